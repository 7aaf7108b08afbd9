import time

import numpy as np
import pyarrow as pa
import pytest

from massif.functions import overlay as ov
from massif.functions import shape_columns
from massif.functions.regions import Regions, apart, areas
from massif.operators import hierarchy, validate

SHAPE = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))
KINDS = "polygons array<array<array<array<double>>>>"


def star(rng, n, x, y, r):
    t = np.sort(rng.random(n)) * 2 * np.pi
    return np.stack([x + r * (0.3 + rng.random(n)) * np.cos(t), y + r * (0.3 + rng.random(n)) * np.sin(t)], axis=1)


def box(x, y, w, h):
    return [[np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)]]


def column(regions):
    return Regions.of_column(pa.array([None if r is None else hierarchy.closed(r) for r in regions], SHAPE))


def shared(x, y):
    met = ~apart(x, y)
    return areas(met, [x, y], [lambda w: (w % 2 == 1).all(axis=1), lambda w: (w[:, 0] % 2 == 1) & (w[:, 1] % 2 == 0)])


def test_areas_of_many_equal_those_of_each():
    rng = np.random.default_rng(5)
    one, other = [], []
    for k in range(150):
        o = rng.choice([0.0, 770_000.0])
        a, b = [
            lambda: ([[rng.random((7, 2)) * 10 + o]], [[rng.random((5, 2)) * 10 + o]]),  # crossed rings
            lambda: (ov.outlines(rng.random((5, 6)) < 0.5), ov.outlines(rng.random((5, 6)) < 0.6)),  # shared edges, several polygons
            lambda: ([[star(rng, 8, o, 0, 4), star(rng, 5, o, 0, 1)]], [[star(rng, 9, o + 1, 1, 4)], [star(rng, 9, o + 3, 1, 4)]]),  # holes, polygons that overlap
            lambda: (box(o, 0, 4, 0), box(o, 0, 2, 2)),  # flat
            lambda: (box(o, 0, 4, 4), [] if k % 2 else box(o + 4, 0, 1, 1)),  # none, side by side
        ][k % 5]()
        one, other = [*one, a], [*other, b]
    x, y = column(one), column(other)
    size = areas(np.ones(x.n, bool), [x.united()], [lambda w: w[:, 0] % 2 == 1])[:, 0]
    both, left = shared(x.united(), y.united()).T
    met = ~apart(x, y)
    winding = np.where(met, areas(met, [x, y], [lambda w: (w[:, 0] > 0) & (w[:, 1] <= 0)])[:, 0], x.area())
    for k, (a, b) in enumerate(zip(one, other, strict=True)):
        p, q = ov.repaired(a), ov.repaired(b)
        assert size[k] == pytest.approx(ov.area(p), abs=1e-5) and both[k] == pytest.approx(ov.area(ov.intersection(p, q)), abs=1e-5)
        if not apart(x.united(), y.united())[k]:
            assert left[k] == pytest.approx(ov.outside(p, q) if p else 0.0, abs=1e-5)
        assert winding[k] == pytest.approx(ov.outside(a, b), abs=1e-5)
        assert x.area()[k] == pytest.approx(ov.area(a)) and x.length()[k] == pytest.approx(ov.length(a))


def test_many_pairs_take_much_less_than_one_by_one():
    one, other = [box(k % 7, 0, 10, 10) for k in range(4000)], [box(3, 2, 10, 10) for _ in range(4000)]
    x, y = column(one), column(other)
    began = time.perf_counter()
    got = shared(x, y)[:, 0]
    together, began = time.perf_counter() - began, time.perf_counter()
    want = [ov.area(ov.intersection(a, b)) for a, b in zip(one[:400], other[:400], strict=True)]
    assert got[:400] == pytest.approx(want) and together / 4000 < (time.perf_counter() - began) / 400 / 3


def test_overlap_of_missing_and_empty_shapes(spark):
    square = hierarchy.closed(box(0, 0, 4, 4))
    rows = [(1, square, hierarchy.closed(box(1, 1, 4, 4))), (2, square, None), (3, None, square), (4, square, []), (5, hierarchy.closed(box(0, 0, 1, 1) + box(2, 0, 1, 1)), square)]
    got = shape_columns.overlap(spark.createDataFrame(rows, f"k int, {KINDS.replace('polygons', 'a')}, {KINDS.replace('polygons', 'b')}")).orderBy("k").collect()
    assert [tuple(round(z, 9) for z in r) for r in got] == [(1, 9, 7, 0.5625), (2, 0, 16, 0), (3, 0, 0, 0), (4, 0, 16, 0), (5, 2, 0, 1)]

def test_geometry_is_checked_without_a_loop_over_rows(spark):
    bow = [[np.array([[0, 0], [2, 2], [2, 0], [0, 2]], float)]]
    shapes = [("r", None, box(0, 0, 10, 10)), ("in", "r", box(1, 1, 3, 3)), ("out", "in", box(3, 3, 9, 9)), ("bow", "r", bow), ("gone", "r", None), ("flat", "r", box(0, 0, 1, 0)), ("two", "r", box(0, 0, 1, 1) + box(11, 0, 1, 1))]
    parts = spark.createDataFrame([("o", name, up, None if s is None else hierarchy.closed(s)) for name, up, s in shapes], f"object_id string, part_id string, parent_part_id string, {KINDS}")
    got = {tuple(r) for r in validate.geometry(parts).collect()}
    invalid = {(name, "the geometry is invalid or has no area") for name in ("bow", "gone", "flat")}
    assert got == invalid | {("out", "it lies outside its parent"), ("out", "it lies outside its root"), ("two", "it lies outside its parent"), ("two", "it lies outside its root")}
    assert "MapInArrow" in validate.geometry(parts)._jdf.queryExecution().toString()
