import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from massif.config import EngineConfig, InputError
from massif.functions import overlay, projection, scalar
from massif.operators import cluster, hierarchy, raster, trees, validate, zonal
from massif.sources import geojson


def lloyd(v, k):
    c = np.unique(np.quantile(v, np.linspace(0, 1, min(k, len(np.unique(v))))))
    for _ in range(60):
        label = (v[:, None] > (c[1:] + c[:-1]) / 2).sum(axis=1)
        new = np.array([v[label == j].mean() if (label == j).any() else c[j] for j in range(len(c))])
        if np.abs(new - c).max() < 1e-6:
            return new
        c = new
    return c


def histogram(v):
    return tuple(x.astype(float) for x in np.unique(v, return_counts=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=80), st.integers(1, 6))
def test_kmeans_equals_the_plain_method(values, k):
    v = np.array(values, float) / 4
    assert np.allclose(cluster.centers_of(*histogram(v), k), lloyd(v, k), atol=1e-9)


def test_kmeans_of_many_distinct_heights():
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(6, 0.5, 900), rng.normal(21, 1.2, 500), rng.normal(40, 0.2, 50)])
    assert np.allclose(cluster.centers_of(*histogram(v), 5), lloyd(v, 5), atol=1e-10)


def test_kmeans_in_columns_equals_the_plain_method(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(2, 40))) for i in range(3) for _ in range(200)] + [(9, 5.0)]
    px = spark.createDataFrame(rows, "object_id int, dsm double").withColumn("dtm", F.lit(0.0))
    got = {r.object_id: r.centers for r in cluster.kmeans(cluster.histograms(px, 2.0), 4).collect()}
    assert set(got) == {0, 1, 2, 9}
    for i, centers in got.items():
        assert np.allclose(centers, lloyd(np.array([v for o, v in rows if o == i]), 4), atol=1e-9)


def boxes(shape, *parts):
    z = np.zeros(shape)
    for y, x, h, w, top in parts:
        z[y : y + h, x : x + w] = top
    return z


def tiers(dsm, inside, **given):
    c = EngineConfig(**given)
    found = hierarchy.decompose(overlay.outlines(inside), inside, dsm + 10.0, np.full(dsm.shape, 10.0), c)
    return [(p.found, p.base, p.top, round(overlay.area(p.region))) for p in found]


def test_podium_and_tower():
    z = boxes((60, 60), (10, 10, 40, 40, 12.0), (20, 20, 20, 20, 30.0))
    assert tiers(z, z > 0) == [(0, 0.0, 12.0, 1600), (1, 12.0, 30.0, 400)]


def test_two_towers_in_order_and_uniform():
    z = boxes((60, 100), (10, 10, 30, 70, 6.0), (15, 15, 15, 15, 25.0), (15, 55, 15, 15, 25.0))
    assert tiers(z, z > 0) == [(0, 0.0, 6.0, 2100), (1, 6.0, 25.0, 225), (1, 6.0, 25.0, 225)]
    z = boxes((60, 60), (10, 10, 30, 30, 50.0))
    assert tiers(z, z > 0) == [(0, 0.0, 50.0, 900)]


def test_merged_levels_raise_the_height():
    rng = np.random.default_rng(0)
    z = boxes((70, 70), (10, 10, 40, 40, 12.0), (20, 20, 20, 20, 30.0), (25, 25, 10, 10, 45.0))
    assert [t[:3] for t in tiers(z, z > 0)][:2] == [(0, 0.0, 12.0), (1, 12.0, 33.75)]
    got = tiers(z + np.where(z > 0, rng.normal(0, 0.15, z.shape), 0), z > 0, max_height_classes=8)
    assert [t[0] for t in got] == [0, 1, 2] and [t[2] for t in got] == pytest.approx([12, 30, 45], abs=0.1)


def test_holes_fill_up_to_their_limit():
    m = np.ones((12, 12), bool)
    m[2:4, 2:4] = False
    m[6:10, 6:10] = False
    out = raster.fill_small_holes(m, 4.0)
    assert out[2:4, 2:4].all() and not out[6:10, 6:10].any()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=7, max_size=7), min_size=5, max_size=9))
def test_labels_and_rings(rows):
    m = np.array(rows)
    labels, n = raster.label(m)
    assert set(labels[m].tolist()) == set(range(1, n + 1)) and not labels[~m].any()
    for a, b in ((m[1:] & m[:-1], (labels[1:], labels[:-1])), (m[:, 1:] & m[:, :-1], (labels[:, 1:], labels[:, :-1]))):
        assert (b[0][a] == b[1][a]).all()
    eight, many = raster.label(m, eight=True)
    assert set(eight[m].tolist()) == set(range(1, many + 1)) and many <= n
    for a, b in ((m[1:, 1:] & m[:-1, :-1], (eight[1:, 1:], eight[:-1, :-1])), (m[1:, :-1] & m[:-1, 1:], (eight[1:, :-1], eight[:-1, 1:]))):
        assert (b[0][a] == b[1][a]).all()
    firsts = [int(np.flatnonzero(labels.ravel() == k)[0]) for k in range(1, n + 1)]
    assert firsts == sorted(firsts) and len(overlay.outlines(m)) == n


def test_closing_in_rows_equals_the_kernel(spark):
    rng = np.random.default_rng(3)
    m = rng.random((12, 12)) < 0.4
    rows = [(1, int(r), int(c)) for r, c in zip(*np.nonzero(m), strict=True)]
    got = raster.closing(spark.createDataFrame(rows, "object_id int, row int, col int"), 2, 12, 12).collect()
    want = raster.close_mask(m, 2)
    assert {(r.row, r.col) for r in got} == set(zip(*np.nonzero(want), strict=True))


def test_watershed_and_gaussian():
    z = np.array([[0, 1, 5, 1, 0]] * 3, float)
    marks = np.zeros((3, 5), int)
    marks[1, 0], marks[1, 4] = 1, 2
    flooded = raster.watershed(z, marks, np.ones((3, 5), bool))
    assert (flooded[:, :2] == 1).all() and (flooded[:, 3:] == 2).all()
    assert np.allclose(raster.gaussian(np.full((6, 6), 3.0)), 3.0)


def test_config():
    assert EngineConfig().override(max_height_classes=8, round_digits=None).max_height_classes == 8
    for bad in ({"nonsense": 1}, {"max_height_classes": 0}, {"base_elevation_stat": "mode"}, {"min_footprint_change_ratio": 2.0}, {"working_crs": "EPSG:4326"}, {"working_crs": "nowhere"}):
        with pytest.raises(InputError):
            EngineConfig().override(**bad)


SQUARE = {"type": "Polygon", "coordinates": [[[117.0, -5.0], [117.001, -5.0], [117.001, -5.001], [117.0, -5.001], [117.0, -5.0]]]}


def collection(path, features, **more):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features, **more}))
    return str(path)


def feature(props, geometry=SQUARE):
    return {"type": "Feature", "id": 7, "properties": props, "geometry": geometry}


def test_geojson_ids(spark, tmp_path):
    def read(ids, field=None):
        path = collection(tmp_path / "f.geojson", [feature({"id": i, "a.b": f"c{k}"}, None) for k, i in enumerate(ids)])
        got, label = geojson.read_footprints(spark, path, "EPSG:32750", field)
        assert label == "EPSG:4326 (RFC 7946 default)"
        return [r.object_id for r in got.orderBy("ord").collect()]

    assert read([" A ", 2, 3.0, "007", 7, "1.0", 1, 1.5, "a}", "true"]) == ["A", "2", "3", "007", "7", "1.0", "1", "1.5", "a}", "true"]
    assert read([None, True], "a.b") == ["c0", "c1"]
    for bad in ([1, "1"], [1, None], [1, "  "], [1, True], [1, [2]], []):
        with pytest.raises(InputError):
            read(bad)


def test_footprints_in_any_form(spark, tmp_path):
    bow = {"type": "Polygon", "coordinates": [[[500000, 9e6], [500020, 9000020], [500020, 9e6], [500000, 9000020], [500000, 9e6]]]}
    both = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, bow]}
    rows = [feature({"id": 1, "k": 1}, bow), feature({"id": 2}, {"type": "Point", "coordinates": [1, 2]}), feature({"id": 3}, None), feature({"id": 4}, both), feature({"id": 5}, {"type": "MultiPolygon", "coordinates": []})]
    path = collection(tmp_path / "f.geojson", rows, crs={"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32750"}})
    got = geojson.read_footprints(spark, path, "EPSG:32750", keep=("k",))[0].orderBy("ord").collect()
    assert [None if r.polygons is None else overlay.area(hierarchy.opened(r.polygons)) for r in got] == [pytest.approx(200), None, None, pytest.approx(200), None]
    assert json.loads(got[0].props) == {"k": 1} and json.loads(got[1].props) == {"k": None}
    lines = tmp_path / "f.geojsonl"
    lines.write_text("\n".join(json.dumps(feature({"id": f"x{i}"})) for i in range(50)) + "\n\n")
    got = geojson.read_footprints(spark, str(lines), "EPSG:32750")[0].orderBy("ord").collect()
    assert [r.object_id for r in got] == [f"x{i}" for i in range(50)] and overlay.area(hierarchy.opened(got[0].polygons)) == pytest.approx(111 * 110.6, rel=0.01)
    for text in ("[]", '{"type": "Point"}', json.dumps({"type": "FeatureCollection", "crs": {"type": "name"}, "features": rows}), json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "none"}}, "features": rows})):
        (tmp_path / "bad.geojson").write_text(text)
        with pytest.raises(InputError):
            geojson.read_footprints(spark, str(tmp_path / "bad.geojson"), "EPSG:32750")


def test_output_geometry_is_rounded_turned_and_repaired():
    ring = np.array([(0, 0), (0, 10), (10, 10), (10, 0)], float) + (500000.0, 9e6)
    hole = np.array([(2, 2), (4, 2), (4, 4), (2, 4)], float) + (500000.0, 9e6)
    doc = json.loads(geojson.geometry_json(hierarchy.closed([[ring, hole]]), 32750, 7))
    shell, inner = (np.array(r) for r in doc["coordinates"])
    assert doc["type"] == "Polygon" and overlay.signed_area(shell[:-1]) > 0 > overlay.signed_area(inner[:-1])
    assert np.array_equal(np.round(shell, 7), shell) and (shell[0] == shell[-1]).all()
    two = json.loads(geojson.geometry_json(hierarchy.closed([[ring], [ring + 50]]), 32750, 7))
    assert two["type"] == "MultiPolygon" and projection.metric(32750)


def test_a_collection_is_written_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([(i, json.dumps({"n": i})) for i in (2, 0, 1)], "k int, feature string")
    path = tmp_path / 'a "b".geojson'
    geojson.write_collection(rows, ["k"], str(path), {"summary": {"x": None}})
    doc = json.loads(path.read_text())
    assert doc["name"] == 'a "b"' and doc["summary"] == {"x": None} and [f["n"] for f in doc["features"]] == [0, 1, 2]
    with pytest.raises(ValueError):
        geojson.write_collection(rows, ["k"], str(path), {"summary": {"x": float("nan")}})
    assert json.loads(path.read_text()) == doc and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(ValueError):
        geojson.write_json({"x": float("inf")}, str(tmp_path / "s.json"))
    assert len(list(tmp_path.iterdir())) == 1


def test_own_names_are_the_columns():
    assert scalar.CANONICAL == tuple(hierarchy.COLUMNS) and len(scalar.CANONICAL) == 26


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30), st.integers(0, 9))
def test_half_even_equals_exact_rounding(spark, values, digits):
    values += [2.675, 0.125, 0.5, 1.5, -2.5, 1.005]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", scalar.half_even(F.col("v"), digits).alias("r")).collect()
    assert all(r.r == round(values[r.i], digits) for r in got)


def test_names_take_the_first_free_suffix(spark):
    names = ["a", "a", "a_01", "b", "a", "b_01", "b", "a_01_01"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, tree_id string")
    got = [r.tree_id for r in trees.first_free_ids(df, "tree_id", ["i"]).orderBy("i").collect()]
    assert got == ["a", "a_01", "a_01_01", "b", "a_02", "b_01", "b_02", "a_01_01_01"]


def test_missing_cells_are_null(spark):
    rows = [(1.0,), (float("nan"),), (-9999.0,), (None,)]
    df = spark.createDataFrame(rows, "z double")
    assert [r.z for r in df.select(zonal.missing_to_null(F.col("z"), -9999.0).alias("z")).collect()] == [1.0, None, None, None]
    assert [r.z for r in df.select(zonal.missing_to_null(F.col("z"), None).alias("z")).collect()] == [1.0, None, -9999.0, None]


def test_a_cube_is_closed(spark):
    quads = [(0, 1, 2, 3), (7, 6, 5, 4), (0, 4, 5, 1), (1, 5, 6, 2), (2, 6, 7, 3), (3, 7, 4, 0)]
    rows = [(1, q[i], q[(i + 1) % 4]) for q in quads for i in range(4)]
    edges = spark.createDataFrame(rows, "shell_id int, a int, b int")
    assert validate.shell_edges(edges).count() == 0
    assert validate.shell_edges(spark.createDataFrame(rows[1:], edges.schema)).count() == 1


def test_footprints_are_dealt_by_tile_and_not_broadcast(spark, data):
    from massif.plans import catalogue

    plan = catalogue.QUERIES["range_join_footprint_pixels"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_local_maxima_see_past_gaps(spark):
    rng = np.random.default_rng(3)
    cells = {(k, int(r), int(c)): float(rng.integers(0, 30)) for k in range(3) for r in range(9) for c in range(-3, 9) if rng.random() < 0.4}
    df = spark.createDataFrame([(*at, v + 5, 5.0) for at, v in cells.items()], "object_id long, row int, col int, dsm double, dtm double")
    want = {at for at, v in cells.items() if v > 0 and all(cells.get((at[0], at[1] + i, at[2] + j), 0) <= v for i in range(-2, 3) for j in range(-2, 3))}
    assert {tuple(r)[:3] for r in raster.local_maxima(df, 2).collect()} == want
