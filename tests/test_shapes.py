import json
import math

import numpy as np
import pytest

from massif import cli
from massif.functions import overlay, shapes
from massif.operators import hierarchy, raster, trees
from massif.sources import exports, scene

L = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 9), (0, 9)]
HOLE = [(1, 1), (1, 2), (2, 2), (2, 1)]


@pytest.mark.parametrize("rings", [[L], [L, HOLE], [L, HOLE, [(6, 1), (6, 3), (9, 3), (9, 1)]], [[(0, 0), (5, 0), (10, 0), (10, 5), (10, 10), (0, 10)]]])
def test_prisms_are_closed_and_have_their_volume(rings):
    rings = [np.array(r, float) for r in rings]
    points, faces = shapes.prism(rings, 3.0, 8.0)
    area = sum(map(shapes.signed_area, rings))
    assert shapes.closed(faces) and shapes.volume(points, faces) == pytest.approx(5 * area)
    length = sum(map(shapes.perimeter, rings))
    assert exports.surface(points, faces) == pytest.approx(2 * area + 5 * length)


def test_rectangles_circles_and_regular_shapes():
    t = math.radians(30)
    turn = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
    box = np.array([(0, 0), (10, 0), (10, 4), (0, 4)]) @ turn
    assert shapes.metrics(box) == pytest.approx((10, 4, 60))
    rng = np.random.default_rng(3)
    p = rng.normal(size=(40, 2))
    x, y, r = shapes.circle(p)
    away = np.hypot(p[:, 0] - x, p[:, 1] - y)
    assert away.max() == pytest.approx(r) and (away > r - 1e-9).sum() >= 2
    region, how = shapes.regularize(box, [HOLE])
    assert overlay.area(region) == pytest.approx(40) and overlay.holes(region) == 0 and how == "minimum_rotated_rectangle"
    a = np.arange(40) * (2 * math.pi / 40)
    region, how = shapes.regularize(20 * np.stack([np.cos(a), np.sin(a)], axis=1))
    assert len(region[0][0]) == 32 and np.hypot(*region[0][0].T) == pytest.approx(20.0) and how == "minimum_bounding_circle"
    assert shapes.regularize(box, regular=False)[1] == "simplified"
    wobbly = np.array(L, float) + [[0, 0.1], [0, 0], [0.1, 0], [0, 0.1], [0, 0], [0, 0.1]]
    steps = np.roll(shapes.orthogonal(wobbly), -1, axis=0) - shapes.orthogonal(wobbly)
    assert len(steps) == 6 and np.abs((steps * np.roll(steps, -1, axis=0)).sum(axis=1)).max() < 1e-9


def test_a_round_outline_of_pixels_becomes_a_circle():
    r, c = np.mgrid[0:40, 0:40]
    (disk,) = overlay.outlines((r - 20) ** 2 + (c - 20) ** 2 <= 15**2)
    raw = 4 * math.pi * shapes.signed_area(disk[0]) / shapes.perimeter(disk[0]) ** 2
    assert raw < 0.8 and shapes.regularize(disk[0])[1] == "minimum_bounding_circle"


def test_holes_are_cut_out_of_the_regular_shell():
    t = math.radians(20)
    turn = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
    shell = np.array([(0, 0), (20, 0), (20, 9.8), (10, 10), (0, 9.9)]) @ turn
    hole, crossing = np.array([(4, 3), (4, 6), (8, 6), (8, 3)]) @ turn, np.array([(15, 8), (15, 12), (18, 12), (18, 8)]) @ turn
    region, how = shapes.regularize(shell, [hole, crossing])
    assert how == "minimum_rotated_rectangle" and overlay.valid(region) and overlay.holes(region) == 1
    assert overlay.area(region) == pytest.approx(20 * 9.9 - 12 - 3 * 1.9, abs=0.05)  # the middle of the top is within the tolerance


def test_runs_lie_at_the_plain_mean_of_their_edges():
    ring = np.array([(0, 0), (9, 0), (10, 0.6), (10, 20), (0, 20)], float)  # bottom: a long edge at 0 and a short one at 0.3
    got = shapes.orthogonal(ring)
    u = got[np.argsort(got[:, 1])][:2]
    assert np.abs(u[:, 1] - u[:, 1].mean()).max() < 0.05 and u[:, 1].mean() == pytest.approx(0.15, abs=0.05)


def test_simplified_rings_stay_simple_and_keep_a_triangle():
    slit = np.array([(0.5, 10), (0, 9.7), (0, 0.3), (0.3, 0), (0.5, 0), (0.8, 0.3), (0.8, 9.7)])
    assert len(shapes.simplify(slit, 0.9)) == 3
    rng = np.random.default_rng(4)
    for _ in range(30):
        t = np.sort(rng.random(40)) * 2 * math.pi
        star = np.stack([np.cos(t), np.sin(t)], axis=1) * (3 + 4 * rng.random(40))[:, None]
        assert overlay.valid([[shapes.simplify(star, 1.5)]])


def test_two_domes_are_two_trees_and_a_branch_is_none():
    r, c = np.mgrid[0:30, 0:50]
    dome = lambda y, x, h, w: h * np.exp(-((r - y) ** 2 + (c - x) ** 2) / (2 * w * w))
    config = trees.EngineConfig()
    two = np.maximum(dome(15, 12, 10, 4), dome(15, 36, 8, 4))
    found = trees.peaks(two, two > 0.5, 10.0, 1.0, config)
    assert [(y, x) for _, y, x in found] == [(15, 12), (15, 36)]
    # a top of a few cells stands out by its own height, though its smoothed height is close to the saddle's
    flat = np.full((30, 50), 6.0)
    flat[14:17, 9:12], flat[14:17, 18:21] = 8.5, 7.5
    smooth = raster.gaussian(flat)
    low = min(smooth[15, 10], smooth[15, 19])
    assert low - smooth[15, 10:20].min() < 1.2 + 0.3 and len([f for f in trees.peaks(flat, flat > 0, 10.0, 1.0, config) if f[0] > 7]) == 2
    branch = np.maximum(dome(15, 12, 10, 5), dome(15, 18, 9, 5))
    assert len(trees.peaks(branch, branch > 0.5, 10.0, 1.0, config)) == 1


def test_run_validate_and_export(spark, data, tmp_path, capsys):
    px, out = str(tmp_path / "px"), str(tmp_path / "parts.geojson")
    scene.towers(spark, data).filter("object_id <= 3").write.parquet(px)
    assert cli.main(["run", "--pixels", px, "--output", out, "--export", "glb,cityjson,citygml"], spark) == 0
    result = json.loads(capsys.readouterr().out.splitlines()[-1])
    want = hierarchy.summary(hierarchy.parts(spark.read.parquet(px))).first()
    assert (result["num_features"], result["num_buildings"]) == (want.n_parts, want.n_objects)
    assert [a["volume_m3"] for a in result["export"]["artifacts"]] == pytest.approx([want.total_volume_m3] * 3, abs=0.05)
    assert cli.main(["validate", out], spark) == 0
    with open(out) as f:
        whole = f.read()
    for change in (lambda d: d["features"][0]["properties"].update(part_height_m=99.0), lambda d: d["features"][1].update(id="x"), lambda d: d["features"][1]["geometry"]["coordinates"][0][0].__setitem__(0, [-90.0, -90.0])):
        doc = json.loads(whole)
        change(doc)
        with open(out, "w") as f:
            json.dump(doc, f)
        assert cli.main(["validate", out], spark) == 3
    for change, word in ((lambda p: p.pop("area_m2"), "area_m2 isn't there"), (lambda p: p.update(part_level="0"), "part_level isn't whole"), (lambda p: p.update(part_level=0.5), "part_level isn't whole"), (lambda p: p.update(object_id=None), "object_id isn't text")):
        doc = json.loads(whole)
        change(doc["features"][0]["properties"])
        with open(out, "w") as f:
            json.dump(doc, f)
        capsys.readouterr()
        assert cli.main(["validate", out], spark) == 3 and word in capsys.readouterr().out
    assert cli.main(["export", out, "--formats", "obj"], spark) == 2
    assert cli.main(["run", "--pixels", px, "--output", out, "--max-height-classes", "0"], spark) == 2
    tree = str(tmp_path / "trees.geojson")
    assert cli.main(["run", "--pixels", px, "--output", tree, "--mode", "tree"], spark) == 0
    stop = tmp_path / "CANCEL"
    stop.touch()
    assert cli.main(["run", "--pixels", px, "--output", str(tmp_path / "none.geojson"), "--cancel-file", str(stop)], spark) == 130 and not (tmp_path / "none.geojson").exists()
    assert json.load(open(tree))["features"][0]["geometry"]["type"] == "Point"


def test_attributes_keep_their_types(spark, tmp_path):
    import xml.etree.ElementTree as ET

    own = {"t": "é <&>", "n": 3, "x": 2.5, "ok": True, "none": None, "deep": {"a": [1]}, "big": 2**40}
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]]
    rows = [("o", "o-P00", None, [ring], 1.0, 5.0, json.dumps(own))]
    parts = spark.createDataFrame(rows, "object_id string, part_id string, parent_part_id string, rings array<array<array<double>>>, base_elevation_m double, top_elevation_m double, attributes string")
    source = tmp_path / "source.geojson"
    source.write_text("{}")
    doc = exports.export(parts, str(tmp_path), "out", ["glb", "cityjson", "citygml"], "EPSG:32750", str(source))
    assert doc["source"]["sha256"] == exports.file_digest(source) and [a["volume_m3"] for a in doc["artifacts"]] == pytest.approx([48.0] * 3)
    want = {"t": "é <&>", "n": 3, "x": 2.5, "ok": True, "deep": '{"a": [1]}', "big": 2**40}
    city = json.loads((tmp_path / "out.city.json").read_text())["CityObjects"]["o-P00"]["attributes"]
    assert {k: city[k] for k in want} == want and "none" not in city and city["ok"] is True
    gen = "{http://www.opengis.net/citygml/generics/2.0}"
    found = {e.get("name"): (e.tag.removeprefix(gen), e[0].text) for e in ET.parse(tmp_path / "out.gml").iter() if e.tag.startswith(gen) and e.get("name")}
    assert found["n"] == ("intAttribute", "3") and found["x"] == ("doubleAttribute", "2.5") and found["ok"] == ("stringAttribute", "true") and found["big"] == ("intAttribute", str(2**40)) and found["t"] == ("stringAttribute", "é <&>") and "none" not in found


def test_reference_systems():
    assert [exports.reference_system("EPSG:32750", v)["state"] for v in (None, "local", "EPSG:5773")] == ["unknown", "label_only", "explicit"]
    assert exports.reference_system("EPSG:32750+5773")["urn"].endswith("crs:EPSG::32750,crs:EPSG::5773")
    with pytest.raises(exports.InputError):
        exports.reference_system("nowhere")
