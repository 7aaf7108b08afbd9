"""Whole runs over rasters, against figures that are known for these scenes."""

import json

import numpy as np
import pytest

from massif import api, cli
from massif.config import InputError
from massif.sources import geotiff
from tests import scenes


def parts(path):
    with open(path) as f:
        doc = json.load(f)
    return doc, {f["id"]: f["properties"] for f in doc["features"]}


def test_stepped_scene(spark, tmp_path):
    f, dsm, dtm = scenes.stepped(tmp_path)
    out = str(tmp_path / "out.geojson")
    heard = []
    got = api.run_elevation(spark, out, f, dsm, dtm, progress=lambda *x: heard.append(x))
    assert (got["num_features"], got["num_parcels"], got["num_buildings"], got["num_skipped"]) == (8, 5, 4, 1) and [h[0] for h in heard] == [1, 2, 3, 4]
    doc, by_id = parts(out)
    want = {"B1-P00": (0, 12, 1600), "B1-P01": (12, 33.75, 400), "B2-P00": (0, 8, 3600), "B2-P01": (8, 20, 2253.42), "B3-P00": (0, 50, 900), "B4-P00": (0, 6, 2100), "B4-P01": (6, 32.5, 225), "B4-P02": (6, 32.5, 225)}
    assert {k: (p["base_height_agl_m"], p["top_height_agl_m"], p["area_m2"]) for k, p in by_id.items()} == want and list(by_id) == list(want)
    assert doc["summary"] == {"building_count": 4, "decomposed_building_count": 3, "part_count": 8, "max_part_level": 1, "max_top_height_agl_m": 50.0, "total_volume_m3": 153266.04, "skipped_building_count": 1, "skipped_buildings": [{"object_id": "B5_out", "reason": "OUTSIDE_ANALYSIS_GRID"}], "validation": {"status": "passed", "checked_parts": 8}}
    p = by_id["B2-P01"]
    assert (p["perimeter_m"], p["interior_ring_count"], p["ground_elevation_m"], p["support_pixel_count"], p["parent_part_id"]) == (262.81, 1, 12.2, 224364, "B2-P00") and p["name"] == "Object B2" and p["id"] == "B2"
    assert abs(p["expected_pixel_count"] - 225342) <= 4 and p["valid_coverage_ratio"] == 1.0 and p["parent_containment_ratio"] == 1.0 and p["geometry_method"] == "simplified"
    assert doc["processing"]["working_crs"] == "EPSG:32750" and doc["inputs"]["dtm"]["crs"] == "EPSG:4326" and doc["processing"]["parameters"]["keep_properties"] == ["id", "name"]
    assert api.validate_file(spark, out) == 8
    exported = api.export_file(spark, out, ["glb", "cityjson"])
    assert [a["volume_m3"] for a in exported["artifacts"]] == pytest.approx([153266.04] * 2, rel=1e-4)
    again = api.run_elevation(spark, out, f, dsm, dtm, max_height_classes=8, regularize=True)
    doc, by_id = parts(out)
    assert again["num_features"] == 10 and doc["summary"]["max_part_level"] == 2 and doc["summary"]["total_volume_m3"] == 153266.04
    assert {k: (p["parent_part_id"], p["top_height_agl_m"], p["area_m2"]) for k, p in by_id.items() if k[:2] in ("B1", "B4")} == {"B1-P00": (None, 12, 1600), "B1-P01": ("B1-P00", 30, 400), "B1-P02": ("B1-P01", 45, 100), "B4-P00": (None, 6, 2100), "B4-P01": ("B4-P00", 25, 225), "B4-P02": ("B4-P00", 25, 225), "B4-P03": ("B4-P02", 40, 225)}
    stopped = api.run_elevation(spark, str(tmp_path / "none.geojson"), f, dsm, dtm, cancel=lambda: True)
    assert stopped["cancelled"] and not (tmp_path / "none.geojson").exists()


def test_courtyard_scene_and_properties(spark, tmp_path):
    f, dsm, dtm = scenes.courtyard(tmp_path)
    scenes.footprints(tmp_path / "g.geojson", {"G1": (10, 10, 90, 90)}, part_id="mine", volume_m3=1.5, top_height_agl_m="x", extra=[1, {"a": None}])
    out = str(tmp_path / "out.geojson")
    assert cli.main(["run", "--footprints", str(tmp_path / "g.geojson"), "--dsm", dsm, "--dtm", dtm, "--output", out], spark) == 0
    doc, by_id = parts(out)
    p = by_id["G1-P01"]
    assert doc["summary"]["total_volume_m3"] == 105223.64 and (p["area_m2"], p["interior_ring_count"], p["perimeter_m"], p["support_pixel_count"]) == (4501.97, 3, 389.4, 447659)
    assert (p["src_part_id"], p["src_volume_m3"], p["src_top_height_agl_m"], p["extra"]) == ("mine", 1.5, "x", [1, {"a": None}]) and p["part_id"] == "G1-P01"
    assert cli.main(["run", "--footprints", f, "--dsm", dsm, "--dtm", str(tmp_path / "no.tif"), "--output", out], spark) == 2
    with pytest.raises(InputError):
        api.run_elevation(spark, out, f, dsm, dtm, keep_properties=("name",), raster_drivers=("PNG",))


def test_trees_of_a_dome(spark, tmp_path):
    r, c = np.mgrid[0:100, 0:100]
    d = np.hypot(r - 50, c - 50)
    h = np.where(d <= 12, 12 * np.cos(d / 12 * np.pi / 2), 0.0)
    geotiff.write(str(tmp_path / "dsm.tif"), 5 + h, scenes.X0, scenes.Y0, 0.5, -0.5, 32750, -9999)
    geotiff.write(str(tmp_path / "dtm.tif"), np.full(h.shape, 5.0), scenes.X0, scenes.Y0, 0.5, -0.5, 32750, -9999)
    f = scenes.footprints(tmp_path / "f.geojson", {"TREE_001": (19, 19, 31.5, 31.5), "LOW": (2, 2, 6, 6), "OUT": (500, 500, 510, 510)}, species="any")
    out = str(tmp_path / "out.geojson")
    got = api.run_elevation(spark, out, f, str(tmp_path / "dsm.tif"), str(tmp_path / "dtm.tif"), mode="tree")
    assert got["num_trees"] == 1 and got["num_skipped"] == 2
    doc, trees = parts(out)
    (tree,) = trees.values()
    assert tree["object_id"] == "TREE_001" and tree["ground_m"] == pytest.approx(5.0) and tree["height_m"] == pytest.approx(12.0, abs=0.1) and tree["carbon_kg"] > 0 and tree["species"] == "any"
    lon, lat = doc["features"][0]["geometry"]["coordinates"]
    x, y = scenes.projection.forward(32750, lon, lat)
    assert (float(x) - scenes.X0, scenes.Y0 - float(y)) == pytest.approx((25.25, 25.25), abs=0.01)
    tiers, by_id = parts(got["tiers_path"])
    own = [f["properties"] for f in tiers["features"]]
    assert [t["part_level"] for t in own] == [0, 1, 2] and [t["parent_part_id"] for t in own] == [None, "TREE_001-P00", "TREE_001-P01"]
    areas = [t["crown_area_m2"] for t in own]
    assert areas == sorted(areas, reverse=True) and own[0]["base_height_agl_m"] > 0 and own[2]["top_height_agl_m"] == pytest.approx(12.0, abs=0.1) and areas[2] > 0.2
    with open(got["summary_path"]) as s:
        summary = json.load(s)
    assert summary["n_trees"] == 1 and summary["carbon_t"] > 0 and summary["rejected"] == {"LOW_VEGETATION_OR_GROUND": 1, "NO_VALID_RASTER_DATA": 1}
