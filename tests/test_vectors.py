import json
import sqlite3
import struct

import pyarrow as pa
import pyarrow.parquet
import pytest

from massif.config import InputError
from massif.functions import overlay
from massif.operators.hierarchy import opened
from massif.sources import geojson, vectors

RINGS = [[(500000, 9e6), (500000, 9000010), (500010, 9000010), (500010, 9e6), (500000, 9e6)], [(500002, 9000002), (500004, 9000002), (500004, 9000004), (500002, 9000004), (500002, 9000002)]]
PRJ = 'PROJCS["WGS_1984_UTM_Zone_50S",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]]]]'


def wkb(rings, order="<", z=False):
    out = struct.pack(order + "BII", order == "<", 1003 if z else 3, len(rings))
    for r in rings:
        out += struct.pack(order + "I", len(r)) + b"".join(struct.pack(f"{order}{2 + z}d", *p, *([1.0] * z)) for p in r)
    return out


def areas(got):
    return [None if r.polygons is None else round(overlay.area(opened(r.polygons)), 3) for r in got.orderBy("ord").collect()]


def shapefile(folder, n):
    main, index, table, at = b"", b"", b"", 50
    for k in range(n):
        rings = RINGS if k % 2 else RINGS[:1]
        flat = [p for r in rings for p in r]
        starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
        body = struct.pack("<i4dii", 5, 0, 0, 0, 0, len(rings), len(flat)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in flat)
        body = body if k % 3 else struct.pack("<i", 0)
        main += struct.pack(">II", k + 1, len(body) // 2) + body
        index += struct.pack(">II", at, len(body) // 2)
        at += 4 + len(body) // 2
        table += b" " + f"o{k}".ljust(6).encode() + f"{k}".rjust(5).encode() + f"{k / 2:.2f}".rjust(8).encode() + (b"T" if k % 2 else b"?")
    head = lambda data: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(data) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8)
    (folder / "f.shp").write_bytes(head(main) + main)
    (folder / "f.shx").write_bytes(head(index) + index)
    fields = b"".join(name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([size, dec]) + b"\0" * 14 for name, kind, size, dec in (("id", "C", 6, 0), ("n", "N", 5, 0), ("x", "N", 8, 2), ("ok", "L", 1, 0)))
    (folder / "f.dbf").write_bytes(struct.pack("<4BIHH", 3, 1, 1, 1, n, 33 + len(fields), 21) + b"\0" * 20 + fields + b"\r" + table)
    (folder / "f.prj").write_text(PRJ)
    return str(folder / "f.shp")


def test_shapefile(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 4)
    path = shapefile(tmp_path, 11)
    got, label = geojson.read_footprints(spark, path, "EPSG:32750")
    assert label == "EPSG:32750" and areas(got) == [None if k % 3 == 0 else 96.0 if k % 2 else 100.0 for k in range(11)]
    rows = got.orderBy("ord").collect()
    assert [r.object_id for r in rows] == [f"o{k}" for k in range(11)] and json.loads(rows[3].props) == {"id": "o3", "n": 3, "x": 1.5, "ok": True}
    (tmp_path / "f.prj").unlink()
    with pytest.raises(InputError):
        geojson.read_footprints(spark, path, "EPSG:32750")


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "f.gpkg")
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE gpkg_contents (table_name, data_type); CREATE TABLE gpkg_geometry_columns (table_name, column_name, srs_id); CREATE TABLE gpkg_spatial_ref_sys (srs_id, organization, organization_coordsys_id);"
                         "INSERT INTO gpkg_contents VALUES ('my \"shapes', 'features'); INSERT INTO gpkg_geometry_columns VALUES ('my \"shapes', 'geom', 9); INSERT INTO gpkg_spatial_ref_sys VALUES (9, 'epsg', 32750); CREATE TABLE \"my \"\"shapes\" (id INTEGER, geom BLOB, name TEXT);")  # fmt: skip
        head = lambda flags: b"GP\0" + bytes([flags]) + struct.pack("<i", 32750)
        blobs = [head(1) + wkb(RINGS), head(3) + b"\0" * 32 + wkb(RINGS[:1], ">"), head(0x11), None, head(1) + wkb(RINGS, z=True)]
        db.executemany('INSERT INTO "my ""shapes" VALUES (?, ?, ?)', [(i, b, f"n{i}") for i, b in enumerate(blobs)])
    got, label = geojson.read_footprints(spark, path, "EPSG:32750")
    assert label == "EPSG:32750" and areas(got) == [96.0, 100.0, None, None, 96.0]
    assert json.loads(got.orderBy("ord").first().props) == {"id": 0, "name": "n0"}


def test_geoparquet(spark, tmp_path):
    many = struct.pack("<BII", 1, 6, 2) + wkb(RINGS[:1]) + wkb([[(x + 20, y) for x, y in RINGS[0]]])
    table = pa.table({"id": [1, 2, 3], "geometry": pa.array([wkb(RINGS), many, None], pa.binary())})
    meta = {"primary_column": "geometry", "columns": {"geometry": {"crs": {"id": {"authority": "EPSG", "code": 32750}}}}}
    pyarrow.parquet.write_table(table.replace_schema_metadata({"geo": json.dumps(meta)}), tmp_path / "f.parquet")
    got, label = geojson.read_footprints(spark, str(tmp_path / "f.parquet"), "EPSG:32750")
    assert label == "EPSG:32750" and areas(got) == [96.0, 200.0, None]


def test_systems_by_text():
    assert vectors.system_of(PRJ) == "EPSG:32750" and vectors.system_of(PRJ.replace("50S", "7N")) == "EPSG:32607"
    assert vectors.system_of('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]') == "EPSG:4326" and vectors.system_of(PRJ[:-1] + ',AUTHORITY["EPSG","32749"]]') == "EPSG:32749"
    for bad in ("", 'PROJCS["ETRS_1989_LAEA"]'):
        with pytest.raises(InputError):
            vectors.system_of(bad)
