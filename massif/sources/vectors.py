"""Footprints from Shapefiles, GeoPackages and GeoParquet, as rows like those of GeoJSON.

Records are read where they are needed: a Shapefile by its index's offsets, a GeoPackage by ranges of row ids,
GeoParquet by Spark.  All tasks must see the file (the first two) at its path.
"""

import json
import re
import sqlite3
import struct
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.config import InputError
from massif.sources.geotiff import file_system

ROWS = 2000
SCHEMA = "ord long, properties string, geometry string"


def features(spark: SparkSession, path: str) -> tuple[DataFrame, str, str]:
    """ord, properties and geometry (JSON) of a file's features in order, its system, and how that was found."""
    kind = Path(path).suffix.lower()
    readers = {".shp": _shapefile, ".gpkg": _geopackage, ".parquet": _geoparquet}
    if kind not in readers:
        raise InputError(f"{path} must be one of .geojson, .json, .geojsonl, {', '.join(readers)}")
    try:
        return readers[kind](spark, path)
    except (OSError, struct.error, sqlite3.Error, ValueError, KeyError, IndexError) as e:
        raise e if isinstance(e, InputError) else InputError(f"{path} can't be read: {e!r}") from e


def wkb_geometry(data: bytes) -> dict | None:
    """A well-known binary geometry as GeoJSON: polygons and what holds them; other kinds by their name alone."""
    at = 0

    def take(letter: str, order: str):
        nonlocal at
        (value,) = struct.unpack_from(order + letter, data, at)
        at += struct.calcsize(letter)
        return value

    def one() -> dict:
        nonlocal at
        order = "<" if data[at] else ">"
        at += 1
        code = take("I", order)
        wide = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            at += 4  # a system's number
        code &= 0xFFFF
        wide += {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
        kind = code % 1000
        points = lambda n: [list(struct.unpack_from(f"{order}{wide}d", data, at + 8 * wide * i))[:2] for i in range(n)]

        def line() -> list:
            nonlocal at
            n = take("I", order)
            out = points(n)
            at += 8 * wide * n
            return out

        if kind == 1:
            at += 8 * wide
            return {"type": "Point"}
        if kind == 2:
            return {"type": "LineString", "n": len(line())}
        if kind == 3:
            return {"type": "Polygon", "coordinates": [line() for _ in range(take("I", order))]}
        if kind in (4, 5, 6, 7):
            own = [one() for _ in range(take("I", order))]
            return {"type": "MultiPolygon", "coordinates": [p["coordinates"] for p in own]} if kind == 6 else {"type": "GeometryCollection", "geometries": own}
        raise ValueError(f"geometry kind {code} isn't known")

    return one() if data else None


def system_of(wkt: str) -> str:
    """The EPSG name of a system given as well-known text."""
    codes = re.findall(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]', wkt)
    if codes:
        return f"EPSG:{codes[-1]}"
    zone = re.search(r"(?i)UTM[_ ]zone[_ ](\d+)([NS])", wkt)
    if zone and re.search(r"(?i)WGS[_ ]?(19)?84", wkt):
        return f"EPSG:{(32600 if zone[2].upper() == 'N' else 32700) + int(zone[1])}"
    if wkt.lstrip().upper().startswith("GEOGCS") and re.search(r"(?i)WGS[_ ]?(19)?84", wkt):
        return "EPSG:4326"
    raise InputError(f"no known coordinate system in {wkt[:60]!r}")


def _rows(spark: SparkSession, n: int, read) -> DataFrame:
    """Rows that ``read(first, last)`` gives for ranges of numbers, in tasks of about ROWS."""

    def run(batches):
        for batch in batches:
            for first, last in zip(batch["first"], batch["last"], strict=True):
                yield pd.DataFrame(read(int(first), int(last)), columns=["ord", "properties", "geometry"]).astype(object)

    blocks = [(a, min(n, a + ROWS)) for a in range(0, n, ROWS)]
    pieces = spark.createDataFrame(blocks or [(0, 0)], "first long, last long").repartition(max(1, len(blocks)))
    return pieces.mapInPandas(run, SCHEMA)


def _shapefile(spark: SparkSession, path: str) -> tuple[DataFrame, str, str]:
    stem = Path(path).with_suffix("")
    near = lambda suffix: next((p for p in (stem.with_suffix(suffix), stem.with_suffix(suffix.upper())) if p.is_file()), None)
    prj, shx, dbf, cpg = near(".prj"), near(".shx"), near(".dbf"), near(".cpg")
    if prj is None or shx is None or dbf is None:
        raise InputError(f"{path} needs its .prj, .shx and .dbf beside it")
    system = system_of(prj.read_text(encoding="utf-8", errors="replace"))
    encoding = cpg.read_text().strip() if cpg else "utf-8"
    with open(dbf, "rb") as f:
        head = f.read(32)
        count, start, width = struct.unpack("<IHH", head[4:12])
        columns, at = [], 1
        for _ in range((start - 33) // 32):
            raw = f.read(32)
            columns.append((raw[:11].split(b"\0")[0].decode(encoding, "replace"), chr(raw[11]), at, raw[16], raw[17]))
            at += raw[16]

    def value(kind: str, raw: bytes, decimals: int):
        text = raw.decode(encoding, "replace").strip("\0 ")
        if kind in "NF":
            try:
                return int(text) if kind == "N" and not decimals else float(text)
            except ValueError:
                return None
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper()) if kind == "L" else text or None

    def read(first: int, last: int) -> list:
        out = []
        with open(path, "rb") as shp, open(shx, "rb") as index, open(dbf, "rb") as table:
            index.seek(100 + 8 * first)
            places = struct.iter_unpack(">II", index.read(8 * (last - first)))
            table.seek(start + first * width)
            for k, (offset, size) in enumerate(places, first):
                record = table.read(width)
                props = {name: value(kind, record[a : a + n], decimals) for name, kind, a, n, decimals in columns}
                shp.seek(2 * offset + 8)
                body, geometry = shp.read(2 * size), None
                if struct.unpack("<i", body[:4])[0] in (5, 15, 25):
                    parts, points = struct.unpack("<ii", body[36:44])
                    starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
                    xy = list(struct.iter_unpack("<dd", body[44 + 4 * parts : 44 + 4 * parts + 16 * points]))
                    geometry = json.dumps({"type": "Polygon", "coordinates": [xy[a:b] for a, b in zip(starts, starts[1:], strict=False)]})
                out.append((k, json.dumps(props), geometry))
        return out

    return _rows(spark, count, read), system, system


def _geopackage(spark: SparkSession, path: str) -> tuple[DataFrame, str, str]:
    if not Path(path).is_file():
        raise InputError(f"there is no {path}")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        tables = db.execute("SELECT g.table_name, g.column_name, s.organization, s.organization_coordsys_id FROM gpkg_geometry_columns g JOIN gpkg_contents c USING (table_name) JOIN gpkg_spatial_ref_sys s ON s.srs_id = g.srs_id WHERE c.data_type = 'features'").fetchall()
        if len(tables) != 1:
            raise InputError(f"{path} holds {len(tables)} feature tables; one is needed")
        name, shape, owner, number = tables[0]
        quoted = '"' + name.replace('"', '""') + '"'
        low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {quoted}").fetchone()
    system = f"{owner.upper()}:{number}"

    def geometry(blob: bytes | None) -> str | None:
        if not blob or blob[3] & 0x10:
            return None
        envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
        return json.dumps(wkb_geometry(blob[8 + envelope :]))

    def read(first: int, last: int) -> list:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            found = db.execute(f"SELECT rowid AS \"_rowid\", * FROM {quoted} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (low + first, low + last))
            names = [d[0] for d in found.description]
            return [(row[0], json.dumps({k: v for k, v in zip(names[1:], row[1:], strict=True) if k != shape and not isinstance(v, bytes)}), geometry(row[names.index(shape)])) for row in found]

    return _rows(spark, high - low + 1, read), system, system


def _geoparquet(spark: SparkSession, path: str) -> tuple[DataFrame, str, str]:
    import pyarrow.parquet

    rows = spark.read.parquet(path)
    first = rows.inputFiles()[0]
    system_, place = file_system(first)
    meta = pyarrow.parquet.read_metadata(place, filesystem=system_).metadata or {}
    geo = json.loads(meta.get(b"geo", b"{}"))
    shape = geo.get("primary_column", "geometry")
    if shape not in rows.columns:
        raise InputError(f"{path} has no column {shape}")
    crs = geo.get("columns", {}).get(shape, {}).get("crs")
    number = (crs or {}).get("id", {})
    system = f"{number['authority']}:{number['code']}" if number else "OGC:CRS84"
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != shape)), {"ignoreNullFields": "false"})

    def run(batches):
        for batch in batches:
            yield batch.assign(geometry=[json.dumps(wkb_geometry(bytes(b))) if b is not None else None for b in batch["geometry"]])

    plain = rows.select(F.monotonically_increasing_id().alias("ord"), others.alias("properties"), F.col(shape).cast("binary").alias("geometry"))
    return plain.mapInPandas(run, SCHEMA), system, system
