"""GeoJSON in and out.  Files are read by Spark; features stay rows until the sink."""

import json
import math
import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.config import InputError
from massif.functions import overlay, projection
from massif.functions.scalar import normalize_id
from massif.operators.hierarchy import SHAPE, closed, opened

_FEATURE = "struct<type:string,properties:string,geometry:string>"
LINES = (".geojsonl", ".geojsonseq", ".ndjson")
#: Repeated ids that an error names.
NAMED = 10


def features(spark: SparkSession, path: str) -> tuple[DataFrame, str, str]:
    """ord, properties and geometry (JSON) of a file's features in order, its system, and how that was found.

    A Feature or a FeatureCollection is one document; a file with one feature a line (.geojsonl, .geojsonseq,
    .ndjson) is split among tasks.
    """
    default = ("EPSG:4326", "EPSG:4326 (RFC 7946 default)")
    if path.lower().endswith(LINES):
        lines = spark.read.text(path).select(F.btrim("value", F.lit("\x1e \t\r")).alias("v"), F.monotonically_increasing_id().alias("ord")).filter("v <> ''")
        return lines.select("ord", F.from_json("v", _FEATURE).alias("f")).select("ord", "f.properties", "f.geometry"), *default
    doc = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))
    top = doc.select(F.get_json_object("doc", "$.type").alias("kind"), F.get_json_object("doc", "$.crs").alias("crs"), F.get_json_object("doc", "$.crs.properties.name").alias("name")).first()
    if top is None or top.kind not in ("Feature", "FeatureCollection"):
        raise InputError(f"{path} holds neither a Feature nor a FeatureCollection")
    if top.crs is not None and top.crs not in ("null", "{}") and not top.name:
        raise InputError(f"the crs member of {path} can't be read")
    many = F.concat(F.lit("["), F.col("doc"), F.lit("]")) if top.kind == "Feature" else F.get_json_object("doc", "$.features")
    rows = doc.select(F.posexplode(F.from_json(many, f"array<{_FEATURE}>")).alias("ord", "f")).select(F.col("ord").cast("long").alias("ord"), "f.properties", "f.geometry")
    return (rows, top.name, top.name) if top.name else (rows, *default)


def stable_ids(rows: DataFrame, field: str) -> DataFrame:
    """Append object_id: the property ``field`` by its JSON value; missing ids and ids that occur twice are input errors."""
    members = F.try_parse_json("properties").try_cast("map<string,variant>")
    out = rows.withColumn("object_id", normalize_id(F.to_json(F.try_element_at(members, F.lit(field)))))
    n = out.agg(F.count("*").alias("n"), F.count_if(F.col("object_id").isNull()).alias("missing")).first()
    if not n.n:
        raise InputError("the footprints hold no features")
    if n.missing:
        raise InputError(f"{n.missing} of {n.n} features have no usable {field!r}; name a property that every feature has with id_field")
    twice = out.groupBy("object_id").count().filter("count > 1")
    some = twice.orderBy("object_id").limit(NAMED).collect()
    if some:
        raise InputError(f"{twice.count()} ids occur more than once: " + ", ".join(r.object_id for r in some))
    return out


def region_of(geometry: dict | None) -> list:
    """The polygons of a GeoJSON geometry, repaired; other kinds have none."""
    if not isinstance(geometry, dict):
        return []
    kind, inner = geometry.get("type"), geometry.get("coordinates") or []
    if kind == "GeometryCollection":
        found = [region_of(g) for g in geometry.get("geometries") or []]
        return overlay.union(*found) if any(found) else []
    polys = inner if kind == "MultiPolygon" else [inner] if kind == "Polygon" else []
    region = [[np.array([q[:2] for q in r], float) for r in p] for p in polys if p]
    region = [[r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in p] for p in region]
    return overlay.repaired(region) if region else []


def read_footprints(spark: SparkSession, path: str, working_crs: str, id_field: str | None = None, keep: tuple[str, ...] | None = None) -> tuple[DataFrame, str]:
    """ord, object_id, polygons (in the working system; null where a feature has none), props (JSON), in the file's order; and the file's system.

    The id is the property ``id_field`` (``id``).  ``keep`` names the properties that stay (None: all).
    """
    rows, name, label = (features if path.lower().endswith((".geojson", ".json", *LINES)) else _vectors)(spark, path)
    source, target = projection.code(name), projection.code(working_crs)
    rows = stable_ids(rows, id_field or "id")

    def run(batches):
        for batch in batches:
            shapes, props = [], []
            for geometry, text in zip(batch["geometry"], batch["properties"], strict=True):
                try:
                    region = region_of(json.loads(geometry) if geometry else None)
                except (ValueError, TypeError, IndexError):
                    region = []
                if region and source != target:
                    region = overlay.repaired(projection.reproject(region, source, target))
                shapes.append(closed(region) if region else None)
                own = json.loads(text) if text else {}
                props.append(json.dumps(own if keep is None else {k: own.get(k) for k in dict.fromkeys(keep)}))
            yield pd.DataFrame({"ord": batch["ord"], "object_id": batch["object_id"], "polygons": pd.Series(shapes, dtype=object), "props": props})

    return rows.select("ord", "object_id", "geometry", "properties").mapInPandas(run, f"ord long, object_id string, polygons {SHAPE}, props string"), label


def _vectors(spark: SparkSession, path: str) -> tuple[DataFrame, str, str]:
    from massif.sources import vectors

    return vectors.features(spark, path)


def property_keys(footprints: DataFrame) -> list[str]:
    """The names of all features' properties, in order of the alphabet."""
    return [r.k for r in footprints.select(F.explode(F.json_object_keys("props")).alias("k")).distinct().orderBy("k").collect()]


def geometry_json(polygons, source: int, digits: int) -> str:
    """A region as a GeoJSON geometry in longitude and latitude: rounded, shells counter-clockwise, repaired if rounding needs it."""
    region = projection.reproject(opened(polygons), source, 4326)
    region = region if overlay.valid(region) else overlay.repaired(region)
    rounded = [[np.round(r, digits) for r in p] for p in region]
    region = rounded if overlay.valid(rounded) else region
    if not region:
        raise InputError("a geometry vanishes in the output system")
    out = [[[*r.tolist(), r[0].tolist()] for r in (ring if (overlay.signed_area(ring) > 0) == (k == 0) else ring[::-1] for k, ring in enumerate(p))] for p in region]
    return json.dumps({"type": "Polygon", "coordinates": out[0]} if len(out) == 1 else {"type": "MultiPolygon", "coordinates": out}, allow_nan=False)


def plain(value):
    """A value as JSON can hold it: numbers that aren't finite are null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, np.ndarray)):
        return [plain(v) for v in value]
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if value is None or isinstance(value, (str, int, bool)) else str(value)


def write_collection(features: DataFrame, order: list[str], path: str, members: dict) -> None:
    """Write one FeatureCollection with further members, then put it in place at once.

    The features (column ``feature``, JSON) stream to the driver in order and never meet in memory.
    """
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(prefix=".massif_", suffix=".geojson.tmp", dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            head = {"type": "FeatureCollection", "name": os.path.splitext(os.path.basename(path))[0], **members}
            f.write(json.dumps(head, ensure_ascii=False, allow_nan=False, separators=(",", ":"))[:-1] + ',"features":[')
            for i, row in enumerate(features.orderBy(*order).select("feature").toLocalIterator()):
                f.write(("," if i else "") + row.feature)
            f.write("]}")
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.remove(temp)
        raise


def write_json(value, path: str) -> None:
    """Write a JSON file whole or not at all; numbers that aren't finite are refused."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(prefix=".massif_", suffix=".tmp", dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, allow_nan=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        os.remove(temp)
        raise
