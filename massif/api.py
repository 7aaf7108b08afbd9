"""Whole runs: footprints and rasters to a saved collection, its validation and its export.

The collection is GeoJSON in longitude and latitude.  Its further members name the inputs, the working system
and the parameters, so that it can be validated and exported again.  Footprints and two GeoTIFFs are the
usual input; pixels that are rows already (object_id, row, col, dsm, dtm) can be given in their place, and
then one cell is one square metre and coordinates stay [col, row].
"""

import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif import __version__
from massif.config import EngineConfig, InputError, ValidationError
from massif.functions import projection
from massif.functions.scalar import CANONICAL
from massif.operators import hierarchy, trees, validate, zonal
from massif.sources import exports, geojson
from massif.sources.geotiff import Raster
from massif.sources.grid import Grid, analysis_grid

#: Problems that an error names; and footprints for each task at most.
MOST, EACH = 100, 64


def problems(parts: DataFrame, round_digits: int = 2, saved: bool = False) -> DataFrame:
    """part_id, problem: every broken invariant of a result; with ``polygons``, also of its geometry."""
    tol = validate.tolerance(round_digits, saved)
    both = lambda df, key, text: df.select(F.col(key).cast("string").alias("part_id"), F.lit(text).alias("problem"))
    out = validate.ids(parts).select(F.col("part_id").cast("string"), "problem")
    more = [both(validate.orphans(parts), "part_id", "the parent isn't there"), both(validate.roots(parts), "object_id", "there isn't one root"), validate.hierarchy(parts, tol), validate.vertical(parts, tol), both(validate.volume(parts, tol), "part_id", "volume")]
    if "polygons" in parts.columns:
        more.append(validate.geometry(parts, saved))
    for df in more:
        out = out.unionByName(df)
    return out


def check(parts: DataFrame, round_digits: int, saved: bool) -> None:
    found = problems(parts, round_digits, saved).orderBy("part_id", "problem").limit(MOST).collect()
    if found:
        raise ValidationError("; ".join(f"{r.part_id}: {r.problem}" for r in found))


def _features(parts: DataFrame, epsg: int | None, digits: int) -> DataFrame:
    """ord, part, feature: each part as a GeoJSON feature; source properties that clash with a part's own columns get the prefix src_."""
    names = [c for c in parts.columns if c in CANONICAL]
    rest = [c for c in ("props",) if c in parts.columns]
    rows = parts.select("ord", "part", "polygons", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("own"), *rest)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = json.loads(row.own)
                given = json.loads(row.props) if rest and row.props else {}
                own |= {f"src_{k}" if k in CANONICAL else k: geojson.plain(v) for k, v in given.items()}
                shape = geojson.geometry_json(row.polygons, epsg, digits) if epsg else json.dumps({"type": "MultiPolygon", "coordinates": geojson.plain([[[list(q) for q in r] for r in p] for p in row.polygons])})
                out.append(json.dumps({"type": "Feature", "id": own["part_id"], "properties": own}, ensure_ascii=False, allow_nan=False)[:-1] + f', "geometry": {shape}}}')
            yield pd.DataFrame({"ord": batch["ord"], "part": batch["part"], "feature": out})

    return rows.mapInPandas(run, "ord long, part int, feature string")


def _raster_member(path: str) -> dict:
    r = Raster(path)
    return {"file_name": os.path.basename(path), "crs": f"EPSG:{r.epsg}", "resolution_x": abs(r.dx), "resolution_y": abs(r.dy), "resolution_unit": "degree" if r.epsg == 4326 else "metre"}


def _members(config: EngineConfig, began: float, n: int, label: str, footprints: str, grid: Grid, summary: dict) -> dict:
    """The collection's further members: engine, process, inputs, processing, vertical reference, summary."""
    finished = datetime.now(UTC)
    return {
        "engine": {"name": "massif", "version": __version__},
        "process": {"name": "elevation", "started_at_utc": datetime.fromtimestamp(began, UTC).isoformat(), "finished_at_utc": finished.isoformat(), "duration_s": round(finished.timestamp() - began, 2)},
        "inputs": {
            "footprint": {"file_name": os.path.basename(footprints), "feature_count": n, "crs": label, "id_source": {"mode": "property", "field": config.id_field or "id"}},
            "dsm": _raster_member(grid.dsm), "dtm": _raster_member(grid.dtm) | {"ground_source_type": config.ground_source_type},
        },
        "processing": {
            "working_crs": f"EPSG:{grid.epsg}", "output_crs": "EPSG:4326", "analysis_grid_source": "DSM", "analysis_resolution_x_m": round(abs(grid.dx), 6), "analysis_resolution_y_m": round(abs(grid.dy), 6),
            "dsm_reprojected": grid.warped, "terrain_normalization": True, "dtm_resampling": "bilinear", "parameters": {k: v for k, v in asdict(config).items() if k not in ("working_crs", "output_crs")},
            "execution": {"processing_order": "dsm_tile_row_major", "output_order": "input_order"},
        },
        "vertical_reference": {"mode": "terrain_normalized", "dtm_used": True, "height_surface": "nDSM", "ground_source": "DTM", "ground_source_type": config.ground_source_type, "base_elevation_stat": config.base_elevation_stat, "vertical_datum": config.vertical_datum},
        "summary": summary,
    }


def run_elevation(spark: SparkSession, output: str, footprints: str | None = None, dsm: str | None = None, dtm: str | None = None, *, pixels: str | None = None, log: Callable[[str], None] | None = None, progress: Callable[[int, int, str], None] | None = None, cancel: Callable[[], bool] | None = None, **parameters) -> dict:
    """Decompose all objects, validate, and write the collection; in tree mode, the trees.

    ``progress(done, total, message)`` hears of the steps, and ``cancel`` is asked before each; a cancelled run writes nothing.
    """
    config, began, steps = EngineConfig().override(**parameters), time.time(), iter(range(1, 9))

    def step(message: str) -> bool:
        (log or (lambda _: None))(message)
        if progress:
            progress(next(steps), 4, message)
        return bool(cancel and cancel())

    if Path(output).suffix.lower() not in (".geojson", ".json"):
        raise InputError(f"{output} must end in .geojson")
    stopped = {"output_path": None, "num_features": 0, "num_buildings": 0, "num_skipped": 0, "cancelled": True}
    if pixels:
        return _run_pixels(spark, pixels, output, config, step, stopped)
    if not footprints:
        raise InputError("footprints are needed")
    if step("reading footprints"):
        return stopped
    found, label = geojson.read_footprints(spark, footprints, config.working_crs, config.id_field, config.keep_properties)
    grid = analysis_grid(dsm, dtm, config)
    found = found.persist()
    try:
        n = found.count()
        if config.keep_properties is None:
            config = config.override(keep_properties=tuple(geojson.property_keys(found)))
        if step(f"decomposing {n} objects on {grid.width} x {grid.height} cells"):
            return stopped
        if config.mode == "tree":
            return _run_trees(found, n, label, footprints, grid, output, config, began, step, stopped)
        tasks = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, -(-n // EACH))))
        results = hierarchy.from_rasters(found, grid, config, tasks).persist()
        try:
            parts = results.filter("skipped is null")
            row = hierarchy.summary(parts, config.round_digits).first()
            if not row.n_parts:
                raise InputError("no object could be decomposed; do the rasters cover the footprints?")
            if step("checking invariants"):
                return stopped
            check(parts, config.round_digits, saved=False)
            gone = json.loads(hierarchy.skipped(results))
            summary = {
                "building_count": row.n_objects, "decomposed_building_count": row.n_decomposed, "part_count": row.n_parts, "max_part_level": row.max_level, "max_top_height_agl_m": row.max_top_m,
                "total_volume_m3": row.total_volume_m3, "skipped_building_count": len(gone), "skipped_buildings": gone, "validation": {"status": "passed", "checked_parts": row.n_parts},
            }
            if step("writing"):
                return stopped
            geojson.write_collection(_features(parts, grid.epsg, config.coord_digits), ["ord", "part"], output, _members(config, began, n, label, footprints, grid, summary))
        finally:
            results.unpersist()
    finally:
        found.unpersist()
    return {"output_path": output, "num_features": row.n_parts, "num_parcels": n, "num_buildings": row.n_objects, "num_skipped": len(gone), "cancelled": False}


def _run_trees(found: DataFrame, n: int, label: str, footprints: str, grid: Grid, output: str, config: EngineConfig, began: float, step, stopped: dict) -> dict:
    """Trees of canopies: points in longitude and latitude, crown tiers and a summary beside them."""
    pixel = grid.pixel_area**0.5
    px = zonal.pixels_of(found, grid, max(2, n // EACH)).persist()
    try:
        profile = trees.canopy_profile(px).persist()
        area = found.select("object_id", "ord", "props", trees.region_area("polygons").alias("footprint_m2"))
        judged = area.join(profile, "object_id", "left").withColumn("reason", trees.rejection(F.col("footprint_m2"), config)).persist()
        good = judged.filter("reason is null").select("object_id")
        apex = trees.clean_apex(px, profile.join(good, "object_id", "left_semi"), config)
        own = trees.detect(px, apex, config, pixel)
        tree = trees.allometry(trees.crown(own), config).join(judged.select("object_id", "ord", "props", "ground_m"), "object_id")
        tree = trees.first_free_ids(tree, "tree_id", ["ord", "tree_id"]).persist()
        if step("writing"):
            return stopped
        summary = trees.summary(tree).first().asDict() | {"rejected": {r.reason: r["count"] for r in judged.filter("reason is not null").groupBy("reason").count().collect()}}
        names = [c for c in tree.columns if c not in ("row", "col", "ord", "props", "polygons")]

        def run(batches):
            for batch in batches:
                x, y = grid.x0 + (batch["col"] + 0.5) * grid.dx, grid.y0 + (batch["row"] + 0.5) * grid.dy
                lon, lat = projection.inverse(grid.epsg, x.to_numpy(), y.to_numpy())
                out = []
                for own, props, a, b in zip(batch["own"], batch["props"], lon, lat, strict=True):
                    mine = json.loads(own)
                    mine |= {f"src_{k}" if k in mine else k: geojson.plain(v) for k, v in json.loads(props or "{}").items()}
                    out.append(json.dumps({"type": "Feature", "id": mine["tree_id"], "properties": mine, "geometry": {"type": "Point", "coordinates": [round(a, config.coord_digits), round(b, config.coord_digits)]}}, ensure_ascii=False, allow_nan=False))
                yield pd.DataFrame({"ord": batch["ord"], "tree_id": batch["tree_id"], "feature": out})

        rows = tree.select("ord", "tree_id", "row", "col", "props", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("own"))
        geojson.write_collection(rows.mapInPandas(run, "ord long, tree_id string, feature string"), ["ord", "tree_id"], output, _members(config, began, n, label, footprints, grid, summary))
        stem = str(Path(output).with_suffix(""))
        tiers = trees.tier_features(trees.tier_outlines(px, tree, config, pixel), tree, grid, config.coord_digits)
        geojson.write_collection(tiers, ["tree_id", "tier"], f"{stem}_tiers.geojson", {"engine": {"name": "massif", "version": __version__}})
        geojson.write_json(summary, f"{stem}_summary.json")
    finally:
        px.unpersist()
    return {"output_path": output, "tiers_path": f"{stem}_tiers.geojson", "summary_path": f"{stem}_summary.json", "num_trees": summary["n_trees"], "num_parcels": n, "num_skipped": sum(summary["rejected"].values()), "cancelled": False}


def _run_pixels(spark: SparkSession, pixels: str, output: str, config: EngineConfig, step, stopped: dict) -> dict:
    px = spark.read.parquet(pixels)
    lost = [c for c in ("object_id", "row", "col", "dsm", "dtm") if c not in px.columns]
    if lost:
        raise InputError(f"the pixels have no {', '.join(lost)}")
    if step("reading pixels"):
        return stopped
    if config.mode == "tree":
        found = trees.detect(px, trees.clean_apex(px, trees.canopy_profile(px), config), config)
        tree = trees.allometry(trees.crown(found), config)
        names = [c for c in tree.columns if c not in ("row", "col", "polygons")]
        features = tree.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*names).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(F.col("col") + 0.5, F.col("row") + 0.5).alias("coordinates")).alias("geometry"))).alias("feature"), "object_id", "tree_id")
        geojson.write_collection(features, ["object_id", "tree_id"], output, {})
        return {"output_path": output, "num_trees": tree.count(), "cancelled": False}
    parts = hierarchy.outlines(px, config).withColumns({"object_id": F.col("object_id").cast("string"), "ord": F.col("object_id").cast("long"), "part": F.element_at(F.split("part_id", "-P"), -1).cast("int")}).persist()
    try:
        if step("checking invariants"):
            return stopped
        check(parts, config.round_digits, saved=False)
        members = {"processing": {"working_crs": None, "parameters": {"round_digits": config.round_digits}}}
        geojson.write_collection(_features(parts, None, config.coord_digits), ["ord", "part"], output, members)
        row = hierarchy.summary(parts, config.round_digits).first()
    finally:
        parts.unpersist()
    return {"output_path": output, "num_features": row.n_parts, "num_buildings": row.n_objects, "num_skipped": px.select("object_id").distinct().count() - row.n_objects, "cancelled": False}


def read_parts(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The parts of a saved collection with their feature's id, ``polygons`` in the working system and all other properties (JSON); and its processing member."""
    doc = spark.read.text(path, wholetext=True)
    top = doc.select(F.get_json_object("value", "$.type").alias("kind"), F.get_json_object("value", "$.processing").alias("processing")).first()
    if top is None or top.kind != "FeatureCollection":
        raise InputError(f"{path} holds no FeatureCollection")
    processing = json.loads(top.processing) if top.processing else {}
    epsg = projection.code(processing["working_crs"]) if processing.get("working_crs") else None
    own = ",".join(f"{c}:{t}" for c, t in hierarchy.COLUMNS.items())
    rows = doc.select(F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<struct<id:string,properties:string,geometry:string>>")).alias("ord", "f"))
    rows = rows.select(F.col("ord").cast("long").alias("ord"), F.col("f.id").alias("feature_id"), F.col("f.properties").alias("all"), F.col("f.geometry").alias("geometry"), F.from_json("f.properties", f"struct<{own}>").alias("own"))

    def run(batches):
        for batch in batches:
            out = []
            for text in batch["geometry"]:
                shape = json.loads(text) if text else {}
                inner = shape.get("coordinates") or []
                region = hierarchy.opened([inner] if shape.get("type") == "Polygon" else inner if shape.get("type") == "MultiPolygon" else [])
                out.append(hierarchy.closed(projection.reproject(region, 4326, epsg) if epsg else region))
            yield batch.drop(columns="geometry").assign(polygons=out)

    shaped = rows.select("ord", "feature_id", "all", "geometry").mapInPandas(run, f"ord long, feature_id string, all string, polygons {hierarchy.SHAPE}")
    return rows.select("ord", "own.*").join(shaped, "ord"), processing


def validate_file(spark: SparkSession, path: str) -> int:
    """The number of parts of a valid saved collection; raises with the first problems of others."""
    parts, processing = read_parts(spark, path)
    parts = parts.persist()
    try:
        n = parts.count()
        if not n:
            raise ValidationError("the collection holds no parts")
        broken = validate.structure(parts).limit(MOST).collect()
        if broken:
            raise ValidationError("; ".join(f"{r.part_id}: {r.problem}" for r in broken))
        check(parts, int((processing.get("parameters") or {}).get("round_digits", 2)), saved=True)
    finally:
        parts.unpersist()
    return n


def export_file(spark: SparkSession, path: str, formats: list[str], crs: str = "EPSG:32750") -> dict:
    """Validate a saved collection and write it in other formats beside it."""
    validate_file(spark, path)
    parts, processing = read_parts(spark, path)
    rest = F.col("all")  # every property with its type; the three ids are columns of their own
    rings = F.transform(F.flatten("polygons"), lambda r: F.slice(r, F.lit(1), F.size(r) - 1))
    own = parts.select("object_id", "part_id", "parent_part_id", rings.alias("rings"), "base_elevation_m", "top_elevation_m", rest.alias("attributes"))
    return exports.export(own, str(Path(path).parent), Path(path).stem, formats, processing.get("working_crs") or crs, path)
