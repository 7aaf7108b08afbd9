"""Invariants of parts as queries: each returns the rows that break one."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.functions.regions import Regions, apart, areas


def tolerance(round_digits: int = 2, saved: bool = False) -> float:
    return max(10.0**-round_digits, 1e-6) * (1 if saved else 1.0001)


def ids(parts: DataFrame) -> DataFrame:
    """part_id, problem: empty object ids, repeated part ids and, where the rows have ``feature_id``, those that differ from it."""
    empty = parts.filter(F.col("object_id").isNull() | (F.trim(F.col("object_id").cast("string")) == "")).select("part_id", F.lit("empty object_id").alias("problem"))
    twice = parts.groupBy("part_id").count().filter("count > 1").select("part_id", F.lit("repeated part_id").alias("problem"))
    out = empty.unionByName(twice)
    if "feature_id" in parts.columns:
        out = out.unionByName(parts.filter(~F.col("feature_id").eqNullSafe(F.col("part_id"))).select("part_id", F.lit("the feature's id isn't part_id").alias("problem")))
    return out


def orphans(parts: DataFrame) -> DataFrame:
    """Parts that name a parent which isn't there: a left anti join."""
    known = parts.select(F.col("part_id").alias("known"))
    return parts.filter("parent_part_id is not null").join(known, F.col("parent_part_id") == F.col("known"), "left_anti").select("object_id", "part_id", "parent_part_id")


def roots(parts: DataFrame) -> DataFrame:
    """Objects that don't have exactly one root."""
    return parts.groupBy("object_id").agg(F.count_if(F.col("parent_part_id").isNull()).alias("n_roots")).filter("n_roots <> 1")


def hierarchy(parts: DataFrame, tol: float) -> DataFrame:
    """part_id, problem: levels, objects and bases that disagree with the parent."""
    p = parts.select(F.col("part_id").alias("pid"), F.col("object_id").alias("pobj"), F.col("part_level").alias("plevel"), F.col("top_height_agl_m").alias("ptop"))
    j = parts.join(p, F.col("parent_part_id") == F.col("pid"), "left")
    own = F.col("parent_part_id").isNull()
    checks = F.array(
        F.when(own & (F.col("part_level") != 0), "a root's level isn't 0"),
        F.when(F.col("pid").isNotNull() & (F.col("pobj") != F.col("object_id")), "the parent is of another object"),
        F.when(F.col("pid").isNotNull() & (F.col("part_level") != F.col("plevel") + 1), "the level isn't the parent's plus 1"),
        F.when(F.col("pid").isNotNull() & (F.abs(F.col("base_height_agl_m") - F.col("ptop")) > tol), "the base isn't the parent's top"),
    )
    return j.select("part_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))


def vertical(parts: DataFrame, tol: float) -> DataFrame:
    """part_id, problem: heights and elevations that don't add up, and coverage outside 0 to 1."""
    c = F.col
    checks = F.array(
        F.when(F.abs(c("top_height_agl_m") - c("base_height_agl_m") - c("part_height_m")) > tol, "height"),
        F.when(F.abs(c("ground_elevation_m") + c("base_height_agl_m") - c("base_elevation_m")) > tol, "base elevation"),
        F.when(F.abs(c("ground_elevation_m") + c("top_height_agl_m") - c("top_elevation_m")) > tol, "top elevation"),
        F.when((c("part_height_m") < 0) | (c("parent_part_id").isNotNull() & (c("part_height_m") <= 0)), "negative height"),
        F.when(~c("valid_coverage_ratio").between(0, 1), "coverage"),
    )
    return parts.select("part_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))


def part_roots(parts: DataFrame, deepest: int = 64) -> DataFrame:
    """part_id, root_id, depth: each part's root and its distance from it, a join a level; parts of orphans and of circles have none."""
    up = parts.select("part_id", "parent_part_id")
    front = up.filter("parent_part_id is null").select("part_id", F.col("part_id").alias("root_id"), F.lit(0).alias("depth"))
    below, out = up.filter("parent_part_id is not null"), front
    for depth in range(1, min(deepest, _deepest(parts)) + 1):
        front = below.join(front.select(F.col("part_id").alias("parent_part_id"), "root_id"), "parent_part_id").select("part_id", "root_id", F.lit(depth).alias("depth"))
        out = out.unionByName(front)
    return out


def _deepest(parts: DataFrame) -> int:
    """The number of levels that the parts name, at least: one more than the highest, so that a wrong level is still walked."""
    return int(parts.agg(F.coalesce(F.max("part_level"), F.lit(0)).alias("m")).first().m) + 1


def geometry(parts: DataFrame, saved: bool = False) -> DataFrame:
    """part_id, problem: parts (``polygons``) that are no valid polygons, or reach outside their parent or their object's root.

    A part may reach out by a millionth of its area or a square centimetre; a saved one, whose corners were
    rounded, by a centimetre along its outline.
    """
    up = parts.select(F.col("part_id").alias("above"), F.col("polygons").alias("parent_shape"))
    top = parts.filter("parent_part_id is null").groupBy("object_id").agg(F.min_by("polygons", "part_id").alias("root_shape"))
    up, top = up.hint("merge"), top.hint("merge")  # a shape is larger than Spark takes a nested array for
    both = parts.select("object_id", "part_id", "parent_part_id", "polygons").join(up, F.col("parent_part_id") == F.col("above"), "left").join(top, "object_id", "left")

    def run(batches):
        for batch in batches:
            own, within = Regions.of_column(batch.column("polygons")), batch.column("parent_part_id").is_valid().to_numpy(zero_copy_only=False)
            size = own.area()
            fine = (own.polygons > 0) & ~own.bare() & (size > 0)
            whole = areas(fine, [own.united()], [lambda w: w[:, 0] % 2 == 1])[:, 0]
            fine &= np.abs(whole - size) <= 1e-6 * size
            slack = np.maximum(1e-6 * size, 1e-4) + (0.01 * own.length() if saved else 0.0)
            problems = [(~fine, "the geometry is invalid or has no area")]
            for column, name in (("parent_shape", "parent"), ("root_shape", "root")):
                shape = batch.column(column)
                other, asked = Regions.of_column(shape), fine & within & shape.is_valid().to_numpy(zero_copy_only=False)
                met = asked & ~apart(own, other)
                outside = np.where(met, areas(met, [own, other], [lambda w: (w[:, 0] > 0) & (w[:, 1] <= 0)])[:, 0], size)
                problems.append((asked & (outside > slack), f"it lies outside its {name}"))
            found = [(batch.column("part_id").filter(pa.array(rows)), name) for rows, name in problems]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([ids for ids, _ in found]), pa.array([name for ids, name in found for _ in range(len(ids))], pa.string())], names=["part_id", "problem"])

    return both.mapInArrow(run, "part_id string, problem string")


def volume(parts: DataFrame, tol: float) -> DataFrame:
    """Parts whose volume isn't area times height."""
    gap = F.abs(F.col("volume_m3") - F.col("area_m2") * F.col("part_height_m"))
    return parts.filter(gap > F.greatest(F.lit(0.1), tol * F.greatest("volume_m3", F.lit(1.0)))).select("part_id", "volume_m3")


def shell_edges(edges: DataFrame) -> DataFrame:
    """shell_id, lo, hi, n, balance: undirected edges that don't occur exactly once in each direction."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return edges.groupBy("shell_id", lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(-1)).alias("balance")).filter("n <> 2 or balance <> 0")


def document_diff(left: DataFrame, right: DataFrame, limit: int = 20) -> DataFrame:
    """path, a, b: the first differences of two flattened documents (path, value), by a full outer join."""
    joined = left.select("path", F.col("value").alias("a")).join(right.select("path", F.col("value").alias("b")), "path", "full_outer")
    return joined.filter(~F.col("a").eqNullSafe(F.col("b"))).orderBy("path").limit(limit)


#: What a saved part's columns must hold in JSON (fixed values): text, number, whole number; a question mark allows null.
STRUCTURE = {
    "object_id": "text", "part_id": "text", "parent_part_id": "text?", "part_level": "whole", "ground_elevation_m": "number", "base_height_agl_m": "number", "top_height_agl_m": "number", "part_height_m": "number",
    "base_elevation_m": "number", "top_elevation_m": "number", "area_m2": "number", "perimeter_m": "number", "oriented_length_m": "number", "oriented_width_m": "number", "dimension_method": "text", "orientation_deg": "number",
    "volume_m3": "number", "delta_z_m": "number", "expected_pixel_count": "whole", "valid_pixel_count": "whole", "support_pixel_count": "whole", "valid_coverage_ratio": "number", "decomposition_reason": "text",
    "parent_containment_ratio": "number?", "interior_ring_count": "whole", "geometry_method": "text",
}


def structure(rows: DataFrame) -> DataFrame:
    """part_id, problem: saved parts (feature_id, all: their properties as JSON) that lack a column or hold a value of another kind."""
    members = F.try_parse_json("all").try_cast("map<string,variant>")
    problems = [F.when(F.col("m").isNull(), "the properties aren't an object")]
    for name, kind in STRUCTURE.items():
        value = F.try_element_at(F.col("m"), F.lit(name))
        found = F.schema_of_variant(value)
        fits = {"text": found == "STRING", "whole": found == "BIGINT", "number": found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")}[kind.rstrip("?")]
        null = found == "VOID"
        fits = fits | null if kind.endswith("?") else fits
        problems += [F.when(F.col("m").isNotNull() & value.isNull(), f"{name} isn't there"), F.when(value.isNotNull() & ~fits, f"{name} isn't {kind.rstrip('?')}")]
    found = rows.select(F.col("feature_id").alias("part_id"), members.alias("m")).select("part_id", F.explode(F.filter(F.array(*problems), lambda x: x.isNotNull())).alias("problem"))
    return found
