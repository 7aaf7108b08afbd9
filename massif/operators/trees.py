"""Tree canopies: profiles, rejection, cleaning, allometry and tiers as column expressions, single trees by a window kernel."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.config import EngineConfig
from massif.functions import overlay, projection
from massif.functions.scalar import half_even, signed_area
from massif.operators import hierarchy, raster
from massif.operators.zonal import clipped

OUTLIER = (-20.0, 2000.0)
#: The least area of a tier's outline, and the shares of the crown's radius by which a tier is narrower where heights give no outline.
LEAST_TIER_M2, NARROWER = 0.2, {1: 0.2, 2: 0.4}


def canopy_profile(pixels: DataFrame) -> DataFrame:
    """One row for each canopy: percentiles of its clipped heights, and the median of plausible terrain."""
    h = clipped(F.col("dsm") - F.col("dtm"), 150.0)
    plausible = F.when((F.col("dtm") > OUTLIER[0]) & (F.col("dtm") < OUTLIER[1]) & F.col("dsm").isNotNull(), F.col("dtm"))
    quantiles = F.percentile("h", F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75, 0.9, 0.95))))
    got = pixels.withColumn("h", h).groupBy("object_id").agg(F.count("h").alias("n_valid"), quantiles.alias("q"), F.max("h").alias("h_max"), F.min("h").alias("h_min"), F.coalesce(F.median(plausible), F.lit(0.0)).alias("ground_m"))
    return got.select("object_id", "n_valid", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p90", "p95"))), "h_max", "h_min", "ground_m")


def rejection(area: Column, config: EngineConfig | None = None) -> Column:
    """Why a canopy is no tree, the first rule that holds; NULL for trees."""
    c = config or EngineConfig()
    p25, p50, p90, low = (F.col(n) for n in ("p25", "p50", "p90", "h_min"))
    roof = ((p25 >= 20) & (area < 50)) | ((p50 >= 30) & (area < 100)) | ((low >= 20) & (area < 50))
    return (
        F.when(area.isNull() | (area <= 0), "INVALID_OR_EMPTY_FOOTPRINT").when(F.coalesce("n_valid", F.lit(0)) < 3, "NO_VALID_RASTER_DATA").when(roof, "ROOFTOP_STRUCTURE")
        .when((area < 8) & (p90 >= 25), "ANTENNA_OR_TOWER").when(p90 < c.min_tree_height, "LOW_VEGETATION_OR_GROUND")
    )


def clean_apex(pixels: DataFrame, profiles: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """object_id, apex_m: the height of a canopy without what spills over from a wall."""
    c = config or EngineConfig()
    spills = (F.col("p50") < 20) & (F.col("h_max") >= 25)
    top = F.least(F.lit(35.0), F.col("p50") + 2.5 * F.greatest(F.lit(2.0), F.col("p75") - F.col("p25")))
    h = pixels.select("object_id", clipped(F.col("dsm") - F.col("dtm"), 150.0).alias("h"))
    kept = F.when((F.col("h") <= top) & (F.col("h") > 0), F.col("h"))
    own = h.join(profiles, "object_id").groupBy("object_id").agg(F.count(kept).alias("n"), F.percentile(kept, 0.95).alias("clean"), F.first(spills).alias("spills"), F.first("p50").alias("p50"), F.first("h_max").alias("h_max"))
    apex = F.when(F.col("spills"), F.when(F.col("n") >= 3, F.col("clean")).otherwise(F.col("p50"))).otherwise(F.col("h_max"))
    return own.select("object_id", F.when(apex.isNotNull(), F.least(apex, F.lit(c.max_bio_height_m))).alias("apex_m"))


def apex_pixel(pixels: DataFrame) -> DataFrame:
    """object_id, row, col, h: the highest pixel, the first in row order of equals; none for objects without a height."""
    h = F.col("dsm") - F.col("dtm")
    best = F.max_by(F.struct("row", "col", h.alias("h")), F.struct(h, -F.col("row"), -F.col("col")))
    return pixels.filter(h.isNotNull()).groupBy("object_id").agg(best.alias("x")).select("object_id", "x.row", "x.col", "x.h")


def allometry(trees: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Append dbh_cm, biomass_kg, carbon_kg, co2e_kg, trunk_diameter_m for height_m and crown_diameter_m.

    Each figure comes from the rounded ones before it; halves are rounded to even.
    """
    c = config or EngineConfig()
    h, d = F.greatest("height_m", F.lit(0.5)), F.greatest("crown_diameter_m", F.lit(0.5))
    t = trees.withColumn("dbh_cm", half_even(0.55 * F.pow(h, F.lit(0.92)) * F.pow(d, F.lit(0.42)), 1))
    t = t.withColumn("biomass_kg", half_even(0.0673 * F.pow(c.wood_density * F.col("dbh_cm") * F.col("dbh_cm") * h, F.lit(0.976)), 1))
    t = t.withColumn("carbon_kg", half_even(F.col("biomass_kg") * c.carbon_fraction, 1))
    return t.withColumns({"co2e_kg": half_even(F.col("carbon_kg") * 3.667, 1), "trunk_diameter_m": half_even(F.greatest(F.lit(0.15), F.col("dbh_cm") / 100), 2)})


def crown(trees: DataFrame) -> DataFrame:
    """Append crown_diameter_m from area_m2 and height_m."""
    a = F.greatest(half_even(F.col("area_m2"), 2), F.lit(0.1))
    of_area = half_even(2 * F.sqrt(a / F.pi()), 2)
    return trees.withColumn("crown_diameter_m", half_even(F.least(of_area, F.greatest(F.lit(2.5), F.least(F.lit(18.0), 1.5 * F.col("height_m")))), 2))


def tiers(trees: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """tree_id, tier, base_m, top_m: one to three crown tiers above the trunk; tiers of 5 cm or less are left out."""
    c = config or EngineConfig()
    t = trees.withColumn("trunk_m", half_even(F.col("height_m") * c.trunk_ratio, 2)).withColumn("crown_m", half_even(F.col("height_m") - F.col("trunk_m"), 2))
    t = t.withColumn("n_tiers", F.when(F.col("crown_m") >= 2.0, 3).when(F.col("crown_m") >= 0.8, 2).otherwise(1))
    t = t.withColumn("tier", F.explode(F.sequence(F.lit(0), F.col("n_tiers") - 1))).withColumn("step_m", F.col("crown_m") / F.col("n_tiers"))
    edge = lambda i: half_even(F.col("trunk_m") + i * F.col("step_m"), 2)
    top = F.when(F.col("tier") == F.col("n_tiers") - 1, half_even(F.col("height_m"), 2)).otherwise(edge(F.col("tier") + 1))
    t = t.withColumns({"base_m": edge(F.col("tier")), "top_m": top})
    return t.filter(half_even(F.col("top_m") - F.col("base_m"), 2) > 0.05).select("tree_id", "tier", "base_m", "top_m")


def region_area(polygons: str) -> Column:
    """The area of multipolygon coordinates whose shells run counter-clockwise and whose holes run clockwise."""
    ring = lambda r: signed_area(F.transform(r, lambda q: q[0]), F.transform(r, lambda q: q[1]))
    return F.aggregate(F.transform(F.flatten(polygons), ring), F.lit(0.0), lambda a, x: a + x)


def outline(h: np.ndarray, region: list, tier: int, base: float, diameter: float, apex: tuple[float, float], pixel: float) -> list:
    """A tier's outline in [col, row] coordinates: the tree's own for the lowest; above it, where the canopy reaches the tier's base.

    Where that is too little, the tree's outline drawn in by a share of the crown; where nothing is left of that, a disk around the top.
    """
    if tier == 0:
        return region
    least = LEAST_TIER_M2 / pixel**2
    tall = overlay.burn(region, h.shape) & (np.where(np.isfinite(h), h, -1.0) >= base)
    if tall.sum() >= 3:
        own = [p for p in overlay.outlines(tall) if overlay.area([p]) >= least]
        own = overlay.intersection(overlay.union(own), region) if own else []
        if overlay.area(own) >= least:
            return own
    drawn = overlay.buffer(region, -NARROWER[tier] * diameter / 2 / pixel)
    if overlay.area(drawn) >= least:
        return drawn
    t = np.arange(32) * (math.pi / 16)
    return [[np.stack([apex[0] + np.cos(t) * max(0.6, 0.3 * diameter) / pixel, apex[1] + np.sin(t) * max(0.6, 0.3 * diameter) / pixel], axis=1)]]


def tier_outlines(pixels: DataFrame, trees: DataFrame, config: EngineConfig | None = None, pixel: float = 1.0) -> DataFrame:
    """tree_id, part_id, parent_part_id, tier, base_m, top_m, crown_area_m2, polygons ([col, row]) of all tiers of the trees that ``detect`` found, with their measures.

    A cogroup of one canopy's pixels with its trees' tiers.
    """
    names = ["tree_id", "part_id", "parent_part_id", "tier", "base_m", "top_m", "crown_area_m2", "polygons"]
    rows = tiers(trees, config).join(trees.select("tree_id", "object_id", "row", "col", "crown_diameter_m", "polygons"), "tree_id")

    def run(px: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(px):
            top, left = int(px["row"].min()), int(px["col"].min())
            h = np.full((int(px["row"].max()) - top + 1, int(px["col"].max()) - left + 1), np.nan)
            h[px["row"].to_numpy() - top, px["col"].to_numpy() - left] = np.clip(px["dsm"].to_numpy(float) - px["dtm"].to_numpy(float), 0, 100)
            for tree_id, mine in own.sort_values(["tree_id", "tier"]).groupby("tree_id", sort=False):
                for i, t in enumerate(mine.itertuples(index=False)):
                    region = [[r - (left, top) for r in p] for p in hierarchy.opened(t.polygons)]
                    got = outline(h, region, int(t.tier), t.base_m, t.crown_diameter_m, (t.col - left + 0.5, t.row - top + 0.5), pixel)
                    out.append((tree_id, f"{tree_id}-P{i:02d}", f"{tree_id}-P{i - 1:02d}" if i else None, int(t.tier), t.base_m, t.top_m, round(overlay.area(got) * pixel**2, 2), hierarchy.closed([[r + (left, top) for r in p] for p in got])))
        return pd.DataFrame(out, columns=names).astype(object)

    schema = f"tree_id string, part_id string, parent_part_id string, tier int, base_m double, top_m double, crown_area_m2 double, polygons {hierarchy.SHAPE}"
    return pixels.groupBy("object_id").cogroup(rows.groupBy("object_id")).applyInPandas(run, schema)


def tier_features(outlines: DataFrame, trees: DataFrame, grid, digits: int) -> DataFrame:
    """tree_id, tier, feature: the tiers as GeoJSON features with their trees' measures."""
    import json

    from massif.sources.geojson import geometry_json

    measures = ("object_id", "ground_elevation_m", "crown_diameter_m", "total_tree_height_m", "dbh_cm", "biomass_kg", "carbon_kg", "co2e_kg")
    tree = trees.select("tree_id", "object_id", half_even(F.col("ground_m"), 2).alias("ground_elevation_m"), "crown_diameter_m", half_even(F.col("height_m"), 2).alias("total_tree_height_m"), "dbh_cm", "biomass_kg", "carbon_kg", "co2e_kg")
    rows = outlines.join(tree, "tree_id")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                world = hierarchy.closed(grid.world(hierarchy.opened(r.polygons), 0, 0))
                props = {"tree_id": r.tree_id, "part_id": r.part_id, "parent_part_id": r.parent_part_id, "part_level": int(r.tier), "base_height_agl_m": r.base_m, "top_height_agl_m": r.top_m, "part_height_m": round(r.top_m - r.base_m, 2), "crown_area_m2": r.crown_area_m2}
                props |= {m: getattr(r, m) for m in measures}
                props |= {"base_elevation_m": round(r.ground_elevation_m + r.base_m, 2), "top_elevation_m": round(r.ground_elevation_m + r.top_m, 2)}
                out.append(json.dumps({"type": "Feature", "id": r.part_id, "properties": props}, allow_nan=False)[:-1] + f', "geometry": {geometry_json(world, grid.epsg, digits)}}}')
            yield pd.DataFrame({"tree_id": batch["tree_id"], "tier": batch["tier"], "feature": out})

    return rows.mapInPandas(run, "tree_id string, tier int, feature string")


def summary(trees: DataFrame) -> DataFrame:
    """One row: trees, heights, and totals of carbon and its carbon dioxide in tonnes."""
    return trees.agg(
        F.count("*").alias("n_trees"), half_even(F.avg("height_m"), 2).alias("mean_height_m"), half_even(F.min("height_m"), 2).alias("min_height_m"), half_even(F.max("height_m"), 2).alias("max_height_m"),
        half_even(F.sum("biomass_kg") / 1000, 3).alias("biomass_t"), half_even(F.sum("carbon_kg") / 1000, 3).alias("carbon_t"), half_even(F.sum("co2e_kg") / 1000, 3).alias("co2e_t"),
    )


def first_free_ids(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """The rows with repeated values of ``name`` renamed, in the given order: the first keeps it, each later one takes the first of name_01, name_02 ... that no row before has.

    Names compete only with those of the same stem (all numbers behind taken off), so each stem is a group of its own.
    """
    names = df.columns
    stem = F.regexp_replace(F.col(name), "(_[0-9]+)+$", "")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        seen: set[str] = set()
        last: dict[str, int] = {}
        out = []
        for value in rows[name]:
            new, k = value, last.get(value, 0)
            while new in seen:
                k += 1
                new = f"{value}_{k:02d}"
            last[value] = k
            seen.add(new)
            out.append(new)
        return rows.assign(**{name: out})[names]

    return df.withColumn("_stem", stem).groupBy("_stem").applyInPandas(run, df.schema)


def _saddle(smooth: np.ndarray, a: tuple[int, int], b: tuple[int, int]) -> float:
    """The lowest smoothed height on the line between two pixels."""
    n = max(int(math.hypot(a[0] - b[0], a[1] - b[1])), 2)
    rows, cols = (np.rint(np.linspace(p, q, n)).astype(int) for p, q in zip(a, b, strict=True))
    return float(smooth[rows, cols].min())


def peaks(h: np.ndarray, inside: np.ndarray, apex: float, pixel: float, c: EngineConfig) -> list[tuple[float, int, int]]:
    """(height, row, col) of the tops in a canopy's window, highest first, without branches of higher ones.

    A top is a branch if a higher one within 12 m is joined to it by a saddle of the smoothed heights that is less
    than 1.2 m, or less than 18 % of the lower top's height, below that top.
    """
    z = np.where(inside & np.isfinite(h), h, 0.0)
    smooth = raster.gaussian(z)
    size = max(3, round(max(2.5, min(c.itd_min_distance_m, 0.32 * apex)) / pixel))
    reach = (size + (size % 2 == 0)) // 2
    p = np.pad(smooth, reach, mode="symmetric")
    top = np.lib.stride_tricks.sliding_window_view(p, (2 * reach + 1, 2 * reach + 1)).max(axis=(2, 3))
    plateaus, n = raster.label((smooth == top) & (smooth > 0) & inside & (smooth >= c.min_tree_height))
    found = []
    for k in range(1, n + 1):
        r, q = np.unravel_index(int(np.argmax(np.where(plateaus == k, z, -1.0))), z.shape)
        found.append((min(max(float(z[r, q]), c.min_tree_height), apex), int(r), int(q)))
    kept: list[tuple[float, int, int]] = []
    for top_h, r, q in sorted(found, key=lambda x: -x[0]):
        for other, a, b in kept:
            if math.hypot(r - a, q - b) * pixel <= 12.0:
                low = min(top_h, other)
                drop = low - _saddle(smooth, (r, q), (a, b))
                if drop < 1.2 or drop < 0.18 * low:
                    break
        else:
            kept.append((top_h, r, q))
    return kept


def detect(pixels: DataFrame, apexes: DataFrame, config: EngineConfig | None = None, pixel: float = 1.0) -> DataFrame:
    """object_id, tree_id, row, col, height_m, area_m2, n_peaks, polygons ([col, row]): the trees of each canopy.

    Canopies of ``cluster_min_area_m2`` and more with two or more tops are divided by a flood from the tops;
    basins under 1 square metre are dropped.  Others, and all without a basin left, are one tree.  A grouped
    map over one canopy's window; ``apexes`` (object_id, apex_m) holds one row a canopy.
    """
    c = config or EngineConfig()
    kind = pixels.schema["object_id"].dataType.simpleString()
    schema = f"object_id {kind}, tree_id string, row int, col int, height_m double, area_m2 double, n_peaks int, polygons {hierarchy.SHAPE}"
    names = ["object_id", "tree_id", "row", "col", "height_m", "area_m2", "n_peaks", "polygons"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r, k = rows["row"].to_numpy() - rows["row"].min(), rows["col"].to_numpy() - rows["col"].min()
        h, inside = np.full((r.max() + 1, k.max() + 1), np.nan), np.zeros((r.max() + 1, k.max() + 1), bool)
        h[r, k], inside[r, k] = np.clip(rows["dsm"].to_numpy(float) - rows["dtm"].to_numpy(float), 0, 100), True
        oid = rows["object_id"].iloc[0]
        apex, area = float(rows["apex_m"].iloc[0]), float(inside.sum()) * pixel**2
        tops = peaks(h, inside, apex, pixel, c) if c.split_clusters and area >= c.cluster_min_area_m2 and math.isfinite(apex) else []
        out = []
        if len(tops) > 1:
            z = np.where(inside & np.isfinite(h), h, 0.0)
            smooth, markers = raster.gaussian(z), np.zeros(h.shape, np.int64)
            for i, (_, a, b) in enumerate(tops, 1):
                markers[a, b] = i
            basins = raster.watershed(np.clip((smooth.max() - smooth) * 1000, 0, 65535).astype(np.uint16).astype(np.int64), markers, inside)
            for i, (height, a, b) in enumerate(tops, 1):
                own = basins == i
                if own.sum() * pixel**2 >= 1.0:
                    out.append((f"{oid}_T{len(out) + 1:02d}", a, b, height, own))
        if not out:
            z = np.where(inside & np.isfinite(h), h, -1.0)
            a, b = np.unravel_index(int(np.argmax(z)), z.shape)
            out = [(f"{oid}_T01" if len(tops) > 1 else f"{oid}", int(a), int(b), max(apex, c.min_tree_height), inside)]
        low, left = int(rows["row"].min()), int(rows["col"].min())
        shape = lambda own: hierarchy.closed([[r + (left, low) for r in p] for p in overlay.outlines(own)])
        return pd.DataFrame([(oid, t, int(a) + low, int(b) + left, float(height), float(own.sum()) * pixel**2, len(tops), shape(own)) for t, a, b, height, own in out], columns=names).astype(object)

    return pixels.join(apexes, "object_id").groupBy("object_id").applyInPandas(run, schema)
