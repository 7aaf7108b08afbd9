"""Zonal statistics of objects over pixels: one shuffle on object_id, exact percentiles, NULL for missing cells."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.config import EngineConfig
from massif.functions import overlay
from massif.operators import hierarchy
from massif.sources.grid import Grid


def missing_to_null(z: Column, nodata: float | None) -> Column:
    """Nodata and NaN cells are NULL."""
    z = F.when(F.isnan(z), None).otherwise(z)
    return z if nodata is None else F.nullif(z, F.lit(nodata))


def ndsm(pixels: DataFrame) -> DataFrame:
    """Append the height above terrain, not clipped."""
    return pixels.withColumn("ndsm", F.col("dsm") - F.col("dtm"))


def clipped(height: Column, top: float) -> Column:
    return F.when(height.isNotNull(), F.least(F.greatest(height, F.lit(0.0)), F.lit(top)))


def ground(how: str) -> Column:
    """The ground statistic over valid terrain cells."""
    valid = F.when(F.col("dsm").isNotNull(), F.col("dtm"))
    return {"min": F.min, "mean": F.avg, "median": F.median}[how](valid)


def profile(pixels: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Counts, evidence, ground, percentiles and means of each object in one aggregation."""
    c = config or EngineConfig()
    h = F.col("ndsm")
    tall = F.when(h >= c.min_building_height_m, h)
    return ndsm(pixels).groupBy("object_id").agg(
        F.count("*").alias("expected_pixel_count"), F.count("ndsm").alias("valid_pixel_count"), F.count(tall).alias("building_pixel_count"),
        ground(c.base_elevation_stat).alias("ground_elevation_m"), F.percentile(tall, 0.05).alias("p05"), F.percentile(tall, 0.95).alias("p95"),
        F.avg(tall).alias("mean_building_height"), F.avg("ndsm").alias("mean_height"),
    )


def coverage() -> Column:
    return F.when(F.col("expected_pixel_count") > 0, F.col("valid_pixel_count") / F.col("expected_pixel_count")).otherwise(0.0)


def single_mass(footprints: DataFrame, pixels: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """For each footprint why it is skipped, why it is one mass, or that it needs clustering; with its height."""
    c = config or EngineConfig()
    stats = profile(pixels, c).withColumnRenamed("object_id", "o")
    joined = footprints.select("object_id").join(stats, F.col("object_id") == F.col("o"), "left").drop("o")
    spread = F.col("p95") - F.col("p05")
    reason = (
        F.when(F.col("expected_pixel_count").isNull(), "OUTSIDE_ANALYSIS_GRID")
        .when(F.col("valid_pixel_count") < 1, "NO_VALID_DSM_DTM_PIXELS")
        .when(F.col("building_pixel_count") < 3, "SINGLE_MASS_INSUFFICIENT_BUILDING_PIXELS")
        .when(spread < c.height_diff_threshold_m, "SINGLE_MASS_UNIFORM_HEIGHT")
        .otherwise("MULTIPLE_HEIGHTS")
    )
    height = F.when(F.col("building_pixel_count") < 3, F.col("mean_height")).otherwise(F.col("mean_building_height"))
    return joined.withColumns({"reason": reason, "height_m": F.greatest(height, F.lit(0.0))})


def in_ring(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Even-odd rule: is the point inside the ring of these coordinate arrays?"""
    n = F.size(xs)
    crosses = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(
            (F.get(ys, i) > y) != (F.get(ys, (i + 1) % n) > y),
            F.when(x < (F.get(xs, (i + 1) % n) - F.get(xs, i)) * (y - F.get(ys, i)) / (F.get(ys, (i + 1) % n) - F.get(ys, i)) + F.get(xs, i), 1).otherwise(0),
        ).otherwise(0),
    )
    return F.aggregate(crosses, F.lit(0), lambda a, b: a + b) % 2 == 1


def pixels_in(footprints: DataFrame, raster: DataFrame, tile: int = 8) -> DataFrame:
    """Footprints (object_id, xs, ys) with the pixels (row, col, ...) whose centre lies inside.

    Each footprint is copied to the tiles that its bounds touch; the join is an equi-join on the
    tile, so no footprint is compared with a pixel outside its own tiles.  Both sides are dealt by
    tile: Spark takes arrays and copies for much smaller than they are, and would broadcast any number of them.
    """
    to_tile = lambda v: F.floor(v / tile).cast("int")
    f = footprints.withColumns({"tr": F.explode(F.sequence(to_tile(F.array_min("ys")), to_tile(F.array_max("ys"))))})
    f = f.withColumn("tc", F.explode(F.sequence(to_tile(F.array_min("xs")), to_tile(F.array_max("xs")))))
    r = raster.withColumns({"tr": to_tile(F.col("row")), "tc": to_tile(F.col("col"))})
    return f.hint("merge").join(r, ["tr", "tc"]).filter(in_ring(F.col("col") + 0.5, F.col("row") + 0.5, F.col("xs"), F.col("ys"))).drop("tr", "tc", "xs", "ys")


def pixels_of(footprints: DataFrame, grid: Grid, tasks: int = 32) -> DataFrame:
    """object_id, row, col, dsm, dtm: the grid's cells whose centre is inside each footprint (polygons in the working system), read in tile order."""

    def run(batches):
        reader = grid.open()
        for batch in batches:
            for object_id, polygons in zip(batch["object_id"], batch["polygons"], strict=True):
                region = hierarchy.opened(polygons) if polygons is not None else []
                span = grid.span(overlay.bounds(region), 0) if region else None
                if span is None:
                    continue
                row, col, height, width = span
                inside = overlay.burn(grid.cells(region, row, col), (height, width))
                dsm, dtm = reader.read(*span)
                r, c = np.nonzero(inside)
                yield pd.DataFrame({"object_id": object_id, "row": (r + row).astype("i4"), "col": (c + col).astype("i4"), "dsm": dsm[r, c], "dtm": dtm[r, c]})

    found = hierarchy.in_tile_order(footprints.select("ord", "object_id", "polygons"), grid, tasks).mapInPandas(run, "object_id string, row int, col int, dsm double, dtm double")
    return found.withColumns({z: missing_to_null(F.col(z), None) for z in ("dsm", "dtm")})


def bilinear(coarse: DataFrame, targets: DataFrame) -> DataFrame:
    """z at fractional (y, x) of the targets from the four cells around; missing cells leave their weight to the others, NULL where all are missing.

    coarse: row, col, z; targets: key columns, y, x in cell-centre coordinates of the coarse grid.
    """
    names = targets.columns
    corners = F.array(*(F.struct((F.floor("y") + i).cast("int").alias("row"), (F.floor("x") + j).cast("int").alias("col"), (F.abs(F.lit(1 - i) - (F.col("y") - F.floor("y"))) * F.abs(F.lit(1 - j) - (F.col("x") - F.floor("x")))).alias("w")) for i in (0, 1) for j in (0, 1)))
    asked = targets.withColumn("q", F.explode(corners)).select(*names, "q.row", "q.col", "q.w")
    found = asked.join(coarse.filter("z is not null"), ["row", "col"], "left")
    seen = F.sum(F.when(F.col("z").isNotNull(), F.col("w")))
    return found.groupBy(*names).agg(F.when(seen > 0, F.sum(F.col("w") * F.col("z")) / seen).alias("z"))
