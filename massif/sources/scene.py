"""A scene of objects, pixels, parts and jobs made from the driver's tables by arithmetic on their keys.

Real rasters arrive in the same long form: object_id, row, col, dsm, dtm.  One pixel is one square metre.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massif.operators.zonal import missing_to_null

WIDTH, NODATA = 24, -9999.0
#: Columns between objects where all of them lie on one grid.
APART = 32


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, row, col, dsm, dtm: the lines of each supplier as a raster of 24 columns, quantity as height over a terrain that isn't flat.

    Some cells of the surface are nodata, NaN or NULL; every 97th object has none that isn't.
    """
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    n = F.row_number().over(order) - 1
    lines = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_linenumber", "l_tax", "l_discount", n.alias("n"))
    row, col = (F.col("n") / WIDTH).cast("int"), (F.col("n") % WIDTH).cast("int")
    dtm = F.lit(10.0) + 0.25 * col + 0.125 * row + 0.5 * ((row * col) % 7)
    gone = (
        F.when((F.col("l_suppkey") % 97 == 5) | ((F.col("l_linenumber") == 4) & (F.col("l_tax") > 0.045)), NODATA)
        .when((F.col("l_linenumber") == 3) & (F.col("l_tax") > 0.065), float("nan"))
    )
    dsm = F.when((F.col("l_linenumber") == 2) & (F.col("l_discount") > 0.085), None).otherwise(F.coalesce(gone, dtm + F.col("l_quantity")))
    return lines.select(F.col("l_suppkey").alias("object_id"), row.alias("row"), col.alias("col"), dsm.alias("dsm"), dtm.alias("dtm"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with NULL for every cell without a value."""
    return raw_pixels(spark, sf_dir).withColumn("dsm", missing_to_null(F.col("dsm"), NODATA))


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, x0, y0, x1, y1: rectangles in pixel coordinates for suppliers, and for customers, who have no pixels (negative ids)."""
    own = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object_id"))
    other = _table(spark, sf_dir, "customer").select((-F.col("c_custkey") - 1).alias("object_id"))
    k = F.abs("object_id")
    return own.unionByName(other).select("object_id", (k % 5).cast("double").alias("x0"), (k % 3).cast("double").alias("y0"), (k % 5 + 7 + k % 9).cast("double").alias("x1"), (k % 3 + 6 + k % 11).cast("double").alias("y1"))


def towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, row, col, dsm, dtm: for each supplier a podium with a tower, a gap of one pixel and a courtyard, on a 24 x 24 grid."""
    grid = spark.range(WIDTH * WIDTH).select((F.col("id") / WIDTH).cast("int").alias("row"), (F.col("id") % WIDTH).cast("int").alias("col"))
    each = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object_id")).crossJoin(F.broadcast(grid))  # 576 rows for each object by definition
    k, r, c = F.col("object_id"), F.col("row"), F.col("col")
    inside = lambda a, b, w, h: (r >= a) & (r < a + h) & (c >= b) & (c < b + w)
    height = F.when(inside(8, 8, 2, 2), 0).when((r == 5) & (c == 5 + k % 3), 0).when(inside(10, 10, 5 + k % 4, 5), 20 + k % 7).when(inside(3, 3, 14, 14), 6 + k % 5).otherwise(0).cast("double")
    return each.select("object_id", "row", "col", (F.lit(10.0) + height).alias("dsm"), F.lit(10.0).alias("dtm"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested parts, four for each object, some broken on purpose (by p_size) for the validation queries."""
    p = _table(spark, sf_dir, "part")
    n, size = F.col("p_partkey") % 4, F.col("p_size")
    obj = F.floor(F.col("p_partkey") / 4).cast("long")
    base = (5 * n).cast("double") + F.when(size % 17 == 0, 1.0).otherwise(0.0)
    top = (5 * n + 5).cast("double")
    name = lambda no: F.format_string("%d-P%02d", obj, no)
    root = ((n == 0) & (size % 43 != 0)) | ((n == 1) & (size % 41 == 0))
    parent = F.when(root, F.lit(None)).when((n == 0) | (size % 23 == 0), F.lit("nowhere")).when(size % 47 == 0, F.format_string("%d-P%02d", obj + 1, n - 1)).otherwise(name(n - 1))
    area = (100 - 20 * n).cast("double")
    height = top - base
    return p.select(
        obj.alias("object_id"), name(n).alias("part_id"), parent.alias("parent_part_id"), (n + F.when(size % 29 == 0, 1).otherwise(0)).cast("int").alias("part_level"),
        F.lit(10.0).alias("ground_elevation_m"), base.alias("base_height_agl_m"), top.alias("top_height_agl_m"), (F.when(size % 11 == 0, -1.0).otherwise(1.0) * height).alias("part_height_m"),
        (F.lit(10.0) + base + F.when(size % 13 == 0, 0.25).otherwise(0.0)).alias("base_elevation_m"), (F.lit(10.0) + top + F.when(size % 31 == 0, 0.5).otherwise(0.0)).alias("top_elevation_m"),
        area.alias("area_m2"), (area * height + F.when(size % 19 == 0, 7.0).otherwise(0.0)).alias("volume_m3"), F.when(size % 37 == 0, 1.5).otherwise(1.0).alias("valid_coverage_ratio"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, seq, ts, state: the events of each user as the log of a job."""
    e = _table(spark, sf_dir, "events")
    state = F.create_map(*(F.lit(x) for x in ("signup", "queued", "view", "running", "click", "cancelling", "purchase", "completed", "error", "failed")))
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", F.element_at(state, F.col("event_type")).alias("state"))


def job_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, source_job_id: every third job works on the files of the job with half its number."""
    j = F.col("user_id")
    return _table(spark, sf_dir, "events").select(j.alias("job_id")).distinct().select("job_id", F.when((F.col("job_id") % 3 == 0) & (F.col("job_id") > 0), F.floor(F.col("job_id") / 2).cast("long")).alias("source_job_id"))


def part_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, part_id, parent_part_id, polygons: four boxes for each object, each within the one before but for some that are shifted or flat (by p_size)."""
    p = _table(spark, sf_dir, "part")
    n, size, obj = F.col("p_partkey") % 4, F.col("p_size"), F.floor(F.col("p_partkey") / 4).cast("long")
    name = lambda k: F.format_string("%d-P%02d", obj, k)
    side = (40 - 8 * n).cast("double")
    x0 = (4 * n).cast("double") + F.when(size % 9 == 0, 3.0 + size / 2).otherwise(0.0)
    x1, y0, y1 = x0 + side, (4 * n).cast("double"), (4 * n).cast("double") + F.when(size % 37 == 0, 0.0).otherwise(side)
    ring = F.array(*(F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))))
    return p.select(obj.alias("object_id"), name(n).alias("part_id"), F.when(n > 0, name(n - 1)).alias("parent_part_id"), F.array(F.array(ring)).alias("polygons"))
