"""Named queries over the driver's tables, and the same results as SQL for DuckDB."""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.config import EngineConfig
from massif.functions import scalar, shape_columns
from massif.operators import cluster, hierarchy, raster, trees, validate, zonal
from massif.sources import exports, scene
from massif.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CONFIG = EngineConfig()
NOW = datetime(2024, 2, 15)

PIXELS = """px0 AS (SELECT l_suppkey AS object_id, l_quantity AS q, l_linenumber AS ln, l_tax, l_discount,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS n FROM lineitem),
px1 AS (SELECT *, CAST(n // 24 AS INT) AS row, CAST(n % 24 AS INT) AS col, 10 + CAST(0.25 AS DOUBLE) * (n % 24) + CAST(0.125 AS DOUBLE) * (n // 24) + CAST(0.5 AS DOUBLE) * ((n // 24 * (n % 24)) % 7) AS dtm FROM px0),
px AS (SELECT object_id, row, col, CASE WHEN object_id % 97 = 5 OR (ln = 4 AND l_tax > 0.045) OR (ln = 3 AND l_tax > 0.065) OR (ln = 2 AND l_discount > 0.085) THEN NULL ELSE dtm + q END AS dsm, dtm FROM px1),
h AS (SELECT *, dsm - dtm AS h FROM px)"""
TOWERS = """grid AS (SELECT CAST(i // 24 AS INT) AS row, CAST(i % 24 AS INT) AS col FROM range(576) AS t(i)),
tw AS (SELECT s_suppkey AS object_id, row, col, CAST(CASE WHEN row BETWEEN 8 AND 9 AND col BETWEEN 8 AND 9 THEN 0 WHEN row = 5 AND col = 5 + s_suppkey % 3 THEN 0
  WHEN row BETWEEN 10 AND 14 AND col BETWEEN 10 AND 14 + s_suppkey % 4 THEN 20 + s_suppkey % 7 WHEN row BETWEEN 3 AND 16 AND col BETWEEN 3 AND 16 THEN 6 + s_suppkey % 5 ELSE 0 END AS DOUBLE) AS h FROM supplier, grid)"""
PARTS = """parts AS (SELECT *, 10.0::DOUBLE AS ground, 10 + base + CASE WHEN p_size % 13 = 0 THEN 0.25 ELSE 0 END AS base_elev, 10 + top + CASE WHEN p_size % 31 = 0 THEN 0.5 ELSE 0 END AS top_elev, (100 - 20 * n)::DOUBLE AS area,
  CASE WHEN p_size % 11 = 0 THEN base - top ELSE top - base END AS height, (100 - 20 * n) * (top - base) + CASE WHEN p_size % 19 = 0 THEN 7 ELSE 0 END AS volume, CASE WHEN p_size % 37 = 0 THEN 1.5 ELSE 1.0 END AS cov,
  CASE WHEN (n = 0 AND p_size % 43 <> 0) OR (n = 1 AND p_size % 41 = 0) THEN NULL WHEN n = 0 OR p_size % 23 = 0 THEN 'nowhere' WHEN p_size % 47 = 0 THEN printf('%d-P%02d', obj + 1, n - 1) ELSE printf('%d-P%02d', obj, n - 1) END AS parent,
  printf('%d-P%02d', obj, n) AS pid, n + CASE WHEN p_size % 29 = 0 THEN 1 ELSE 0 END AS lvl
  FROM (SELECT *, CAST(p_partkey % 4 AS BIGINT) AS n, CAST(p_partkey // 4 AS BIGINT) AS obj, (5 * (p_partkey % 4) + CASE WHEN p_size % 17 = 0 THEN 1 ELSE 0 END)::DOUBLE AS base, (5 * (p_partkey % 4) + 5)::DOUBLE AS top FROM part))"""
JOBS = """ev AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'cancelling' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state FROM events),
last AS (SELECT job_id, arg_max(state, (ts, seq)) AS state, max(ts) AS ts FROM ev GROUP BY job_id)"""


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---- zonal ----

_PROFILE = """prof AS (SELECT object_id, count(*) AS expected_pixel_count, count(h) AS valid_pixel_count, count(*) FILTER (h >= 2) AS building_pixel_count, min(dtm) FILTER (h IS NOT NULL) AS ground_elevation_m,
  quantile_cont(h, 0.05) FILTER (h >= 2) AS p05, quantile_cont(h, 0.95) FILTER (h >= 2) AS p95, avg(h) FILTER (h >= 2) AS mean_building_height, avg(h) AS mean_height FROM h GROUP BY object_id)"""


@query(f"WITH {PIXELS}, {_PROFILE} SELECT object_id, expected_pixel_count, valid_pixel_count, building_pixel_count, ground_elevation_m, round(p05, 6) AS p05, round(p95, 6) AS p95, round(mean_building_height, 6) AS mean_building_height, round(mean_height, 6) AS mean_height FROM prof")
def zonal_height_profile(spark, sf_dir):
    return _round(zonal.profile(scene.pixels(spark, sf_dir)))


def _ground(how, sql):
    def run(spark, sf_dir):
        return _round(scene.pixels(spark, sf_dir).groupBy("object_id").agg(zonal.ground(how).alias("ground_m")))

    run.__name__ = f"ground_stat_{how}"
    query(f"WITH {PIXELS} SELECT object_id, round({sql}(dtm) FILTER (h IS NOT NULL), 6) AS ground_m FROM h GROUP BY object_id")(run)


for _how, _sql in (("min", "min"), ("mean", "avg"), ("median", "median")):
    _ground(_how, _sql)


@query(f"WITH {PIXELS}, {_PROFILE} SELECT object_id, expected_pixel_count, valid_pixel_count, building_pixel_count AS support_pixel_count, CAST(printf('%.4f', valid_pixel_count / expected_pixel_count) AS DOUBLE) AS valid_coverage_ratio FROM prof")
def raster_evidence(spark, sf_dir):
    p = zonal.profile(scene.pixels(spark, sf_dir))
    return p.select("object_id", "expected_pixel_count", "valid_pixel_count", F.col("building_pixel_count").alias("support_pixel_count"), scalar.half_even(zonal.coverage(), 4).alias("valid_coverage_ratio"))


_FOOT = "foot AS (SELECT s_suppkey AS object_id FROM supplier UNION ALL SELECT -c_custkey - 1 FROM customer)"
_MASS = f"""mass AS (SELECT foot.object_id, CASE WHEN expected_pixel_count IS NULL THEN 'OUTSIDE_ANALYSIS_GRID' WHEN valid_pixel_count < 1 THEN 'NO_VALID_DSM_DTM_PIXELS' WHEN building_pixel_count < 3 THEN 'SINGLE_MASS_INSUFFICIENT_BUILDING_PIXELS'
  WHEN p95 - p05 < {CONFIG.height_diff_threshold_m} THEN 'SINGLE_MASS_UNIFORM_HEIGHT' ELSE 'MULTIPLE_HEIGHTS' END AS reason, CASE WHEN building_pixel_count < 3 THEN mean_height ELSE mean_building_height END AS height_m, ground_elevation_m, expected_pixel_count
  FROM foot LEFT JOIN prof USING (object_id))"""


@query(f"WITH {PIXELS}, {_PROFILE}, {_FOOT}, {_MASS} SELECT object_id, reason, round(greatest(height_m, 0), 6) AS height_m FROM mass WHERE height_m IS NOT NULL UNION ALL SELECT object_id, reason, CAST(0 AS DOUBLE) FROM mass WHERE height_m IS NULL")
def single_mass_reason(spark, sf_dir):
    return _round(zonal.single_mass(scene.footprints(spark, sf_dir), scene.pixels(spark, sf_dir)).select("object_id", "reason", "height_m"))


@query(f"""WITH {PIXELS}, {_PROFILE}, {_FOOT}, {_MASS} SELECT object_id, object_id || '-P00' AS part_id, 0 AS part_level, ground_elevation_m, round(height_m, 4) AS top_height_agl_m, CAST(expected_pixel_count AS DOUBLE) AS area_m2,
  round(round(height_m, 4) * expected_pixel_count, 4) AS volume_m3, round(ground_elevation_m + height_m, 4) AS top_elevation_m FROM mass WHERE ground_elevation_m IS NOT NULL""")
def single_mass_parts(spark, sf_dir):
    m = zonal.single_mass(scene.footprints(spark, sf_dir), scene.pixels(spark, sf_dir)).filter("ground_elevation_m is not null")
    top, area = F.round("height_m", 4), F.col("expected_pixel_count").cast("double")
    return m.select("object_id", F.format_string("%d-P%02d", "object_id", F.lit(0)).alias("part_id"), F.lit(0).alias("part_level"), "ground_elevation_m", top.alias("top_height_agl_m"), area.alias("area_m2"), F.round(top * area, 4).alias("volume_m3"), F.round(F.col("ground_elevation_m") + F.col("height_m"), 4).alias("top_elevation_m"))


@query(f"""WITH {PIXELS}, f AS (SELECT s_suppkey AS object_id, s_suppkey % 5 AS x0, s_suppkey % 3 AS y0, s_suppkey % 5 + 7 + s_suppkey % 9 AS x1, s_suppkey % 3 + 6 + s_suppkey % 11 AS y1 FROM supplier)
  SELECT f.object_id, count(*) AS n, round(sum(h), 4) AS total_h FROM f JOIN h ON h.object_id = f.object_id AND col + 0.5 > x0 AND col + 0.5 < x1 AND row + 0.5 > y0 AND row + 0.5 < y1 GROUP BY f.object_id""")
def range_join_footprint_pixels(spark, sf_dir):
    """All footprints against the cells of all objects, laid side by side on one grid."""
    left = scene.APART * F.col("object_id")
    foot = scene.footprints(spark, sf_dir).select("object_id", F.array("x0", "x1", "x1", "x0").alias("xs"), F.array("y0", "y0", "y1", "y1").alias("ys")).withColumn("xs", F.transform("xs", lambda x: x + left))
    every = zonal.ndsm(scene.pixels(spark, sf_dir)).select("row", (F.col("col") + left).cast("int").alias("col"), "ndsm")
    return zonal.pixels_in(foot, every).groupBy("object_id").agg(F.count("*").alias("n"), F.round(F.sum("ndsm"), 4).alias("total_h"))


@query(f"""WITH {PIXELS}, t AS (SELECT object_id, row, col, dy, dx, w FROM px, (VALUES (0, 0, 0.46875), (0, 1, 0.15625), (1, 0, 0.28125), (1, 1, 0.09375)) AS c(dy, dx, w))
  SELECT t.object_id, t.row, t.col, round(sum(CAST(w AS DOUBLE) * z.dsm) / sum(CAST(w AS DOUBLE)) FILTER (z.dsm IS NOT NULL), 6) AS z FROM t LEFT JOIN px z ON z.object_id = t.object_id AND z.row = t.row + dy AND z.col = t.col + dx GROUP BY ALL""")
def bilinear_terrain(spark, sf_dir):
    """The surface with its gaps, at a point beside every cell of every object: 3/8 down and 1/4 to the right."""
    left = scene.APART * F.col("object_id")
    cells = scene.pixels(spark, sf_dir)
    asked = cells.select("object_id", "row", "col", (F.col("row") + 0.375).alias("y"), (F.col("col") + left + 0.25).alias("x"))
    coarse = cells.select(F.col("row").alias("row"), (F.col("col") + left).cast("int").alias("col"), F.col("dsm").alias("z"))
    own = asked.select("object_id", F.col("row").alias("at_row"), F.col("col").alias("at_col"), "y", "x")
    return zonal.bilinear(coarse, own).select("object_id", F.col("at_row").alias("row"), F.col("at_col").alias("col"), F.round("z", 6).alias("z"))


@query(f"WITH {PIXELS} SELECT object_id, row, col, dsm FROM px")
def masked_cells(spark, sf_dir):
    return scene.pixels(spark, sf_dir).select("object_id", "row", "col", "dsm")


# ---- height classes ----

_KMEANS = f"""hist AS (SELECT object_id, list(h ORDER BY h) AS vs, list(n ORDER BY h) AS ns, sum(n) AS total FROM (SELECT object_id, h, count(*) AS n FROM h WHERE h >= 2 GROUP BY object_id, h) GROUP BY object_id),
  al AS (SELECT object_id, list(h ORDER BY h) AS al FROM h WHERE h >= 2 GROUP BY object_id),
  q0 AS (SELECT object_id, vs, ns, al, least({CONFIG.max_height_classes}, len(vs)) AS kk, CAST(len(al) - 1 AS DOUBLE) AS top FROM hist JOIN al USING (object_id)),
  q AS (SELECT object_id, vs, ns, list_sort(list_distinct(list_transform(list_transform(range(0, kk), lambda i: CASE WHEN kk > 1 THEN CAST(i AS DOUBLE) / (kk - 1) ELSE 0 END * top),
    lambda p: al[CAST(floor(p) AS INT) + 1] + (al[CAST(ceil(p) AS INT) + 1] - al[CAST(floor(p) AS INT) + 1]) * (p - floor(p))))) AS c FROM q0),
  it AS (SELECT object_id, 0 AS step, vs, ns, c, false AS done FROM q
    UNION ALL SELECT object_id, step + 1, vs, ns, n, list_max(list_transform(list_zip(n, c), lambda z: abs(z[1] - z[2]))) < 1e-6 FROM (
      SELECT *, list_transform(c, lambda y, i: coalesce(
        list_sum(list_transform(list_filter(list_zip(vs, ns), lambda z: (i = 1 OR z[1] > (c[i - 1] + y) / 2) AND (i = len(c) OR z[1] <= (y + c[i + 1]) / 2)), lambda z: z[1] * z[2]))
        / list_sum(list_transform(list_filter(list_zip(vs, ns), lambda z: (i = 1 OR z[1] > (c[i - 1] + y) / 2) AND (i = len(c) OR z[1] <= (y + c[i + 1]) / 2)), lambda z: z[2])), y)) AS n
      FROM it WHERE NOT done AND step < 60)),
  km AS (SELECT object_id, unnest(list_sort(arg_max(c, step))) AS center FROM it GROUP BY object_id)"""
_MERGED = f"""mg AS (SELECT object_id, grp - 1 AS cls, avg(center) AS center FROM (SELECT *, sum(isnew) OVER (PARTITION BY object_id ORDER BY center) AS grp FROM (
  SELECT *, CASE WHEN center - lag(center) OVER (PARTITION BY object_id ORDER BY center) < {CONFIG.height_diff_threshold_m} THEN 0 ELSE 1 END AS isnew FROM km)) GROUP BY object_id, grp)"""
_CLASSED = """cl AS (SELECT object_id, cls, center, CAST(sum(n) AS BIGINT) AS px FROM (SELECT h.object_id, h.h, h.n, arg_min(mg.cls, (abs(mg.center - h.h), mg.cls)) AS cls, arg_min(mg.center, (abs(mg.center - h.h), mg.cls)) AS center
  FROM (SELECT object_id, h, count(*) AS n FROM h WHERE h >= 2 GROUP BY object_id, h) h JOIN mg USING (object_id) GROUP BY ALL) GROUP BY object_id, cls, center)"""


def _hist(spark, sf_dir):
    return cluster.histograms(scene.pixels(spark, sf_dir), CONFIG.min_building_height_m)


def _centers(spark, sf_dir):
    return cluster.kmeans(_hist(spark, sf_dir), CONFIG.max_height_classes)


@query(f"WITH RECURSIVE {PIXELS}, {_KMEANS} SELECT object_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY center) - 1 AS INT) AS cls, round(center, 6) AS center FROM km")
def kmeans_1d_heights(spark, sf_dir):
    return _centers(spark, sf_dir).select("object_id", F.posexplode("centers").alias("cls", "center")).withColumn("center", F.round("center", 6))


@query(f"WITH RECURSIVE {PIXELS}, {_KMEANS}, {_MERGED} SELECT object_id, CAST(cls AS BIGINT) AS cls, round(center, 6) AS center FROM mg")
def merge_close_centers(spark, sf_dir):
    return _round(cluster.merge_close(_centers(spark, sf_dir), CONFIG.height_diff_threshold_m))


@query(f"WITH RECURSIVE {PIXELS}, {_KMEANS}, {_MERGED}, {_CLASSED} SELECT object_id, CAST(cls AS INT) AS cls, round(center, 6) AS center, px, CAST(sum(px) OVER (PARTITION BY object_id ORDER BY center DESC) AS BIGINT) AS px_from_here FROM cl")
def class_pixels(spark, sf_dir):
    from pyspark.sql import Window

    c = _centers(spark, sf_dir)
    counted = cluster.classes(_hist(spark, sf_dir), cluster.merge_close(c, CONFIG.height_diff_threshold_m))
    w = Window.partitionBy("object_id").orderBy("center").rowsBetween(0, Window.unboundedFollowing)
    return _round(counted.withColumn("px_from_here", F.sum("px").over(w)))


@query(f"""WITH RECURSIVE {PIXELS}, {_KMEANS}, {_MERGED}, {_CLASSED}, cu AS (SELECT *, sum(px) OVER (PARTITION BY object_id ORDER BY center DESC) AS cum, row_number() OVER (PARTITION BY object_id ORDER BY center) AS k FROM cl),
  lv AS (SELECT object_id, k, cls AS start_cls, center AS height, cum AS ref, 0 AS level FROM cu WHERE k = 1
    UNION ALL SELECT cu.object_id, cu.k, CASE WHEN o THEN cls ELSE start_cls END, center, CASE WHEN o THEN cum ELSE ref END, CASE WHEN o THEN level + 1 ELSE level END FROM (SELECT cu.*, lv.start_cls, lv.ref, lv.level, 1 - cu.cum / lv.ref >= {CONFIG.min_footprint_change_ratio} AS o FROM lv JOIN cu ON cu.object_id = lv.object_id AND cu.k = lv.k + 1) cu)
  SELECT object_id, CAST(level AS INT) AS level, CAST(start_cls AS BIGINT) AS start_cls, round(arg_max(height, k), 6) AS height FROM lv GROUP BY object_id, level, start_cls""")
def level_merge(spark, sf_dir):
    counted = cluster.classes(_hist(spark, sf_dir), cluster.merge_close(_centers(spark, sf_dir), CONFIG.height_diff_threshold_m))
    return _round(cluster.levels(counted, CONFIG.min_footprint_change_ratio))


#: Every object of the towers' scene is a square of 24 cells with a podium and a tower on it, whose heights are the only two.
_TOWER_PARTS = f"""{TOWERS}, ob AS (SELECT s_suppkey AS object_id, 6 + s_suppkey % 5 AS low, 20 + s_suppkey % 7 AS high, 5 * (5 + s_suppkey % 4) AS cells, 5 + s_suppkey % 4 AS wide, m.n FROM supplier JOIN (SELECT object_id, count(*) AS n FROM tw WHERE h >= 2 GROUP BY 1) m ON m.object_id = s_suppkey),
  pt AS (SELECT object_id, object_id || '-P00' AS part_id, NULL AS parent_part_id, 0 AS part_level, 0 AS base, low AS top, 576 AS cells, 24 AS long, 24 AS wide, n AS support, 'AUTHORITATIVE_ROOT' AS reason, NULL AS share, 'authoritative_footprint' AS method FROM ob
    UNION ALL SELECT object_id, object_id || '-P01', object_id || '-P00', 1, low, high, cells, wide, 5, cells, 'HEIGHT_AND_FOOTPRINT_CHANGE', 1, 'simplified' FROM ob)"""


@query(f"""WITH {_TOWER_PARTS} SELECT object_id, part_id, parent_part_id, CAST(part_level AS INT) AS part_level, 10::DOUBLE AS ground_elevation_m, base::DOUBLE AS base_height_agl_m, top::DOUBLE AS top_height_agl_m, (top - base)::DOUBLE AS part_height_m,
  (10 + base)::DOUBLE AS base_elevation_m, (10 + top)::DOUBLE AS top_elevation_m, cells::DOUBLE AS area_m2, (2 * (long + wide))::DOUBLE AS perimeter_m, greatest(long, wide)::DOUBLE AS oriented_length_m, least(long, wide)::DOUBLE AS oriented_width_m,
  'minimum_rotated_rectangle' AS dimension_method, (cells * (top - base))::DOUBLE AS volume_m3, (top - base)::DOUBLE AS delta_z_m, CAST(cells AS BIGINT) AS expected_pixel_count, CAST(cells AS BIGINT) AS valid_pixel_count, CAST(support AS BIGINT) AS support_pixel_count,
  1::DOUBLE AS valid_coverage_ratio, reason AS decomposition_reason, share::DOUBLE AS parent_containment_ratio, CAST(0 AS INT) AS interior_ring_count, method AS geometry_method FROM pt""")
def part_hierarchy(spark, sf_dir):
    """All columns of all parts but the direction, which is arbitrary for squares."""
    return hierarchy.parts(scene.towers(spark, sf_dir)).drop("orientation_deg")


@query(f"WITH {_TOWER_PARTS} SELECT count(*) FILTER (part_level = 0) AS n_objects, count(*) AS n_parts, count(DISTINCT object_id) FILTER (part_level > 0) AS n_decomposed, CAST(max(part_level) AS INT) AS max_level, max(top)::DOUBLE AS max_top_m, CAST(sum(cells * (top - base)) AS DOUBLE) AS total_volume_m3 FROM pt")
def run_summary(spark, sf_dir):
    return hierarchy.summary(hierarchy.parts(scene.towers(spark, sf_dir)))


# ---- neighbourhoods ----


@query(f"WITH {PIXELS} SELECT a.object_id, a.row, a.col, a.h FROM h a JOIN h b ON a.object_id = b.object_id AND b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY ALL HAVING a.h = max(b.h) AND a.h > 0")
def local_maxima(spark, sf_dir):
    return raster.local_maxima(scene.pixels(spark, sf_dir), 2)


@query(f"""WITH {TOWERS}, d AS (SELECT r, c FROM range(-2, 3) a(r), range(-2, 3) b(c) WHERE abs(r) + abs(c) <= 2), m AS (SELECT object_id, row, col FROM tw WHERE h >= 2),
  w AS (SELECT DISTINCT object_id, row + r AS row, col + c AS col FROM m, d WHERE row + r BETWEEN 0 AND 23 AND col + c BETWEEN 0 AND 23),
  e AS (SELECT object_id, row + r AS row, col + c AS col FROM w, d GROUP BY ALL HAVING count(*) = 13)
  SELECT object_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM e UNION SELECT object_id, row, col FROM m""")
def binary_closing(spark, sf_dir):
    mask = zonal.ndsm(scene.towers(spark, sf_dir)).filter("ndsm >= 2")
    return raster.closing(mask, 2, scene.WIDTH, scene.WIDTH)


@query(f"WITH {PIXELS} SELECT object_id, arg_max(row, (h, -row, -col)) AS row, arg_max(col, (h, -row, -col)) AS col, max(h) AS h FROM h WHERE h IS NOT NULL GROUP BY object_id")
def apex_pixel(spark, sf_dir):
    return trees.apex_pixel(scene.pixels(spark, sf_dir))


_SETS = """c AS (SELECT object_id, row // 6 AS cand, row, col FROM tw WHERE h >= 20), p AS (SELECT object_id, 'root' AS part, 0 AS lvl, row, col FROM tw UNION ALL SELECT object_id, 'podium', 1, row, col FROM tw WHERE h >= 6 AND col < 13)"""


@query(f"""WITH {TOWERS}, {_SETS}, s AS (SELECT c.object_id, c.cand, p.part, p.lvl, count(*) / any_value(n) AS score, any_value(area) AS area FROM c JOIN p USING (object_id, row, col) JOIN (SELECT object_id, cand, count(*) AS n FROM c GROUP BY ALL) USING (object_id, cand) JOIN (SELECT object_id, part, count(*) AS area FROM p GROUP BY ALL) a ON a.object_id = c.object_id AND a.part = p.part GROUP BY c.object_id, c.cand, p.part, p.lvl)
  SELECT object_id, CAST(cand AS BIGINT) AS cand, part, round(score, 6) AS score FROM s WHERE lvl = 0 OR score >= 0.5 QUALIFY row_number() OVER (PARTITION BY object_id, cand ORDER BY lvl DESC, score DESC, area DESC, part) = 1""")
def best_parent_overlap(spark, sf_dir):
    t = zonal.ndsm(scene.towers(spark, sf_dir))
    cands = t.filter("ndsm >= 20").select("object_id", F.floor(F.col("row") / 6).alias("cand"), "row", "col")
    root = t.select("object_id", F.lit("root").alias("part"), F.lit(0).alias("lvl"), "row", "col")
    podium = t.filter("ndsm >= 6 and col < 13").select("object_id", F.lit("podium").alias("part"), F.lit(1).alias("lvl"), "row", "col")
    return _round(raster.best_parents(cands, root.unionByName(podium)))


# ---- trees ----

_CANOPY = f"""{PIXELS}, hc AS (SELECT *, CASE WHEN h IS NOT NULL THEN least(greatest(h, 0), 150) END AS hh FROM h),
cp AS (SELECT object_id, count(hh) AS n_valid, quantile_cont(hh, 0.25) AS p25, quantile_cont(hh, 0.5) AS p50, quantile_cont(hh, 0.75) AS p75, quantile_cont(hh, 0.9) AS p90, quantile_cont(hh, 0.95) AS p95, max(hh) AS h_max, min(hh) AS h_min,
  coalesce(median(dtm) FILTER (dtm > -20 AND dtm < 2000 AND h IS NOT NULL), 0) AS ground_m FROM hc GROUP BY object_id)"""


@query(f"WITH {_CANOPY} SELECT object_id, n_valid, {', '.join(f'round({c}, 6) AS {c}' for c in ('p25', 'p50', 'p75', 'p90', 'p95', 'h_max', 'h_min', 'ground_m'))} FROM cp")
def canopy_profile(spark, sf_dir):
    return _round(trees.canopy_profile(scene.pixels(spark, sf_dir)))


@query(f"""WITH {_CANOPY}, a AS (SELECT *, CAST(object_id % 12 * 10 - 10 AS DOUBLE) AS area FROM cp) SELECT object_id, CASE WHEN area <= 0 THEN 'INVALID_OR_EMPTY_FOOTPRINT' WHEN n_valid < 3 THEN 'NO_VALID_RASTER_DATA'
  WHEN (p25 >= 20 AND area < 50) OR (p50 >= 30 AND area < 100) OR (h_min >= 20 AND area < 50) THEN 'ROOFTOP_STRUCTURE' WHEN area < 8 AND p90 >= 25 THEN 'ANTENNA_OR_TOWER' WHEN p90 < {CONFIG.min_tree_height} THEN 'LOW_VEGETATION_OR_GROUND' END AS reason FROM a""")
def canopy_reject_reason(spark, sf_dir):
    p = trees.canopy_profile(scene.pixels(spark, sf_dir))
    return p.select("object_id", trees.rejection((F.col("object_id") % 12 * 10 - 10).cast("double")).alias("reason"))


@query(f"""WITH {_CANOPY}, k AS (SELECT object_id, p50, h_max, p50 < 20 + 10 AND h_max >= 25 AS spills0, p50 < 20 AND h_max >= 25 AS spills, hh, CASE WHEN hh <= least(35, p50 + 2.5 * greatest(2, p75 - p25)) AND hh > 0 THEN hh END AS kept FROM hc JOIN cp USING (object_id))
  SELECT object_id, round(CASE WHEN any_value(h_max) IS NOT NULL THEN least(CASE WHEN any_value(spills) THEN CASE WHEN count(kept) >= 3 THEN quantile_cont(kept, 0.95) ELSE any_value(p50) END ELSE any_value(h_max) END, {CONFIG.max_bio_height_m}) END, 6) AS apex_m FROM k GROUP BY object_id""")
def wall_cleaning(spark, sf_dir):
    px = scene.pixels(spark, sf_dir)
    return _round(trees.clean_apex(px, trees.canopy_profile(px)))


_TREES = "t AS (SELECT p_partkey AS tree_id, CAST(p_size AS DOUBLE) AS height_m, p_retailprice / 10 AS area_m2 FROM part)"
_HE = lambda x, d: f"CAST(printf('%.{d}f', {x}) AS DOUBLE)"  # exact: halves of the binary value to even
_CROWN = f"{_TREES}, c AS (SELECT *, {_HE(f'least({_HE(f"2 * sqrt(greatest({_HE("area_m2", 2)}, 0.1) / pi())", 2)}, greatest(2.5, least(18, 1.5 * height_m)))', 2)} AS crown_diameter_m FROM t)"
_ALLO = f"""{_CROWN}, b AS (SELECT *, {_HE("0.55 * pow(greatest(height_m, 0.5), 0.92) * pow(greatest(crown_diameter_m, 0.5), 0.42)", 1)} AS dbh_cm FROM c),
  g AS (SELECT *, {_HE(f"0.0673 * pow({CONFIG.wood_density} * dbh_cm * dbh_cm * greatest(height_m, 0.5), 0.976)", 1)} AS biomass_kg FROM b), k AS (SELECT *, {_HE(f"biomass_kg * {CONFIG.carbon_fraction}", 1)} AS carbon_kg FROM g),
  a AS (SELECT *, {_HE("carbon_kg * 3.667", 1)} AS co2e_kg, {_HE("greatest(0.15, dbh_cm / 100)", 2)} AS trunk_diameter_m FROM k)"""


def _trees(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("tree_id"), F.col("p_size").cast("double").alias("height_m"), (F.col("p_retailprice") / 10).alias("area_m2"))


@query(f"WITH {_ALLO} SELECT tree_id, crown_diameter_m, dbh_cm, biomass_kg, carbon_kg, co2e_kg, trunk_diameter_m FROM a")
def tree_allometry(spark, sf_dir):
    return trees.allometry(trees.crown(_trees(spark, sf_dir))).select("tree_id", "crown_diameter_m", "dbh_cm", "biomass_kg", "carbon_kg", "co2e_kg", "trunk_diameter_m")


@query(f"""WITH {_TREES}, k AS (SELECT *, {_HE(f"height_m * {CONFIG.trunk_ratio}", 2)} AS trunk_m FROM t), q AS (SELECT *, {_HE("height_m - trunk_m", 2)} AS crown_m FROM k),
  n AS (SELECT *, CASE WHEN crown_m >= 2.0 THEN 3 WHEN crown_m >= 0.8 THEN 2 ELSE 1 END AS n FROM q), e AS (SELECT *, unnest(range(0, n)) AS tier FROM n),
  x AS (SELECT tree_id, CAST(tier AS INT) AS tier, {_HE("trunk_m + tier * (crown_m / n)", 2)} AS base_m, CASE WHEN tier = n - 1 THEN {_HE("height_m", 2)} ELSE {_HE("trunk_m + (tier + 1) * (crown_m / n)", 2)} END AS top_m FROM e)
  SELECT * FROM x WHERE {_HE("top_m - base_m", 2)} > 0.05""")
def tree_tiers(spark, sf_dir):
    return trees.tiers(_trees(spark, sf_dir))


@query(f"WITH {_ALLO} SELECT count(*) AS n_trees, {_HE('avg(height_m)', 2)} AS mean_height_m, {_HE('min(height_m)', 2)} AS min_height_m, {_HE('max(height_m)', 2)} AS max_height_m, {_HE('sum(biomass_kg) / 1000', 3)} AS biomass_t, {_HE('sum(carbon_kg) / 1000', 3)} AS carbon_t, {_HE('sum(co2e_kg) / 1000', 3)} AS co2e_t FROM a")
def tree_summary(spark, sf_dir):
    return trees.summary(trees.allometry(trees.crown(_trees(spark, sf_dir))))


# ---- invariants ----

TOL = validate.tolerance(CONFIG.round_digits)


@query(f"WITH {PARTS} SELECT obj AS object_id, pid AS part_id, parent AS parent_part_id FROM parts WHERE parent IS NOT NULL AND parent NOT IN (SELECT pid FROM parts)")
def validate_orphans(spark, sf_dir):
    return validate.orphans(scene.parts(spark, sf_dir))


@query(f"WITH {PARTS} SELECT obj AS object_id, count(*) FILTER (parent IS NULL) AS n_roots FROM parts GROUP BY obj HAVING count(*) FILTER (parent IS NULL) <> 1")
def validate_roots(spark, sf_dir):
    return validate.roots(scene.parts(spark, sf_dir))


@query(f"""WITH {PARTS} SELECT pid AS part_id, 'a root''s level isn''t 0' AS problem FROM parts WHERE parent IS NULL AND lvl <> 0
  UNION ALL SELECT a.pid, 'the parent is of another object' FROM parts a JOIN parts b ON a.parent = b.pid WHERE a.obj <> b.obj
  UNION ALL SELECT a.pid, 'the level isn''t the parent''s plus 1' FROM parts a JOIN parts b ON a.parent = b.pid WHERE a.lvl <> b.lvl + 1
  UNION ALL SELECT a.pid, 'the base isn''t the parent''s top' FROM parts a JOIN parts b ON a.parent = b.pid WHERE abs(a.base - b.top) > {TOL}""")
def validate_hierarchy(spark, sf_dir):
    return validate.hierarchy(scene.parts(spark, sf_dir), TOL)


@query(f"""WITH {PARTS} SELECT pid AS part_id, 'top elevation' AS problem FROM parts WHERE abs(ground + top - top_elev) > {TOL} UNION ALL SELECT pid, 'coverage' FROM parts WHERE cov NOT BETWEEN 0 AND 1
  UNION ALL SELECT pid, 'base elevation' FROM parts WHERE abs(ground + base - base_elev) > {TOL} UNION ALL SELECT pid, 'height' FROM parts WHERE abs(top - base - height) > {TOL}
  UNION ALL SELECT pid, 'negative height' FROM parts WHERE height < 0 OR (parent IS NOT NULL AND height <= 0)""")
def validate_vertical(spark, sf_dir):
    return validate.vertical(scene.parts(spark, sf_dir), TOL)


@query(f"WITH {PARTS} SELECT pid AS part_id, volume AS volume_m3 FROM parts WHERE abs(volume - area * height) > greatest(0.1, {TOL} * greatest(volume, 1))")
def validate_volume(spark, sf_dir):
    return validate.volume(scene.parts(spark, sf_dir), TOL)


@query(f"""WITH {PARTS} SELECT substr(pid, -3) AS part_id, 'repeated part_id' AS problem FROM parts GROUP BY 1 HAVING count(*) > 1
  UNION ALL SELECT substr(pid, -3), 'empty object_id' FROM parts WHERE obj % 5 < 2 UNION ALL SELECT substr(pid, -3), 'the feature''s id isn''t part_id' FROM parts WHERE obj % 3 = 0""")
def validate_ids(spark, sf_dir):
    p = scene.parts(spark, sf_dir).withColumn("part_id", F.substring("part_id", -3, 3))
    named = p.withColumn("feature_id", F.when(F.col("object_id") % 3 == 0, F.when(F.col("object_id") % 2 == 0, "other")).otherwise(F.col("part_id")))
    blank = F.when(F.col("object_id") % 5 == 0, " ").when(F.col("object_id") % 5 == 1, None).otherwise(F.col("object_id").cast("string"))
    return validate.ids(named.withColumn("object_id", blank))


@query(f"WITH RECURSIVE {PARTS}, walk AS (SELECT pid, pid AS root, 0 AS depth FROM parts WHERE parent IS NULL UNION ALL SELECT parts.pid, root, depth + 1 FROM parts JOIN walk ON parts.parent = walk.pid) SELECT pid AS part_id, root AS root_id, depth FROM walk")
def part_roots(spark, sf_dir):
    return validate.part_roots(scene.parts(spark, sf_dir))


#: Boxes within boxes: the overlap of a part with its parent and its root has a closed form.
_SHAPES = """sh AS (SELECT obj, pid, parent, n, x0, x0 + side AS x1, 4.0 * n AS y0, 4.0 * n + CASE WHEN p_size % 37 = 0 THEN 0 ELSE side END AS y1 FROM (SELECT *, (40 - 8 * n)::DOUBLE AS side, 4.0 * n + CASE WHEN p_size % 9 = 0 THEN 3 + p_size / 2 ELSE 0 END AS x0,
  printf('%d-P%02d', obj, n) AS pid, CASE WHEN n > 0 THEN printf('%d-P%02d', obj, n - 1) END AS parent FROM (SELECT p_size, CAST(p_partkey % 4 AS BIGINT) AS n, CAST(p_partkey // 4 AS BIGINT) AS obj FROM part))),
  pr AS (SELECT a.*, b.pid AS bpid, (a.x1 - a.x0) * (a.y1 - a.y0) AS area, CASE WHEN b.y1 > b.y0 THEN greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) ELSE 0 END AS shared, r.obj AS robj,
  CASE WHEN r.y1 > r.y0 THEN greatest(0, least(a.x1, r.x1) - greatest(a.x0, r.x0)) * greatest(0, least(a.y1, r.y1) - greatest(a.y0, r.y0)) ELSE 0 END AS in_root FROM sh a LEFT JOIN sh b ON b.pid = a.parent LEFT JOIN sh r ON r.obj = a.obj AND r.n = 0)"""


@query(f"""WITH {_SHAPES} SELECT pid AS part_id, 'the geometry is invalid or has no area' AS problem FROM pr WHERE area = 0 UNION ALL SELECT pid, 'it lies outside its parent' FROM pr WHERE area > 0 AND bpid IS NOT NULL AND area - shared > greatest(1e-6 * area, 1e-4)
  UNION ALL SELECT pid, 'it lies outside its root' FROM pr WHERE area > 0 AND robj IS NOT NULL AND n > 0 AND area - in_root > greatest(1e-6 * area, 1e-4)""")
def validate_geometry(spark, sf_dir):
    return validate.geometry(scene.part_shapes(spark, sf_dir))


@query(f"WITH {_SHAPES} SELECT pid AS part_id, parent AS parent_part_id, round(shared, 6) AS shared_m2, round(area - shared, 6) AS outside_m2, round(CASE WHEN area > 0 THEN shared / area ELSE 0 END, 6) AS share FROM pr WHERE bpid IS NOT NULL")
def polygon_overlap(spark, sf_dir):
    shapes_of = scene.part_shapes(spark, sf_dir)
    up = shapes_of.select(F.col("part_id").alias("above"), F.col("polygons").alias("b"))
    up = up.hint("merge")  # a shape is larger than Spark takes a nested array for
    return _round(shape_columns.overlap(shapes_of.join(up, F.col("parent_part_id") == F.col("above")).select("part_id", "parent_part_id", F.col("polygons").alias("a"), "b")))


@query(f"WITH {_SHAPES} SELECT pid AS part_id, parent AS parent_part_id FROM pr WHERE bpid IS NOT NULL AND CASE WHEN area > 0 THEN shared / area ELSE 0 END < 0.95")
def not_contained(spark, sf_dir):
    """Parts of which less than 95 % lies in their parent."""
    return polygon_overlap(spark, sf_dir).filter("share < 0.95").select("part_id", "parent_part_id")


@query(f"""WITH {_SHAPES}, ev AS (SELECT s.obj, s.x0, s.x1, s.y0, s.y1 FROM sh s WHERE y1 > y0), xs AS (SELECT obj, x, lead(x) OVER (PARTITION BY obj ORDER BY x) AS nx FROM (SELECT obj, x0 AS x FROM ev UNION SELECT obj, x1 FROM ev)),
  ys AS (SELECT obj, y, lead(y) OVER (PARTITION BY obj ORDER BY y) AS ny FROM (SELECT obj, y0 AS y FROM ev UNION SELECT obj, y1 FROM ev)),
  ce AS (SELECT DISTINCT xs.obj, x, nx, y, ny FROM xs JOIN ys USING (obj) JOIN ev ON ev.obj = xs.obj AND ev.x0 <= x AND ev.x1 >= nx AND ev.y0 <= y AND ev.y1 >= ny WHERE nx IS NOT NULL AND ny IS NOT NULL)
  SELECT obj AS object_id, round(sum((nx - x) * (ny - y)), 6) AS area_m2 FROM ce GROUP BY obj""")
def polygon_union(spark, sf_dir):
    return _round(shape_columns.union_area(scene.part_shapes(spark, sf_dir)))


@query("""WITH e AS (SELECT o_custkey % 50 AS shell_id, o_orderkey % 7 AS a, o_orderkey % 11 AS b FROM orders WHERE o_orderkey % 7 <> o_orderkey % 11)
  SELECT shell_id, least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n, CAST(sum(CASE WHEN a < b THEN 1 ELSE -1 END) AS BIGINT) AS balance FROM e GROUP BY ALL HAVING count(*) <> 2 OR sum(CASE WHEN a < b THEN 1 ELSE -1 END) <> 0""")
def shell_edge_check(spark, sf_dir):
    """All orders as edges; an edge needs two ends, so those with equal ends are none."""
    k = F.col("o_orderkey")
    return validate.shell_edges(spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 50).alias("shell_id"), (k % 7).alias("a"), (k % 11).alias("b")).filter("a <> b"))


@query("""SELECT coalesce(a.path, b.path) AS path, a.c_mktsegment AS a, b.c_mktsegment AS b FROM (SELECT c_custkey || '' AS path, c_mktsegment FROM customer) a
  FULL JOIN (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'moved.' ELSE '' END || c_custkey AS path, CASE WHEN c_custkey % 7 = 0 THEN 'other' WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer) b USING (path)
  WHERE a.c_mktsegment IS DISTINCT FROM b.c_mktsegment ORDER BY path LIMIT 20""")
def document_diff(spark, sf_dir):
    """The first differences (that is the report) of two documents made of all customers: values and paths of some differ."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    other = F.when(k % 7 == 0, "other").when(k % 13 == 0, None).otherwise(seg)
    return validate.document_diff(c.select(k.cast("string").alias("path"), seg.alias("value")), c.select(F.concat(F.when(k % 11 == 0, "moved.").otherwise(""), k.cast("string")).alias("path"), other.alias("value")))


# ---- ids, properties, rings ----

#: Ids as JSON text, and what each becomes by the rule: strings trimmed, whole numbers without a point, others at their shortest.
_FORMS = (("'\"  id ' || ord || ' \"'", "'id ' || ord"), ("ord || '.0'", "CAST(ord AS VARCHAR)"), ("'true'", "NULL"), ("'null'", "NULL"), ("CAST(ord // 3 AS VARCHAR)", "CAST(ord // 3 AS VARCHAR)"), ("'\"   \"'", "NULL"),
          ("'\"00' || ord || '\"'", "'00' || ord"), ("ord || '.50'", "ord || '.5'"), ("'\"' || ord || '.0\"'", "ord || '.0'"), ("ord || 'e2'", "CAST(ord * 100 AS VARCHAR)"), ("'{\"a\":' || ord || '}'", "NULL"), ("'\"a' || ord || '}\"'", "'a' || ord || '}'"), ("'-0'", "'0'"))
_IDS = "ids AS (SELECT c_custkey AS ord, CASE c_custkey % 13 " + " ".join(f"WHEN {k} THEN {raw.replace('ord', 'c_custkey')}" for k, (raw, _) in enumerate(_FORMS)) + " END AS raw FROM customer)"
_NORMAL = f"{_IDS}, nid AS (SELECT ord, CASE ord % 13 " + " ".join(f"WHEN {k} THEN {want}" for k, (_, want) in enumerate(_FORMS)) + " END AS object_id FROM ids)"


def _ids(spark, sf_dir):
    k = F.col("c_custkey")
    s = k.cast("string")
    forms = (F.concat(F.lit('"  id '), s, F.lit(' "')), F.concat(s, F.lit(".0")), F.lit("true"), F.lit("null"), F.floor(k / 3).cast("string"), F.lit('"   "'), F.concat(F.lit('"00'), s, F.lit('"')), F.concat(s, F.lit(".50")), F.concat(F.lit('"'), s, F.lit('.0"')), F.concat(s, F.lit("e2")), F.concat(F.lit('{"a":'), s, F.lit("}")), F.concat(F.lit('"a'), s, F.lit('}"')), F.lit("-0"))
    raw = F.get(F.array(*forms), (k % len(forms)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("ord"), scalar.normalize_id(raw).alias("object_id"))


@query(f"WITH {_NORMAL} SELECT ord, object_id FROM nid")
def id_normalise(spark, sf_dir):
    return _ids(spark, sf_dir)


@query(f"WITH {_NORMAL} SELECT object_id, count(*) AS n FROM nid WHERE object_id IS NOT NULL GROUP BY object_id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return _ids(spark, sf_dir).filter("object_id is not null").groupBy("object_id").agg(F.count("*").alias("n")).filter("n > 1")


@query("""WITH a AS (SELECT c_custkey AS ord, c_custkey // 7 AS g, c_custkey % 7 AS k FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY g) AS size FROM a)
  SELECT ord, CASE k WHEN 0 THEN 't' || g WHEN 1 THEN 't' || g || '_01' WHEN 2 THEN 't' || g || '_02' WHEN 3 THEN 't' || g || '_03' WHEN 4 THEN 't' || g || '_01_01' WHEN 5 THEN 't' || g || '_04' ELSE 't' || g || '_05' END AS tree_id FROM n""")
def id_disambiguate(spark, sf_dir):
    """Names a, a, a_02, a, a_01, a, a in each group of seven: each takes the first free one in turn."""
    g, k = F.floor(F.col("c_custkey") / 7), F.col("c_custkey") % 7
    name = F.concat(F.lit("t"), g.cast("string"), F.when(k == 2, "_02").when(k == 4, "_01").otherwise(""))
    return trees.first_free_ids(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("ord"), name.alias("tree_id")), "tree_id", ["ord"])


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def property_union(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.explode(F.json_object_keys("props")).alias("key")).distinct()


@query(f"""WITH n AS (SELECT [{", ".join(f"'{c}'" for c in scalar.CANONICAL)}, 'k'] AS names) SELECT event_id, names[event_id % 27 + 1] AS asked, CASE WHEN event_id % 27 < 26 THEN 'src_' ELSE '' END || names[event_id % 27 + 1] AS name, json_extract_string(props, '$.k') AS value FROM events, n""")
def property_keep(spark, sf_dir):
    """Each event has one wanted property, by turns one of a part's 26 own names or another, and one that isn't wanted."""
    names = [*scalar.CANONICAL, "k"]
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int"))
    props = F.create_map(key, F.get_json_object("props", "$.k"), F.lit("dropped"), F.lit("x"))
    return e.select("event_id", key.alias("asked"), F.explode(scalar.keep_properties(props, names)).alias("name", "value")).select("event_id", "asked", "name", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(printf('%.2f', l_extendedprice * 0.0125) AS DOUBLE) AS two, CAST(printf('%.1f', l_quantity / 20) AS DOUBLE) AS one, CAST(printf('%.0f', l_quantity / 2 - 10) AS DOUBLE) + 0.0 AS zero, CAST(printf('%.4f', l_discount / 7) AS DOUBLE) AS four FROM lineitem")
def round_half_even(spark, sf_dir):
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", scalar.half_even(F.col("l_extendedprice") * 0.0125, 2).alias("two"), scalar.half_even(F.col("l_quantity") / 20, 1).alias("one"), (scalar.half_even(F.col("l_quantity") / 2 - 10, 0) + 0.0).alias("zero"), scalar.half_even(F.col("l_discount") / 7, 4).alias("four"))


@query("""WITH f AS (SELECT s_suppkey AS object_id, (7 + s_suppkey % 9)::DOUBLE AS w, (s_suppkey % 3 + 6 + s_suppkey % 11 - s_suppkey % 3)::DOUBLE AS h FROM supplier)
  SELECT object_id, w * h AS area_m2, 2 * (w + h) AS perimeter_m, round(4 * pi() * w * h / pow(2 * (w + h), 2), 6) AS circularity, CAST(CASE WHEN w >= h THEN 90 ELSE 0 END AS DOUBLE) AS orientation_deg FROM f""")
def ring_metrics(spark, sf_dir):
    f = scene.footprints(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("object_id")), "object_id", "left_semi").select("object_id", F.array("x0", "x1", "x1", "x0").alias("xs"), F.array("y0", "y0", "y1", "y1").alias("ys"))
    a, p = scalar.signed_area(F.col("xs"), F.col("ys")), scalar.perimeter(F.col("xs"), F.col("ys"))
    dx, dy = F.get("xs", F.lit(1)) - F.get("xs", F.lit(0)), F.get("ys", F.lit(2)) - F.get("ys", F.lit(1))
    turn = F.when(dx >= dy, scalar.azimuth(dx, F.lit(0.0))).otherwise(scalar.azimuth(F.lit(0.0), dy))
    return f.select("object_id", a.alias("area_m2"), p.alias("perimeter_m"), F.round(scalar.circularity(a, p), 6).alias("circularity"), turn.alias("orientation_deg"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 32600 ELSE 32700 END + least(greatest(CAST(floor((c_custkey % 360) / 6) AS INT) + 1, 1), 60) AS epsg FROM customer")
def utm_zone(spark, sf_dir):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), scalar.utm_epsg(k % 360 - 180.0, F.when(k % 2 == 0, 5.0).otherwise(-5.0)).alias("epsg"))


# ---- jobs ----


@query(f"WITH {JOBS} SELECT job_id, row_number() OVER (ORDER BY ts, job_id) AS position FROM last WHERE state = 'queued'")
def job_queue_position(spark, sf_dir):
    return jobs.queue_positions(scene.jobs(spark, sf_dir))


_SOURCES = "src AS (SELECT DISTINCT user_id AS job_id, CASE WHEN user_id % 3 = 0 AND user_id > 0 THEN user_id // 2 END AS source FROM events)"


@query(f"""WITH {JOBS}, {_SOURCES}, live AS (SELECT job_id FROM last WHERE state NOT IN ('completed', 'failed', 'cancelled')) SELECT job_id, state FROM last WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR
  AND job_id NOT IN (SELECT job_id FROM live) AND job_id NOT IN (SELECT source FROM src WHERE source IS NOT NULL AND job_id IN (SELECT job_id FROM live))""")
def ttl_cleanup(spark, sf_dir):
    return jobs.expired(scene.jobs(spark, sf_dir), 24, NOW, scene.job_inputs(spark, sf_dir))


@query(f"WITH RECURSIVE {_SOURCES}, w AS (SELECT job_id, coalesce(source, job_id) AS owner, 0 AS k FROM src UNION ALL SELECT w.job_id, s.source, k + 1 FROM w JOIN src s ON s.job_id = w.owner WHERE s.source IS NOT NULL) SELECT job_id, arg_max(owner, k) AS owner FROM w GROUP BY job_id")
def job_input_owner(spark, sf_dir):
    return jobs.input_owners(scene.job_inputs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT job_id, seq, state FROM ev WHERE job_id % 2 = 0 OR seq > job_id * 50")
def job_events_after(spark, sf_dir):
    """Events beyond each odd job's cursor; even jobs have none."""
    log = scene.jobs(spark, sf_dir)
    cursor = log.select("job_id").distinct().filter("job_id % 2 = 1").select("job_id", (F.col("job_id") * 50).alias("seq"))
    return jobs.events_after(log, cursor).select("job_id", "seq", "state")


@query(f"""WITH {JOBS}, c AS (SELECT job_id, seq, state, lag(state) OVER (PARTITION BY job_id ORDER BY ts, seq) AS before FROM ev) SELECT job_id, seq, before, state FROM c WHERE state IS DISTINCT FROM before AND NOT coalesce(CASE before WHEN 'queued' THEN state IN ('running', 'cancelled')
  WHEN 'running' THEN state IN ('cancelling', 'completed', 'failed', 'cancelled') WHEN 'cancelling' THEN state IN ('cancelled', 'completed', 'failed') WHEN 'completed' THEN false WHEN 'failed' THEN false ELSE state = 'queued' END, false)""")
def job_wrong_changes(spark, sf_dir):
    return jobs.wrong_changes(scene.jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT job_id, seq, state FROM (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY ts, seq) AS b FROM ev) WHERE state IS DISTINCT FROM b")
def job_state_changes(spark, sf_dir):
    return jobs.state_changes(scene.jobs(spark, sf_dir)).select("job_id", "seq", "state")


# ---- single trees, outlines, shapes and meshes ----


#: Seen as a canopy, the podium's smoothed height has its tops on the tower alone, and all of them are one plateau or its branches.
@query()
def individual_trees(spark, sf_dir):
    px = scene.towers(spark, sf_dir)
    return trees.detect(px, trees.clean_apex(px, trees.canopy_profile(px)))


@query(f"""WITH {_TOWER_PARTS}, sup AS (SELECT s_suppkey AS object_id, 5 + s_suppkey % 4 AS w FROM supplier) SELECT pt.object_id, part_id, CAST(1 AS BIGINT) AS n_polygons, CAST(5 AS BIGINT) AS n_points, CASE part_level WHEN 0 THEN 0 ELSE 10 END::DOUBLE AS x0, CASE part_level WHEN 0 THEN 0 ELSE 10 END::DOUBLE AS y0,
  CASE part_level WHEN 0 THEN 24 ELSE 10 + w END::DOUBLE AS x1, CASE part_level WHEN 0 THEN 24 ELSE 15 END::DOUBLE AS y1 FROM pt JOIN sup ON sup.object_id = pt.object_id""")
def part_outlines(spark, sf_dir):
    points = F.flatten(F.flatten("polygons"))
    at = lambda f, k: f(F.transform(points, lambda q: q[k]))
    own = hierarchy.outlines(scene.towers(spark, sf_dir))
    return own.select("object_id", "part_id", F.size("polygons").cast("long").alias("n_polygons"), F.size(points).cast("long").alias("n_points"), at(F.array_min, 0).alias("x0"), at(F.array_min, 1).alias("y0"), at(F.array_max, 0).alias("x1"), at(F.array_max, 1).alias("y1"))


_BOXES = """bx AS (SELECT p_partkey AS object_id, CAST(p_partkey % 5 AS DOUBLE) AS x0, CAST(p_partkey % 3 AS DOUBLE) AS y0, CAST(7 + p_size % 9 AS DOUBLE) AS w, CAST(6 + p_partkey % 11 AS DOUBLE) AS h, CAST(p_size + 1 AS DOUBLE) AS z FROM part)"""


def _boxes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    x0, y0 = (p.p_partkey % 5).cast("double"), (p.p_partkey % 3).cast("double")
    x1, y1 = x0 + (7 + p.p_size % 9), y0 + (6 + p.p_partkey % 11)
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))
    return p.select(p.p_partkey.alias("object_id"), F.format_string("%d-P00", p.p_partkey).alias("part_id"), F.array(ring).alias("rings"), F.lit(10.0).alias("base_elevation_m"), (F.lit(11.0) + p.p_size).alias("top_elevation_m"))


@query(f"WITH {_BOXES} SELECT object_id, greatest(w, h) AS length_m, least(w, h) AS width_m, CAST(CASE WHEN w >= h THEN 90 ELSE 0 END AS DOUBLE) AS azimuth_deg, round(sqrt(w * w + h * h) / 2, 6) AS circle_radius_m FROM bx")
def shape_metrics(spark, sf_dir):
    return _round(shape_columns.shape_metrics(_boxes(spark, sf_dir)))


@query(f"WITH {_BOXES} SELECT CAST(object_id AS VARCHAR) AS object_id, printf('%d-P00', object_id) AS part_id, CAST(12 AS BIGINT) AS n_triangles, CAST(1 AS BIGINT) AS n_shells, round(2 * w * h + 2 * (w + h) * z, 6) AS surface_m2, round(w * h * z, 6) AS volume_m3, CAST(NULL AS VARCHAR) AS problem FROM bx")
def prism_meshes(spark, sf_dir):
    return _round(exports.meshes(_boxes(spark, sf_dir)))
