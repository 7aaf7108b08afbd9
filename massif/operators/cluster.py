"""Exact one-dimensional height clustering over histograms.

The cost depends on an object's distinct heights, not on its pixels: a pre-aggregated (height, count)
histogram for each object is all that meets in one place.  One method serves the columns and the kernels.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUNDS, STILL = 60, 1e-6


def histograms(pixels: DataFrame, least: float) -> DataFrame:
    """object_id, hist: sorted (v, n) of the heights from ``least`` on."""
    h = pixels.select("object_id", (F.col("dsm") - F.col("dtm")).alias("v")).filter(F.col("v") >= least)
    return h.groupBy("object_id", "v").agg(F.count("*").alias("n")).groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("hist"))


def quantiles(v: np.ndarray, n: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Linear quantiles of a histogram with ascending values."""
    upto = np.cumsum(n)
    place = shares * (upto[-1] - 1)
    low, high = (v[np.searchsorted(upto, f(place), "right")] for f in (np.floor, np.ceil))
    return low + (high - low) * (place - np.floor(place))


def centers_of(v: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's method on a histogram, from evenly spaced quantiles, at most ROUNDS rounds.

    k is at most the number of distinct heights; equal starting quantiles count once; a height on
    the midpoint of two centres belongs to the lower; an empty cluster keeps its centre; the update
    that hardly moves anything is still adopted.
    """
    k, mass = min(k, len(v)), n * v
    centers = np.unique(quantiles(v, n, np.arange(k) / (k - 1) if k > 1 else np.zeros(1)))
    for _ in range(ROUNDS):
        moved = centers.copy()
        first = np.concatenate([[0], np.searchsorted(v, (centers[1:] + centers[:-1]) / 2, "right")])
        some = np.flatnonzero(np.diff(first, append=len(v)))  # clusters that hold a height
        moved[some] = np.add.reduceat(mass, first[some]) / np.add.reduceat(n, first[some])
        far = np.abs(moved - centers).max()
        centers = np.sort(moved)
        if far < STILL:
            break
    return centers


def owners(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest of ascending centres, the lower of two that are as near."""
    return np.searchsorted((centers[1:] + centers[:-1]) / 2, v, "left")


def kmeans(hist: DataFrame, k: int) -> DataFrame:
    """Append centers to the histograms; rows are independent, so nothing is shuffled."""

    def run(batches):
        for batch in batches:
            found = [centers_of(np.array([x["v"] for x in h]), np.array([x["n"] for x in h], float), k).tolist() for h in batch["hist"]]
            yield pd.DataFrame({"object_id": batch["object_id"], "hist": batch["hist"], "centers": found})

    kind = hist.schema["object_id"].dataType.simpleString()
    return hist.select("object_id", "hist").mapInPandas(run, f"object_id {kind}, hist array<struct<v:double,n:bigint>>, centers array<double>")


def merge_close(centers: DataFrame, threshold: float) -> DataFrame:
    """object_id, cls, center: chains of centres closer than the threshold become their unweighted mean."""
    w = Window.partitionBy("object_id").orderBy("center")
    c = centers.select("object_id", F.explode("centers").alias("center"))
    c = c.withColumn("new", F.when(F.col("center") - F.lag("center").over(w) < threshold, 0).otherwise(1))
    c = c.withColumn("cls", F.sum("new").over(w) - 1)
    return c.groupBy("object_id", "cls").agg(F.avg("center").alias("center"))


def classes(hist: DataFrame, merged: DataFrame) -> DataFrame:
    """object_id, cls, center, px: pixels by nearest centre, ties to the lower."""
    cs = merged.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("center", "cls"))).alias("cs"))
    best = lambda v: F.array_min(F.transform("cs", lambda c: F.struct(F.abs(c["center"] - v).alias("d"), c["cls"].cast("int").alias("cls"), c["center"].alias("center"))))
    each = hist.join(cs, "object_id").select("object_id", F.explode("hist").alias("x"), "cs").select("object_id", "x.n", best(F.col("x.v")).alias("b"))
    return each.groupBy("object_id", F.col("b.cls").alias("cls"), F.col("b.center").alias("center")).agg(F.sum("n").alias("px"))


def levels(counted: DataFrame, min_change: float) -> DataFrame:
    """object_id, level, start_cls, height: a class opens a new level if the pixels from it upwards shrink by min_change against the last level's; else it raises that level's height."""
    rows = F.sort_array(F.collect_list(F.struct("center", "cls", "px")))
    per = counted.groupBy("object_id").agg(rows.alias("cs"))
    suffix = F.transform("cs", lambda x, i: F.aggregate(F.filter("cs", lambda y: y["center"] >= x["center"]), F.lit(0).cast("long"), lambda a, y: a + y["px"]))
    per = per.withColumn("cum", suffix)
    empty = F.array().cast("array<struct<start_cls:bigint,height:double>>")
    zero = F.struct(empty.alias("out"), F.lit(0).cast("long").alias("ref"))
    item = lambda x: F.struct(x["x"]["cls"].cast("long").alias("start_cls"), x["x"]["center"].alias("height"))

    def step(state, x):
        opens = (F.size(state["out"]) == 0) | (F.when(state["ref"] > 0, 1 - x["cum"] / state["ref"]).otherwise(1.0) >= min_change)
        last = F.element_at(state["out"], -1)
        raised = F.concat(F.slice(state["out"], F.lit(1), F.size(state["out"]) - 1), F.array(F.struct(last["start_cls"].alias("start_cls"), x["x"]["center"].alias("height"))))
        return F.when(opens, F.struct(F.concat(state["out"], F.array(item(x))).alias("out"), x["cum"].alias("ref"))).otherwise(F.struct(raised.alias("out"), state["ref"].alias("ref")))

    folded = F.aggregate(F.zip_with("cs", "cum", lambda x, u: F.struct(x.alias("x"), u.alias("cum"))), zero, step)
    return per.select("object_id", F.posexplode(folded["out"]).alias("level", "l")).select("object_id", "level", "l.start_cls", "l.height")
