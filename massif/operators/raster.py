"""Neighbourhood operators: relational where they are local, NumPy kernels for one object's window where they aren't."""

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---- relational ----


def closing(mask: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """object_id, row, col: the pixel set closed by n steps of the cross within its window, and itself; one shuffle on object_id, one window at a time."""
    kind = mask.schema["object_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros((height, width), bool)
        own[rows["row"].to_numpy(), rows["col"].to_numpy()] = True
        r, c = np.nonzero(close_mask(own, n))
        return pd.DataFrame({"object_id": rows["object_id"].iloc[0], "row": r.astype("i4"), "col": c.astype("i4")})

    return mask.select("object_id", "row", "col").groupBy("object_id").applyInPandas(run, f"object_id {kind}, row int, col int")


def local_maxima(pixels: DataFrame, reach: int, least: float = 0.0) -> DataFrame:
    """object_id, row, col, h: pixels above ``least`` that no pixel of the square around them exceeds.

    The largest of each row's neighbours is passed on along columns, so it needs a place also where the row has
    no pixel itself: beside gaps and ends rows without h stand in, as far as the square reaches.
    """
    h = pixels.select("object_id", "row", "col", (F.col("dsm") - F.col("dtm")).alias("h")).filter("object_id is not null and row is not null and col is not null")
    line = Window.partitionBy("object_id", "row").orderBy("col")
    col, before, after = F.col("col"), F.col("before"), F.col("after")
    beside = h.withColumns({"before": F.lag("col").over(line), "after": F.lead("col").over(line)})
    # each gap's left part is made by the pixel before it, and by the one after it what that doesn't reach
    right = F.when(after.isNull(), col + reach).otherwise(F.least(col + reach, after - 1))
    left = F.when(before.isNull(), col - reach).otherwise(F.greatest(col - reach, before + reach + 1))
    span = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    cells = F.concat(F.array(F.struct(col, F.col("h"))), F.transform(F.concat(span(left, col - 1), span(col + 1, right)), lambda c: F.struct(c.alias("col"), F.lit(None).cast("double").alias("h"))))
    every = beside.select("object_id", "row", F.inline(cells))
    across = every.withColumn("m", F.max("h").over(line.rangeBetween(-reach, reach)))
    both = across.withColumn("m", F.max("m").over(Window.partitionBy("object_id", "col").orderBy("row").rangeBetween(-reach, reach)))
    return both.filter((F.col("h") == F.col("m")) & (F.col("h") > least)).select("object_id", "row", "col", "h")


def best_parents(candidates: DataFrame, parts: DataFrame, least: float = 0.5) -> DataFrame:
    """cand, part, score: for pixel sets, the part of the highest level that holds enough of each candidate.

    candidates: object_id, cand, row, col; parts: object_id, part, lvl, row, col.  A root (lvl 0)
    needs any overlap; ties go to the larger part.
    """
    size = candidates.groupBy("object_id", "cand").agg(F.count("*").alias("n"))
    area = parts.groupBy("object_id", "part", "lvl").agg(F.count("*").alias("area"))
    both = candidates.join(parts, ["object_id", "row", "col"]).groupBy("object_id", "cand", "part", "lvl").agg(F.count("*").alias("m"))
    scored = both.join(size, ["object_id", "cand"]).join(area, ["object_id", "part", "lvl"]).withColumn("score", F.col("m") / F.col("n"))
    fit = scored.filter((F.col("lvl") == 0) | (F.col("score") >= least))
    w = Window.partitionBy("object_id", "cand").orderBy(F.desc("lvl"), F.desc("score"), F.desc("area"), "part")
    return fit.withColumn("k", F.row_number().over(w)).filter("k = 1").select("object_id", "cand", "part", "score")


# ---- kernels on one window ----


def shifted(mask: np.ndarray, fill: bool = False) -> list[np.ndarray]:
    p = np.pad(mask, 1, constant_values=fill)
    return [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]


def close_mask(mask: np.ndarray, n: int) -> np.ndarray:
    out = mask.copy()
    for _ in range(n):
        out = np.logical_or.reduce(shifted(out))
    for _ in range(n):
        out = np.logical_and.reduce(shifted(out))
    return out | mask


def label(mask: np.ndarray, eight: bool = False) -> tuple[np.ndarray, int]:
    """Connected components, numbered from 1 in row order of their first pixels.

    Rows fall into runs of pixels; runs that touch runs of the row above are joined, each round to the
    smallest number among their neighbours and that one's own.
    """
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    row, start = np.nonzero(step > 0)
    stop = np.nonzero(step < 0)[1]
    n, reach = len(row), int(eight)
    if not n:
        return np.zeros(mask.shape, np.int64), 0
    # for each run the first and last run of the row above that it touches
    line = mask.shape[1] + 2
    low = np.searchsorted((row + 1) * line + stop + reach, row * line + start, "right")
    high = np.searchsorted((row + 1) * line + start - reach, row * line + stop, "left")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[a]
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    first, number = np.unique(root, return_inverse=True)
    out = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int64)
    np.add.at(out, (row, start), number + 1)
    np.subtract.at(out, (row, stop), number + 1)
    return np.cumsum(out[:, :-1], axis=1), len(first)


def fill_small_holes(mask: np.ndarray, max_area: float, pixel_area: float = 1.0) -> np.ndarray:
    """Fill background that is enclosed (4-connected, not at the edge) and not larger than max_area."""
    if max_area <= 0 or not mask.any():
        return mask
    holes, n = label(~mask)
    edge = set(np.concatenate([holes[0], holes[-1], holes[:, 0], holes[:, -1]]).tolist())
    sizes = np.bincount(holes.ravel(), minlength=n + 1) * pixel_area
    fill = [k for k in range(1, n + 1) if k not in edge and sizes[k] <= max_area]
    return mask | np.isin(holes, fill)


def gaussian(z: np.ndarray, sigma: float = 0.85, truncate: float = 4.0) -> np.ndarray:
    """Separable Gaussian with mirrored borders."""
    radius = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(z, pad, mode="symmetric")
        z = sum(w * np.take(p, range(i, i + z.shape[axis]), axis=axis) for i, w in enumerate(k))
    return z


def watershed(cost: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Flood from the markers in order of cost, then of arrival."""
    out, heap, n = np.where(mask, markers, 0), [], 0
    for r, c in zip(*np.nonzero(out), strict=True):
        heapq.heappush(heap, (cost[r, c], n := n + 1, r, c))
    while heap:
        level, _, r, c = heapq.heappop(heap)
        for a, b in ((-1, 0), (0, -1), (0, 1), (1, 0)):
            y, x = r + a, c + b
            if 0 <= y < cost.shape[0] and 0 <= x < cost.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = out[r, c]
                heapq.heappush(heap, (max(level, cost[y, x]), n := n + 1, y, x))
    return out
