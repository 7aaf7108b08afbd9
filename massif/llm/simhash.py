"""SimHash near-duplicates (operator 10) by the generalised pigeonhole principle.

Fingerprints are over shingles of ``SHINGLE`` words with XXH64; texts of fewer words are one shingle.
Distinct fingerprints are linked if they differ in at most ``TAU`` bits:

1. Bits that vary together in a bounded sample of fingerprints form the same of ``m`` partitions.
2. Partition thresholds t_i >= -1 with sum TAU - m + 1 are chosen by dynamic programming on the
   estimated rows (probes, and candidates from the sample's distances); m is the cheapest.
   By the generalised pigeonhole principle a linked pair is within t_i on some partition i.
3. Each fingerprint probes, for each used partition, all values within t_i; candidates are verified.
4. A cell with over ``CELL`` fingerprints is not paired.  All fingerprints that are in or probe such
   a cell instead emit the 65 points at distance 0 and 1; two share a point exactly if they differ
   in at most two bits, and a point has at most 65 owners, so each is linked to the point's smallest
   owner.  That is exact and linear however large a group of near copies is.

Components come from alternating large-star and small-star steps, each a grouped minimum, until no
edge changes; nothing about documents is collected.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other;
rows that share a doc_id are linked; a component of rows without doc_id has a null component_id;
empty tables give no rows; other columns are ignored by ``components`` and kept by ``deduplicate``.
"""

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.llm.common import cut, held, with_arrow

SHINGLE, TAU, SAMPLE, CELL, BLOCK = 3, 2, 4096, 64, 1 << 16
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The text's 64-bit SimHash, as a signed number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    hashes = np.fromiter(map(_hash, shingles), np.uint64, max(1, len(words) - k + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp"""
    return with_arrow(docs.select("doc_id", "text"), ["text"], T.StructType([T.StructField("fp", T.LongType())]), lambda c: [pa.array([fingerprint(t, k) for t in c[0]], pa.int64())]).select("doc_id", "fp")


def partition_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """Deal the columns of a 0/1 matrix into m groups of correlated ones."""
    spread = bits.std(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        together = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((64, 64))
    np.fill_diagonal(together, 0)
    free, groups = set(range(64)), []
    for g in range(m):
        want = 64 // m + (g < 64 % m)
        own = [max(sorted(free), key=lambda b: (together[b][list(free)].sum(), spread[b]))]
        free.remove(own[0])
        while len(own) < want:
            best = max(sorted(free), key=lambda b: (together[b][own].mean(), -b))
            own.append(best)
            free.remove(best)
        groups.append(sorted(own))
    return groups


def allocate(bits: np.ndarray, groups: list[list[int]], n: int, tau: int) -> tuple[float, list[int]]:
    """The cheapest thresholds for these partitions: their cost in rows, and one threshold for each."""
    half = len(bits) // 2
    left, right = bits[:half], bits[half : 2 * half]
    costs = []
    pairs = [(left != np.roll(right, s, axis=0)) for s in range(16)] if half else []
    pairs = [x[x.sum(axis=1) > 4 * tau] for x in pairs]  # near copies are candidates under any plan
    for own in groups:
        apart = np.concatenate([x[:, own].sum(axis=1) for x in pairs]) if pairs else np.zeros(0)
        w, ball, row = len(own), 0, {-1: 0.0}
        for t in range(tau + 1):
            ball += len(list(combinations(range(w), t)))
            near = max((apart <= t).mean() if len(apart) else 0.0, ball / 2.0**w)
            row[t] = n * ball + near * n * n / 2
        costs.append(row)
    best = {0: (0.0, [])}  # by the sum of t_i + 1
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in row.items():
                if used + t + 1 <= tau + 1 and (used + t + 1 not in new or cost + c < new[used + t + 1][0]):
                    new[used + t + 1] = cost + c, [*chosen, t]
        best = new
    return best[tau + 1]


def plan(sample: list[int], n: int, tau: int = TAU) -> list[tuple[int, list[int]]]:
    """(mask, values to flip) of each used partition."""
    bits = np.unpackbits(np.array(sample, np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if sample else np.zeros((0, 64), np.uint8)
    options = []
    for m in range(2, tau + 3):
        groups = partition_bits(bits, m) if len(bits) > 1 else [list(range(g, 64, m)) for g in range(m)]
        options.append((*allocate(bits, groups, n, tau), groups))
    _, chosen, groups = min(options, key=lambda x: x[0])
    signed = lambda bs: int(np.array(sum(1 << b for b in bs), np.uint64).view(np.int64))
    return [(signed(own), [signed(f) for r in range(t + 1) for f in combinations(own, r)]) for own, t in zip(groups, chosen, strict=True) if t >= 0]


def links(distinct: DataFrame, tau: int = TAU, cell: int = CELL) -> DataFrame:
    """a, b: edges between distinct fingerprints (column fp) whose closure is that of all pairs within tau bits."""
    n = distinct.count()
    sample = [r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    parts = plan(sample, n, tau)
    data = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(mask)) for mask, _ in parts))).alias("part", "key"))
    crowded = data.groupBy("part", "key").agg(F.count("*").alias("size")).filter(F.col("size") > cell).select("part", "key", F.lit(True).alias("crowded"))

    def reach(i, mask, flips):
        return F.transform(F.lit(flips).cast("array<bigint>"), lambda x: F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(x).alias("key")))

    probes = distinct.select("fp", F.explode(F.concat(*(reach(i, mask, flips) for i, (mask, flips) in enumerate(parts)))).alias("x")).select("fp", "x.part", "x.key").join(crowded, ["part", "key"], "left")
    near = probes.filter(F.col("crowded").isNull()).select("part", "key", F.col("fp").alias("a")).join(data.select("part", "key", F.col("fp").alias("b")), ["part", "key"])
    found = near.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau)).select("a", "b")
    if tau != 2:
        if crowded.limit(1).count():
            raise ValueError("crowded cells are linked exactly for two bits only")
        return found.distinct()
    one = [1 << b for b in range(63)] + [-(1 << 63), 0]
    balls = probes.filter("crowded").select("fp").distinct().select("fp", F.explode(F.transform(F.lit(one).cast("array<bigint>"), lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    owners = balls.groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return found.unionByName(owners.select("a", F.explode("all").alias("b")).filter("a <> b")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) can reach."""

    def state(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()  # large star
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        stars = edges.join(least, "a")
        edges = stars.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()  # small star
        edges = cut(edges)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def components(docs: DataFrame, k: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """One row for each document: doc_id, fingerprint, component_id."""
    own = cut(fingerprints(docs, k))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    edges = links(distinct.select("fp"), tau)
    twice = own.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a <> z").select("doc_id", "a")
    edges = edges.unionByName(own.join(twice, "doc_id").filter("fp <> a").select("a", F.col("fp").alias("b")))
    roots = closure(edges)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = cut(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, k: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with its columns; rows without doc_id stay."""
    return keep_first(docs, cut(components(docs, k, tau)))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without those whose component (``found``: doc_id, component_id) has a smaller doc_id.

    Of rows that share a doc_id that stays, the one whose text is first in order stays; equal texts are as good as each other.
    """
    drop = cut(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_drop")).distinct())
    kept = docs.join(held(drop, 2_000_000), docs["doc_id"] == F.col("_drop"), "left_anti")
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        whole = F.struct(*(F.col(f"`{c}`") for c in kept.columns))
        first = kept.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(whole, F.coalesce("text", F.lit(""))).alias("_row"))
        some = first.select(*(F.col("_row")[c].alias(c) for c in kept.columns))
        kept = some.unionByName(kept.filter("doc_id is null"))
    return kept
