"""Near copies by exact shingle similarity (the pipeline's stage): SimHash first, then a prefix-filtered self-join of sets.

A text's set holds the 64-bit hashes of its runs of ``SHINGLE`` words; a text of fewer words is one
run.  Two sets are linked if their Jaccard similarity is at least 4/5, counted in whole numbers; op10's
query keeps its own contract in ``simhash``.  Sets as much alike as that differ in up to a dozen of 64 bits
and more, beyond what the pigeonhole probes of ``simhash`` can reach in less than quadratic time, so they
find the closest copies, and the join finds all others:

1. Equal sets fall together by the hash of the set.
2. Sets get a SimHash of their shingles; those within ``simhash.TAU`` bits (operator 10's generalised
   pigeonhole) are candidates.  This joins most of a large group of copies at a row for each.
3. All sets are read in one order: shingles that are frequent in a bounded sample last, the others by
   hash.  Any order gives the same links; this one keeps boilerplate out of the index.  Linked sets
   share one of the first n - ceil(4 n / 5) + 1 shingles of each, so only these are dealt out by shingle;
   shingles that are very frequent in the sample are known to be crowded and are spread.
4. Cells of at most ``CELL`` sets give all pairs that size and position allow.  Linked sets that meet only
   in larger cells are both among the sets of these, a few of all; so these sets alone are joined once more,
   in an order of their own: by how many of them have a shingle, counted in all and not in a sample.  There
   a sentence that many texts repeat comes last, however few of the whole table have it.
5. In a cell that is still larger all are compared with one member, another in each round, as long as that
   joins groups; then all pairs of its sets that are in different groups yet are compared.  Sets that are
   too far down to be linked even to the shortest of the cell are left out.  Sets of one group are in one component already, so nothing is lost, and a group of near copies costs a row for each,
   not each pair.  Only sets that share a rare shingle and really are dissimilar meet pair by pair.
6. Candidates whose shingles fall into ``BINS`` bins so differently that the bins alone rule out the
   similarity are dropped; the others are verified on their whole sets, made again from the texts that take part.

Defined results: null, empty and blank texts are one empty set; rows that share a doc_id are linked; rows
without doc_id stay; empty tables give no rows; other columns are kept.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.llm import simhash
from massif.llm.common import cut, held, released, slices, swept, with_arrow
from massif.llm.simhash import closure, keep_first

SHINGLE, SAMPLE, HEAVY, HOT, CELL, ROUNDS, ROWS, BINS, SEEN = 5, 1 << 16, 200_000, 512, 16, 6, 1 << 17, 256, 1 << 18
_hash, _MIX, U = partial(xxhash.xxh64_intdigest, seed=42), np.uint64(0x9E3779B97F4A7C15), np.uint64


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The text's distinct shingles as sorted hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < k:
        return np.array([_hash(b" ".join(words))] if words else [], U)
    own = np.fromiter(map(_hash, words), U, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, U)
    for j in range(k):
        out = (out ^ own[j : j + n]) * _MIX
        out ^= out >> U(32)
    return np.unique(out)


def set_id(own: np.ndarray) -> int:
    return int(np.array(_hash(own.tobytes()), U).view(np.int64)) if len(own) else 0


def prefix(own: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which a linked set has at least one in its own prefix."""
    if not len(own):
        return own
    place = np.zeros(len(own), np.int64)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, own), len(heavy) - 1)
        place = np.where(heavy[at] == own, rank[at], 0)
    return own[np.argsort(place, kind="stable")][: len(own) - (4 * len(own) + 4) // 5 + 1]


def simhash_of(own: np.ndarray) -> int:
    """The SimHash of a set: each bit that more than half of its shingles have."""
    if not len(own):
        return 0
    ones = sum(np.unpackbits(own[at : at + ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(0, len(own), ROWS))
    return int(np.packbits(2 * ones > len(own), bitorder="little").view(np.int64)[0])


def bins_of(own: np.ndarray) -> bytes:
    """How many shingles have each value of the hash's lowest bits, 255 for that many and more."""
    return np.minimum(np.bincount((own % U(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _arrays(sets: list) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), U) for s in sets]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, U)]).view(np.int64)))


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles of several texts of a sample, sorted, their places in the order from 1, and the place from which they are hot.

    Only a quarter of each set is counted, by hash, which is somewhat more than its prefix: others seldom come into one.
    Those that wouldn't fill half a cell are left out, as most shingles of a few near copies.
    """
    n = docs.count()
    fraction = min(1.0, SAMPLE / max(1, n))
    adds = T.StructType([T.StructField("s", T.ArrayType(T.LongType()))])
    sample = with_arrow(docs.select("text").sample(fraction, 42), ["text"], adds, lambda c: [_lists([x[: len(x) // 4 + 1] for x in (shingles(t, k) for t in c[0])])])
    least = max(2, int(CELL / 2 * fraction))
    top = sample.select(F.explode("s").alias("s")).groupBy("s").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "s").limit(HEAVY).toArrow()
    keys, many = top["s"].to_numpy().view(U), top["count"].to_numpy()
    order = np.argsort(keys)
    swept(docs.sparkSession)
    return keys[order], many[order], max(8, int(n * fraction / HOT))


def _counted(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The same for whole sets (fp, s), all of which are counted."""

    def run(batches):
        def out(waiting):
            key, many = np.unique(np.concatenate(waiting), return_counts=True)
            for at in range(0, len(key), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + ROWS].view(np.int64)), pa.array(many[at : at + ROWS])], names=["s", "many"])

        waiting, size = [], 0
        for batch in (piece for whole in batches for piece in slices(whole)):
            for own in _arrays(batch.column(1)):
                waiting.append(own)
                size += len(own)
            if size >= 8 * ROWS:
                yield from out([np.array(x) for x in waiting])
                waiting, size = [], 0
        if size:
            yield from out(waiting)

    n, each = sets.count(), sets.select("fp", "s").mapInArrow(released(run), "s long, many long")
    top = each.groupBy("s").agg(F.sum("many").alias("many")).filter(F.col("many") >= CELL // 2).orderBy(F.desc("many"), "s").limit(HEAVY).toArrow()
    keys, many = top["s"].to_numpy().view(U), top["many"].to_numpy()
    order = np.argsort(keys)
    return keys[order], many[order], max(2 * CELL, n // HOT)


def described(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, mark (the text's hash), fp (the set's), n, sim, bins."""
    adds = T.StructType([T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sim", T.LongType()), T.StructField("bins", T.BinaryType())])

    def run(c):
        sets = [shingles(t, k) for t in c[0]]
        return [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([simhash_of(s) for s in sets], pa.int64()), pa.array([bins_of(s) for s in sets], pa.binary())]

    return with_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), ["text"], adds, run).drop("text")


def _prefixes(rows: DataFrame, order: tuple[np.ndarray, np.ndarray, int], read) -> DataFrame:
    """key, a (the set), n, pos, hot: the prefixes in this order; ``read`` gives the names and sets of a batch."""
    heavy = rows.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        keys, rank, least = heavy.value
        hot, seen = keys[rank >= least], set()
        for batch in (piece for whole in batches for piece in slices(whole)):
            key, own = [], []
            for name, found in read(batch):
                if name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                first = prefix(found, keys, rank)
                key.append(first)
                own.append((name, len(found), len(first)))
            if not own:
                continue
            key, (names, sizes, many) = np.concatenate([*key, np.zeros(0, U)]), (np.array(x, np.int64) for x in zip(*own, strict=True))
            pos = np.arange(len(key)) - np.repeat(np.cumsum(many) - many, many)
            columns = (key.view(np.int64), np.repeat(names, many), np.repeat(sizes, many).astype(np.int32), pos.astype(np.int32), np.isin(key, hot))
            for at in range(0, len(key), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + ROWS]) for x in columns], names=["key", "a", "n", "pos", "hot"])

    return rows.mapInArrow(released(run), "key long, a long, n int, pos int, hot boolean")


def index(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """key, a (the set), n, pos, hot: the prefixes; each task gives a set once, as far as it remembers."""
    return _prefixes(docs.select("text"), _frequent(docs, k), lambda batch: ((set_id(own), own) for own in (shingles(t, k) for t in batch.column(0).to_pylist())))


def reindex(sets: DataFrame) -> DataFrame:
    """The same for whole sets (fp, s), in the order of their own counts."""
    return _prefixes(sets.select("fp", "s"), _counted(sets), lambda batch: zip(batch.column(0).to_pylist(), _arrays(batch.column(1)), strict=True))


def _cells(rows: DataFrame, cell: int) -> DataFrame:
    """Rows a, b of pairs in cells of up to ``cell`` sets; of larger and hot cells rows key, a, n, pos, without b."""
    names = ["key", "a", "n", "pos", "b"]

    def out(key, a, n, pos, b):
        for at in range(0, len(a), ROWS):
            cols = [pa.nulls(len(a[at : at + ROWS]), t) if c is None else pa.array(c[at : at + ROWS], t) for c, t in zip((key, a, n, pos, b), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def part(key, a, n, pos, hot):
        order = np.lexsort((a, key))  # sets that several tasks gave fall together
        key, a, n, pos, hot = (x[order] for x in (key, a, n, pos, hot))
        once = np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1])])
        key, a, n, pos, hot = (x[once] for x in (key, a, n, pos, hot))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        big = np.repeat(size > cell, size) | hot
        if big.any():
            yield from out(key[big], a[big], n[big], pos[big], None)
        left, right = [], []
        for step in range(1, cell):  # each row with the one that many rows on in the same cell
            at = np.flatnonzero((key[step:] == key[:-step]) & ~big[step:])
            if not len(at):
                break
            to = at + step
            na, nb = n[at].astype(np.int64), n[to].astype(np.int64)
            able = (9 * np.minimum(na - pos[at], nb - pos[to]) >= 4 * (na + nb)) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb))
            left.append(np.minimum(a[at], a[to])[able])
            right.append(np.maximum(a[at], a[to])[able])
        if left:
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
            yield from out(None, pairs[0], None, None, pairs[1])

    def run(batches):
        waiting, size, over = [], 0, None
        for batch in batches:
            waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            size += batch.num_rows
            if size < ROWS:
                continue
            cols = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            if over is not None:  # a cell so large that it came in several pieces: known to be crowded
                cols[4] = cols[4] | (cols[0] == over)
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on
            if not last:
                over, last = cols[0][-1], len(cols[0])
                cols[4] = np.ones(last, bool)
            yield from part(*(c[:last] for c in cols))
            waiting, size = [[c[last:] for c in cols]], len(cols[0]) - last
        if size:
            cols = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            if over is not None:
                cols[4] = cols[4] | (cols[0] == over)
            yield from part(*cols)

    place = F.when(F.col("hot"), F.xxhash64("a")).otherwise(F.col("key"))
    return rows.repartition(place).sortWithinPartitions("key").mapInArrow(released(run), "key long, a long, n int, pos int, b long")


def _able(rows: DataFrame) -> DataFrame:
    """The rows key, a, n, pos that a set as short as the shortest of their cell could be linked to: what comes before ``pos`` isn't shared."""
    least = cut(rows.groupBy("key").agg(F.min("n").alias("least")))
    return rows.join(held(least), "key").filter("9 * (n - pos) >= 4 * (n + least)").drop("least")


def _possible(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sizes and bins allow the similarity."""
    side = lambda x: distinct.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"bins{x}"))

    def run(batches):
        for batch in (piece for whole in batches for piece in slices(whole, 4096)):
            bins = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int64) for i in (4, 5)]
            n, m = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            most = np.where((bins[0] == 255) | (bins[1] == 255), 1 << 40, np.minimum(*bins)).sum(axis=1)
            fits = (9 * most >= 4 * (n + m)) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
            yield batch.select(["a", "b"]).filter(pa.array(fits))

    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "binsa", "binsb")
    return cut(both.mapInArrow(released(run), "a long, b long"))


def _sets(docs: DataFrame, distinct: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """fp, s: the whole sets of those wanted (fp), made again from their texts."""
    marks = cut(distinct.select("fp", "mark").join(wanted, "fp", "left_semi").select("mark").distinct())
    texts = docs.select("text", F.xxhash64("text").alias("mark")).join(held(marks), "mark", "left_semi")

    def run(batches):
        seen: set[int] = set()
        for batch in (piece for whole in batches for piece in slices(whole)):
            sets = {}
            for text in batch.column(0).to_pylist():
                own = shingles(text, k)
                name = set_id(own)
                if name not in seen:
                    sets[name] = own.tobytes()
                    if len(seen) < SEEN:
                        seen.add(name)
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())], names=["fp", "s"])

    return texts.select("text").mapInArrow(released(run), "fp long, s binary").groupBy("fp").agg(F.first("s").alias("s"))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b whose sets (fp, s) are similar."""
    met = pairs.join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb")

    def similar(batches):
        for batch in (piece for whole in batches for piece in slices(whole)):
            keep = [9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)) for x, y in zip(_arrays(batch.column(2)), _arrays(batch.column(3)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(met.mapInArrow(released(similar), "a long, b long"))


def _verified(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, k: int) -> DataFrame:
    """Those of the pairs a, b whose sets are similar."""
    pairs = _possible(pairs, distinct)
    both = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    return _similar(pairs, _sets(docs, distinct, both, k))


def _closest(distinct: DataFrame) -> DataFrame:
    """a, b: pairs of sets whose SimHashes are equal or near: each set with the first of its SimHash, and the firsts of linked SimHashes."""
    firsts = cut(distinct.filter("n > 0").groupBy("sim").agg(F.min("fp").alias("a")))
    same = distinct.filter("n > 0").select("sim", F.col("fp").alias("b")).join(firsts, "sim").filter("a <> b").select("a", "b")
    near = simhash.links(firsts.select(F.col("sim").alias("fp"))).select(F.col("a").alias("sim"), F.col("b").alias("other"))
    far = near.join(firsts, "sim").join(firsts.select(F.col("sim").alias("other"), F.col("a").alias("b")), "other").select("a", "b")
    both = same.unionByName(far)
    return cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def links(docs: DataFrame, distinct: DataFrame, k: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """a, b: edges between distinct sets (fp, n, sim, bins, mark) whose closure is that of all similar pairs."""
    found = cut(_cells(index(docs, k), cell))
    swept(docs.sparkSession)
    seen = cut(_closest(distinct).unionByName(found.filter("b is not null").select("a", "b")).distinct())
    edges, crowded = _verified(seen, docs, distinct, k), _able(found.filter("b is null").drop("b").distinct()).select(F.col("a").alias("fp")).distinct()
    swept(docs.sparkSession)
    sets = cut(_sets(docs, distinct, crowded, k))  # all pairs from here on are of these
    found = cut(_cells(reindex(sets), cell))
    pairs = cut(found.filter("b is not null").select("a", "b").distinct().join(seen, ["a", "b"], "left_anti"))
    edges, seen = cut(edges.unionByName(_similar(_possible(pairs, distinct), sets))), seen.unionByName(pairs)
    crowded = _able(found.filter("b is null").drop("b").distinct())
    swept(docs.sparkSession)
    fits = F.expr("5 * least(n, m) >= 4 * greatest(n, m)")
    for turn in range(ROUNDS + 1):
        roots = closure(edges).select(F.col("node").alias("a"), "root")
        rows = cut(crowded.join(roots, "a", "left").withColumn("root", F.coalesce("root", "a")))
        groups = rows.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("size"), F.sum(F.expr("count * count")).alias("own")).filter("size * size > own")
        todo = groups.agg(F.sum("size").alias("rows"), F.sum(F.expr("(size * size - own) / 2")).alias("pairs")).first()
        if not todo.rows:
            break
        crowded = cut(rows.join(groups.select("key"), "key", "left_semi"))
        right = crowded.select("key", F.col("a").alias("b"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("root").alias("other"))
        last = turn == ROUNDS or todo.pairs <= cell * todo.rows
        if not last:
            right = right.groupBy("key").agg(F.min_by(F.struct("b", "m", "other"), F.xxhash64("b", F.lit(turn))).alias("x")).select("key", "x.*")
        near = crowded.join(right, "key").filter(fits & F.expr("root <> other"))
        if last:
            near = near.filter(F.expr("a < b and 9 * least(n - pos, m - at) >= 4 * (n + m)"))
        pairs = cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(seen, ["a", "b"], "left_anti"))
        edges = cut(edges.unionByName(_similar(_possible(pairs, distinct), sets)))
        swept(docs.sparkSession)
        if last:
            break
        seen, crowded = seen.unionByName(pairs), crowded.select("key", "a", "n", "pos")
    return edges


def components(docs: DataFrame, k: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """One row for each document: doc_id, component_id."""
    own = cut(described(docs, k))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bins").alias("bins"), F.min("mark").alias("mark")))
    twice = own.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a <> z").select("doc_id", "a")
    edges = links(docs, distinct, k, cell).unionByName(own.select("doc_id", "fp").join(twice, "doc_id").filter("fp <> a").select("a", F.col("fp").alias("b")))
    rooted = distinct.select("fp", "rep").join(closure(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = cut(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    return own.select("doc_id", "fp").join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, k: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with its columns; rows without doc_id stay."""
    return keep_first(docs, cut(components(docs, k, cell)))
