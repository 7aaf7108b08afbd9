"""Language-model scores (operator 6): prediction by partial matching over bytes, beside a smoothed word unigram.

The model is a trie of byte contexts up to ``ORDER`` with the counts of all training texts
(lower-cased A-Z, ``ORDER`` zero bytes before and one after each).  Escapes follow method C: a context
with d distinct successors escapes with probability d / (n + d); symbols that the longer context
has seen are excluded from the shorter ones; after order 0, unseen bytes are equally likely.  The
pretrained code length of a text is the sum over its bytes and its end.

Windows of ORDER + 1 bytes are counted where the texts are (sorted runs, one shuffle of partial counts);
those of scored texts that weren't learnt from take part with count zero, so every window that is scored
has a row.  All contexts of ``LOW`` + 1 bytes and more that share their last bytes meet in one task, in pieces of at
least ``PIECE`` windows that never split such a context (at most 256 ** 3 windows share one); shorter
windows, at most 256 ** 3, travel to every task.  So each distinct window gets its exact
log-probability without the trie ever meeting in one place.  The ``nodes`` most frequent travel to the
scoring tasks; each text's other windows are joined by window.  Word counts likewise: the
``FREQUENT`` most frequent words travel to the tasks, all others are joined by word.  What is joined is
rare, so no key of those joins is hot.

Defined results: null texts are empty; a document whose id is null is held out; without training
texts every byte has probability 1/256 and every token 1; repeated rows are scored one by one;
empty tables give no rows; other columns are ignored.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.llm.common import cut, remainder

ORDER, LOW, NODES, FREQUENT, BLOCK, WORDS_HELD, WINDOWS_HELD, PIECE, MISSES = 5, 2, 3_000_000, 200_000, 1 << 20, 300_000, 2_000_000, 1 << 20, 1 << 16
_MIX, U = np.uint64(0x9E3779B97F4A7C15), np.uint64


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def windows(data: bytes) -> np.ndarray:
    """The windows of ORDER + 1 bytes of a buffer, as numbers."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - ORDER
    key = b[:n].astype(U)
    for k in range(1, ORDER + 1):
        key <<= U(8)
        key |= b[k : k + n]
    return key


def pieces(text: bytes):
    """A text's padded bytes in blocks that overlap by the context."""
    data = b"\0" * ORDER + text + b"\0"
    for at in range(0, len(data) - ORDER, BLOCK):
        yield data[at : at + BLOCK + ORDER]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def counts(docs: DataFrame) -> DataFrame:
    """token, n of (text, held): words as 'w...', ends as 'e', windows as 'g' and their bytes; windows of held texts count zero."""

    def run(batches):
        words: Counter = Counter()
        keys, n, waiting, size, ends = np.zeros(0, U), np.zeros(0, np.int64), ([], []), 0, 0

        def merge():
            nonlocal keys, n, waiting, size
            for own, weight in zip(waiting, (1, 0), strict=True):
                if own:
                    got, c = np.unique(np.concatenate(own), return_counts=True)
                    keys, n = summed(np.concatenate([keys, got]), np.concatenate([n, weight * c.astype(np.int64)]))
            waiting, size = ([], []), 0

        def out(tokens, n):
            for at in range(0, len(tokens), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(tokens[at : at + 50_000], pa.binary()), pa.array(n[at : at + 50_000], pa.int64())], names=["token", "n"])

        def grams():
            packed = keys.astype(">u8").tobytes()
            return out([b"g" + packed[8 * i + 7 - ORDER : 8 * i + 8] for i in range(len(keys))], n)

        for batch in batches:
            for value, held in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = lowered(value.as_py())
                if not held:
                    words.update(text.split())
                    ends += 1
                for piece in pieces(text):
                    waiting[held].append(windows(piece))
                    size += len(piece)
                    if size >= 4 * BLOCK:
                        merge()
                if len(words) >= WORDS_HELD:
                    yield from out([b"w" + w for w in words], list(words.values()))
                    words.clear()
                if len(keys) >= WINDOWS_HELD:
                    yield from grams()
                    keys, n = keys[:0], n[:0]
        merge()
        yield from out([b"w" + w for w in words] + [b"e"] * bool(ends), [*words.values()] + [ends] * bool(ends))
        yield from grams()

    return docs.select("text", "held").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Table:
    """An open-addressing table of windows with the logarithm of their probability."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, size = U(64 - bits), 1 << bits
        self.slots, self.logs = np.full(size, np.iinfo(U).max), np.zeros(size, np.float32)
        at, todo = ((keys * _MIX) >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[at[todo]] == np.iinfo(U).max]
            self.slots[at[free]] = keys[free]
            won = self.slots[at[todo]] == keys[todo]
            self.logs[at[todo[won]]] = logs[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & (size - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithms, zero for windows that aren't there, and the places of those."""
        out, place, todo, missed = np.zeros(len(keys)), ((keys * _MIX) >> self.shift).astype(np.int64), np.arange(len(keys)), []
        while len(todo):
            found = self.slots[place]
            same, empty = found == keys[todo], found == np.iinfo(U).max
            out[todo[same]] = self.logs[place[same]]
            missed.append(todo[empty])
            more = ~(same | empty)
            todo, place = todo[more], (place[more] + 1) & (len(self.slots) - 1)
        return out, np.concatenate(missed) if missed else todo


def scored(texts: list[bytes], find) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The sum over each text's windows of what ``find`` gives, and (text, windows, counts) of those it hasn't, in blocks."""
    out, waiting, size, missed = np.zeros(len(texts)), [], 0, []

    def add():
        keys = [windows(p) for _, p in waiting]
        owner, keys = np.repeat([i for i, _ in waiting], [*map(len, keys)]), np.concatenate(keys)
        logs, gone = find(keys)
        out[:] += np.bincount(owner, logs, len(texts))
        if len(gone):
            order = gone[np.lexsort((keys[gone], owner[gone]))]
            first = np.flatnonzero(np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (owner[order][1:] != owner[order][:-1])]))
            n, order = np.diff(np.append(first, len(order))), order[first]
            for i in np.unique(owner[order]):
                own = np.flatnonzero(owner[order] == i)
                missed.extend((int(i), keys[order[own[a : a + MISSES]]], n[own[a : a + MISSES]]) for a in range(0, len(own), MISSES))

    for i, text in enumerate(texts):
        for piece in pieces(text):
            waiting.append((i, piece))
            size += len(piece)
            if size >= BLOCK:
                add()
                waiting, size = [], 0
    if waiting:
        add()
    return out, missed


class Trie:
    """Byte contexts of length 0 to ORDER with successors.

    ``keys`` and ``n`` count windows of the longest context, ``short`` and ``short_n`` all those of a context of ``low`` bytes.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, short: np.ndarray, short_n: np.ndarray, low: int = ORDER - 1):
        levels = range(ORDER + 1)
        self.keys, self.n, self.ctx, self.total, self.kinds = ([None for _ in levels] for _ in range(5))
        own = {ORDER: summed(keys.astype(U), n.astype(np.int64)), low: summed(short.astype(U), short_n.astype(np.int64))}
        for order in reversed(levels):
            if order not in own:
                longer, counted = own[order + 1]
                own[order] = summed(longer & U((1 << 8 * (order + 1)) - 1), counted)
            self.keys[order], self.n[order] = keys, n = own[order]
            before = keys >> U(8)
            first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(keys) else np.zeros(0, np.int64)
            self.ctx[order] = before[first]
            self.total[order] = np.add.reduceat(n, first) if len(first) else n[:0]
            self.kinds[order] = np.diff(np.append(first, len(keys)))
        # for each context, what is left of the next shorter one once its symbols are excluded
        self.left_n, self.left_kinds = [None] * (ORDER + 1), [None] * (ORDER + 1)
        for order in levels[1:]:
            at = np.searchsorted(self.keys[order - 1], self.keys[order] & U((1 << 8 * order) - 1))
            owner = np.searchsorted(self.ctx[order], self.keys[order] >> U(8))
            gone = np.bincount(owner, self.n[order - 1][at], len(self.ctx[order])) if len(owner) else np.zeros(0)
            above = np.searchsorted(self.ctx[order - 1], self.ctx[order] & U((1 << 8 * (order - 1)) - 1))
            self.left_n[order] = self.total[order - 1][above] - gone
            self.left_kinds[order] = self.kinds[order - 1][above] - self.kinds[order]
        keys = self.keys[ORDER]
        owner = np.searchsorted(self.ctx[ORDER], keys >> U(8))
        logs = np.log10(self.n[ORDER] / (self.total[ORDER][owner] + self.kinds[ORDER][owner])) if len(keys) else np.zeros(0)
        self.table = Table(keys, logs)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last byte after the others."""
        out, every = self.table.find(keys)
        if len(every):
            out[every] = self._escaped(keys[every])
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        """The same for windows that the longest context hasn't seen."""

        def find(table, values):
            at = np.minimum(np.searchsorted(table, values), max(0, len(table) - 1))
            return at, (table[at] == values) if len(table) else np.zeros(len(values), bool)

        out, live = np.zeros(len(keys)), np.ones(len(keys), bool)
        above, known = find(self.ctx[ORDER], keys >> U(8))
        with np.errstate(divide="ignore", invalid="ignore"):
            if len(self.ctx[ORDER]):
                out += np.where(known, np.log10(self.kinds[ORDER][above] / (self.total[ORDER][above] + self.kinds[ORDER][above])), 0.0)
            for order in reversed(range(ORDER)):
                if not len(self.ctx[order]):
                    continue
                key = keys & U((1 << 8 * (order + 1)) - 1)
                here, there = find(self.ctx[order], key >> U(8))
                n, kinds = self.total[order][here].astype(float), self.kinds[order][here].astype(float)
                if len(self.ctx[order + 1]):
                    n, kinds = np.where(known, self.left_n[order + 1][above], n), np.where(known, self.left_kinds[order + 1][above], kinds)
                use = live & there & (kinds > 0)
                at, seen = find(self.keys[order], key)
                done, escape = use & seen, use & ~seen
                out[done] += np.log10(self.n[order][at[done]] / (n[done] + kinds[done]))
                out[escape] += np.log10(kinds[escape] / (n[escape] + kinds[escape]))
                live &= ~done
                above, known = here, there
        out[live] -= np.log10(max(1, 256 - len(self.keys[0])))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text and its end."""
        return scored(texts, lambda keys: (self(keys), np.zeros(0, np.int64)))[0]


def logs(grams: DataFrame) -> DataFrame:
    """key, n, log: each counted window and log10 of the probability of its last byte after the others."""
    number = lambda first, n: F.conv(F.hex(F.substring("token", first, n)), 16, 10).cast("long")
    every = grams.select(number(2, ORDER + 1).alias("key"), "n")
    short = every.filter("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (LOW + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    low = grams.sparkSession.sparkContext.broadcast(tuple(short[c].to_numpy() for c in ("key", "n")))

    def run(batches):
        def out(keys, n):
            seen = n > 0
            found = Trie(keys[seen], n[seen], *low.value, low=LOW)(keys.astype(U))
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (keys, n, found)], names=["key", "n", "log"])

        waiting, size = [], 0
        for batch in batches:
            waiting.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            size += batch.num_rows
            if size >= PIECE:
                keys, n = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
                place = (keys >> 8) & 0xFFFFFF
                last = int(np.searchsorted(place, place[-1]))  # the last context may go on
                if last:
                    yield from out(keys[:last], n[:last])
                waiting = [(keys[last:], n[last:])]
                size = len(keys) - last
        if size:
            yield from out(*(np.concatenate([w[i] for w in waiting]) for i in (0, 1)))

    context = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF))
    return every.repartition(context).sortWithinPartitions(context).mapInArrow(run, "key long, n long, log double")


def score(docs: DataFrame, modulus: int = 10, frequent: int = FREQUENT, nodes: int = NODES) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    held = remainder(F.col("doc_id"), modulus) == 0
    table = cut(counts(docs.withColumn("held", held)))
    is_gram = F.substring("token", 1, 1) == F.lit(b"g")
    words = table.filter(~is_gram)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    grams = cut(logs(table.filter(is_gram)))
    sizes = {r.b: r["count"] for r in grams.groupBy(F.floor(F.log2(F.greatest("n", F.lit(0.5)))).alias("b")).count().collect()}
    least = next((b for b in range(-1, 64) if sum(n for k, n in sizes.items() if k >= b) <= nodes), 64)
    often = F.col("n") >= (0 if least < 0 else 1 << least)
    whole, kept = least < 0, grams.filter(often).select("key", "log").toArrow()
    model = spark.sparkContext.broadcast(Table(kept["key"].to_numpy().astype(U), kept["log"].to_numpy()))
    top = words.orderBy(F.desc("n"), "token").limit(frequent).toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top["token"].to_pylist(), top["n"].to_pylist(), strict=True)))
    ends, every = known.value.get(b"e", 0), total.v <= frequent
    fixed = float(np.log10(total.n + 0.1 * (total.v + 1)))

    def run(batches):
        table, made = {w[1:]: (c, float(np.log10(c + 0.1))) for w, c in known.value.items() if w != b"e"}, TaskContext.get().partitionId() << 33
        zero = float(np.log10(0.1))
        for batch in batches:
            texts = [lowered(t) for t in batch.column(1).to_pylist()]
            cols = [[] for _ in range(6)]
            for text in texts:
                own = Counter(text.split())
                total_words, n_known, sum_logs, rare, rare_n = 0, 1 if ends else 0, float(np.log10(ends + 0.1)), [], []
                for word, n in own.items():
                    total_words += n
                    if word in table:
                        n_known += n
                        sum_logs += n * table[word][1]
                    elif every:
                        sum_logs += n * zero
                    else:
                        rare.append(b"w" + word)
                        rare_n.append(n)
                for col, value in zip(cols, (made, total_words + 1, n_known, sum_logs, rare, rare_n), strict=True):
                    col.append(value)
                made += 1
            kinds, none = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())], [None] * len(texts)
            sums, missed = scored(texts, model.value.find)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(sums), pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.list_(pa.int64()))], names=names)
            for i, keys, n in missed:  # further rows of a text, with its rare windows
                own = [pa.nulls(1, batch.schema.field(0).type), pa.array([cols[0][i]], pa.int64()), *(pa.nulls(1, k) for k in kinds[1:]), pa.nulls(1, pa.float64())]
                yield pa.RecordBatch.from_arrays([*own, pa.array([keys.astype(np.int64)], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64()))], names=names)

    names = ["doc_id", "uid", "n_tokens", "n_known", "logs", "rare", "rare_n", "score", "gone", "gone_n"]
    rows = docs.mapInArrow(run, f"doc_id {kind}, uid long, n_tokens long, n_known long, logs double, rare array<binary>, rare_n array<int>, score double, gone array<long>, gone_n array<long>")
    rows = rows if every and whole else cut(rows)
    joined = rows.filter("gone is null").drop("gone", "gone_n")
    if not whole:
        gone = rows.filter("gone is not null").select("uid", F.explode(F.arrays_zip("gone", "gone_n")).alias("x")).select("uid", F.col("x.gone").alias("key"), F.col("x.gone_n").alias("m"))
        more = gone.join(grams.filter(~often).select("key", "log"), "key").groupBy("uid").agg(F.sum(F.col("m") * F.col("log")).alias("more_score"))
        joined = joined.join(more, "uid", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0))).drop("more_score")
    if not every:
        rare = joined.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("uid", F.col("x.rare").alias("token"), F.col("x.rare_n").alias("m"))
        found = rare.join(words, "token", "left")
        more = found.groupBy("uid").agg(F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("more_known"))
        joined = joined.drop("rare", "rare_n").join(more, "uid", "left")
        joined = joined.withColumns({"logs": F.col("logs") + F.coalesce("more_logs", F.lit(0.0)), "n_known": F.col("n_known") + F.coalesce("more_known", F.lit(0))})
    return joined.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(total.n)).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(fixed)).alias("base_score"), "score")
