"""Benchmark decontamination (operator 5): pigeonhole edit matching.

Texts and items are lower-cased and every run of characters other than letters and digits becomes
one space.  An item of m characters may differ in e = m // EDIT_SHARE edits.  Cut into e + 1 pieces,
an occurrence within e edits has at least one piece unchanged, at most e characters from its place.
All pieces are searched at once (Aho-Corasick), hits are grouped into stretches of the text that
can hold the occurrence, and each stretch is verified by Myers' bit-parallel distance of the item to
its best substring.  An item of fewer than EDIT_SHARE characters may have no edits and is found as whole words only.

The items are the query set: they travel to the tasks in blocks of at most ``BLOCK_CHARS``
characters, one pass over the texts for each block; the texts are never shuffled or cut.

Defined results: null and empty items and texts match nothing; a null item_id is an id like any other; several items with one id are all
searched and the best match of the id is given; of several matches of an item in a document the
best is given, the first of equals; rows that share a doc_id are matched one by one; empty tables
give no rows; other columns are ignored by ``matches`` and kept by ``filter_documents``.
"""

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.llm.common import released

EDIT_SHARE, BLOCK_CHARS = 20, 2_000_000
_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(item: str) -> int:
    return len(item) // EDIT_SHARE


def cut_pieces(item: str) -> list[tuple[int, str]]:
    """Budget plus one pieces, as even as can be, with their places."""
    n = budget(item) + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def letters(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edits between the item and any substring of the text, and where the first such substring ends."""
    every, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = every, 0, m, m, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, i
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & every
        mv = ph & xv & every
    return best, end


class Index:
    """The pieces of a block of items, ready to be searched."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items, self.masks = items, {}
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(items):
            for at, piece in cut_pieces(item):
                owners.setdefault(piece, []).append((k, at))
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()

    def fits(self, k: int, flat: str, place: int) -> bool:
        """Whether a hit can be an occurrence: one of an item that may not be edited begins and ends with words of the text."""
        item = self.items[k][1]
        after = place + len(item)
        return budget(item) > 0 or ((place == 0 or flat[place - 1] == " ") and (after == len(flat) or flat[after] == " "))

    def search(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item id, edits, budget, end in the normal text) of the best match of each item found."""
        if not self.items:
            return []
        flat, starts = normal(text), {}
        for end, (n, own) in self.automaton.iter(flat):
            for k, at in own:
                place = end - n + 1 - at
                if self.fits(k, flat, place):
                    starts.setdefault(k, []).append(place)
        found: dict[object, tuple[int, int, int]] = {}
        for k, places in starts.items():
            name, item = self.items[k]
            m, e = len(item), budget(item)
            if k not in self.masks:
                self.masks[k] = letters(item)
            places.sort()
            low = high = None
            stretches = []
            for p in places:
                a, b = max(0, p - e), min(len(flat), p + m + e)
                if high is not None and a <= high:
                    high = max(high, b)
                else:
                    if high is not None:
                        stretches.append((low, high))
                    low, high = a, b
            stretches.append((low, high))
            for a, b in stretches:
                edits, end = best_match(self.masks[k], m, flat[a:b])
                if edits <= e and (name not in found or (edits, a + end) < (found[name][0], found[name][2])):
                    found[name] = edits, e, a + end
        return [(name, *x) for name, x in sorted(found.items(), key=lambda x: (x[0] is None, x[0]))]


def blocks(benchmark: DataFrame):
    """Bounded blocks of the items' normal texts."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        item = normal(row.text)
        if item:
            block.append((row.item_id, item))
            size += len(item)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    yield block


def _searcher(spark, block):
    shared = spark.sparkContext.broadcast(block)

    def texts(batches_of_texts):
        index = Index(shared.value)
        for batch in batches_of_texts:
            yield batch, index

    return texts


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, budget, match_end: the benchmark items found in each document."""
    spark, out = docs.sparkSession, None
    kind, item_kind = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("item_id", item_kind), *(T.StructField(n, T.LongType()) for n in ("edits", "budget", "match_end"))])
    for block in blocks(benchmark):
        with_index = _searcher(spark, block)

        def run(batches, with_index=with_index):
            for batch, index in with_index(batches):
                rows = [(name, *x) for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in index.search(text)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1]), *(pa.array(c, pa.int64()) for c in cols[2:])], names=schema.fieldNames())

        found = docs.select("doc_id", "text").mapInArrow(released(run), schema)
        out = found if out is None else out.unionByName(found)
    return out


def filter_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns.  Each block filters what the one before left."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for block in blocks(benchmark):
        if block:
            with_index = _searcher(spark, block)

            def run(batches, with_index=with_index):
                for batch, index in with_index(batches):
                    yield batch.filter(pa.array([not index.search(t) for t in batch.column(at).to_pylist()], pa.bool_()))

            docs = docs.mapInArrow(released(run), docs.schema)
    return docs
