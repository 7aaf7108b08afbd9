"""Vector bin packing into training sequences (operator 8).

An item asks for tokens, segments (one) and loss-bearing tokens; a sequence bounds all three.
``Packer`` keeps a bounded pool of items and fills one sequence at a time with the item that fits
and has the largest dot product of its demand with the room left, both as shares of the limits.
With ``cut`` the item that no longer fits is cut at the room left and its rest goes back to the
pool, so a sequence is full unless segments or loss-bearing tokens run out first; then it is cut to
the largest power of two.  What is left at the end of a partition is dealt into sequences whose
lengths are powers of two, so that nothing is padded.  Without ``cut`` items stay whole and
sequences are padded.

A partition is packed by one task in one pass over its rows with at most ``POOL`` pending pieces,
so memory doesn't grow with the input, nothing is shuffled, and a task that runs again on the
same partition makes the same sequences.  Sequence ids are partition * 2 ** 33 + a running number.

Defined results: a null text is empty, and its document is the single separator; empty tables give
no rows; repeated rows and null ids are documents of their own; other columns are ignored.
"""

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.llm.common import released

TOKENS, SEGMENTS, LOSS, POOL = 1024, 64, 1024, 512
SEPARATOR, BLOCK = 0, 1 << 20


class Packer:
    """Greedy dot-product vector packing of items (key, start, tokens, loss flags or None) into sequences."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, cut: bool = True, pool: int = POOL):
        self.limits, self.cut, self.pool = np.array([tokens, segments, loss], float), cut, pool
        self.items: list[tuple] = []
        self.need = np.zeros((2 * pool + 8, 3))

    def _put(self, key, start: int, n: int, loss: np.ndarray) -> None:
        if n:
            if len(self.items) == len(self.need):
                self.need = np.vstack([self.need, np.zeros_like(self.need)])
            self.need[len(self.items)] = n, 1, int(loss.sum())
            self.items.append((key, start, n, loss))

    def _take(self, i: int) -> tuple:
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i] = last
            self.need[i] = self.need[len(self.items)]
        return item

    def add(self, key, loss: np.ndarray) -> Iterator[list[tuple]]:
        """Take an item; ``loss`` flags each of its tokens.  Yields finished sequences of (key, start, n)."""
        top, whole = int(self.limits[0]), 0
        if self.cut:
            while len(loss) - whole >= top and loss[whole : whole + top].sum() <= self.limits[2]:
                yield [(key, whole, top)]
                whole += top
        elif len(loss) > top or loss.sum() > self.limits[2]:
            raise ValueError(f"an item of {len(loss)} tokens, {int(loss.sum())} of them loss-bearing, can't be placed whole")
        self._put(key, whole, len(loss) - whole, loss[whole:])
        while len(self.items) >= self.pool:
            yield from self._fill(last=False)

    def finish(self) -> Iterator[list[tuple]]:
        while self.items:
            yield from self._fill(last=True)

    def _fill(self, last: bool) -> Iterator[list[tuple]]:
        room, pieces = self.limits.copy(), []
        while self.items and room[0] > 0 and room[1] > 0:
            need = self.need[: len(self.items)]
            scores = (need / self.limits) @ (room / self.limits)
            scores[(need > room).any(axis=1)] = -1
            i = int(scores.argmax())
            if scores[i] < 0:
                if not self.cut:
                    break
                i = int((need / self.limits @ (room / self.limits)).argmax())
            key, start, n, loss = self._take(i)
            take = n
            if n > room[0] or loss.sum() > room[2]:
                take = min(n, int(room[0]), int(np.searchsorted(np.cumsum(loss), room[2], "right")))
                self._put(key, start + take, n - take, loss[take:])
            if not take:
                break
            pieces.append((key, start, take, loss[:take]))
            room -= take, 1, int(loss[:take].sum())
        if not self.cut:
            yield [p[:3] for p in pieces]
            return
        total = sum(p[2] for p in pieces)
        if total == int(self.limits[0]):
            yield [p[:3] for p in pieces]
            return
        while total:  # powers of two from the front; before the end only the first, and the rest goes back
            size, got, rest = 1 << (total.bit_length() - 1), [], []
            for key, start, n, loss in pieces:
                take = min(n, size)
                if take:
                    got.append((key, start, take))
                    size -= take
                if n > take:
                    rest.append((key, start + take, n - take, loss[take:]))
            yield got
            pieces, total = rest, sum(p[2] for p in rest)
            if not last or self.items:
                for p in rest:
                    self._put(*p)
                return


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Text to ids as the tokenizer in this file gives them with add_special_tokens=False; the file's merges run in tiktoken, which is faster."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    edge = re.compile(r"(?<=\S)(?=\s)")

    def blocks(text: str) -> Iterator[str]:
        while len(text) > BLOCK:  # a token never reaches over the end of a word into the white space that follows
            m = edge.search(text, BLOCK)
            if not m:
                break
            yield text[: m.start()]
            text = text[m.start() :]
        yield text

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for part in split.split(text) if split and any(s in text for s in special) else (text,):
            if part in special:
                out.append(special[part])
            else:
                for block in blocks(part):
                    out += coder.encode_ordinary(block)
        return out

    return encode


def pack_documents(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, packer, base, made = encoder(tokenizer), Packer(tokens, segments, loss), TaskContext.get().partitionId() << 33, 0
        ids: dict[int, np.ndarray] = {}
        left: dict[int, int] = {}
        names: dict[int, object] = {}
        rows: list[tuple] = []
        done = 0

        def place(sequences):
            nonlocal made
            for pieces in sequences:
                at, total = 0, sum(n for _, _, n in pieces)
                for doc, start, n in pieces:
                    part = ids[doc][start : start + n]
                    rows.append((names[doc], start, n, zlib.crc32(part.tobytes()), len(ids[doc]), base + made, at, total, part))
                    at += n
                    left[doc] -= n
                    if not left[doc]:
                        del ids[doc], left[doc], names[doc]
                made += 1

        def flush():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [arrow_id, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in cols[8]])]).astype(np.int32)
            flat = pa.array(np.concatenate(cols[8]).astype(np.int64))
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols[:8], kinds, strict=True)), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids"])

        arrow_id = pa.int64()
        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.array([*encode(text.as_py() or ""), SEPARATOR], dtype="<u4")
                ids[done], left[done], names[done] = own, len(own), name
                place(packer.add(done, np.ones(len(own), np.int64)))
                done += 1
                if sum(map(lambda r: r[2], rows[-1:])) and len(rows) >= 2000:
                    yield flush()
        place(packer.finish())
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids array<bigint>")


def pack_conversations(turns: DataFrame, tokenizer: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS // 2) -> DataFrame:
    """Instruction data: turns as items, loss on the assistant's tokens, under all three limits.

    A turn is cut where it doesn't fit whole, so each of its ids lies in exactly one piece.  Rows are packed one
    by one, also those that repeat or lack an id; a null role bears no loss, a null text is empty.
    One row for each piece: conv_id, turn, start, length, loss_tokens, turn_tokens, sequence_id, offset.
    """
    kinds = [turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")]
    names = ["conv_id", "turn", "start", "length", "loss_tokens", "turn_tokens", "sequence_id", "offset"]

    def run(batches):
        encode, packer, base, made, n = encoder(tokenizer), Packer(tokens, segments, loss), TaskContext.get().partitionId() << 33, 0, 0
        flags: dict[int, np.ndarray] = {}
        own: dict[int, tuple] = {}
        types = None
        for last, batch in _with_end(batches):
            sequences: list = []
            if batch is not None:
                types = [batch.schema.field(k).type for k in (0, 1)]
                for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    own[n], flags[n] = (conv, turn), np.full(len(encode(text or "")) + 1, int(role == "assistant"), np.int64)
                    sequences += packer.add(n, flags[n])
                    n += 1
            if last:
                sequences += packer.finish()
            rows: list[tuple] = []
            for pieces in sequences:
                at = 0
                for key, start, size in pieces:
                    rows.append((*own[key], start, size, int(flags[key][start : start + size].sum()), len(flags[key]), base + made, at))
                    at += size
                made += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*types, *[pa.int64()] * 6], strict=True)], names=names)
            waiting = {item[0] for item in packer.items}
            flags, own = ({k: v for k, v in d.items() if k in waiting} for d in (flags, own))

    rest = ", ".join(f"{c} long" for c in names[2:])
    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds[0]}, turn {kinds[1]}, {rest}")


def _with_end(batches):
    for batch in batches:
        yield False, batch
    yield True, None
