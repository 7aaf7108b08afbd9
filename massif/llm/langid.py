"""Language identification (operator 2): averaged hashed subword embeddings under a linear softmax.

Subwords are the 2- to 4-byte windows of the lower-cased text whose ASCII non-letters became spaces,
hashed into ``BUCKETS`` rows of a ``DIM``-wide embedding table.  A text is the mean of its rows; a
linear softmax over it gives the language.  Both are trained by stochastic gradient descent in
numpy on at most ``SAMPLE`` labelled texts (an even share for each language, picked by a hash of the
id; whole texts, as subword counts).  A fifth of them is kept for calibration: a temperature by
negative log-likelihood, and the score under which a prediction is rejected, at most ``REFUSE`` of
the calibration texts and never above ``ACCEPT``.

As the mean and the softmax are linear, prediction adds up one row of logits for each window, in
blocks, so memory is bounded for any text.

Defined results: ``und`` with score 0 and rejected for null texts and texts without a letter; if
nothing can be learnt from, every text is ``und``; rows pass through one by one, so repeated rows
and null ids don't matter; other columns are ignored by ``predict`` and kept by ``filter_documents``.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.llm.common import eased, give_back, released, remainder, with_arrow

ORDERS, BUCKETS, DIM, SAMPLE, EPOCHS, RATE, SEED = (2, 3, 4), 1 << 16, 16, 4000, 6, 4.0, 7
REFUSE, ACCEPT, BLOCK = 0.001, 0.5, 1 << 20
PAD = max(ORDERS)
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)


def windows(buffer: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the window that starts at each byte."""
    n = len(buffer) - order + 1
    key = buffer[:n].astype(np.uint32)
    for k in range(1, order):
        key = (key << np.uint32(8)) | buffer[k : k + n]
    return ((key * np.uint32(2654435761) + np.uint32(order * 40503)) >> np.uint32(32 - 16)).astype(np.int32)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    data, total = b" " + normal(text) + b" ", np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), BLOCK):
        part = np.frombuffer(data[at : at + BLOCK + PAD - 1], np.uint8)
        for order in ORDERS:
            if len(part) >= order:
                total += np.bincount(windows(part, order)[:BLOCK], minlength=BUCKETS)
    idx = np.flatnonzero(total)
    return idx.astype(np.int32), total[idx]


def logits(texts: list[str], rows: np.ndarray) -> np.ndarray:
    """The mean of the windows' rows for each text.  The last row must be zeros."""
    out, weight = np.zeros((len(texts), rows.shape[1]), np.float64), np.zeros(len(texts))

    def add(parts: list[tuple[int, bytes, int]]) -> None:
        joined = np.frombuffer(b"".join(p + b"\0" * PAD for _, p, _ in parts), np.uint8)
        starts = np.cumsum([0, *(len(p) + PAD for _, p, _ in parts)])
        own = np.array([i for i, _, _ in parts])
        for order in ORDERS:
            # windows that start in a text's own part and end in it
            ends = np.array([max(0, min(n, len(p) - order + 1)) for _, p, n in parts])
            hashed = np.full(len(joined), BUCKETS, np.int32)
            got = windows(joined, order)
            hashed[: len(got)] = got
            steps = np.zeros(len(joined) + 1, np.int32)
            np.add.at(steps, starts[:-1], 1)
            np.add.at(steps, starts[:-1] + ends, -1)
            hashed[np.cumsum(steps[:-1]) == 0] = BUCKETS
            sums = np.add.reduceat(rows[hashed], starts[:-1], axis=0)
            np.add.at(out, own, sums)
            np.add.at(weight, own, ends)

    waiting: list[tuple[int, bytes, int]] = []
    size = 0
    for i, text in enumerate(texts):
        data = b" " + normal(text) + b" "
        for at in range(0, len(data), BLOCK):
            part = data[at : at + BLOCK + PAD - 1]
            waiting.append((i, part, min(BLOCK, len(data) - at)))
            size += len(part)
            if size >= BLOCK:
                add(waiting)
                waiting, size = [], 0
    if waiting:
        add(waiting)
    return out / np.maximum(weight, 1)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """rows: the logits that each bucket adds; bias; the calibrated temperature; the score below which a text is rejected."""

    def __init__(self, langs: list[str], rows: np.ndarray, bias: np.ndarray, temperature: float = 1.0, floor: float = 0.0):
        self.langs, self.rows, self.bias, self.temperature, self.floor = langs, rows, bias, temperature, floor

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        known = [i for i, t in enumerate(texts) if t is not None and self.langs and any(map(str.isalpha, t))]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            p = softmax((logits([texts[i] for i in known], self.rows) + self.bias) / self.temperature)
            for i, k, s in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                lang[i], score[i] = self.langs[k], float(min(1.0, s))
        return lang, score, [w == "und" or s < self.floor for w, s in zip(lang, score, strict=True)]


def train(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """sample: (language, buckets, counts) of each labelled text."""
    sample = [x for x in sample if len(x[1])]
    langs = sorted({x[0] for x in sample})
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(SEED)
    emb, out, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(langs))), np.zeros(len(langs))
    order = rng.permutation(len(sample))
    held = order[: len(order) // 5]
    learnt = order[len(order) // 5 :] if len(order) >= 5 else order
    steps = EPOCHS * len(learnt)
    for step in range(steps):
        if step % len(learnt) == 0:
            learnt = rng.permutation(learnt)
        lang, idx, n = sample[learnt[step % len(learnt)]]
        rate, share = RATE * (1 - step / steps), (n / n.sum())[:, None]
        mean = (emb[idx] * share).sum(axis=0)
        error = softmax(mean @ out + bias)
        error[langs.index(lang)] -= 1
        back = out @ error
        out -= 0.25 * rate * np.outer(mean, error)
        bias -= 0.01 * rate * error
        emb[idx] -= rate * share * back * DIM
    rows = np.vstack([emb @ out, np.zeros(len(langs))]).astype(np.float32)
    if not len(held):
        return Model(langs, rows, bias)
    z = np.array([(rows[sample[i][1]] * (sample[i][2] / sample[i][2].sum())[:, None]).sum(axis=0) + bias for i in held])
    y = np.array([langs.index(sample[i][0]) for i in held])
    loss = {t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.25, 8, 41)}
    best = min(loss, key=loss.get)
    top = softmax(z / best).max(axis=1)
    return Model(langs, rows, bias, float(best), float(min(ACCEPT, np.quantile(top, REFUSE, method="lower"))))


def learn(docs: DataFrame, modulus: int = 5, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the documents whose crc32 remainder is not 0 and whose language is known."""
    try:
        got = _sample(docs, modulus, sample)
        eased(docs.sparkSession)  # the JVM's copies of it
        return train(got)
    finally:
        give_back()  # the sample is the most that the driver's Python holds


def _sample(docs: DataFrame, modulus: int, sample: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """language, buckets, counts of the texts to learn from."""
    own = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), modulus) != 0))
    sizes = {r.lang: r.n for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    each = max(1, sample // max(1, len(sizes)))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    picked = None
    for lang, n in sizes.items():
        test = (F.col("lang") == lang) & (place < int(1_000_000 * min(1.0, each / n)))
        picked = test if picked is None else picked | test
    if picked is None:
        return []

    def count(batches):
        for batch in batches:
            got = [counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i for i, _ in got], pa.list_(pa.int32())), pa.array([n for _, n in got], pa.list_(pa.int32()))], names=["lang", "idx", "n"])

    got = own.filter(picked).select("lang", "text").mapInArrow(released(count), "lang string, idx array<int>, n array<int>").toArrow()

    def lists(name, kind):  # without a Python object for each number
        for column in got[name].chunks:
            edges, flat = column.offsets.to_numpy(), column.values.to_numpy().astype(kind, copy=False)
            yield from (flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))

    rows = list(zip(got["lang"].to_pylist(), lists("idx", np.int32), lists("n", np.float32), strict=True))
    rows.sort(key=lambda r: (r[0], zlib.crc32(r[1].tobytes() + r[2].tobytes())))  # whatever order the tasks ended in
    return rows


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Append lang_pred, score and rejected; every other column passes through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns):
        lang, score, rejected = shared.value(columns[0])
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    return with_arrow(docs, ["text"], T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]), run)


def identify(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, rejected."""
    made = predict(docs.select("doc_id", "text"), learn(docs, modulus))
    return made.select("doc_id", (remainder(F.col("doc_id"), modulus) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def filter_documents(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """The documents whose language is accepted, with their columns."""
    made = predict(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text")), learn(docs, modulus))
    return made.filter(~F.col("rejected")).select(*(F.col("_row")[c].alias(c) for c in docs.columns))
