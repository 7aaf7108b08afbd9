"""Toxicity severity (operator 9): cumulative-link ordinal regression on sparse word features.

A document's features are its distinct words (lower-cased, ASCII non-letters as spaces), hashed into
``BUCKETS``.  P(grade > k) = sigmoid(w x - theta_k): the weights are shared by all thresholds, which
stay ordered because their differences are exponentials.  Weights are fitted by Adam with an
L1 penalty, so that words that tell nothing weigh nothing and long documents are not
accused for their length.  Only words whose share among toxic documents differs from that among the
others by ``Z`` standard errors take part, and near copies in the sample (equal grade and equal two
smallest hashes of their rarer words) count once, so that the words of a much-copied text are not
mistaken for signs.  The fit uses at most ``SAMPLE`` labelled documents for each grade, picked
by a hash of the id, each whole.  The grade is the number of thresholds that the document probably
exceeds; the expected severity is the sum of their probabilities.

Grades are the values of the labels' ``toxic`` column, 0 for none and up to 15; null is left out.
Of several labels of a document the highest counts.

Defined results: null and empty texts have no features and get the grade of the thresholds alone;
without labels every grade is 0 and the severity 0.0; rows pass one by one, so repeated rows, null
ids and other columns don't matter.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.llm.common import with_arrow

BUCKETS, SAMPLE, STEPS, L1, MIN_DOCS, Z, RARE = 1 << 20, 3000, 500, 1e-4, 4, 5.0, 0.05
_LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def features(text: str | None) -> np.ndarray:
    """The distinct word buckets of a whole text."""
    words = set((text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    return np.unique(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(BUCKETS - 1))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Shared weights by bucket and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def exceed(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        z = np.array([self.weights[features(t)].sum(dtype=np.float64) for t in texts])
        return sigmoid(z[:, None] - self.thresholds[None, :])


def once(rows: list[np.ndarray], grades: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Leave out near copies."""
    seen = np.bincount(np.concatenate(rows).astype(np.int64), minlength=BUCKETS)
    kept: dict[tuple, int] = {}
    for i, row in enumerate(rows):
        rare = row[seen[row] <= max(1, RARE * len(rows))].astype(np.uint64)
        mixed = np.sort((rare * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20))[:2]
        kept.setdefault((int(grades[i]), *mixed.tolist()) if len(mixed) == 2 else (i,), i)
    own = sorted(kept.values())
    return [rows[i] for i in own], grades[own]


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    levels = int(grades.max()) if len(grades) else 0
    if not levels:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(0))
    rows, grades = once(rows, grades)
    flat = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=BUCKETS)
    bad, share = np.bincount(flat[grades[owner] > 0], minlength=BUCKETS), seen / len(rows)
    n1 = max(1, int((grades > 0).sum()))
    n0 = max(1, len(rows) - n1)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    used = np.flatnonzero((seen >= MIN_DOCS) & (np.abs(bad / n1 - (seen - bad) / n0) >= Z * error))
    column = np.full(BUCKETS, -1)
    column[used] = np.arange(len(used))
    keep = column[flat] >= 0
    owner, flat = owner[keep], column[flat[keep]]
    n, m = len(rows), len(used)
    share = np.array([1 / max(1, (grades == g).sum()) for g in grades]) / (levels + 1)  # grades weigh alike
    # weights, the first threshold and the logarithms of the gaps between thresholds
    point = np.concatenate([np.zeros(m), [1.0], np.zeros(levels - 1)])
    mean, square = np.zeros_like(point), np.zeros_like(point)
    for step in range(1, STEPS + 1):
        w, gaps = point[:m], np.exp(point[m + 1 :])
        theta = point[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(owner, w[flat], n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = sigmoid(edge[grades + 1] - z), sigmoid(edge[grades] - z)
        upper, lower = np.where(grades == levels, 1.0, upper), np.where(grades == 0, 0.0, lower)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = share * upper * (1 - upper) / p, share * lower * (1 - lower) / p  # of log p, by either edge
        by_theta = np.array([du[grades == k].sum() - dl[grades == k + 1].sum() for k in range(levels)])
        slope = -np.concatenate([np.bincount(flat, (dl - du)[owner], m), [by_theta.sum()], [by_theta[k:].sum() * gaps[k - 1] for k in range(1, levels)]])
        slope[:m] += L1 * np.sign(w)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        point -= 0.1 * (1 - 0.9 * step / STEPS) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    w, first, gaps = point[:m], point[m], point[m + 1 :]
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return Model(weights, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of labelled documents."""
    graded = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.least(F.greatest(F.max("toxic"), F.lit(0)), F.lit(15)).cast("int").alias("_grade"))
    sizes = {r._grade: r.n for r in graded.groupBy("_grade").agg(F.count("*").alias("n")).orderBy("_grade").limit(16).collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    chosen = None
    for g, n in sizes.items():
        test = (F.col("_grade") == g) & (place < int(1_000_000 * min(1.0, sample / n)))
        chosen = test if chosen is None else chosen | test
    if chosen is None:
        return fit([], np.zeros(0, int))
    picked = F.broadcast(graded.filter(chosen))  # about `sample` rows for each of at most 16 grades

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["grade", "idx"])

    rows = docs.select("doc_id", "text").join(picked, "doc_id").select("_grade", "text").mapInArrow(run, "grade int, idx array<bigint>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["grade"], len(r["idx"]), r["idx"][:8]))
    return fit([np.array(r["idx"], np.int64) for r in rows], np.array([r["grade"] for r in rows], int))


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: doc_id, severity_grade, expected_severity, p_toxic, toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(columns):
        p = shared.value.exceed(columns[0])
        p_toxic = p[:, 0] if p.shape[1] else np.zeros(len(p))
        return [pa.array((p > 0.5).sum(axis=1).astype(np.int32)), pa.array(p.sum(axis=1)), pa.array(p_toxic), pa.array(p_toxic > 0.5)]

    adds = T.StructType([T.StructField("severity_grade", T.IntegerType()), T.StructField("expected_severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    return with_arrow(docs.select("doc_id", "text"), ["text"], adds, run).drop("text")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return grade(docs, learn(docs, labels))
