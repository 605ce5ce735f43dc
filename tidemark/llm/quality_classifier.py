"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features: its different words, and marks of its shape (shares of words with
symbols or in capitals, repetition, length). One weight vector over the hash buckets, shared by all
grades, gives a score; ordered thresholds turn it into P(grade <= k) = sigmoid(threshold_k - score).
That gives the expected grade, and the tail probability P(grade >= wanted) by which texts are selected.

The model is fitted in one task, which returns the weights, on at most ``max_labelled`` rated documents,
those of smallest hash, whatever the size of the corpus: a documented bound. All documents are scored,
over their whole text.

Defined cases: null text is empty and scored by its shape; of rows that repeat a rated id the one with
the smallest features is learned; null or repeated ratings of a document: the lowest non-null rating counts; without ratings, or with one grade only, nothing is known: every
document gets null scores and is kept; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, text_or_empty, tidy

BUCKETS = 1 << 18
SYMBOLS = frozenset(b"#*$%&|<>{}[]=_^~@\\/")
#: Steps into which a share of words is put.
STEPS = (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
LEAST_DOCS = 5


def features(text: bytes) -> np.ndarray:
    """Sorted hash buckets of a text's different words and of its shape."""
    words = text.split()
    lower = text.lower().split()
    n = len(words)
    different = set(lower)
    found = {w.strip(b".,;:!?\"'()") for w in different}
    share = lambda k: sum(k / max(n, 1) > s for s in STEPS)
    marked = sum(1 for w in different if not SYMBOLS.isdisjoint(w))
    shape = [
        b"length:%d" % min(n.bit_length(), 12),
        b"symbols:%d" % sum(marked / max(len(different), 1) > s for s in STEPS),
        b"pipes:%d" % share(words.count(b"|")),
        b"capitals:%d" % share(sum(map(bytes.isupper, words))),
        b"again:%d" % share(sum(map(bytes.__eq__, lower[1:], lower))),
        b"twice:%d" % share(sum(map(bytes.__eq__, lower[4:], lower))),
    ]
    hashes = np.fromiter(map(zlib.crc32, found), np.uint32, len(found)) % (BUCKETS - 1024)
    marks = np.fromiter((BUCKETS - 1024 + zlib.crc32(s) % 1024 for s in shape), np.uint32, len(shape))
    return np.unique(np.concatenate((hashes, marks)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list

    def score(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum())

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for every threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -50, 50)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        g = np.array(self.grades, float)
        return g[0] + self.tails(score) @ np.diff(g)

    def tail(self, score: np.ndarray, wanted: float) -> np.ndarray:
        """P(grade >= wanted)."""
        k = int(np.searchsorted(self.grades, wanted))
        return np.ones(len(score)) if k == 0 else np.zeros(len(score)) if k > len(self.thresholds) else self.tails(score)[:, k - 1]


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 150, rate: float = 0.05, decay: float = 2e-5, sparse: float = 0.0155) -> OrdinalModel | None:
    """Maximum likelihood by Adam on all rows at once. Thresholds are a first one and
    positive steps. Weights bear a penalty of ``sparse`` / sqrt(rows) on their absolute value."""
    levels = sorted(set(grades.tolist()))
    if len(levels) < 2:
        return None
    y = np.searchsorted(levels, grades)
    columns = np.concatenate(rows).astype(np.int64)
    sizes = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    used = np.bincount(columns, minlength=BUCKETS) >= min(LEAST_DOCS, len(rows))
    keep = used[columns]
    known, columns = np.unique(columns[keep], return_inverse=True)
    owner, n = owner[keep], len(rows)
    k = len(levels) - 1
    freq = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / n
    start = np.log(freq / (1 - freq))
    parameters = np.concatenate((np.zeros(len(known)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    w = len(known)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, rounds + 1):
        cuts = parameters[w] + np.concatenate(([0.0], np.cumsum(np.exp(parameters[w + 1 :]))))
        score = np.bincount(owner, parameters[:w][columns], n)
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        upper, lower = sigmoid(edges[y + 1] - score), sigmoid(edges[y] - score)
        upper[y == k], lower[y == 0] = 1.0, 0.0
        p = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_cut = np.bincount(y[y < k], up[y < k], k) - np.bincount(y[y > 0] - 1, low[y > 0], k)
        grad = np.empty_like(parameters)
        grad[:w] = -np.bincount(columns, (low - up)[owner], w) / n + decay * parameters[:w]
        grad[w] = -by_cut.sum() / n
        grad[w + 1 :] = [-by_cut[j:].sum() / n * np.exp(parameters[w + j]) for j in range(1, k)]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        pace = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        parameters -= pace * m / (1 - 0.9**step)
        shrink = np.minimum(pace[:w] * sparse / np.sqrt(n), 0.2)  # an absolute penalty: most words tell nothing
        parameters[:w] = np.sign(parameters[:w]) * np.maximum(np.abs(parameters[:w]) - shrink, 0)
    weights = np.zeros(BUCKETS, np.float32)
    weights[known] = parameters[:w]
    return OrdinalModel(weights, parameters[w] + np.concatenate(([0.0], np.cumsum(np.exp(parameters[w + 1 :])))), levels)


def train(docs: DataFrame, ratings: DataFrame, max_labelled: int = 12_000, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> OrdinalModel | None:
    """Fit on at most ``max_labelled`` rated documents."""
    rated = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("rid")).agg(F.min(grade_col).cast("double").alias("grade"))
    sample = rated.orderBy(F.xxhash64("rid"), "rid").limit(max_labelled)  # a bounded number of rows of two numbers each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [features(t).tobytes() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["rid", "grade", "features"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r, g, f) for b in batches for r, g, f in zip(*(c.to_pylist() for c in b.columns)))
        model = fit([np.frombuffer(f, np.uint32) for _, _, f in rows], np.array([g for _, g, _ in rows])) if rows else None
        if model is not None:
            cells = (model.weights.tobytes(), model.thresholds.tobytes(), np.array(model.grades, float).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["weights", "thresholds", "grades"])

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("did"), text_or_empty(text_col).alias("text"))
    picked = texts.join(F.broadcast(sample), F.col("did") == F.col("rid")).select(F.col("rid").cast("long").alias("rid"), "grade", "text")
    found = picked.mapInArrow(tidy(run), "rid long, grade double, features binary").groupBy("rid").agg(F.min("grade").alias("grade"), F.min("features").alias("features"))
    models = found.select("rid", "grade", "features").coalesce(1).mapInArrow(tidy(fitted), "weights binary, thresholds binary, grades binary").collect()
    if not models:
        return None
    return OrdinalModel(np.frombuffer(models[0].weights, np.float32), np.frombuffer(models[0].thresholds, np.float64), np.frombuffer(models[0].grades, np.float64).tolist())


def scored(docs: DataFrame, model: OrdinalModel | None, wanted: float, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade of ``wanted`` or more), kept (tail_probability >= ``least``)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    if model is None:
        null = F.lit(None).cast("double")
        return texts.select("doc_id", null.alias("expected_grade"), null.alias("tail_probability"), F.lit(True).alias("kept"))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = np.array([m.score(features(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()], float)
            tail = m.tail(s, wanted)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.expected(s)), pa.array(tail), pa.array(tail >= least)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    return texts.mapInArrow(tidy(run), "doc_id long, expected_grade double, tail_probability double, kept boolean")


def accepted(docs: DataFrame, model: OrdinalModel | None, wanted: float, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the model accepts, all columns, without a join."""
    if model is None:
        return docs
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = np.array([m.score(features(t or b"")) for t in batch.column(place).cast(pa.binary()).to_pylist()], float)
            yield batch.filter(pa.array(m.tail(s, wanted) >= least))

    return docs.mapInArrow(tidy(run), docs.schema)


def grades(labels: DataFrame) -> DataFrame:
    """Ratings of the labels table: 0 toxic, 1 poor, 2 good; null if a label is missing."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
