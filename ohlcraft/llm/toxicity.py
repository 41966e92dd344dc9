"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are counts of hashed character n-grams of the lower-cased text. From labelled texts come, per n-gram, the
documents of either class that hold it; the log of the ratio of its smoothed shares scales the feature, and a logistic
regression with an L2 penalty learns weights for the scaled features. Each text's scaled counts are divided by their
Euclidean length, so that a score follows what a text is made of and not how long it is: a text repeated any number of
times scores as it does once. The model is two arrays of ``BUCKETS`` numbers whatever the corpus.

The fit reads at most about ``SAMPLE`` labelled rows, drawn by a hash of the id (all of them where there are fewer), whole
texts, none of them held out. Scoring reads every whole text in one pass without a shuffle.

Nulls: a null text scores like an empty one, which gets the score of the intercept; null ids are never held out; null
labels aren't learned from. Repeated rows count as often as they occur. Without labelled rows of both classes the score is
the smoothed share of label 1. An empty table gives an empty result. A very long text is scored whole. Other columns may have any
name; ``clean`` returns them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import COUNTS, map_rows, packed_counts, release, staged, summed_counts, text_of

ORDERS = (3, 4, 5)
BITS = 18
BUCKETS = 1 << BITS
SAMPLE = 24_000
#: N-grams that tell the classes apart best take part in the regression.
FEATURES = 1024
SMOOTHING = 1.0
PENALTY = 1e-4
ROUNDS = 150
THRESHOLD = 0.5
FOLDS = 5
_SEGMENT = 4096


def held_out(column: str = "doc_id") -> Column:
    """Rows that no fit may read: checksum of the id as text, modulo ``FOLDS``, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % FOLDS == 0, F.lit(False))


def ngrams(text: str) -> np.ndarray:
    """Buckets of all n-grams of a text, in order of place, with repeats."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x9E3779B1) + c[n - 1 :]
        if n in ORDERS:
            x = h ^ (h >> np.uint32(15))
            x *= np.uint32(0x85EBCA6B)
            out.append(x >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def features(found: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of ``found`` and their counts, scaled and of Euclidean length 1."""
    index, count = np.unique(found, return_counts=True)
    value = count * scale[index]
    return index, value / (np.linalg.norm(value) or 1.0)


@dataclass
class Model:
    weights: np.ndarray
    scale: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        found = ngrams(text)
        index, value = features(found[self.scale[found] != 0], self.scale)
        z = self.intercept + float(self.weights[index] @ value)
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """text and label of the labelled rows that the fit may read. The drawn ids are bounded by ``sample`` and are broadcast."""
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label"))
    n = usable.count()
    if n > sample:
        usable = usable.filter(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(n)) < sample)
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(usable), "doc_id").select("text", "label")


def _class_counts(rows: DataFrame) -> np.ndarray:
    """Documents of class 0 and 1 that hold each n-gram, and all documents, as one array."""

    def count(batches):
        total = np.zeros(2 * BUCKETS + _SEGMENT, np.int64)  # the documents of either class come last
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[label * BUCKETS + np.unique(ngrams(text))] += 1
                total[2 * BUCKETS + label] += 1
        if total.any():
            yield packed_counts(total, _SEGMENT)
        batch = None
        release()

    rows = rows.select("text", "label")
    total = summed_counts(rows.mapInArrow(count, COUNTS), 2 * BUCKETS + 2, _SEGMENT, rows.rdd.getNumPartitions())
    return np.concatenate([total[2 * BUCKETS :].reshape(2, 1), total[: 2 * BUCKETS].reshape(2, -1)], axis=1)


def _logistic(indptr: np.ndarray, index: np.ndarray, value: np.ndarray, k: int, y: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent with restarts on rows of values of ``k`` features."""
    n = len(y)
    row = np.repeat(np.arange(n), np.diff(indptr))

    def margin(w, b):
        return np.bincount(row, value * w[index], n) + b

    def gradient(w, b):
        g = 1 / (1 + np.exp(-np.clip(margin(w, b), -50, 50))) - y
        return np.bincount(index, value * g[row], k) / n + penalty * w, g.mean()

    def loss(w, b):
        z = margin(w, b)
        return float((np.logaddexp(0, z) - y * z).mean() + penalty / 2 * (w @ w))

    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    v, c, t, best, step = w, b, 1.0, loss(w, b), 1.0
    for _ in range(rounds):
        gw, gb = gradient(v, c)
        at, square = loss(v, c), gw @ gw + gb * gb
        if square < 1e-12:
            break
        while step > 1e-8 and (now := loss(v - step * gw, c - step * gb)) > at - step / 2 * square:
            step /= 2
        w1, b1 = v - step * gw, c - step * gb
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2 if now <= best else 1.0
        v, c = (w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)) if now <= best else (w1, b1)
        w, b, t, best, step = w1, b1, t1, now, step * 1.3
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    rows = staged(training_rows(docs, labels, label, sample), "toxicity-sample")
    counts = _class_counts(rows)
    docs_of, held = counts[:, 0].astype(float), counts[:, 1:].astype(float)
    if not docs_of.all():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), float(np.log((docs_of[1] + SMOOTHING) / (docs_of[0] + SMOOTHING))))
    share = (held + SMOOTHING) / (docs_of + 2 * SMOOTHING)[:, None]
    ratio = np.log(share[1] / share[0])
    # how far the observed number of class-1 documents is from what independence would give, in standard deviations
    total, p = held.sum(0), docs_of[1] / docs_of.sum()
    spread = np.sqrt(total * p * (1 - p) * np.maximum(1 - total / docs_of.sum(), 1e-9)) + 1
    chosen = np.sort(np.argsort(-np.abs(held[1] - total * p) / spread, kind="stable")[:FEATURES])
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    sent = docs.sparkSession.sparkContext.broadcast((place, ratio[chosen]))

    def make():
        at, scale = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [at[ngrams(t)] for t in batch.column(0).to_pylist()]
            rows = [features(f[f >= 0], scale) for f in found]
            index = pa.array([i.astype(np.uint16).tobytes() for i, _ in rows], pa.binary())
            value = pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())
            return pa.RecordBatch.from_arrays([index, value, batch.column(1)], names=["index", "value", "label"])

        return step

    kept = map_rows(rows, make, "index binary, value binary, label int").collect()  # of the bounded sample
    kept.sort(key=lambda r: (r.label, bytes(r["index"]), bytes(r.value)))
    index = np.frombuffer(b"".join(r["index"] for r in kept), np.uint16).astype(np.int64)
    value = np.frombuffer(b"".join(r.value for r in kept), np.float32).astype(float)
    indptr = np.concatenate([[0], np.cumsum([len(r["index"]) // 2 for r in kept])])
    w, b = _logistic(indptr, index, value, len(chosen), np.array([r.label for r in kept], float), PENALTY, ROUNDS)
    weights, scale = np.zeros(BUCKETS), np.zeros(BUCKETS)
    weights[chosen], scale[chosen] = w, ratio[chosen]
    return Model(weights, scale, b)


def with_score(docs: DataFrame, model: Model, columns: list[str], name: str = "score") -> DataFrame:
    """``columns`` of every document and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(text_of().alias("score_text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(columns)])

    def make():
        score = sent.value.score

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = pa.array([score(t) for t in batch.column(0).to_pylist()], pa.float64())
            return pa.RecordBatch.from_arrays([*batch.columns[1:], scores], names=[*batch.schema.names[1:], name])

        return step

    schema = rows.drop("score_text").withColumn(name, F.lit(0.0)).schema
    return map_rows(rows, make, schema).select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(columns)], F.col(name))


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    scored = with_score(docs, fit(docs, labels, sample=sample), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    own = docs.columns
    kept = with_score(docs, fit(docs, labels, sample=sample), own, "__toxicity")
    return kept.filter(F.col("__toxicity") < threshold).select(*own)
