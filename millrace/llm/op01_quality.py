"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Every word gives two tokens: a bucket of its hash, and its shape (length, capitals, kind of last
character, whether it repeats the word before).  Each token has a sparse random index
vector; its word vector adds the index vectors of the tokens around it in the fitting
sample.  A document is the mean word vector of its tokens.  The network is fitted on the driver
on at most ``FIT_ROWS`` labelled documents (those whose ids hash lowest), a fifth of which
sets the temperature of the probabilities.

Only labels whose ``crc32(doc_id as text) % 3`` is not 1 are learned from; id, language,
source and label are never inputs of a score.

Edge cases: a null or empty text has the zero vector and is scored like any other, a very long one by all its words;
other columns are not read; texts that tie score alike.  Ids labelled both ways
are left out of the fit; without usable labels of both classes every score is the share of
label 1 (0.5 without any).  Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.words import lowered, words

#: Most labelled documents that the classifier is fitted on.
FIT_ROWS = 20_000
SHAPES, BUCKETS, DIMS, NONZERO, HIDDEN = 2048, 2048, 96, 6, 32
SPAN = 2
FOLDS, HELD = 3, 1
#: Tasks that gather word vectors; each sends one matrix to the driver.
GATHER_TASKS = 8

_KIND = np.zeros(256, np.int64)  # of a word's last byte
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".;:", ",", "!?", "#*$%&|<>"), 1):
    _KIND[list(_chars.encode())] = _k
_IS_LOWER = (_KIND == 1) | (np.arange(256) >= 0x80)


def index_vectors() -> np.ndarray:
    """A sparse random vector of +1 and -1 for every token."""
    draw = np.random.default_rng(77)
    out = np.zeros((SHAPES + BUCKETS, DIMS), np.float32)
    for row in out:
        row[draw.choice(DIMS, NONZERO, replace=False)] = draw.choice([-1.0, 1.0], NONZERO)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape token and bucket token of every word, and each row's first word."""
    found = words(lowered(data), offsets)
    start, end = found.start, found.end
    lower = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_IS_LOWER[data], out=lower[1:])
    size = np.minimum(end - start, 15)
    none_lower = lower[end] == lower[start]
    again = np.zeros(len(size), bool)
    again[1:] = found.hash[1:] == found.hash[:-1]
    again[found.first[:-1][found.first[:-1] < len(again)]] = False
    capital = _KIND[data[start]] == 2
    shape = size | none_lower.astype(np.int64) << 4 | capital.astype(np.int64) << 5 | again.astype(np.int64) << 6 | _KIND[data[end - 1]] << 7
    return shape, SHAPES + (found.hash >> np.uint64(40)).astype(np.int64) % BUCKETS, found.first


def gathered(column: pa.Array, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token the sum of index vectors around it in a column of texts, and how many they are."""
    n = SHAPES + BUCKETS
    total, count = np.zeros((n, DIMS), np.float64), np.zeros(n, np.int64)
    data, offsets = common.text_buffers(column)
    for lo, hi in common.slices(offsets):
        shape, bucket, first = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        for step in range(1, SPAN + 1):
            same = row[step:] == row[:-step]
            for left, right in ((shape, shape), (bucket, shape), (bucket, bucket)):
                pairs, times = np.unique(np.concatenate([left[:-step][same] * n + right[step:][same], left[step:][same] * n + right[:-step][same]]), return_counts=True)
                np.add.at(total, pairs // n, index[pairs % n] * times[:, None])
                np.add.at(count, pairs // n, times)
    return total, count


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text, and its log length."""
    data, offsets = common.text_buffers(column)
    out = np.zeros((len(column), vectors.shape[1] + 1), np.float32)
    n = len(vectors)
    for lo, hi in common.slices(offsets):
        shape, bucket, first = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        size = np.diff(first)
        for a in range(0, hi - lo, 256):  # bounds the count matrix
            b = min(a + 256, hi - lo)
            words_of = slice(first[a], first[b])
            row = np.repeat(np.arange(b - a), size[a:b]) * n
            counts = np.bincount(np.concatenate([row + shape[words_of], row + bucket[words_of]]), minlength=(b - a) * n)
            counts = counts.reshape(b - a, n).astype(np.float32) / np.maximum(size[a:b], 1)[:, None]
            out[lo + a : lo + b, :-1] = counts @ vectors
        out[lo:hi, -1] = np.log1p(size)
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer, a logit divided by ``temperature``."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(np.float64) / self.temperature, -30, 30)))


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, -logit * (2 * y - 1))))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 2e-3, decay: float = 1e-4) -> Network:
    """Adam on the logistic loss over rows that are not ``held``; those set the temperature."""
    if len(np.unique(y)) < 2:
        prior = float(y.mean()) if len(y) else 0.5
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        d = x.shape[1]
        return Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))))
    draw = np.random.default_rng(5)
    own = ~held if len(np.unique(y[~held])) == 2 else np.ones(len(y), bool)
    a, b = x[own].astype(np.float64), y[own].astype(np.float64)
    d = a.shape[1]
    net = Network(a.mean(0), a.std(0) + 1e-6, draw.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    a = (a - net.mean) / net.scale
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    moment, square, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    epochs = max(epochs, -(-2000 * batch // len(b)) if len(b) < 2000 else epochs)
    for epoch in range(epochs):
        order = draw.permutation(len(b))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            z = a[some] @ values[0] + values[1]
            h = np.maximum(z, 0)
            error = (1 / (1 + np.exp(-(h @ values[2] + values[3][0]))) - b[some]) / len(some)
            back = np.outer(error, values[2]) * (z > 0)
            slopes = [a[some].T @ back + decay * values[0], back.sum(0), h.T @ error + decay * values[2], np.array([error.sum()])]
            step += 1
            pace = rate * (1 - epoch / epochs) + 1e-5
            for v, m, s, g in zip(values, moment, square, slopes):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if held.any() and own.sum() < len(y):
        logit, truth = net.logit(x[held].astype(np.float64)), y[held].astype(np.float64)
        net.temperature = float(min(np.geomspace(0.5, 8, 60), key=lambda t: _loss(logit / t, truth)))
    return net


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fitting_sample(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, quality of at most ``most`` labelled ids outside the held-out fold, those that hash lowest."""
    known = (
        labels.filter((fold(F.col("doc_id")) != HELD) & F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("__most"))
        .filter(F.col("quality") == F.col("__most"))
        .drop("__most")
        .withColumn("__at", F.xxhash64("doc_id"))
        .orderBy("__at", "doc_id")
        .limit(most)
        .drop("__at")
    )
    # At most ``most`` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def train(sample: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors and network from a bounded sample."""
    index = index_vectors()
    n = SHAPES + BUCKETS

    def gather(batches):
        total, count = np.zeros((n, DIMS)), np.zeros(n, np.int64)
        for batch in batches:
            t, c = gathered(batch.column(0), index)
            total += t
            count += c
        yield pa.RecordBatch.from_pydict({"total": [total.astype(np.float32).tobytes()], "count": [count.tobytes()]})

    total, count = np.zeros((n, DIMS)), np.zeros(n)
    for r in sample.select("text").coalesce(GATHER_TASKS).mapInArrow(gather, "total binary, count binary").collect():
        total += np.frombuffer(r["total"], np.float32).reshape(n, DIMS)
        count += np.frombuffer(r["count"], np.int64)
    vectors = (index + total / np.maximum(count, 1)[:, None]).astype(np.float32)

    def pool(batches):
        for batch in batches:
            found = pooled(batch.column(1), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in found], pa.binary())], ["doc_id", "quality", "vector"])

    rows = sample.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(pool, "doc_id bigint, quality int, vector binary")
    # Of rows that share an id one text is learned from, the same in every run.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("vector", "quality")).alias("one")).select("doc_id", "one.*").orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r["vector"], np.float32) for r in rows], np.float32).reshape(len(rows), DIMS + 1)
    y = np.array([r["quality"] for r in rows], np.int64)
    held = np.array([(r["doc_id"] * 0x9E3779B97F4A7C15 >> 32) % 5 == 0 for r in rows], bool)
    return vectors, fit(x, y, held)


def scored(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.  No shuffle; the model is a few MB."""

    def score(batches):
        for batch in batches:
            s = net.score(pooled(batch.column(1), vectors))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD, F.lit(False)).alias("held_out"), "score", "predicted")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = common.written(fitting_sample(docs, labels), "quality-sample")
    return scored(docs, *train(sample))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLES: dict[str, str] = {}
