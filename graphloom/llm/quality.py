"""Quality classifier: random-indexing word vectors, pooled, and a calibrated two-layer network (operator 4).

Random indexing: each hashed word has a sparse index vector of +1 and -1; a word's context vector is the sum
of its neighbours' index vectors over all documents of the table. Each task counts neighbours and sends one
small matrix; their sum is bounded by BUCKETS * DIMENSIONS whatever the input. A document's features are the
mean of its words' vectors (context direction plus own index vector) with its length, how often a word
repeats the one before, and how few words make up the text. Runs of punctuation are words of their own.

The network is fitted on the driver to at most TRAIN_ROWS labelled documents (the smallest hashes of their
ids); a fifth of them calibrates the temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.sampling import first_by_hash, groups, parts_of, summed
from graphloom.llm.words import PARTED, slices, words

BUCKETS, DIMENSIONS, NONZERO, WINDOW = 2048, 64, 4, 2
TRAIN_ROWS, HIDDEN, STEPS, RATE, DECAY = 20_000, 24, 400, 0.02, 1e-4


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(4)
    out = np.zeros((BUCKETS, DIMENSIONS))
    for row in out:
        row[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def _bucketed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = words(texts, lower=False, kinds=PARTED)
    return (w.hashes >> np.uint64(53)).astype(np.int64), w.doc_at


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sum of context vectors."""
    near = np.zeros(BUCKETS * BUCKETS, np.int32)
    for part in slices(batches):
        bucket, doc_at = _bucketed(part.column("text"))
        doc = np.repeat(np.arange(len(doc_at) - 1), np.diff(doc_at))
        for step in range(1, WINDOW + 1):
            same = doc[step:] == doc[:-step]
            np.add.at(near, bucket[:-step][same] * BUCKETS + bucket[step:][same], 1)
    near = near.reshape(BUCKETS, BUCKETS)
    vectors = (near.astype(np.float64) + near.T) @ index_vectors()
    yield parts_of(vectors)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """BUCKETS * DIMENSIONS: context directions plus own index vectors, learned from every text."""
    context, index = summed(texts, _contexts), index_vectors()
    if context is None:
        return index
    context = context.reshape(BUCKETS, DIMENSIONS)
    return context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1) + 0.5 * index


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    bucket, doc_at = _bucketed(texts)
    lengths, n = np.diff(doc_at), len(doc_at) - 1
    doc = np.repeat(np.arange(n), lengths)
    counts = np.bincount(doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    share = counts / np.maximum(lengths, 1)[:, None]
    again = np.bincount(doc[1:][(bucket[1:] == bucket[:-1]) & (doc[1:] == doc[:-1])], minlength=n) / np.maximum(lengths, 1)
    return np.column_stack([share @ vectors, np.log1p(lengths), again, np.log((share * share).sum(1) + 1e-6)])


@dataclass
class Network:
    """Standardised inputs, tanh units, one logit divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss over four fifths of the rows, then the temperature that suits the last fifth best."""
    rng = np.random.default_rng(44)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    z, t = (x[own] - mean) / scale, y[own]
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        h = np.tanh(z @ params[0] + params[1])
        d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - t) / len(t)
        dh = np.outer(d, params[2]) * (1 - h * h)
        grads = [z.T @ dh + DECAY * params[0], dh.sum(0), h.T @ d + DECAY * params[2], np.array([d.sum()])]
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    if len(held):
        logit, sign = net.logits(x[held]), 2 * y[held] - 1
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda k: np.logaddexp(0, -sign * logit / k).mean()))
    return net


@dataclass
class Classifier:
    """Word vectors and a network; without one (labels of one kind) every text gets the labels' share."""

    vectors: np.ndarray
    network: Network | None
    share: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.network.probability(features(texts, self.vectors)) if self.network else np.full(len(texts), self.share)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Classifier:
    """Word vectors from all texts of docs, the network from at most train_rows labelled ones."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = labels.where(learn).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    sample = first_by_hash(known, "id", train_rows)
    vectors = word_vectors(texts.select("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches):
            x = features(part.column("text"), shared.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "x"])

    # at most train_rows ids of 12 bytes are sent
    rows = texts.join(F.broadcast(sample), "id").mapInArrow(run, "id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r.id, r.label, r.x))
    y = np.array([r.label for r in rows], float)
    net = fit(np.stack([np.frombuffer(bytes(r.x), np.float32) for r in rows]).astype(float), y) if 0 < y.sum() < len(y) else None
    return Classifier(vectors, net, float(y.mean()) if len(y) else 0.5)


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, score, predicted), one row per row of docs: the calibrated probability of label 1, and whether it is at least 0.5.

    labels holds id_col and label_col (0 or 1; other values and nulls are left out, differing labels of one id
    all count); learn, a condition on id_col, says which of its rows to learn from. Only the text feeds a score.
    A null or empty text scores as a text without words. Labels of one kind, or none, give every row that
    label's share, 0.5 without labels. Empty table: empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, learn, id_col, text_col, label_col, train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches):
            p = shared.value.scores(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of docs that score at least least, all columns as they are; judged as they pass, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, learn, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, column=text_col):
            yield part.filter(pa.array(shared.value.scores(part.column(text_col)) >= least))

    return docs.mapInArrow(run, docs.schema)
