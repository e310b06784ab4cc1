"""Quality classifier: logistic regression on hashed word n-grams.

Tokens are runs of alphanumerics or of other visible characters, lower-cased (A-Z).
Features are hashed into 2**BITS weights: words, pairs of consecutive words, and
single and paired word shapes (kind, first bytes' case, whether the word repeats the
one before).  A feature's value is its share of the text's tokens times SCALE.

Training: follow-the-regularised-leader (proximal, per-coordinate rates) on the
driver over at most ``max_rows`` labelled documents, those of least hash of doc_id, as
many of them in that order as have features of at most ``max_bytes`` together (both
documented bounds; features, not texts, are collected).  Of rows that share a doc_id
the text of the least hash counts.  Scoring: one map pass, the sigmoid of a sparse dot
product with weights of a fixed size (2**BITS floats).

Scores are cut at THRESHOLD.  Rows whose crc32(doc_id as text) mod FOLDS is 0 are held
out of training.  labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts have no feature and get the intercept's score;
a null doc_id is never a training row and not held out; several labels of one doc_id
count as the greatest; an empty training set scores 0.5 throughout; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, written
from sparkloom.llm.kernels import LOWER, TOKENS, Words, mix64, seeds, slices, string_buffers

BITS = 20
SCALE = 8.0
MAX_ROWS, MAX_BYTES = 5000, 128 << 20
EPOCHS = 3
FOLDS = 5
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.01


def features(words: Words, raw: np.ndarray, member: np.ndarray = TOKENS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and weight index of every n-gram of a slice."""
    h, row, n = words.hash, words.row(), len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = seeds(6, 900)
    first = raw[words.start]
    second = raw[np.minimum(words.start + 1, words.end - 1)]
    repeat = np.zeros(n, bool)
    repeat[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shape = (member[first] - 1) + 2 * (LOWER[first] != first) + 4 * (LOWER[second] != second) + 8 * repeat
    shape = shape.astype(np.uint64)
    pair = row[1:] == row[:-1]
    one = mix64(h * s[0])
    two = mix64(h[:-1] * s[1] + h[1:] * s[2])[pair]
    flat = mix64((shape + np.uint64(1)) * s[3])
    flat2 = mix64((shape[:-1] + np.uint64(1)) * s[4] + (shape[1:] + np.uint64(1)) * s[5])[pair]
    rows = np.concatenate([row, row[1:][pair], row, row[1:][pair]])
    return rows, (np.concatenate([one, two, flat, flat2]) >> np.uint64(64 - bits)).astype(np.int64)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = string_buffers(batch.column(2))
        for lo, hi in slices(offsets):
            words = Words(raw, offsets, lo, hi, TOKENS)
            row, index = features(words, raw)
            order = np.argsort(row, kind="stable")
            index, ends = index[order], np.searchsorted(row[order], np.arange(hi - lo + 1))
            idx, val = [], []
            for i in range(hi - lo):
                own, count = np.unique(index[ends[i] : ends[i + 1]], return_counts=True)
                idx.append(own.astype(np.int32).tobytes())
                val.append((SCALE * count / max(1, words.count[i])).astype(np.float32).tobytes())
            held = [batch.column(i).slice(lo, hi - lo) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["id", "label", "idx", "val"])


class Ftrl:
    """Proximal follow-the-regularised-leader for logistic loss; index 2**bits is the intercept."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, idx: np.ndarray, val: np.ndarray, label: float) -> None:
        w = self.weights(idx)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ val, -35, 35)))
        g = (p - label) * val
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> list:
    """label, idx, val of the chosen documents, in the order of the hash of their ids."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
        .groupBy(F.col("doc_id").cast("bigint").alias("__id"))
        .agg(F.max("quality").cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").cast("bigint") == F.col("__id"))
    # one text for each id, taken before any is shuffled; then at most max_rows of them
    one = rows.groupBy("__id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("__label").alias("label"))
    held = written(one.select("__id", "label", "text").mapInArrow(_featurise, "id bigint, label int, idx binary, val binary"), "features")
    held_at = held.withColumn("place", F.xxhash64("id"))
    size = (F.octet_length("idx") + F.octet_length("val")).alias("size")
    total, last = 0, None
    for r in sorted(held_at.select("place", "id", size).collect()):
        total += r["size"]
        if total > max_bytes:
            break
        last = r
    upto = [] if last is None else held_at.where((F.col("place") < last["place"]) | (F.col("place") == last["place"]) & (F.col("id") <= last["id"])).collect()
    discard(held)
    return sorted(upto, key=lambda r: (r["place"], r["id"]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """Weights, the intercept last."""
    held = training_rows(docs, labels, max_rows, max_bytes)
    model, top, one = Ftrl(), np.array([1 << BITS]), np.ones(1)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(held)):
            r = held[i]  # features are read in place: nothing of them is copied for all rows
            model.learn(np.r_[np.frombuffer(r["idx"], np.int32), top], np.r_[np.frombuffer(r["val"], np.float32), one], float(r["label"]))
    return model.weights().astype(np.float32)


def _score_batch(batch_text: pa.Array, weights: np.ndarray) -> np.ndarray:
    raw, offsets = string_buffers(batch_text)
    out = np.empty(len(batch_text))
    for lo, hi in slices(offsets, 2 << 20):
        words = Words(raw, offsets, lo, hi, TOKENS)
        row, index = features(words, raw)
        total = np.bincount(row, weights[index], minlength=hi - lo) if len(row) else np.zeros(hi - lo)
        dot = SCALE * total / np.maximum(1, words.count) + float(weights[-1])
        out[lo:hi] = 1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35)))
    return out


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _score_batch(batch.column(2), weights)
            columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(kernel, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs without the rows predicted 0."""
    at = docs.columns.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score_batch(batch.column(at), weights) >= THRESHOLD))

    return docs.mapInArrow(kernel, docs.schema)
