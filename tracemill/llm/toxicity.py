"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, pairs of neighbours, pairs with one word between, and the stems of words
(their first four and five bytes, so that new inflections of a known word count), hashed into
a fixed number of slots; a slot counts once per text. The model is learnt online, one row after the
other, in one task that streams over a bounded sample of labelled rows. Per-coordinate rates
and the L1 term leave few weights, at most `SLOTS`, which are sent to all tasks for scoring.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import map_batches, utf8

SLOTS = 1 << 18
STEMS = (4, 5)
_PUNCTUATION = bytes(c if chr(c).isalnum() or c > 127 or c == 39 else 32 for c in range(128)) + bytes(range(128, 256))
_SPACED = _PUNCTUATION.lower()


def features(text: bytes) -> np.ndarray:
    """Slots of a text's n-grams, repeats included; A-Z lower-cased, ASCII punctuation dropped."""
    words = text.translate(_SPACED).split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)
    pair = h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]
    skip = h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] * np.uint64(0x27D4EB2F165667C5)
    parts = [h, pair, skip]
    for size in STEMS:
        stem = np.fromiter(map(crc32, [w[:size] for w in words]), np.uint64, len(words))
        parts.append(stem * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size))
    mixed = np.concatenate(parts)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


class Ftrl:
    """FTRL-proximal: per-coordinate rates, L1 and L2 terms. Slot `SLOTS` is the intercept."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.arange(SLOTS + 1)[at] == SLOTS, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, SLOTS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: F.Column | None = None,
    max_rows: int = 12_000,
    epochs: int = 2,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 6.0,
    l2: float = 0.0,
) -> np.ndarray:
    """Weights of all slots and the intercept.

    `labels`: (doc_id, toxic). Learns from the `max_rows` labelled rows whose ids come first
    by a hash, among those where `learn_from` (over doc_id) is true: the documented bound of
    the sample. Rows without a text or label teach nothing; of the rows of one id the smallest
    text and the larger label teach, so `max_rows` bounds the rows as well.
    """
    wanted = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    if learn_from is not None:
        wanted = wanted.filter(learn_from)
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    chosen = wanted.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(max_rows)

    def made(batch: pa.RecordBatch) -> dict:
        slots = [np.unique(features(raw)).astype("<i4").tobytes() for raw in utf8(batch.column(1))]
        return {"doc_id": batch.column(0), "toxic": batch.column(2), "slots": pa.array(slots, pa.binary())}

    met = docs.filter("text IS NOT NULL").select("doc_id", "text").join(chosen, "doc_id")
    rows = met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = map_batches(rows, made, f"doc_id {kind}, toxic int, slots binary")
    turns = sample.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    mixed = F.xxhash64("doc_id", "epoch")
    one_task = turns.repartition(1).sortWithinPartitions("epoch", mixed, "slots")

    def learnt(batches):
        model = Ftrl(alpha, beta, l1, l2)
        for batch in batches:
            for slots, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                model.learn(np.frombuffer(slots.as_py(), "<i4").astype(np.int64), toxic)
        w = model.weights()
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(kept, pa.int32()), "weight": pa.array(w[kept])})

    weights = np.zeros(SLOTS + 1)
    for row in one_task.select("slots", "toxic").mapInArrow(learnt, "slot int, weight double").collect():
        weights[row.slot] = row.weight
    return weights


def score_of(text: bytes, weights: np.ndarray) -> float:
    slots = features(text)
    slots = np.unique(slots[weights[slots] != 0])
    return float(1 / (1 + np.exp(-np.clip(weights[slots].sum() + weights[SLOTS], -35, 35))))


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score): one row per row of `docs`; a null text is scored as an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def score(batch: pa.RecordBatch) -> dict:
        return {
            "doc_id": batch.column(0),
            "score": pa.array([score_of(raw, sent.value) for raw in utf8(batch.column(1))], pa.float64()),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), score, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, weights: np.ndarray, limit: float = 0.5) -> DataFrame:
    """Rows of `docs` that score below `limit`, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            fine = [score_of(raw, sent.value) < limit for raw in utf8(batch.column(at))]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
