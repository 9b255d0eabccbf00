"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Learning rates are kept per coordinate and an L1 term holds most weights at exactly zero, so the
model is a short list of (feature, weight) that every task can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from farsight.llm.common import arrow_map, bounded_sample, chunks, texts_of
from farsight.llm.decontaminate import words_of
from farsight.llm.registry import query, table

# Features are hashed to this many coordinates, which bounds the model that is broadcast.
FEATURE_BITS = 20
# Labelled rows that the model is fitted on, and passes over them.
TRAIN_ROWS = 12_000
EPOCHS = 8
# A coordinate is learned if this many of those rows have it.
MIN_COUNT = 3
THRESHOLD = 0.7
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class WordHashes(dict):
    """Word -> 64-bit hash, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


_HASHES = WordHashes()


def features(texts: list[bytes], bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of the words, word pairs and pairs with one word between."""
    get = _HASHES.__getitem__
    words = [words_of(t) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    h = np.fromiter((get(w) for ws in words for w in ws), np.uint64, len(doc))
    docs, coordinates = [doc], [h]
    for gap, step in ((1, _STEPS[0]), (2, _STEPS[1])):
        same = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][same])
        coordinates.append((h[:-gap] * step + h[gap:])[same])
    mixed = np.concatenate(coordinates) * _STEPS[2]
    return np.concatenate(docs), (mixed >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """The coordinates with a weight that is not zero, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = FEATURE_BITS

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float64)
        out[self.at] = self.weight
        return out


class Ftrl:
    """FTRL-proximal with per-coordinate rates; binary features, last coordinate the bias."""

    def __init__(self, bits: int = FEATURE_BITS, alpha: float = 3.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.5) -> None:
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << self.bits, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step on a row with the distinct coordinates ``at``."""
        at = np.append(at.astype(np.int64), 1 << self.bits)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def model(self) -> Model:
        every = self.weights(np.arange((1 << self.bits) + 1))
        at = np.flatnonzero(every[:-1])
        return Model(at, every[at], float(every[-1]), self.bits)


def fit(rows: Iterator[tuple[bytes, int]], epochs: int = EPOCHS, bits: int = FEATURE_BITS, min_count: int = MIN_COUNT) -> Model:
    """A model of (text, label) rows, in their order, ``epochs`` times over.

    Coordinates of fewer than ``min_count`` rows are left out: they would only tell rows apart.
    """
    held, count = [], np.zeros(1 << bits, np.int32)
    for text, label in rows:
        at = np.unique(features([text], bits)[1]).astype(np.int32)
        count[at] += 1
        held.append((at, label))
    held = [(at[count[at] >= min_count], label) for at, label in held]
    learner = Ftrl(bits)
    for _ in range(epochs):
        for at, label in held:
            learner.learn(at, label)
    return learner.model()


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_rows: int = TRAIN_ROWS,
) -> Model:
    """Fits on the ``max_rows`` labels that come first by a hash of their id, and the texts of those ids.

    Null labels, ids without a text row and null ids are left out; a repeated id gives its rows each.
    The chosen labels are broadcast, their number being bounded, so no other text moves. One task
    learns; only the weights come to the driver. Without any labelled text all weights are zero.
    """
    known = labels.where(F.col(label_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    chosen = bounded_sample(known, ["id", "label"], max_rows)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    sample = rows.orderBy(F.xxhash64("id", "label"), "id", "text", "label").limit(max_rows).select("text", "label")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for batch in batches:
                yield from zip(texts_of(batch), batch.column(1).to_pylist())

        model = fit(pairs())
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.at.astype("<i8").tobytes()], pa.binary()), pa.array([model.weight.astype("<f8").tobytes()], pa.binary()), pa.array([model.bias])],
            names=["at", "weight", "bias"],
        )

    found = sample.coalesce(1).mapInArrow(learn, "at binary, weight binary, bias double").collect()
    if not found:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    return Model(np.frombuffer(found[0]["at"], "<i8"), np.frombuffer(found[0]["weight"], "<f8"), found[0]["bias"])


@lru_cache(maxsize=2)
def _dense(at: bytes, weight: bytes, bits: int) -> np.ndarray:
    return Model(np.frombuffer(at, "<i8"), np.frombuffer(weight, "<f8"), 0.0, bits).dense()


def score_texts(texts: list[bytes], weights: np.ndarray, bias: float, bits: int = FEATURE_BITS) -> np.ndarray:
    doc, at = features(texts, bits)
    used = weights[at] != 0
    pairs = np.unique(doc[used] << bits | at[used])
    total = np.bincount(pairs >> bits, weights[pairs & ((1 << bits) - 1)], len(texts)) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: Model, text_column: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` with ``out``, the probability of toxicity, replacing such a column.

    Null and empty texts have no features and get the score of the bias.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.at.astype("<i8").tobytes(), model.weight.astype("<f8").tobytes()))
    kept = docs.select(*[c for c in docs.columns if c != out])
    bias, bits = model.bias, model.bits

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, texts = _dense(*shared.value, bits), texts_of(batch, text_column)
        scores = [score_texts(texts[a:b], weights, bias, bits) for a, b in chunks(texts, 2 << 20)]
        columns = [batch.column(i) for i in range(batch.num_columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(scores), pa.float64())], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return arrow_map(kept, run, f"{schema}, `{out}` double")


def fold(id_column: str = "doc_id"):
    """crc32 of the id as text, modulo 3; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3, F.lit(0))


@query("op4_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, by a model of the labelled rows outside fold 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold() != 1)
    model = train(docs.where(fold() != 1), labels)
    scored = score(docs, model)
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
