"""Toxicity scores by logistic regression, trained with FTRL-proximal on hashed features."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_map, batch, raw, remainder

BITS = 20
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: The model is fitted on at most so many labelled rows, those with the least hash of doc_id.
TRAIN_ROWS = 8_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 10.0, 0.5
CACHED_WORDS = 400_000
#: Inflected forms of a word share so many first bytes.
STEM = 4

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Words(dict):
    """crc32 of words in the upper half, of their stems in the lower; kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word) << 32 | zlib.crc32(word[:STEM])
        return value


def features(text: bytes, words: Words) -> np.ndarray:
    """Hashed word unigrams, of whole words and of stems, bigrams and skip-grams (one word left out) of a whole text, with repeats."""
    tokens = text.translate(_KEEP).split()
    both = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    h, stem = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    mixed = np.concatenate([h * np.uint64(0x9E3779B97F4A7C15), stem * np.uint64(0x27D4EB2F165667C5), h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9), h[:-2] * np.uint64(0xD6E8FEB86659FD93) + h[2:] * np.uint64(0xA0761D6478BD642F)])
    return (mixed >> np.uint64(64 - BITS)).astype(np.uint32)


@dataclass
class Model:
    """The weights that L1 left, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.index] = self.weight
        return out


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal with a rate for each coordinate; a feature counts once a text.

    Without rows the model scores 0.5; with labels of one kind only the bias moves far.
    """
    n, z = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = 0.0, 0.0
    for _ in range(epochs):
        for x, y in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= L1, 0.0, -(zx - np.sign(zx) * L1) / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + w.sum()))))
            g = p - y
            if len(x):
                z[x] = zx + g - (np.sqrt(nx + g * g) - root) / ALPHA * w
                n[x] = nx + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + math.sqrt(bias_n)) * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    index = np.flatnonzero(w)
    return Model(index.astype(np.uint32), w[index].astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled documents outside the held-out fold: at most `rows` of them.

    The bound is on the classifier's sample alone. Which rows: those with the least xxhash64 of
    doc_id; both the ids and their features come to the driver, a known number of rows.
    """
    doc_id = F.col("doc_id").cast("long")
    chosen = (
        labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            x = [np.unique(features(t.as_py(), words)).tobytes() for t in b.column("text")]
            yield batch(doc_id=b.column("doc_id"), toxic=b.column("toxic"), x=(x, pa.binary()))

    # at most `rows` pairs of numbers: small enough for every task
    sample = raw(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])
    found = arrow_map(sample.select("doc_id", "toxic", "text"), hashed, "doc_id long, toxic int, x binary").toArrow()
    by_id = sorted(zip(found["doc_id"].to_pylist(), found["toxic"].to_pylist(), found["x"].to_pylist(), strict=True), key=lambda r: (zlib.crc32(b"%d" % r[0]), r))
    return fit([(np.frombuffer(x, dtype=np.uint32), int(y > 0)) for _, y, x in by_id])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash, held_out, score and predicted of every whole text; no shuffle.

    Cases: null and empty texts get the score of the bias; a null doc_id is not held out; repeated
    rows get the same score; no rows give no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.index, model.weight, model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        index, weight, bias = shared.value
        dense = Model(index, weight, bias).dense()
        for b in batches:
            sums = []
            for t in b.column("text"):
                x = features(t.as_py(), words)
                # a feature counts once, and only those with a weight need sorting for that
                sums.append(float(dense[np.unique(x[dense[x] != 0])].sum(dtype=np.float64)))
            p = 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=np.float64) + bias, -35, 35)))
            yield batch(doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), held_out=b.column("held_out"), score=pa.array(p), predicted=pa.array((p >= THRESHOLD).astype(np.int32)))

    rows = raw(docs).withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))
    return arrow_map(rows, score, "doc_id long, text_hash long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train(docs, labels))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't call toxic, all columns, in one pass without a shuffle.

    Cases: null and empty texts have the score of the bias; repeated rows stay or go together; no rows give
    no rows; other columns are kept, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        index, weight, bias = shared.value
        dense = Model(index, weight, bias).dense()
        limit = math.log(THRESHOLD / (1 - THRESHOLD))
        for b in batches:
            clean = []
            for t in b.column("text"):
                x = features((t.as_py() or "").encode(), words)
                clean.append(float(dense[np.unique(x[dense[x] != 0])].sum(dtype=np.float64)) + bias < limit)
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
