"""Importance resampling towards a target distribution, over a sparse matrix of documents by buckets."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_map, batch, texts
from lakeloom.session import Scratch

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
#: Words of a block of the matrix; a larger document is a block of its own.
BLOCK_WORDS = 1 << 19
CACHED_WORDS = 400_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BLOCK_SCHEMA = "doc_ids array<long>, n_words array<long>, indptr binary, indices binary, counts binary, width int"


@cache
def _shifts(length: int) -> np.ndarray:
    """What `length` zero bytes behind a string do to its crc32, as four tables of 256: the crc is linear over
    GF(2), so the crc of a joined string is the shifted one of its first part, xor that of its second."""
    zeros = bytes(length)
    ones = [zlib.crc32(zeros, 1 << bit) ^ zlib.crc32(zeros) for bit in range(32)]
    out = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ np.uint32(ones[8 * byte + bit])
    return out


#: Words up to so many bytes have tables; longer ones are rare and go through zlib.
TABLED = 63


def joined_crc(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of strings joined, from those of their parts and the seconds' lengths in bytes (at most TABLED + 1)."""
    tables = np.stack([_shifts(n) for n in range(TABLED + 2)])
    shifted = tables[lengths, 0, first & 255]
    for byte in (1, 2, 3):
        shifted ^= tables[lengths, byte, (first >> (8 * byte)) & 255]
    return shifted ^ second


class Features:
    """Buckets of the words and word pairs of texts. A word is looked at once and then known by a number."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.alone, self.spaced, self.length = [], [], []

    def _add(self, word: str) -> int:
        data = word.encode()
        self.alone.append(zlib.crc32(data))
        self.spaced.append(zlib.crc32(b" " + data))
        self.length.append(len(data) + 1)
        self.numbers[word] = n = len(self.numbers)
        return n

    def rows(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CSR (indptr, indices, counts) of the documents whose words are given."""
        numbers = self.numbers
        if len(numbers) > CACHED_WORDS:
            self.clear()
            numbers = self.numbers
        flat = [w for d in words for w in d]
        for w in set(flat) - numbers.keys():
            self._add(w)
        of = np.fromiter(map(numbers.__getitem__, flat), dtype=np.int64, count=len(flat))
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        doc = np.repeat(np.arange(len(words)), n)
        alone, spaced, length = (np.asarray(x, dtype=t) for x, t in ((self.alone, np.uint32), (self.spaced, np.uint32), (self.length, np.int64)))
        pairs = np.flatnonzero(doc[1:] == doc[:-1])  # a pair is named by its first word
        first, second = of[pairs], of[pairs + 1]
        short = length[second] <= TABLED + 1
        crc = np.empty(len(pairs), dtype=np.uint32)
        crc[short] = joined_crc(alone[first[short]], spaced[second[short]], length[second[short]])
        for k in np.flatnonzero(~short):
            crc[k] = zlib.crc32(b" " + flat[pairs[k] + 1].encode(), int(alone[first[k]]))
        keys = np.concatenate([doc * self.buckets + alone[of] % self.buckets, doc[pairs] * self.buckets + crc % self.buckets])
        cells, counts = np.unique(keys, return_counts=True)
        indptr = np.searchsorted(cells, np.arange(len(words) + 1) * self.buckets)
        return indptr, cells % self.buckets, counts


def count_matrix(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The matrix of documents by buckets in compressed sparse rows, a row of this table for each block of documents:
    doc_ids and n_words by document, and indptr (int64), indices and counts (unsigned, the latter of `width` bytes) as raw arrays.

    Features are all words and pairs of neighbouring words of the whole texts; buckets are crc32 modulo `buckets`.

    Cases: null, empty and wordless texts are empty rows; a very long text is one row of any number of cells; repeated
    rows are rows of their own; other columns are ignored; no rows give no blocks.
    """
    if not 0 < buckets <= 1 << 32:
        raise ValueError("buckets must be positive and fit 32 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        index = np.uint16 if buckets <= 1 << 16 else np.uint32

        def block(ids: list, words: list[list[str]]) -> pa.RecordBatch:
            indptr, indices, counts = features.rows(words)
            width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << 8 * w)
            one = lambda x, t: ([x], t)
            return batch(
                doc_ids=one(ids, pa.list_(pa.int64())),
                n_words=one([len(w) for w in words], pa.list_(pa.int64())),
                indptr=one(indptr.astype("<i8").tobytes(), pa.binary()),
                indices=one(indices.astype(index).tobytes(), pa.binary()),
                counts=one(counts.astype(f"<u{width}").tobytes(), pa.binary()),
                width=one(width, pa.int32()),
            )

        ids, held, total = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids.append(doc_id)
                held.append(WORD.findall(text.as_py().translate(LOWER)))
                total += len(held[-1])
                if total >= BLOCK_WORDS or len(ids) >= 10_000:
                    yield block(ids, held)
                    ids, held, total = [], [], 0
        if ids:
            yield block(ids, held)

    return arrow_map(texts(docs).select("doc_id", "text"), run, BLOCK_SCHEMA)


def _blocks(b: pa.RecordBatch, buckets: int) -> Iterator[tuple[list, list, np.ndarray, np.ndarray, np.ndarray]]:
    index = np.uint16 if buckets <= 1 << 16 else np.uint32
    for k in range(b.num_rows):
        take = lambda name, t, k=k: np.frombuffer(b.column(name)[k].as_py(), dtype=t)
        width = b.column("width")[k].as_py()
        yield b.column("doc_ids")[k].as_py(), b.column("n_words")[k].as_py(), take("indptr", "<i8"), take("indices", index), take("counts", f"<u{width}")


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the distribution of features; each task sums its blocks first, to `buckets` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for *_, indices, counts in _blocks(b, buckets):
                np.add.at(total, indices, counts.astype(np.int64))
        seen = np.flatnonzero(total)
        yield batch(bucket=pa.array(seen, pa.int64()), n=pa.array(total[seen], pa.int64()))

    return arrow_map(matrix, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(have: dict[int, int], want: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain: a thousand times the log ratio of its smoothed shares in the target and in all documents, floored."""
    s_all, t_all = sum(have.values()), sum(want.values())
    return [math.floor(1000 * math.log((want.get(b, 0) + 1) * (s_all + buckets) / ((have.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)]


def weigh(matrix: DataFrame, gains: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight: the matrix times the gains, divided by the features, floored; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.asarray(gains, dtype=np.int64)
        for b in batches:
            for ids, n_words, indptr, indices, counts in _blocks(b, len(gains)):
                counts = counts.astype(np.int64)
                running = np.concatenate([[0], np.cumsum(counts * vector[indices])])
                features = np.concatenate([[0], np.cumsum(counts)])
                n = features[indptr[1:]] - features[indptr[:-1]]
                weight = (running[indptr[1:]] - running[indptr[:-1]]) // np.maximum(n, 1)
                yield batch(doc_id=(ids, pa.int64()), n_words=(n_words, pa.int64()), n_features=pa.array(n), weight=pa.array(weight))

    return arrow_map(matrix, run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw in thousandths, floored, that hangs on the seed and the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -1000.0)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with its weight and score, and a rank where it is drawn.

    The matrix of counts is written once. Its column sums, at most `buckets` numbers, come to the driver, as do the
    target's; the gains go to the tasks, and the matrix times the gains gives the weights. A score is the weight plus a
    Gumbel draw, so that the highest scores are a sample without replacement. Of the N documents with at least
    `least_words` words floor(percent * N / 100) are drawn. Scores are dealt into sorted ranges and numbered in each
    range over the ranges' totals, so no task holds them all; equal scores and ids are dealt by a running number.

    Cases: null, empty and wordless texts have weight 0 and are never drawn; of equal scores the smaller doc_id is
    drawn first, a null one (noise of the empty id) first of all; repeated rows have equal scores and ranks of their
    own; no documents give no rows; with an empty target gains follow its smoothing alone; other columns are ignored.

    Returns doc_id, n_words, n_features, weight, score, rank.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    matrix = scratch.save("matrix", count_matrix(docs, buckets))
    sums = lambda m: {r[0]: r[1] for r in column_sums(m, buckets).collect()}
    gains = gains_of(sums(matrix), sums(count_matrix(target.withColumn("doc_id", F.lit(0)), buckets)), buckets)
    scored = weigh(matrix, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row_no", F.monotonically_increasing_id())
    scored = scratch.save("scored", scored)
    scratch.drop("matrix")
    eligible = scored.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id"), F.col("row_no")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: ranges are drawn by sampling, and totals and rows must see the same ones
    ranged = scratch.save("ranged", eligible.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count("*").alias("rows")).select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("all"))
    # one row for each range: as many as partitions, so its size is known
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    drawn = ranged.join(F.broadcast(starts), "range").withColumn("place", place.cast("long")).withColumn("rank", F.when(F.col("place") <= F.floor(F.col("all") * percent / 100), F.col("place")))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*columns).unionByName(rest.select(*columns))
