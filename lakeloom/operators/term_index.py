"""An index of character trigrams for searches by substring.

Terms match anywhere in a text, also within words, so words can't be looked up. A chunk that holds a term holds all of
its trigrams: the chunks posted under a term's rarest ones are a superset of those that hold it, and the search
itself verifies them by substring.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.operators import search
from lakeloom.sources.committed import CommittedTable, Storage

GRAM = 3
#: Of a term's trigrams so many, the rarest, are looked up: more would rule out few chunks and read long postings.
RAREST = 2
#: Characters of texts posted at once (a longer text alone), and pairs of trigram and text that are marked rather than sorted.
CHARACTERS, CELLS = 1 << 22, 1 << 26
#: Bits of the map of posted keys, 2 MB whatever the data; a fuller one lets more chunks pass.
BITS = 1 << 24


def grams_of(text: str) -> set[str]:
    low = text.lower()
    return {low[i : i + GRAM] for i in range(len(low) - GRAM + 1)}


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with at most CHARACTERS of text; a longer text is one by itself."""
    begin = held = 0
    for k, size in enumerate(pa.compute.utf8_length(batch.column("text")).fill_null(0).to_pylist()):
        if k > begin and held + size > CHARACTERS:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    yield batch.slice(begin)


def _postings(keys: pa.Array, low: list[str]) -> pa.RecordBatch | None:
    """gram, n and keys: the n texts, in lower case, that hold a trigram; as grams_of each of them, but all at once."""
    codes = np.frombuffer("".join(low).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    text = np.repeat(np.arange(len(low)), [len(t) for t in low])
    whole = text[GRAM - 1 :] == text[: len(text) - GRAM + 1]
    if not whole.any():
        return None
    # a character has 21 bits
    grams = pa.array((codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[whole]).dictionary_encode()
    many = len(grams.dictionary)
    pairs = grams.indices.to_numpy().astype(np.int64) * len(low) + text[: len(whole)][whole]
    if many * len(low) <= CELLS:
        marked = np.zeros(many * len(low), dtype=bool)
        marked[pairs] = True
        pairs = np.flatnonzero(marked)
    else:
        pairs = np.unique(pairs)
    code = grams.dictionary.to_numpy()
    letters = np.stack([code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    n = np.bincount(pairs // len(low), minlength=many)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), keys.take(pa.array(pairs % len(low))))
    return pa.RecordBatch.from_arrays([pa.array([letters[i : i + GRAM] for i in range(0, len(letters), GRAM)]), pa.array(n, pa.int32()), lists], names=["gram", "n", "keys"])


def _among(grams: list[str]) -> Column:
    """Whether `gram` is one of some. Spark lets Parquet look for ten values at once, and else for all between the first and last."""
    few = 10 if len(grams) <= 500 else len(grams)
    return reduce(or_, [F.col("gram").isin(grams[k : k + few]) for k in range(0, len(grams), few)])


class TermIndex:
    """A folder with the chunks (a committed table by their key), `postings/` (gram, n, keys; sorted) and `counts/` (gram, n)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        said = json.loads(Storage(spark, root).read(f"{self.root}/index.json"))
        self.key = StructType.fromJson(said["schema"])
        self.chunks = CommittedTable(spark, f"{self.root}/chunks")
        self.version = said["version"]

    @classmethod
    def build(cls, chunks: DataFrame, root: str, buckets: int = 64) -> TermIndex:
        """Index chunks (key, text and other columns), one row a key.

        A row of the postings has a trigram's chunks among those of CHARACTERS of text, not a row for each chunk. They are
        made once and dealt by trigram; a trigram that most chunks hold has as many rows as there are such runs of texts,
        which adaptive planning spreads over several files.
        """
        spark, root = chunks.sparkSession, root.rstrip("/")
        table = CommittedTable.create(spark, f"{root}/chunks", chunks.schema, "key", buckets)
        version = table.overwrite(chunks)
        key = StructType([chunks.schema["key"]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for few in _runs(b):
                    rows = _postings(few.column("key"), [(t or "").lower() for t in few.column("text").to_pylist()])
                    if rows is not None:
                        yield rows

        shape = f"gram string, n int, keys array<{chunks.schema['key'].dataType.simpleString()}>"
        posted = table.read().select("key", "text").mapInArrow(run, shape)
        posted.hint("rebalance", "gram").sortWithinPartitions("gram").write.option("parquet.block.size", 8 << 20).option("compression", "zstd").parquet(f"{root}/postings")
        postings = spark.read.schema(shape).parquet(f"{root}/postings")
        postings.groupBy("gram").agg(F.sum("n").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{root}/counts")
        if not Storage(spark, root).publish(f"{root}/index.json", json.dumps({"schema": json.loads(key.json()), "version": version.number})):
            raise FileExistsError(root)
        return cls(spark, root)

    def _terms(self, queries: DataFrame) -> list[str]:
        rows = queries.select(F.explode("terms").alias("term")).where(F.col("term").isNotNull()).distinct().limit(search.QUERY_BLOCK * 12 + 1).collect()
        if len(rows) > search.QUERY_BLOCK * 12:
            raise ValueError("too many terms: search in blocks")
        return [r["term"].lower() for r in rows]

    def posted(self, queries: DataFrame) -> DataFrame:
        """The chunks that may hold a term of any of the queries (terms); all chunks if a term is shorter than a trigram.

        The terms' trigrams and their counts come to the driver, the postings don't. Only the chunks' buckets that hold posted
        keys are read, and a map of bits tells posted chunks where they lie: chunks are not moved for it.
        """
        terms = self._terms(queries)
        if any(0 < len(t) < GRAM for t in terms):
            return self.chunks.read(self.version)
        wanted = {t: grams_of(t) for t in terms if t}
        asked = sorted(set().union(*wanted.values())) if wanted else []
        count = {r["gram"]: r["n"] for r in self.spark.read.schema("gram string, n long").parquet(f"{self.root}/counts").where(F.col("gram").isin(asked)).collect()} if asked else {}
        needed = [(t, g) for t, gs in wanted.items() if all(g in count for g in gs) for g in sorted(gs, key=lambda g: (count[g], g))[:RAREST]]
        if not needed:
            return self.chunks.read(self.version).limit(0)
        size = {t: sum(1 for n, _ in needed if n == t) for t, _ in needed}
        lookup = self.spark.createDataFrame([(t, g, size[t]) for t, g in needed], "term string, gram string, needed long")
        postings = self.spark.read.schema(f"gram string, keys array<{self.key['key'].dataType.simpleString()}>").parquet(f"{self.root}/postings").where(_among(sorted({g for _, g in needed})))
        each = postings.join(F.broadcast(lookup), "gram").select("term", "needed", F.explode("keys").alias("key"))
        found = each.groupBy("term", "key").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).where("n >= needed")
        return self._mapped(self.chunks.rows_near(found.select("key"), self.version), found)

    def _mapped(self, chunks: DataFrame, found: DataFrame) -> DataFrame:
        """The chunks whose key is, by its hash, among those found. As the search verifies terms, others that pass do no harm."""
        bit = F.xxhash64("key").bitwiseAND(F.lit(BITS - 1))
        word, at = F.shiftright(bit, 6).cast("int").alias("__word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("__at")
        words = found.select(word, at).groupBy("__word").agg(F.expr("bit_or(shiftleft(1L, __at))").alias("__bits"))
        joined = chunks.select("*", word, at).join(F.broadcast(words), "__word")
        return joined.where("getbit(__bits, __at) = 1").select(*chunks.columns)

    def keyword_search(self, queries: DataFrame, candidates_: int = 30) -> DataFrame:
        """As search.keyword_search over all chunks, from the posted ones."""
        return search.keyword_search(self.posted(queries), queries, candidates_)
