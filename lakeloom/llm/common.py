"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and text_hash: the last two tell rows apart that share a doc_id.

    Rows alike in doc_id and text are repeated rows; every operator gives each of them the same result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def raw(docs: DataFrame) -> DataFrame:
    """Like texts(), with the text as its UTF-8 bytes, which spares Python decoding."""
    return texts(docs).withColumn("text", F.col("text").cast("binary"))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo a fold count (null doc_id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def arrow_map(frame: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return frame.mapInArrow(function, schema)


def batch(**columns) -> pa.RecordBatch:
    """A record batch of the given arrays or (values, type) pairs."""
    arrays = {k: v if isinstance(v, pa.Array) else pa.array(v[0], v[1]) if isinstance(v, tuple) else pa.array(v) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


#: At most so many keys are told apart as hot; each holds more than one in HOT_KEYS of the rows.
HOT_KEYS = 1_000
#: Bits of a bitmap, 2 MB whatever the data; fuller ones let more pass.
BITMAP_BITS = 1 << 24


def hot_keys(counted: DataFrame, keys: list[str], count: str, floor: int) -> list[int]:
    """Hashes of the keys whose count is above `floor` and above one in HOT_KEYS of all, so never more than HOT_KEYS."""
    total = counted.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    return [r[0] for r in counted.where(F.col(count) > max(floor, total // HOT_KEYS)).select(F.xxhash64(*keys)).collect()]


def among(keys: list[str], hashes: list[int]) -> Column:
    """Whether the hash of the keys is one of a bounded list."""
    if not hashes:
        return F.lit(False)
    return F.expr(f"xxhash64({', '.join(keys)}) in ({', '.join(f'{h}L' for h in hashes)})")


def skewed_join(rows: DataFrame, other: DataFrame, keys: list[str], hot: list[int]) -> DataFrame:
    """Inner join by keys of which `other` has a bounded number of rows each: hot ones by broadcast, so that
    their rows stay where they are, the others by a shuffle."""
    if not hot:
        return rows.join(other, keys)
    warm = among(keys, hot)
    return rows.where(~warm).join(other.where(~warm), keys).unionByName(rows.where(warm).join(F.broadcast(other.where(warm)), keys))


def with_maybe(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows and `maybe`: false only where the key, a 64-bit hash, isn't among `keys`.

    Told by a bitmap of BITMAP_BITS bits, made in Spark and broadcast as its words; the more keys there
    are the more rows pass, so it spares work and decides nothing.
    """
    word = F.shiftright(F.col(key).bitwiseAND(F.lit(BITMAP_BITS - 1)), 6).cast("int")
    words = keys.select(word.alias("__word"), F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))").alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    joined = rows.withColumn("__word", word).join(F.broadcast(words), "__word", "left")
    return joined.withColumn("maybe", F.expr(f"coalesce(getbit(__bits, cast(`{key}` & 63 as int)) = 1, false)")).drop("__word", "__bits")
