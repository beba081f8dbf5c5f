"""Contiguous shards of near equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.session import Scratch

SHARDS = 16


def assign_shards(docs: DataFrame, shards: int = SHARDS, partitions: int | None = None) -> DataFrame:
    """Cut the documents, in the order of doc_id, into shards of near equal bytes.

    Method: only (doc_id, size, crc32) is dealt into sorted ranges and written; the text is read
    once and never moved. A total for each range (as many rows as ranges) gives the bytes and rows
    before it; a running sum within a range adds the rest. A row goes to the shard in which the
    middle of its bytes lies, so each shard misses its target by less than one row at either end.

    Rows of one range are summed in one task; a range holds its share of rows whatever the keys
    are, as equal keys are dealt by a running number too.

    Cases: a null text counts as empty (size 1); null doc_ids come first; repeated rows are rows of
    their own; no rows give no rows; a row larger than a shard leaves neighbours empty.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_crc32", "row_no"]
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
        .withColumn("row_no", F.monotonically_increasing_id())
        .repartitionByRange(n, *order)
        .withColumn("range", F.spark_partition_id())
    )
    # written once: ranges are drawn by sampling, and totals and rows must see the same ones
    ranged = scratch.save("ranged", ranged)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("range")
        .agg(F.sum("size").alias("range_bytes"), F.count("*").alias("range_rows"))
        .withColumns({"bytes_before": F.coalesce(F.sum("range_bytes").over(before), F.lit(0)), "rows_before": F.coalesce(F.sum("range_rows").over(before), F.lit(0)), "all_bytes": F.sum("range_bytes").over(Window.partitionBy())})
        .select("range", "bytes_before", "rows_before", "all_bytes")
    )
    run = Window.partitionBy("range").orderBy(*order)
    middle = F.col("bytes_before") * 2 + F.sum("size").over(run) * 2 - F.col("size")
    # one row for each range: as many as partitions, so its size is known
    placed = ranged.join(F.broadcast(starts), "range").select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.lit(shards - 1), (middle * shards / (F.col("all_bytes") * 2)).cast("int")).alias("shard"),
        (F.col("rows_before") + F.row_number().over(run) - 1).cast("long").alias("row_index"),
    )
    placed = scratch.save("placed", placed)
    scratch.drop("ranged")
    firsts = placed.groupBy("shard").agg(F.min("row_index").alias("first_index"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row_index") - F.col("first_index")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write the rows of docs as Parquet under path/shard=K, as many of each text to each shard as assigned, and return the assignment.

    Rows meet their shards by doc_id and text. A cut falls within the repeated rows of one text at most, so
    no more than shards - 1 texts lie in several; their rows are numbered, in each task, then over the tasks'
    totals.

    Cases: null texts and ids and repeated rows are written like others; a column of docs named shard
    makes the folders' name shard_; other columns are kept, whatever their names; no rows write no files.
    """
    scratch = Scratch(docs.sparkSession, "write-shards")
    assigned = assign_shards(docs, shards)
    key = [F.col("doc_id").cast("long").alias("__id"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("__crc")]
    places = scratch.save("places", assigned.groupBy(F.col("doc_id").alias("__at_id"), F.col("text_crc32").alias("__at_crc"), "shard").agg(F.count("*").alias("__n")))
    folder = "shard"
    while folder in docs.columns:
        folder += "_"
    spans = places.groupBy("__at_id", "__at_crc").agg(F.min("shard").alias(folder), F.array_sort(F.collect_list(F.struct("shard", "__n"))).alias("__spans"))
    keyed = docs.withColumns({"__id": key[0], "__crc": key[1]})
    same = F.col("__id").eqNullSafe(F.col("__at_id")) & (F.col("__crc") == F.col("__at_crc"))
    joined = keyed.join(spans, same).drop("__at_id", "__at_crc")
    plain = joined.where(F.size("__spans") == 1).drop("__id", "__crc", "__spans")
    # at most shards - 1 keys; their rows are numbered where they are
    split = joined.where(F.size("__spans") > 1).drop(folder).withColumn("__row", F.monotonically_increasing_id())
    if not split.isEmpty():
        split = scratch.save("split", split)
        part = F.shiftright("__row", 33)
        totals = split.groupBy("__id", "__crc", part.alias("__part")).agg(F.count("*").alias("__rows"))
        before = F.sum("__rows").over(Window.partitionBy("__id", "__crc").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        starts = totals.select(F.col("__id").alias("__at_id"), F.col("__crc").alias("__at_crc"), "__part", F.coalesce(before, F.lit(0)).alias("__before"))
        number = F.row_number().over(Window.partitionBy("__id", "__crc", "__part").orderBy("__row"))
        numbered = split.withColumn("__part", part).withColumn("__no", number).withColumnRenamed("__part", "__of").join(F.broadcast(starts), same & (F.col("__of") == F.col("__part")))
        # the shard whose rows of this text reach past the number
        place = F.col("__before") + F.col("__no")
        upto = F.aggregate("__spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("s")), lambda a, x: F.struct((a["n"] + x["__n"]).alias("n"), F.coalesce(a["s"], F.when(place <= a["n"] + x["__n"], x["shard"])).alias("s")))["s"]
        plain = plain.unionByName(numbered.withColumn(folder, upto).select(*docs.columns, folder))
    plain.write.partitionBy(folder).parquet(path)
    return assigned
