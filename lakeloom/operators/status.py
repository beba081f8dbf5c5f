"""Facets, counts and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def facets(rows: DataFrame, value: Column, most: int = 10, condition: Column | None = None, term: str | None = None) -> DataFrame:
    """key and doc_count of the commonest values: 10 if `most` isn't positive, 100 at most; ties by key.

    An array counts each of its values once a row. term: of the values that hold it, letter case aside; a blank one is none.
    """
    kept = (rows if condition is None else rows.where(condition)).select(value.alias("key"))
    if isinstance(kept.schema["key"].dataType, ArrayType):
        kept = kept.select(F.explode(F.array_distinct("key")).alias("key"))
    kept = kept.select(F.col("key").cast("string").alias("key")).where("key is not null")
    if term and term.strip():
        kept = kept.where(F.contains(F.lower("key"), F.lit(term.strip().lower())))
    counted = kept.groupBy("key").agg(F.count("*").alias("doc_count"))
    return counted.orderBy(F.desc("doc_count"), "key").limit(min(100, most) if most > 0 else 10)


def folder_status(rows: DataFrame) -> DataFrame:
    """Counts and the worst state of each folder (folder_id, status: INDEXED, FAILED, else pending)."""
    counted = rows.groupBy("folder_id").agg(
        F.count("*").alias("total"),
        F.count(F.when(F.col("status") == "INDEXED", 1)).alias("indexed"),
        F.count(F.when(F.col("status") == "FAILED", 1)).alias("failed"),
    )
    pending = F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("indexed") - F.col("failed"))
    return counted.withColumn("pending", pending).select(
        "*",
        F.when(F.col("failed") > 0, "FAILED").when(F.col("pending") > 0, "PENDING").otherwise("INDEXED").alias("status"),
        F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" document(s) failed indexing"))).alias("error"),
    )


def node_status(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """State of each node (node_id, own_status) by its own property, else its document (node_id, sync_status); unknown words count as INDEXED."""
    joined = nodes.join(documents.withColumn("__there", F.lit(True)), "node_id", "left")
    known = lambda c: F.when(F.col(c).isin("PENDING", "PROCESSING", "INDEXED", "FAILED"), F.col(c)).when(F.col(c).isNotNull(), F.lit("INDEXED"))
    return joined.select("node_id", F.coalesce("__there", F.lit(False)).alias("present"), F.coalesce(known("own_status"), known("sync_status"), F.when(F.col("__there"), F.lit("INDEXED")), F.lit("PENDING")).alias("status"))


def outcomes(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    """How many of each outcome: the counters of a job or a stream."""
    return rows.groupBy(outcome).agg(F.count("*").alias("n"))


def exists(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Each wanted key and whether any row has it."""
    there = rows.select(key).distinct().withColumn("present", F.lit(True))
    return wanted.select(key).distinct().join(there, key, "left").select(key, F.coalesce("present", F.lit(False)).alias("present"))


def job_counters(outcomes_: DataFrame) -> DataFrame:
    """job, discovered, ingested, synced, skipped, failed and state of batch jobs, from each node's outcome.

    outcomes_: job, outcome (created, updated, acl_only, kept, failed, or null while a node waits) and error.
    A job whose every node failed has failed; one with waiting nodes runs; else it is complete.
    """
    of = lambda *names: F.count(F.when(F.col("outcome").isin(*names), 1))
    counted = outcomes_.groupBy("job").agg(
        F.count("*").alias("discovered"), of("created", "updated").alias("ingested"), of("created", "updated", "acl_only").alias("synced"), of("kept", "acl_only").alias("skipped"), of("failed").alias("failed"), F.count(F.when(F.col("outcome").isNull(), 1)).alias("waiting"),
    )
    state = F.when(F.col("waiting") > 0, "RUNNING").when(F.col("failed") == F.col("discovered"), "FAILED").otherwise("COMPLETED")
    return counted.withColumn("state", state)


def last_jobs(jobs: DataFrame, most: int = 100) -> DataFrame:
    """The jobs (job, started) begun last: older ones are forgotten."""
    return jobs.orderBy(F.desc("started"), F.desc("job")).limit(most)


def poll_metrics(polls: DataFrame) -> DataFrame:
    """source, polls, events by outcome, the longest poll and the cursor's lag, in seconds.

    polls: source, began, ended, cursor, processed, failed and skipped of each poll.
    """
    seconds = lambda a, b: F.unix_micros(F.col(b).cast("timestamp")) / 1e6 - F.unix_micros(F.col(a).cast("timestamp")) / 1e6
    last = F.max_by(F.struct("ended", "cursor"), F.struct("ended", "cursor"))
    counted = polls.groupBy("source").agg(
        F.count("*").alias("polls"), F.sum("processed").alias("processed"), F.sum("failed").alias("failed"), F.sum("skipped").alias("skipped"),
        F.max(seconds("began", "ended")).alias("longest"), last.alias("last"),
    )
    lag = F.unix_micros(F.col("last.ended").cast("timestamp")) / 1e6 - F.unix_micros(F.col("last.cursor").cast("timestamp")) / 1e6
    return counted.withColumn("lag", lag).drop("last")


def relevance(hits: DataFrame, min_score: float, min_hits: int = 1) -> DataFrame:
    """RELEVANT where enough hits (one at least) reach the score, else WEAK; by query."""
    enough = F.count(F.when(F.col("score") >= min_score, 1))
    return hits.groupBy("q").agg(enough.alias("good"), F.when(enough >= max(1, min_hits), "RELEVANT").otherwise("WEAK").alias("verdict"))


def merge_acl_requests(requests: DataFrame) -> DataFrame:
    """One request a node: recursive if any was, the reason of the first."""
    return requests.groupBy("node_id").agg(F.max("recursive").alias("recursive"), F.min_by("reason", "seq").alias("reason"))
