"""A stream's state is kept by groups of keys: its rows, and so the calls of Python, don't grow with the keys."""

from datetime import timedelta

from pyspark.sql import functions as F

from lakeloom.streaming import events as E


def test_states_are_those_of_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "GROUPS", 8, raising=False)
    rows = spark.range(600).select(F.col("id").alias("event_id"), F.lit("x").alias("event_type"), (F.col("id") % 300).alias("node_id"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    kept = E.drop_repeats_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), timedelta(seconds=301))
    query = E.run_available(kept, lambda batch, number: batch.write.parquet(f"{tmp_path}/out/batch={number}"), f"{tmp_path}/checkpoint")
    assert {r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == set(range(300))
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 8
