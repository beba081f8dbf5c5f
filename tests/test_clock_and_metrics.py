"""Streams by the time of arrival, metrics of running queries, and the closure of parents."""

import random
import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.plans import flow
from lakeloom.sources import nodes as N
from lakeloom.streaming import events as E
from lakeloom.streaming import metrics

NOON = datetime(2024, 1, 1, 12)


def fed(spark, tmp_path, schema, batches, make):
    """A stream of given micro-batches, and all that it gave."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    out, done = [], threading.Event()

    def keep(batch, number):
        out.extend(batch.collect())
        if number + 1 >= len(batches):
            done.set()

    # state by the clock keeps a stream busy, so it never runs dry
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start()
    try:
        assert done.wait(90)
    finally:
        query.stop()
    return out


def at(**length):
    return NOON + timedelta(**length)


def test_repeats_go_for_exactly_two_minutes(spark, tmp_path):
    """The clock is a column; the events' own times say something else."""
    old = datetime(2020, 1, 1)
    batches = [
        [(1, "t", "n", old, at()), (2, "t", "n", old, at(seconds=1)), (3, "u", "n", old, at()), (4, "t", None, old, at()), (5, "t", " ", old, at())],
        [(6, "t", "n", old, at(seconds=119, microseconds=999_999)), (7, "t", " ", old, at(seconds=2))],
        [(8, "t", "n", old, at(seconds=120)), (9, None, "n", old, at(seconds=120)), (10, None, "n", old, at(seconds=121))],
        [(11, "t", "n", old, at(seconds=239)), (12, "t", "n", old, at(seconds=240))],
    ]
    got = fed(spark, tmp_path, "event_id int, event_type string, node_id string, ts timestamp, clock timestamp", batches, lambda s: E.drop_repeats_arriving(s, timedelta(minutes=2), F.col("clock")))
    assert sorted(r["event_id"] for r in got) == [1, 3, 4, 5, 7, 8, 9, 12]


def test_of_what_arrives_together_one_is_kept(spark, tmp_path):
    batches = [[(k, "t", f"n{k % 3}", NOON) for k in range(30)]] * 2
    got = fed(spark, tmp_path, "event_id int, event_type string, node_id string, ts timestamp", batches, lambda s: E.drop_repeats_arriving(s, timedelta(minutes=2)))
    assert sorted(r["event_id"] for r in got) == [0, 1, 2]


def test_a_session_ends_after_thirty_minutes(spark, tmp_path):
    old = datetime(2020, 1, 1)
    turn = lambda k, role, text, **length: (k, "s", old, role, text, at(**length))
    batches = [
        [turn(1, "user", "one"), turn(2, "assistant", "two", minutes=10)],
        [turn(3, "user", "three", minutes=40)],  # exactly thirty minutes later
        [turn(4, "user", " ", minutes=70)],  # blank, but an access
        [turn(5, "user", "four", minutes=100), turn(6, "user", "five", minutes=130, microseconds=1)],
    ]
    got = fed(spark, tmp_path, "seq int, session string, ts timestamp, role string, text string, clock timestamp", batches, lambda s: E.memory_arriving(s, arrived=F.col("clock")))
    assert {r["seq"]: r["held"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 6: 1}
    assert next(r["block"] for r in got if r["seq"] == 3) == "User: one\nAssistant: two\nUser: three"


@pytest.mark.parametrize("seed", range(5))
def test_jumps_accept_what_single_steps_do(seed):
    rng = np.random.default_rng(seed)
    times = np.sort(np.datetime64("2024-01-01", "us") + rng.integers(0, 4_000, 300).astype("timedelta64[s]"))
    window = timedelta(seconds=int(rng.integers(0, 90)))
    last = None if seed % 2 else times[0] - np.timedelta64(10, "s")
    import pandas as pd

    want = E.accepted([pd.Timestamp(t) for t in times], window, None if last is None else pd.Timestamp(last))
    assert E.jumps(times, window, last) == [k for k, w in enumerate(want) if w]


def test_batch_counters_equal_a_recount(spark, tmp_path):
    frame = spark.range(1000).withColumn("outcome", F.when(F.col("id") % 3 == 0, "created").when(F.col("id") % 3 == 1, "failed"))
    told, seen = metrics.counted(frame, F.col("outcome"), ("created", "failed"))
    told.write.parquet(f"{tmp_path}/out")
    again = spark.read.parquet(f"{tmp_path}/out")
    assert seen.get == {"received": 1000, "created": again.where("outcome = 'created'").count(), "failed": again.where("outcome = 'failed'").count()}


def test_stream_progress_has_times_and_cursor(spark, sf, tmp_path):
    from lakeloom.sources import audit

    audit.register(spark)
    log = flow.audit_log(spark, sf).withColumn("log_date", F.col("log_date").cast("timestamp_ntz"))
    log.repartitionByRange(6, "log_date").sortWithinPartitions("log_date").write.parquet(f"{tmp_path}/in")
    progress = metrics.Progress("p")
    spark.streams.addListener(progress)
    try:
        stream = metrics.counted_stream(spark.readStream.format("audit_log").option("path", f"{tmp_path}/in").option("page", 200).load(), "p", F.col("event_id"), ("other",))
        running = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
        running.processAllAvailable()
        running.stop()
        progress.wait(running)
    finally:
        spark.streams.removeListener(progress)
    polls = progress.polls(spark).where("received > 0")
    written = spark.read.parquet(f"{tmp_path}/out")
    assert polls.count() > 2 and progress.totals() == {"received": written.count(), "other": written.where("event_id = 'other'").count()}
    last = written.agg(F.max("log_date")).first()[0]
    assert polls.agg(F.max("cursor")).first()[0] == last
    report = metrics.poll_report(polls).first()
    end = polls.agg(F.max("ended")).first()[0]
    assert report["received"] == written.count() and report["longest"] > 0 and abs(report["lag"] - (end - last).total_seconds()) < 0.01


def below_by_force(pairs, root, depth=None):
    out, level, n = set(), {root}, 0
    while level and n != depth:
        level = {c for c, p in pairs if p in level} - out - {root}
        out |= level
        n += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_parents(spark, seed):
    """Forests with cycles, missing parents and a hot folder."""
    rng = random.Random(seed)
    pairs = [(f"n{k}", rng.choice([f"n{rng.randrange(60)}", f"n{max(0, k - 1)}", "n3", None, "gone"])) for k in range(60)]
    nodes = spark.createDataFrame(pairs, "node_id string, parent_id string")
    for root, depth in (("n0", None), ("n3", None), ("n3", 2), ("gone", None), ("nobody", None)):
        assert {r["node_id"] for r in N.tree(nodes, root, depth).collect()} == below_by_force(pairs, root, depth)


def test_a_chain_of_a_thousand_levels_takes_few_rounds(spark, monkeypatch):
    from lakeloom.session import Scratch

    saved = []
    plain = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, name, frame: saved.append(name) or plain(self, name, frame))
    nodes = spark.createDataFrame([(k, k - 1) for k in range(1, 1001)], "node_id long, parent_id long").repartition(4)
    assert N.tree(nodes, 0).count() == 1000 and len(saved) <= 12
    assert N.tree(nodes, 0, 17).count() == 17
