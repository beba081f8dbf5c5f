"""The audit source: row groups as partitions, pages from statistics, the cursor."""

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakeloom.sources import audit

DAY = datetime(2024, 1, 1)


def log(ids, hours):
    return pa.table({"id": pa.array(ids, pa.int64()), "event_id": pa.array(["documentCreated"] * len(ids)), "node_id": pa.array(ids, pa.int64()), "log_date": pa.array([DAY + timedelta(hours=h) for h in hours], pa.timestamp("us"))})


def rows_of(reader, start, end):
    return [i for p in reader.partitions(start, end) for b in reader.read(p) for i in b.column("id").to_pylist()]


def polled(reader):
    """All batches until nothing comes: their ids and how many partitions each had."""
    out, start = [], reader.initialOffset()
    while (end := reader.latestOffset()) != start:
        out.append((sorted(rows_of(reader, start, end)), len(reader.partitions(start, end))))
        start = end
    return out


def test_a_row_group_is_a_partition(tmp_path):
    pq.write_table(log(range(100), range(100)), f"{tmp_path}/a.parquet", row_group_size=10)
    reader = audit.AuditReader({"path": str(tmp_path), "page": "1000000"})
    (ids, parts), = polled(reader)
    assert ids == list(range(100)) and parts == 10


@pytest.mark.parametrize("page", [1, 15, 40])
def test_pages_are_read_once_and_whole(tmp_path, page):
    """Files in disorder, equal times across files and row groups, and hidden files."""
    hours = [k // 3 for k in range(90)]
    order = list(range(90))[::-1]
    pq.write_table(log(order[::2], [hours[k] for k in order[::2]]), f"{tmp_path}/a.parquet", row_group_size=7)
    pq.write_table(log(order[1::2], [hours[k] for k in order[1::2]]), f"{tmp_path}/b.parquet", row_group_size=11)
    pq.write_table(log([999], [5]), f"{tmp_path}/_c.parquet")
    batches = polled(audit.AuditReader({"path": str(tmp_path), "page": str(page)}))
    assert sorted(i for ids, _ in batches for i in ids) == list(range(90))
    times = [{hours[i] for i in ids} for ids, _ in batches]
    assert all(max(a) < min(b) for a, b in zip(times, times[1:])) and (len(batches) > 1 or page == 40)


def test_the_start_and_late_entries_of_a_time(tmp_path):
    pq.write_table(log([1, 2, 3], [1, 2, 3]), f"{tmp_path}/a.parquet")
    start = int((DAY + timedelta(hours=1)).timestamp() * 0) + 1_704_070_800_000_000
    reader = audit.AuditReader({"path": str(tmp_path), "start": str(start)})
    first = reader.latestOffset()
    # the start's own time comes again, as no id is known of it
    assert rows_of(reader, reader.initialOffset(), first) == [1, 2, 3]
    pq.write_table(log([4, 5], [3, 4]), f"{tmp_path}/b.parquet")
    second = reader.latestOffset()
    assert rows_of(reader, first, second) == [4, 5] and reader.latestOffset() == second and reader.partitions(second, second) == []


def test_nothing_there(tmp_path):
    reader = audit.AuditReader({"path": str(tmp_path)})
    assert reader.latestOffset() == reader.initialOffset()


def test_tasks_and_a_restart(spark, tmp_path):
    """As many tasks as row groups, and a stream that goes on from its checkpoint."""
    audit.register(spark)
    (tmp_path / "in").mkdir()
    pq.write_table(log(range(120), range(120)), f"{tmp_path}/in/a.parquet", row_group_size=20)
    seen = []

    def keep(batch, number):
        seen.append((batch.rdd.getNumPartitions(), sorted(r["id"] for r in batch.collect())))

    def run():
        query = spark.readStream.format("audit_log").option("path", f"{tmp_path}/in").load().writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    assert [ids for _, ids in seen if ids] == [list(range(120))] and max(n for n, _ in seen) == 6
    pq.write_table(log([200, 201], [119, 130]), f"{tmp_path}/in/b.parquet")
    run()
    assert [ids for _, ids in seen if ids][1:] == [[200, 201]]
