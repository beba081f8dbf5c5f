"""An audit log as a stream source that keeps its place by (logDate, id).

The log is a folder of Parquet on any store that Spark's paths name. Row groups and their statistics are read on the
driver, rows only in tasks: a micro-batch has a partition for each row group that overlaps with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "id long, event_id string, node_id long, log_date timestamp"
FIELDS = ("id", "event_id", "node_id", "log_date")
#: A time after all others, in microseconds, and the largest id.
EVER, LAST_ID = 1 << 62, (1 << 63) - 1


class Part(InputPartition):
    """A row group's entries after one place and up to another, both in microseconds and ids."""

    def __init__(self, file: str, group: int, after: dict, upto: dict):
        self.file, self.group, self.after, self.upto = file, group, after, upto


def _times(column: pa.ChunkedArray | pa.Array) -> pa.ChunkedArray | pa.Array:
    return pc.cast(column, pa.timestamp("us")).cast(pa.int64())


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it: local ones are taken as they are, others by their scheme."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path if scheme else path
    return pafs.FileSystem.from_uri(path)


class RowGroup(NamedTuple):
    """Where rows are, how many, the range of their times and their largest id."""

    file: str
    number: int
    rows: int
    low: int
    high: int
    last_id: int


class RowGroups:
    """The row groups of the log. Files are never changed once written, so a poll opens the footers of new ones alone."""

    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, list[RowGroup]] = {}

    def __getstate__(self) -> dict:
        return {"path": self.path, "known": {}}  # tasks are told their row groups

    @staticmethod
    def _footer(store: pafs.FileSystem, file: str) -> list[RowGroup]:
        meta = pq.ParquetFile(file, filesystem=store).metadata
        out = []
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            stats = {c.path_in_schema: c.statistics for c in map(group.column, range(group.num_columns))}
            times, ids = stats["log_date"], stats["id"]
            low, high = (_times(pa.array([times.min, times.max])).to_pylist()) if times is not None and times.has_min_max else (-EVER, EVER)
            out.append(RowGroup(file, g, group.num_rows, low, high, ids.max if ids is not None and ids.has_min_max else LAST_ID))
        return out

    def all(self) -> list[RowGroup]:
        store, root = open_store(self.path)
        files = store.get_file_info(pafs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == pafs.FileType.Directory else [store.get_file_info(root)]
        for f in files:
            hidden = any(part[0] in "._" for part in f.path[len(root) :].split("/") if part)
            if f.is_file and not hidden and f.path.endswith(".parquet") and f.path not in self.known:
                self.known[f.path] = self._footer(store, f.path)
        return [g for groups in self.known.values() for g in groups]


def _within(times, ids, after: dict, upto: dict):
    later = pc.or_(pc.greater(times, after["logDate"]), pc.and_(pc.equal(times, after["logDate"]), pc.greater(ids, after["id"])))
    before = pc.or_(pc.less(times, upto["logDate"]), pc.and_(pc.equal(times, upto["logDate"]), pc.less_equal(ids, upto["id"])))
    return pc.and_(later, before)


class AuditReader(DataSourceStreamReader):
    """Places are {"logDate": microseconds, "id": number}. The end is fixed once for each micro-batch.

    Options: path (Parquet of id, event_id, node_id, log_date), page (about so many entries in a batch) and start (microseconds;
    the first poll begins behind it).
    """

    def __init__(self, options: dict):
        self.groups = RowGroups(options["path"])
        self.path = options["path"]
        self.page = int(options.get("page", 1_000_000))
        self.start = {"logDate": int(options.get("start", -1)), "id": -1}
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        """About one page behind the last place, from statistics alone; a failed poll moves nothing.

        Row groups that reach behind the place are taken by their last times until they hold a page; the batch ends at the
        last of those times, so that none cuts through a time. Its id is the largest one known: of that time nothing
        that is there is left, and what is logged later has a larger id.
        """
        place = self.at or self.start
        groups = self.groups.all()
        rows, end = 0, None
        for g in sorted(groups, key=lambda g: g.high):
            if g.high < place["logDate"] or (g.high == place["logDate"] and g.last_id <= place["id"]):
                continue
            if end is not None and rows >= self.page and g.high > end:
                break
            rows, end = rows + g.rows, g.high
        if end is not None:
            last = max(g.last_id for g in groups if g.low <= end)
            place = {"logDate": end, "id": max(last, place["id"]) if end == place["logDate"] else last}
        self.at = place
        return place

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """A partition for each row group that overlaps with the batch."""
        if start == end:
            return []
        return [Part(g.file, g.number, start, end) for g in self.groups.all() if g.high >= start["logDate"] and g.low <= end["logDate"]]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        found = pq.ParquetFile(partition.file, filesystem=store)
        for b in found.iter_batches(row_groups=[partition.group], columns=list(FIELDS)):
            kept = b.filter(_within(_times(b.column("log_date")), b.column("id"), partition.after, partition.upto))
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("event_id"), kept.column("node_id"), pc.cast(pc.cast(kept.column("log_date"), pa.timestamp("us")), pa.timestamp("us", "UTC"))], names=list(FIELDS))

    def commit(self, end: dict) -> None:
        pass


class AuditLog(DataSource):
    """`spark.readStream.format("audit_log").option("path", ...)`; the checkpoint keeps the cursor."""

    @classmethod
    def name(cls) -> str:
        return "audit_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> AuditReader:
        return AuditReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AuditLog)
