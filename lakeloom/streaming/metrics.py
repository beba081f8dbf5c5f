"""What running queries say of themselves: counters of rows as they pass, and the progress of streams."""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

POLLS = "source string, batch long, began timestamp, ended timestamp, cursor timestamp, received long, counts map<string,long>"


def counters(outcome: Column, names: tuple[str, ...]) -> list[Column]:
    """Aggregates of rows as they pass: all, and those of each outcome."""
    return [F.count(F.lit(1)).alias("received"), *[F.count(F.when(outcome == n, 1)).alias(n) for n in names]]


def counted(frame: DataFrame, outcome: Column, names: tuple[str, ...]) -> tuple[DataFrame, Observation]:
    """A batch frame that counts its rows while it is written, and what they are counted in; no second pass."""
    seen = Observation()
    return frame.observe(seen, *counters(outcome, names)), seen


def counted_stream(frame: DataFrame, name: str, outcome: Column, names: tuple[str, ...]) -> DataFrame:
    """A stream that counts its rows under a name, for a Progress of that name."""
    return frame.observe(name, *counters(outcome, names))


@dataclass
class Poll:
    source: str
    batch: int
    began: datetime
    ended: datetime
    cursor: datetime | None
    received: int
    counts: dict[str, int] = field(default_factory=dict)


def _cursor(end_offset: str | None) -> datetime | None:
    """The time in a place of the audit log; None for other sources."""
    try:
        place = json.loads(end_offset or "null")
        return datetime.fromtimestamp(place["logDate"] / 1_000_000, UTC) if place["logDate"] >= 0 else None
    except (TypeError, KeyError, ValueError):
        return None


class Progress(StreamingQueryListener):
    """Keeps a row for each micro-batch of the streams that count under its name: its times, cursor and counters.

    A batch that is run again replaces its former row. The last `most` batches are kept.
    """

    def __init__(self, name: str, most: int = 10_000):
        self.name, self.most = name, most
        self._polls: dict[tuple[str, int], Poll] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _end(self, run: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        said = event.progress
        row = (said.observedMetrics or {}).get(self.name)
        if row is None:
            return
        counts = {k: v for k, v in row.asDict().items() if v is not None}
        began = datetime.fromisoformat(said.timestamp.replace("Z", "+00:00"))
        took = (said.durationMs or {}).get("triggerExecution", 0)
        cursors = [c for c in (_cursor(s.endOffset) for s in said.sources) if c]
        poll = Poll(self.name, said.batchId, began, datetime.fromtimestamp(began.timestamp() + took / 1000, UTC), max(cursors, default=None), counts.pop("received", 0), counts)
        with self._lock:
            self._polls[str(said.id), said.batchId] = poll
            while len(self._polls) > self.most:
                self._polls.pop(next(iter(self._polls)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all that an ended query has to say is here."""
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError(f"no end of {query.runId} was told")

    def polls(self, spark: SparkSession) -> DataFrame:
        """A row for each batch, as operators.status.poll_metrics and the totals below take it."""
        with self._lock:
            rows = [(p.source, p.batch, p.began, p.ended, p.cursor, p.received, p.counts) for p in self._polls.values()]
        return spark.createDataFrame(rows, POLLS)

    def totals(self) -> dict[str, int]:
        with self._lock:
            out: dict[str, int] = {}
            for p in self._polls.values():
                for name, n in (("received", p.received), *p.counts.items()):
                    out[name] = out.get(name, 0) + n
            return out


def poll_report(polls: DataFrame) -> DataFrame:
    """source, polls, received, the longest poll and the cursor's lag behind the end of the last one, in seconds."""
    seconds = lambda c: F.unix_micros(c) / 1e6
    last = F.max_by(F.struct("ended", "cursor"), F.struct("ended", "batch"))
    rows = polls.groupBy("source").agg(F.count("*").alias("polls"), F.sum("received").alias("received"), F.max(seconds(F.col("ended")) - seconds(F.col("began"))).alias("longest"), last.alias("last"))
    return rows.withColumn("lag", seconds(F.col("last.ended")) - seconds(F.col("last.cursor"))).drop("last")
