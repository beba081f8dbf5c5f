"""Event streams: routing, deduplication, audit logs, sessions.

Each function on events works on batch and streaming frames alike unless it says otherwise.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from datetime import timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lakeloom.functions.paths import ancestor_paths, matches_glob
from lakeloom.functions.text import is_blank
from lakeloom.operators import ingest
from lakeloom.operators.scope import any_of
from lakeloom.session import Scratch
from lakeloom.sources.committed import CommittedTable, Version

# What the audit log calls its events.
UPSERTS, DELETES, SECURITY = ("documentCreated", "documentModified"), ("documentTrashed", "documentRemoved"), ("documentSecurityUpdated",)


def route(event_id: Column, node_id: Column) -> Column:
    """upsert, acl, delete or skip."""
    kind = F.when(event_id.isin(*UPSERTS), "upsert").when(event_id.isin(*SECURITY), "acl").when(event_id.isin(*DELETES), "delete").otherwise("skip")
    return F.when(is_blank(node_id), "skip").otherwise(kind)


def decide(kind: Column, present: Column, is_folder: Column, in_scope: Column) -> Column:
    """What to do with a routed event, given the node as it is now."""
    live = F.when(~present, "delete").when(is_folder, "subtree").when(~in_scope, "delete")
    return F.when(kind == "delete", "delete").when(kind == "upsert", live.otherwise("sync")).when(kind == "acl", live.otherwise("update_acl")).otherwise("skip")


def decide_live(kind: Column, present: Column, is_folder: Column, in_scope: Column, indexed: Column, excluded: Column) -> Column:
    """What to do about an event of a repository's topic (kind: state, delete, acl, scope), given the node as it is now.

    state: a node that is gone or out of scope is deleted, another synced. acl: a folder's subtree, unless
    it is excluded; a file out of scope is deleted. scope, of folders alone: out of scope, all below is
    torn down; marked itself, all below is synced; else nothing changes.
    """
    acl = F.when(~present, "filtered").when(is_folder, F.when(excluded, "filtered").otherwise("acl_subtree")).when(in_scope, "update_acl").otherwise("delete")
    scope = F.when(~present | ~is_folder, "filtered").when(~in_scope, "tear_down").when(indexed, F.when(excluded, "filtered").otherwise("sync_subtree")).otherwise("filtered")
    state = F.when(present & in_scope, "sync").otherwise("delete")
    return F.when(kind == "delete", "delete").when(kind == "state", state).when(kind == "acl", acl).when(kind == "scope", scope).otherwise("filtered")


def live_decisions(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """events (event_id, kind, node_id, at) with the node's path and `decision`: one join by node.

    nodes: node_id, path, is_folder, in_scope, indexed (marked itself), excluded (itself or an ancestor).
    Events without a node id are filtered.
    """
    joined = events.join(nodes.withColumn("__present", F.lit(True)), "node_id", "left")
    sure = lambda c: F.coalesce(F.col(c), F.lit(False))
    made = decide_live(F.col("kind"), sure("__present"), sure("is_folder"), sure("in_scope"), sure("indexed"), sure("excluded"))
    return joined.select("event_id", "kind", "node_id", "at", "path", F.when(is_blank(F.col("node_id").cast("string")), "filtered").otherwise(made).alias("decision"))


SUBTREES = ("sync_subtree", "acl_subtree", "tear_down")


def live_effects(decisions: DataFrame, nodes: DataFrame, excluded_globs: tuple[str, ...] = ()) -> DataFrame:
    """node_id, event_id, at and action: what each decision does to each node (sync, update_acl, delete or skip).

    A decision about a subtree reaches the files below the folder that can be found: not those that are `hidden`
    (marked as excluded themselves, or of an excluded aspect). Whoever decides has looked at the folder, so no file's
    own scope is asked again: files of excluded paths are skipped, those that are excluded by a folder in between too where
    all is synced, but not where access alone changes; the others are synced or get their access. A tear-down deletes
    all that can be found.

    Of a folder's decisions of a kind the last one counts, as the others do the same before it; so a row comes
    out for each file, folder above it and kind, however many events there are.
    """
    one = decisions.where(F.col("decision").isin("sync", "update_acl", "delete")).select("node_id", "event_id", "at", F.col("decision").alias("action"))
    last = decisions.where(F.col("decision").isin(*SUBTREES)).groupBy(F.col("path").alias("__at"), "decision").agg(F.max(F.struct("at", "event_id")).alias("__last"))
    found = ~F.col("hidden") if "hidden" in nodes.columns else F.lit(True)
    below = nodes.where(~F.col("is_folder") & found).withColumn("__at", F.explode(ancestor_paths(F.col("path")))).join(last, "__at")
    passed = any_of(*[matches_glob(F.col("path"), g) for g in excluded_globs])
    synced = F.when(passed | F.col("excluded"), "skip").otherwise("sync")
    shared = F.when(passed, "skip").otherwise("update_acl")
    action = F.when(F.col("decision") == "tear_down", "delete").when(F.col("decision") == "sync_subtree", synced).otherwise(shared)
    return one.unionByName(below.select("node_id", "__last.event_id", "__last.at", action.alias("action")))


def last_actions(effects: DataFrame) -> DataFrame:
    """node_id, at and action: what is left to do to each node, the last of its actions that isn't a skip.

    An access change after a sync or before one is part of it.
    """
    real = effects.where("action <> 'skip'")
    last = real.groupBy("node_id").agg(F.max(F.struct("at", "event_id", "action")).alias("last"), F.max(F.when(F.col("action") != "update_acl", F.struct("at", "event_id", "action"))).alias("whole"))
    action = F.when((F.col("last.action") == "update_acl") & (F.col("whole.action") == "sync"), "sync").otherwise(F.col("last.action"))
    return last.select("node_id", "last.at", action.alias("action"))


def node_steps(effects: DataFrame) -> DataFrame:
    """One row a node: the five steps that leave a stored document as all its effects in turn would.

    deleted_before (time of the latest deletion before the last sync), synced, shared_before (access changed between that and
    the last deletion), deleted_after (time of the latest deletion behind the last sync) and shared_after. Nodes are as they are
    now, so syncs before the last one and access changes before it leave no trace.
    """
    real = effects.where("action <> 'skip'").select("node_id", "action", "at", F.struct("at", "event_id").alias("place"))
    last = real.groupBy(F.col("node_id").alias("__node")).agg(F.max(F.when(F.col("action") == "sync", F.col("place"))).alias("__sync"), F.max(F.when(F.col("action") == "delete", F.col("place"))).alias("__delete"))
    joined = real.join(last, F.col("node_id") == F.col("__node"))
    behind = F.col("__sync").isNull() | (F.col("place") > F.col("__sync"))
    gone, shared = F.col("action") == "delete", (F.col("action") == "update_acl") & behind
    return joined.groupBy("node_id").agg(
        F.max(F.when(gone & ~behind, F.col("at"))).alias("deleted_before"),
        F.bool_or(F.col("action") == "sync").alias("synced"),
        F.bool_or(F.coalesce(shared & (F.col("place") < F.col("__delete")), F.lit(False))).alias("shared_before"),
        F.max(F.when(gone & behind, F.col("at"))).alias("deleted_after"),
        F.bool_or(shared & (F.col("__delete").isNull() | (F.col("place") > F.col("__delete")))).alias("shared_after"),
    )


def apply_steps(stored: DataFrame, steps: DataFrame, nodes: DataFrame, modified: str, acl: tuple[str, ...]) -> DataFrame:
    """The stored documents (node_id, `modified`, access and other columns) after node_steps, nodes being the source's rows.

    Syncs and deletions are guarded by times: a document stored strictly after a deletion stays.
    """
    gone = lambda rows, c: ingest.delete(rows, steps.where(F.col(c).isNotNull()).select("node_id", F.col(c).alias("deleted_at")), "node_id", modified)
    of = lambda c: nodes.join(steps.where(F.col(c)).select("node_id"), "node_id", "left_semi")
    out = ingest.sync(gone(stored, "deleted_before"), of("synced"), "node_id", modified, acl).drop("outcome")
    out = gone(ingest.update_acl(out, of("shared_before"), "node_id", acl), "deleted_after")
    return ingest.update_acl(out, of("shared_after"), "node_id", acl)


def apply_actions(stored: DataFrame, actions: DataFrame, nodes: DataFrame, modified: str, acl: tuple[str, ...]) -> DataFrame:
    """The stored documents after last_actions: as apply_steps, where nothing but the last action is known."""
    is_ = lambda name: F.col("action") == name
    never = F.when(F.lit(False), F.col("at"))
    steps = actions.select("node_id", never.alias("deleted_before"), is_("sync").alias("synced"), F.lit(False).alias("shared_before"), F.when(is_("delete"), F.col("at")).alias("deleted_after"), is_("update_acl").alias("shared_after"))
    return apply_steps(stored, steps, nodes, modified, acl)


def apply_live_batch(table: CommittedTable, events: DataFrame, nodes: DataFrame, modified: str, acl: tuple[str, ...], excluded_globs: tuple[str, ...] = (), batch: tuple[str, int] | None = None) -> Version:
    """A batch of live events, committed to a table of documents keyed by node_id as one version.

    nodes: the source as it is now, with node_id, path, is_folder, in_scope, indexed, excluded, perhaps hidden, and the
    documents' columns. Steps are written before the merge, as several of its parts read them.
    """
    version = table.version()
    if batch and version.batches.get(batch[0], -1) >= batch[1]:
        return version
    scratch = Scratch(table.spark, "live")
    steps = scratch.save("steps", node_steps(live_effects(live_decisions(events, nodes), nodes, excluded_globs)))
    stored_columns = StructType.fromJson(json.loads(version.schema)).fieldNames()
    source = nodes.select(*dict.fromkeys([*stored_columns, "is_folder"]))
    try:
        return table.change(steps, lambda stored: apply_steps(stored, steps, source.join(steps.select("node_id"), "node_id", "left_semi"), modified, acl), "live", batch)
    finally:
        scratch.drop("steps")


def live_stream(events: DataFrame, table: CommittedTable, nodes: Callable[[], DataFrame], modified: str, acl: tuple[str, ...], checkpoint: str, name: str = "live", excluded_globs: tuple[str, ...] = ()) -> StreamingQuery:
    """A topic of live events (event_id, kind, node_id, at) followed into a table of documents.

    Each micro-batch is joined with the source as `nodes` reads it at that time, and committed under the stream's name and the
    batch's number: one that is run again after a failure between commit and checkpoint changes nothing, so the table
    holds each event's effect exactly once. All that is there is processed; start it again for what comes.
    """
    return run_available(events, lambda batch, number: apply_live_batch(table, batch, nodes(), modified, acl, excluded_globs, (name, number)), checkpoint)


def live_counters(decisions: DataFrame) -> DataFrame:
    """kind, received, filtered and processed: nodes found out of scope count as filtered, though they are deleted."""
    gone = (F.col("decision") == "delete") & F.col("path").isNotNull() & (F.col("kind") != "delete")
    left = (F.col("decision") == "filtered") | gone
    return decisions.groupBy("kind").agg(F.count("*").alias("received"), F.count(F.when(left, 1)).alias("filtered"), F.count(F.when(~left, 1)).alias("processed"))


def event_time(*times: Column) -> Column:
    """The first known of a node's, a resource's and the event's time."""
    return F.coalesce(*times)


def audit_page(log: DataFrame, last_date: str, last_id: int, window_end: str, most: int | None = None) -> DataFrame:
    """Entries after the cursor (date, id) up to the window's end, in that order: one page, or all."""
    rows = log.where(F.col("event_id").isin(*UPSERTS, *DELETES, *SECURITY))
    after = (F.col("log_date") > F.lit(last_date).cast("timestamp")) | ((F.col("log_date") == F.lit(last_date).cast("timestamp")) & (F.col("id") > last_id))
    rows = rows.where(after & (F.col("log_date") <= F.lit(window_end).cast("timestamp")))
    return rows if most is None else rows.orderBy("log_date", "id").limit(most)


def next_cursor(page: DataFrame) -> DataFrame:
    """The last (log_date, id) of a page: failed entries move it too; no row where nothing came."""
    return page.agg(F.max(F.struct("log_date", "id")).alias("c")).where("c is not null").select("c.log_date", "c.id")


def accepted(times: list[pd.Timestamp], window: timedelta, last: pd.Timestamp | None = None) -> list[bool]:
    """Which of ascending times are no repeats: those at least `window` after the last one kept."""
    out = []
    for t in times:
        fresh = last is None or window <= timedelta(0) or t >= last + window
        out.append(fresh)
        last = t if fresh else last
    return out


def jumps(times: np.ndarray, window: timedelta, last: np.datetime64 | None = None) -> list[int]:
    """Places of the accepted ones of ascending times: from each to the first that is out of its window."""
    step = np.timedelta64(int(window.total_seconds() * 1_000_000), "us")
    if window <= timedelta(0):
        return list(range(len(times)))
    out: list[int] = []
    at = 0 if last is None else int(np.searchsorted(times, last + step))
    while at < len(times):
        out.append(at)
        at = int(np.searchsorted(times, times[at] + step))
    return out


def drop_repeats(events: DataFrame, window: timedelta) -> DataFrame:
    """Batch: events (event_type, node_id, ts, event_id) without those within the window of the last kept of their key.

    A null node is never a repeat. One key's events are folded in order in one task, in bounded batches.
    """

    keyed = events.where("node_id is not null").repartition("event_type", "node_id").sortWithinPartitions("event_type", "node_id", "ts", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for b in batches:
            kept = []
            for k, rows in b.groupby(["event_type", "node_id"], sort=False, dropna=False).indices.items():
                # sorted by key: only the one that a batch ends with goes on
                last = last if k == key else None
                key = k
                times = b["ts"].to_numpy()[rows]
                fresh = jumps(times, window, last)
                kept += [rows[i] for i in fresh]
                last = times[fresh[-1]] if fresh else last
            yield b.iloc[sorted(kept)]

    return keyed.mapInPandas(fold, events.schema).unionByName(events.where("node_id is null"))


def _millis(t: pd.Timestamp) -> int:
    return int(t.timestamp() * 1000)


def _keep_until(state: GroupState, moment: int) -> None:
    """State goes once the watermark has passed a moment (milliseconds)."""
    state.setTimeoutTimestamp(max(moment, state.getCurrentWatermarkMs() + 1))


#: Keys of a stream are dealt into so many groups, each with one state that holds its live keys: a call of Python for each key and batch
#: costs milliseconds.
GROUPS = 1_024


def _group(*keys: Column) -> Column:
    """The group of a key; null keys are apart, as pandas turns integers beside nulls into floats."""
    place = F.pmod(F.xxhash64(*keys), F.lit(GROUPS))
    return F.when(reduce(lambda a, b: a | b, [k.isNull() for k in keys]), -1 - place).otherwise(place)


def _live(state: GroupState, last: int) -> dict:
    """The keys of a group's state whose time, at place `last` of their values (milliseconds), the watermark hasn't passed."""
    passed = state.getCurrentWatermarkMs()
    return {k: v for k, v in pickle.loads(state.get[0]).items() if v[last] > passed} if state.exists else {}


def drop_repeats_stream(events: DataFrame, window: timedelta) -> DataFrame:
    """drop_repeats for a stream: the state of a group of keys is the time of each one's last event kept.

    A key goes from it once the watermark, `window` behind the latest event, has passed its window, and the state with the
    last of them; whatever comes then is no repeat. Events older than the last one kept are judged as repeats of it.
    """
    seconds = max(1, int(window.total_seconds()))
    step = int(window / timedelta(microseconds=1))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        held, kept = _live(state, 1), []
        named = [None if kind != kind else kind for kind in rows["event_type"].tolist()]
        for k, of in enumerate(zip(named, rows["node_id"].tolist(), rows["ts"].astype("datetime64[us]").astype("int64").tolist())):
            name, at = of[:2], of[2]
            last = held.get(name)
            if last is None or step <= 0 or at >= last[0] + step:
                kept.append(k)
                held[name] = (at, at // 1000 + 1000 * seconds)
        state.update((pickle.dumps(held),))
        _keep_until(state, max(until for _, until in held.values()))
        yield rows.iloc[kept][fields]

    fields = list(events.columns)
    known = events.where("node_id is not null").withWatermark("ts", f"{seconds} seconds").withColumn("__group", _group(F.col("event_type"), F.col("node_id")))
    kept = known.groupBy("__group").applyInPandasWithState(fold, events.schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.unionByName(events.where("node_id is null"))


ARRIVED = "__arrived"


def _arriving(rows: DataFrame, arrived: Column | None) -> DataFrame:
    return rows.withColumn(ARRIVED, (F.current_timestamp() if arrived is None else arrived).cast("timestamp"))


def _keep_for(state: GroupState, length: timedelta) -> None:
    """State goes once the machine's clock has gone on by a length, at the first batch after that."""
    state.setTimeoutDuration(max(1, int(length.total_seconds() * 1000)))


def drop_repeats_arriving(events: DataFrame, window: timedelta, arrived: Column | None = None) -> DataFrame:
    """A stream of events (event_type, node_id, event_id, ...) without those that arrive less than `window` after the last kept of their key,
    whatever times they bear.

    `arrived` is the clock: the time of the micro-batch unless it is given. At exactly `window` an event is kept. Events of
    a null or blank node are never repeats; a window of none keeps all. State goes by the machine's clock, whether or
    not events of any key come, and what is decided hangs on the times of arrival alone. As the clock alone can end state, such
    a stream never runs dry: give it a trigger of some seconds and stop it.
    """
    if window <= timedelta(0):
        return events
    fields = list(events.columns)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(batches).sort_values([ARRIVED, "event_id"])
        last = pd.Timestamp(state.get[0]) if state.exists else None
        keep = accepted(rows[ARRIVED].tolist(), window, last)
        if any(keep):
            last = rows[ARRIVED][keep].iloc[-1]
        state.update((last.to_pydatetime(),))
        _keep_for(state, max(timedelta(milliseconds=1), last + window - rows[ARRIVED].iloc[-1]))
        yield rows[keep][fields]

    named = ~is_blank(F.col("node_id").cast("string"))
    keyed = _arriving(events.where(named), arrived).withColumn("__kind", F.coalesce("event_type", F.lit("unknown"))).groupBy("__kind", "node_id")
    kept = keyed.applyInPandasWithState(fold, events.schema, "last timestamp", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return kept.unionByName(events.where(~named))


def memory_arriving(turns: DataFrame, most: int = 10, ttl: timedelta = timedelta(minutes=30), arrived: Column | None = None) -> DataFrame:
    """memory_stream by the time of arrival: a session that was left alone for longer than `ttl` by the clock begins anew; at exactly `ttl` it goes on.

    Turns that arrive together are taken by seq. State goes by the machine's clock.
    """
    fields = list(turns.columns)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(batches).sort_values([ARRIVED, "seq"])
        last, lines = (pd.Timestamp(state.get[0]), json.loads(state.get[1])) if state.exists else (None, [])
        held, blocks, last, lines = remembered(rows[ARRIVED], rows["role"], rows["text"], last, lines, most, ttl)
        state.update((last.to_pydatetime(), json.dumps(lines)))
        _keep_for(state, ttl + timedelta(milliseconds=1))
        yield rows[fields].assign(held=held, block=blocks)

    schema = StructType([*turns.schema.fields, StructField("held", IntegerType()), StructField("block", StringType())])
    return _arriving(turns, arrived).groupBy("session").applyInPandasWithState(fold, schema, "last timestamp, lines string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def remembered(times, roles, texts, last: pd.Timestamp | None, lines: list[str], most: int, ttl: timedelta) -> tuple[list[int], list[str], pd.Timestamp, list[str]]:
    """Turns in order, after a state of the last access and the lines held: how many are held after each, as what block, and the new state."""
    held, blocks = [], []
    for ts, role, text in zip(times, roles, texts):
        if role == "reset" or (last is not None and ts > last + ttl):
            lines = []
        if role != "reset" and text and text.strip():
            lines = [*lines, ("User: " if role == "user" else "Assistant: ") + text.strip()][-most:]
        last = ts if last is None else max(last, ts)
        held.append(len(lines))
        blocks.append("\n".join(lines))
    return held, blocks, last, lines


def memory_stream(turns: DataFrame, most: int = 10, ttl: timedelta = timedelta(minutes=30)) -> DataFrame:
    """Conversation memory of a stream of turns (session, ts, seq, role, text): a row for each with `held`, the turns
    remembered after it, and `block`, those as lines of User: and Assistant:.

    A session ends when it is left alone for longer than `ttl`; any access, also that of a blank turn,
    which isn't remembered, keeps it alive. The role "reset" empties it. The state of a group of sessions is the last `most`
    turns and the time of the last access of each; a session goes from it once the watermark has passed that by `ttl`.
    """
    schema = StructType([*turns.schema.fields, StructField("held", IntegerType()), StructField("block", StringType())])
    seconds = int(ttl.total_seconds())
    fields = list(turns.columns)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(batches).sort_values(["ts", "seq"])
        kept, places = _live(state, 2), {}
        for k, session in enumerate(rows["session"].tolist()):
            places.setdefault(None if session != session else session, []).append(k)
        times, roles, texts = rows["ts"].tolist(), rows["role"].tolist(), rows["text"].tolist()
        held, blocks = [0] * len(rows), [""] * len(rows)
        for session, at in places.items():
            last, lines, _ = kept.get(session, (None, [], 0))
            n, block, last, lines = remembered([times[k] for k in at], [roles[k] for k in at], [texts[k] for k in at], last, lines, most, ttl)
            for k, of, b in zip(at, n, block):
                held[k], blocks[k] = of, b
            kept[session] = (last, lines, _millis(last) + 1000 * seconds + 1)
        state.update((pickle.dumps(kept),))
        _keep_until(state, max(until for _, _, until in kept.values()))
        yield rows[fields].assign(held=held, block=blocks)

    timed = turns.withWatermark("ts", f"{max(1, seconds)} seconds").withColumn("__group", _group(F.col("session")))
    return timed.groupBy("__group").applyInPandasWithState(fold, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(turns: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, session begin, end and turns: a gap longer than the limit ends a session."""
    return turns.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("turns")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "turns")


def run_available(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there, micro-batch by micro-batch; the checkpoint is the cursor, moved after each batch (at least once)."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def subtree(folders: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (path, ...) strictly below any of the folders (path), each once: ancestors are joined by path."""
    reach = nodes.withColumn("__at", F.explode(ancestor_paths(F.col("path"))))
    return reach.join(folders.select(F.col("path").alias("__at")).distinct(), "__at", "left_semi").drop("__at").distinct()


def reconcile_subtree(folders: DataFrame, nodes: DataFrame, acl_only: bool = False) -> DataFrame:
    """What to do with each node (in_scope) below changed folders: sync or delete; if only access changed, update_acl or skip."""
    inside, outside = ("update_acl", "skip") if acl_only else ("sync", "delete")
    return subtree(folders, nodes).withColumn("outcome", F.when(F.col("in_scope"), inside).otherwise(outside))


def tear_down(folders: DataFrame, nodes: DataFrame) -> DataFrame:
    """All below folders that left the scope goes, and its status is cleared."""
    return subtree(folders, nodes).withColumn("outcome", F.lit("delete"))
