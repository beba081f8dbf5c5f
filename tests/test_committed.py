"""Committed tables, merges of repeated keys, and live events followed into a table."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import ingest
from lakeloom.sources.committed import CommittedTable, Conflict
from lakeloom.streaming import events as E

SCHEMA = "node_id string, modified_at timestamp, name string, acl string"
DAY = datetime(2024, 1, 1)


def at(n):
    return None if n is None else DAY + timedelta(hours=n)


def content(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture
def lake(spark, tmp_path):
    made = CommittedTable.create(spark, f"{tmp_path}/lake", SCHEMA, "node_id", 8)
    made.overwrite(spark.createDataFrame([(f"n{k}", at(k), "old", "x") for k in range(40)], SCHEMA))
    return made


def test_versions(spark, lake):
    assert lake.versions() == [1, 2] and lake.read(1).count() == 0 and lake.read().count() == 40
    before = lake.read()
    ingest.commit_sync(lake, spark.createDataFrame([("n3", at(50), "new", "y"), ("fresh", at(1), "new", "y"), ("n9", at(2), "new", "y")], SCHEMA), "modified_at", ("acl",))
    now = {r[0]: tuple(r)[2:] for r in lake.read().collect()}
    assert now["n3"] == ("new", "y") and now["fresh"] == ("new", "y") and now["n9"] == ("old", "y") and now["n4"] == ("old", "x") and len(now) == 41
    assert content(before) == content(lake.read(2))  # a reader stays on its version
    ingest.commit_delete(lake, spark.createDataFrame([("n3", at(49)), ("n4", at(49))], "node_id string, deleted_at timestamp"), "modified_at")
    assert {r[0] for r in lake.read().collect()} == set(now) - {"n4"}
    ingest.commit_acl(lake, spark.createDataFrame([("n5", at(1), "?", "z", False), ("folder", at(1), "?", "z", True)], SCHEMA + ", is_folder boolean"), ("acl",))
    assert {r["acl"] for r in lake.read().where("node_id in ('n5', 'folder')").collect()} == {"z"} and lake.read().count() == 40


def test_a_change_touches_only_the_buckets_of_its_keys(spark, lake):
    before = lake.version()
    after = ingest.commit_sync(lake, spark.createDataFrame([("n3", at(50), "new", "y")], SCHEMA), "modified_at", ("acl",))
    assert sum(before.folders[b] != after.folders[b] for b in before.folders) == 1
    with pytest.raises(ValueError, match="did not name"):
        lake.change(spark.createDataFrame([("n3",)], "node_id string"), lambda rows: lake.read())
    assert lake.versions()[-1] == after.number


def test_a_merge_killed_between_tasks_is_never_seen(spark, lake):
    """Some tasks have written their files when another breaks down: readers stay on the former version."""
    before = content(lake.read())

    def broken(batches):
        for b in batches:
            if "n7" in b.column("node_id").to_pylist():
                raise RuntimeError("lost")
            yield b

    with pytest.raises(Exception, match="lost"):
        lake.change(lake.read(), lambda rows: rows.withColumn("name", F.lit("half")).mapInArrow(broken, rows.schema))
    assert lake.versions() == [1, 2] and content(CommittedTable(spark, lake.root).read()) == before
    lake.change(lake.read(), lambda rows: rows.withColumn("name", F.lit("whole")))
    assert {r["name"] for r in lake.read().collect()} == {"whole"}


def test_a_writer_that_dies_before_its_commit_leaves_no_trace(spark, lake, monkeypatch):
    before = content(lake.read())
    with monkeypatch.context() as m:
        m.setattr(CommittedTable, "_commit", lambda self, version: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            lake.overwrite(lake.read().limit(1))
    assert content(lake.read()) == before
    gone = lake.vacuum()
    assert len(gone) == 1 and content(lake.read()) == before and len(os.listdir(f"{lake.root}/data")) == 1


def test_of_two_writers_one_wins(spark, lake):
    version = lake.version()
    rows = lake.read().limit(3)
    lake._write(version, rows, None, "first", None)
    with pytest.raises(Conflict):
        lake._write(version, rows, None, "second", None)
    with pytest.raises(Conflict):
        CommittedTable.create(spark, lake.root, SCHEMA, "node_id")
    assert lake.version().operation == "first" and lake.read().count() == 3


def test_a_batch_is_committed_once(spark, lake):
    rows = lambda name: spark.createDataFrame([("n1", at(99 if name == "a" else 100), name, "y")], SCHEMA)
    ingest.commit_sync(lake, rows("a"), "modified_at", ("acl",), batch=("s", 4))
    number = lake.version().number
    for batch in (4, 3):
        ingest.commit_sync(lake, rows("b"), "modified_at", ("acl",), batch=("s", batch))
    assert lake.version().number == number and lake.read().where("name = 'a'").count() == 1
    ingest.commit_sync(lake, rows("b").limit(0), "modified_at", ("acl",), batch=("s", 5))
    assert lake.version().batches == {"s": 5} and lake.read().where("name = 'a'").count() == 1


def test_vacuum_keeps_what_is_named(spark, lake):
    for k in range(3):
        ingest.commit_sync(lake, spark.createDataFrame([(f"n{k}", at(60), "new", "y")], SCHEMA), "modified_at", ("acl",))
    want = content(lake.read())
    lake.vacuum(keep=2)
    assert lake.versions() == [4, 5] and content(lake.read()) == want and lake.read(4).count() == 40
    lake.vacuum()
    assert lake.versions() == [5] and content(lake.read()) == want


def test_children_are_replaced_at_once(spark, tmp_path):
    lake = CommittedTable.create(spark, f"{tmp_path}/chunks", "doc_id long, text string", "doc_id", 4)
    lake.overwrite(spark.createDataFrame([(k % 5, f"old{k}") for k in range(20)], "doc_id long, text string"))
    ingest.commit_children(lake, spark.createDataFrame([(1, "new"), (7, "new")], "doc_id long, text string"), spark.createDataFrame([(1,), (2,), (7,)], "doc_id long"))
    got = content(lake.read())
    assert [r for r in got if r[0] in (1, 2, 7)] == [(1, "new"), (7, "new")] and len(got) == 14


def test_tables_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        CommittedTable.create(spark, f"{tmp_path}/a", SCHEMA, "other")
    with pytest.raises(FileNotFoundError):
        CommittedTable(spark, f"{tmp_path}/none").read()


def in_turn(stored, rows):
    """Syncs one by one."""
    docs = dict(stored)
    for node, m, name, acl, _ in rows:
        old = docs.get(node)
        if old and m is not None and old[0] is not None and not m > old[0]:
            docs[node] = (old[0], old[1], acl)
        else:
            docs[node] = (m, name, acl)
    return {(k, *v) for k, v in docs.items()}


@pytest.mark.parametrize("seed", range(4))
def test_repeated_keys_are_synced_in_turn(spark, seed):
    rng = random.Random(seed)
    stored = {f"n{k}": (at(rng.choice([None, 3, 5, 9])), "old", "x") for k in range(8)}
    rows = [(f"n{rng.randrange(14)}", at(rng.choice([None, 1, 3, 5, 7, 9, 9, 12])), f"name{k}", f"acl{k}", k) for k in range(70)]
    incoming = spark.createDataFrame(rows, SCHEMA + ", turn int").repartition(5)
    table = spark.createDataFrame([(k, *v) for k, v in stored.items()], SCHEMA)
    got = ingest.sync(table, incoming, "node_id", "modified_at", ("acl",), "turn")
    assert {tuple(r)[:4] for r in got.collect()} == in_turn(stored, rows)
    assert got.groupBy("node_id").count().where("count > 1").isEmpty()


def test_repeated_keys_without_a_turn_go_by_time(spark):
    stored = spark.createDataFrame([("a", at(10), "old", "x")], SCHEMA)
    incoming = spark.createDataFrame([("a", at(30), "third", "3"), ("a", at(20), "second", "2"), ("b", at(1), "first", "1"), ("b", at(1), "first", "1")], SCHEMA)
    assert content(ingest.sync(stored, incoming, "node_id", "modified_at", ("acl",))) == [("a", at(30), "third", "3", "updated"), ("b", at(1), "first", "1", "created")]


def test_repeated_access_changes(spark):
    stored = spark.createDataFrame([("a", at(1), "old", "x")], SCHEMA)
    rows = [("a", at(9), "n", "1", False, 1), ("a", at(2), "n", "2", False, 2), ("b", at(1), "first", "3", False, 3), ("b", at(2), "second", "4", False, 4), ("f", at(1), "dir", "5", True, 5)]
    incoming = spark.createDataFrame(rows, SCHEMA + ", is_folder boolean, turn int").repartition(3)
    assert content(ingest.update_acl(stored, incoming, "node_id", ("acl",), "turn")) == [("a", at(1), "old", "2"), ("b", at(1), "first", "4")]


NODES = "node_id string, path string, is_folder boolean, in_scope boolean, indexed boolean, excluded boolean, hidden boolean, modified_at timestamp, name string, acl string"


def world(rng):
    nodes = []
    for path in ("/a", "/a/b", "/a/b/c", "/d"):
        nodes.append((f"f{path}", path, True, rng.random() < 0.7, rng.random() < 0.6, rng.random() < 0.2, False, at(rng.randrange(40)), "dir", "y"))
        for k in range(4):
            hidden = rng.random() < 0.2
            name = f"{path}/{'tmp' if rng.random() < 0.2 else 'file'}{k}"
            nodes.append((f"p{name}", name, False, rng.random() < 0.7, False, hidden or rng.random() < 0.3, hidden, at(rng.randrange(40)), "new", "y"))
    return nodes


def one_by_one(stored, nodes, events):
    """The live rules, an event at a time: what each does to the documents."""
    known, docs = {n[0]: n for n in nodes}, dict(stored)

    def sync(n):
        old = docs.get(n[0])
        docs[n[0]] = (old[0], old[1], n[9]) if old and not n[7] > old[0] else (n[7], n[8], n[9])

    def delete(node, t):
        if node in docs and not docs[node][0] > t:
            del docs[node]

    def share(n):
        if n[0] in docs:
            docs[n[0]] = (*docs[n[0]][:2], n[9])
        elif not n[2]:
            docs[n[0]] = (n[7], n[8], n[9])

    def below(folder):
        return [n for n in nodes if not n[2] and not n[6] and n[1].startswith(folder[1] + "/")]

    for _, kind, node, t in events:
        n = known.get(node)
        if node is None:
            continue
        if kind == "delete" or kind == "state" and not (n and n[3]):
            delete(node, t)
        elif kind == "state":
            sync(n)
        elif kind == "acl" and n:
            if n[2]:
                for c in below(n) if not n[5] else []:
                    if "tmp" not in c[1]:
                        share(c)
            elif n[3]:
                share(n)
            else:
                delete(node, t)
        elif kind == "scope" and n and n[2]:
            if not n[3]:
                for c in below(n):
                    delete(c[0], t)
            elif n[4] and not n[5]:
                for c in below(n):
                    if "tmp" not in c[1] and not c[5]:
                        sync(c)
    return {(k, *v) for k, v in docs.items()}


@pytest.mark.parametrize("seed", range(3))
def test_live_events_as_one_by_one(spark, tmp_path, seed):
    """Three batches, one of them run twice: the table is as if each event had been handled in turn."""
    rng = random.Random(seed)
    nodes = world(rng)
    stored = {n[0]: (at(rng.randrange(40)), "old", "x") for n in nodes if not n[2] and rng.random() < 0.6} | {"gone": (at(5), "old", "x")}
    names = [n[0] for n in nodes] + ["gone", "never", None]
    folders = [n[0] for n in nodes if n[2]]
    events = [(k, kind := rng.choice(["state", "delete", "acl", "acl", "scope", "other"]), rng.choice(folders) if kind in ("acl", "scope") and rng.random() < 0.7 else rng.choice(names), at(10 + k)) for k in range(45)]
    lake = CommittedTable.create(spark, f"{tmp_path}/t", SCHEMA, "node_id", 4)
    lake.overwrite(spark.createDataFrame([(k, *v) for k, v in stored.items()], SCHEMA))
    source = spark.createDataFrame(nodes, NODES)
    for number in (0, 1, 1, 2, 0):
        batch = spark.createDataFrame(events[15 * number : 15 * number + 15], "event_id int, kind string, node_id string, at timestamp")
        E.apply_live_batch(lake, batch, source, "modified_at", ("acl",), ("*tmp*",), ("live", number))
    want = one_by_one(stored, nodes, events)
    assert {tuple(r) for r in lake.read().collect()} == want
    # all at once comes to the same
    at_once = CommittedTable.create(spark, f"{tmp_path}/u", SCHEMA, "node_id", 4)
    at_once.overwrite(lake.read(2))
    E.apply_live_batch(at_once, spark.createDataFrame(events, "event_id int, kind string, node_id string, at timestamp").repartition(4), source, "modified_at", ("acl",), ("*tmp*",))
    assert {tuple(r) for r in at_once.read().collect()} == want


def test_many_events_on_a_folder_are_one_row_a_file(spark):
    rng = random.Random(9)
    nodes = [("f/a", "/a", True, True, True, False, False, at(1), "dir", "y"), *[(f"p{k}", f"/a/{k}", False, True, False, False, False, at(1), "new", "y") for k in range(20)]]
    events = spark.createDataFrame([(k, rng.choice(["acl", "scope"]), "f/a", at(k)) for k in range(300)], "event_id int, kind string, node_id string, at timestamp")
    source = spark.createDataFrame(nodes, NODES)
    assert E.live_effects(E.live_decisions(events, source), source).count() == 40


def test_a_restarted_stream_goes_on(spark, tmp_path):
    """The stream's own checkpoint is lost: batches that the table has are not applied again."""
    schema = "event_id int, kind string, node_id string, at timestamp"
    source = spark.createDataFrame([("p1", "/a", False, True, False, False, False, at(3), "new", "y")], NODES)
    lake = CommittedTable.create(spark, f"{tmp_path}/t", SCHEMA, "node_id", 2)
    spark.createDataFrame([(1, "state", "p1", at(4))], schema).write.parquet(f"{tmp_path}/in")
    run = lambda checkpoint: E.live_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lake, lambda: source, "modified_at", ("acl",), f"{tmp_path}/{checkpoint}")
    run("one")
    number = lake.version().number
    assert content(lake.read()) == [("p1", at(3), "new", "y")]
    run("two")
    assert lake.version().number == number


OLD = "k string, props struct<a: int, deep: struct<x: int>>, parts array<struct<p: int>>, tags map<string, struct<t: int>>"
NEW = "k string, added double, props struct<b: string, deep: struct<y: array<int>, x: int>>, parts array<struct<q: string, p: int>>, tags map<string, struct<t: int, u: int>>"


def test_a_schema_grows_at_every_depth(spark, tmp_path):
    lake = CommittedTable.create(spark, f"{tmp_path}/t", OLD, "k", 4)
    lake.overwrite(spark.createDataFrame([("a", (1, (2,)), [(3,)], {"m": (4,)}), ("b", None, None, None)], OLD))
    added = lake.evolve(NEW)
    assert added == [("added", "double"), ("props.b", "string"), ("props.deep.y", "array<int>"), ("parts.element.q", "string"), ("tags.value.u", "int")]
    assert lake.evolve(NEW) == [] and lake.version().number == 3
    fresh = spark.createDataFrame([("c", 0.5, ("s", ([7], 8)), [("q", 9)], {"m": (1, 2)})], NEW)
    lake.change(fresh, lambda rows: rows.unionByName(ingest.conform(fresh, rows.schema)))
    got = {r["k"]: r.asDict(True) for r in lake.read().collect()}
    assert got["a"] == {"k": "a", "props": {"a": 1, "deep": {"x": 2, "y": None}, "b": None}, "parts": [{"p": 3, "q": None}], "tags": {"m": {"t": 4, "u": None}}, "added": None}
    assert got["b"] == {"k": "b", "props": None, "parts": None, "tags": None, "added": None}
    assert got["c"] == {"k": "c", "props": {"a": None, "deep": {"x": 8, "y": [7]}, "b": "s"}, "parts": [{"p": 9, "q": "q"}], "tags": {"m": {"t": 1, "u": 2}}, "added": 0.5}


def test_types_never_change_and_nothing_is_lost(spark, tmp_path):
    lake = CommittedTable.create(spark, f"{tmp_path}/t", OLD, "k", 4)
    for bad in ("k string, props struct<a: string>", "k string, parts struct<p: int>", "k int"):
        with pytest.raises(TypeError):
            lake.evolve(bad)
    with pytest.raises(ValueError, match="props.b"):
        lake.overwrite(spark.createDataFrame([], NEW.replace("added double, ", "")))
    assert lake.versions() == [1] and lake.evolve("k string") == []
