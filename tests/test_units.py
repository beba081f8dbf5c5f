"""Small cases with known numbers."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import paths as P
from lakeloom.functions import text as T
from lakeloom.functions import vectors as V
from lakeloom.operators import acl, chunking, filters, ingest, rag, scope, search, status
from lakeloom.sources import nodes as N
from lakeloom.sources import sinks
from lakeloom.streaming import events as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def hits(spark, rows, leg):
    cols = "q int, key string, cosine double, rank int" if leg == "v" else "q int, key string, bm25 double, rank int"
    return spark.createDataFrame(rows, cols)


def test_rrf_of_both_legs(spark):
    fused = search.rrf(search.fused(search.legs(hits(spark, [(0, "doc1::e1", 0.9, 1), (0, "doc2::e2", 0.7, 2)], "v"), hits(spark, [(0, "doc2::e2", 0.8, 1), (0, "doc3::e3", 0.6, 2)], "k"))))
    rows = {r["key"]: r for r in search.best_fused(fused, 10).collect()}
    assert len(rows) == 3 and rows["doc2::e2"]["rank"] == 1
    assert rows["doc2::e2"]["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)
    assert rows["doc1::e1"]["keyword_rank"] is None and rows["doc3::e3"]["vector_rank"] is None


def test_weighted_fusion(spark):
    both = search.fused(search.legs(hits(spark, [(0, "a", 0.8, 1)], "v"), hits(spark, [(0, "a", 1.0, 1)], "k")))
    assert search.weighted(both).first()["score"] == pytest.approx(1.0)
    lone = search.weighted(search.fused(search.legs(hits(spark, [(0, "a", 1.0, 1), (0, "b", 0.5, 2)], "v"), hits(spark, [], "k"))))
    assert sorted(r["score"] for r in lone.collect()) == pytest.approx([0.35, 0.7])
    ends = search.weighted(search.fused(search.legs(hits(spark, [(0, "a", 0.9, 1), (0, "b", 0.3, 2)], "v"), hits(spark, [], "k"))), 1.0, 0.0, "minmax")
    assert sorted(r["score"] for r in ends.collect()) == pytest.approx([0.0, 1.0])


def test_bm25(spark):
    score = lambda text, *terms: one(spark, T.bm25_tf(F.lit(text), F.array(*map(F.lit, terms)).cast("array<string>")))
    full, part = score("alpha beta", "alpha", "beta"), score("alpha gamma", "alpha", "beta")
    assert full > part > 0 == score("gamma", "alpha")
    assert score("ALPHA beta", "alpha") == score("alpha beta", "alpha")
    assert score("alpha alpha alpha", "alpha") < 3 * score("alpha", "alpha")
    assert score(None, "alpha") == score(" ", "alpha") == score("alpha") == 0


def test_keyword_terms(spark):
    terms = lambda q: one(spark, T.keyword_terms(F.lit(q)))
    assert terms("What is the status of CHG-105402, and 'quotes' 100%?") == ["status", "chg-105402", "quotes", "100"]
    assert terms("an of to") == terms(None) == terms("  ") == []
    assert terms("alpha Alpha (alpha)") == ["alpha"]
    assert len(terms(" ".join(f"word{i}" for i in range(30)))) == 12


def test_cosine(spark):
    cos = lambda a, b: one(spark, V.cosine(F.lit(a).cast("array<double>"), F.lit(b).cast("array<double>")))
    assert cos([1.0, 2.0], [1.0, 2.0]) == pytest.approx(1) and cos([1.0, 0.0], [0.0, 1.0]) == 0 and cos([1.0, 0.0], [-1.0, 0.0]) == pytest.approx(-1)
    assert cos(None, [1.0]) == cos([1.0], [1.0, 2.0]) == cos([0.0, 0.0], [1.0, 1.0]) == 0


def test_mmr():
    scores, vectors = [0.9, 0.85, 0.5], [[1, 0], [0.99, 0.01], [0, 1]]
    assert rag.mmr_order(scores, vectors, 2, 1.0) == [0, 1]
    assert rag.mmr_order(scores, vectors, 2, 0.0) == [0, 2]
    assert rag.mmr_order(scores, [None] * 3, 5, 0.5) == [0, 1, 2]


def test_gate(spark):
    rows = spark.createDataFrame([(0, 0.5), (0, 0.4), (1, 0.1)], "q int, score double")
    got = {r["q"]: r["verdict"] for r in status.relevance(rows, 0.5, 0).collect()}
    assert got == {0: "RELEVANT", 1: "WEAK"}


def test_variant_fusion_keeps_scores(spark):
    rows = [(0, 0, 1, "d1", 0.9), (0, 0, 2, "d2", 0.8), (0, 1, 1, "d3", 0.7), (0, 1, 2, "d2", 0.6)]
    frame = spark.createDataFrame(rows, "q int, variant int, rank int, key string, score double")
    got = search.fuse_variants(frame, 10, keep="first").orderBy("rank").collect()
    assert [r["key"] for r in got] == ["d2", "d1", "d3"] and got[0]["score"] == 0.8


@pytest.mark.parametrize(("text", "config"), [("This is a sentence. " * 200, chunking.ChunkConfig()), ("a" * 5000, chunking.ChunkConfig()), ("This is sentence number one. " * 100, chunking.ChunkConfig(100, 300, 50))])
def test_chunks_are_bounded(text, config):
    pieces = chunking.adaptive(text, config)
    assert len(pieces) > 2 and all(len(p[0]) <= config.most + config.overlap + 1 for p in pieces)


def test_chunk_cases():
    config = chunking.ChunkConfig()
    assert chunking.adaptive(None, config) == chunking.adaptive(" \n", config) == []
    assert [p[0] for p in chunking.adaptive("short", config)] == ["short"]
    assert "# Two" in chunking.adaptive("# One\n" + "x " * 300 + "\n# Two\n" + "y " * 300, config)[-1][0] or any("# Two" in p[0] for p in chunking.adaptive("# One\n" + "x " * 300 + "\n# Two\n" + "y " * 300, config))
    with pytest.raises(ValueError):
        chunking.fixed("x", 10, 10)
    assert chunking.fixed("one two three four", 9, 0)[0][0] == "one two"


def test_cleaning(spark):
    clean = lambda t, **k: one(spark, T.clean(F.lit(t), **k))
    assert clean(None) == clean(" \n") == ""
    assert clean("a​b\tc") == "ab c"
    assert clean("x" + "=" * 12 + "y") == "xy"
    assert clean("one\nPage 3 of 9\ntwo") .split() == ["one", "two"]
    assert clean("a b", enabled=False) == "a b"
    lines = "\n".join(["head line", "body %d"] * 8)
    assert "head line" not in clean(lines, aggressive=True)


def test_segments(spark):
    assert one(spark, T.sentences(F.lit("One. Two! three; four\nFive"))) == ["One.", "Two! three;", "four", "Five"]
    assert one(spark, T.paragraphs(F.lit("a\n\n b \n \n\nc"))) == ["a", "b", "c"]
    assert one(spark, T.sections(F.lit("pre\n# A\nx\n# B\ny"))) == ["pre", "# A\nx", "# B\ny"]


def test_truncation(spark):
    cut = one(spark, T.truncate_to_budget(F.lit("word " * 700)))
    assert len(cut) <= 1056 and not cut.endswith(" ")
    assert one(spark, T.truncate_to_budget(F.lit("short"))) == "short"


def test_answers(spark):
    got = one(spark, T.rerank_scores(F.lit("[1] = 7\n2: 9\n[9]=3\n[1]=2"), F.lit(3)))
    assert [(r["i"], r["s"]) for r in got] == [(1, 7.0), (2, 9.0)]
    assert one(spark, T.stream_delta(F.lit("hello wor"), F.lit("hello"))) == " wor"
    assert one(spark, T.stream_delta(F.lit("x"), F.lit("hello"))) == "x"


def test_paths(spark):
    assert one(spark, P.ancestor_paths(F.lit("/a/b/c"))) == ["/a/b", "/a"]
    assert one(spark, P.ancestor_paths(F.lit("/a/b"), itself=True)) == ["/a/b", "/a"]
    assert one(spark, P.ancestor_paths(F.lit("/"))) == []
    assert one(spark, P.parent_path(F.lit("/a/b/"))) == "/a"
    assert one(spark, P.matches_glob(F.lit("/x/tmp/y"), "*/tmp/*")) and not one(spark, P.matches_glob(F.lit("/x/y"), "*/tmp/*"))
    assert one(spark, P.open_link(F.lit("h/{a}/{b}"), {"a": F.lit("1 2")})) is None
    assert one(spark, P.open_link(F.lit("h/{a}"), {"a": F.lit("1 2"), "b": F.lit(" ")}, ("b",))) is None
    assert one(spark, P.open_link(F.lit("h/{a}"), {"a": F.lit(" 1 2 ")})) == "h/1 2" and one(spark, P.open_link(F.lit(" "), {})) is None
    assert one(spark, P.encode_path(F.lit("/a b/c d"))) == "/a%20b/c%20d" and one(spark, P.encode_segment(F.lit("a/ü{+}"))) == "a%2F%C3%BC%7B+%7D"
    assert one(spark, P.encode_path(F.lit(" "))) is None and one(spark, P.encode_path(F.lit("/x^\U0001f600"))) == "/x%5E%F0%9F%98%80"
    assert one(spark, P.own_id(F.lit("a:b:c"))) == "b:c" and one(spark, P.own_id(F.lit("a:"))) == "a:" and one(spark, P.own_id(F.lit(" "))) is None
    links = P.link_values(F.lit("n"), F.lit("t:s"), F.lit("/p q/"), F.lit("r"), F.lit(" "))
    assert one(spark, P.open_link(F.lit("{sourceId}{documentPath}#{fullSourceId}"), links)) == "s/p%20q/r#t:s"
    assert one(spark, P.source_id(F.lit("t"), F.lit("x"))) == "t:x" and one(spark, P.source_id(F.lit("t"), F.lit("y:x"))) == "y:x"


def test_first_match_decides(spark):
    rows = [("n", 0, "GROUP_members", "Read", False, None), ("n", 1, "alice", "Read", True, "effective"), ("n", 2, "GROUP_members", "Read", True, None), ("n", 3, "GROUP_EVERYONE", "Read", True, "")]
    frame = spark.createDataFrame(rows, "node_id string, pos int, principal string, permission string, granted boolean, status string")
    assert {r["principal"]: r["granted"] for r in acl.first_match_readers(frame).collect()} == {"GROUP_members": False, "alice": True, "GROUP_EVERYONE": True}


def test_entries(spark):
    got = one(spark, acl.entries(F.array(*map(F.lit, ("GROUP_EVERYONE", "GROUP_sales", "bob"))), F.lit("src")))
    assert {(r["user"], r["group"]) for r in got} == {("__Everyone__", None), (None, "GROUP_sales_#_src"), ("bob_#_src", None)}


def test_more_principals_see_more(spark):
    frame = spark.createDataFrame([(["__Everyone__"], "s"), (["u:a_#_s"], "s"), (["g:GROUP_x_#_t"], "t")], "racl array<string>, source_id string")
    count = lambda *p: frame.where(acl.permitted(F.col("racl"), F.col("source_id"), acl.Asker(p))).count()
    assert count() == 0 and count(acl.Principal("s", "b")) == 1 and count(acl.Principal("s", "a")) == 2
    assert count(acl.Principal("s", "a"), acl.Principal("t", "a", ("x",))) == 3 == count(acl.Principal("s", "a"), acl.Principal("t", "root", admin=True))


def test_scope(spark):
    nodes = spark.createDataFrame([("/in/a", False, "File", None), ("/in/no/b", False, "File", None), ("/out/c", False, "File", None), ("/in/d", False, "Note", None), ("/root/e", False, "File", "DELETED")], "path string, is_folder boolean, type string, state string")
    marked = spark.createDataFrame([("/in", True, False), ("/in/no", False, True)], "path string, indexed boolean, excluded boolean")
    got = scope.in_scope(nodes, marked, scope.Scope(("/root",), ("File",), ("deleted",)))
    assert {r["path"] for r in got.collect()} == {"/in/a"}


def test_sync_ties_are_stale(spark):
    at = datetime(2024, 1, 1)
    stored = spark.createDataFrame([(1, at, "old", "a"), (2, at, "old", "a")], "node_id int, modified_at timestamp, name string, acl string")
    incoming = spark.createDataFrame([(1, at, "new", "b"), (2, at + timedelta(1), "new", "b"), (3, None, "new", "b")], "node_id int, modified_at timestamp, name string, acl string")
    got = {r["node_id"]: (r["name"], r["acl"], r["outcome"]) for r in ingest.sync(stored, incoming, "node_id", "modified_at", ("acl",)).collect()}
    assert got == {1: ("old", "b", "acl_only"), 2: ("new", "b", "updated"), 3: ("new", "b", "created")}


def test_repeats_are_judged_by_the_last_kept():
    t = pd.Timestamp("2024-01-01")
    times = [t + pd.Timedelta(seconds=s) for s in (0, 60, 119, 120, 200, 240)]
    assert E.accepted(times, timedelta(minutes=2)) == [True, False, False, True, False, True]
    assert E.accepted(times, timedelta(0)) == [True] * 6


def test_batch_dedup(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, "x", n, t + timedelta(seconds=s)) for i, (n, s) in enumerate([(1, 0), (1, 60), (1, 121), (None, 0), (None, 1), (2, 30)])]
    frame = spark.createDataFrame(rows, "event_id long, event_type string, node_id long, ts timestamp")
    assert {r["event_id"] for r in E.drop_repeats(frame, timedelta(minutes=2)).collect()} == {0, 2, 3, 4, 5}


def test_decisions(spark):
    kind = lambda k, present=True, folder=False, inside=True: one(spark, E.decide(F.lit(k), F.lit(present), F.lit(folder), F.lit(inside)))
    assert kind("upsert") == "sync" and kind("upsert", present=False) == "delete" and kind("upsert", folder=True) == "subtree" and kind("acl", inside=False) == "delete" and kind("acl") == "update_acl"


def test_messages(spark):
    raw = spark.createDataFrame([('{"eventType":"e","sourceType":"s","nodeId":"n","recursive":true}',), ("{bad",), ('{"eventType":"e"}',)], "value string")
    good, bad = N.read_messages(raw)
    assert good.count() == 1 and bad.count() == 2


def test_embeddings_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, None, "t", [0.5], "x", None, None)], f"doc_id long, index int, id string, type string, vector array<float>, text string, blobref string, location {sinks.LOCATION}")
    sinks.write_embeddings(rows, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").first()["id"] == "0"
    with pytest.raises(ValueError):
        sinks.write_embeddings(rows.limit(0), f"{tmp_path}/f")


def test_tree(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "z")], "node_id string, parent_id string")
    assert {r["node_id"] for r in N.tree(nodes, "a").collect()} == {"b", "c"}


def test_metadata_ignores_bad_keys(spark):
    frame = spark.createDataFrame([({"k": "v"},), ({"k": "w"},)], "properties map<string,string>")
    assert frame.where(filters.metadata(filters.MetadataFilter(properties={"k": "v", "bad key": "x"}))).count() == 1


def test_plans(spark, sf):
    """Filters reach the scan, unused columns stay there, and grouped limits run before the exchange."""
    from lakeloom.plans.book import table
    from lakeloom.plans.retrieval import asked, chunks

    plan = lambda f: f._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan(table(spark, sf, "documents").where("lang = 'en'").select("doc_id"))
    scored = search.nearest(chunks(spark, sf), asked(spark, sf), 5)
    assert "WindowGroupLimit" in plan(scored)


def test_hashing_embedder():
    v = V.HashingEmbedder(8)(["a b", ""])
    assert np.linalg.norm(v[0]) == pytest.approx(1) and not v[1].any()


def test_least_scores():
    assert search.least_score(None) == search.least_score(0.0) == search.least_score(-1) == search.least_score(float("nan")) == 0.5
    assert search.least_score(0.2) == 0.2 and search.least_score(3) == 1.0


def test_search_without_vectors_and_readers(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0], ["r"], "x"), ("b", None, ["r"], "x y"), ("c", [1.0], ["r"], "y"), ("d", [0.0, 1.0], None, "x"), ("e", [float("nan"), 1.0], ["r"], None)], "key string, vector array<double>, racl array<string>, text string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], ["y"], ["r"]), (2, [0.0, 0.0], [], ["z"])], "q int, vector array<double>, terms array<string>, tokens array<string>")
    found = search.nearest(chunks, asked, 9)
    assert [(r["q"], r["rank"], r["key"], r["cosine"]) for r in found.orderBy("q", "rank").collect()] == [(1, 1, "a", 1.0), (1, 2, "b", 0.0), (1, 3, "c", 0.0), (1, 4, "e", 0.0)]
    assert sorted(r["key"] for r in search.keyword_search(chunks, asked).collect()) == ["b", "c"]
    assert search.nearest(chunks, asked.limit(0), 9).count() == 0 and search.nearest(chunks.limit(0), asked, 9).count() == 0


def test_blank_is_what_java_says(spark):
    blank = lambda x: one(spark, T.is_blank(F.lit(x).cast("string")))
    assert blank(None) and blank("") and blank(" \n\t\u2003") and not blank("\u00a0") and not blank(" a ")


def test_boilerplate_stays_without_repeats(spark):
    text = "\n".join(f"line {k}" for k in range(12)) + "\n\n"
    assert one(spark, T.drop_boilerplate(F.lit(text))) == text
    assert one(spark, T.drop_boilerplate(F.lit("\u2003same line\n" * 5 + text))) == "".join(f"line {k}\n" for k in range(12))


def test_gate_gives_nothing_where_all_is_weak(spark):
    rows = lambda *scores: spark.createDataFrame([(q, f"k{i}", i + 1, s) for q, ss in enumerate(scores) for i, s in enumerate(ss)], "q int, key string, rank int, score double")
    strict, broad = rows([0.9, 0.8], [0.4], [0.1]), rows([0.9, 0.8, 0.1], [0.9, 0.8], [0.1, 0.1])
    kept = rag.gated(strict, broad, 0.7, 2)
    assert {q: kept.where(f"q = {q}").count() for q in range(3)} == {0: 2, 1: 2, 2: 0}


def test_expansion_of_failed_answers(spark):
    queries = spark.createDataFrame([(1, " What is it? "), (2, "  "), (3, "Only")], "q int, text string")
    answers = spark.createDataFrame([(1, "sub", "NONE\nnot taken"), (1, "hyde", None), (1, "variant", "1. what is it?\n2) Other\n- other\n* Third"), (2, "variant", "x")], "q int, kind string, answer string")
    found = [(r["q"], r["place"], r["label"], r["text"]) for r in rag.expand(queries, answers).orderBy("q", "place").collect()]
    assert found == [(1, 1, "original", "What is it?"), (1, 2, "variant-1", "Other"), (1, 3, "variant-2", "Third"), (3, 1, "original", "Only")]


def test_windows_cover_their_text():
    text = "ab cde " * 200
    for most, overlap in ((50, 10), (64, 63), (7, 0)):
        found = chunking.windows(text, most, overlap)
        assert found[0][1] == 0 and found[-1][2] == len(text) and all(b - a <= most for _, a, b in found)
        assert {b[1] - a[1] for a, b in zip(found, found[1:])} <= {max(most // 2, most - overlap)}
    assert chunking.windows("", 10, 2) == [] and chunking.windows("x" * 25, 10, 2) == [("x" * 10, 0, 10), ("x" * 10, 8, 18), ("x" * 9, 16, 25)]
    assert chunking.tail("one two three four five six", 24) == "two three four five six"
    assert chunking.tail("short", 10) == "" == chunking.tail("x y", 1)


def test_group_expansion_of_unknown_users(spark):
    askers = spark.createDataFrame([(1, "ann", "s"), (2, None, "s"), (3, "bob", "t")], "q int, user string, source_id string")
    members = spark.createDataFrame([("ann", "s", "dev"), ("ann", "s", "GROUP_ops"), ("ann", "t", "other"), ("ann", "s", " ")], "user string, source_id string, group string")
    tokens = {r["q"]: r["tokens"] for r in acl.asker_tokens(askers, members).collect()}
    assert tokens[1] == ["__Everyone__", "g:GROUP_EVERYONE_#_s", "g:GROUP_dev_#_s", "g:GROUP_ops_#_s", "u:ann_#_s"]
    assert tokens[2] == ["__Everyone__"] and tokens[3] == ["__Everyone__", "g:GROUP_EVERYONE_#_t", "u:bob_#_t"]


def test_applied_actions_are_guarded(spark):
    stored = spark.createDataFrame([("a", 5, "old", "x"), ("b", 9, "old", "x"), ("c", 1, "old", "x")], "node_id string, modified_at int, name string, acl string")
    nodes = spark.createDataFrame([("a", 6, "new", "y", False), ("c", 1, "new", "y", False), ("d", 1, "new", "y", False)], "node_id string, modified_at int, name string, acl string, is_folder boolean")
    actions = spark.createDataFrame([("a", 7, "sync"), ("b", 8, "delete"), ("c", 7, "update_acl"), ("d", 7, "sync")], "node_id string, at int, action string")
    out = {r["node_id"]: (r["name"], r["acl"]) for r in E.apply_actions(stored, actions, nodes, "modified_at", ("acl",)).collect()}
    assert out == {"a": ("new", "y"), "b": ("old", "x"), "c": ("old", "y"), "d": ("new", "y")}


def test_readers_are_not_denied(spark):
    aces = spark.createDataFrame([("n", 0, "ann", "Read", False, " "), ("n", 1, "GROUP_EVERYONE", "Read", True, None)], "node_id string, pos int, principal string, permission string, granted boolean, status string")
    who = spark.createDataFrame([("n", "ann"), ("n", "GROUP_EVERYONE"), ("m", "bob")], "node_id string, principal string")
    assert {r["node_id"]: r["readers"] for r in acl.readers(who, aces).collect()} == {"n": ["GROUP_EVERYONE"], "m": []}


def test_descendants_of_one_level(spark):
    nodes = spark.createDataFrame([("/a/x", False, ["k"]), ("/a/b/y", False, None), ("/a/b", True, None), ("/a/c/z", False, [])], "path string, is_folder boolean, aspects array<string>")
    names = lambda f: {r["path"] for r in f.collect()}
    assert names(N.descendants(nodes, "/a", recursive=False)) == {"/a/x"}
    assert names(N.descendants(nodes, "/a/", ("k",))) == {"/a/b/y", "/a/c/z"}
    assert names(N.descendants(nodes, "/a", excluded=nodes.where("path = '/a/b'").select("path"))) == {"/a/x", "/a/c/z"}


def test_sources_by_precedence():
    assert filters.resolve_sources([" "], ["alf:one", "one", "two"], ["p"], [], "alf") == ["one", "two"]
    assert filters.resolve_sources([], [], [], ["z"]) == ["z"]


def test_refused_texts_are_shortened():
    """A model that takes 300 characters, and says how many tokens it counted only where they are many."""
    calls = []

    def model(texts):
        calls.append(texts)
        for t in texts:
            if len(t) > 300:
                raise V.TooLarge(len(t) if len(t) > 1_000 else None)
        return np.array([[float(len(t))] for t in texts])

    got = V.Resilient(model)(["short", "word " * 400, "x" * 700]).ravel().tolist()
    assert got[0] == 5 and 100 < got[1] <= 300 and got[2] == 175
    assert V.shortened("a. b" * 10, None).endswith(".") and len(V.shortened("y" * 5_000, 100)) < 5_000
    with pytest.raises(V.TooLarge):
        V.Resilient(lambda texts: (_ for _ in ()).throw(V.TooLarge()))(["abc"])
