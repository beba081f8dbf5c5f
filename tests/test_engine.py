"""The service surface end to end on a few rows."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.engine import Lake
from lakeloom.functions.vectors import HashingEmbedder, TooLarge
from lakeloom.operators import chunking, status
from lakeloom.operators.acl import Asker, Principal


def test_lake(spark):
    texts = [("d1", "the budget report of spring", "s"), ("d2", "holiday plans and trains", "s"), ("d3", "secret budget numbers", "t")]
    rows = [(d, d.upper(), f"/{s}/{d}", s, ["__Everyone__"] if s == "s" else ["g:GROUP_x_#_t"], datetime(2024, 1, 1), "INDEXED") for d, _, s in texts]
    documents = spark.createDataFrame(rows, "node_id string, name string, path string, source_id string, racl array<string>, modified_at timestamp, sync_status string")
    embedder = HashingEmbedder(32)
    vectors = embedder([t for _, t, _ in texts]).tolist()
    chunks = spark.createDataFrame([(f"{d}::0", d, t, v, s, r[4]) for (d, t, s), v, r in zip(texts, vectors, rows)], "key string, doc_id string, text string, vector array<double>, source_id string, racl array<string>")
    lake = Lake(documents, chunks, embedder)
    anyone, insider = Asker((Principal("s", "ann"),)), Asker((Principal("t", "bob", ("x",)),))
    assert {r["key"] for r in lake.hybrid_search(["budget report"], anyone).collect()} <= {"d1::0", "d2::0"}
    assert "d3::0" in {r["key"] for r in lake.hybrid_search(["budget report"], insider).collect()}
    assert lake.hybrid_search(["budget"], Asker()).count() == 0
    assert lake.semantic_search(["  "], anyone).count() == 0
    assert {r["key"]: r["doc_count"] for r in lake.facets(F.col("source_id"), insider).collect()} == {"s": 2, "t": 1}
    context = lake.rag_context(["budget report"], insider, most=2, min_score=0.01).first()["context"]
    assert context.startswith("[Source 1: ") and "budget" in context
    assert lake.rag_context(["budget report"], insider, min_score=0.99).count() == 0
    incoming = documents.where("node_id = 'd1'").withColumn("name", F.lit("new"))
    assert {r["outcome"] for r in lake.ingest(incoming).collect()} == {"acl_only", "kept"}


@pytest.fixture(scope="module")
def small(spark):
    documents = spark.createDataFrame([("d1", ["a"], "INDEXED"), ("d2", ["a"], "FAILED")], "node_id string, racl array<string>, sync_status string")
    chunks = spark.createDataFrame([("d1::0", "d1", "budget of spring", [1.0, 0.0], "s", ["__Everyone__"]), ("d2::0", "d2", "trains", [0.0, 1.0], "s", ["__Everyone__"])], "key string, doc_id string, text string, vector array<double>, source_id string, racl array<string>")

    def model(texts):
        if any(len(t) > 4_000 for t in texts):
            raise TooLarge()
        return np.array([[1.0, float("train" in t)] for t in texts])

    return Lake(documents, chunks, model)


def test_hybrid_options(small):
    asker = Asker((Principal("s", "ann"),))
    first = lambda **how: small.hybrid_search(["trains"], asker, fusion="weighted", **how).orderBy("rank").first()
    assert first(weights=(0.1, 0.9))["key"] == "d2::0" and first(normalisation="minmax")["score"] <= 1.0
    with pytest.raises(ValueError):
        small.hybrid_search(["trains"], asker, fusion="other")
    with pytest.raises(ValueError, match="switched off"):
        Lake(small.documents, small.chunks, small.embedder, hybrid_enabled=False).hybrid_search(["trains"], asker)


def test_refused_texts_are_embedded_shortened(spark, small):
    long = spark.createDataFrame([("d", "word " * 2_000)], "doc_id string, text string")
    cut = small.chunk(long, chunking.Fixed(9_000, 0)).collect()
    assert len(cut) == 2 and all(r["vector"] == [1.0, 0.0] for r in cut)


def test_folder_status_and_reconciliation(spark, small):
    files = spark.createDataFrame([("f", "d1", None), ("f", "d2", None), ("f", "d3", None), ("g", "d1", None)], "folder_id string, node_id string, own_status string")
    assert {r["folder_id"]: (r["total"], r["failed"], r["pending"], r["status"]) for r in small.folder_status(files).collect()} == {"f": (3, 1, 1, "FAILED"), "g": (1, 0, 0, "INDEXED")}
    incoming = spark.createDataFrame([("d1", ["b"], False, None), ("d2", ["b"], False, "timeout"), ("d9", ["b"], False, None), ("dir", ["b"], True, None)], "node_id string, racl array<string>, is_folder boolean, failure string")
    stale = spark.createDataFrame([("d2",), ("d7",)], "node_id string")
    assert small.reconciliation_counts(incoming, stale).first().asDict() == {"updated": 1, "created": 1, "deleted": 1, "skipped": 2, "failed": 1}
    assert {r["node_id"]: r["racl"] for r in small.reconcile_permissions(incoming).collect()} == {"d1": ["b"], "d2": ["a"], "d9": ["b"]}


def test_array_facets(spark):
    rows = spark.createDataFrame([(["x", "y", "x"],), (["y", None],), (None,), ([],)], "tags array<string>")
    assert [tuple(r) for r in status.facets(rows, F.col("tags")).collect()] == [("y", 2), ("x", 1)]
    assert [tuple(r) for r in status.facets(rows, F.col("tags"), 0, term="X").collect()] == [("x", 1)]
    assert status.facets(spark.range(30), F.col("id"), 0).count() == 10


def test_strategies_through_one_surface(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 12").select("doc_id", "text")
    key = lambda f: {(r["doc_id"], r["index"], r["text"], r["start"], r["end"]) for r in f.collect()}
    for strategy in (chunking.Fixed(120, 30), chunking.Adaptive(), lambda t: [(w, 0, len(w)) for w in (t or "").split()[:3]]):
        cut = chunking.chunk_function(strategy)
        lateral = docs.alias("d").lateralJoin(cut(F.col("d.text").outer()).alias("c")).select("d.doc_id", "c.index", "c.text", "c.start", "c.end")
        assert key(lateral) == key(chunking.chunks(docs, strategy)) != set()
