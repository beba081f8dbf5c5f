"""The indexes of vectors and terms against searches over all chunks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import search
from lakeloom.operators.term_index import TermIndex, grams_of
from lakeloom.operators.vector_index import REST, VectorIndex, fit_centroids

DIMS = 24


def vectors(rng, n, topics):
    """Vectors around topics, as texts' are."""
    centres = rng.standard_normal((topics, DIMS))
    return centres[rng.integers(topics, size=n)] + 0.6 * rng.standard_normal((n, DIMS))


def table(spark, path, matrix, **columns):
    """Chunks from a Parquet file written by Arrow."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(path)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), DIMS).cast(pa.list_(pa.float64()))
    pq.write_table(pa.table({"key": np.arange(len(matrix)), "vector": flat, **columns}), f"{path}/part.parquet")
    return spark.read.parquet(path)


def asked_of(spark, matrix, tokens=None):
    rows = [(k, [float(x) for x in v], tokens) for k, v in enumerate(matrix)]
    frame = spark.createDataFrame(rows, "q int, vector array<double>, tokens array<string>")
    return frame if tokens else frame.drop("tokens")


def found(frame):
    return {(r["q"], r["rank"], r["key"], round(r["cosine"], 9)) for r in frame.collect()}


def test_recall_and_files_read_over_100_000_vectors(spark, tmp_path):
    """A sixteenth of the lists gives nine of ten neighbours at least; without `probes` all are found."""
    rng = np.random.default_rng(1)
    matrix = vectors(rng, 100_000, 400)
    chunks = table(spark, f"{tmp_path}/chunks", matrix)
    index = VectorIndex.build(chunks, f"{tmp_path}/index")
    assert len(index.numbers) > 250 and index.read([int(k) for k in index.numbers]).count() == 100_000
    queries = asked_of(spark, vectors(np.random.default_rng(1), 40, 400))
    want = found(search.nearest(chunks, queries, 10))
    probed = index.nearest(queries, 10, probes=len(index.numbers) // 16)
    pairs = lambda rows: {(q, key) for q, _, key, _ in rows}
    recall = len(pairs(found(probed)) & pairs(want)) / len(want)
    one = asked_of(spark, matrix[:1])
    read = lambda probes: len(index.nearest(one, 10, probes=probes).inputFiles())
    everything = len(index.read([int(k) for k in index.numbers]).inputFiles())
    print(f"recall {recall:.3f}, files of one query {read(len(index.numbers) // 16)} of {everything}")
    assert recall >= 0.9 and read(len(index.numbers) // 16) < everything / 8
    assert found(index.nearest(queries, 10)) == want


@pytest.fixture(scope="module")
def odd(spark):
    """Ties, and vectors that are null, empty, zero, of other lengths or hold nulls."""
    rng = np.random.default_rng(2)
    rows = [(k, v.round(1).tolist(), [f"g{k % 3}"]) for k, v in enumerate(rng.standard_normal((300, 4)))]
    rows += [(1000 + k, rows[k][1], [f"g{k % 3}"]) for k in range(40)]
    rows += [(2000, None, ["g0"]), (2001, [], ["g0"]), (2002, [0.0] * 4, ["g0"]), (2003, [1.0, None, 2.0, 3.0], ["g0"]), (2004, [1.0, 2.0], ["g0"]), (2005, [float("nan")] * 4, None)]
    return spark.createDataFrame(rows, "key long, vector array<double>, racl array<string>").repartition(4)


@pytest.mark.parametrize("most, floor", [(5, None), (30, 0.7), (400, None)])
def test_an_exact_search_is_the_scan(spark, odd, tmp_path, most, floor):
    index = VectorIndex.build(odd, f"{tmp_path}/index", lists=12)
    queries = asked_of(spark, np.random.default_rng(3).standard_normal((6, 4)), ["g0", "g2"]).unionByName(spark.createDataFrame([(90, [1.0, 2.0], ["g0"]), (91, None, ["g1"]), (92, [0.0] * 4, ["g1"]), (93, [1.0] * 4, ["nobody"])], "q int, vector array<double>, tokens array<string>"))
    assert found(index.nearest(queries, most, floor=floor)) == found(search.nearest(odd, queries, most, floor))
    condition = F.col("key") % 2 == 0
    assert found(index.nearest(queries, most, floor=floor, condition=condition)) == found(search.nearest(odd.where(condition), queries, most, floor))


def test_lists_that_cannot_hold_a_neighbour_are_left_out(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    centres = np.eye(DIMS)
    matrix = centres[rng.integers(DIMS, size=2_000)] + 0.05 * rng.standard_normal((2_000, DIMS))
    index = VectorIndex.build(table(spark, f"{tmp_path}/chunks", matrix), f"{tmp_path}/index", lists=DIMS)
    read = []
    monkeypatch.setattr(VectorIndex, "read", lambda self, lists, plain=VectorIndex.read: read.extend(lists) or plain(self, lists))
    index.nearest(asked_of(spark, matrix[:1]), 5).collect()
    assert 0 < len(set(read)) < DIMS / 2


def test_small_indexes(spark, tmp_path):
    none = spark.createDataFrame([], "key long, vector array<double>")
    queries = asked_of(spark, np.ones((1, 4)))
    assert VectorIndex.build(none, f"{tmp_path}/a").nearest(queries, 5).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [])], "key long, vector array<double>")
    index = VectorIndex.build(bad, f"{tmp_path}/b")
    assert index.rest and found(index.nearest(queries, 5)) == {(0, 1, 1, 0.0), (0, 2, 2, 0.0)}
    one = VectorIndex.build(spark.createDataFrame([(1, [1.0, 1.0, 1.0, 1.0])], "key long, vector array<double>"), f"{tmp_path}/c")
    assert found(one.nearest(queries, 5, probes=3)) == {(0, 1, 1, 1.0)} and REST not in one.numbers
    with pytest.raises(ValueError):
        VectorIndex.build(none.withColumn("list", F.lit(1)), f"{tmp_path}/d")


def test_centroids_have_length_one_and_no_list_is_lost():
    rng = np.random.default_rng(5)
    centres = fit_centroids(np.repeat(rng.standard_normal((7, 5)), 30, axis=0), 20)
    assert centres.shape == (20, 5) and np.allclose(np.linalg.norm(centres, axis=1), 1)


TEXTS = ["The quick brown fox", "quicksand and BROWNIES", None, "", "ab", "ÜBER den Wolken über", "xquiy", "brown", "the end of the then", "qui ick", "ŞİŞE", "aa aaa aaaa"]


@pytest.fixture(scope="module")
def terms(spark, tmp_path_factory):
    rows = [(k, t, [1.0, float(k % 5)]) for k, t in enumerate(TEXTS * 4)]
    frame = spark.createDataFrame(rows, "key long, text string, vector array<double>").repartition(3)
    return frame, TermIndex.build(frame, f"{tmp_path_factory.mktemp('terms')}/index", buckets=8)


@pytest.mark.parametrize("asked", [["quick"], ["brown", "über"], ["then", "zzz"], ["zzzz"], ["aaa"], ["ab"], [], ["quick", "ic"], ["end of the"]])
def test_posted_chunks_hold_all_that_match(spark, terms, asked):
    frame, index = terms
    queries = spark.createDataFrame([(1, [1.0, 2.0], asked), (2, [0.5, 1.0], asked[:1])], "q int, vector array<double>, terms array<string>")
    posted = {r["key"] for r in index.posted(queries).collect()}
    holding = {k for k, t in enumerate(TEXTS * 4) if any(a in (t or "").lower() for a in asked)}
    assert holding <= posted
    if all(len(a) >= 3 for a in asked):
        grams = [sorted(grams_of(a)) for a in asked]
        assert all(any(set(g[:1]) & grams_of((TEXTS * 4)[k] or "") or set(g) & grams_of((TEXTS * 4)[k] or "") for g in grams) for k in posted)
    got = {tuple(r) for r in index.keyword_search(queries, 10).collect()}
    assert got == {tuple(r) for r in search.keyword_search(frame, queries, 10).collect()}


def test_rare_terms_read_few_chunks(spark, tmp_path):
    frame = spark.range(4_000).select(F.col("id").alias("key"), F.concat(F.lit("common words here "), F.when(F.col("id") % 1_000 == 7, "platypus").otherwise("others")).alias("text"), F.array(F.lit(1.0), F.rand(1)).alias("vector"))
    index = TermIndex.build(frame, f"{tmp_path}/index", buckets=64)
    queries = spark.createDataFrame([(1, [1.0, 0.0], ["platypus"])], "q int, vector array<double>, terms array<string>")
    posted = index.posted(queries)
    assert {r["key"] for r in posted.collect()} == {7, 1007, 2007, 3007}
    assert len(posted.select("text").inputFiles()) < len(index.chunks.read().inputFiles()) + len(os.listdir(f"{tmp_path}/index/postings"))
    assert index.keyword_search(queries).count() == 4


def test_enriched_hits_pick_a_stated_row(spark):
    hits = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z")], "q int, doc_id string")
    documents = spark.createDataFrame([("a", "x", 2), ("a", "w", 9), ("b", None, 1), ("c", "y", 1)], "doc_id string, name string, n int")
    assert {tuple(r) for r in search.enrich(hits, documents).collect()} == {(1, "a", "w", 9), (2, "b", None, 1), (3, "z", None, None)}
