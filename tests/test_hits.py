"""The keyword leg from hits in place of texts: the same results, and no text is moved to the vectors."""

from pyspark.sql import functions as F

from lakeloom.operators import search
from lakeloom.plans import retrieval
from lakeloom.session import spread


def test_hits_stand_for_texts(spark):
    texts = [None, "", "  \n", "the sea", " Sea sea  SEAseasea\n", "Über ÜBER x \x0b y\x1cz", "aaa aaaa", "İstanbul ΣΑΣ"]
    chunks = spark.createDataFrame([(k, [1.0, k / 7], t) for k, t in enumerate(texts)], "key long, vector array<double>, text string")
    lists = [["sea"], ["sea", "the", "sea"], ["über", "z"], ["aa", " "], [], ["", "a"], ["σας", None], None]
    queries = spark.createDataFrame([(k, [1.0, 0.5], t) for k, t in enumerate(lists)], "q int, vector array<double>, terms array<string>")
    hits = search.with_hits(chunks, queries)
    assert "text" not in hits.columns
    both = [sorted(map(repr, search.candidates(c, queries, ("vector", "keyword"), 5, columns=()).collect())) for c in (chunks, hits)]
    assert both[0] == both[1] and any("keyword" in r for r in both[0])


def test_hybrid_and_keyword_queries_move_no_text(spark, sf, monkeypatch):
    """What is joined with the vectors has hits, a small part of the texts' bytes."""
    seen = []
    best_of = search.best_of
    monkeypatch.setattr(search, "best_of", lambda chunks, *a: seen.append(chunks) or best_of(chunks, *a))
    for name in ("hybrid_rrf", "hybrid_weighted_max", "hybrid_weighted_minmax", "hybrid_weight_default", "keyword_bm25", "chunk_fts"):
        retrieval.BOOK[name][0](spark, sf)
    assert len(seen) == 6 and all("hits" in c.columns and "text" not in c.columns for c in seen)


def test_tables_of_many_files_stay_where_they_are(spark, tmp_path):
    frame = spark.range(100).withColumn("text", F.lit("x"))
    for files in (1, spark.sparkContext.defaultParallelism):
        frame.repartition(files).write.parquet(f"{tmp_path}/{files}")
    one, many = (spread(spark.read.parquet(f"{tmp_path}/{n}")) for n in (1, spark.sparkContext.defaultParallelism))
    assert "Repartition" in one._jdf.queryExecution().optimizedPlan().toString() and "Repartition" not in many._jdf.queryExecution().optimizedPlan().toString()
