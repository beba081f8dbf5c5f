"""What the index of trigrams writes and moves."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import search, term_index
from lakeloom.operators.term_index import TermIndex, grams_of

TEXTS = ["The quick brown fox", "", None, "ab", "abc", "ŞİŞE İstanbul ΣΑΣ", "a\U0001f600b\U0001f600b c", "\x00\x00\x00\x00", "the the the", "fox"]


@pytest.mark.parametrize("characters, cells", [(1 << 22, 1 << 26), (1 << 22, 0), (20, 1 << 26), (1, 0)])
def test_postings_of_many_texts_are_the_trigrams_of_each(monkeypatch, characters, cells):
    monkeypatch.setattr(term_index, "CHARACTERS", characters)
    monkeypatch.setattr(term_index, "CELLS", cells)
    keys = [f"k{n}" for n in range(len(TEXTS))]
    runs = list(term_index._runs(pa.RecordBatch.from_arrays([pa.array(keys), pa.array(TEXTS)], names=["key", "text"])))
    assert [k for r in runs for k in r.column("key").to_pylist()] == keys
    assert (len(runs) == 1) == (characters == 1 << 22)
    made = [term_index._postings(r.column("key"), [(t or "").lower() for t in r.column("text").to_pylist()]) for r in runs]
    rows = [r for m in made if m is not None for r in m.to_pylist()]
    assert all(r["n"] == len(r["keys"]) == len(set(r["keys"])) for r in rows)
    pairs = [(r["gram"], k) for r in rows for k in r["keys"]]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(g, k) for k, t in zip(keys, TEXTS) for g in grams_of(t or "")}


def test_postings_have_few_rows_and_chunks_are_not_moved(spark, tmp_path):
    """Terms that nearly all chunks hold: a row for each trigram and run of texts, and no text in a shuffle."""
    frame = spark.range(3_000).select(F.col("id").alias("key"), F.concat(F.lit("common words here "), (F.col("id") % 7).cast("string")).alias("text"), F.array(F.lit(1.0), F.rand(1)).alias("vector"))
    index = TermIndex.build(frame, f"{tmp_path}/index", buckets=4)
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/index/counts").collect()}
    assert counts["com"] == 3_000 and counts["e 3"] == len(range(3, 3_000, 7))
    assert spark.read.parquet(f"{tmp_path}/index/postings").count() < 3_000
    queries = spark.createDataFrame([(1, [1.0, 0.0], ["common"])], "q int, vector array<double>, terms array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        posted = index.posted(queries)
        assert posted.count() == 3_000
        plan = posted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and not re.search(r"ShuffledHashJoin|Exchange hashpartitioning\(key", plan)
    assert {tuple(r) for r in index.keyword_search(queries, 10).collect()} == {tuple(r) for r in search.keyword_search(frame, queries, 10).collect()}


def test_repeated_and_missing_keys_are_found_as_by_the_scan(spark, tmp_path):
    rows = [(1, "the platypus", [1.0, 0.1]), (1, "platypus eggs", [1.0, 0.2]), (None, "a platypus", [1.0, 0.3]), (2, "an otter", [1.0, 0.4]), (3, None, [1.0, 0.5])]
    frame = spark.createDataFrame(rows, "key long, text string, vector array<double>")
    index = TermIndex.build(frame, f"{tmp_path}/index", buckets=4)
    queries = spark.createDataFrame([(1, [1.0, 0.0], ["platypus"])], "q int, vector array<double>, terms array<string>")
    found = sorted(map(repr, index.keyword_search(queries, 10).collect()))
    assert len(found) == 3 and found == sorted(map(repr, search.keyword_search(frame, queries, 10).collect()))
