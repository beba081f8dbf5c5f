"""An index's exact search, whatever order the queries come in and however narrow the lists are."""

import os

import numpy as np
from pyspark.sql import functions as F

from lakeloom.operators import search
from lakeloom.operators.vector_index import VectorIndex


def test_queries_that_come_in_another_order_each_time(spark, tmp_path):
    """As rows do that tasks of several executors send: which lists a query looks into goes with the query."""
    rng = np.random.default_rng(8)
    centres = np.eye(16)
    rows = [(k, [float(x) for x in centres[k % 16] + 0.05 * rng.standard_normal(16)]) for k in range(1_600)]
    chunks = spark.createDataFrame(rows, "key long, vector array<double>")
    index = VectorIndex.build(chunks, f"{tmp_path}/index", lists=16)
    queries = chunks.where("key < 24").select(F.col("key").alias("q"), "vector").coalesce(1)
    turned = queries.mapInPandas(lambda batches: (b.sample(frac=1, random_state=int.from_bytes(os.urandom(4))) for b in batches), queries.schema)
    found = lambda frame: {(r["q"], r["rank"], r["key"]) for r in frame.collect()}
    assert found(index.nearest(turned, 5)) == found(search.nearest(chunks, queries, 5))


def test_bounds_allow_for_what_a_cosine_near_one_hides():
    """Vectors up to 2e-8 from a centroid have a cosine of 1 in doubles, which must not rule out their list."""
    index = VectorIndex.__new__(VectorIndex)
    index.least = np.array([1.0])
    angles = np.linspace(0.1, 3.0, 50)
    assert (index._bounds(np.cos(angles)[:, None])[:, 0] >= np.cos(angles - 1e-8)).all()
