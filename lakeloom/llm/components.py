"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import Scratch

MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (a, b: long); root is the least node reachable.

    Large star links each larger neighbour to a node's least neighbour, small star each smaller one;
    the rounds needed grow with the logarithm of a component's length. Nodes of high degree: the
    least neighbour is a map-side-combined minimum, and the join back has one row on that side, so
    adaptive planning can split the other. Each round is written to the shared folder.
    """
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.save("edges", ordered)
    seen = _digest(edges)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a's are already the larger ends
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = scratch.save("edges", small.where("a <> b").distinct())
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # settled: stars whose centre is the least node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
