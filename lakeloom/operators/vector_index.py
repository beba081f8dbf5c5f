"""An inverted file of vectors: chunks in lists around centroids, of which a search reads a few.

A chunk is in the list of its nearest centroid by cosine. Lists are folders of Parquet, so that reading some of them
touches no file of the others. A list's smallest cosine to its centroid bounds how near its chunks can be to any
query, which gives an exact search that leaves out what can't be among the nearest.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.operators import search
from lakeloom.session import Scratch
from lakeloom.sources.committed import Storage

#: Centroids are fitted to a sample of about so many vectors, in so many rounds; all chunks are indexed.
SAMPLE, ROUNDS = 32_768, 12
MOST_LISTS = 4_096
#: Angles from cosines near 1 or -1 may be wrong by so much.
ANGLE = 3e-8
#: The list of chunks without a usable vector or with another number of dimensions: read by every search.
REST = -1


def fit_centroids(vectors: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Spherical k-means: rows of length one; a list that runs empty starts again from a vector of the largest."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    lists = min(lists, len(unit))
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), lists, replace=False)]
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = np.flatnonzero(length[:, 0] == 0)
        if len(empty):
            pool = np.flatnonzero(of == np.bincount(of, minlength=lists).argmax())
            sums[empty] = unit[rng.choice(pool, len(empty))]
            length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / length
    return centres


class VectorIndex:
    """An index in a folder: `lists/`, and `index.json`, which is written last and makes it whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        said = json.loads(Storage(spark, root).read(f"{self.root}/index.json"))
        self.centres = np.frombuffer(base64.b64decode(said["centres"]), dtype="<f8").reshape(len(said["numbers"]), said["dims"])
        self.numbers, self.least = np.array(said["numbers"], dtype=np.int64), np.array(said["least"], dtype=np.float64)
        self.rest, self.schema = said["rest"], StructType.fromJson(said["schema"])

    @classmethod
    def build(cls, chunks: DataFrame, root: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 42) -> VectorIndex:
        """Index chunks (key, vector array<double> and other columns): all of them, around centroids of a bounded sample.

        lists: as many as the square root of the chunks, at most MOST_LISTS, unless given. The sample is taken by a hash of
        the key; the commonest number of dimensions in it is the index's. The driver holds the sample and the centroids.
        """
        spark, root = chunks.sparkSession, root.rstrip("/")
        if "list" in chunks.columns:
            raise ValueError("list is a name of the index's own")
        n = chunks.count()
        step = max(1, n // sample)
        taken = chunks.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(step)) == 0).select("vector").limit(2 * sample).toArrow()["vector"].combine_chunks()
        groups = sorted(search._usable(taken), key=lambda g: -len(g[1]))
        wanted = lists or max(1, min(MOST_LISTS, math.isqrt(n)))
        centres = fit_centroids(groups[0][2], wanted, seed=seed) if groups and len(groups[0][1]) else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast(centres)
        schema = StructType.fromJson(chunks.schema.jsonValue()).add("list", "integer").add("__near", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = sent.value
            for b in batches:
                place, near = np.full(b.num_rows, REST, dtype=np.int32), np.zeros(b.num_rows)
                for dims, rows, matrix, length in search._usable(b.column("vector")):
                    if len(centres) and dims == centres.shape[1]:
                        cosine = (matrix / length[:, None]) @ centres.T
                        place[rows], near[rows] = cosine.argmax(axis=1), cosine.max(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(near)], names=[*b.schema.names, "list", "__near"])

        placed = chunks.mapInArrow(run, schema)
        placed.hint("rebalance", "list").withColumn("near", F.col("__near")).drop("__near").write.partitionBy("list").parquet(f"{root}/lists")
        kept = spark.read.schema(StructType.fromJson(chunks.schema.jsonValue()).add("near", "double").add("list", "integer")).parquet(f"{root}/lists") if n else None
        # a row a list
        least = {r["list"]: r["least"] for r in kept.groupBy("list").agg(F.min("near").alias("least")).collect()} if n else {}
        numbers = sorted(k for k in least if k != REST)
        said = {"numbers": numbers, "dims": centres.shape[1], "centres": base64.b64encode(centres[numbers].astype("<f8").tobytes()).decode(), "least": [least[k] for k in numbers], "rest": REST in least, "schema": json.loads(chunks.schema.json())}
        if not Storage(spark, root).publish(f"{root}/index.json", json.dumps(said)):
            raise FileExistsError(root)
        return cls(spark, root)

    def read(self, lists: list[int]) -> DataFrame:
        """The chunks of some lists, with `list`."""
        schema = StructType.fromJson(self.schema.jsonValue()).add("list", "integer")
        paths = [f"{self.root}/lists/list={k}" for k in lists]
        return self.spark.read.option("basePath", f"{self.root}/lists").schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _near(self, asked: search._Asked) -> np.ndarray:
        """Cosines of queries and centroids; -2 for queries that the lists can't serve."""
        out = np.full((len(asked.q), len(self.numbers)), -2.0)
        if len(self.numbers) and self.centres.shape[1] in asked.vectors:
            rows, matrix, length = asked.vectors[self.centres.shape[1]]
            out[rows] = (matrix / length[:, None]) @ self.centres.T
        return out

    def _bounds(self, near: np.ndarray) -> np.ndarray:
        """How near any chunk of a list can be to a query: the angle to the centroid less the list's widest."""
        angle = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(self.least, -1, 1))[None, :] - 2 * ANGLE
        return np.where(near < -1.5, 0.0, np.cos(np.maximum(angle, 0.0))) + search.SLACK

    def _rows(self, probed: np.ndarray, rest: bool, condition) -> tuple[DataFrame, dict[int, np.ndarray]]:
        """The chunks of the lists that any query looks into, and which queries look into each."""
        masks = {int(self.numbers[k]): probed[:, k] for k in np.flatnonzero(probed.any(axis=0))}
        if rest and self.rest:
            masks[REST] = np.ones(len(probed), dtype=bool)
        rows = self.read(sorted(masks))
        return rows if condition is None else rows.where(condition), masks

    def nearest(self, queries: DataFrame, most: int, probes: int | None = None, floor: float | None = None, condition=None, columns: tuple[str, ...] | None = None) -> DataFrame:
        """q, rank, key, cosine and the chunks' columns (all, or those named) of each query's nearest chunks.

        With `probes` the nearest so many lists of each query are read, which may miss some of its chunks. Without, all
        that a list's bound doesn't rule out: a first pass over the nearest lists gives the score to beat, which is
        at most a number a query on the driver, and a second one reads the lists that could; the result is exact. Queries that
        have no vector of the index's kind are compared with all lists.
        """
        parts = [self._nearest(block, most, probes, floor, condition, columns) for block in search.in_blocks(queries)]
        return reduce(DataFrame.unionByName, parts)

    def _nearest(self, queries: DataFrame, most: int, probes: int | None, floor: float | None, condition, columns: tuple[str, ...] | None) -> DataFrame:
        asked = search._Asked(queries)
        q_type = queries.schema["q"].dataType
        near = self._near(asked)
        first = probes or max(1, len(self.numbers) // 16)
        probed = np.zeros(near.shape, dtype=bool)
        if near.size:
            top = np.argsort(-near, axis=1, kind="stable")[:, :first]
            probed[np.arange(len(near))[:, None], top] = True
        probed |= near < -1.5
        rows, masks = self._rows(probed, True, condition)
        found = search.best_of(rows, asked, q_type, ("vector",), most, floor, masks)
        shown = lambda found, rows: search.with_columns(found, rows.drop("list"), columns).drop("leg")
        if probes is not None:
            return shown(found, rows)
        found = Scratch(self.spark, "index").save("first", found)
        worst = {r["q"]: (r["n"], r["least"]) for r in found.groupBy("q").agg(F.count("*").alias("n"), F.min("cosine").alias("least")).collect()}
        beat = np.array([worst[q][1] if q in worst and worst[q][0] >= most else (-2.0 if floor is None else floor) for q in asked.q.to_pylist()])
        further = (self._bounds(near) >= beat[:, None]) & ~probed
        if not further.any():
            return shown(found, rows)
        more, masks = self._rows(further, False, condition)
        again = search.best_of(more, asked, q_type, ("vector",), most, floor, masks)
        both = search.ranked(found.drop("rank").unionByName(again.drop("rank")), [F.desc("cosine"), F.asc("key")], most)
        return shown(both, self._rows(probed | further, True, condition)[0])
