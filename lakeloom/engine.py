"""The engine's service surface: one object over a lake's tables.

What the asker may see is a filter of every plan. Methods return lazy DataFrames, but questions, a few
rows, are embedded and read when a search is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.functions import vectors as V
from lakeloom.operators import acl, chunking, filters, ingest, rag, search, status


@dataclass
class Lake:
    """documents: node_id, name, path, source_id, racl and metadata. chunks: key, doc_id, text, vector, source_id, racl and metadata."""

    documents: DataFrame
    chunks: DataFrame
    embedder: V.Embedder
    #: A hybrid search is refused where it is switched off.
    hybrid_enabled: bool = True

    def __post_init__(self) -> None:
        # texts that the model refuses are shortened and tried again
        if not isinstance(self.embedder, V.Resilient):
            self.embedder = V.Resilient(self.embedder)

    def _asked(self, questions: list[str]) -> DataFrame:
        spark = self.chunks.sparkSession
        rows = spark.createDataFrame(list(enumerate(questions)), "q int, question string").where(~T.is_blank(F.col("question")))
        return rows.select("q", V.embed(F.concat(F.lit(T.QUERY_PREFIX), T.sanitize(F.col("question"))), self.embedder).alias("vector"), T.keyword_terms(F.col("question")).alias("terms"))

    def _visible(self, asker: acl.Asker, wanted: filters.MetadataFilter | None, source_type: str | None) -> DataFrame:
        seen = acl.permitted(F.col("racl"), F.col("source_id"), asker)
        return self.chunks.where(search.all_of(seen, filters.metadata(wanted) if wanted else None, filters.source_type(source_type)))

    def semantic_search(self, questions: list[str], asker: acl.Asker, most: int = 5, min_score: float | None = None, wanted: filters.MetadataFilter | None = None, source_type: str | None = None) -> DataFrame:
        return search.semantic_search(self._visible(asker, wanted, source_type), self._asked(questions), most, min_score)

    def hybrid_search(self, questions: list[str], asker: acl.Asker, most: int = 5, candidates: int = 30, min_score: float | None = None, fusion: str = "rrf", normalisation: str = "max", weights: tuple[float, float] = (search.VECTOR_WEIGHT, search.KEYWORD_WEIGHT), wanted: filters.MetadataFilter | None = None, source_type: str | None = None) -> DataFrame:
        """q, rank, key, score and the scores and ranks of both legs; fusion is rrf or weighted, normalisation max or minmax."""
        if not self.hybrid_enabled:
            raise ValueError("hybrid search is switched off")
        if fusion not in ("rrf", "weighted") or normalisation not in ("max", "minmax"):
            raise ValueError(f"unknown fusion {fusion} or normalisation {normalisation}")
        hold = lambda n, default: max(1, min(100, n if n > 0 else default))
        return search.hybrid_search(self._visible(asker, wanted, source_type), self._asked(questions), hold(candidates, 30), hold(most, 5), min_score, fusion, normalisation, weights)

    def facets(self, value: Column, asker: acl.Asker, most: int = 10, term: str | None = None) -> DataFrame:
        return status.facets(self.documents, value, most, acl.permitted(F.col("racl"), F.col("source_id"), asker), term)

    def node_status(self, nodes: DataFrame) -> DataFrame:
        return status.node_status(nodes, self.documents.select("node_id", "sync_status"))

    def folder_status(self, files: DataFrame) -> DataFrame:
        """Counts and the worst state of each folder, from its files (folder_id, node_id, own_status)."""
        nodes = files.groupBy("node_id").agg(F.max("own_status").alias("own_status"))
        return status.folder_status(files.select("folder_id", "node_id").distinct().join(self.node_status(nodes), "node_id"))

    def rag_context(self, questions: list[str], asker: acl.Asker, most: int = 8, pool: int = 30, trade: float = 0.7, min_score: float = 0.3, min_hits: int = 1, max_chars: int = 12_000) -> DataFrame:
        """q and context: the strict pass, diversified, where it is relevant, else a broadened one if that is, packed; else no row."""
        seen, asked = self._visible(asker, None, None), self._asked(questions)
        found = search.nearest(seen, asked, rag.pool_size(most, pool), columns=("doc_id", "text", "vector")).select("q", "key", "rank", F.col("cosine").alias("score"), "doc_id", "text", "vector")
        strict = rag.mmr(found.where(F.col("score") >= min_score), most, trade)
        broad = rag.mmr(found, rag.broadened(most, pool), trade)
        hits = rag.gated(strict, broad, min_score, min_hits)
        named = hits.join(self.documents.select(F.col("node_id").alias("doc_id"), "name"), "doc_id", "left")
        return rag.pack_context(named.withColumn("name", F.coalesce("name", F.col("doc_id").cast("string"))), max_chars)

    def ingest(self, incoming: DataFrame, acl_columns: tuple[str, ...] = ("racl",)) -> DataFrame:
        """The documents with incoming nodes merged, and each one's outcome."""
        return ingest.sync(self.documents, incoming, "node_id", "modified_at", acl_columns)

    def reconcile_permissions(self, incoming: DataFrame, acl_columns: tuple[str, ...] = ("racl",)) -> DataFrame:
        """The documents with the access of incoming nodes (is_folder, and `failure` where the source could not be asked)."""
        known = incoming.where(F.col("failure").isNull()) if "failure" in incoming.columns else incoming
        return ingest.update_acl(self.documents, known, "node_id", acl_columns)

    def reconciliation_counts(self, incoming: DataFrame, stale_ids: DataFrame | None = None) -> DataFrame:
        """One row of what a reconciliation does: updated, created, deleted, skipped and failed nodes.

        incoming as above. stale_ids: nodes that the source doesn't have any more (node_id), whose documents go.
        """
        failure = F.col("failure") if "failure" in incoming.columns else F.lit(None).cast("string")
        there = self.documents.select("node_id").distinct().withColumn("__there", F.lit(True))
        one = incoming.groupBy("node_id").agg(F.max("is_folder").alias("is_folder"), F.max(failure).alias("failure")).join(there, "node_id", "left")
        outcome = F.when(F.col("failure").isNotNull(), "failed").when(F.col("__there"), "updated").when(F.col("is_folder"), "skipped").otherwise("created")
        rows = one.select(outcome.alias("outcome"))
        if stale_ids is not None:
            gone = stale_ids.select("node_id").distinct().join(there, "node_id", "left")
            rows = rows.unionByName(gone.select(F.when(F.col("__there"), "deleted").otherwise("skipped").alias("outcome")))
        return rows.agg(*[F.count(F.when(F.col("outcome") == n, 1)).alias(n) for n in ("updated", "created", "deleted", "skipped", "failed")])

    def chunk(self, texts: DataFrame, strategy: chunking.Strategy = chunking.Adaptive()) -> DataFrame:
        """Chunks of cleaned texts (doc_id, text) by any strategy, with their vectors."""
        rows = chunking.chunks(texts, strategy, T.clean(F.col("text")))
        return rows.withColumn("vector", V.embed(F.col("text"), self.embedder))
