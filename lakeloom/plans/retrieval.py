"""Queries of search, filters, access control and facets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.functions import vectors as V
from lakeloom.operators import acl, filters, rag, search, status
from lakeloom.operators.term_index import TermIndex
from lakeloom.operators.vector_index import VectorIndex
from lakeloom.plans.book import book, table
from lakeloom.session import scratch_root

BOOK, query = book()

TERMS = (("that", "with"), ("der", "keit"), ("que", "ment"), ("ción", "las"), ("tion", "ing"))
#: Rows with an id divisible by this are the queries, asked against all.
EVERY = 100


def chunks(spark: SparkSession, sf_dir: str, queries: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """All documents, or those given; they take the vectors in turn. Readers are the group of the source, and everyone for each fifth.

    With queries, `hits` of their terms stand for the text, which is not joined with the vectors then.
    """
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    if queries is not None:
        docs = search.with_hits(docs.select("doc_id", "lang", "source", "text"), queries)
    vectors = table(spark, sf_dir, "embeddings")
    many = vectors.count()
    vectors = vectors.select(F.col("vec_id").alias("turn"), F.col("embedding").cast("array<double>").alias("vector"))
    racl = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("__Everyone__"), F.concat(F.lit("g:GROUP_"), "source"))).otherwise(F.array(F.concat(F.lit("g:GROUP_"), "source")))
    return docs.withColumn("turn", F.col("doc_id") % many).join(vectors, "turn").select(F.col("doc_id").alias("key"), "doc_id", "text" if queries is None else "hits", "lang", "source", racl.alias("racl"), "vector")


def asked(spark: SparkSession, sf_dir: str, tokens: bool = True) -> DataFrame:
    """Queries: vectors, terms in turn, and the groups that the asker is in."""
    vectors = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("q"), F.col("embedding").cast("array<double>").alias("vector"))
    n = (F.col("q") / EVERY).cast("int")
    terms = F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in TERMS]), n % len(TERMS) + 1)
    groups = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("g:GROUP_src"), ((n * 4 + i) % 20).cast("string")))
    out = vectors.select("q", "vector", terms.alias("terms"), F.concat(F.array(F.lit("__Everyone__")), groups).alias("tokens"))
    return out if tokens else out.drop("tokens")


def shown(rows: DataFrame, *scores: str) -> DataFrame:
    """Scores to nine digits, as sums of another order may differ in the last ones."""
    return rows.withColumns({c: F.round(c, 9) for c in scores})


CORPUS = """corpus AS (SELECT d.doc_id AS key, d.doc_id, d.text, lower(d.text) AS low, d.lang, d.source, e.embedding::DOUBLE[] AS v
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)),
qs AS (SELECT vec_id AS q, vec_id // 100 AS n, embedding::DOUBLE[] AS qv, [['that','with'], ['der','keit'], ['que','ment'], ['ción','las'], ['tion','ing']][1 + vec_id // 100 % 5] AS terms FROM embeddings WHERE vec_id % 100 = 0),
"""
ALLOWED = "(c.doc_id % 5 = 0 OR ((CAST(substr(c.source, 4) AS INT) - qs.n * 4) % 20 + 20) % 20 <= 9)"
SCORED = CORPUS + f"""scored AS (SELECT qs.q, qs.terms, c.key, c.low, c.lang, list_cosine_similarity(c.v, qs.qv) AS cosine FROM corpus c, qs WHERE {ALLOWED}),
"""
BM25 = "list_sum(list_transform({t}, lambda t: ((length(low) - length(replace(low, t, ''))) / length(t)) * 2.2::DOUBLE / (((length(low) - length(replace(low, t, ''))) / length(t)) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(regexp_split_to_array(regexp_replace(low, '\\s+$', ''), '\\s+')) / 100.0::DOUBLE)))) / len({t})"
LEGS = f"""vec AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, key) AS r FROM scored QUALIFY r <= 30),
held AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, key) AS wr FROM scored WHERE len(list_filter(terms, lambda t: contains(low, t))) > 0 QUALIFY wr <= 30),
kb AS (SELECT *, {BM25.format(t="terms")} AS bm25 FROM held),
kw AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bm25 DESC, wr) AS r FROM kb WHERE bm25 > 0 QUALIFY r <= 30),
fused AS (SELECT coalesce(v.q, k.q) AS q, coalesce(v.key, k.key) AS key, v.cosine AS vector_score, v.r AS vector_rank, k.bm25 AS keyword_score, k.r AS keyword_rank FROM vec v FULL JOIN kw k ON v.q = k.q AND v.key = k.key),
"""
OUT = """SELECT q, CAST(rank AS INT) AS rank, key, round(score, 9) AS score, round(vector_score, 9) AS vector_score, round(keyword_score, 9) AS keyword_score, CAST(vector_rank AS INT) AS vector_rank, CAST(keyword_rank AS INT) AS keyword_rank FROM ranked"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vector_rank ASC NULLS LAST, keyword_rank ASC NULLS LAST, key) AS rank FROM final{where} QUALIFY rank <= 10)\n"
RRF = "final AS (SELECT *, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS score FROM fused),\n"
HYBRID = ("score", "vector_score", "keyword_score")


@query("WITH " + SCORED + LEGS + RRF + RANKED.format(where=" WHERE score >= 0.01") + OUT)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = asked(spark, sf_dir)
    return shown(search.hybrid_search(chunks(spark, sf_dir, queries), queries, 30, 10, 0.01), *HYBRID)


def _weighted(how: str, vector: float = 0.7, keyword: float = 0.3) -> str:
    norm = {
        "max": "CASE WHEN {s} IS NULL THEN 0.0 WHEN max({s}) OVER w > 0 THEN {s} / max({s}) OVER w ELSE 0.0 END",
        "minmax": "CASE WHEN {s} IS NULL THEN 0.0 WHEN max({s}) OVER w > min({s}) OVER w THEN ({s} - min({s}) OVER w) / (max({s}) OVER w - min({s}) OVER w) WHEN max({s}) OVER w > 0 THEN 1.0 ELSE 0.0 END",
    }[how]
    final = f"final AS (SELECT *, {vector}::DOUBLE * ({norm.format(s='vector_score')}) + {keyword}::DOUBLE * ({norm.format(s='keyword_score')}) AS score FROM fused WINDOW w AS (PARTITION BY q)),\n"
    return "WITH " + SCORED + LEGS + final + RANKED.format(where="") + OUT


@query(_weighted("max"))
def hybrid_weighted_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = asked(spark, sf_dir)
    return shown(search.hybrid_search(chunks(spark, sf_dir, queries), queries, 30, 10, fusion="weighted", normalisation="max"), *HYBRID)


@query(_weighted("minmax"))
def hybrid_weighted_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = asked(spark, sf_dir)
    return shown(search.hybrid_search(chunks(spark, sf_dir, queries), queries, 30, 10, fusion="weighted", normalisation="minmax"), *HYBRID)


@query(_weighted("max", 0.7, 0.9))
def hybrid_weight_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight of 0 in a request stands for the default one."""
    queries = asked(spark, sf_dir)
    return shown(search.hybrid_search(chunks(spark, sf_dir, queries), queries, 30, 10, fusion="weighted", weights=(0.0, 0.9)), *HYBRID)


def _semantic(least: float, most: int) -> str:
    return "WITH " + SCORED + f"r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, key) AS rank FROM scored WHERE cosine >= {least}::DOUBLE QUALIFY rank <= {most}) SELECT q, CAST(rank AS INT) AS rank, key, round(cosine, 9) AS score FROM r"


@query(_semantic(0.05, 20))
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.semantic_search(chunks(spark, sf_dir), asked(spark, sf_dir), 20, 0.05), "score")


@query(_semantic(0.5, 20))
def semantic_default_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A floor of 0, below it or that is no number stands for the default one."""
    return shown(search.semantic_search(chunks(spark, sf_dir), asked(spark, sf_dir), 20, 0.0), "score")


@query("WITH " + SCORED + LEGS + "x AS (SELECT 1) SELECT q, CAST(r AS INT) AS rank, key, round(bm25, 9) AS score FROM kw")
def keyword_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = asked(spark, sf_dir)
    return shown(search.keyword_search(chunks(spark, sf_dir, queries), queries, 30), "score")


@query("WITH " + SCORED + LEGS + "x AS (SELECT 1) SELECT q, CAST(r AS INT) AS rank, key, round(bm25, 9) AS score FROM kw")
def keyword_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an index of trigrams, built here, of the texts; the vectors stay where they are."""
    docs, queries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "doc_id", "text", "lang", "source"), asked(spark, sf_dir)
    index = TermIndex.build(docs, f"{scratch_root(spark)}/lakeloom/terms-{uuid.uuid4().hex}")
    return shown(search.keyword_search(chunks(spark, sf_dir, queries, index.posted(queries)), queries, 30), "score")


@query("WITH " + SCORED + "r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, key) AS rank FROM scored QUALIFY rank <= 20) SELECT q, CAST(rank AS INT) AS rank, key, round(cosine, 9) AS score FROM r")
def semantic_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest chunks through an inverted file of vectors, built here, searched until no list can hold a nearer one."""
    index = VectorIndex.build(chunks(spark, sf_dir), f"{scratch_root(spark)}/lakeloom/vectors-{uuid.uuid4().hex}")
    return shown(index.nearest(asked(spark, sf_dir), 20, columns=()).select("q", F.col("rank").cast("int").alias("rank"), "key", F.col("cosine").alias("score")), "score")


@query("WITH " + SCORED + "r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, key) AS rank FROM scored WHERE len(list_filter(terms, lambda t: contains(low, t))) > 0 QUALIFY rank <= 10) SELECT q, CAST(rank AS INT) AS rank, key, round(cosine, 9) AS score FROM r")
def chunk_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms as a condition of the vector search."""
    queries = asked(spark, sf_dir)
    holding = search.candidates(chunks(spark, sf_dir, queries), queries, ("keyword",), 10, columns=())
    return shown(holding.select("q", F.col("rank").cast("int").alias("rank"), "key", F.col("cosine").alias("score")), "score")


# Each query with two more variants of it, whose vectors lie a few rows on
VARIANTS = """vs AS (SELECT qs.q, t.v AS variant, e.embedding::DOUBLE[] AS qv, qs.n FROM qs, range(3) t(v), embeddings e WHERE e.vec_id = (qs.q + t.v * 7) % (SELECT count(*) FROM embeddings)),
vscored AS (SELECT qs.q, qs.variant, c.key, list_cosine_similarity(c.v, qs.qv) AS cosine FROM corpus c, vs qs WHERE """ + ALLOWED + """),
hits AS (SELECT q, CAST(variant AS INT) AS variant, CAST(row_number() OVER (PARTITION BY q, variant ORDER BY cosine DESC, key) AS INT) AS rank, key, cosine AS score FROM vscored QUALIFY rank <= 20),
"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("turn"), F.col("embedding").cast("array<double>").alias("vector"))
    many = vectors.count()
    each = asked(spark, sf_dir).drop("vector").withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("turn", (F.col("q") + F.col("variant") * 7) % many)
    named = each.join(vectors, "turn").withColumn("q", F.struct("q", "variant"))
    hits = search.nearest(chunks(spark, sf_dir), named.select("q", "vector", "terms", "tokens"), 20, columns=())
    return hits.select("q.q", "q.variant", "rank", "key", F.col("cosine").alias("score"))


def _fused(kept: str) -> str:
    return "WITH " + SCORED + VARIANTS + f"s AS (SELECT q, key, round(list_sum(list_sort(list(1.0::DOUBLE / (60 + rank)))), 12) AS fused, {kept} AS score, min(variant * 1000 + rank) AS seen FROM hits GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY fused DESC, seen, key) AS rank FROM s QUALIFY rank <= 15) SELECT q, CAST(rank AS INT) AS rank, key, round(score, 9) AS score, round(fused, 9) AS fused FROM r"


@query(_fused("max(score)"))
def multi_variant_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.fuse_variants(_variants(spark, sf_dir), 15, keep="best"), "score", "fused")


@query(_fused("arg_min(score, variant * 1000 + rank)"))
def multi_variant_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.fuse_variants(_variants(spark, sf_dir), 15, keep="first"), "score", "fused")


@query("WITH " + SCORED + VARIANTS + "h AS (SELECT q, variant, count(*) AS n FROM (SELECT * FROM hits WHERE score >= 0.3) GROUP BY 1, 2) SELECT q, max(n) AS largest, CAST(sum(n) AS BIGINT) AS total FROM h GROUP BY 1")
def variant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.variant_counts(_variants(spark, sf_dir).where("score >= 0.3"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.alias("a").join(e.alias("b"), F.expr("b.vec_id = a.vec_id + 1")).select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), F.round(V.cosine(F.col("a.v"), F.col("b.v")), 9).alias("cosine"))


@query("WITH " + SCORED + "r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, key) AS rank FROM scored QUALIFY rank <= 5) SELECT r.q, CAST(r.rank AS INT) AS rank, r.key AS doc_id, d.lang, d.source FROM r LEFT JOIN documents d ON d.doc_id = r.key")
def enrich_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.nearest(chunks(spark, sf_dir), asked(spark, sf_dir), 5, columns=())
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return search.enrich(hits.select("q", F.col("rank").cast("int").alias("rank"), F.col("key").alias("doc_id")), docs).select("q", "rank", "doc_id", "lang", "source")


# Access control

OWNED = "owned AS (SELECT doc_id, source AS source_id, lang, CASE WHEN doc_id % 5 = 0 THEN ['__Everyone__', 'g:GROUP_' || lang || '_#_' || source] WHEN doc_id % 7 = 0 THEN ['u:ann_#_' || source] ELSE ['g:GROUP_' || lang || '_#_' || source] END AS racl FROM documents) "


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat(F.lit("g:GROUP_"), "lang", F.lit("_#_"), "source")
    racl = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("__Everyone__"), group)).when(F.col("doc_id") % 7 == 0, F.array(F.concat(F.lit("u:ann_#_"), "source"))).otherwise(F.array(group))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), "lang", racl.alias("racl"))


@query("WITH " + OWNED + "SELECT doc_id, source_id FROM owned WHERE list_has_any(racl, ['__Everyone__', 'u:ann_#_src1', 'g:GROUP_EVERYONE_#_src1', 'g:GROUP_en_#_src1', 'g:GROUP_de_#_src1'])")
def acl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = acl.Asker((acl.Principal("src1", "ann", ("GROUP_EVERYONE", "en", "GROUP_de")),))
    return owned(spark, sf_dir).where(acl.permitted(F.col("racl"), F.col("source_id"), who)).select("doc_id", "source_id")


@query("WITH " + OWNED + "SELECT doc_id, source_id FROM owned WHERE source_id = 'src2' OR list_has_any(racl, ['__Everyone__', 'u:root_#_src2', 'u:ann_#_src1', 'g:GROUP_fr_#_src1'])")
def acl_admin_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = acl.Asker((acl.Principal("src2", "root", admin=True), acl.Principal("src1", "ann", ("fr",))))
    return owned(spark, sf_dir).where(acl.permitted(F.col("racl"), F.col("source_id"), who)).select("doc_id", "source_id")


@query("WITH " + OWNED + "SELECT doc_id, source_id FROM owned WHERE list_has_any(racl, ['__Everyone__', 'u:ann_#_src3', 'g:GROUP_en_#_src3'])")
def dual_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second source gives the asker no user name, so it counts for nothing."""
    who = acl.Asker((acl.Principal("src3", "ann", ("en",)), acl.Principal("src4", None, ("en",), admin=True)))
    return owned(spark, sf_dir).where(acl.permitted(F.col("racl"), F.col("source_id"), who)).select("doc_id", "source_id")


@query("SELECT doc_id, false AS seen FROM documents")
def acl_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned(spark, sf_dir).select("doc_id", acl.permitted(F.col("racl"), F.col("source_id"), acl.Asker()).alias("seen"))


@query("""WITH a AS (SELECT doc_id AS node_id, p AS pos, CASE WHEN p = 2 THEN 'GROUP_EVERYONE' ELSE ['ann','GROUP_dev','bob'][1 + (doc_id + p) % 3] END AS principal, (doc_id + p) % 4 <> 0 AS granted,
  CASE WHEN doc_id % 6 = 0 AND p = 0 THEN 'archived' ELSE NULL END AS status, CASE WHEN p = 3 AND doc_id % 2 = 0 THEN 'Write' ELSE 'Read' END AS permission FROM documents, range(4) t(p)),
e AS (SELECT * FROM a WHERE (status IS NULL OR status = 'effective') AND permission IN ('Read','ReadVersion','ReadWrite','Everything')),
p AS (SELECT DISTINCT node_id, principal FROM e)
SELECT p.node_id, p.principal, arg_min(e.granted, e.pos) AS granted FROM p JOIN e ON e.node_id = p.node_id AND (e.principal = p.principal OR e.principal = 'GROUP_EVERYONE') GROUP BY 1, 2""")
def ace_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    aces = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("p")).select(
        F.col("doc_id").alias("node_id"), p.cast("long").alias("pos"),
        F.when(p == 2, "GROUP_EVERYONE").otherwise(F.element_at(F.array(F.lit("ann"), F.lit("GROUP_dev"), F.lit("bob")), (1 + (F.col("doc_id") + p) % 3).cast("int"))).alias("principal"),
        ((F.col("doc_id") + p) % 4 != 0).alias("granted"),
        F.when((F.col("doc_id") % 6 == 0) & (p == 0), "archived").alias("status"),
        F.when((p == 3) & (F.col("doc_id") % 2 == 0), "Write").otherwise("Read").alias("permission"),
    )
    return acl.first_match_readers(aces)


@query("""WITH p AS (SELECT doc_id AS node_id, 'user' || i AS authority, ['Consumer','SiteManager','Guest','Read','SiteGuest'][1 + (doc_id + i) % 5] AS role, CASE WHEN (doc_id + i) % 7 = 0 THEN 'DENIED' ELSE 'ALLOWED' END AS access_status,
  i >= 2 AS inherited, CASE WHEN doc_id % 3 = 0 THEN false WHEN doc_id % 3 = 1 THEN true ELSE NULL END AS inheritance_enabled FROM documents, range(4) t(i))
SELECT node_id, array_to_string(list_sort(list(DISTINCT authority) FILTER (WHERE access_status = 'ALLOWED' AND role IN ('Consumer','SiteManager','Read') AND (NOT inherited OR coalesce(inheritance_enabled, true)))), ',') AS readers FROM p GROUP BY 1""")
def acl_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = F.col("doc_id"), F.col("i")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select(
        d.alias("node_id"), F.concat(F.lit("user"), i.cast("string")).alias("authority"),
        F.element_at(F.array(*map(F.lit, ("Consumer", "SiteManager", "Guest", "Read", "SiteGuest"))), (1 + (d + i) % 5).cast("int")).alias("role"),
        F.when((d + i) % 7 == 0, "DENIED").otherwise("ALLOWED").alias("access_status"), (i >= 2).alias("inherited"),
        F.when(d % 3 == 0, False).when(d % 3 == 1, True).alias("inheritance_enabled"),
    )
    found = acl.inherited_readers(rows)
    return found.select("node_id", F.when(F.size("readers") > 0, F.array_join("readers", ",")).alias("readers"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([CASE WHEN doc_id % 5 = 0 THEN '__Everyone__' ELSE 'g:GROUP_' || lang || '_#_' || source END, 'u:bob_#_' || source])), ',') AS tokens FROM documents")
def acl_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    readers = F.array(F.when(F.col("doc_id") % 5 == 0, "GROUP_EVERYONE").otherwise(F.concat(F.lit("GROUP_"), "lang")), F.lit(" bob "), F.lit(""), F.lit(None))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(acl.reader_tokens(readers, F.col("source"))), ",").alias("tokens"))


# Filters

META = """meta AS (SELECT doc_id, source || ':' || lang AS source_id, lower(lang) AS source_type, CASE WHEN doc_id % 3 = 0 THEN 'text/plain' ELSE 'text/html' END AS mime_type, '/' || source || '/' || lang || '/d' || doc_id AS path,
  '2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') AS modified_at, lang AS label FROM documents) """


def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat_ws(":", "source", "lang").alias("source_id"), F.lower("lang").alias("source_type"),
        F.when(d % 3 == 0, "text/plain").otherwise("text/html").alias("mime_type"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/d"), d.cast("string")).alias("path"),
        F.concat(F.lit("2024-01-"), F.lpad((1 + d % 28).cast("string"), 2, "0")).alias("modified_at"), F.col("lang").alias("label"), F.create_map(F.lit("lang"), F.col("lang")).alias("properties"),
    )


@query("WITH " + META + "SELECT doc_id, path FROM meta WHERE mime_type = 'text/html' AND starts_with(path, '/src1') AND modified_at BETWEEN '2024-01-05' AND '2024-01-20' AND label = 'en'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = filters.MetadataFilter("text/html", "/src1", "2024-01-05", "2024-01-20", {"lang": "English", "bad key'": "x"})
    return metadata_rows(spark, sf_dir).where(filters.metadata(wanted, {"English": "en"})).select("doc_id", "path")


@query("WITH " + META + "SELECT doc_id FROM meta WHERE source_type = 'de' AND mime_type = 'text/plain'")
def named_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = filters.NamedQueries({"plain": lambda: F.col("mime_type") == "text/plain"})
    return metadata_rows(spark, sf_dir).where(search.all_of(filters.source_type(" DE "), stored.get("plain"), stored.get("unknown"))).select("doc_id")


@query("WITH " + META + "SELECT doc_id, CASE label WHEN 'en' THEN 'lang.english' WHEN 'fr' THEN 'lang.french' ELSE label END AS label FROM meta")
def vocab_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([("en", "lang.english", 1), ("en", "lang.other", 2), ("fr", "lang.french", 3)], "label string, key string, no int")
    return filters.resolve_labels(metadata_rows(spark, sf_dir), "label", words).select("doc_id", "label")


@query("WITH " + META + "SELECT DISTINCT source_id FROM meta WHERE source_type = 'fr'")
def source_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.source_ids(metadata_rows(spark, sf_dir), "fr")


# Facets and states

@query("SELECT source AS key, count(*) AS doc_count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def facets_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.facets(table(spark, sf_dir, "documents"), F.col("source"))


@query("WITH " + OWNED + "SELECT lang AS key, count(*) AS doc_count FROM owned WHERE list_has_any(racl, ['__Everyone__', 'u:ann_#_src1', 'g:GROUP_en_#_src1']) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def facets_lang_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = acl.Asker((acl.Principal("src1", "ann", ("en",)),))
    return status.facets(owned(spark, sf_dir), F.col("lang"), 3, acl.permitted(F.col("racl"), F.col("source_id"), who))


@query("SELECT o_orderpriority AS key, count(*) AS doc_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def facets_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: facets at the scale of a large table."""
    return status.facets(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), 1000)


STATES = "st AS (SELECT d.doc_id, d.source AS folder_id, CASE l.quality WHEN 1 THEN 'INDEXED' WHEN 0 THEN 'FAILED' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)) "


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("quality") == 1, "INDEXED").when(F.col("quality") == 0, "FAILED")
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("source").alias("folder_id"), state.alias("status"))


@query("WITH " + STATES + ", c AS (SELECT folder_id, count(*) AS total, count(*) FILTER (status = 'INDEXED') AS indexed, count(*) FILTER (status = 'FAILED') AS failed FROM st GROUP BY 1) SELECT folder_id, total, indexed, failed, total - indexed - failed AS pending, CASE WHEN failed > 0 THEN 'FAILED' WHEN total > indexed THEN 'PENDING' ELSE 'INDEXED' END AS status, CASE WHEN failed > 0 THEN failed || ' document(s) failed indexing' END AS error FROM c")
def folder_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.folder_status(_states(spark, sf_dir))


@query("WITH " + STATES + "SELECT doc_id AS node_id, status IS NOT NULL AS present, CASE WHEN doc_id % 11 = 0 THEN 'INDEXED' ELSE coalesce(status, 'PENDING') END AS status FROM st")
def node_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = _states(spark, sf_dir)
    nodes = st.select(F.col("doc_id").alias("node_id"), F.when(F.col("doc_id") % 11 == 0, "odd word").alias("own_status"))
    return status.node_status(nodes, st.where("status is not null").select(F.col("doc_id").alias("node_id"), F.col("status").alias("sync_status")))


@query("WITH " + SCORED + "r AS (SELECT q, cosine AS score, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, key) AS rank FROM scored QUALIFY rank <= 10) SELECT q, count(*) FILTER (score >= 0.3) AS good, CASE WHEN count(*) FILTER (score >= 0.3) >= 3 THEN 'RELEVANT' ELSE 'WEAK' END AS verdict FROM r GROUP BY 1")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.nearest(chunks(spark, sf_dir), asked(spark, sf_dir), 10, columns=())
    return status.relevance(hits.select("q", F.col("cosine").alias("score")), 0.3, 3)


_MMR = """h AS (SELECT qs.q, c.key, list_cosine_similarity(c.v, qs.qv) AS score, c.v FROM corpus c, qs WHERE """ + ALLOWED + """),
p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS rank FROM h QUALIFY rank <= {pool}),
near AS (SELECT a.q, a.key AS a, b.key AS b, greatest(0.0, list_cosine_similarity(a.v, b.v)) AS near FROM p a JOIN p b ON a.q = b.q),
walk AS (SELECT q, 1 AS n, [arg_max(key, {trade}::DOUBLE * score - rank * 1e-15)] AS chosen FROM p GROUP BY 1
  UNION ALL SELECT w.q, w.n + 1, list_append(w.chosen, (SELECT c.key FROM (SELECT p.key, p.rank, {trade}::DOUBLE * p.score - (1 - {trade}::DOUBLE) * (SELECT max(near) FROM near WHERE near.q = w.q AND near.a = p.key AND list_contains(w.chosen, near.b)) AS value FROM p WHERE p.q = w.q AND NOT list_contains(w.chosen, p.key)) c ORDER BY c.value DESC, c.rank LIMIT 1)) FROM walk w WHERE w.n < {k}),
picked AS (SELECT q, unnest(chosen) AS key, generate_subscripts(chosen, 1) AS rank FROM walk WHERE n = {k})
"""


@query("WITH RECURSIVE " + CORPUS + _MMR.format(pool=30, trade=0.6, k=8) + "SELECT picked.q, CAST(picked.rank AS INT) AS rank, picked.key, round(p.score, 9) AS score FROM picked JOIN p ON p.q = picked.q AND p.key = picked.key")
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.nearest(chunks(spark, sf_dir), asked(spark, sf_dir), 30, columns=("vector",))
    return shown(rag.mmr(hits.select("q", "rank", "key", F.col("cosine").alias("score"), "vector"), 8, 0.6).select("q", "rank", "key", "score"), "score")


@query("WITH " + SCORED + "h AS (SELECT q, key, cosine AS score, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, key) AS rank FROM scored QUALIFY rank <= 20), j AS (SELECT h.*, CASE WHEN key % 3 <> 0 THEN CAST(key * 7919 % 101 AS DOUBLE) END AS rs FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rs DESC NULLS LAST, rank) AS nr FROM j QUALIFY nr <= 8) SELECT q, key, CAST(nr AS INT) AS rank, round(coalesce(rs, score), 9) AS score FROM r")
def rerank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.nearest(chunks(spark, sf_dir), asked(spark, sf_dir), 20, columns=()).select("q", "key", "rank", F.col("cosine").alias("score"))
    scores = hits.where("key % 3 <> 0").select("q", "key", (F.col("key") * 7919 % 101).cast("double").alias("rerank_score"))
    return shown(rag.rerank(hits, scores, 8, replace=True), "score")


@query("WITH " + SCORED + "h AS (SELECT q, key, cosine AS score, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, key) AS rank FROM scored QUALIFY rank <= 20) SELECT q, key, CAST(rank AS INT) AS rank, round(score, 9) AS score FROM h WHERE rank <= 8")
def rerank_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without scores from the reranker the first hits stay as they are."""
    hits = search.nearest(chunks(spark, sf_dir), asked(spark, sf_dir), 20, columns=()).select("q", "key", "rank", F.col("cosine").alias("score"))
    return shown(rag.rerank(hits, None, 8, replace=True), "score")


# The strict pass asks for 5 hits of 0.3 at least, the broadened one for 12 of any score; 3 of 0.35 make either relevant
@query("WITH " + SCORED + """h AS (SELECT q, key, cosine AS score, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, key) AS rank FROM scored QUALIFY rank <= 12),
x AS (SELECT q, key, score, key * 7919 % 101 AS rs, rank FROM h),
strict AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rs DESC, rank) AS nr FROM x WHERE score >= 0.3 AND rank <= 5),
broad AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rs DESC, rank) AS nr FROM x),
gs AS (SELECT q FROM strict WHERE score >= 0.35 GROUP BY 1 HAVING count(*) >= 3), gb AS (SELECT q FROM broad WHERE score >= 0.35 GROUP BY 1 HAVING count(*) >= 3)
SELECT q, key, CAST(nr AS INT) AS rank, round(score, 9) AS score FROM strict WHERE q IN (SELECT q FROM gs)
UNION ALL SELECT q, key, CAST(nr AS INT), round(score, 9) FROM broad WHERE q NOT IN (SELECT q FROM gs) AND q IN (SELECT q FROM gb)""")
def gated_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieve, rerank, grade; one broadened pass where that is weak, and nothing where it still is."""

    def reranked(hits: DataFrame) -> DataFrame:
        hits = hits.select("q", "key", "rank", F.col("cosine").alias("score"))
        return rag.rerank(hits, hits.select("q", "key", (F.col("key") * 7919 % 101).cast("double").alias("rerank_score")), 12)

    pool = search.nearest(chunks(spark, sf_dir), asked(spark, sf_dir), rag.broadened(5, 12), columns=())
    strict = pool.where("cosine >= 0.3 and rank <= 5")
    return shown(rag.gated(reranked(strict), reranked(pool), 0.35, 3), "score")
