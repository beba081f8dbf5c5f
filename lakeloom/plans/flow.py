"""Queries of ingest, scope, context and streams."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import acl, ingest, rag, scope, status
from lakeloom.plans.book import book, table
from lakeloom.plans.lexical import PAGES, page_paths
from lakeloom.session import scratch_root
from lakeloom.sources import audit
from lakeloom.sources.committed import CommittedTable
from lakeloom.streaming import events as E
from lakeloom.streaming import metrics

BOOK, query = book()

# Versions of nodes: a user's events before and after a moment stand for what is stored and what comes.
SPLIT = "event_id % 2"
VERSIONS = """v AS (SELECT user_id AS node_id, ts AS modified_at, event_type AS name, CAST(event_id AS VARCHAR) AS acl, event_id FROM events),
stored AS (SELECT * FROM v WHERE event_id % 2 = 0 AND node_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY modified_at DESC, event_id DESC) = 1),
inc AS (SELECT * FROM v WHERE event_id % 2 = 1 AND node_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY modified_at DESC, event_id DESC) = 1)
"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.col("ts").alias("modified_at"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("acl"), "event_id")
    order = [F.desc("modified_at"), F.desc("event_id")]
    stored = ingest.latest(v.where("event_id % 2 = 0 and node_id % 3 <> 0"), "node_id", order)
    return stored.drop("event_id"), ingest.latest(v.where("event_id % 2 = 1 and node_id % 5 <> 0"), "node_id", order).drop("event_id")


@query("WITH " + VERSIONS + """SELECT coalesce(s.node_id, i.node_id) AS node_id, CASE WHEN i.node_id IS NULL OR (s.node_id IS NOT NULL AND NOT i.modified_at > s.modified_at) THEN s.modified_at ELSE i.modified_at END AS modified_at,
CASE WHEN i.node_id IS NULL OR (s.node_id IS NOT NULL AND NOT i.modified_at > s.modified_at) THEN s.name ELSE i.name END AS name, CASE WHEN i.node_id IS NULL THEN s.acl ELSE i.acl END AS acl,
CASE WHEN i.node_id IS NULL THEN 'kept' WHEN s.node_id IS NULL THEN 'created' WHEN NOT i.modified_at > s.modified_at THEN 'acl_only' ELSE 'updated' END AS outcome FROM stored s FULL JOIN inc i ON s.node_id = i.node_id""")
def staleness_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _versions(spark, sf_dir)
    return ingest.sync(stored, incoming, "node_id", "modified_at", ("acl",))


REPEATED = """v AS (SELECT user_id AS node_id, CASE WHEN event_id % 101 = 1 THEN NULL ELSE ts END AS modified_at, event_type AS name, CAST(event_id AS VARCHAR) AS acl, event_id FROM events),
stored AS (SELECT * FROM v WHERE event_id % 2 = 0 AND node_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY modified_at DESC, event_id DESC) = 1),
t AS (SELECT *, max(CASE WHEN modified_at IS NULL THEN event_id END) OVER (PARTITION BY node_id) AS p, max(event_id) OVER (PARTITION BY node_id) AS ends FROM v WHERE event_id % 2 = 1 AND node_id % 5 <> 0),
w AS (SELECT node_id, modified_at, name, p, CAST(ends AS VARCHAR) AS acl FROM t WHERE p IS NULL OR event_id >= p QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY modified_at DESC NULLS LAST, event_id) = 1),
j AS (SELECT coalesce(s.node_id, w.node_id) AS node_id, s.node_id AS sn, w.node_id AS wn, s.modified_at AS sm, w.modified_at AS wm, s.name AS sname, w.name AS wname, s.acl AS sacl, w.acl AS wacl,
  s.node_id IS NOT NULL AND w.node_id IS NOT NULL AND w.p IS NULL AND sm IS NOT NULL AND wm IS NOT NULL AND NOT wm > sm AS old FROM stored s FULL JOIN w ON s.node_id = w.node_id)
"""


@query("WITH " + REPEATED + "SELECT node_id, CASE WHEN wn IS NULL OR old THEN sm ELSE wm END AS modified_at, CASE WHEN wn IS NULL OR old THEN sname ELSE wname END AS name, CASE WHEN wn IS NULL THEN sacl ELSE wacl END AS acl FROM j")
def committed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a user's odd events synced in turn, some without a time, into a committed table that is read back."""
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.when(F.col("event_id") % 101 != 1, F.col("ts")).alias("modified_at"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("acl"), "event_id")
    stored = ingest.latest(v.where("event_id % 2 = 0 and node_id % 3 <> 0"), "node_id", [F.desc("modified_at"), F.desc("event_id")]).drop("event_id")
    lake = CommittedTable.create(spark, f"{scratch_root(spark)}/lakeloom/merge-{uuid.uuid4().hex}", stored.schema, "node_id", 16)
    lake.overwrite(stored)
    ingest.commit_sync(lake, v.where("event_id % 2 = 1 and node_id % 5 <> 0"), "modified_at", ("acl",), "event_id")
    return lake.read()


@query("""SELECT doc_id AS node_id, lang AS props_lang, CASE WHEN doc_id % 3 = 1 THEN source END AS props_source, CASE WHEN doc_id % 3 = 1 THEN n_chars END AS first_chars, CASE WHEN doc_id % 3 = 1 THEN doc_id % 7 = 0 END AS checked FROM documents WHERE doc_id % 3 < 2""")
def evolved_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose nested schema grows between two changes; old and new files read as one."""
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("node_id"), F.struct("lang").alias("props"), F.array(F.struct(F.lit(0).alias("page"))).alias("parts"))
    new = docs.where("doc_id % 3 = 1").select(F.col("doc_id").alias("node_id"), F.struct("source", "lang").alias("props"), F.array(F.struct(F.lit(0).alias("page"), "n_chars")).alias("parts"), (F.col("doc_id") % 7 == 0).alias("checked"))
    lake = CommittedTable.create(spark, f"{scratch_root(spark)}/lakeloom/evolved-{uuid.uuid4().hex}", old.schema, "node_id", 8)
    lake.overwrite(old)
    lake.evolve(new.schema)
    lake.change(new, lambda stored: stored.unionByName(ingest.conform(new, stored.schema)))
    return lake.read().select("node_id", F.col("props.lang").alias("props_lang"), F.col("props.source").alias("props_source"), F.col("parts")[0]["n_chars"].alias("first_chars"), "checked")


@query("WITH " + VERSIONS + "SELECT s.node_id, s.modified_at FROM stored s WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.node_id = s.node_id AND NOT s.modified_at > i.modified_at)")
def delete_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _versions(spark, sf_dir)
    return ingest.delete(stored, incoming.select("node_id", F.col("modified_at").alias("deleted_at")), "node_id", "modified_at").select("node_id", "modified_at")


@query("WITH " + VERSIONS + "SELECT coalesce(s.node_id, i.node_id) AS node_id, coalesce(s.name, i.name) AS name, coalesce(i.acl, s.acl) AS acl FROM stored s FULL JOIN inc i ON s.node_id = i.node_id WHERE s.node_id IS NOT NULL OR i.node_id % 2 = 0")
def acl_only_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _versions(spark, sf_dir)
    return ingest.update_acl(stored, incoming.withColumn("is_folder", F.col("node_id") % 2 != 0), "node_id", ("acl",)).select("node_id", "name", "acl")


@query("WITH c AS (SELECT doc_id % 300 AS cin_id, 'a:' || source AS wanted, CASE WHEN doc_id % 2 = 0 THEN 'a:' || source ELSE source END AS found, doc_id FROM documents) SELECT cin_id, found FROM c QUALIFY row_number() OVER (PARTITION BY cin_id ORDER BY (found = wanted) DESC, found) = 1")
def prefer_exact_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.concat(F.lit("a:"), "source")
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("cin_id"), full.alias("wanted"), F.when(F.col("doc_id") % 2 == 0, full).otherwise(F.col("source")).alias("found"))
    return ingest.prefer_exact(rows, "cin_id", "wanted", "found").select("cin_id", "found")


@query("SELECT vec_id AS doc_id, 'old' AS type FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, 'new' FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 'new2' FROM embeddings WHERE vec_id % 3 = 0")
def replace_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    fresh = e.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit("new"), F.lit("new2"))).alias("type"))
    return ingest.replace_children(e.withColumn("type", F.lit("old")), fresh, "doc_id")


@query("WITH i AS (SELECT doc_id AS node_id, '/' || source || '/' || (doc_id % 40) AS path, n_chars AS modified_at FROM documents WHERE doc_id % 2 = 0), s AS (SELECT '/' || source || '/' || (doc_id % 40) AS path, min(doc_id) AS known FROM documents WHERE doc_id % 2 = 1 AND doc_id % 4 = 1 GROUP BY 1), o AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY path ORDER BY modified_at DESC, node_id DESC) = 1) SELECT o.path, o.node_id, coalesce(s.known, o.node_id) AS document_id FROM o LEFT JOIN s USING (path)")
def path_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), "source", F.lit("/"), (F.col("doc_id") % 40).cast("string"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), path.alias("path"), F.col("n_chars").alias("modified_at"))
    stored = rows.where("node_id % 2 = 1 and node_id % 4 = 1").groupBy("path").agg(F.min("node_id").alias("node_id"))
    return ingest.resolve_paths(rows.where("node_id % 2 = 0"), stored).select("path", "node_id", "document_id")


@query("WITH " + PAGES + ", s AS (SELECT string_split(path, '/') AS a FROM p) SELECT DISTINCT unnest(list_transform(range(len(a) - 2, 0, -1), lambda n: '/' || array_to_string(a[2:n + 1], '/'))) AS folder FROM s WHERE len(a) > 2")
def ensure_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.folders(page_paths(spark, sf_dir))


def _scoped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = page_paths(spark, sf_dir).select("page_id", "path", F.lit(False).alias("is_folder"), F.when(F.col("page_id") % 4 == 0, "Note").otherwise("File").alias("type"), F.when(F.col("page_id") % 9 == 0, "Deleted").otherwise("project").alias("state"))
    marks = nodes.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).where("path <> ''").distinct()
    marked = marks.select("path", (F.length("path") % 4 != 0).alias("indexed"), (F.length("path") % 4 == 0).alias("excluded"))
    return nodes, marked


@query("WITH " + PAGES + """, m AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS spot FROM p WHERE regexp_replace(path, '/[^/]*$', '') <> ''),
s AS (SELECT page_id, path, string_split(path, '/') AS a FROM p WHERE page_id % 4 <> 0 AND page_id % 9 <> 0),
x AS (SELECT page_id, path, unnest(list_transform(range(len(a) - 1, 0, -1), lambda n: '/' || array_to_string(a[2:n + 1], '/'))) AS spot FROM s)
SELECT page_id, path FROM x JOIN m USING (spot) GROUP BY 1, 2 HAVING bool_or(length(spot) % 4 <> 0) AND NOT bool_or(length(spot) % 4 = 0)""")
def scope_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, marked = _scoped(spark, sf_dir)
    return scope.in_scope(nodes, marked, scope.Scope(roots=("/nowhere",), types=("File",), excluded_states=("deleted",))).select("page_id", "path")


@query("WITH " + PAGES + "SELECT page_id FROM p WHERE page_id % 4 <> 0 AND page_id % 9 <> 0 AND NOT contains(path, '7') AND length(path) > 1")
def scope_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, marked = _scoped(spark, sf_dir)
    none = marked.select("path", F.lit(False).alias("indexed"), F.lit(False).alias("excluded"))
    return scope.in_scope(nodes, none, scope.Scope(roots=("/",), types=("File",), excluded_states=("deleted",), excluded_globs=("*7*",))).where("length(path) > 1").select("page_id")


FOLDERS = PAGES + """, seg AS (SELECT page_id, path, string_split(path, '/') AS a FROM p),
fold AS (SELECT DISTINCT unnest(list_transform(range(len(a) - 2, 0, -1), lambda n: '/' || array_to_string(a[2:n + 1], '/'))) AS path FROM seg WHERE len(a) > 2),
"""


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("folder").alias("path")
    return ingest.folders(page_paths(spark, sf_dir)).select(path, F.lit(True).alias("is_folder"), F.lit("Folder").alias("type"), F.when(F.length("folder") % 5 == 0, F.array(F.lit("hidden"))).alias("aspects"))


@query("WITH " + FOLDERS + """m AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS spot FROM p WHERE regexp_replace(path, '/[^/]*$', '') <> ''),
up AS (SELECT path, unnest(list_transform(range(len(a) - 1, 0, -1), lambda n: '/' || array_to_string(a[2:n + 1], '/'))) AS spot FROM (SELECT path, string_split(path, '/') AS a FROM fold))
SELECT path FROM up JOIN m USING (spot) WHERE length(path) % 5 <> 0 GROUP BY 1 HAVING bool_or(length(spot) % 4 <> 0) AND NOT bool_or(length(spot) % 4 = 0)""")
def scope_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, marked = _scoped(spark, sf_dir)
    return scope.in_scope(_folders(spark, sf_dir), marked, scope.Scope(roots=("/nowhere",), types=("File",), excluded_aspects=("hidden",)), folders=True).select("path")


@query("WITH " + FOLDERS + "x AS (SELECT 1) SELECT path FROM fold WHERE NOT contains(path, '7') AND length(path) % 5 <> 0")
def scope_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.traversable(_folders(spark, sf_dir), scope.Scope(excluded_globs=("*7*",), excluded_aspects=("hidden",))).select("path")


@query("SELECT event_id FROM events WHERE event_id % 9 NOT IN (0, 7, 8)")
def status_only_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of nine events three change nothing but status; the others the title, name, content, association, place or an aspect, or lack the former image."""
    e = F.col("event_id") % 9
    image = "struct<name:string,node_type:string,content:string,primary_association:string,primary_hierarchy:array<string>,is_folder:boolean,aspects:array<string>,properties:map<string,string>>"
    null, when = F.lit(None), lambda k, c: F.when(e == k, c)
    after = F.struct(F.lit("n"), F.lit("t"), F.lit("c2"), F.lit("cm:contains"), F.array(F.lit("a"), F.lit("b")), F.lit(False), F.array(F.lit("cl:syncStatus"), F.lit("cm:titled")), F.create_map(F.lit("cl:syncStatus"), F.lit("INDEXED"), F.lit("cm:title"), F.lit("new"))).cast(image)
    title = F.when(e == 1, "old").otherwise("new")
    # 7: the former image carries no properties, so aspects aren't compared; 8: a status aspect came
    aspects = F.when(e == 6, F.array(F.lit("cm:other"))).when(e == 8, F.array(F.lit("cm:titled"), F.lit("cl:indexed"))).when(e == 7, F.array(F.lit("cm:other"))).otherwise(F.array(F.lit("cl:syncStatus"), F.lit("cm:titled")))
    properties = F.when(e != 7, F.create_map(F.lit("cl:syncStatus"), F.lit("PENDING"), F.lit("cm:modifier"), F.lit("x"), F.lit("cm:title"), title))
    before = F.struct(when(2, F.lit("m")), null, when(3, F.lit("c1")), when(4, F.lit("cm:other")), when(5, F.array(F.lit("a"))), null, aspects, properties).cast(image)
    rows = table(spark, sf_dir, "events").select("event_id", after.alias("after"), before.alias("before"))
    return rows.where(~scope.only_status_changed(F.col("before"), F.col("after"))).select("event_id")


@query("""WITH t AS (SELECT *, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || trim(text) AS line FROM conversations WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS block FROM t GROUP BY 1""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.history(table(spark, sf_dir, "conversations"), 4)


@query("""WITH h AS (SELECT doc_id % 50 AS q, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS rank, 'd' || doc_id AS name, text FROM documents),
e AS (SELECT q, rank, '[Source ' || rank || ': ' || name || ' (score: ' || printf('%.2f', 1.0::DOUBLE - rank / 100.0::DOUBLE) || ')]' || chr(10) || text || chr(10) || chr(10) AS entry FROM h),
b AS (SELECT *, coalesce(sum(length(entry)) OVER (PARTITION BY q ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
p AS (SELECT q, rank, CASE WHEN length(entry) <= 12000 - before THEN entry WHEN 12000 - before > 100 THEN substr(entry, 1, CAST(12000 - before AS INT)) || chr(10) || '... (context truncated)' END AS part FROM b)
SELECT q, trim(string_agg(part, '' ORDER BY rank)) AS context FROM p WHERE part IS NOT NULL GROUP BY 1""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").withColumn("q", F.col("doc_id") % 50)
    hits = docs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("doc_id")))
    return rag.pack_context(hits.select("q", "rank", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "text", (1.0 - F.col("rank") / 100.0).alias("score")), 12_000)


@query("""WITH v AS (SELECT conv_id AS q, turn AS no, trim(regexp_replace(text, '^\\s*(?:[-*•]|\\d+[.)])\\s*', '')) AS text FROM conversations), f AS (SELECT q, min(no) AS no, arg_min(text, no) AS text FROM v WHERE text <> '' AND upper(text) <> 'NONE' GROUP BY q, lower(text)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY no) AS place FROM f QUALIFY place <= 6) SELECT q, CAST(place AS INT) AS place, text FROM r""")
def variant_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.unique_variants(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("q"), F.col("turn").alias("no"), "text"))


# What a model would say: sub-questions, a passage and paraphrases, from a conversation's turns
SAID = """t AS (SELECT conv_id AS q, turn, role, text FROM conversations), asked AS (SELECT q, trim(text) AS text FROM t WHERE turn = 0 AND trim(text) <> ''),
lines AS (SELECT q, CASE role WHEN 'user' THEN 3 ELSE 1 END AS kind, turn, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t WHERE turn > 0 AND turn < 4),
"""


@query("WITH " + SAID + """bare AS (SELECT l.q, kind, turn, i, trim(regexp_replace(l.text, '^\\s*(?:[-*•]|\\d+[.)])\\s*', '')) AS text FROM lines l SEMI JOIN asked USING (q)),
alls AS (SELECT q, 0 AS kind, 0 AS turn, 0 AS i, text FROM asked UNION ALL SELECT q, kind, turn, i, text FROM bare WHERE text <> '' AND NOT (kind = 1 AND upper(text) = 'NONE')),
firsts AS (SELECT q, arg_min(kind, kind * 1000000 + turn * 1000 + i) AS kind, min(kind * 1000000 + turn * 1000 + i) AS no, arg_min(text, kind * 1000000 + turn * 1000 + i) AS text FROM alls GROUP BY q, lower(text)),
hyde AS (SELECT q, 2 AS kind, 2000000 AS no, substr(trim(text), 1, 1000) AS text FROM t SEMI JOIN asked USING (q) WHERE turn = 1 AND trim(text) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY no) AS n FROM (SELECT * FROM firsts UNION ALL SELECT * FROM hyde) QUALIFY n <= [1, 4, 1, 3][kind + 1])
SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY kind, n) AS INT) AS place, CASE kind WHEN 0 THEN 'original' WHEN 1 THEN 'sub-' || n WHEN 2 THEN 'hyde' ELSE 'variant-' || n END AS label, text, kind = 2 AS vector_only FROM n QUALIFY place <= 8""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first turn is the query; the answers of its assistant are sub-questions and, the first, a passage, the user's are paraphrases."""
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "q")
    some = turns.where("turn > 0 and turn < 4")
    lines = some.groupBy("q", F.when(F.col("role") == "user", "variant").otherwise("sub").alias("kind")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("answer"))
    passage = turns.where("turn = 1").select("q", F.lit("hyde").alias("kind"), F.col("text").alias("answer"))
    return rag.expand(turns.where("turn = 0").select("q", "text"), lines.unionByName(passage))


@query("""WITH h AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || trim(text), chr(10) ORDER BY turn) AS block FROM conversations WHERE trim(text) <> '' AND turn BETWEEN 1 AND 2 GROUP BY 1)
SELECT c.conv_id, 'Based on the conversation history and document context, answer the current question.' || repeat(chr(10), 2) || '--- CONVERSATION HISTORY ---' || chr(10) || coalesce(h.block, '(none)') || chr(10) || '--- END CONVERSATION HISTORY ---' || repeat(chr(10), 2) || '--- DOCUMENT CONTEXT ---' || chr(10) || 'ctx' || chr(10) || '--- END CONTEXT ---' || repeat(chr(10), 2) || 'Question: ' || c.text || repeat(chr(10), 2) || 'Answer:' AS prompt FROM conversations c LEFT JOIN h USING (conv_id) WHERE c.turn = 0""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    blocks = rag.history(turns.where("turn between 1 and 2"), 10)
    return turns.where("turn = 0").join(blocks, "conv_id", "left").select("conv_id", rag.prompt(F.col("text"), F.col("block"), F.lit("ctx")).alias("prompt"))


# Users with the groups of their countries' first letters, in two sources
@query("""WITH m AS (SELECT c_custkey AS user, 's' || c_custkey % 2 AS source_id, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE CASE WHEN c_nationkey % 2 = 0 THEN 'GROUP_' ELSE '' END || c_mktsegment END AS grp FROM customer WHERE c_custkey % 4 <> 1)
SELECT c_custkey AS q, array_to_string(list_concat(['__Everyone__'], CASE WHEN c_custkey % 7 = 0 THEN [] ELSE list_sort(list_distinct(list_concat(['u:' || c_custkey || '_#_s' || c_custkey % 2, 'g:GROUP_EVERYONE_#_s' || c_custkey % 2],
  coalesce((SELECT list('g:' || CASE WHEN starts_with(grp, 'GROUP_') THEN grp ELSE 'GROUP_' || grp END || '_#_' || source_id) FROM m WHERE m.user = c_custkey AND grp <> ''), [])))) END), ',') AS tokens FROM customer""")
def group_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("source_id", F.concat(F.lit("s"), (F.col("c_custkey") % 2).cast("string")))
    user = F.col("c_custkey").cast("string")
    group = F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.concat(F.when(F.col("c_nationkey") % 2 == 0, "GROUP_").otherwise(""), F.col("c_mktsegment")))
    members = c.where("c_custkey % 4 <> 1").select(user.alias("user"), "source_id", group.alias("group"))
    askers = c.select(F.col("c_custkey").alias("q"), F.when(F.col("c_custkey") % 7 != 0, user).alias("user"), "source_id")
    return acl.asker_tokens(askers, members).select("q", F.array_join("tokens", ",").alias("tokens"))


@query("SELECT vec_id AS doc_id, 'old' AS type FROM embeddings WHERE vec_id % 3 <> 0")
def delete_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("old").alias("type"))
    return ingest.delete_children(e, e.where("doc_id % 3 = 0"), "doc_id")


@query("SELECT vec_id AS doc_id, 'old' AS type FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, 'new' FROM embeddings WHERE vec_id % 6 = 0")
def replace_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners without fresh children are left without any."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("old").alias("type"))
    fresh = e.where("doc_id % 6 = 0").withColumn("type", F.lit("new"))
    return ingest.replace_children(e, fresh, "doc_id", e.where("doc_id % 3 = 0"))


@query("""WITH l AS (SELECT user_id AS node_id, arg_max(CASE WHEN event_type = 'signup' THEN 'clear' ELSE event_type END, event_id) AS kind, max(event_id) AS event_id FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT DISTINCT user_id AS node_id, 'OLD' AS status, NULL AS error FROM events WHERE user_id % 2 <> 0 OR user_id NOT IN (SELECT node_id FROM l) UNION ALL SELECT node_id, kind, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id END FROM l WHERE kind <> 'clear'""")
def status_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "node_id")
    states = events.select("node_id", F.lit("OLD").alias("status"), F.lit(None).cast("string").alias("error")).distinct()
    error = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).otherwise(F.lit(" \n"))
    changes = events.where("node_id % 2 = 0").select("node_id", F.when(F.col("event_type") != "signup", F.col("event_type")).alias("status"), error.alias("error"), F.col("event_id").alias("seq"))
    return ingest.write_status(states, changes)


@query("SELECT doc_id, array_to_string(CASE WHEN doc_id % 3 = 0 THEN ['a', 'b', lang] ELSE ['b', lang, 'a'] END, ',') AS mixins FROM documents")
def mixin_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 3 == 0
    first = F.when(d, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b")))
    second = F.when(d, F.array(F.col("lang"), F.lit("b"))).otherwise(F.array(F.col("lang"), F.lit(None), F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(ingest.ordered_union(first, second), ",").alias("mixins"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 2, 3) THEN 'FAILED' ELSE 'INDEXED' END AS status, CASE doc_id % 5 WHEN 0 THEN 'No extractable text produced for mimeType=text/plain' WHEN 1 THEN 'No extractable text produced for mimeType=null' WHEN 2 THEN 'No chunks produced from extracted text' WHEN 3 THEN 'timeout' END AS error FROM documents""")
def content_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id") % 5
    text = F.when(d == 0, F.lit(" \n\t\u2003")).when(d == 1, F.lit(None)).otherwise(F.concat(F.lit("x"), "text"))
    chunks = F.when(d == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("c")))
    made = ingest.process(text, chunks, F.when(d == 0, "text/plain"), F.when(d == 3, "timeout"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("o")).select("doc_id", "o.status", "o.error")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'lang=xx;n=1' ELSE 'lang=' || lang || ';src=' || source END AS properties FROM documents")
def json_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = lambda op, key, value: F.struct(F.lit(op).alias("op"), F.lit(key).alias("key"), F.lit(value).alias("value"))
    changes = F.when(F.col("doc_id") % 2 == 0, F.array(change("replace", "lang", "yy"), change("add", "n", "1"), change("remove", "src", None), change("replace", "lang", "xx"))).otherwise(F.array(change("add", "n", "1"), change("remove", "n", None)))
    had = F.create_map(F.lit("lang"), F.col("lang"), F.lit("src"), F.col("source"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.map_entries(ingest.patch(had, changes))).alias("p"))
    return rows.select("doc_id", F.array_join(F.transform("p", lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("properties"))


JOBS = "o AS (SELECT user_id % 20 AS job, CASE event_type WHEN 'view' THEN 'created' WHEN 'click' THEN 'updated' WHEN 'signup' THEN 'acl_only' WHEN 'error' THEN 'failed' ELSE 'kept' END AS outcome, ts, event_id FROM events)"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"view": "created", "click": "updated", "signup": "acl_only", "error": "failed", "purchase": "kept"}
    outcome = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()])
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("job"), outcome.alias("outcome"), "ts", "event_id")


@query("WITH " + JOBS + ", w AS (SELECT job, CASE WHEN job = 3 THEN 'failed' WHEN job = 4 AND event_id % 2 = 0 THEN NULL ELSE outcome END AS outcome FROM o) SELECT job, count(*) AS discovered, count(*) FILTER (outcome IN ('created','updated')) AS ingested, count(*) FILTER (outcome IN ('created','updated','acl_only')) AS synced, count(*) FILTER (outcome IN ('kept','acl_only')) AS skipped, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome IS NULL) AS waiting, CASE WHEN count(*) FILTER (outcome IS NULL) > 0 THEN 'RUNNING' WHEN count(*) FILTER (outcome = 'failed') = count(*) THEN 'FAILED' ELSE 'COMPLETED' END AS state FROM w GROUP BY 1")
def batch_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir)
    return status.job_counters(rows.withColumn("outcome", F.when(F.col("job") == 3, "failed").when((F.col("job") == 4) & (F.col("event_id") % 2 == 0), None).otherwise(F.col("outcome"))))


@query("SELECT user_id AS job, min(ts) AS started FROM events GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 100")
def job_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.last_jobs(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.min("ts").alias("started")))


@query("""WITH p AS (SELECT event_type AS source, date_trunc('hour', ts) AS began, max(ts) AS ended, max(ts) - INTERVAL 90 SECOND AS cursor, count(*) AS processed, count(*) FILTER (value < 2) AS failed, 0 AS skipped FROM events GROUP BY 1, 2)
SELECT source, count(*) AS polls, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(skipped) AS BIGINT) AS skipped, round(max(epoch_us(ended) / 1e6 - epoch_us(began) / 1e6), 3) AS longest, 90.0::DOUBLE AS lag FROM p GROUP BY 1""")
def poll_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.date_trunc("hour", "ts").alias("began")).agg(F.max("ts").alias("ended"), (F.max("ts") - F.expr("INTERVAL 90 SECONDS")).alias("cursor"), F.count("*").alias("processed"), F.count(F.when(F.col("value") < 2, 1)).alias("failed"), F.lit(0).alias("skipped"))
    return status.poll_metrics(polls).withColumn("lag", F.round("lag", 3)).withColumn("longest", F.round("longest", 3))


@query("SELECT doc_id * 2 AS node_id, doc_id * 2 < (SELECT count(*) FROM documents) AS present FROM documents")
def existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"))
    return status.exists(docs, docs.select((F.col("node_id") * 2).alias("node_id")), "node_id")


@query("SELECT source AS key, count(*) AS doc_count FROM documents WHERE contains(lower(source), 'c1') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def facets_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.facets(table(spark, sf_dir, "documents"), F.col("source"), 5, term=" C1 ")


# Pages and the folders above them as nodes; a page is out of scope if its id divides by three, folders by the length of their path
NODES = PAGES + """, seg AS (SELECT page_id, path, string_split(path, '/') AS a FROM p),
fold AS (SELECT DISTINCT unnest(list_transform(range(len(a) - 2, 0, -1), lambda n: '/' || array_to_string(a[2:n + 1], '/'))) AS path FROM seg WHERE len(a) > 2),
nodes AS (SELECT 'p' || page_id AS node_id, path, false AS is_folder, page_id % 3 <> 0 AS in_scope, false AS indexed, page_id % 11 = 0 OR page_id % 13 = 0 AS excluded, page_id % 13 = 0 AS hidden, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (page_id % 31) AS m FROM p UNION ALL SELECT 'f' || path, path, true, length(path) % 3 <> 0, length(path) % 2 = 0, length(path) % 7 = 0, false, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (length(path) % 31) FROM fold),
ev AS (SELECT event_id, ['state','acl','scope','delete','state','acl','scope'][1 + event_id % 7] AS kind, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 4 = 0 OR f.path IS NULL OR event_id % 7 = 3 THEN 'p' || (event_id % total) ELSE 'f' || f.path END AS node_id, ts AS t FROM events CROSS JOIN (SELECT count(*) AS total FROM p) LEFT JOIN (SELECT page_id, '/' || array_to_string(a[2:len(a) - 1], '/') AS path FROM seg WHERE len(a) > 2) f ON f.page_id = event_id % total),
dec AS (SELECT ev.*, n.path, n.is_folder, n.in_scope, CASE WHEN ev.node_id IS NULL THEN 'filtered' WHEN kind = 'delete' THEN 'delete'
  WHEN kind = 'state' THEN CASE WHEN n.in_scope THEN 'sync' ELSE 'delete' END
  WHEN kind = 'acl' THEN CASE WHEN n.node_id IS NULL THEN 'filtered' WHEN n.is_folder THEN CASE WHEN n.excluded THEN 'filtered' ELSE 'acl_subtree' END WHEN n.in_scope THEN 'update_acl' ELSE 'delete' END
  ELSE CASE WHEN n.node_id IS NULL OR NOT n.is_folder THEN 'filtered' WHEN NOT n.in_scope THEN 'tear_down' WHEN n.indexed THEN CASE WHEN n.excluded THEN 'filtered' ELSE 'sync_subtree' END ELSE 'filtered' END END AS decision
  FROM ev LEFT JOIN nodes n ON n.node_id = ev.node_id)
"""


def _live(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    paths = page_paths(spark, sf_dir)
    n, size = F.col("page_id"), F.length("folder")
    files = paths.select(F.concat(F.lit("p"), n.cast("string")).alias("node_id"), "path", F.lit(False).alias("is_folder"), (n % 3 != 0).alias("in_scope"), F.lit(False).alias("indexed"), ((n % 11 == 0) | (n % 13 == 0)).alias("excluded"), (n % 13 == 0).alias("hidden"), (n % 31).alias("day"))
    dirs = ingest.folders(paths).select(F.concat(F.lit("f"), F.col("folder")).alias("node_id"), F.col("folder").alias("path"), F.lit(True).alias("is_folder"), (size % 3 != 0).alias("in_scope"), (size % 2 == 0).alias("indexed"), (size % 7 == 0).alias("excluded"), F.lit(False).alias("hidden"), (size % 31).alias("day"))
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("state", "acl", "scope", "delete", "state", "acl", "scope"))), (1 + e % 7).cast("int"))
    above = paths.select(n.alias("__page"), F.regexp_replace("path", "/[^/]*$", "").alias("__folder")).where("__folder <> ''")
    total = paths.count()
    events = table(spark, sf_dir, "events").withColumn("__page", e % total).join(above, "__page", "left")
    node = F.when(e % 5 == 0, None).when((e % 4 == 0) | F.col("__folder").isNull() | (e % 7 == 3), F.concat(F.lit("p"), (e % total).cast("string"))).otherwise(F.concat(F.lit("f"), F.col("__folder")))
    return events.select("event_id", kind.alias("kind"), node.alias("node_id"), F.col("ts").cast("timestamp").alias("at")), files.unionByName(dirs).withColumn("modified_at", _day(F.col("day"))).drop("day")


def _day(n: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_704_067_200) + n * 86_400)  # from 2024-01-01 on


@query("WITH " + NODES + "SELECT kind, count(*) AS received, count(*) FILTER (decision = 'filtered' OR (decision = 'delete' AND kind <> 'delete' AND path IS NOT NULL)) AS filtered, count(*) FILTER (NOT (decision = 'filtered' OR (decision = 'delete' AND kind <> 'delete' AND path IS NOT NULL))) AS processed FROM dec GROUP BY 1")
def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, nodes = _live(spark, sf_dir)
    return E.live_counters(E.live_decisions(events, nodes))


EFFECTS = """, up AS (SELECT 'p' || page_id AS node_id, path, unnest(list_transform(range(len(a) - 2, 0, -1), lambda n: '/' || array_to_string(a[2:n + 1], '/'))) AS spot FROM seg WHERE len(a) > 2),
eff AS (SELECT node_id, event_id, t, decision AS action FROM dec WHERE decision IN ('sync', 'update_acl', 'delete')
  UNION ALL SELECT n.node_id, d.event_id, d.t, CASE WHEN decision = 'tear_down' THEN 'delete' WHEN contains(n.path, '77') THEN 'skip' WHEN decision = 'acl_subtree' THEN 'update_acl' WHEN n.excluded THEN 'skip' ELSE 'sync' END FROM dec d JOIN up ON up.spot = d.path JOIN nodes n ON n.node_id = up.node_id WHERE NOT n.hidden AND decision IN ('sync_subtree', 'acl_subtree', 'tear_down'))
"""


@query("WITH " + NODES + EFFECTS + """, ended AS (SELECT node_id, max(t) AS t, arg_max(action, epoch_us(t)::HUGEINT * 10000000 + event_id) AS la, arg_max(action, epoch_us(t)::HUGEINT * 10000000 + event_id) FILTER (action <> 'update_acl') AS wa FROM eff WHERE action <> 'skip' GROUP BY 1)
SELECT node_id, t AS "at", CASE WHEN la = 'update_acl' AND wa = 'sync' THEN 'sync' ELSE la END AS action FROM ended""")
def live_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a log of live events leaves to do to each node, subtrees expanded."""
    events, nodes = _live(spark, sf_dir)
    return E.last_actions(E.live_effects(E.live_decisions(events, nodes), nodes, ("*77*",)))


@query("WITH RECURSIVE " + NODES + EFFECTS + """, turn AS (SELECT node_id, action, t, row_number() OVER (PARTITION BY node_id ORDER BY t, event_id) AS k FROM eff WHERE action <> 'skip'),
fresh AS (SELECT node_id, is_folder, m, 'new' AS name, 'y' AS acl FROM nodes),
st AS (SELECT f.node_id, 0::BIGINT AS k, page_id IS NOT NULL AS present, CASE WHEN page_id IS NOT NULL THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (page_id * 7 % 31) END AS m, CASE WHEN page_id IS NOT NULL THEN 'old' END AS name, CASE WHEN page_id IS NOT NULL THEN 'x' END AS acl
    FROM fresh f LEFT JOIN (SELECT page_id, 'p' || page_id AS node_id FROM p WHERE page_id % 2 = 0) s ON s.node_id = f.node_id
  UNION ALL SELECT st.node_id, turn.k,
    CASE WHEN action = 'delete' THEN present AND st.m > t WHEN action = 'sync' THEN true ELSE present OR NOT f.is_folder END,
    CASE WHEN action = 'delete' THEN st.m WHEN action = 'sync' THEN CASE WHEN present AND NOT f.m > st.m THEN st.m ELSE f.m END ELSE CASE WHEN present THEN st.m ELSE f.m END END,
    CASE WHEN action = 'delete' THEN st.name WHEN action = 'sync' THEN CASE WHEN present AND NOT f.m > st.m THEN st.name ELSE f.name END ELSE CASE WHEN present THEN st.name ELSE f.name END END,
    CASE WHEN action = 'delete' THEN st.acl ELSE f.acl END
  FROM st JOIN turn ON turn.node_id = st.node_id AND turn.k = st.k + 1 JOIN fresh f ON f.node_id = st.node_id)
SELECT node_id, m AS modified_at, name, acl FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY k DESC) = 1) WHERE present""")
def live_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live events as a stream of three micro-batches, each committed to a table of documents; the SQL takes event by event."""
    events, nodes = _live(spark, sf_dir)
    base = f"{scratch_root(spark)}/lakeloom/live-{uuid.uuid4().hex}"
    source = nodes.withColumns({"name": F.lit("new"), "acl": F.lit("y")})
    number = F.regexp_extract("node_id", "^p([0-9]+)$", 1).try_cast("long")
    stored = source.where(number % 2 == 0).select("node_id", _day(number * 7 % 31).alias("modified_at"), F.lit("old").alias("name"), F.lit("x").alias("acl"))
    lake = CommittedTable.create(spark, f"{base}/table", stored.schema, "node_id", 16)
    lake.overwrite(stored)
    E.live_stream(_in_turn(events, base, order="at"), lake, lambda: source, "modified_at", ("acl",), f"{base}/checkpoint", excluded_globs=("*77*",))
    return lake.read()


# Streams, run to their end and read back

KINDS = "CASE event_type {} END"
AUDIT = "a AS (SELECT event_id AS id, ['documentCreated','documentModified','documentTrashed','documentRemoved','documentSecurityUpdated','other'][1 + event_id % 6] AS event_id, user_id AS node_id, ts AS log_date FROM events) "


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("documentCreated", "documentModified", "documentTrashed", "documentRemoved", "documentSecurityUpdated", "other")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.element_at(names, (1 + F.col("event_id") % 6).cast("int")).alias("event_id"), F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp").alias("log_date"))


@query("WITH " + AUDIT + ", m AS (SELECT min(log_date) AS lo, max(log_date) AS hi FROM a), w AS (SELECT * FROM a, m WHERE event_id <> 'other' AND (log_date > lo OR (log_date = lo AND id > 0)) AND log_date <= hi - INTERVAL 1 HOUR) SELECT id, event_id, node_id FROM w")
def audit_cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit_log(spark, sf_dir)
    lo, hi = log.agg(F.min("log_date").cast("string"), (F.max("log_date") - F.expr("INTERVAL 1 HOUR")).cast("string")).first()
    return E.audit_page(log, lo, 0, hi).select("id", "event_id", "node_id")


@query("WITH " + AUDIT + "SELECT CASE WHEN event_id IN ('documentCreated','documentModified') THEN 'upsert' WHEN event_id = 'documentSecurityUpdated' THEN 'acl' WHEN event_id = 'other' THEN 'skip' ELSE 'delete' END AS outcome, count(*) AS n FROM a GROUP BY 1")
def event_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream of files: each micro-batch is routed and appended to a table."""
    base = f"{scratch_root(spark)}/lakeloom/routing-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")

    def apply(batch: DataFrame, number: int) -> None:
        names = F.array(*map(F.lit, ("documentCreated", "documentModified", "documentTrashed", "documentRemoved", "documentSecurityUpdated", "other")))
        routed = batch.select(E.route(F.element_at(names, (1 + F.col("event_id") % 6).cast("int")), F.col("user_id").cast("string")).alias("outcome"))
        routed.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    E.run_available(stream, apply, f"{base}/checkpoint")
    return status.outcomes(spark.read.parquet(f"{base}/out").select("outcome"))


@query("""WITH RECURSIVE e AS (SELECT event_id, event_type, user_id AS node_id, ts, epoch_us(ts)::HUGEINT * 10000000 + event_id AS place FROM events),
k AS (SELECT event_type, node_id, min(place) AS place FROM e GROUP BY 1, 2
  UNION ALL SELECT k.event_type, k.node_id, min(e.place) FROM k JOIN e ON e.event_type = k.event_type AND e.node_id = k.node_id AND epoch_us(e.ts)::HUGEINT >= k.place // 10000000 + 43200000000 GROUP BY 1, 2)
SELECT CAST(place % 10000000 AS BIGINT) AS event_id, event_type, node_id FROM k""")
def event_dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp").alias("ts"))
    return E.drop_repeats(rows, timedelta(hours=12)).select("event_id", "event_type", "node_id")


DEDUP = """WITH RECURSIVE e AS (SELECT event_id, event_type, user_id AS node_id, ts, epoch_us(ts)::HUGEINT * 10000000 + event_id AS place FROM events),
k AS (SELECT event_type, node_id, min(place) AS place FROM e GROUP BY 1, 2
  UNION ALL SELECT k.event_type, k.node_id, min(e.place) FROM k JOIN e ON e.event_type = k.event_type AND e.node_id = k.node_id AND epoch_us(e.ts)::HUGEINT >= k.place // 10000000 + 43200000000 GROUP BY 1, 2)
SELECT CAST(place % 10000000 AS BIGINT) AS event_id, event_type, node_id FROM k"""


FILES = 4


def _in_turn(rows: DataFrame, base: str, parts: int = 3, order: str = "ts") -> DataFrame:
    """A table as a stream of files in the order of time, FILES in each micro-batch."""
    spark = rows.sparkSession
    ends = rows.select(F.unix_micros(order).alias("t")).approxQuantile("t", [k / parts for k in range(1, parts)], 0.001)
    place = sum((F.unix_micros(order) > int(e)).cast("int") for e in ends)
    for k in range(parts):
        rows.where(place == k).repartition(FILES).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(f"{base}/in")


def _run(stream: DataFrame, base: str) -> DataFrame:
    E.run_available(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}"), f"{base}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out/batch=*")


@query(DEDUP)
def event_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of three micro-batches, with state that expires."""
    base = f"{scratch_root(spark)}/lakeloom/dedup-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp").alias("ts"))
    return _run(E.drop_repeats_stream(_in_turn(rows, base), timedelta(hours=12)), base).select("event_id", "event_type", "node_id")


@query("""WITH g AS (SELECT event_id, user_id, ts, event_type, value, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh + CASE WHEN event_type = 'error' AND fresh = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g),
h AS (SELECT *, CAST(least(10, sum(CASE WHEN event_type NOT IN ('error', 'signup') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, n ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS INT) AS held FROM s)
SELECT event_id AS seq, user_id AS session, held FROM h""")
def memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation memory from a stream: errors reset it, sign-ups are blank turns."""
    base = f"{scratch_root(spark)}/lakeloom/memory-{uuid.uuid4().hex}"
    role = F.when(F.col("event_type") == "error", "reset").when(F.col("event_type") == "view", "user").otherwise("assistant")
    text = F.when(F.col("event_type") == "signup", " ").otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), role.alias("role"), text.alias("text"))
    return _run(E.memory_stream(_in_turn(rows, base), 10, timedelta(hours=6)), base).select("seq", "session", "held")


@query("WITH " + AUDIT + "SELECT id, event_id, node_id FROM a WHERE log_date > TIMESTAMP '2024-01-05 00:00:00'")
def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log through its own source: files by time, about a thousand entries or a row group in a page, the cursor in the checkpoint."""
    audit.register(spark)
    base = f"{scratch_root(spark)}/lakeloom/audit-{uuid.uuid4().hex}"
    log = audit_log(spark, sf_dir).withColumn("log_date", F.col("log_date").cast("timestamp_ntz"))
    log.repartitionByRange("log_date").sortWithinPartitions("log_date", "id").write.option("parquet.block.size", 1 << 20).parquet(f"{base}/in")
    start = 1_704_412_800_000_000  # 2024-01-05, in microseconds
    stream = spark.readStream.format("audit_log").option("path", f"{base}/in").option("page", 1000).option("start", start).load()
    query = stream.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")).option("checkpointLocation", f"{base}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/batch=*").select("id", "event_id", "node_id")


@query("WITH " + AUDIT + ", o AS (SELECT CASE WHEN event_id IN ('documentCreated','documentModified') THEN 'upsert' WHEN event_id = 'documentSecurityUpdated' THEN 'acl' WHEN event_id = 'other' THEN 'skip' ELSE 'delete' END AS outcome FROM a) SELECT 'received' AS counter, count(*) AS n FROM o UNION ALL SELECT outcome, count(*) FROM o GROUP BY 1")
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of the audit stream counted by itself while its rows passed, told by its progress."""
    audit.register(spark)
    base = f"{scratch_root(spark)}/lakeloom/metrics-{uuid.uuid4().hex}"
    log = audit_log(spark, sf_dir).withColumn("log_date", F.col("log_date").cast("timestamp_ntz"))
    log.repartitionByRange("log_date").sortWithinPartitions("log_date", "id").write.parquet(f"{base}/in")
    progress = metrics.Progress("audit")
    spark.streams.addListener(progress)
    try:
        routed = spark.readStream.format("audit_log").option("path", f"{base}/in").option("page", 2000).load().withColumn("outcome", E.route(F.col("event_id"), F.col("node_id").cast("string")))
        told = metrics.counted_stream(routed, "audit", F.col("outcome"), ("upsert", "acl", "delete", "skip"))
        running = told.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").start()
        try:
            running.processAllAvailable()
        finally:
            running.stop()
        progress.wait(running)
    finally:
        spark.streams.removeListener(progress)
    return spark.createDataFrame([(k, v) for k, v in progress.totals().items() if v], "counter string, n long")


@query("SELECT user_id AS node_id, bool_or(event_id % 4 = 0) AS recursive, arg_min(event_type, event_id) AS reason FROM events GROUP BY 1")
def acl_request_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), (F.col("event_id") % 4 == 0).alias("recursive"), F.col("event_type").alias("reason"), F.col("event_id").alias("seq"))
    return status.merge_acl_requests(rows)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS turns FROM s GROUP BY user_id, n""")
def session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events")).select("user_id", "begin", "end", "turns")


@query("WITH " + AUDIT + "SELECT CASE WHEN event_id IN ('documentTrashed','documentRemoved') THEN 'delete' WHEN event_id = 'other' THEN 'skip' WHEN node_id % 5 = 0 THEN 'delete' WHEN node_id % 7 = 0 THEN 'subtree' WHEN node_id % 3 = 0 THEN 'delete' WHEN event_id = 'documentSecurityUpdated' THEN 'update_acl' ELSE 'sync' END AS outcome, count(*) AS n FROM a GROUP BY 1")
def event_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = audit_log(spark, sf_dir)
    kind, n = E.route(F.col("event_id"), F.col("node_id").cast("string")), F.col("node_id")
    return status.outcomes(log.select(E.decide(kind, n % 5 != 0, n % 7 == 0, n % 3 != 0).alias("outcome")))


@query("WITH " + PAGES + """, s AS (SELECT page_id, path, string_split(path, '/') AS a FROM p),
x AS (SELECT page_id, path, unnest(list_transform(range(len(a) - 2, 0, -1), lambda n: '/' || array_to_string(a[2:n + 1], '/'))) AS spot FROM s WHERE len(a) > 2)
SELECT DISTINCT page_id, CASE WHEN page_id % 3 = 0 THEN 'delete' ELSE 'sync' END AS outcome FROM x WHERE length(spot) % 2 = 0""")
def subtree_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = page_paths(spark, sf_dir).withColumn("in_scope", F.col("page_id") % 3 != 0)
    folders = ingest.folders(nodes).where(F.length("folder") % 2 == 0).select(F.col("folder").alias("path"))
    return E.reconcile_subtree(folders, nodes).select("page_id", "outcome")
