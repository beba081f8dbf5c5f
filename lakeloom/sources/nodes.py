"""Scans of repositories, held as tables of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.paths import ancestor_paths, parent_path
from lakeloom.functions.text import is_blank
from lakeloom.operators.scope import any_of, under
from lakeloom.operators.search import all_of
from lakeloom.session import Scratch

# Types that hold text as it is.
TEXT_TYPES = ("application/json", "application/xml", "application/javascript")


SKIPPED = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def node_at(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path") == path)


def children(nodes: DataFrame, parent_id: str, skip: int = 0, most: int | None = None) -> DataFrame:
    """A folder's children by name; a page of them if a limit is given."""
    rows = nodes.where(F.col("parent_id") == parent_id)
    return rows if most is None else rows.orderBy("name", "node_id").offset(skip).limit(most)


def descendants(nodes: DataFrame, folder: str, excluded_aspects: tuple[str, ...] = (), recursive: bool = True, excluded: DataFrame | None = None) -> DataFrame:
    """Files below a folder, or right in it, without those that carry an excluded aspect.

    excluded: paths of folders marked as excluded, checked against each file's ancestors whatever the scan said.
    """
    rows = nodes.where(~F.col("is_folder") & F.startswith(F.col("path"), F.lit(folder.rstrip("/") + "/")))
    if not recursive:
        rows = rows.where(parent_path(F.col("path")) == folder.rstrip("/"))
    if excluded_aspects:
        rows = rows.where(~F.coalesce(F.arrays_overlap("aspects", F.array(*map(F.lit, excluded_aspects))), F.lit(False)))
    if excluded is not None:
        hit = rows.select("path", F.explode(ancestor_paths(F.col("path"))).alias("at")).join(excluded.select(F.col("path").alias("at")), "at", "left_semi")
        rows = rows.join(hit.select("path").distinct(), "path", "left_anti").select(*nodes.columns)
    return rows


def discover(nodes: DataFrame, roots: tuple[str, ...] = (), types: tuple[str, ...] = (), excluded_states: tuple[str, ...] = (), condition: Column | None = None) -> DataFrame:
    """Nodes under any root, of a type, in no excluded state, neither proxy nor version: one scan with one predicate."""
    return nodes.where(
        all_of(
            any_of(*[under(F.col("path"), r) for r in roots]) if roots else None,
            F.col("type").isin(*types) if types else None,
            ~F.coalesce(F.col("state").isin(*excluded_states), F.lit(False)) if excluded_states else None,
            F.col("is_proxy") == F.lit(False) if "is_proxy" in nodes.columns else None,
            F.col("is_version") == F.lit(False) if "is_version" in nodes.columns else None,
            condition,
        )
    )


def tree(nodes: DataFrame, root_id: str, depth: int | None = None) -> DataFrame:
    """All nodes below one where only parents are known, in as many rounds as the logarithm of the levels.

    Every node points to its parent and knows how far that is; each round lets it point to where that node points, so
    distances double. A node whose pointer has met the root is below it; one whose pointer runs out isn't. What is still
    open after rounds for a chain of all nodes runs in a cycle without the root. depth: as many levels at most.
    Of a round a row a node travels, and one number comes to the driver.
    """
    scratch = Scratch(nodes.sparkSession, "tree")
    at_root = F.col("parent_id") == root_id
    start = nodes.where(F.col("node_id") != root_id).select("node_id", F.when(~at_root, F.col("parent_id")).alias("at"), F.lit(1).cast("long").alias("steps"), F.when(at_root, F.lit(1).cast("long")).alias("level"))
    state = scratch.save("state", start)
    n, left = state.agg(F.count("*"), F.count("at")).first()
    for _ in range(max(1, n).bit_length() + 1):
        if not left:
            break
        aim = state.select(F.col("node_id").alias("at"), F.col("at").alias("__at"), F.col("steps").alias("__steps"), F.col("level").alias("__level"))
        open_ = state.where(F.col("at").isNotNull()).join(aim, "at", "left")
        moved = open_.select("node_id", F.col("__at").alias("at"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), (F.col("steps") + F.col("__level")).alias("level"))
        state = scratch.save("state", state.where(F.col("at").isNull()).unionByName(moved))
        left = state.agg(F.count("at")).first()[0]
    below = state.where(F.col("at").isNull() & F.col("level").isNotNull())
    return nodes.join((below if depth is None else below.where(F.col("level") <= depth)).select("node_id"), "node_id", "left_semi")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """Files as path, modificationTime, length and content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def text_of(content: Column, mime_type: Column, convert: Column | None = None) -> Column:
    """Text by type: decoded where it is text, markup stripped where it is HTML, else what a converter makes of it, or null."""
    kind = F.lower(mime_type)
    decoded = F.decode(content, "UTF-8")
    return F.when(kind == "text/html", html_text(decoded)).when(F.startswith(kind, F.lit("text/")) | kind.rlike(r"\+(?:xml|json)$") | kind.isin(*TEXT_TYPES), decoded).otherwise(convert if convert is not None else F.lit(None).cast("string"))


def html_text(html: Column) -> Column:
    """Without scripts, styles and tags; common entities decoded; one blank between words."""
    out = F.regexp_replace(html, SKIPPED, " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, sign in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def read_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Access-change messages (value: JSON) that are complete, and the others, for a dead-letter table."""
    schema = "eventType string, sourceType string, nodeId string, recursive boolean, reason string, occurredAt string"
    parsed = raw.withColumn("m", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    good = ~is_blank(F.col("m.eventType")) & ~is_blank(F.col("m.sourceType")) & ~is_blank(F.col("m.nodeId"))
    return parsed.where(good).select("m.*"), parsed.where(~good).select("value")
