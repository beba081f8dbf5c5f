"""Which nodes belong to the lake: ancestors that include or exclude, types, states, roots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import paths as P

# What a status write-back changes.
STATUS_PROPERTIES = ("cl:syncStatus", "cl:syncStatusValue", "cl:syncError", "cm:modified", "cm:modifier")
STATUS_ASPECTS = ("cl:syncStatus", "cl:indexed")


@dataclass(frozen=True)
class Scope:
    roots: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    excluded_states: tuple[str, ...] = ()
    excluded_globs: tuple[str, ...] = ()
    excluded_aspects: tuple[str, ...] = ()


def under(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return (path == root) | F.startswith(path, F.lit(root + "/"))


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def with_scope_marks(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """nodes (path) with in_indexed and in_excluded: whether itself or an ancestor is marked so.

    marked: path, indexed, excluded. Ancestors are exploded and joined by path, so a deep tree needs no
    recursion; a popular folder has one row on the other side of the join.
    """
    reach = nodes.select("path").distinct().select("path", F.explode(P.ancestor_paths(F.col("path"), itself=True)).alias("at"))
    found = reach.join(marked.select(F.col("path").alias("at"), "indexed", "excluded"), "at").groupBy("path").agg(F.max("indexed").alias("in_indexed"), F.max("excluded").alias("in_excluded"))
    return nodes.join(found, "path", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_indexed", "in_excluded")})


def in_scope(nodes: DataFrame, marked: DataFrame, scope: Scope, folders: bool = False) -> DataFrame:
    """The nodes that belong: (folders or files), of an included type, in no excluded state, path or aspect,
    under an indexed ancestor or a configured root, and under no excluded one."""
    rows = with_scope_marks(nodes, marked).where(F.col("is_folder") == folders)
    keep = F.col("in_indexed") | any_of(*[under(F.col("path"), r) for r in scope.roots])
    keep = keep & ~F.col("in_excluded") & ~any_of(*[P.matches_glob(F.col("path"), g) for g in scope.excluded_globs])
    if scope.types and not folders:
        keep = keep & F.col("type").isin(*scope.types)
    if scope.excluded_states and "state" in nodes.columns:
        keep = keep & ~F.coalesce(F.lower("state").isin(*[s.lower() for s in scope.excluded_states]), F.lit(False))
    if scope.excluded_aspects and "aspects" in nodes.columns:
        keep = keep & ~F.coalesce(F.arrays_overlap("aspects", F.array(*map(F.lit, scope.excluded_aspects))), F.lit(False))
    return rows.where(keep).select(*nodes.columns)


def traversable(nodes: DataFrame, scope: Scope) -> DataFrame:
    """The folders that a scan goes down into, by technical exclusions alone: an excluded aspect or path. What lies
    below decides by itself whether it is in scope; in_scope(folders=True) is the narrower answer."""
    keep = F.col("is_folder") & ~any_of(*[P.matches_glob(F.col("path"), g) for g in scope.excluded_globs])
    if scope.excluded_aspects and "aspects" in nodes.columns:
        keep = keep & ~F.coalesce(F.arrays_overlap("aspects", F.array(*map(F.lit, scope.excluded_aspects))), F.lit(False))
    return nodes.where(keep)


def only_status_changed(before: Column, after: Column) -> Column:
    """Whether an update differs in nothing but status and audit properties or status aspects: its name, type,
    content, primary association and primary hierarchy are unchanged.

    before holds what changed: a null field means unchanged; a missing before is a real change. Without
    a change of properties aspects aren't compared.
    """
    properties = F.map_filter(before["properties"], lambda k, v: ~k.isin(*STATUS_PROPERTIES) & ~v.eqNullSafe(F.element_at(after["properties"], k)))
    aspects = F.filter(F.array_union(F.array_except(before["aspects"], after["aspects"]), F.array_except(after["aspects"], before["aspects"])), lambda a: ~a.isin(*STATUS_ASPECTS))
    same = lambda f: before[f].isNull() | before[f].eqNullSafe(after[f])
    none = lambda a: F.coalesce(F.size(a), F.lit(0)) < 1
    return before.isNotNull() & same("name") & same("node_type") & same("content") & same("primary_association") & same("primary_hierarchy") & (before["properties"].isNull() | none(properties) & none(aspects))


def looks_like_permission_change(before: Column, after: Column, fields: list[str]) -> Column:
    """A folder's update without a before image, or with all of these fields alike."""
    out = F.lit(True)
    for f in fields:
        out = out & before[f].eqNullSafe(after[f])
    return after["is_folder"] & (before.isNull() | out)


def mark_changed(before: Column, after: Column, aspect: str) -> Column:
    """Whether an aspect came or went."""
    has = lambda c: F.coalesce(F.array_contains(c["aspects"], aspect), F.lit(False))
    return has(before) != has(after)
