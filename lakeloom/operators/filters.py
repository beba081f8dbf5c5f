"""Filters of a search, built as columns and pushed to the scan where they can be."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.paths import without_type
from lakeloom.operators.search import all_of

KEY = re.compile(r"[A-Za-z0-9_:-]+")


@dataclass
class MetadataFilter:
    mime_type: str | None = None
    path_prefix: str | None = None
    modified_after: str | None = None
    modified_before: str | None = None
    properties: dict[str, str] = field(default_factory=dict)


def metadata(filter_: MetadataFilter, vocabulary: dict[str, str] | None = None) -> Column:
    """Equal type, path prefix, a closed range of times (ISO strings) and equal properties; bad keys are passed over."""
    known = vocabulary or {}
    return all_of(
        F.col("mime_type") == filter_.mime_type if filter_.mime_type else None,
        F.startswith(F.col("path"), F.lit(filter_.path_prefix)) if filter_.path_prefix else None,
        F.col("modified_at") >= filter_.modified_after if filter_.modified_after else None,
        F.col("modified_at") <= filter_.modified_before if filter_.modified_before else None,
        *[F.col("properties")[k] == known.get(v, v) for k, v in filter_.properties.items() if KEY.fullmatch(k)],
    )


def source_type(wanted: str | None) -> Column | None:
    return F.col("source_type") == wanted.strip().lower() if wanted and wanted.strip() else None


class NamedQueries:
    """Stored conditions by name; an unknown or blank name adds none."""

    def __init__(self, conditions: dict[str, Callable[[], Column]]):
        self.conditions = conditions

    def get(self, name: str | None) -> Column | None:
        make = self.conditions.get((name or "").strip())
        return make() if make else None


def resolve_labels(rows: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """A column with labels replaced by their keys (label, key, no); the first key of a label wins, others pass."""
    first = vocabulary.withColumn("__n", F.row_number().over(Window.partitionBy("label").orderBy("no"))).where("__n = 1").select(F.col("label").alias("__label"), F.col("key").alias("__key"))
    joined = rows.join(first, F.col(column) == F.col("__label"), "left")
    return joined.withColumn(column, F.coalesce("__key", column)).drop("__label", "__key")


def is_uuid(value: Column) -> Column:
    return (F.length(value) >= 32) & value.rlike(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def source_ids(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """The distinct sources, of one type or all."""
    return rows.where(all_of(source_type(kind))).select("source_id").distinct()


def resolve_sources(named: list[str], of_type: list[str], pinned: list[str], discovered: list[str], kind: str | None = None) -> list[str]:
    """The first of these that isn't empty: named in the filter, of the type, configured, discovered. Without blanks,
    repeats and the type's prefix."""
    clean = lambda names: list(dict.fromkeys(without_type(n.strip(), kind) for n in names if n and n.strip()))
    return next((x for x in map(clean, (named, of_type, pinned, discovered)) if x), [])
