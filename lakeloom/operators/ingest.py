"""Merges of incoming nodes into the stored documents, by DataFrame algebra.

Every merge takes the stored table and the incoming rows and returns the new table; the last functions commit
merges to a table of sources.committed, so that readers see all of one or nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.functions.text import is_blank
from lakeloom.sources.committed import CommittedTable, Version, additions, grown, shaped


def stale(incoming: Column, stored: Column) -> Column:
    """Both known and the incoming not newer: ties are stale."""
    return F.coalesce(incoming.isNotNull() & stored.isNotNull() & ~(incoming > stored), F.lit(False))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def _turns(incoming: DataFrame, key: str, modified: str, turn: str | None) -> DataFrame:
    """Incoming rows with `__turn`, their place among those of a key: by `turn`, else by time."""
    if turn is not None:
        return incoming.withColumn("__turn", F.struct(F.col(turn)))
    return incoming.withColumn("__turn", F.struct(F.col(modified), F.xxhash64(*[c for c, t in incoming.dtypes if not t.startswith("map")])))


def fold_incoming(incoming: DataFrame, key: str, modified: str, acl: tuple[str, ...], turn: str | None = None) -> DataFrame:
    """One row a key that does to any stored row what syncing the rows in turn does.

    The first of the newest rows gives the content, as later ones of its time are stale; but a row without a time
    replaces whatever is there and is replaced by whatever follows. The last row in turn, stale or not, gives the access
    columns. All are maxima, so hot keys are folded before they are shuffled.
    """
    rows = _turns(incoming, key, modified, turn)
    cols = incoming.columns
    whole = F.struct(*cols)
    # rows after the last one without a time; of those the first of the newest
    timeless = rows.where(F.col(modified).isNull()).groupBy(key).agg(F.max("__turn").alias("__null_turn"), F.max_by(whole, "__turn").alias("__null_row")).withColumnRenamed(key, "__key")
    joined = rows.join(timeless, rows[key].eqNullSafe(F.col("__key")), "left")
    after = F.col("__null_turn").isNull() | (F.col("__turn") > F.col("__null_turn"))
    newest = joined.where(after & F.col(modified).isNotNull()).groupBy(key, modified).agg(F.min_by(whole, "__turn").alias("__row")).groupBy(key).agg(F.max_by("__row", modified).alias("__row"))
    ends = joined.groupBy(key).agg(F.max_by(F.struct(*acl), "__turn").alias("__acl"), F.first("__null_row", ignorenulls=True).alias("__null_row"))
    folded = ends.join(newest.withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k")), "left").withColumn("__row", F.coalesce("__row", "__null_row"))
    return folded.select(*[(F.col(f"__acl.{c}") if c in acl else F.col(f"__row.{c}")).alias(c) for c in cols], F.col("__null_row").isNotNull().alias("__timeless"))


def sync(stored: DataFrame, incoming: DataFrame, key: str, modified: str, acl: tuple[str, ...], turn: str | None = None) -> DataFrame:
    """Upsert: newer rows replace, stale ones only refresh the access columns, new ones are added. One join by key.

    Incoming rows of one key are synced in turn: by the column `turn`, else by their time. Columns are those of stored;
    outcome says created, updated, acl_only or kept.
    """
    folded = fold_incoming(incoming.select(*stored.columns, *([turn] if turn and turn not in stored.columns else [])), key, modified, acl, turn)
    left, right = stored.select(*[F.col(c).alias(f"s_{c}") for c in stored.columns]), folded.select(*[F.col(c).alias(f"i_{c}") for c in stored.columns], "__timeless")
    joined = left.join(right, F.col(f"s_{key}") == F.col(f"i_{key}"), "full_outer")
    # what follows a row without a time is newer than it, whatever is stored
    old = stale(F.col(f"i_{modified}"), F.col(f"s_{modified}")) & ~F.col("__timeless")
    outcome = F.when(F.col(f"i_{key}").isNull(), "kept").when(F.col(f"s_{key}").isNull(), "created").when(old, "acl_only").otherwise("updated")
    rows = joined.withColumn("outcome", outcome)
    pick = lambda c: F.when(F.col("outcome") == "kept", F.col(f"s_{c}")).when((F.col("outcome") == "acl_only") & F.lit(c not in acl), F.col(f"s_{c}")).otherwise(F.col(f"i_{c}"))
    return rows.select(*[pick(c).alias(c) for c in stored.columns], "outcome")


def delete(stored: DataFrame, deletions: DataFrame, key: str, modified: str) -> DataFrame:
    """Without the rows deleted; a row stored strictly after its deletion stays. deletions: key, deleted_at."""
    gone = deletions.groupBy(key).agg(F.max("deleted_at").alias("deleted_at")).withColumnRenamed(key, "__key")
    hit = (stored[key] == gone["__key"]) & ~F.coalesce(stored[modified] > gone["deleted_at"], F.lit(False))
    return stored.join(gone, hit, "left_anti")


def update_acl(stored: DataFrame, incoming: DataFrame, key: str, acl: tuple[str, ...], turn: str | None = None) -> DataFrame:
    """New access columns for rows that are there; missing files are created with metadata alone, missing folders are not.

    Of several incoming rows of a key the last one in the order of `turn` (else of its values) gives the access
    columns, and the first file a missing row's others: what comes in turn finds it there.
    """
    cols = stored.columns
    place = F.struct(F.col(turn)) if turn else F.struct(F.xxhash64(*[c for c, t in incoming.dtypes if not t.startswith("map")]))
    row = F.struct(*[c for c in incoming.columns])
    first = F.min_by(F.when(~F.col("is_folder"), row), F.when(~F.col("is_folder"), place))
    one = incoming.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*acl), place).alias("__acl"), first.alias("__first"), F.max_by(row, place).alias("__last"))
    kept = F.coalesce("__first", "__last")
    incoming = one.select(*[(F.col(f"__acl.{c}") if c in acl else kept[c]).alias(c) for c in incoming.columns])
    left, right = stored.select(*[F.col(c).alias(f"s_{c}") for c in cols]), incoming.select(*[F.col(c).alias(f"i_{c}") if c in incoming.columns else F.lit(None).cast(stored.schema[c].dataType).alias(f"i_{c}") for c in cols], "is_folder")
    joined = left.join(right, F.col(f"s_{key}") == F.col(f"i_{key}"), "full_outer").where(F.col(f"s_{key}").isNotNull() | ~F.col("is_folder"))
    there, new = F.col(f"s_{key}").isNotNull(), F.col(f"i_{key}").isNotNull()
    return joined.select(*[F.when(there & (~new | F.lit(c not in acl)), F.col(f"s_{c}")).otherwise(F.col(f"i_{c}")).alias(c) for c in cols])


def prefer_exact(candidates: DataFrame, key: str, wanted: str, found: str) -> DataFrame:
    """One row a key: that of the exact namespaced source before a legacy one."""
    return latest(candidates, key, [F.desc(F.col(found) == F.col(wanted)), F.asc(found)])


def replace_children(stored: DataFrame, fresh: DataFrame, owner: str, owners: DataFrame | None = None) -> DataFrame:
    """All children of the owners go, whatever their type; fresh ones come. Owners are those of the fresh rows
    unless they are named, as one that is left without children must be."""
    named = fresh.select(owner) if owners is None else owners.select(owner)
    return delete_children(stored, named.distinct(), owner).unionByName(fresh.join(named.distinct(), owner, "left_semi").select(*stored.columns))


def delete_children(stored: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """Without all children of the owners."""
    return stored.join(owners.select(owner), owner, "left_anti").select(*stored.columns)


def merge_duplicates(found: DataFrame, wanted: DataFrame, key: str, source: str) -> DataFrame:
    """One row for each wanted key that is there, of several the one of its exact source, else the first: a bulk lookup."""
    rows = found.join(wanted.select(key, F.col(source).alias("__wanted")).dropDuplicates([key]), key)
    return latest(rows, key, [F.desc(F.coalesce(F.col(source) == F.col("__wanted"), F.lit(False))), F.asc(source)]).drop("__wanted")


def resolve_paths(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows with the id of the document that has their path already, and one row a path (the last)."""
    one = latest(incoming, "path", [F.desc("modified_at"), F.desc("node_id")])
    return one.join(stored.select("path", F.col("node_id").alias("__known")), "path", "left").withColumn("document_id", F.coalesce("__known", "node_id")).drop("__known")


def process(text: Column, chunks: Column, mime_type: Column, failure: Column | None = None) -> Column:
    """Outcome of the content phase: status and error. failure: what an extractor, chunker or model that broke down said, else null."""
    blank = is_blank(text)
    none = F.coalesce(F.size(chunks), F.lit(0)) < 1
    broken = F.lit(None).cast("string") if failure is None else failure
    error = F.coalesce(broken, F.when(blank, F.concat(F.lit("No extractable text produced for mimeType="), F.coalesce(mime_type, F.lit("null")))).when(none, F.lit("No chunks produced from extracted text")))
    return F.struct(F.when(error.isNotNull(), "FAILED").otherwise("INDEXED").alias("status"), error.alias("error"))


def with_status(properties: Column, status: Column, error: Column) -> Column:
    """A property map with state and error; a blank error goes."""
    rest = F.map_filter(properties, lambda k, v: ~k.isin("syncStatus", "syncError"))
    new = F.map_filter(F.create_map(F.lit("syncStatus"), status, F.lit("syncError"), F.when(~is_blank(error), error)), lambda k, v: v.isNotNull())
    return F.map_concat(rest, new)


def described(properties: Column) -> Column:
    """A node's properties without null values, and the list of their names, which always mirrors the keys."""
    kept = without_nulls(properties)
    return F.struct(kept.alias("properties"), F.array_sort(F.map_keys(kept)).alias("names"))


def ordered_union(first: Column, *others: Column) -> Column:
    """What each array holds, once, in order of first appearance: mixins, authorities, ids."""
    empty = F.array().cast("array<string>")
    return F.filter(F.array_distinct(F.concat(F.coalesce(first, empty), *[F.coalesce(o, empty) for o in others])), lambda x: x.isNotNull())


def write_status(states: DataFrame, changes: DataFrame) -> DataFrame:
    """The states of source nodes (node_id, status, error) after changes of them (and seq): the last one of a node
    counts; a null status clears it."""
    last = latest(changes, "node_id", [F.desc("seq")])
    kept = states.join(last.select("node_id"), "node_id", "left_anti")
    return kept.select("node_id", "status", "error").unionByName(last.where("status is not null").select("node_id", "status", F.when(~is_blank(F.col("error")), F.col("error")).alias("error")))


def patch(properties: Column, changes: Column) -> Column:
    """A property map after changes (array of op, key, value): add and replace set a key, remove takes it away; the last of a key counts."""
    last = F.aggregate(changes, F.create_map().cast("map<string,struct<op:string,key:string,value:string>>"), lambda m, c: F.map_concat(F.map_filter(m, lambda k, v: k != c["key"]), F.create_map(c["key"], c)))
    kept = F.map_filter(properties, lambda k, v: ~F.array_contains(F.map_keys(last), k))
    return F.map_concat(kept, F.transform_values(F.map_filter(last, lambda k, v: v["op"] != "remove"), lambda k, v: v["value"]))


def without_nulls(properties: Column) -> Column:
    return F.map_filter(properties, lambda k, v: v.isNotNull())


def folders(paths: DataFrame) -> DataFrame:
    """Every folder that the paths need, once."""
    from lakeloom.functions.paths import ancestor_paths

    return paths.select(F.explode(ancestor_paths(F.col("path"))).alias("folder")).distinct()


def conform(frame: DataFrame, schema: StructType) -> DataFrame:
    """A frame in the form of a schema: what it lacks, at any depth, is added as nulls, in the schema's order; what it has
    beyond the schema stays behind its columns. Schemas only grow: another type is refused."""
    additions(schema, frame.schema)
    have = {f.name: f.dataType for f in frame.schema}
    columns = [(shaped(F.col(f"`{f.name}`"), have[f.name], grown(f.dataType, have[f.name])) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    return frame.select(*columns, *[F.col(f"`{c}`") for c in frame.columns if c not in schema.fieldNames()])


def commit_sync(table: CommittedTable, incoming: DataFrame, modified: str, acl: tuple[str, ...], turn: str | None = None, batch: tuple[str, int] | None = None) -> Version:
    """sync, committed; only the buckets of the incoming keys are read and written."""
    key = table.version().key
    return table.change(incoming, lambda stored: sync(stored, incoming, key, modified, acl, turn).drop("outcome"), "sync", batch)


def commit_delete(table: CommittedTable, deletions: DataFrame, modified: str, batch: tuple[str, int] | None = None) -> Version:
    key = table.version().key
    return table.change(deletions, lambda stored: delete(stored, deletions, key, modified), "delete", batch)


def commit_acl(table: CommittedTable, incoming: DataFrame, acl: tuple[str, ...], turn: str | None = None, batch: tuple[str, int] | None = None) -> Version:
    key = table.version().key
    return table.change(incoming, lambda stored: update_acl(stored, incoming, key, acl, turn), "update_acl", batch)


def commit_children(table: CommittedTable, fresh: DataFrame, owners: DataFrame | None = None, batch: tuple[str, int] | None = None) -> Version:
    """replace_children, committed, for a table whose key is the owner."""
    key = table.version().key
    named = fresh if owners is None else owners
    return table.change(named.select(key), lambda stored: replace_children(stored, fresh, key, named), "replace_children", batch)
