"""Paths, source ids and links: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.text import is_blank, java_trim


def normal_path(path: Column) -> Column:
    """One leading slash, none doubled or at the end."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(path), r"/{2,}", "/"), r"^/|/$", "")
    return F.concat(F.lit("/"), bare)


def parent_path(path: Column) -> Column:
    return F.regexp_replace(normal_path(path), r"/[^/]*$", "")


def join_path(*parts: Column) -> Column:
    return normal_path(F.concat_ws("/", *parts))


def ancestor_paths(path: Column, itself: bool = False) -> Column:
    """Deepest first; none for the root and blank paths."""
    parts = F.split(normal_path(path), "/", -1)
    depth = F.size(parts) - (1 if itself else 2)
    some = F.transform(F.sequence(depth, F.lit(1), F.lit(-1)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 2, n), "/")))
    return F.when((depth >= 1) & (normal_path(path) != "/") & path.isNotNull(), some).otherwise(F.array().cast("array<string>"))


def source_id(kind: Column, name: Column) -> Column:
    """type:id, unless blank or prefixed already."""
    return F.when(is_blank(name) | F.contains(name, F.lit(":")), name).otherwise(F.concat_ws(":", kind, name))


def without_type(name: str, kind: str | None) -> str:
    """A source id as it was named, without its type's prefix."""
    return name[len(kind) + 1 :] if kind and name.startswith(kind + ":") else name


def source_id_variants(full: Column) -> Column:
    """The id, and what follows its first colon."""
    return F.array_distinct(F.array(full, F.regexp_replace(full, r"^[^:]*:", "")))


def matches_glob(path: Column, pattern: str) -> Column:
    """Whole-path match where * stands for anything; other signs keep their meaning in a pattern."""
    return path.rlike("^(?:" + pattern.replace("*", ".*") + ")$")


def _encoded(value: Column, kept: str) -> Column:
    """Percent signs for the UTF-8 bytes of every sign but letters, digits and those of a class."""
    signs = F.filter(F.split(value, ""), lambda c: c != "")
    escaped = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    return F.array_join(F.transform(signs, lambda c: F.when(c.rlike(f"^[A-Za-z0-9{kept}]$"), c).otherwise(escaped(c))), "")


def _or_null(value: Column) -> Column:
    trimmed = java_trim(value)
    return F.when(trimmed != "", trimmed)


#: What may stand in a segment of a path as it is: unreserved signs, sub-delimiters, colon and at sign.
SEGMENT_SIGNS = r"\-._~!$&'()*+,;=:@"


def encode_segment(name: Column) -> Column:
    """A name as one segment of a link's path; null where it is blank."""
    return _encoded(_or_null(name), SEGMENT_SIGNS)


def encode_path(path: Column) -> Column:
    """A path for a link: its slashes stay; null where it is blank."""
    return _encoded(_or_null(path), SEGMENT_SIGNS + "/")


def joined_path(path: Column, name: Column) -> Column:
    """A document's path from its folder's and its name; null where either is blank."""
    folder, own = _or_null(path), _or_null(name)
    return F.when(F.endswith(folder, F.lit("/")), F.concat(folder, own)).otherwise(F.concat(folder, F.lit("/"), own))


def own_id(full: Column) -> Column:
    """What follows the first colon of a source id, if anything does; null where it is blank."""
    bare = F.regexp_extract(_or_null(full), r"(?s)^[^:]*:(.+)$", 1)
    return F.when(bare != "", bare).otherwise(_or_null(full))


def link_values(node_id: Column, source: Column, path: Column, name: Column, stored_path: Column | None = None) -> dict[str, Column]:
    """The values of a link's placeholders: ids as they are, paths and names encoded.

    documentPath is the path that the repository stored, else the folder's with the name.
    """
    whole = joined_path(path, name) if stored_path is None else F.coalesce(_or_null(stored_path), joined_path(path, name))
    return {"nodeId": node_id, "sourceId": own_id(source), "fullSourceId": source, "sourcePath": encode_path(path), "sourceName": encode_segment(name), "documentPath": encode_path(whole)}


def open_link(template: Column, values: dict[str, Column], required: tuple[str, ...] = ()) -> Column:
    """A template with its {name} placeholders filled, in the order of `values`.

    Null where a value that the template names, or a required one, is blank, where a placeholder is unknown, and where
    the template is blank. Values go in as they are: see encode_path and encode_segment.
    """
    out = _or_null(template)
    for name, value in values.items():
        slot = F.lit("{" + name + "}")
        out = F.when(F.contains(out, slot), F.replace(out, slot, _or_null(value))).otherwise(out)
    there = F.lit(True)
    for name in required:
        there = there & _or_null(values[name]).isNotNull()
    return F.when(~F.contains(out, F.lit("{")) & there, out)
