"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_map, batch, raw
from lakeloom.llm.components import components
from lakeloom.session import Scratch

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Colliding fingerprints are compared with each other in groups up to this size; see link_fingerprints.
PAIRED_UPTO = 256

_ONE = np.uint64(1)


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of a text's 4-word shingles, repeats included.

    A-Z are lower-cased (bytes.lower() does just that); words are runs without ASCII white space
    (bytes.split() does just that). Fewer words than four make one shingle; none give zero.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-SHINGLE_WORDS] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), dtype=np.uint64, count=b.num_rows)
            yield batch(doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), fp=pa.array(fp.view(np.int64)))

    return arrow_map(raw(docs), run, "doc_id long, text_hash long, fp long")


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of all changes of at most `radius` of the low `bits` bits."""
    return np.array([sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)], dtype=np.uint64)


def _half_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two fingerprints within 4 bits are within 2 bits in one 32-bit half: each half emits its ball of radius 1."""
    masks = ball(32, RADIUS // 4)
    low = np.uint64(0xFFFFFFFF)
    for b in batches:
        whole = b.column("fp").to_numpy().view(np.uint64)
        for k in range(0, len(whole), 20_000):
            fp = whole[k : k + 20_000]
            for half, part in enumerate((fp & low, fp >> np.uint64(32))):
                variant = (part[:, None] ^ masks[None, :]).astype(np.int64)
                key = variant.ravel() * 2 + half
                yield batch(key=pa.array(key), fp=pa.array(np.repeat(fp.view(np.int64), len(masks))))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From rows sorted by key: (values, run starts, run lengths) of complete runs of two rows or more.

    A run longer than PAIRED_UPTO + 1 is cut into stretches of that length at most, each led by the run's first
    value, so memory is bounded by a batch.
    """
    held_k = held_v = np.zeros(0, dtype=np.int64)
    for b in batches:
        k, v = np.concatenate([held_k, b.column(key).to_numpy()]), np.concatenate([held_v, b.column("fp").to_numpy()])
        if not len(k):
            continue
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        last = int(starts[-1])
        yield v[:last], starts[:-1], np.diff(starts)
        held_k, held_v = k[last:], v[last:]
        if len(held_v) > PAIRED_UPTO + 1:
            # a long run: hand it out whole so far, and keep its first value to go on with
            yield held_v, np.array([0]), np.array([len(held_v)])
            held_k = np.full(PAIRED_UPTO + 1, held_k[0])
            held_v = np.full(PAIRED_UPTO + 1, held_v[0])
    if len(held_v):
        yield held_v, np.array([0]), np.array([len(held_v)])


def _spanning(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fewer links than fingerprints that connect all of them that are linked, by a search from each in turn."""
    rest = fp
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= RADIUS
            if near.any():
                yield np.full(near.sum(), at), rest[near]
                frontier.extend(rest[near])
                rest = rest[~near]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect colliding fingerprints; those of larger groups are handed on as (fp, fp)."""
    for values, starts, lengths in _runs(batches, "key"):
        out: list[tuple[np.ndarray, np.ndarray]] = []
        pairs = starts[lengths == 2]
        a, b = values[pairs], values[pairs + 1]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS
        out.append((a[near], b[near]))
        for s, n in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
            if n <= PAIRED_UPTO:
                out.extend(_spanning(values[s : s + n]))
            else:
                out.append((values[s : s + n], values[s : s + n]))
        links = np.unique(np.stack([np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])], axis=1), axis=0)
        if len(links):
            yield batch(a=pa.array(np.ascontiguousarray(links[:, 0])), b=pa.array(np.ascontiguousarray(links[:, 1])))


def _full_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All variants within half the radius of the whole fingerprint: any that share one are within the radius."""
    masks = ball(64, RADIUS // 2)
    for b in batches:
        fp = b.column("fp").to_numpy()
        for k in range(0, len(fp), 500):
            part = fp[k : k + 500]
            variant = (part.view(np.uint64)[:, None] ^ masks[None, :]).view(np.int64).ravel()
            yield batch(key=pa.array(variant), fp=pa.array(np.repeat(part, len(masks))))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A link from each fingerprint of a run to the run's first."""
    for values, starts, lengths in _runs(batches, "key"):
        first = np.repeat(values[starts], lengths)
        differ = first != values[: len(first)]
        if not differ.any():
            continue
        pairs = np.unique(np.stack([first[differ], values[: len(first)][differ]], axis=1), axis=0)
        yield batch(a=pa.array(np.ascontiguousarray(pairs[:, 0])), b=pa.array(np.ascontiguousarray(pairs[:, 1])))


def link_fingerprints(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect all fingerprints (fp: long, distinct) within 4 bits of each other.

    Emitting a ball of radius 2 of 64 bits takes 2,081 rows a fingerprint, more than the documents
    themselves. So the balls are laid around halves: within 4 bits, one 32-bit half differs in 2 bits
    at most, and balls of radius 1 around it (33 variants) meet in the middle: 66 rows. Fingerprints
    that share a variant are verified, and linked by a spanning tree rather than in all pairs. Where
    more than PAIRED_UPTO share one, even verifying pairs would be too much: those fingerprints emit the whole balls of radius 2, where sharing a variant proves the
    distance, and a link to the variant's first fingerprint connects them. Both ways are exact.
    """
    near = arrow_map(distinct, _half_variants, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = scratch.save("found", arrow_map(near, _verify, "a long, b long").distinct())
    crowded = found.where("a = b").select(F.col("a").alias("fp"))
    wide = arrow_map(crowded, _full_variants, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    return found.where("a <> b").unionByName(arrow_map(wide, _stars, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fingerprint, component_id and root (a number of the component) of every document.

    Equal texts, and all texts of equal fingerprint, are one node from the start, so groups of copies
    cost nothing further on. component_id is the smallest doc_id reachable by links of at most 4
    differing bits. Joins have one row for each fingerprint on one side, so a hot one can be split.

    Cases: null, empty and blank texts have fingerprint zero and are linked like any other; a null
    doc_id is never a component_id unless a component has no other (then null); repeated rows get
    the same values; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save("prints", fingerprints(docs))
    nodes = scratch.save("nodes", prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(link_fingerprints(nodes.select("fp"), scratch), scratch)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, the one of the smallest doc_id (then text hash); all columns.

    Cases: null, empty and blank texts are near-duplicates of each other, so one of them stays; null ids
    come last; of repeated rows the one whose other columns come first as JSON stays; no rows give no rows;
    other columns are kept, whatever their names.
    """
    found = Scratch(docs.sparkSession, "keep-one").save("found", near_duplicates(docs).select("doc_id", "text_hash", "root"))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"))
    text = F.coalesce(docs["text"], F.lit(""))
    same = docs["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (F.xxhash64(text) == kept["__hash"])
    out = docs.join(kept, same, "left_semi")
    # repeated rows have one key: only where there are any need the rows be compared again
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return out
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = out.groupBy(F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__hash")).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return one.select("__row.*")
