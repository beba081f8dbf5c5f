"""Removal of long repeated strings, by enhanced suffix arrays over content-chosen anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import among, arrow_map, batch, hot_keys, raw, skewed_join, with_maybe
from lakeloom.session import Scratch

#: Bytes of a repeated string that goes, of one that is reported, and of an anchor in it.
LENGTH, SHORT, ANCHOR = 400, 256, 48
#: A passage is a reported run of more words than this.
WORDS = 50
#: Distinct surroundings in one tree; larger groups are split by further bytes, into ranges of so many windows.
GROUP, RANGE = 1_000, 14
#: Surroundings that a task remembers having sent.
REMEMBERED = 200_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the rolling hash's base and its inverse modulo 2^64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, b, dtype=np.uint64)])) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


def anchors(text: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of a text's anchors.

    A window is a string of SHORT bytes; its anchor is the leftmost of the ANCHOR-byte strings in it
    with the least hash. So equal windows have equal anchors at equal places in them, wherever they
    are, and each window has one anchor. Consecutive windows share theirs. A string of LENGTH bytes
    belongs to the anchor of the window that it begins with.
    """
    n = len(text)
    if n < SHORT:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    up, down = powers.upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[ANCHOR:] - sums[:-ANCHOR]) * up[: n - ANCHOR + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    # least of each stretch of `reach` hashes, by doubling; the left one wins ties
    width = SHORT - ANCHOR + 1
    value, at, reach = h, np.arange(len(h), dtype=np.int64), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = value[:-step], value[step:]
        later = right < left
        value, at = np.where(later, right, left), np.where(later, at[step:], at[:-step])
        reach += step
    firsts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    lasts = np.concatenate([firsts[1:] - 1, [len(at) - 1]])
    places = at[firsts]
    return places, h[places].view(np.int64), firsts, lasts


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


Run = tuple[int, int]


def merged(runs: list[Run]) -> list[Run]:
    out: list[Run] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def shared_strings(lefts: list[bytes], rights: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """What each of the distinct surroundings of one anchor shares with another one: pairs (l, r) of bytes before and after.

    lefts and rights: the bytes before the anchor, and from it on, as far as its windows go. The
    rights, sorted, are a suffix array of the anchor's occurrences; a stack scan over the common
    prefixes of neighbours gives its interval tree. All occurrences in an interval of depth r go on
    alike for r bytes. What they share to the left is found where the sorted lefts of the interval
    differ: the group is split by its left extensions, and each occurrence keeps the longest it shares
    with another one. Pairs of less than `least` bytes in all are left out. Every occurrence of an
    interval is served, not just neighbours in the array.
    """
    m = len(rights)
    order = sorted(range(m), key=lambda i: rights[i])
    mirrored = [x[::-1] for x in lefts]
    rank = {i: k for k, i in enumerate(sorted(range(m), key=lambda i: mirrored[i]))}
    reach = max(map(len, lefts))
    pairs: list[list[tuple[int, int]]] = [[] for _ in range(m)]

    def close(depth: int, members: list[int]) -> None:
        if depth + reach < least:
            return
        members.sort(key=rank.__getitem__)
        for a, b in zip(members, members[1:]):
            shared = common(mirrored[a], mirrored[b])
            if shared + depth >= least:
                pairs[a].append((shared, depth))
                pairs[b].append((shared, depth))

    stack: list[tuple[int, list[int]]] = []
    group = [order[0]]
    for previous, this in zip(order, order[1:]):
        depth = common(rights[previous], rights[this])
        while stack and stack[-1][0] > depth:
            top, members = stack.pop()
            members.extend(group)
            close(top, members)
            group = members
        if stack and stack[-1][0] == depth:
            stack[-1][1].extend(group)
        else:
            stack.append((depth, group))
        group = [this]
    while stack:
        top, members = stack.pop()
        members.extend(group)
        close(top, members)
        group = members
    return pairs


def windows_of(pairs: list[tuple[int, int]], length: int, lo: int, hi: int) -> list[Run]:
    """Which windows between lo and hi repeat. The anchor at distance d from a window's start is in window d;
    l bytes to the left and r to the right make windows length - r to l repeat."""
    clipped = [(max(lo, length - r), min(hi, l)) for l, r in pairs]
    return merged([(a, b) for a, b in clipped if a <= b])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's anchors, those that occur again in it twice, the others once."""
    powers = Powers()
    for b in batches:
        found = []
        for t in b.column("text"):
            values, times = np.unique(anchors(t.as_py(), powers)[1], return_counts=True)
            found.append(np.repeat(values, np.minimum(times, 2)))
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        values = pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64))
        yield batch(doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), anchors=pa.ListArray.from_arrays(pa.array(offsets), values))


_ROWS = {"doc_id": pa.int64(), "text_hash": pa.int64(), "anchor": pa.int64(), "digest": pa.binary(), "places": pa.list_(pa.int32()), "near": pa.int32(), "far": pa.int32(), "bytes": pa.binary()}


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, anchor and distinct surroundings; the bytes only the first time that a task meets them."""
    powers, seen = Powers(), set()
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return batch(**{k: ([r[i] for r in rows], t) for i, (k, t) in enumerate(_ROWS.items())})

    for b in batches:
        for doc_id, text_hash, text, wanted in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text"), b.column("wanted"), strict=True):
            text = text.as_py()
            places, h, firsts, lasts = anchors(text, powers)
            hit = np.isin(h, wanted.values.to_numpy())
            classes: dict[tuple[int, bytes], list] = {}
            for place, anchor, first, last in zip(places[hit].tolist(), h[hit].tolist(), firsts[hit].tolist(), lasts[hit].tolist(), strict=True):
                near, far = place - last, place - first
                part = text[first : last + LENGTH]
                digest = hashlib.blake2b(part, digest_size=16, salt=b"%d,%d" % (near, far)).digest()
                if (known := classes.get((anchor, digest))) is not None:
                    known[0].append(place)
                else:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    classes[anchor, digest] = [[place], near, far, None if (anchor, digest) in seen else part]
                    seen.add((anchor, digest))
            rows += [(doc_id, text_hash, anchor, digest, *rest) for (anchor, digest), rest in classes.items()]
            if len(rows) >= 10_000:
                yield flush()
                rows = []
    yield flush()


_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
#: Windows of SHORT and of LENGTH bytes that repeat, for surroundings told by anchor and digest.
_VERDICT = "anchor long, digest binary, length int, runs array<struct<lo:int,hi:int>>"


def _verdicts(rows: list[tuple[int, bytes, int, list[Run]]]) -> pa.RecordBatch:
    kept = [r for r in rows if r[3]]
    return batch(anchor=([r[0] for r in kept], pa.int64()), digest=([r[1] for r in kept], pa.binary()), length=([r[2] for r in kept], pa.int32()), runs=([[{"lo": a, "hi": b} for a, b in r[3]] for r in kept], _RUNS))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts of the groups in rows sorted by `key`: those of two to GROUP distinct surroundings.

    length 0 asks for strings of both lengths; lo and hi bound the windows asked for.
    """
    key, group = None, {}

    def settle() -> list[tuple]:
        if not 1 < len(group) <= GROUP:
            return []
        members = list(group.values())
        asked = members[0]["length"]
        pairs = shared_strings([m["bytes"][: m["far"]] for m in members], [m["bytes"][m["far"] :] for m in members], asked or SHORT)
        return [(m["anchor"], m["digest"], length, windows_of(p, length, m["lo"], m["hi"])) for m, p in zip(members, pairs, strict=True) if p for length in ((asked,) if asked else (SHORT, LENGTH))]

    out: list[tuple] = []
    for b in batches:
        for r in b.to_pylist():
            if r["key"] != key:
                out += settle()
                key, group = r["key"], {}
            # several tasks may have sent the same bytes; a group beyond GROUP is settled elsewhere
            if len(group) <= GROUP:
                group.setdefault(r["digest"], r)
        if len(out) >= 10_000:
            yield _verdicts(out)
            out = []
    yield _verdicts(out + settle())


def _digest(*parts: bytes | int) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p if isinstance(p, bytes) else b"%d," % p)
    return h.digest()


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings cut into RANGE windows: what all windows of a range have in common makes the smaller group."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            part, near, far = r["bytes"], r["near"], r["far"]
            for length in (SHORT, LENGTH):
                for lo in range(0, SHORT - ANCHOR + 1, RANGE):
                    hi = min(lo + RANGE - 1, SHORT - ANCHOR)
                    a, z = max(lo, near, length - (len(part) - far)), min(hi, far)
                    if a <= z:
                        rows.append((r["anchor"], r["digest"], r["n"], length, a, z, _digest(r["anchor"], length, lo, part[far - lo : far + length - hi]), _digest(a, z, part[far - z : far - a + length])))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield batch(**{k: ([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(("anchor", "digest", "n", "length", "lo", "hi", "key", "sub"), kinds, strict=True))})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(r["anchor"], r["digest"], r["n"], r["length"], d, _digest(r["length"], d, r["bytes"][r["far"] - d : r["far"] - d + r["length"]])) for r in b.to_pylist() for d in range(r["lo"], r["hi"] + 1)]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield batch(**{k: ([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(("anchor", "digest", "n", "length", "d", "window"), kinds, strict=True))})


def _whole(rows: DataFrame, length: int | str, lo, hi) -> DataFrame:
    size = F.lit(length) if isinstance(length, int) else F.col(length)
    return rows.select("anchor", "digest", size.alias("length"), F.array(F.struct(lo.alias("lo"), hi.alias("hi"))).alias("runs"))


def split_groups(big: DataFrame, scratch: Scratch) -> DataFrame:
    """Verdicts for anchors of more than GROUP distinct surroundings (anchor, digest, n, near, far, bytes).

    The windows around the anchor are cut into ranges; what the windows of a range have in common, nearly
    a whole string, makes smaller groups. Those of equal members are settled by their count, others of up
    to GROUP by trees of their own; in the rest, which only differ near one place, the windows of that
    range are counted one by one. Counting combines before the shuffle, so no group's rows need meet.
    """
    pieces = scratch.save("pieces", arrow_map(big, _cuts, "anchor long, digest binary, n long, length int, lo int, hi int, key binary, sub binary"))
    # equal pieces are one member of their group; one that occurs once has the one surroundings it stands for
    one = F.min(F.struct("anchor", "digest", "length", "lo", "hi")).alias("one")
    subs = scratch.save("subs", pieces.groupBy("key", "sub").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), one).select("key", "sub", "n", "rows", "one.*"))
    groups = scratch.save("groups", subs.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    again = skewed_join(pieces, subs.where("n > 1").select("key", "sub"), ["key", "sub"], hot_keys(subs, ["key", "sub"], "rows", GROUP))
    mixed = skewed_join(subs.select("key", "n", "anchor", "digest", "length", "lo", "hi"), groups, ["key"], hot_keys(groups, ["key"], "kinds", GROUP))
    mixed = scratch.save("mixed", mixed.join(big.select("anchor", "digest", "far", "bytes"), ["anchor", "digest"]))
    small = mixed.where(F.col("kinds") <= GROUP).repartition("key").sortWithinPartitions("key")
    windows = scratch.save("windows", arrow_map(mixed.where(F.col("kinds") > GROUP), _windows, "anchor long, digest binary, n long, length int, d int, window binary"))
    counted = scratch.save("counted", windows.groupBy("anchor", "window").agg(F.sum("n").alias("times"), F.count("*").alias("rows")))
    found = skewed_join(windows, counted.where("times > 1").select("anchor", "window"), ["anchor", "window"], hot_keys(counted, ["anchor", "window"], "rows", GROUP))
    return _whole(again, "length", F.col("lo"), F.col("hi")).unionByName(arrow_map(small, _trees, _VERDICT)).unionByName(_whole(found, "length", F.col("d"), F.col("d")))


def likely(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows that a bitmap doesn't rule out, before a shuffle that joins them with few of all anchors."""
    return with_maybe(rows, "anchor", anchors).where("maybe").drop("maybe")


def large_groups(sent: DataFrame, classes: DataFrame, large: DataFrame, hot: list[int]) -> DataFrame:
    """anchor, digest, n, near, far and bytes of the surroundings of large anchors; those of others are not shuffled."""
    counted = skewed_join(likely(classes.select("anchor", "digest", "n"), large), large, ["anchor"], hot)
    bytes_of = skewed_join(likely(sent, large), large, ["anchor"], hot).dropDuplicates(["anchor", "digest"])
    return bytes_of.join(counted, ["anchor", "digest"])


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash and spans (length, begin, stop): bytes covered by strings that also start elsewhere; may overlap."""
    found = scratch.save("anchors", arrow_map(raw(docs), _anchor_rows, "doc_id long, text_hash long, anchors array<long>"))
    each = found.select("doc_id", "text_hash", F.explode("anchors").alias("anchor"))
    again = scratch.save("again", each.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1"))
    each = found.select("doc_id", "text_hash", F.explode(F.array_distinct("anchors")).alias("anchor"))
    repeated = skewed_join(likely(each, again), again.select("anchor"), ["anchor"], hot_keys(again, ["anchor"], "times", GROUP))
    wanted = scratch.save("wanted", repeated.groupBy("doc_id", "text_hash").agg(F.collect_set("anchor").alias("wanted")))
    scratch.drop("anchors")
    scratch.drop("again")
    texts = with_maybe(raw(docs), "text_hash", wanted).where("maybe")
    named = wanted.withColumnRenamed("doc_id", "wanted_id")
    texts = texts.join(named, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("doc_id", "text_hash", "text", "wanted")
    rows = scratch.save("surroundings", arrow_map(texts, _surroundings, "doc_id long, text_hash long, anchor long, digest binary, places array<int>, near int, far int, bytes binary"))
    scratch.drop("wanted")

    classes = rows.groupBy("anchor", "digest").agg(F.sum(F.size("places")).alias("n"), F.count("*").alias("rows"), F.first("near").alias("near"), F.first("far").alias("far"), F.max(F.length("bytes")).alias("size"))
    classes = scratch.save("classes", classes)
    kinds = scratch.save("kinds", classes.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    # all windows of surroundings that occur twice repeat; LENGTH bytes need not fit behind the last ones
    twice = classes.where("n > 1")
    least = F.greatest("near", F.lit(LENGTH) - (F.col("size") - F.col("far")))
    verdicts = _whole(twice, SHORT, F.col("near"), F.col("far")).unionByName(_whole(twice.where(least <= F.col("far")), LENGTH, least, F.col("far")))
    # trees: the bytes of anchors of several surroundings meet by anchor
    hot = hot_keys(kinds, ["anchor"], "kinds", GROUP)
    sent = rows.where("bytes is not null").select("anchor", "digest", "near", "far", "bytes")
    several = with_maybe(sent, "anchor", kinds.where(F.col("kinds") <= GROUP)).where("maybe")
    several = several.where(~among(["anchor"], hot))
    several = several.select(F.col("anchor").alias("key"), "anchor", "digest", F.lit(0).alias("length"), F.col("near").alias("lo"), F.col("far").alias("hi"), "far", "bytes")
    verdicts = verdicts.unionByName(arrow_map(several.repartition("key").sortWithinPartitions("key"), _trees, _VERDICT))
    large = kinds.where(F.col("kinds") > GROUP).select("anchor")
    if not large.isEmpty():
        verdicts = verdicts.unionByName(split_groups(scratch.save("big", large_groups(sent, classes, large, hot)), scratch))

    verdicts = scratch.save("verdicts", verdicts)
    runs = skewed_join(rows.select("doc_id", "text_hash", "anchor", "digest", "places"), verdicts, ["anchor", "digest"], hot_keys(classes, ["anchor", "digest"], "rows", GROUP))
    each = runs.select("doc_id", "text_hash", "length", "runs", F.explode("places").alias("place")).select("doc_id", "text_hash", "length", "place", F.explode("runs").alias("run"))
    span = F.struct("length", (F.col("place") - F.col("run.hi")).alias("begin"), (F.col("place") - F.col("run.lo") + F.col("length")).alias("stop"))
    spans = scratch.save("spans", each.groupBy("doc_id", "text_hash").agg(F.collect_set(span).alias("spans")))
    for name in ("surroundings", "classes", "kinds", "big", "pieces", "subs", "groups", "mixed", "windows", "counted", "verdicts"):
        scratch.drop(name)
    return spans


def _joined(begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of what spans cover."""
    if not len(begins):
        return begins, stops
    order = np.argsort(begins, kind="stable")
    b, e = begins[order], np.maximum.accumulate(stops[order])
    fresh = np.concatenate([[True], b[1:] > e[:-1]])
    return b[fresh], e[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(b) - 1]])]


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """What is left of a text without the runs."""
    kept, at = [], 0
    for s, t in zip(starts.tolist(), ends.tolist(), strict=True):
        kept.append(text[at:s])
        at = t
    kept.append(text[at:])
    return b"".join(kept)


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, n_passages long, kept binary"


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, dtype=np.int64)
    for b in batches:
        out = []
        for t, spans in zip(b.column("text"), b.column("spans"), strict=True):
            text = t.as_py()
            length, begin, stop = (spans.values.field(k).to_numpy() for k in range(3)) if spans.is_valid else (none, none, none)
            starts, ends = _joined(begin[length == LENGTH], stop[length == LENGTH])
            kept = _cut(text, starts, ends)
            froms, tos = _joined(begin[length == SHORT], stop[length == SHORT])
            passages = sum(len(text[s:e].split()) > WORDS for s, e in zip(froms.tolist(), tos.tolist(), strict=True))
            out.append((len(text), int((ends - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest(), int((tos - froms).sum()), passages, kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "n_passages", "kept")
        yield batch(doc_id=b.column("doc_id"), **{k: ([o[i] for o in out], t) for i, (k, t) in enumerate(zip(names, kinds, strict=True))})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated, n_passages and kept (UTF-8 bytes) of every document.

    Every byte covered by a LENGTH-byte string that also starts anywhere else goes; strings are judged
    on the input. Shorter repeats are reported and stay: n_repeated are the bytes covered by SHORT-byte
    strings that also start elsewhere, n_passages the maximal runs of those that hold over WORDS words
    (some 320 bytes of prose, which LENGTH misses).

    Anchors (about one in 100 bytes) that occur once are dropped by a count; the bytes around the others
    are compared by anchor, in trees. Copies send their bytes once a task. Texts are shuffled only if a
    bitmap of fixed size says that they may hold a repeated anchor.

    Shuffles: anchors (8 bytes each), those repeated with their document's id, the texts with repeats
    twice, and surroundings of repeated anchors; of large groups' ones only theirs are sent again. No group of copies or common passage meets in one task: equal
    surroundings are combined before the shuffle, keys with more than one in HOT_KEYS of the rows are
    joined by broadcast, and anchors with more than GROUP distinct surroundings are split by further bytes.

    Cases: null, empty and short texts lose nothing; repeated rows lose all windows, being copies of
    each other; no rows give no rows; other columns of docs are ignored, whatever their names. Cuts may
    fall within a character, so kept is bytes.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    spans = repeated_spans(docs, scratch)
    texts = with_maybe(raw(docs), "text_hash", spans)
    zero = F.lit(0).cast("long")
    whole = texts.where("not maybe").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), zero.alias("n_repeated"), zero.alias("n_passages"), F.col("text").alias("kept"))
    named = spans.withColumnRenamed("doc_id", "span_id").withColumnRenamed("text_hash", "span_hash")
    joined = texts.where("maybe").join(named, (F.col("text_hash") == F.col("span_hash")) & F.col("doc_id").eqNullSafe(F.col("span_id")), "left")
    return whole.unionByName(arrow_map(joined.select("doc_id", "text", "spans"), _results, _RESULT))
