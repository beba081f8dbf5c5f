"""Secrets in texts: labelled and known forms, and strings whose windows have high entropy."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_map, batch, texts

KINDS = ("assign", "access", "hex", "entropy")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A run that ends where its class ends has one longest match, so the least length can be in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

#: Characters of a window and the least length of a candidate.
WINDOW = 20
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{WINDOW},}}")
#: Character classes from narrow to wide, with the entropy, in bits a character, that a window needs. Random windows
#: of 20 signs have 3.4, 4.1 and 4.1 bits; ordinary words without spaces have 3.5 at most in the wide ones.
CLASSES = (("hex", re.compile(r"[0-9A-Fa-f]+"), 2.9), ("alnum", re.compile(r"[A-Za-z0-9]+"), 3.75), ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), 3.85))

#: What is no secret though it looks random, matched against the whole candidate.
ALLOWED = (
    r"[0-9]+",  # numbers
    r"[^0-9]*",  # words and identifiers: random strings of 20 signs without a digit are rare
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # UUIDs
    r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-].*",  # times
    r"(?i:.*(?:example|placeholder|changeme|redacted|dummy|sample|x{6}).*)",
    r"(?:[A-Za-z]+[0-9]{0,4}[/_+-])*[A-Za-z]+[0-9]{0,4}",  # paths and names of words with numbers behind
)
#: What a candidate follows where it is a checksum or a part of a link.
ALLOWED_BEFORE = re.compile(r"(?i)(?:sha-?(?:1|224|256|384|512)|md5|checksum|digest|integrity|commit|revision)[\"']?[\x20:=-]{1,3}[\"']?$|(?:https?|ftp)://[^\s\"'<>]*$")
BEFORE = 256
#: Alphabets and rows of keys step by one from sign to sign; in random strings one step in 30 does.
MOST_STEPS = 0.4

_PLOGP = [0.0, *[n * math.log2(n) for n in range(1, WINDOW + 1)]]


def entropies(text: str, window: int = WINDOW) -> Iterator[float]:
    """Shannon entropy in bits a character of each window of the text, by counts kept from window to window:
    one sign leaves, one enters, and only their two terms of the sum change."""
    terms = _PLOGP if window == WINDOW else [0.0, *[n * math.log2(n) for n in range(1, window + 1)]]
    counts: dict[str, int] = {}
    total, top = 0.0, math.log2(window)
    for k, c in enumerate(text):
        if k >= window:
            gone = text[k - window]
            n = counts[gone]
            total += terms[n - 1] - terms[n]
            counts[gone] = n - 1
        n = counts.get(c, 0)
        total += terms[n + 1] - terms[n]
        counts[c] = n + 1
        if k >= window - 1:
            yield top - total / window


def _suppressed(text: str, start: int, end: int, allow: re.Pattern) -> bool:
    value = text[start:end]
    if allow.fullmatch(value):
        return True
    if ALLOWED_BEFORE.search(text, max(0, start - BEFORE), start):
        return True
    steps = sum(abs(ord(a) - ord(b)) == 1 for a, b in zip(value, value[1:]))
    return steps > MOST_STEPS * len(value)


def high_entropy(text: str, allow: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of a text whose windows reach their class's entropy: in each candidate the runs of a class are slid
    over, the narrow classes first, and windows that overlap or touch are one span; a digit and a letter are needed."""
    for m in CANDIDATE.finditer(text):
        if _suppressed(text, m.start(), m.end(), allow):
            continue
        found: list[list[int]] = []
        for _, runs, least in CLASSES:
            for run in runs.finditer(m.group()):
                if len(run.group()) < WINDOW:
                    continue
                at = m.start() + run.start()
                for k, bits in enumerate(entropies(run.group())):
                    if bits >= least:
                        if found and found[-1][0] <= at + k <= found[-1][1]:
                            found[-1][1] = max(found[-1][1], at + k + WINDOW)
                        else:
                            found.append([at + k, at + k + WINDOW])
        last = -1
        for start, end in _united(found):
            value = text[start:end]
            if start >= last and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                yield start, end
                last = end


def _united(spans: list[list[int]]) -> Iterator[tuple[int, int]]:
    at: list[int] | None = None
    for start, end in sorted(spans):
        if at and start <= at[1]:
            at[1] = max(at[1], end)
        else:
            if at:
                yield at[0], at[1]
            at = [start, end]
    if at:
        yield at[0], at[1]


def spans_of(text: str, allow: re.Pattern) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind as listed; added ones overlap no base span."""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    added = list(high_entropy(text, allow))
    if added and base:
        # one walk along both: taken ends never fall, as the largest so far is kept
        taken, k, reach, free = sorted((s, e) for _, s, e in base), 0, -1, []
        for start, end in added:
            while k < len(taken) and taken[k][0] < end:
                reach = max(reach, taken[k][1])
                k += 1
            if reach <= start:
                free.append((start, end))
        added = free
    return sorted(base + [("entropy", s, e) for s, e in added], key=lambda x: (x[1], KINDS.index(x[0])))


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, allow: Iterable[str] = ALLOWED) -> DataFrame:
    """doc_id, text_hash, base and spans (arrays of kind, start, end in code points, by start, then kind as listed).

    Base kinds are found by their patterns, leftmost and non-overlapping a kind. Candidate strings, runs of 20 and
    more letters, digits and `+/_-`, are slid over by windows of 20 signs, for each character class apart; what
    reaches the class's entropy is added as kind "entropy" unless the candidate is allowed: it matches a
    pattern of `allow` as a whole, follows the label of a checksum or lies in a link, or runs through an alphabet.
    Each text is read once and whole, in time linear in its length; no shuffle.

    Cases: null and empty texts have no spans; a very long run is one candidate, slid over whole; equal starts of
    two kinds are ordered as KINDS; repeated rows get the same spans; other columns are ignored, whatever their
    names; no rows give no rows.
    """
    allowed = "|".join(f"(?:{p})" for p in allow) or r"(?!)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(allowed, re.DOTALL)
        for b in batches:
            found = [spans_of(t, pattern) for t in b.column("text").to_pylist()]
            rows = lambda kinds: [[{"kind": k, "start": s, "end": e} for k, s, e in x if k in kinds] for x in found]
            yield batch(doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), base=(rows(BASE), SPAN), spans=(rows(KINDS), SPAN))

    span = "array<struct<kind: string, start: long, end: long>>"
    return arrow_map(texts(docs), run, f"doc_id long, text_hash long, base {span}, spans {span}")


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns of find_secrets."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return spans.select("doc_id", *[of_kind(kind).alias(f"n_{kind}") for kind in BASE], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def mask(docs: DataFrame, allow: Iterable[str] = ALLOWED) -> DataFrame:
    """docs with every secret replaced by `<SECRET>`; all columns stay, n_chars follows the text.

    Overlapping and touching spans are one. Cases as in find_secrets; null and empty texts stay as they are.
    """
    allowed = "|".join(f"(?:{p})" for p in allow) or r"(?!)"
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(allowed, re.DOTALL)
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                pieces, end = [], 0
                for s, e in _united([[s, e] for _, s, e in spans_of(text or "", pattern)]):
                    pieces += [text[end:s], "<SECRET>"]
                    end = e
                out.append(text if not end else "".join([*pieces, text[end:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else c for k, c in enumerate(b.columns)], list(b.schema.names))

    masked = docs.mapInArrow(run, docs.schema)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked
