"""Masking: spans replaced in pieces against a plain replacement."""

import random
import time

import pytest

from lakeloom.llm import pii

SPANS = "id int, text string, spans array<struct<start: int, end: int, kind: string>>, size int"


def plainly(text, spans):
    out, at = "", 0
    for start, end, kind in sorted(spans or []):
        if start >= at:
            out += text[at:start] + f"<{kind.upper()}>"
        at = max(at, end)
    return text if not spans else out + text[at:]


@pytest.mark.parametrize("length", [pii.PIECE - 1, pii.PIECE, pii.PIECE + 1, 3 * pii.PIECE + 17])
def test_spans_across_pieces(spark, length):
    rng = random.Random(length)
    rows = [(0, None, None, 1), (1, "", None, 1), (2, "", [], 1), (3, "plain", [(0, 5, "ip")], 1), (4, "x" * length, [(0, length, "card")], 1)]
    for k in range(5, 25):
        text = "".join(rng.choice("abé\n🙂 ") for _ in range(length))
        spans = []
        for _ in range(rng.choice([1, 5, 60, 400])):
            start = rng.randrange(length)
            spans.append((start, min(length, start + rng.choice([1, 3, 20, 20, pii.PIECE, 5_000])), rng.choice(pii.KINDS)))
        if k % 3 == 0:  # ends at borders of pieces
            spans += [(s, e, "ip") for s, e in [(pii.PIECE - 2, pii.PIECE), (pii.PIECE, pii.PIECE + 1)] if e <= length]
        rows.append((k, text, spans, 1))
    got = {r["id"]: r["text"] for r in pii.replace_spans(spark.createDataFrame(rows, SPANS).repartition(3), "text", "spans").collect()}
    for k, text, spans, _ in rows:
        assert got[k] == plainly(text, spans), k


def test_many_spans_in_a_long_text_take_linear_time(spark):
    """100,000 spans in 5 MB, from finding to masking."""
    text = "".join(f"write to someone{k:05d}@example.org about the matter. "[:50].ljust(50) for k in range(100_000))
    frame = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    pii.redact(frame.limit(0)).count()
    began = time.perf_counter()
    row = pii.redact(frame).first()
    assert time.perf_counter() - began < 30
    assert row["text"].count("<EMAIL>") == 100_000 and "@" not in row["text"] and row["n_chars"] == len(row["text"])


def test_masked_tables(spark):
    schema = "doc_id long, text string, spans string, n_chars long, size int"
    rows = [(1, "mail a.b@example.org now", "x", 24, None), (1, "mail a.b@example.org now", "x", 24, None), (None, None, None, None, 1), (2, "", None, 0, 1), (2, "none", None, 4, 1)]
    frame = spark.createDataFrame(rows, schema)
    got = sorted((tuple(r) for r in pii.redact(frame).collect()), key=repr)
    masked = (1, "mail <EMAIL> now", "x", 16, None)
    assert got == sorted([masked, masked, rows[2], rows[3], rows[4]], key=repr)
    assert pii.redact(frame.limit(0)).count() == 0 and pii.redact(frame).columns == frame.columns
