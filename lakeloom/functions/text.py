"""Cleaning, segmentation and lexical functions: Column -> Column.

Spark's regular expressions are java.util.regex. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the cleaning rules.
ARTEFACTS = r"\x00|\f|\uFEFF|\u00AD|[\u200B-\u200F]|[\u2028\u2029]"
REPEATED = r"(.)\1{10,}"
BLANKS = r"[ \t\x0B\f\r]+"
LEADERS = r"[.·…]{5,}|[-_=]{5,}"
PAGE_NUMBERS = r"(?im)^\s*(?:(?:page|p\.?)\s*\d+(?:\s*(?:of|/)\s*\d+)?|\d+\s*(?:of|/)\s*\d+|-\s*\d+\s*-|\d{1,4})\s*$"
HEADERS = r"(?im)^\s*(?:(?:confidential|draft|internal use only|do not distribute|privileged)|(?:copyright|©)\s*(?:\d{4}|\(c\)).*|(?:all rights reserved).*|(?:printed on|generated on|last (?:updated|modified))\s+.*)\s*$"
BLANK_LINES = r"\n{4,}"
# Patterns of the segmenter.
SENTENCES = r"(?<=[.!?])\s+(?=[A-Z])|(?<=\n)\s*(?=\S)|(?<=;)\s+"
PARAGRAPHS = r"\n\s*\n"
HEADINGS = r"(?im)^\s*(?:#{1,6}\s+|(?:chapter|section|article|part)\s+[\divxlc]+|\d+(?:\.\d+)*\.?\s+[A-Z]|[A-Z][A-Z\s]{3,}$)"
# Words that say nothing about a document.
STOP_WORDS = (
    "and", "are", "but", "can", "did", "does", "for", "has", "have", "how", "its",
    "may", "not", "the", "that", "this", "was", "were", "what", "when", "which", "who",
    "why", "with", "you", "your", "from", "into", "than", "them", "then", "they", "will",
)
MIN_TERM, MAX_TERMS = 3, 12
K1, B, AVERAGE_WORDS = 1.2, 0.75, 100.0
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
TARGET_TOKENS, MAX_CHARS = 480, 3000
#: What Java counts as white space: none of the no-break spaces.
WHITE = r"[\t-\r\x1C-\x20\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def is_blank(text: Column) -> Column:
    """Null, empty or white space alone."""
    return F.coalesce(text.rlike(rf"\A{WHITE}*+\z"), F.lit(True))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"\A{WHITE}+|{WHITE}+\z", "")


def java_trim(text: Column) -> Column:
    """Without control characters and spaces (up to U+0020) at either end."""
    return F.regexp_replace(text, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def drop_artefacts(text: Column) -> Column:
    return F.regexp_replace(text, ARTEFACTS, "")


def drop_repeated(text: Column) -> Column:
    return F.regexp_replace(text, REPEATED, "")


def squeeze_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, " ")


def drop_leaders(text: Column) -> Column:
    return F.regexp_replace(text, LEADERS, " ")


def drop_page_numbers(text: Column) -> Column:
    return F.regexp_replace(text, PAGE_NUMBERS, "")


def drop_headers(text: Column) -> Column:
    return F.regexp_replace(text, HEADERS, "")


def drop_boilerplate(text: Column) -> Column:
    """Without lines (stripped length between 4 and 99) that make up a seventh of ten or more lines, three at least.

    In sorted order a line that occurs n times equals the one n - 1 places on, so one pass finds them.
    A text without such lines stays as it is.
    """

    def often(lines: Column) -> Column:
        least = F.greatest(F.lit(3), F.floor(F.size(lines) / 7).cast("int"))
        stripped = F.array_sort(F.filter(F.transform(lines, strip), lambda x: F.length(x).between(4, 99)))
        return _with(stripped, lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + least - 1) == x, F.lit(False)))))

    def without(lines: Column, some: Column) -> Column:
        rest = F.filter(lines, lambda x: ~F.array_contains(some, strip(x)))
        return F.array_join(F.transform(rest, lambda x: F.concat(x, F.lit("\n"))), "")

    def kept(whole: Column) -> Column:
        lines = F.split(F.regexp_replace(whole, r"\n+\z", ""), "\n", -1)
        return _with(lines, lambda a: _with(F.when(F.size(a) >= 10, often(a)), lambda some: F.when(F.size(some) > 0, without(a, some)).otherwise(whole)))

    return _with(text, kept)


def collapse_blank_lines(text: Column) -> Column:
    return java_trim(F.regexp_replace(text, BLANK_LINES, "\n\n"))


def clean(text: Column, aggressive: bool = False, enabled: bool = True) -> Column:
    """All rules in order; null and blank become empty."""
    out = text
    if enabled:
        for rule in (drop_artefacts, drop_repeated, squeeze_blanks, drop_leaders, drop_page_numbers, drop_headers):
            out = rule(out)
        out = collapse_blank_lines(drop_boilerplate(out) if aggressive else out)
    return F.when(text.isNull() | (java_trim(text) == ""), F.lit("")).otherwise(out)


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern, -1), lambda s: F.regexp_replace(s, r"\A\s+|\s+\z", "")), lambda s: s != "")


def sentences(text: Column) -> Column:
    return _pieces(text, SENTENCES)


def paragraphs(text: Column) -> Column:
    return _pieces(text, PARAGRAPHS)


def sections(text: Column) -> Column:
    """Headings stay with what follows; what is before the first is a section of its own."""
    return _pieces(F.regexp_replace(text, HEADINGS, "\u0001$0"), "\u0001")


def sanitize(text: Column) -> Column:
    """What goes to an embedding model."""
    return java_trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\x00", ""), r"[ \t\x0B\f\r]+", " "), r"\n{3,}", "\n\n"))


def chars_per_token(text: Column) -> Column:
    """Between 1.0 (signs only) and 2.2 (prose) characters a token, by the share of signs."""
    length = F.length(text)
    signs = F.length(F.regexp_replace(text, r"[\p{L}\p{Nd}\s]", ""))
    return F.when(length == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(1.0), F.lit(2.2) - signs / length * 5.0))


def _last_before(text: Column, sign: str, end: Column, window: int) -> Column:
    """0-based place of the last such sign from `end` down to `window` before it, or -1."""
    start = F.greatest(F.lit(0), end - window)
    part = F.substring(text, start + 1, end - start + 1)
    at = F.length(part) - F.instr(F.reverse(part), sign)
    return F.when(F.contains(part, F.lit(sign)), start + at).otherwise(F.lit(-1))


def truncate_to_budget(text: Column) -> Column:
    """At most TARGET_TOKENS by estimate and MAX_CHARS: cut behind a full stop, else at a line end, a space, or hard."""

    def cut(capped: Column, limit: Column) -> Column:
        stop, line, space = _last_before(capped, ".", limit, 80), _last_before(capped, "\n", limit, 80), _last_before(capped, " ", limit, 40)
        at = F.when(stop > 0, stop + 1).when(line > 0, line).when(space > 0, space).otherwise(limit)
        return F.when(F.length(capped) <= limit, capped).otherwise(F.substring(capped, F.lit(1), at))

    return _with(F.substring(text, 1, MAX_CHARS), lambda c: _with((chars_per_token(c) * TARGET_TOKENS).cast("int"), lambda n: cut(c, n)))


def keyword_terms(query: Column) -> Column:
    """Distinct useful terms of a query, at most twelve."""
    words = F.split(F.lower(F.coalesce(query, F.lit(""))), r"\s+", -1)
    bare = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"[\\'%_]", ""), r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= MIN_TERM) & ~w.isin(*STOP_WORDS))), 1, MAX_TERMS)


def any_term(text: Column, terms: Column) -> Column:
    """Whether a text holds any of the terms, letter case aside."""
    lower = F.lower(text)
    return F.exists(terms, lambda t: F.contains(lower, t))


def bm25_tf(text: Column, terms: Column) -> Column:
    """Mean saturated term frequency of the terms, by substring, with length normalisation; no corpus statistics."""
    lower = F.lower(text)
    words = F.size(F.split(F.regexp_replace(lower, r"\s+\z", ""), r"\s+", -1))
    norm = F.lit(1.0 - B) + F.lit(B) * words / F.lit(AVERAGE_WORDS)

    def gain(t: Column) -> Column:
        tf = (F.length(lower) - F.length(F.replace(lower, t, F.lit("")))) / F.length(t)
        return F.when(F.trim(t) == "", F.lit(0.0)).otherwise(tf * (K1 + 1.0) / (tf + K1 * norm))

    total = F.aggregate(F.transform(terms, gain), F.lit(0.0), lambda a, x: a + x)
    return F.when(text.isNull() | (java_trim(text) == "") | (F.size(terms) < 1), F.lit(0.0)).otherwise(total / F.size(terms))


def whitespace_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def strip_list_mark(text: Column) -> Column:
    """Without a bullet or number at its begin."""
    return F.trim(F.regexp_replace(text, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))


def stream_delta(chunk: Column, so_far: Column) -> Column:
    """What a cumulative chunk adds to an answer, or the chunk itself."""
    return F.when(F.startswith(chunk, so_far), F.substring(chunk, F.length(so_far) + 1, F.length(chunk))).otherwise(chunk)


def rerank_scores(answer: Column, items: Column) -> Column:
    """(index, score) pairs of a model's answer such as "[2] = 7": indices in range, the first of each."""
    pattern = r"\[?(\d+)\]?\s*[=:]?\s*(\d+)"
    pairs = F.arrays_zip(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)).alias("i"), F.regexp_extract_all(answer, F.lit(pattern), F.lit(2)).alias("s"))
    typed = F.transform(pairs, lambda p: F.struct(p["i"].cast("int").alias("i"), p["s"].cast("double").alias("s")))
    inside = F.filter(typed, lambda p: (p["i"] >= 1) & (p["i"] <= items))
    first = F.transform(F.array_distinct(F.transform(inside, lambda p: p["i"])), lambda i: F.struct(i.alias("i"), F.get(F.filter(inside, lambda p: p["i"] == i), F.lit(0))["s"].alias("s")))
    return first


def file_name(name: Column) -> Column:
    """Without signs that file systems refuse, at most 120 characters."""
    return F.substring(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', "_"), 1, 120)


def mirror_text(text: Column) -> Column:
    """The first 64,000 characters, null where blank."""
    return F.when(java_trim(text) != "", F.substring(text, 1, 64_000))
