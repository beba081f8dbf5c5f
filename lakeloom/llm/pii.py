"""Personal data by weak supervision, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lakeloom.session import Scratch

KINDS = ("email", "ip", "card", "phone")

# Each pattern finds the same matches as the base pattern it stands for. Possessive quantifiers keep
# long runs from being tried again and again (and from deep recursion), and the look-behinds keep a run
# from being entered in its middle: \G lets a match begin right behind the one before.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the method may add: the same kinds in other spellings.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]{1,63}+){1,6}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without these can't hold the kind.
NEEDS = {"email": "@", "phone": "+"}
#: What must be in a text for the wider spellings.
NEEDS_WIDER = {"email": r"[(\[{]at[)\]}]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[./_][0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
#: Gazetteers: domain ends, issuer prefixes, country codes and ordinary first octets.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]}]\x20?)(?:com|org|net|edu|gov|info|biz|io|eu|de|fr|es|it|nl|uk|us|ca|au|jp|ch|at|be|pl|se|no|dk|fi)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.|:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?![0-9]{15})|^\(|555",
}
#: Words that announce the kind, looked for in the 40 code points before it.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|courriel|correo|kontakt)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|address|addr|client|from|login|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|pay|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|telefon|t[eé]l[eé]phone|tel[eé]fono|whatsapp)\b",
}
#: Words that speak against any kind there: numbers and names of other things.
AGAINST = r"(?i)\b(?:order|invoice|isbn|version|section|chapter|figure|serial|sku|part|item|page|ref|reference|id|no)\b[\s.:#]*$"
CONTEXT_POINTS = 40
#: Shorter card candidates can't be valid and are dropped at once, as are the many numbers of tables and logs.
LEAST_CARD = 13
#: Matches whose places are summed up at once.
BLOCK = 256
#: Buckets of a span's shape: its runs of digits and letters, and the signs between them.
SHAPES = 64
#: Added spans need so much of the classifier; base spans stay whatever it says.
ADD_FROM = 0.9
ROUNDS, STEPS = 50, 400


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weigh), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, match: Column, base: bool) -> Column:
    """The checks of a kind; those of the wider spellings are their own."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        # area codes and exchanges begin with 2 to 9
        return F.length(digits).between(9, 15) if base else digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    if kind == "ip":
        part = r"0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        # eight groups that could be times or counters have no letter and no group of three signs
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$") if base else match.rlike("[A-Fa-f]|[0-9]{3}")
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """For each of an array's values the sum of those before it, in time linear in its length but for blocks of BLOCK.

    `lengths` must be a column, not an expression, as it is named within a lambda.
    """

    def before(values: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list"))
        return F.aggregate(values, none, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["list"], F.array(a["at"])).alias("list")))["list"]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, before(totals), lambda b, at: F.transform(before(b), lambda x: x + at)))


VOTES = ("v_strict", "v_valid", "v_gazetteer", "v_context")


def _span(kind: str, base: bool, piece: Column, m: Column, before: Column) -> Column:
    """A candidate: kind, start, end (code points), whether it is a base span, the labelers' votes (1 for, 0 against, -1 abstaining) and its shape."""
    at = before + F.length(piece)
    context = F.right(piece, F.lit(CONTEXT_POINTS))
    valid = _valid(kind, m, base)
    shape = F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), r"\p{L}+", "a")
    return F.struct(
        F.lit(kind).alias("kind"),
        at.alias("start"),
        (at + F.length(m)).alias("end"),
        (F.lit(base) & valid).alias("base"),
        F.lit(1 if base else -1).alias("v_strict"),
        valid.cast("int").alias("v_valid"),
        m.rlike(GAZETTEER[kind]).cast("int").alias("v_gazetteer"),
        F.when(context.rlike(CONTEXT[kind]), 1).when(context.rlike(AGAINST), 0).otherwise(-1).alias("v_context"),
        F.pmod(F.xxhash64(shape), F.lit(SHAPES)).cast("int").alias("shape"),
    )


def _candidate(kind: str, base: bool, p: str, m: str, b: str) -> Callable[[Column], Column]:
    worth = lambda x: F.length(x[m]) >= LEAST_CARD if kind == "card" else F.lit(True)
    return lambda x: F.when(worth(x), _span(kind, base, x[p], x[m], x[b]))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and spans: all candidates of a text, by kind, then start.

    Each step's arrays are columns of their own, so none is computed again for every match; the time
    grows with the text and its matches. Texts are split only where a pattern matches.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), text.rlike("[0-9]").alias("digits"))
    labelers = [(kind, base, (BASE if base else WIDER)[kind]) for kind in KINDS for base in (True, False)]
    none = lambda kind: F.array().cast(f"array<{kind}>")
    matches, pieces, lengths, before, spans = {}, {}, {}, {}, {}
    for k, (kind, base, pattern) in enumerate(labelers):
        m, p, n, b = f"m{k}", f"p{k}", f"n{k}", f"b{k}"
        if base:
            has = F.contains("text", F.lit(NEEDS[kind])) if kind in NEEDS else F.col("digits")
        else:
            has = F.col("text").rlike(NEEDS_WIDER[kind]) if kind == "email" else F.col("digits") & F.col("text").rlike(NEEDS_WIDER[kind])
        matches[m] = F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none("string"))
        pieces[p] = F.when(F.size(m) > 0, F.slice(F.split("text", pattern, -1), F.lit(1), F.size(m))).otherwise(none("string"))
        lengths[n] = F.zip_with(p, m, lambda x, y: F.length(x) + F.length(y))
        before[b] = F.when(F.size(m) > 0, _running(F.col(n))).otherwise(none("int"))
        spans[f"s{k}"] = F.filter(F.transform(F.arrays_zip(p, m, b), _candidate(kind, base, p, m, b)), lambda x: x.isNotNull())
    rows = rows.withColumns(matches).withColumns(pieces).withColumns(lengths).withColumns(before).withColumns(spans)
    return rows.select("doc_id", "text_hash", F.concat(*spans).alias("spans"))


@dataclass
class Classifier:
    """Logistic weights for each kind: bias, each vote's for and against, and the shapes'."""

    weights: dict[str, list[float]]

    def score(self, span: Column) -> Column:
        out = F.lit(0.0)
        for kind, w in self.weights.items():
            z = F.lit(w[0]) + F.element_at(F.array(*map(F.lit, w[1 + 2 * len(VOTES) :])), span["shape"] + 1)
            for k, vote in enumerate(VOTES):
                z = z + F.when(span[vote] == 1, F.lit(w[1 + 2 * k])).when(span[vote] == 0, F.lit(w[2 + 2 * k])).otherwise(F.lit(0.0))
            out = F.when(span["kind"] == kind, 1 / (1 + F.exp(-z))).otherwise(out)
        return out


def _em(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[list[float], dict[tuple[int, ...], float]]:
    """Reliabilities of the labelers of one kind and the posterior of each pattern of votes.

    Dawid-Skene with two classes: how often each labeler says yes to true and to false spans, given
    that it votes. It starts from the vote of the majority, with a weak prior on the labelers being
    better than chance, and runs on pattern counts: at most 3^labelers rows.
    """
    posterior = {v: (1 + sum(x == 1 for x in v)) / (2 + sum(x >= 0 for x in v)) for v, _ in patterns}
    rates: list[float] = []
    for _ in range(ROUNDS):
        yes = 1.0 + sum(n * posterior[v] for v, n in patterns)
        no = 1.0 + sum(n * (1 - posterior[v]) for v, n in patterns)
        rates = []
        for k in range(len(VOTES)):
            for side in (1, 0):
                mass = [(n * (posterior[v] if side else 1 - posterior[v]), v[k]) for v, n in patterns if v[k] >= 0]
                prior = 4.0 if side else 1.0
                rates.append((prior + sum(m for m, x in mass if x == 1)) / (5.0 + sum(m for m, _ in mass)))
        for v, _ in patterns:
            log_odds = math.log(yes / no)
            for k, x in enumerate(v):
                if x >= 0:
                    a, b = rates[2 * k], rates[2 * k + 1]
                    log_odds += math.log(a / b) if x else math.log((1 - a) / (1 - b))
            posterior[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log_odds))))
    return rates, posterior


def train(counts: list[Row]) -> Classifier:
    """Fit on counts of votes and shapes over all candidates: EM on the votes gives soft labels, on which a
    logistic span classifier learns what votes and shape say.

    A kind without candidates gets a bias that admits nothing.
    """
    weights = {}
    first_shape = 1 + 2 * len(VOTES)
    for kind in KINDS:
        rows = [(tuple(r[v] for v in VOTES), r["shape"], r["n"]) for r in counts if r["kind"] == kind]
        w = [0.0] * (first_shape + SHAPES)
        if not rows:
            weights[kind] = [-30.0] + w[1:]
            continue
        patterns: dict[tuple[int, ...], int] = {}
        for v, _, n in rows:
            patterns[v] = patterns.get(v, 0) + n
        _, posterior = _em(list(patterns.items()))
        total = sum(n for *_, n in rows)
        cases = [([0, *[1 + 2 * k if x == 1 else 2 + 2 * k for k, x in enumerate(v) if x >= 0], first_shape + shape], posterior[v], n / total) for v, shape, n in rows]
        for _ in range(STEPS):
            gradient = [1e-4 * a for a in w]
            for x, label, share in cases:
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in x)))))
                for i in x:
                    gradient[i] += (p - label) * share
            w = [a - 2.0 * g for a, g in zip(w, gradient, strict=True)]
        weights[kind] = w
    return Classifier(weights)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base and spans (arrays of kind, start, end by kind as listed, then start).

    Labelers (strict pattern; check sum, range or length; gazetteer; words before) vote on every
    candidate of every text or abstain. The counts of votes and shapes, at most 3^4 x SHAPES rows a kind,
    are all that comes to the driver: EM estimates the labelers' reliabilities from them and a logistic
    classifier of votes and shape is fitted to its soft labels. Base spans always stay; other spellings
    are added if they pass their checks, the classifier is sure and they overlap no base span.
    Candidates are written once; the texts are read once.

    Cases: null and empty texts have no spans; repeated rows get the same spans; equal starts do not
    occur within a kind; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.save("candidates", candidates(docs))
    # bounded by the number of patterns and shapes, whatever the texts are
    counts = rows.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.shape", *[f"s.{v}" for v in VOTES]).agg(F.count("*").alias("n")).collect()
    model = train(counts)
    base = F.filter("spans", lambda s: s["base"])
    rows = rows.withColumn("base", base)
    sure = F.filter("spans", lambda s: ~s["base"] & (model.score(s) >= ADD_FROM) & (s["v_valid"] == 1) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    order = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    ranked = F.array_sort(F.transform(F.concat(F.col("base"), sure), lambda s: F.struct(order[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    slim = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("doc_id", "text_hash", slim("base").alias("base"), slim(ranked).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns of find_spans."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in KINDS]
    return spans.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


#: Code points of a piece of text in which spans are replaced, so that no span looks at the whole text.
PIECE = 2_048


def _reach(ends: Column) -> Column:
    """For each of an array's values the largest of those before it, 0 for the first; as _running, by blocks."""

    def before(values: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list"))
        return F.aggregate(values, none, lambda a, x: F.struct(F.greatest(a["at"], x).alias("at"), F.concat(a["list"], F.array(a["at"])).alias("list")))["list"]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ends) - 1) / BLOCK).cast("int")), lambda b: F.slice(ends, b * BLOCK + 1, F.lit(BLOCK)))
    return F.flatten(F.zip_with(blocks, before(F.transform(blocks, F.array_max)), lambda b, at: F.transform(before(b), lambda x: F.greatest(x, at))))


def _first_from(spans: Column, place: Column) -> Column:
    """How many of the spans, ordered by start, start before a place: by halving."""
    bounds = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def halve(b: Column, _: Column) -> Column:
        middle = F.floor((b["low"] + b["high"]) / 2).cast("int")
        before = (b["low"] < b["high"]) & (F.get(spans, middle)["start"] < place)
        return F.struct(F.when(before, middle + 1).otherwise(b["low"]).alias("low"), F.when(before | (b["low"] >= b["high"]), b["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int")), bounds, halve)["low"]


def replace_spans(rows: DataFrame, text: str, spans: str) -> DataFrame:
    """`text` with each of `spans` (an array of start, end, kind; null: none) replaced by its kind in angle brackets.

    Overlapping spans are one, named after the first. The text is cut to pieces once and each span is replaced in the
    pieces that it touches, so the time grows with text and spans, not with their product. Columns named __* are used.
    """
    heads = F.filter(F.zip_with("__sorted", "__reach", lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), r.alias("reach"))), lambda s: s["start"] >= s["reach"])
    merged = F.transform("__heads", lambda h, k: F.struct(h["start"].alias("start"), F.coalesce(F.get("__heads", k + 1)["reach"], F.array_max("__ends")).alias("end"), h["kind"].alias("kind")))
    some = F.size(F.coalesce(spans, F.array())) > 0

    def piece(part: Column, number: Column) -> Column:
        base = number * PIECE
        low, high = F.get("__first", number), F.get("__first", number + 1)
        reached = F.when(low > 0, F.greatest(F.get("__merged", low - 1)["end"] - base, F.lit(0))).otherwise(F.lit(0))
        start = F.struct(reached.alias("at"), F.lit("").alias("out"))

        def put(a: Column, s: Column) -> Column:
            fresh = F.concat(a["out"], F.substring(part, a["at"] + 1, s["start"] - base - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
            return F.struct((s["end"] - base).alias("at"), fresh.alias("out"))

        return F.aggregate(F.slice("__merged", low + 1, high - low), start, put, lambda a: F.concat(a["out"], F.substring(part, a["at"] + 1, F.lit(PIECE))))

    steps = [
        ("__sorted", F.when(some, F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))),
        ("__ends", F.transform("__sorted", lambda s: s["end"])),
        ("__reach", _reach(F.col("__ends"))),
        ("__heads", heads),
        ("__merged", merged),
        ("__parts", F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))),
        ("__first", F.transform(F.sequence(F.lit(0), F.size("__parts")), lambda n: _first_from(F.col("__merged"), n * PIECE))),
        (text, F.when(some, F.array_join(F.transform("__parts", piece), "")).otherwise(F.col(text))),
    ]
    for name, column in steps:
        rows = rows.withColumn(name, column)
    return rows.drop(*[name for name, _ in steps[:-1]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span's text replaced by its kind in angle brackets; all columns, n_chars kept in step.

    Overlapping spans are replaced as one, named after the first. Spans join back by doc_id and text.

    Cases: null texts stay null and empty ones empty; repeated rows are masked alike; other columns stay
    as they are, whatever their names; no rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found_spans = find_spans(docs).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    found_spans = found_spans.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    joined = docs.join(found_spans, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left")
    out = replace_spans(joined, "text", "__spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
