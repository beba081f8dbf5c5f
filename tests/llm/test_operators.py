"""Each operator against brute force on small tables with awkward rows."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lakeloom.llm import common, decontamination, language_model, neighbours, packing, pii, repeats, sharding, simhash, token_counts, toxicity
from lakeloom.llm.registry import tokenizer_path

LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(9000))
PASSAGE = " ".join(f"passage{i}" for i in range(80))
TEXTS = [None, "", "   ", "one", "Hello world. " * 3, "a" * 900, LONG, LONG, PASSAGE, "before " + PASSAGE + " after", "prefix words here " + PASSAGE, "ünï cödé ñandú " * 40, "ab" * 500]
SCHEMA = "doc_id long, text string, score string, text_hash string, size int, anchor int"


@pytest.fixture(scope="module")
def rows():
    out = [(i, t) for i, t in enumerate(TEXTS)]
    return [*out, (6, LONG), (6, LONG), (None, PASSAGE), (None, None), (3, "another text of the same id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves, and null in any column."""
    return spark.createDataFrame([(d, t, None, "x", None, 1) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table_of(frame, *columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


# 1

def cut_by_force(rows):
    texts = [(t or "").encode() for _, t in rows]

    def covered(n):
        seen = Counter(b[s : s + n] for b in texts for s in range(len(b) - n + 1))
        for b in texts:
            gone = bytearray(len(b))
            for s in range(len(b) - n + 1):
                if seen[b[s : s + n]] > 1:
                    gone[s : s + n] = b"\1" * n
            yield gone

    out = Counter()
    for (doc_id, _), b, gone, short in zip(rows, texts, covered(repeats.LENGTH), covered(repeats.SHORT)):
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        runs = [m.span() for m in re.finditer(b"\1+", bytes(short))]
        out[doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), sum(short), sum(len(b[x:y].split()) > repeats.WORDS for x, y in runs)] += 1
    return out


CUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "n_passages")


@pytest.mark.parametrize("group, hot", [(1000, 1000), (1, 1000), (3, 10)])
def test_repeats(docs, rows, monkeypatch, group, hot):
    """Also with every anchor of several surroundings split by further bytes, and with keys joined by broadcast."""
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    assert table_of(repeats.remove_repeats(docs), *CUT) == cut_by_force(rows)


@pytest.mark.parametrize("group, hot", [(1000, 1000), (4, 20)])
def test_repeats_of_near_copies(spark, monkeypatch, group, hot):
    """A passage in many surroundings, copies with a changed letter, parts of it, and periodic texts."""
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("".join(rng.choice(list("abcdef"), rng.integers(2, 8))) for _ in range(n))
    passage, short, line = words(200), words(70), words(45) + " "
    texts = []
    for k in range(48):
        changed = list(passage)
        changed[rng.integers(len(changed))] = "Z"
        texts.append([words(30) + " " + passage + " " + words(30), words(20) + " " + passage[: rng.integers(250, 900)] + words(10), words(10) + short + words(10), "".join(changed), line * int(rng.integers(1, 5)) + words(5), "ab" * int(rng.integers(0, 400))][k % 6])
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert table_of(repeats.remove_repeats(frame), *CUT) == cut_by_force(rows)


def test_repeats_empty(empty):
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("length", [repeats.SHORT, repeats.LENGTH])
def test_runs_serve_every_occurrence(length):
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = [rng.integers(97, 99, 400, dtype=np.uint8).tobytes() for _ in range(2)]
        lefts = [base[i % 2][: 208 - k * 20] for i, k in enumerate(rng.integers(0, 9, 12))]
        rights = [base[(i // 2) % 2][: 400 - k] + bytes([i]) for i, k in enumerate(rng.integers(0, 300, 12))]
        got = [repeats.windows_of(p, length, -1000, 1000) for p in repeats.shared_strings(lefts, rights, repeats.SHORT)]
        for i in range(12):
            want = set()
            for j in range(12):
                if i != j:
                    left = next((n for n in range(min(len(lefts[i]), len(lefts[j]))) if lefts[i][::-1][n] != lefts[j][::-1][n]), min(len(lefts[i]), len(lefts[j])))
                    want |= set(range(length - repeats.common(rights[i], rights[j]), left + 1))
            assert {d for lo, hi in got[i] for d in range(lo, hi + 1)} == want


# 2

def test_language_model(docs, rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts, ends = Counter(), 0
    for d, t in rows:
        if not held(d):
            counts.update((t or "").encode().lower().split())
            ends += 1
    n, v = counts.total() + ends, len(counts) + 1
    want = Counter()
    for d, t in rows:
        words = (t or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        want[d, held(d), len(words) + 1, sum(w in counts for w in words) + 1, n, round(base, 4)] += 1
    found = language_model.score_texts(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def test_language_model_is_normalised():
    rng = np.random.default_rng(0)
    context, cls, n = rng.integers(0, 2 * 5, 200), rng.integers(0, 7, 200), rng.integers(1, 9, 200).astype(float)
    table = language_model.train_nce(context, cls, n, 2, 5, 7)
    assert np.allclose((10**table).sum(1), 1)


def test_language_model_beats_unigrams(spark, sf):
    got = language_model.score_texts(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_language_model_empty(empty):
    assert language_model.score_texts(empty).count() == 0


def test_language_model_states_cover_all_texts(spark):
    """A kind of text that comes late in the order of hashes is among the states' texts, past the first thousands."""
    from pyspark.sql import functions as F

    text = lambda t: F.lit(t).cast("binary").alias("text")
    plain = spark.range(5000).select(F.col("id").alias("doc_id"), text("alpha beta"))
    rare = spark.range(10000, 14000).select(F.col("id").alias("doc_id"), text("gamma gamma"))
    hashed = lambda d: d.withColumn("text_hash", F.xxhash64("text"))
    rare = hashed(rare).orderBy(F.xxhash64("doc_id", "text_hash").desc()).limit(100)
    rows = hashed(plain).unionByName(rare)
    model = language_model.train(rows, language_model.word_counts(rows))
    assert np.exp(model.evidence[1 + model.own.index(b"gamma")].max()) > 0.005


def test_language_model_learns_from_rare_pairs():
    """A pair that some millions of draws would miss moves its context's table."""
    context, cls, n = np.array([0, 0, 1]), np.array([1, 2, 3]), np.array([1e9, 1e9, 20.0])
    table = language_model.train_nce(context, cls, n, 1, 2, 4)
    assert table[1, 3] > table[0, 3] + 1


def test_language_model_scores(docs, rows):
    """Scores are the product of each class's probability, given the class before and the state so far, and the word's share in it."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    training = common.raw(docs).where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")
    model = language_model.train(training, language_model.word_counts(training))
    classes = language_model.Classes(model.own)
    counts = Counter(w for d, t in rows if not held(d) for w in (t or "").encode().lower().split())
    mass = Counter()
    for w, c in counts.items():
        mass[classes[w]] += c + 0.5
    want = Counter()
    for d, t in rows:
        words = (t or "").encode().lower().split()
        total, before, seen = 0.0, 0, np.array(model.evidence[0], dtype=float)
        for w in [*words, None]:
            at = 0 if w is None else classes[w]
            state = int(np.argmax(seen))
            total += float(model.table[state * (language_model.OWN_CONTEXT + 41) + model.context_of[before], at])
            if w is not None:
                total += math.log10((counts[w] + 0.5) / (mass[at] + 0.5 if at >= classes.first_tail else max(1.0, mass[at])))
                seen = seen + model.evidence[at]
            before = at
        want[d, len(words) + 1, round(total, 2)] += 1
    found = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 2)) for r in language_model.score_texts(docs).collect())
    near = lambda a, b: a[:2] == b[:2] and abs(a[2] - b[2]) <= 0.02 + 1e-6 * abs(a[2])
    assert all(any(near(a, b) and n == m for b, m in want.items()) for a, n in found.items()) and found.total() == want.total()


def test_held_words_are_the_commonest(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HELD_WORDS", 3)
    monkeypatch.setattr(language_model, "OWN_CLASS", 1)
    counts = spark.createDataFrame([(b"a", 9), (b"b", 5), (b"c", 2), (b"d", 2), (b"e", 1)], "word binary, c long")
    assert language_model.held_words(counts) == {b"a": 9, b"b": 5}
    assert language_model.held_words(counts.where("c < 3")) == {b"c": 2, b"d": 2, b"e": 1}
    assert language_model.held_words(counts.limit(0)) == {}


# 3

def test_neighbours_of_several_dimensions(spark):
    """Vectors are compared with those of their own length, none is dropped; other columns don't matter."""
    rows = [(i, [float(i + 1), 1.0], None) for i in range(45)] + [(100 + i, [1.0, float(i), 2.0], "x") for i in range(30)] + [(200, [4.0], "y")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    found = {}
    for r in neighbours.nearest(frame).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == [0, 20, 40, 100, 120]
    for q, got in found.items():
        mine = next(v for i, v, _ in rows if i == q)
        want = sorted((-sum(x * y for x, y in zip(v, mine)), i) for i, v, _ in rows if i != q and len(v) == len(mine))[:20]
        assert [i for _, i, _ in sorted(got)] == [i for _, i in want]


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    v[200:260] = v[0]
    bad = [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0]), (5005, [])]
    rows = [(int(i), [float(x) for x in np.float32(r)]) for i, r in enumerate(v)] + [(5000, [1.0] * 16)] + bad + [(7, [float(x) for x in np.float32(v[7])])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ids = np.array([i for i, e in rows[:1501]])
    m = np.array([e for _, e in rows[:1501]])
    found = {}
    for r in neighbours.nearest(frame).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    asked = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(found) == asked
    for q in asked:
        at = int(np.flatnonzero(ids == q)[0])
        s = m @ m[at]
        want = [int(ids[k]) for k in np.lexsort((ids, -s)) if k != at][:20]
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(s[int(np.flatnonzero(ids == i)[0])] - x) < 1e-9 for _, i, x in got)
        hit, total = hit + len(set(want) & {i for _, i, _ in got}), total + 20
    assert hit / total >= 0.9
    copies = [i for _, i, _ in sorted(found[0])]
    top = [i for i in copies if 200 <= i < 260]
    assert top == sorted(top)


def test_neighbours_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert table_of(neighbours.nearest(few), "query_id", "rank", "vec_id") == Counter({(0, 1, 1): 1, (0, 2, 20): 1, (20, 1, 1): 1, (20, 2, 0): 1})
    assert neighbours.nearest(few.limit(0)).count() == 0


@pytest.mark.parametrize("spread", ["one", "all"])
def test_neighbours_of_unlike_lengths(spark, spread):
    """The graph is walked, not only the sample of a band."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(2000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if spread == "one":
        v[5] *= 200
    else:
        v *= 100 ** rng.uniform(0, 1, (2000, 1))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(frame).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 2000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / 2000 >= 0.9


def test_neighbours_whatever_the_partitions(spark):
    """Few distinct vectors, some with copies: all are returned, though they are fewer than the partitions."""
    rows = [(i, [float(i % 6 + 1), float(i % 5), 1.0]) for i in range(20)] + [(20 + i, [1.0, 0.0, 1.0]) for i in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = neighbours.nearest(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for q in (0, 20):
        want = sorted(((-sum(x * y for x, y in zip(v, rows[q][1], strict=True)), i) for i, v in rows if i != q))[:20]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in want]


# 4

PII_TEXTS = [
    "mail a.b@c.de, x@y.z_d@e.f and no@dot", "1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 0255.1.1.1", "card 4111 1111 1111 1111 and 4111111111111112, 1234567890123", "+1 (555) 123-4567 +49 30 1234567. +12 +1234567890123456",
    "9" * 20000, "a" * 20000, "ü@x.de ñ+33 1 22 33 44 55!", "call (555) 123-4567 or write bob (at) site (dot) org", None, "",
]


def spans_by_force(text):
    text = text or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))] if "." in text else []

    def luhn(digits):
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_pii(spark):
    frame = spark.createDataFrame([(i, t, None) for i, t in enumerate(PII_TEXTS)], "doc_id long, text string, base string")
    for r in pii.digest(pii.find_spans(frame)).collect():
        base = spans_by_force(PII_TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",") if r["spans"] else [])
        assert r["n_email"] == sum(b.startswith("email") for b in base) and r["n_card"] == sum(b.startswith("card") for b in base)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert masked[0].startswith("mail <EMAIL>, <EMAIL>_d@e.f") or "<EMAIL>" in masked[0]
    assert masked[4] == PII_TEXTS[4] and masked[8] is None and len(masked) == len(PII_TEXTS)
    assert pii.digest(pii.find_spans(frame.limit(0))).count() == 0


def test_pii_of_many_matches(spark):
    """A log of 100,000 short lines, and 20,000 cards, take seconds."""
    frame = spark.createDataFrame([(1, "12\n" * 100_000 + "a@b.com " * 2_000), (2, "4111 1111 1111 1111," * 20_000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.digest(pii.find_spans(frame)).collect()}
    assert time.perf_counter() - began < 60
    assert got[1]["n_email"] == 2_000 and got[2]["n_card"] == 20_000
    assert got[2]["spans"].endswith(f"card:{19_999 * 20}:{19_999 * 20 + 19}")


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        frame = spark.range(1).selectExpr(f"transform(sequence(1, {n}), x -> cast(x % 7 as int)) as n" if n else "cast(array() as array<int>) as n")
        got = frame.select(pii._running(frame["n"]).alias("r")).first()["r"] if n else []
        assert got == [sum((k + 1) % 7 for k in range(i)) for i in range(n)]


def labelled_texts():
    """Texts with the personal data in them, in base and other spellings, and look-alikes that are none."""
    rng = np.random.default_rng(2)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card(sign):
        body = "4" + digits(14)
        total = sum(d - 9 * (d > 9) for d in (int(c) * (2 - i % 2) for i, c in enumerate(body)))
        whole = body + str(-total % 10)
        return sign.join(whole[k : k + 4] for k in range(0, 16, 4))

    for k in range(40):
        yield f"write to ann{k}@site{k}.org please", [f"ann{k}@site{k}.org"]
        yield f"mail bob{k} (at) place{k} (dot) com now", [f"bob{k} (at) place{k} (dot) com"]
        yield f"client from 2001:0db8:{k:04x}:0000:0000:8a2e:0370:7334 seen", [f"2001:0db8:{k:04x}:0000:0000:8a2e:0370:7334"]
        yield f"host 10.0.{k}.1 up", [f"10.0.{k}.1"]
        yield f"visa {(c := card('.'))} paid", [c]
        yield f"card {(c := card(' '))} paid", [c]
        yield f"call 212-555-{1000 + k} today", [f"212-555-{1000 + k}"]
        yield f"phone +1 212 555 {1000 + k} today", [f"+1 212 555 {1000 + k}"]
        yield f"order 123-456-{1000 + k} and version 1.2.{k}", []
        yield f"sums {k:04d}.1111.1111.1113 and 300.1.1.{k}", []
        yield f"times 12:34:56:12:34:56:12:{k:02d}", []


def test_added_spans_raise_recall(spark):
    """The classifier learns without labels; these are for judging it."""
    cases = list(labelled_texts())
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_spans(frame).collect()}
    texts = lambda i, c: [cases[i][0][s["start"] : s["end"]] for s in found[i][c]]
    there = sum(len(w) for _, w in cases)
    base, all_ = ([x for i in range(len(cases)) for x in texts(i, c) if x in cases[i][1]] for c in ("base", "spans"))
    wrong = [x for i in range(len(cases)) for x in texts(i, "spans") if x not in cases[i][1]]
    assert len(base) == there // 2 and len(all_) >= 0.9 * there and len(wrong) <= 0.02 * there
    masked = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert masked[2] == "client from <IP> seen" and masked[1] == "mail <EMAIL> now"


# 5

def overlap_by_force(text, item):
    """Most words of an item that a text holds along some diagonal, if a stretch of 15 (the item if shorter) matches in 80 %; up to five words must be there whole."""
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    a, b = split(text), split(item)
    window = min(len(b), decontamination.PASSAGE_WORDS)
    need = len(b) if len(b) <= 5 else math.ceil(window * decontamination.SIMILARITY)
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        flags = [0 <= shift + j < len(a) and a[shift + j] == w for j, w in enumerate(b)]
        if any(sum(flags[s : s + window]) >= need for s in range(len(b) - window + 1)):
            best = max(best, sum(flags))
    return best


@pytest.mark.parametrize("most", [decontamination.BROADCAST_SEEDS, 1])
def test_decontamination_by_force(spark, monkeypatch, most):
    """Items of 1 to 30 words, in texts with words exchanged; a small vocabulary makes chance overlaps."""
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", most)
    rng = np.random.default_rng(6)
    words = lambda n: [f"v{k}" for k in rng.integers(0, 60, n)]
    items = [(k, " ".join(words(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 6, 7, 7, 8, 9, 10, 10, 11, 12, 14, 15, 18, 30, 30])]
    texts = []
    for k in range(120):
        part = items[int(rng.integers(len(items)))][1].split()
        for _ in range(int(rng.integers(0, 4))):
            part[int(rng.integers(len(part)))] = "other"
        texts.append((k, " ".join([*words(int(rng.integers(0, 6))), *part, *words(int(rng.integers(0, 6)))])))
    want = {(d, i): n for d, t in texts for i, item in items if (n := overlap_by_force(t, item))}
    got = decontamination.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want) and len(got) == len(want)


def test_decontamination(spark):
    words = [f"term{i}" for i in range(40)]
    item = " ".join(words)
    swapped = " ".join(w if i % 5 else "other" for i, w in enumerate(words))
    rows = [(1, f"lead in {item} and out"), (2, swapped), (3, " ".join(words[:5]) + " nothing else of it"), (4, None), (5, ""), (6, item.upper().replace(" ", ", ")), (6, item.upper().replace(" ", ", ")), (None, item), (7, " ".join(words[10:26])), (8, "x " * 5000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(0, item), (1, None), (2, "a b"), (3, "nothing else of it"), (0, item)], "item_id long, text string")
    want = Counter({(1, 0): 1, (2, 0): 1, (6, 0): 1, (None, 0): 1, (7, 0): 1, (3, 3): 1})
    assert table_of(decontamination.contaminated(docs, bench), "doc_id", "item_id") == want
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()) == [4, 5, 8]
    assert decontamination.contaminated(docs.limit(0), bench).count() == decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_beyond_broadcast(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    near = table_of(decontamination.contaminated(docs, bench), "doc_id", "item_id", "matched_words")
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 1)
    assert table_of(decontamination.contaminated(docs, bench), "doc_id", "item_id", "matched_words") == near and near


def test_decontamination_of_items_alike_in_id(spark, monkeypatch):
    """Null ids and several texts under one id: each text is verified, with and without broadcast."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    docs = spark.createDataFrame([(1, f"x {a}"), (2, f"y {b}"), (3, f"z {c}"), (4, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, a), (7, b), (7, c)], "item_id long, text string")
    want = Counter({(1, None, 30): 1, (2, 7, 30): 1, (3, 7, 30): 1})
    for most in (decontamination.BROADCAST_SEEDS, 1):
        monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", most)
        assert table_of(decontamination.contaminated(docs, bench), "doc_id", "item_id", "matched_words") == want
        assert [r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()] == [4]


# 6

def test_token_counts(docs, rows):
    scores = token_counts.piece_scores(tokenizer_path("piece_bpe_32k.model"))

    def pieces(word):
        best = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            n = len(word[d - 1].encode())
            options = [(best[d - 1][0] + token_counts.BYTE_SCORE * n, best[d - 1][1] - n)]
            options += [(best[s][0] + scores[word[s:d]], best[s][1] - 1) for s in range(d) if word[s:d] in scores]
            best.append(max(options))
        return -best[-1][1]

    known = {}
    want = Counter()
    for d, t in rows:
        words = (t or "").encode().split()
        want[d, len((t or "").encode()), len(words), sum(known.setdefault(w, pieces(token_counts.MARK + w.decode())) for w in words)] += 1
    assert table_of(token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")), "doc_id", "n_bytes", "n_words", "n_tokens") == want


def test_token_counts_empty(empty):
    assert token_counts.count_tokens(empty, tokenizer_path("piece_bpe_32k.model")).count() == 0


# 7

def test_encoder_is_the_tokenizer(rows):
    from tokenizers import Tokenizer

    plain, ours = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    assert ours.fast is not None
    for t in [t for _, t in rows if t is not None] + ["two  spaces", "line \n end ", " x", "it's <|endoftext|> here", "日本語 text"]:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing(docs, rows):
    encoder = packing.Encoder(tokenizer_path())
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(np.frombuffer(encoder.encode(t or ""), "<u4").tolist() + [0])
    found = packing.pack_documents(docs, tokenizer_path()).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        want = Counter()
        for ids in texts[d]:
            want.update({(len(ids), k): 1 for k in range(len(ids))})
        got = Counter((r["doc_tokens"], k) for r in pieces for k in range(r["start"], r["start"] + r["length"]))
        assert got == want
        assert all(any(len(ids) == r["doc_tokens"] and zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for ids in texts[d]) for r in pieces)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(60):
        places = [0, *np.cumsum(rng.integers(1, 7, 14)).tolist()]
        costs = [0, *rng.choice([0, 3, 8], 14).tolist()]
        window = 16

        def cost(i, j):
            n = places[j] - places[i]
            if n > window:
                return math.inf
            power = n in (4, 8, 16) and (n == 16 or not costs[j])
            return (0 if power else window - n) + costs[j]

        best = [0.0]
        for j in range(1, 15):
            best.append(min(best[i] + cost(i, j) for i in range(j)))
        cuts = packing.plan_cuts(places, costs, window)
        assert sum(cost(i, j) for i, j in zip([0, *cuts], cuts)) == best[-1]


def test_packing_empty(empty):
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


# 8

def test_toxicity(spark, docs, rows, empty):
    made = [(i, ("you are scum " if i % 4 == 0 else "you are fine ") + f"word{i} text{i % 7}", "l", i) for i in range(400)]
    train_docs = spark.createDataFrame(made, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(train_docs, labels).collect()
    assert len(got) == 400 and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    model = toxicity.train(train_docs, labels)
    assert toxicity.score_documents(docs, model).count() == len(rows)
    kept = toxicity.keep_clean(train_docs, model)
    assert kept.columns == train_docs.columns and kept.count() == 300
    assert toxicity.toxicity(empty, labels).count() == 0
    blank = {r["score"] for r in toxicity.score_documents(docs, model).where("doc_id in (0, 1, 2)").collect()}
    assert len(blank) == 1


def test_weights_are_ftrl():
    """The weights of each coordinate, recomputed one by one as published."""
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 50, 8)).astype(np.uint32), int(rng.integers(0, 2))) for _ in range(200)]
    z, n, bias, bias_n = Counter(), Counter(), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, y in rows:
            w = {int(i): weight(int(i)) for i in x}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for i, v in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * v
                n[i] += g * g
            bias_n += g * g
            bias -= toxicity.ALPHA / (toxicity.BETA + math.sqrt(bias_n)) * g
    model = toxicity.fit(rows)
    want = {i: weight(i) for i in range(50) if weight(i)}
    assert model.index.tolist() == sorted(want) and np.allclose(model.weight, [want[i] for i in sorted(want)], rtol=1e-5)
    assert abs(model.bias - bias) < 1e-9


# 9

def print_by_force(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_force(prints):
    at = list(range(len(prints)))

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = sorted((top(i), top(j)))
                at[b] = a
    return [top(i) for i in range(len(prints))]


def test_near_duplicates(docs, rows):
    prints = [print_by_force(t) for _, t in rows]
    groups = components_by_force(prints)
    least = {}
    for (d, _), g in zip(rows, groups):
        least[g] = min((x for x in (d, least.get(g)) if x is not None), default=None)
    want = Counter((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, groups))
    assert table_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(groups))


def test_the_row_kept_of_repeated_ones_is_always_the_same(spark):
    rows = [(1, "same text of it", c, {"k": c}) for c in "cab"]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_one(spark.createDataFrame(order, "doc_id long, text string, root string, props map<string,string>").repartition(3)).collect()
        assert [r["root"] for r in kept] == ["a"]


@pytest.mark.parametrize("paired", [256, 2])
def test_links_connect_all_within_reach(spark, monkeypatch, paired):
    """Balls of halves, and whole balls where groups are large, give the same components as comparing all."""
    from lakeloom.llm.components import components
    from lakeloom.session import Scratch

    monkeypatch.setattr(simhash, "PAIRED_UPTO", paired)
    rng = np.random.default_rng(9)
    prints = set()
    for centre in rng.integers(0, 2**63, 12).tolist():
        for _ in range(12):
            prints.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.link_fingerprints(frame, Scratch(spark, "t")), Scratch(spark, "t")).collect()}
    groups = components_by_force(prints)
    ours = [found.get(p, p) for p in signed]
    assert len(set(zip(ours, groups))) == len(set(ours)) == len(set(groups))


def test_near_duplicates_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


# 10

def test_shards(docs, rows):
    found = sharding.assign_shards(docs, 4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even(spark, sf):
    found = sharding.assign_shards(spark.read.parquet(f"{sf}/documents.parquet"), 4)
    sizes = [r[1] for r in found.groupBy("shard").agg({"size": "sum"}).collect()]
    largest = found.agg({"size": "max"}).first()[0]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2 * largest
    order = [r["shard"] for r in found.orderBy("doc_id").collect()]
    assert order == sorted(order)


def test_shards_are_written_as_assigned(spark, tmp_path):
    """Repeated rows that lie across cuts, columns named like the operator's, null texts and ids."""
    rows = [(5, "same words " * 4, k, 7) for k in range(40)] + [(k, f"text {k} " * (k % 5), k, None) for k in range(30)] + [(None, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, text_crc32 int").repartition(4)
    assigned = sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert table_of(back, *docs.columns) == table_of(docs, *docs.columns)
    texts = Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode()), r["shard_"]) for r in back.collect())
    assert texts == table_of(assigned, "doc_id", "text_crc32", "shard")


def test_shards_empty(empty):
    assert sharding.assign_shards(empty).count() == 0


# the pipeline

def test_pipeline(spark, sf):
    import corpus_pipeline
    from lakeloom.llm.common import table

    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    left = docs.toPandas()
    assert decontamination.contaminated(docs, table(spark, sf, "benchmark")).count() == 0
    assert not any(spans_by_force(t) for t in left["text"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(packed["doc_id"]) == set(left["doc_id"])
