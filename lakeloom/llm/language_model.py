"""A log-bilinear language model, trained by noise-contrastive estimation on counts of the whole corpus."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_map, batch, raw, remainder
from lakeloom.session import Scratch

FOLDS, HELD_OUT = 5, 1
#: Words with a class of their own; words whose counts every task holds (some 10 MB); bounds, whatever the corpus.
OWN_CLASS, HELD_WORDS = 1_000, 100_000
#: Of those with a class of their own, so many are told apart as the word before.
OWN_CONTEXT = 200
#: Classes of the other words, by their last letters; states of the text so far.
TAIL_CLASSES, STATES = 200, 8
#: Passes over all training texts that find the states, and texts whose class counts are laid out at once.
STATE_ROUNDS, STATE_CHUNK = 15, 1_000
#: Each step takes the counts of all pairs, and all noise by its expectation.
DIMENSION, NOISE, STEPS, RATE = 24, 20, 300, 0.05
COUNTED_WORDS = 300_000
END = 0  # class of the end of a text

_STRIP = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))


def tail_class(word: bytes) -> int:
    """Class, from 0, of a word without one of its own: by the kind of its last byte and its last letters."""
    letters = word.rstrip(_STRIP)
    kind = 0 if len(letters) == len(word) else 1 + word[-1] % 7
    value = 5381
    for c in letters[-2:]:
        value = value * 33 + c
    return (value * 8 + kind) * 2654435761 % (1 << 32) * TAIL_CLASSES >> 32


class Classes(dict):
    """Class of each word: END, own classes from 1, then the tail's; new words are kept."""

    def __init__(self, own: list[bytes]):
        super().__init__((w, k + 1) for k, w in enumerate(own))
        self.first_tail = len(own) + 1
        self.size = self.first_tail + TAIL_CLASSES
        self.own = dict(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) > COUNTED_WORDS:
            self.clear()
            self.update(self.own)
            if word in self:
                return self[word]
        value = self[word] = self.first_tail + tail_class(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


class Index(dict):
    """Number of each word: those with known counts first, then new ones as they are met, as many as COUNTED_WORDS or
    one text needs. By number: `cls`, a word's class, `log`, log10 of its count (0 for new ones), and `names` of new ones."""

    def __init__(self, held: dict[bytes, int], classes: Classes):
        super().__init__((w, k) for k, w in enumerate(held))
        self.held, self.many, self.names, self.classes = held, len(held), [], classes
        room = self.many + COUNTED_WORDS
        self.cls, self.log = np.zeros(room, dtype=np.int32), np.zeros(room)
        self.cls[: self.many] = [classes[w] for w in held]
        self.log[: self.many] = np.log10(np.fromiter(held.values(), dtype=np.float64, count=self.many) + 0.5)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.many + len(self.names)
        self.names.append(word)
        self.cls[number] = self.classes.first_tail + tail_class(word)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        if self.many + len(self.names) + len(words) > len(self.cls):
            self.clear()
            self.update((w, k) for k, w in enumerate(self.held))
            self.names = []
            if (room := self.many + len(words)) > len(self.cls):
                self.cls, self.log = np.resize(self.cls, room), np.concatenate([self.log, np.zeros(room - len(self.log))])
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


@dataclass
class Model:
    own: list[bytes]
    #: log10 of each class's probability by context (state, class before), all normalised
    table: np.ndarray = field(repr=False)
    #: what each class's appearance says for each state
    evidence: np.ndarray = field(repr=False)
    #: log10 of the count mass of each class: sum of c + 0.5 over its words, and 0.5 for a new one
    class_mass: np.ndarray = field(repr=False)
    #: contexts by class before: own classes, and one for each kind of tail
    context_of: np.ndarray = field(repr=False)


def contexts(classes: np.ndarray, evidence: np.ndarray, context_of: np.ndarray, contexts_per_state: int) -> np.ndarray:
    """Context of each token of one text and of its end: the class before, and the likeliest state of all before."""
    before = np.concatenate([[END], classes])
    state = np.cumsum(evidence[before], axis=0).argmax(axis=1)
    return state * contexts_per_state + context_of[before]


def find_states(texts: DataFrame, size: int, seed: int = 7) -> np.ndarray:
    """A mixture of unigram models over texts' class counts, by expectation-maximisation: log probabilities (classes, states).

    texts has doc_id, text_hash, cls and n (32-bit numbers as bytes) of every training text. Each round is
    a pass over all; only sums of states x classes come to the driver. The first guess comes from STATES texts.
    """
    spark = texts.sparkSession
    generator = np.random.default_rng(seed)

    def dense(cls: list[bytes], n: list[bytes]) -> np.ndarray:
        x = np.zeros((len(cls), size), dtype=np.float32)
        rows = np.repeat(np.arange(len(cls)), [len(c) // 4 for c in cls])
        x[rows, np.frombuffer(b"".join(cls), dtype=np.int32)] = np.frombuffer(b"".join(n), dtype=np.int32)
        return x

    def sums(rate: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(rate)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = shared.value
            mass = np.zeros((len(weights), size))
            for whole in batches:
                for at in range(0, whole.num_rows, STATE_CHUNK):
                    b = whole.slice(at, STATE_CHUNK)
                    x = dense(b.column("cls").to_pylist(), b.column("n").to_pylist())
                    score = (x @ weights.T.astype(np.float32)).astype(np.float64)
                    score -= score.max(1, keepdims=True)
                    share = np.exp(score)
                    share /= share.sum(1, keepdims=True)
                    mass += share.T.astype(np.float32) @ x
            at = np.flatnonzero(mass)
            yield batch(at=pa.array(at), mass=pa.array(mass.ravel()[at]))

        out = np.zeros(len(rate) * size)
        for r in arrow_map(texts.select("cls", "n"), run, "at long, mass double").groupBy("at").agg(F.sum("mass").alias("mass")).collect():
            out[r["at"]] = r["mass"]
        shared.unpersist()
        return out.reshape(len(rate), size)

    first = texts.orderBy(F.xxhash64("doc_id", "text_hash"), "doc_id").limit(STATES).select("cls", "n").collect()
    if not first:
        return np.zeros((size, STATES))
    overall = sums(np.zeros((1, size)))[0] + 1.0
    seeds = dense([bytes(r["cls"]) for r in first], [bytes(r["n"]) for r in first])
    seeds = seeds[generator.choice(len(seeds), STATES, replace=len(seeds) < STATES)].astype(np.float64)
    rate = np.log(0.5 * (seeds + 0.01) / (seeds + 0.01).sum(1, keepdims=True) + 0.5 * overall / overall.sum())
    for _ in range(STATE_ROUNDS):
        mass = sums(rate) + 0.5 * overall / overall.sum() * size * 0.1
        rate = np.log(mass / mass.sum(1, keepdims=True))
    return rate.T.copy()


def train_nce(pair_context: np.ndarray, pair_class: np.ndarray, pair_count: np.ndarray, states: int, per_state: int, classes: int, seed: int = 11) -> np.ndarray:
    """log10 p(class | context), normalised, of a log-bilinear model.

    A context's vector is the sum of its state's and of its former class's; a class is scored by its
    own vector's product with it, plus a bias. Noise-contrastive estimation tells the pairs counted in
    all of the corpus from pairs with classes of the unigram distribution. Nothing is drawn: a step
    takes every pair by its count and the noise by its expectation, so its cost hangs on the number of
    contexts and classes alone. In the end, products over all classes are normalised, so that each
    context's sum is one.
    """
    generator = np.random.default_rng(seed)
    unigram = np.bincount(pair_class, weights=pair_count, minlength=classes) + 0.5
    noise = unigram / unigram.sum()
    log_noise = np.log(NOISE * noise)
    bias = np.log(noise)
    out = generator.normal(0, 0.1, (classes, DIMENSION))
    of_state = generator.normal(0, 0.1, (states, DIMENSION))
    of_class = generator.normal(0, 0.1, (per_state, DIMENSION))
    if len(pair_count):
        real = np.bincount(pair_context * classes + pair_class, weights=pair_count, minlength=states * per_state * classes).reshape(-1, classes)
        seen = np.flatnonzero(real.sum(1))
        real = (real[seen] / pair_count.sum()).astype(np.float32)
        both = real + (NOISE * real.sum(1, keepdims=True) * noise).astype(np.float32)
        s, c = seen // per_state, seen % per_state
        weights = [out, of_state, of_class, bias]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        for step in range(1, STEPS + 1):
            x = (of_state[s] + of_class[c]).astype(np.float32)
            z = x @ out.T.astype(np.float32) + (bias - log_noise).astype(np.float32)
            # real pairs pull by p - 1, noise pushes by p
            g = both / (1 + np.exp(-np.clip(z, -30, 30))) - real
            gx = (g @ out.astype(np.float32)).astype(np.float64)
            of_s, of_c = np.zeros_like(of_state), np.zeros_like(of_class)
            np.add.at(of_s, s, gx)
            np.add.at(of_c, c, gx)
            rate = RATE * (1 - (step - 1) / STEPS) + 0.001
            for w, (m, v), d in zip(weights, moments, ((g.T @ x).astype(np.float64), of_s, of_c, g.sum(0, dtype=np.float64)), strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
    table = np.empty((states * per_state, classes))
    for s in range(states):
        z = (of_state[s] + of_class) @ out.T + bias
        z -= z.max(1, keepdims=True)
        table[s * per_state : (s + 1) * per_state] = (z - np.log(np.exp(z).sum(1, keepdims=True))) / math.log(10)
    return table


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes) and c over whole texts; combined in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            return batch(word=(list(held), pa.binary()), c=(list(held.values()), pa.int64()))

        for b in batches:
            for t in b.column("text"):
                held.update(t.as_py().lower().split())
                if len(held) > COUNTED_WORDS:
                    yield flush()
                    held.clear()
        yield flush()

    return arrow_map(docs.select("text"), count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def held_words(counts: DataFrame) -> dict[bytes, int]:
    """The commonest words with their counts: those with a class of their own, and of the others all from a count on
    that at most HELD_WORDS reach. No task sends more than the driver keeps."""
    reached = F.sum("words").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0))
    least = counts.groupBy("c").agg(F.count("*").alias("words")).withColumn("reached", reached).where(F.col("reached") <= HELD_WORDS).agg(F.min("c")).first()[0]
    found = {bytes(r["word"]): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(OWN_CLASS).collect()}
    if least is not None:
        top = counts.where(F.col("c") >= least).toArrow()
        found |= zip(top["word"].to_pylist(), top["c"].to_pylist(), strict=True)
    return found


def train(rows: DataFrame, counts: DataFrame) -> Model:
    """The model from training rows (text as bytes) and their word counts.

    To the driver come the OWN_CLASS commonest words, the mass of each class, in each round of the
    states' search a sum for each state and class over all training texts, and counts of (context,
    class) pairs over them: at most STATES x contexts x classes, some million, whatever the corpus.
    """
    spark = rows.sparkSession
    own = [bytes(r["word"]) for r in counts.orderBy(F.desc("c"), "word").limit(OWN_CLASS).collect()]
    classes = Classes(own)
    size, first_tail = classes.size, classes.first_tail

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Classes(own)
        for b in batches:
            at = local.of(b.column("word").to_pylist())
            c = b.column("c").to_numpy()
            yield batch(cls=pa.array(np.arange(size)), mass=pa.array(np.bincount(at, weights=c + 0.5, minlength=size)))

    mass = np.zeros(size)
    for r in arrow_map(counts, masses, "cls long, mass double").groupBy("cls").agg(F.sum("mass").alias("mass")).collect():
        mass[r["cls"]] = r["mass"]
    mass[first_tail:] += 0.5  # one place for new words
    mass[END] = 1.0
    for k in range(1, first_tail):
        mass[k] = max(mass[k], 1.0)
    # contexts: the commonest words, other own classes in 24 kinds, the tail in 16
    context_of = np.arange(size)
    context_of[OWN_CONTEXT + 1 :] = OWN_CONTEXT + 1 + np.arange(size - OWN_CONTEXT - 1) % 24
    context_of[first_tail:] = OWN_CONTEXT + 25 + np.arange(size - first_tail) % 16
    per_state = OWN_CONTEXT + 41

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Classes(own)
        for b in batches:
            run = [local.of(t.as_py().lower().split()) for t in b.column("text")]
            counted = [np.bincount(at, minlength=size) for at in run]
            found = [np.flatnonzero(n) for n in counted]
            yield batch(
                doc_id=b.column("doc_id"),
                text_hash=b.column("text_hash"),
                cls=([f.astype(np.int32).tobytes() for f in found], pa.binary()),
                n=([n[f].astype(np.int32).tobytes() for n, f in zip(counted, found, strict=True)], pa.binary()),
                run=([at.astype(np.int16).tobytes() for at in run], pa.binary()),
            )

    scratch = Scratch(spark, "states")
    # the texts are split once: their class counts for the states, their runs of classes for the pairs
    held = scratch.save("classed", arrow_map(rows.select("doc_id", "text_hash", "text"), classed, "doc_id long, text_hash long, cls binary, n binary, run binary"))
    evidence = find_states(held, size)
    shared = spark.sparkContext.broadcast(evidence)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = shared.value
        table = np.zeros(STATES * per_state * size, dtype=np.int32)
        for b in batches:
            for t in b.column("run"):
                at = np.frombuffer(t.as_py(), dtype=np.int16).astype(np.int64)
                np.add.at(table, contexts(at, shares, context_of, per_state) * size + np.concatenate([at, [END]]), 1)
        found = np.flatnonzero(table)
        yield batch(pair=pa.array(found), n=pa.array(table[found].astype(np.int64)))

    found = arrow_map(held.select("run"), pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    scratch.drop("classed")
    pair, n = found["pair"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(pair)
    table = train_nce(pair[order] // size, pair[order] % size, n[order].astype(np.float64), STATES, per_state, size)
    return Model(own, table.astype(np.float32), evidence, np.log10(mass), context_of)


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Training texts are those outside the held-out fold. A word's probability is its class's, given
    the class before and the state of the text so far, by the log-bilinear model, times its share in
    the class, (c + 0.5) over the class's sum of that with one place for new words; so the
    probabilities of all words, new ones as one, and of the end add up to one.

    Counts of the HELD_WORDS commonest words go to every task. The others' occurrences, combined for
    each text, are joined with their counts by word; a hot word is among the held ones.

    Cases: null and empty texts have the one token of their end; a null doc_id counts for training;
    repeated rows count and are scored each; without training texts N is 0 and every word new; no rows give
    no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    rows = raw(docs).withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))
    training = rows.where(~F.col("held_out"))
    counts = scratch.save("counts", word_counts(training))
    ends = training.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the end is a token, counted like a word
    n_all, distinct = int(total["n"]) + ends, int(total["v"]) + (ends > 0)
    log_base = math.log10(n_all + 0.5 * (distinct + 1))
    model = train(training, counts)
    held = held_words(counts)
    # plain arrays, as broadcasts are pickled by reference; bounded by OWN_CLASS, STATES and HELD_WORDS
    shared = spark.sparkContext.broadcast((model.own, model.table, model.evidence, model.class_mass, model.context_of, held))
    end_base = math.log10(ends + 0.5)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, held = shared.value
        model = Model(*parts)
        index = Index(held, Classes(model.own))
        per_state = OWN_CONTEXT + 41
        for b in batches:
            names = ("doc_id", "text_hash", "held_out")
            keys = [b.column(n).to_pylist() for n in names]
            out: list[tuple] = []
            rare: list[tuple[int, list[bytes], np.ndarray]] = []
            waiting = 0
            for k, t in enumerate(b.column("text")):
                words = t.as_py().lower().split()
                number = index.of(words)
                at = index.cls[number]
                context = contexts(at, model.evidence, model.context_of, per_state)
                logp = float(model.table[context, np.concatenate([at, [END]])].sum(dtype=np.float64))
                # log10(c + 0.5): words with known counts by number, the others, each once a text, by a join
                plain = float(index.log[number].sum())
                others, times = np.unique(number[number >= index.many], return_counts=True)
                known = len(words) - int(times.sum())
                logp += plain - float(model.class_mass[at].sum())
                out.append((keys[0][k], keys[1][k], keys[2][k], len(words) + 1, known + (ends > 0), plain + end_base - (len(words) + 1) * log_base, logp))
                if len(others):
                    rare.append((k, [index.names[i] for i in (others - index.many).tolist()], times))
                    waiting += len(others)
                if waiting > 100_000:
                    yield rare_rows(rare, b)
                    rare, waiting = [], 0
            if rare:
                yield rare_rows(rare, b)
            yield batch(
                # text rows go through the same join; no word has a space, so they match nothing and spread
                word=([b"%d %d" % (o[1], k) for k, o in enumerate(out)], pa.binary()),
                n=pa.array(np.zeros(len(out), dtype=np.int64)),
                copies=pa.array(np.ones(len(out), dtype=np.int64)),
                **{k: pa.array([o[i] for o in out], t) for i, (k, t) in enumerate(kinds.items())},
            )

    kinds = {"doc_id": pa.int64(), "text_hash": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64()}

    def rare_rows(rare: list[tuple[int, list[bytes], np.ndarray]], b: pa.RecordBatch) -> pa.RecordBatch:
        """Words of texts (row in the batch, words, times); all else is null."""
        of = pa.array(np.repeat([r[0] for r in rare], [len(r[1]) for r in rare]))
        n = pa.array(np.concatenate([r[2] for r in rare]))
        fill = {k: pa.nulls(len(n), t) for k, t in kinds.items()} | {k: b.column(k).take(of) for k in ("doc_id", "text_hash")}
        return batch(word=([w for r in rare for w in r[1]], pa.binary()), n=n, copies=pa.nulls(len(n), pa.int64()), **fill)

    parts = arrow_map(rows, score, "word binary, n long, copies long, doc_id long, text_hash long, held_out boolean, n_tokens long, n_known long, base double, score double")
    joined = parts.join(counts, "word", "left")
    gain = F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    sums = joined.groupBy("doc_id", "text_hash").agg(
        F.sum("copies").alias("copies"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.lit(0)) + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce("base", F.lit(0.0)) + gain).alias("base"),
        F.sum(F.coalesce("score", F.lit(0.0)) + gain).alias("score"),
    )
    # repeated rows were added up: share out again
    each = lambda c: (F.col(c) / F.col("copies"))
    one = sums.select("doc_id", "text_hash", "held_out", *[F.round(each(c)).cast("long").alias(c) for c in ("n_tokens", "n_known")], F.lit(n_all).cast("long").alias("train_tokens"), each("base").alias("base_score"), each("score").alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return one.drop("copy")
