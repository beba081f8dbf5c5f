"""Benchmark decontamination by spaced seeds, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks over word positions: five words count, those between are ignored. Each leaves out a
#: residue modulo 5, so that a substitution in every fifth word can't hide a passage from all.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 3, 5, 6), (0, 2, 3, 6, 7))
#: Further masks, with the fewest and most words of the items they are for: with those above, one word may
#: be another in items of six to ten words; items of up to five words are looked for whole.
SHORT_MASKS = (
    ((0, 1, 2, 3, 4), 6, 10), ((0, 1, 2, 4, 5), 6, 10), ((0, 1, 3, 4, 5), 6, 10), ((0, 2, 3, 4, 5), 6, 10),
    ((0, 1, 2, 3, 4), 5, 5), ((0, 1, 2, 3), 4, 4), ((0, 1, 2), 3, 3), ((0, 1), 2, 2), ((0,), 1, 1),
)
#: A passage is an overlap of so many words (or the whole item, if shorter) of which SIMILARITY match.
PASSAGE_WORDS = 15
SIMILARITY = 0.8
#: Seeds of the benchmark are broadcast up to so many, some 200 bytes each; beyond, the join shuffles.
BROADCAST_SEEDS = 200_000


def word_hashes(text: Column) -> Column:
    """Hashes of lower-cased words: runs of letters and digits."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def masks_for(sizes: set[int]) -> list[tuple[int, tuple[int, ...], int, int]]:
    """(number, mask, fewest words, most words) of the masks that items of these sizes need."""
    longest = 1 << 30
    every = [(m, len(MASKS[0]) + 1, longest) for m in MASKS] + list(SHORT_MASKS)
    return [(k, m, lo, hi) for k, (m, lo, hi) in enumerate(every) if hi == longest or any(lo <= n <= hi for n in sizes)]


def seeds(frame: DataFrame, words: str, at: str, masks: list, of_items: bool = False) -> DataFrame:
    """A row for each mask and word position of the array `words`: its other columns, the position, mask and seed.

    Items have seeds of the masks for their size alone, documents of all.

    The words are exploded first and the hashes taken from row to array, so that they are compiled;
    a higher-order function would interpret them.
    """
    others = frame.columns
    # outer, as else a filter on the array's size is inferred, which hashes all words a second time
    each = frame.select(*others, F.posexplode_outer(words).alias(at, "__word")).where(F.col(at).isNotNull())

    def seed(k: int, mask: tuple[int, ...], lo: int, hi: int) -> Column:
        fits = F.col(at) + mask[-1] < F.size(words)
        fits = fits & F.size(words).between(lo, hi) if of_items else fits
        return F.when(fits, F.xxhash64(F.lit(k), "__word", *[F.get(words, F.col(at) + o) for o in mask[1:]]))

    return each.select(*others, at, F.posexplode(F.array(*[seed(*m) for m in masks])).alias("mask", "seed")).where("seed is not null")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, item_hash (of its text) and item_words of all items."""
    text = F.coalesce("text", F.lit(""))
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text).alias("item_hash"), word_hashes(text).alias("item_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, matched_words and item_words: each pair of document and item that overlap.

    All positions of a whole text are hashed under each mask and joined with the items' seeds. Each
    diagonal that has hits is verified once: the words along it are compared, and a stretch of
    PASSAGE_WORDS words (the whole item if shorter) must match in 80 %.

    The items' seeds are counted first; up to BROADCAST_SEEDS are broadcast, so that documents aren't
    shuffled. Beyond that the seeds of the documents are shuffled without their texts, the hits are
    joined back, and adaptive planning splits hot seeds. Both ways verify alike: an item is told by its
    id, null or not, and its text; of several texts of one id the best match is returned.

    Cases: null and empty texts and items match nothing; items of up to five words are looked for whole;
    repeated rows give one row; no rows on either side give no rows; other columns are ignored,
    whatever their names.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = base.select("doc_id", F.xxhash64("text").alias("text_hash"), word_hashes(F.col("text")).alias("words"))
    items = benchmark_items(benchmark)
    # at most ten numbers
    masks = masks_for({r["n"] for r in items.select(F.size("item_words").alias("n")).where("n between 1 and 10").distinct().collect()})
    test = seeds(items, "item_words", "item_at", masks, of_items=True)
    if test.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        hits = seeds(words, "words", "at", masks).drop("mask").join(F.broadcast(test), "seed")
    else:
        slim = test.select("seed", F.col("item_id").alias("hit_item"), "item_hash", "item_at")
        found = seeds(words, "words", "at", masks).select(F.col("doc_id").alias("hit_id"), "text_hash", "at", "seed").join(slim, "seed")
        items = items.dropDuplicates(["item_id", "item_hash"])
        joined = found.join(words.dropDuplicates(["doc_id", "text_hash"]), "text_hash").where(F.col("hit_id").eqNullSafe(F.col("doc_id")))
        hits = joined.drop("hit_id").join(items, "item_hash").where(F.col("hit_item").eqNullSafe(F.col("item_id")))
    # only the part of the text that lies along the item goes on, once for each diagonal
    shift, size = F.col("at") - F.col("item_at"), F.size("item_words")
    skipped = F.greatest(-shift, F.lit(0))
    along = F.slice("words", F.greatest(shift, F.lit(0)) + 1, size - skipped)
    diagonals = (
        hits.select("doc_id", "text_hash", "item_id", "item_hash", "item_words", shift.alias("shift"), along.alias("along"))
        .groupBy("doc_id", "text_hash", "item_id", "item_hash", "shift")
        .agg(F.first("along").alias("along"), F.first("item_words").alias("item_words"))
    )
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    flag = F.transform("item_words", lambda w, j: F.coalesce((j >= skipped) & (F.get("along", F.when(j >= skipped, j - skipped)) == w), F.lit(False)).cast("int"))
    checked = diagonals.select("doc_id", "text_hash", "item_id", "item_hash", flag.alias("flags"), F.least(size, F.lit(PASSAGE_WORDS)).alias("window"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("flags") - F.col("window") + 1), lambda s: total(F.slice("flags", s, F.col("window")))))
    pairs = checked.groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(F.max(best - F.ceil(F.col("window") * SIMILARITY)).alias("spare"), F.max(total("flags")).alias("matched_words"), F.max(F.size("flags")).alias("item_words"))
    top = pairs.where("spare >= 0").groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("matched_words", "item_words")).alias("top"))
    return top.select("doc_id", "text_hash", "item_id", "top.matched_words", "top.item_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap with no item, all columns.

    Cases: rows with null or empty texts stay; repeated rows stay or go together; no rows give no rows,
    and an empty benchmark keeps all; other columns are kept, whatever their names.
    """
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(bad["__bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["__bad_hash"])
    return docs.join(bad, same, "left_anti")
