"""From hits to a prompt: diversity, reranking, context, history, query variants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lakeloom.functions.text import is_blank, java_trim, strip_list_mark
from lakeloom.operators.status import relevance

# Fixed value: the wording of the prompt.
PROMPT = """Based on the conversation history and document context, answer the current question.

--- CONVERSATION HISTORY ---
%s
--- END CONVERSATION HISTORY ---

--- DOCUMENT CONTEXT ---
%s
--- END CONTEXT ---

Question: %s

Answer:"""


def mmr_order(scores: list[float], vectors: list, k: int, trade: float) -> list[int]:
    """Greedy choice of k by trade x score less (1 - trade) x nearness to those chosen; the first wins ties."""
    n = len(scores)
    if n <= k:
        return list(range(n))
    usable = [np.asarray(v, dtype=float) if v is not None and len(v) else None for v in vectors]

    def near(a, b) -> float:
        if a is None or b is None or len(a) != len(b):
            return 0.0
        length = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / length) if length else 0.0

    chosen: list[int] = []
    closest = np.zeros(n)
    while len(chosen) < k:
        value = [-np.inf if i in chosen else trade * scores[i] - (1 - trade) * closest[i] for i in range(n)]
        best = int(np.argmax(value))
        chosen.append(best)
        closest = np.maximum(closest, [near(usable[i], usable[best]) for i in range(n)])
    return chosen


def mmr(hits: DataFrame, k: int, trade: float = 0.5) -> DataFrame:
    """hits (q, rank, score, vector, ...) of each query, diversified and ranked anew. A query's hits are a bounded pool."""
    schema = StructType([f if f.name != "rank" else type(f)("rank", IntegerType()) for f in hits.schema])

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        order = mmr_order(rows["score"].tolist(), rows["vector"].tolist(), k, trade)
        return rows.iloc[order].assign(rank=range(1, len(order) + 1))

    return hits.groupBy("q").applyInPandas(select, schema)


def rerank(hits: DataFrame, scores: DataFrame | None, most: int = 8, replace: bool = False) -> DataFrame:
    """hits (q, key, rank, score, ...) by scores from outside (q, key, rerank_score), missing last, then the old order.

    replace: the new score takes the old one's place, and the vector goes, as it no longer explains the
    score. Without scores (the model failed) the first `most` stay as they are.
    """
    if scores is None:
        return hits.where(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("int"))
    joined = hits.join(scores, ["q", "key"], "left")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc_nulls_last("rerank_score"), "rank"))
    out = joined.withColumn("rank", place.cast("int")).where(F.col("rank") <= most)
    if replace:
        out = out.withColumn("score", F.coalesce("rerank_score", "score")).drop("vector")
    return out.drop("rerank_score")


def first_hits(hits: DataFrame, most: int) -> DataFrame:
    """What takes the place of a diversity selector that is off: the first `most`."""
    return hits.where(F.col("rank") <= most)


def always_relevant(hits: DataFrame) -> DataFrame:
    """What takes the place of a grader that is off: every query with hits is relevant."""
    return hits.groupBy("q").agg(F.count("*").alias("good")).withColumn("verdict", F.lit("RELEVANT"))


def pool_size(most: int, pool: int = 30, diversify: bool = True) -> int:
    """How many hits to retrieve: where they are diversified, the pool or more."""
    return max(pool, most) if diversify else most


def broadened(most: int, pool: int = 30) -> int:
    """How many hits the second pass retrieves, with no least score."""
    return max(pool, most)


def pack_context(hits: DataFrame, max_chars: int, least: int = 100) -> DataFrame:
    """q and context: numbered sources in rank order up to max_chars; a last one is cut if over `least` remain."""
    entry = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.col("name"), F.lit(" (score: "), F.format_string("%.2f", "score"), F.lit(")]\n"), F.col("text"), F.lit("\n\n"))
    run = Window.partitionBy("q").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = hits.withColumn("entry", entry).withColumn("before", F.coalesce(F.sum(F.length("entry")).over(run), F.lit(0)))
    left = F.lit(max_chars) - F.col("before")
    part = F.when(F.length("entry") <= left, F.col("entry")).when((left > least) & (F.col("before") <= max_chars), F.concat(F.substring(F.col("entry"), F.lit(1), left.cast("int")), F.lit("\n... (context truncated)")))
    parts = rows.withColumn("part", part).where("part is not null").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("parts"))
    return parts.select("q", F.trim(F.array_join(F.transform("parts", lambda p: p["part"]), "")).alias("context"))


def last_turns(turns: DataFrame, most: int = 10) -> DataFrame:
    """The last turns of each session, blank ones not counted."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.where(~is_blank(F.col("text"))).withColumn("place", place).where(F.col("place") <= max(1, most)).drop("place")


def history(turns: DataFrame, most: int = 10) -> DataFrame:
    """conv_id and block: the last turns as lines of User: and Assistant:."""
    said = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.trim("text"))
    rows = last_turns(turns, most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("line")))).alias("lines"))
    return rows.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("block"))


def unique_variants(variants: DataFrame, most: int = 6) -> DataFrame:
    """Query texts (q, no, text) without list marks, one of each whatever its case, the first `most`; blank and NONE go."""
    bare = variants.withColumn("text", strip_list_mark(F.col("text"))).where((F.col("text") != "") & (F.upper("text") != "NONE"))
    first = bare.groupBy("q", F.lower("text").alias("low")).agg(F.min(F.struct("no", "text")).alias("v")).select("q", "v.*")
    place = F.row_number().over(Window.partitionBy("q").orderBy("no"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("q", F.col("place").cast("int").alias("place"), "text")


#: How many of each kind of variant are taken, and characters of a drafted passage.
SUB_QUESTIONS, PARAPHRASES, PASSAGE_CHARS = 4, 3, 1_000


def expand(queries: DataFrame, answers: DataFrame, sub_questions: bool = True, hypothetical: bool = True, paraphrases: bool = True, most: int = 8) -> DataFrame:
    """q, place, label, text and vector_only: the variants to search for, at most `most` of each query.

    queries: q, text. answers: q, kind and answer, what a model said: "sub" and "variant" hold a line
    for each variant, "hyde" a passage; a missing or null answer is a failed one. In order: the query
    itself; sub-questions, unless the first line is NONE; the drafted passage, which searches by its
    vector alone and is embedded as documents are; paraphrases. Texts that came before, letter case
    aside, and blank ones go, and don't count against the limits. Blank queries have none.
    """
    asked = queries.where(F.trim("text") != "").select("q", F.trim("text").alias("text"))
    rows = asked.select("q", F.lit(0).alias("kind"), F.lit(0).alias("no"), "text")
    said = answers.where("answer is not null").join(asked.select("q"), "q", "left_semi")
    bare = F.filter(F.transform(F.split("answer", "\\R"), strip_list_mark), lambda x: x != "")
    lines = said.select("q", "kind", bare.alias("lines"))
    kinds = [("sub", 1)] * sub_questions + [("variant", 3)] * paraphrases
    for kind, place in kinds:
        some = lines.where(F.col("kind") == kind)
        if kind == "sub":
            some = some.where(F.coalesce(F.upper(F.get("lines", F.lit(0))) != "NONE", F.lit(True))).withColumn("lines", F.filter("lines", lambda x: F.upper(x) != "NONE"))
        rows = rows.unionByName(some.select("q", F.lit(place).alias("kind"), F.posexplode("lines").alias("no", "text")))
    # of equal texts the first; a passage is told from questions by its kind
    first = rows.groupBy("q", F.lower("text").alias("low")).agg(F.min(F.struct("kind", "no", "text")).alias("v")).select("q", "v.*")
    if hypothetical:
        passage = said.where("kind = 'hyde'").select("q", F.lit(2).alias("kind"), F.lit(0).alias("no"), F.substring(F.trim("answer"), 1, PASSAGE_CHARS).alias("text"))
        first = first.unionByName(passage.where("text <> ''"))
    number = F.row_number().over(Window.partitionBy("q", "kind").orderBy("no"))
    kept = first.withColumn("n", number).where(F.col("n") <= F.element_at(F.array(F.lit(1), F.lit(SUB_QUESTIONS), F.lit(1), F.lit(PARAPHRASES)), F.col("kind") + 1))
    label = F.when(F.col("kind") == 0, "original").when(F.col("kind") == 1, F.concat(F.lit("sub-"), "n")).when(F.col("kind") == 2, "hyde").otherwise(F.concat(F.lit("variant-"), "n"))
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("kind", "n"))).where(F.col("place") <= most)
    return placed.select("q", F.col("place").cast("int").alias("place"), label.alias("label"), "text", (F.col("kind") == 2).alias("vector_only"))


def gated(strict: DataFrame, broad: DataFrame, min_score: float, min_hits: int = 1) -> DataFrame:
    """The hits of the strict pass where they are relevant, else those of the broadened pass if that is, else none."""
    good = lambda hits: relevance(hits, min_score, min_hits).where("verdict = 'RELEVANT'").select("q")
    first = good(strict)
    again = good(broad).join(first, "q", "left_anti")
    return strict.join(first, "q", "left_semi").unionByName(broad.join(again, "q", "left_semi"))


def prompt(question: Column, history: Column, context: Column) -> Column:
    """The user message: history, context and question; fixed wording."""
    none = F.when(history.isNull() | (java_trim(history) == ""), F.lit("(none)")).otherwise(history)
    return F.format_string(PROMPT, none, context, question)


def sources(hits: DataFrame) -> DataFrame:
    """q and sources: what an answer rests on, in rank order."""
    rows = hits.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "score"))).alias("sources"))
    return rows.select("q", "sources")


def question(original: Column, rewritten: Column, has_history: Column) -> Column:
    """A rewritten question, if there is a history and a rewrite."""
    return F.when(has_history, F.coalesce(F.when(~is_blank(rewritten), rewritten), original)).otherwise(original)
