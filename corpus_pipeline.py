"""From raw documents to packed training sequences: five stages, each an operator that takes effect.

Each stage gets the rows that its predecessor kept. Those before the last return the columns of
documents: toxic documents go, one document of each group of near-duplicates stays, documents that
overlap the benchmark go, personal data are masked. The last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import decontamination, packing, pii, simhash, toxicity
from lakeloom.llm.common import table
from lakeloom.llm.registry import tokenizer_path
from lakeloom.session import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by a classifier of the labelled ones.

    Cases: null and empty texts are scored like others and stay unless the bias alone is toxic; null ids
    are not labelled; repeated rows stay or go together; no rows give no rows; all columns are kept.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id.

    Cases: null, empty and blank texts are one group; of repeated rows one stays; null ids come last; no
    rows give no rows; all columns are kept.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no item of the benchmark.

    Cases: null and empty texts stay; repeated rows stay or go together; no rows give no rows, and an
    empty benchmark keeps all; all columns are kept.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by their kinds.

    Cases: null and empty texts stay as they are; repeated rows are masked alike; no rows give no rows;
    all columns are kept, and n_chars follows the text.
    """
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1,024 ids, in place of documents.

    Cases: a null or empty text is the one id that ends it; repeated rows are packed each; texts longer
    than a sequence span several; no rows give no rows; other columns are ignored.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Models and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
