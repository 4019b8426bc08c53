"""Corpus pipeline: five stages from documents to token records.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. ``run`` hands the stages on through Parquet in the shared folder.

In every stage null text counts as empty, texts of any length are read whole, nulls in other columns are values like any
other, extra columns are kept whatever their names (the last stage ignores them), and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkreg.functions.storage import materialise
from sparkreg.llm import decontaminate, mixing, ngram_join, rules, token_records
from sparkreg.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; cutoffs come from the labelled rows among docs.

    Empty and null texts fail the base rules. A metric equal to a cutoff passes. Rows that repeat an id and text are judged
    alike and all stay or go. A null language is a stratum of its own; strata with too few labels keep the base rules alone.
    """
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least id, of each near-duplicate class.

    Texts without words (empty, null or blank) are copies of those with equal text only. Null ids come after all others; a
    tie for the least id goes to the text with the least MD5; of rows that repeat an id and text one stays.
    """
    return ngram_join.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Items without words match nothing; items of under five words are found as they stand, in order; a containment equal to
    the threshold is a match; rows that repeat an id and text go together.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Documents without words are never taken. A null source is a source of its own, last in order. Rows of one id and
    text share their rank and are taken together.
    """
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token records written for docs, as read back: doc_id, start, n_tokens, ids_crc32.

    Empty and null texts have the end id alone. Null ids come first; rows that repeat an id are ordered by text, and copies
    that the mix made are records of their own.
    """
    return token_records.round_trip(docs, vocabulary())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_tokens),
]

#: MinHash search, a hash-ranked sample and byte-pair encoding have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
