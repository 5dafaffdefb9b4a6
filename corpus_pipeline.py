"""Documents through toxicity, near duplicates, repeated passages, benchmark leaks and tokens.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept.  All but the last return the columns of
documents, whatever they are called; repeated rows stay or go alike, texts of any length are read whole, and an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import encoded_digests
from tidemark.llm.jaccard import one_of_each
from tidemark.llm.leaks import without_leaks
from tidemark.llm.queries import vocabulary
from tidemark.llm.store import keep
from tidemark.llm.substrings import without_repeats
from tidemark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; null and empty texts score like texts without evidence."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of similar ones; those without doc_id, text or words stay."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that one of a smaller doc_id has; null texts stay null."""
    return without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of each document that is left; a null text has no tokens."""
    return encoded_digests(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_passages", benchmark_passages), ("tokens", tokens)]

#: Learned scores and the vocabulary can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs)
    return docs
