"""A corpus pipeline: each stage works on what the one before kept.

Toxic documents go, one document of each near-duplicate group stays, repeated strings of 100 bytes are cut out, documents
with benchmark passages go, and the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import bpe, decontaminate, jaccard, suffixdup, toxicity
from factweave.llm.common import table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model lets through."""
    return toxicity.clean(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.clean(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without strings that an earlier one has."""
    return suffixdup.clean(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the documents' token ids and of their decoded texts."""
    return bpe.digest(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near), ("suffix_dedup", repeats), ("decontamination", leaks), ("bpe", encoded)]

#: A learned classifier and a vocabulary file are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
