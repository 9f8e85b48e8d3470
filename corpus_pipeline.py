"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtab.llm import line_dedup, near_dup, packing, pii, quality_rules
from loomtab.llm.common import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those that only repeat others go."""
    return line_dedup.keep(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, by shingles of five words and a similarity of 0.8."""
    return near_dup.keep(spark, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, by the session's secret key, or one drawn for this run alone."""
    return pii.replace_table(spark, docs, pii.session_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, and their places in sequences of 4096 tokens."""
    return packing.pack(spark, docs, with_ids=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dup", near_duplicates), ("pii", personal_data), ("packing", pack)]

#: Shingle hashes, byte-pair merges and keyed surrogates are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each on a written copy of what the one before returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(spark, apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
