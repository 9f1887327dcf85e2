"""From raw documents to a training order: five stages, each on all that the one before kept.

Documents of no known language go; lines that repeat in runs of three go from all but the first document (a document can become
empty, but stays); of near-duplicates the document with the smallest id stays; documents that hold a benchmark item go; the rest
is put in the order of a curriculum that mixes the sources to their target weights.

Every stage but the last returns the columns of its input. What nulls, empty texts, equal rows, empty tables and further columns
give is stated by the operators; no stage adds a case of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cataloom.llm import decontaminate, jaccard_join, language, line_dedup, mixing
from cataloom.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, docs.columns)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontamination),
    ("mixture", mixture),
]
ORACLE_SQL = None  # language models are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
