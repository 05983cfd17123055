"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and hands its rows to the next as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daywright.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from daywright.llm.common import byte_bpe, stored, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the boilerplate lines of their source."""
    return line_dedup.drop_boilerplate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of tokens."""
    return packing.pack(docs, *byte_bpe())


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontaminated),
    ("packing", packed),
]

#: The last stages aren't SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
