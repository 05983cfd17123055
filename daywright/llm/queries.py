"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywright.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    jaccard_join,
    line_dedup,
    lm_scoring,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    ranked_search,
    resharding,
    spelling,
)
from daywright.llm.common import byte_bpe, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *byte_bpe())


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more a document is like what assistants say in `conversations` than like the documents at large."""
    target = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), target, *byte_bpe())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), dropped="dropped_lines")
    return docs.select("doc_id", "source", "text", "dropped_lines")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return chat_format.digests(chat_format.formatted(rows.unionByName(more)))


#: The query's layout before and after: documents lie in six shards by a hash of their text, two more are added.
OLD_SHARDS, SHARDS = 6, 8


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and checksums are those of the texts as the new shards' files hold them."""
    moved = resharding.resharded(table(spark, sf_dir, "documents"), SHARDS, OLD_SHARDS)
    text = F.coalesce("whole.text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    none = F.lit(None).cast("int").alias("grown_shard")
    checksum = F.crc32(text.cast("binary")).alias("text_crc32")
    return moved.select("whole.doc_id", size, checksum, F.lit("bytes").alias("law"), "shard", "slot", none, "old_shard")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_decontaminate,
        op3_lm_scoring,
        op4_quality_classifier,
        op5_quality_rules,
        op6_pii,
        op7_line_dedup,
        op8_chat_format,
        op9_resharding,
        op10_jaccard_join,
        op11_spelling_variants,
        op12_exact_dedup,
        op13_ranked_search,
    )
}
