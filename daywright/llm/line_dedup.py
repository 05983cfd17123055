"""Site-relative line frequency, in DataFrame functions only.

Within a host, a line is boilerplate if the share of the host's pages that contain it exceeds a
ratio. Lines are compared without surrounding spaces; a line counts once a page; lines of white
space neither count nor go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywright.llm.common import col, fresh

#: A line goes if more than this share of its host's pages have it, and at least so many pages.
MAX_RATIO, MIN_PAGES = 0.05, 3

#: Parts that a host's documents are split into for the join; its few boilerplate lines are copied to each.
SPLITS = 32


def _key(line: Column) -> Column:
    """128 bits for a line: no two lines of a corpus are taken for one another."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, bad): per host the keys of its boilerplate lines.

    A page's lines sum to its length, so a host has at most (mean lines a page) / max_ratio such
    lines, however many pages it has: the array stays small. Counting is an aggregate with a
    partial sum before the shuffle, so a hot host is no hot task.
    """
    pages = docs.select(col(host).alias("host"), F.coalesce(col(text), F.lit("")).alias("text"))
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), _has_word), _key))
    lines = pages.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("pages_with"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = lines.where(F.col("pages_with") >= min_pages).alias("l").join(totals.alias("t"), F.expr("l.host <=> t.host"))
    bad = frequent.where(F.col("pages_with") > F.lit(max_ratio) * F.col("pages"))
    return bad.groupBy(F.col("l.host").alias("host")).agg(F.collect_list("key").alias("bad"))


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    chars: str = "n_chars",
    dropped: str | None = None,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """All documents, boilerplate lines gone from `text`, `chars` (if there) set to the new length.

    Other lines keep their order and bytes. A text that loses every line becomes empty; a null text
    stays null; null hosts form one host; repeated rows count as pages of their own. `dropped`
    names a column for the number of lines that went. A host's documents are joined in `SPLITS`
    parts by doc_id, so that one host doesn't meet in one task.
    """
    h, part, of, bad = (fresh(docs, x) for x in ("__host", "__part", "__of_part", "__bad"))
    lists = boilerplate(docs, host, text, max_ratio, min_pages).select(
        F.col("host").alias(h), F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias(of), F.col("bad").alias(bad)
    )
    spread = docs.withColumn(part, F.pmod(F.xxhash64(col("doc_id")), F.lit(SPLITS)).cast("int"))
    joined = spread.join(lists, col(host).eqNullSafe(F.col(h)) & (F.col(part) == F.col(of)), "left")
    lines = F.split(col(text), "\n")
    kept = F.filter(lines, lambda x: ~(_has_word(x) & F.array_contains(F.col(bad), _key(x))))
    clean = F.when(F.col(bad).isNull(), col(text)).otherwise(F.array_join(kept, "\n"))
    lost = F.when(F.col(bad).isNull(), F.lit(0)).otherwise(F.coalesce(F.size(lines) - F.size(kept), F.lit(0)))
    columns = [
        clean.alias(c) if c == text else F.coalesce(F.length(clean), F.lit(0)).cast(docs.schema[c].dataType).alias(c) if c == chars else col(c)
        for c in docs.columns
    ]
    return joined.select(*columns, *([lost.cast("long").alias(dropped)] if dropped else []))
