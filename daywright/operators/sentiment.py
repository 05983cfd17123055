"""Activity sentiment: how busy a day is compared with the active days before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywright.operators.cleaning import to_day
from daywright.operators.rolling import with_percent_rank
from daywright.settings import MARKET_TEXT_PATTERN


def text_matches(c: Column, pattern: str = MARKET_TEXT_PATTERN) -> Column:
    """Case-insensitive regular-expression match; missing text does not match."""
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def daily_activity(markets: DataFrame, pattern: str = MARKET_TEXT_PATTERN) -> DataFrame:
    """(date, market_count, volume) of the matching markets by creation day."""
    return (
        markets.where(text_matches(F.col("question"), pattern))
        .withColumn("date", to_day(F.col("created_at")))
        .where(F.col("date").isNotNull())
        .groupBy("date")
        .agg(
            F.count("market_id").alias("market_count"),
            F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        )
    )


def activity_sentiment(
    markets: DataFrame, pattern: str = MARKET_TEXT_PATTERN, rows: int = 30
) -> DataFrame:
    """(date, sentiment): mean of the rolling ranks of market count and volume.

    The ranks need one order over all active days. That table has one row per calendar date
    however many markets there are, so a single ordered pass over it stays small.
    """
    ranks = daily_activity(markets, pattern).withColumn("_all", F.lit(0))
    ranks = with_percent_rank(ranks, "market_count", "_count_rank", rows, 1, ["_all"])
    ranks = with_percent_rank(ranks, "volume", "_volume_rank", rows, 1, ["_all"])
    return ranks.select(
        "date",
        F.coalesce(0.5 * F.col("_count_rank") + 0.5 * F.col("_volume_rank"), F.lit(0.5)).alias(
            "sentiment"
        ),
    )
