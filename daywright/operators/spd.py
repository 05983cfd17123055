"""Units-per-dollar (SPD) results of windows and weight validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywright.functions.labels import window_label
from daywright.functions.numeric import INF, float_div, is_close
from daywright.operators.rolling import DEFAULT_KEYS, Keys
from daywright.operators.windows import WINDOW_KEYS
from daywright.settings import UNITS_PER_COIN, WEIGHT_SUM_ATOL, WEIGHT_SUM_RTOL


def unit_rate(price: Column) -> Column:
    """Units bought by one dollar; a price of 0 gives infinity."""
    return float_div(F.lit(UNITS_PER_COIN), price)


def spd_table(rates: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Final SPD columns from per-window rates.

    Percentiles place a plan between the worst and best day of its window; they are missing
    when the span is zero or not finite.
    """
    low, high = F.col("min_rate"), F.col("max_rate")
    span = high - low
    known = (span > 0) & (span < INF)

    def percentile(rate: str) -> Column:
        return F.when(known, (F.col(rate) - low) / span * 100)

    return rates.select(
        *keys,
        "window_start",
        "window_end",
        window_label(F.col("window_start"), F.col("window_end")).alias("window"),
        low.alias("min_sats_per_dollar"),
        high.alias("max_sats_per_dollar"),
        F.col("uniform_rate").alias("uniform_sats_per_dollar"),
        F.col("dynamic_rate").alias("dynamic_sats_per_dollar"),
        percentile("uniform_rate").alias("uniform_percentile"),
        percentile("dynamic_rate").alias("dynamic_percentile"),
        *[c for c in ("weight_sum", "negative_weights") if c in rates.columns],
    ).withColumn("excess_percentile", F.col("dynamic_percentile") - F.col("uniform_percentile"))


def rates_from_weights(
    weighted: DataFrame, rate: str = "rate", keys: Keys = DEFAULT_KEYS
) -> DataFrame:
    """Per-window rates from rows that carry a rate and a weight.

    A day without a price buys nothing: its product is NULL and drops out of the sum.
    """
    return weighted.groupBy(*keys, *WINDOW_KEYS).agg(
        F.min(rate).alias("min_rate"),
        F.max(rate).alias("max_rate"),
        F.avg(rate).alias("uniform_rate"),
        F.coalesce(F.sum(F.col("weight") * F.col(rate)), F.lit(0.0)).alias("dynamic_rate"),
        F.sum("weight").alias("weight_sum"),
        F.count_if(F.col("weight") < 0).alias("negative_weights"),
    )


def sums_to_one(total: Column) -> Column:
    """The strict sum test of the submission check."""
    return is_close(total, F.lit(1.0), 1e-5, 1e-8)


def weight_checks(weights: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Per window: sum of weights, count of negative weights, and whether both are right."""
    return (
        weights.groupBy(*keys, "window_start", "window_end")
        .agg(F.sum("weight").alias("weight_sum"), F.count_if(F.col("weight") < 0).alias("negative_weights"))
        .withColumn("sum_ok", sums_to_one(F.col("weight_sum")))
        .withColumn("passed", F.col("sum_ok") & (F.col("negative_weights") == 0))
    )


def wrong_sums(windows: DataFrame, total: str = "weight_sum") -> DataFrame:
    """Windows whose weights do not sum to 1 within the backtest tolerance."""
    right = is_close(F.col(total), F.lit(1.0), WEIGHT_SUM_RTOL, WEIGHT_SUM_ATOL)
    return windows.where(~F.coalesce(right, F.lit(False)))


def with_right_sums(results: DataFrame, total: str = "weight_sum") -> DataFrame:
    """The rows as they are; the job fails at a window whose weights do not sum to 1.

    It is a filter, so it holds whichever columns are read, and stays lazy.
    """
    right = F.coalesce(is_close(F.col(total), F.lit(1.0), WEIGHT_SUM_RTOL, WEIGHT_SUM_ATOL), F.lit(False))
    text = F.concat(
        F.lit("weights do not sum to 1 in "), F.col("window"), F.lit(": "), F.coalesce(F.col(total).cast("string"), F.lit("none"))
    )
    return results.where(F.when(right, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def assert_weight_sums(windows: DataFrame, total: str = "weight_sum") -> None:
    """Raise on the first few windows with a wrong sum."""
    bad = wrong_sums(windows, total).limit(3).collect()
    if bad:
        raise AssertionError(f"weights do not sum to 1: {bad}")


def weight_summary(weights: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    return weights.groupBy(*keys, "window_start", "window_end").agg(
        F.count("weight").alias("n"),
        F.sum("weight").alias("sum_weight"),
        F.min("weight").alias("min_weight"),
        F.max("weight").alias("max_weight"),
        F.avg("weight").alias("mean_weight"),
        F.stddev_samp("weight").alias("std_weight"),
    )
