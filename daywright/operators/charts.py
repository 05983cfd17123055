"""Chart-ready tables. Drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywright.functions.labels import iso_datetime
from daywright.operators.rolling import DEFAULT_KEYS, Keys, running

# Row labels and value formats of the summary table: fixed values.
SUMMARY_ROWS = (
    ("Final Model Score", "score", "%.2f%%"),
    ("Win Rate", "win_rate", "%.2f%%"),
    ("Exponential Decay Percentile", "exp_decay_percentile", "%.2f%%"),
    ("Mean Excess Percentile", "mean_excess", "%.2f%%"),
    ("Median Excess Percentile", "median_excess", "%.2f%%"),
    ("Mean Relative Improvement", "relative_improvement_pct_mean", "%.2f%%"),
    ("Median Relative Improvement", "relative_improvement_pct_median", "%.2f%%"),
    ("Mean Ratio (Dynamic/Uniform)", "mean_ratio", "%.2f"),
    ("Median Ratio (Dynamic/Uniform)", "median_ratio", "%.2f"),
    ("Total Windows", "total_windows", "%d"),
    ("Wins", "wins", "%d"),
    ("Losses", "losses", "%d"),
)
HISTOGRAM_BINS = 30


def _excess() -> Column:
    return F.col("dynamic_percentile") - F.col("uniform_percentile")


def performance_long(spd: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """(date, strategy, spd_percentile): two lines per series."""
    return spd.select(
        *keys,
        F.col("window_start").alias("date"),
        F.col("dynamic_percentile").alias("Dynamic DCA"),
        F.col("uniform_percentile").alias("Uniform DCA"),
    ).unpivot([*keys, "date"], ["Dynamic DCA", "Uniform DCA"], "strategy", "spd_percentile")


def excess_histogram(
    spd: DataFrame, bins: int = HISTOGRAM_BINS, keys: Keys = DEFAULT_KEYS
) -> DataFrame:
    """(bin, bin_start, bin_end, windows, mean_excess) with equal bins from min to max.

    The last bin holds the maximum. A series whose values are all equal uses the unit range
    around them. The limits come from a window over the series, so the SPD table is read once.
    """
    whole = Window.partitionBy(*keys)
    values = spd.select(*keys, _excess().alias("_x")).where(F.col("_x").isNotNull())
    ranged = values.withColumns(
        {"_min": F.min("_x").over(whole), "_max": F.max("_x").over(whole), "mean_excess": F.avg("_x").over(whole)}
    )
    margin = F.when(F.col("_min") == F.col("_max"), 0.5).otherwise(0.0)
    ranged = ranged.withColumns({"_lo": F.col("_min") - margin, "_hi": F.col("_max") + margin})
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_no = F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    of_series = [*keys, "_lo", "_hi", "mean_excess"]
    counted = ranged.groupBy(*of_series, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("windows"))
    # At most ``bins`` entries per series: looked up again to keep the empty bins.
    found = counted.groupBy(*of_series).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "windows"))).alias("_found")
    )
    every_bin = found.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every_bin.select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce(F.try_element_at("_found", F.col("bin")), F.lit(0)).alias("windows"),
        "mean_excess",
    )


def cumulative_excess(spd: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """(date, cumulative_excess) over windows ordered by start."""
    ordered = Window.partitionBy(*keys).orderBy("window_start", "window_end")
    total = F.sum(_excess()).over(running(ordered))
    # An undefined window leaves a hole but does not end the running sum.
    return spd.select(
        *keys,
        F.col("window_start").alias("date"),
        F.when(_excess().isNotNull(), total).alias("cumulative_excess"),
    )


def metrics_summary(metrics: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """(position, metric, value) with formatted values, twelve rows per series."""
    rows = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(label).alias("metric"),
            F.format_string(fmt, F.col(name)).alias("value"),
        )
        for i, (label, name, fmt) in enumerate(SUMMARY_ROWS)
    ]
    return metrics.select(*keys, F.inline(F.array(*rows)))


def window_report(spd: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """The nine window-level fields of the report."""
    return spd.select(
        *keys,
        "window",
        iso_datetime(F.col("window_start")).alias("start_date"),
        "dynamic_percentile",
        "uniform_percentile",
        _excess().alias("excess_percentile"),
        "dynamic_sats_per_dollar",
        "uniform_sats_per_dollar",
        "min_sats_per_dollar",
        "max_sats_per_dollar",
    )
