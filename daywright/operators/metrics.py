"""Summary metrics over the SPD table of each series.

A series has at most one row per window start, so the exact medians below hold a bounded
number of values per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywright.functions.numeric import float_div
from daywright.operators.rolling import DEFAULT_KEYS, Keys
from daywright.settings import EXP_DECAY

# Order and names of the twelve metrics: fixed values.
METRICS = (
    "score",
    "win_rate",
    "exp_decay_percentile",
    "mean_excess",
    "median_excess",
    "relative_improvement_pct_mean",
    "relative_improvement_pct_median",
    "mean_ratio",
    "median_ratio",
    "total_windows",
    "wins",
    "losses",
)


def _won() -> Column:
    """Strictly better; ties and undefined windows are losses."""
    return F.coalesce(F.col("dynamic_percentile") > F.col("uniform_percentile"), F.lit(False))


def _decay_sum() -> tuple[Column, Column]:
    weight = F.pow(F.lit(EXP_DECAY), F.col("_age").cast("double"))
    return F.sum(F.col("dynamic_percentile") * weight), F.sum(weight)


def _with_age(spd: DataFrame, keys: Keys) -> DataFrame:
    """Windows counted back from the newest, which has age 0."""
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("window_start"), F.desc("window_end"))
    return spd.withColumn("_age", F.row_number().over(newest_first) - 1)


def _decay_column() -> Column:
    weighted, total = _decay_sum()
    complete = F.count("dynamic_percentile") == F.count(F.lit(1))
    return F.when(complete, weighted / total)


def exp_decay_percentile(spd: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Mean percentile with weights 0.9^age; missing if any window is undefined."""
    return _with_age(spd, keys).groupBy(*keys).agg(_decay_column().alias("exp_decay_percentile"))


def spd_summary(spd: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """min/max/mean/median of the dynamic SPD and of its percentile."""
    stats = []
    for column, name in (("dynamic_sats_per_dollar", "spd"), ("dynamic_percentile", "percentile")):
        for fn, label in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"), (F.median, "median")):
            stats.append(fn(column).alias(f"{name}_{label}"))
    return spd.groupBy(*keys).agg(*stats)


def score_metrics(spd: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """The twelve score metrics, one row per series."""
    uniform = F.col("uniform_percentile")
    excess = F.col("dynamic_percentile") - uniform
    relative = excess / F.when(uniform == 0, F.lit(0.01)).otherwise(uniform) * 100
    ratio = float_div(F.col("dynamic_percentile"), uniform)
    totals = (
        _with_age(spd, keys)
        .groupBy(*keys)
        .agg(
            (F.avg(_won().cast("double")) * 100).alias("win_rate"),
            _decay_column().alias("exp_decay_percentile"),
            F.avg(excess).alias("mean_excess"),
            F.median(excess).alias("median_excess"),
            F.avg(relative).alias("relative_improvement_pct_mean"),
            F.median(relative).alias("relative_improvement_pct_median"),
            F.avg(ratio).alias("mean_ratio"),
            F.median(ratio).alias("median_ratio"),
            F.count(F.lit(1)).alias("total_windows"),
            F.count_if(_won()).alias("wins"),
        )
    )
    score = 0.5 * F.col("win_rate") + 0.5 * F.col("exp_decay_percentile")
    return totals.withColumn("score", score).withColumn(
        "losses", F.col("total_windows") - F.col("wins")
    ).select(*keys, *METRICS)


def win_loss(spd: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """(outcome, windows, percentage), two rows per series."""
    counts = spd.groupBy(*keys).agg(
        F.count_if(_won()).alias("_wins"), F.count(F.lit(1)).alias("_all")
    )
    outcomes = F.inline(
        F.array(
            F.struct(F.lit("Wins").alias("outcome"), F.col("_wins").alias("windows")),
            F.struct(F.lit("Losses").alias("outcome"), (F.col("_all") - F.col("_wins")).alias("windows")),
        )
    )
    return counts.select(*keys, "_all", outcomes).select(
        *keys, "outcome", "windows", (F.col("windows") / F.col("_all") * 100).alias("percentage")
    )


def under_performers(spd: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Windows where the dynamic plan was strictly worse, with the difference."""
    return spd.where(F.col("dynamic_percentile") < F.col("uniform_percentile")).select(
        *keys,
        "window",
        "dynamic_percentile",
        "uniform_percentile",
        (F.col("dynamic_percentile") - F.col("uniform_percentile")).alias("delta"),
    )
