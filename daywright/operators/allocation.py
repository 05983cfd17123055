"""Budget weights inside windows.

The weight of a day is its multiplier relative to the mean of the multipliers seen so far in
the window, divided by the number of days. Weights of past days are never raised above their
share of the budget, future days get equal shares, and the last day takes what remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywright.functions.numeric import INF, finite_or, float_div
from daywright.operators.rolling import DEFAULT_KEYS, Keys, running
from daywright.operators.windows import WINDOW_KEYS
from daywright.settings import BUDGET_SLACK


def _in_window(keys: Keys):
    """Rows of one window of one series.

    The dates come first: they tell rows apart in the sort prefix, series names do not.
    """
    return Window.partitionBy(*reversed(WINDOW_KEYS), *keys)


def with_stable_signal(
    expanded: DataFrame, multiplier: str = "multiplier", keys: Keys = DEFAULT_KEYS
) -> DataFrame:
    """Add ``signal``: the multiplier over its running mean, 1 where that is undefined."""
    mean_so_far = F.avg(multiplier).over(running(_in_window(keys).orderBy("date")))
    return (
        expanded.withColumn("_so_far", mean_so_far)
        .withColumn("signal", finite_or(float_div(F.col(multiplier), F.col("_so_far")), 1.0))
        .drop("_so_far")
    )


def past_days(window_start: Column, window_end: Column, current_date: Column) -> Column:
    """Days of a window up to and including the current date."""
    return F.greatest(
        F.datediff(F.least(current_date, window_end), window_start) + 1, F.lit(0)
    )


def allocate(
    expanded: DataFrame,
    multiplier: str = "multiplier",
    keys: Keys = DEFAULT_KEYS,
    n_past: Column | None = None,
    locked: str | None = None,
) -> DataFrame:
    """Add ``weight``; weights of a window sum to 1.

    ``n_past`` counts the leading days that are already decided (default: all of them).
    ``locked`` names a column with stored weights; they are used only if every past day of
    the window has one.
    """
    group = _in_window(keys)
    ordered = group.orderBy("date")
    base = with_stable_signal(expanded, multiplier, keys).withColumns(
        {
            "_i": F.row_number().over(ordered),
            "_n": F.count(F.lit(1)).over(group),
            "_k": F.lit(None).cast("int") if n_past is None else n_past.cast("int"),
        }
    )
    base = base.withColumn("_k", F.least(F.coalesce("_k", "_n"), F.col("_n")))
    past = F.col("_i") <= F.col("_k")
    computed = F.col("signal") / F.col("_n")
    if locked is None:
        base = base.withColumn("_u", F.when(past, computed))
    else:
        stored = F.count(F.when(past, F.col(locked))).over(group)
        base = base.withColumn(
            "_u", F.when(past, F.when(stored >= F.col("_k"), F.col(locked)).otherwise(computed))
        )
    budget = F.col("_k") / F.col("_n")
    spent = F.col("_spent")
    scale = F.when(spent > budget + BUDGET_SLACK, budget / spent).otherwise(1.0)
    base = base.withColumn("_spent", F.coalesce(F.sum("_u").over(group), F.lit(0.0)))
    base = base.withColumn("_w", F.when(past, F.col("_u") * scale).otherwise(1.0 / F.col("_n")))
    is_last = F.col("_i") == F.col("_n")
    others = F.coalesce(F.sum(F.when(~is_last, F.col("_w"))).over(group), F.lit(0.0))
    weight = (
        F.when(F.col("_k") <= 0, 1.0 / F.col("_n"))
        .when(is_last, F.greatest(1.0 - others, F.lit(0.0)))
        .otherwise(F.col("_w"))
    )
    return base.withColumn("weight", weight).drop(
        "signal", "_i", "_n", "_k", "_u", "_spent", "_w"
    )


def window_totals(
    expanded: DataFrame,
    multiplier: str = "multiplier",
    rate: str = "rate",
    keys: Keys = DEFAULT_KEYS,
) -> DataFrame:
    """Per-window totals when every day is past, without building the weights.

    ``allocate`` followed by ``sum(weight * rate)`` needs three passes over the expanded rows;
    the sum is linear in the signals, so the pieces below are enough to finish it once per
    window.
    """
    rows = with_stable_signal(expanded, multiplier, keys)
    signal, bought = F.col("signal"), F.col("signal") * F.col(rate)
    totals = rows.groupBy(*keys, *WINDOW_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(signal).alias("_all"),
        F.sum(bought).alias("_bought"),
        F.max_by(signal, "date").alias("_last"),
        F.max_by(rate, "date").alias("_last_rate"),
        F.min(rate).alias("min_rate"),
        F.max(rate).alias("max_rate"),
        F.avg(rate).alias("uniform_rate"),
    )
    over_budget = F.col("_all") / F.col("n") > 1.0 + BUDGET_SLACK
    unit = F.when(over_budget, 1.0 / F.col("_all")).otherwise(1.0 / F.col("n"))
    final = F.greatest(1.0 - unit * (F.col("_all") - F.col("_last")), F.lit(0.0))
    # The last day is taken out of the signal total and put back with its own weight.
    correction = (final - unit * F.col("_last")) * F.col("_last_rate")
    dynamic = F.coalesce(unit * F.col("_bought"), F.lit(0.0)) + F.coalesce(correction, F.lit(0.0))
    return totals.select(
        *keys,
        *WINDOW_KEYS,
        "min_rate",
        "max_rate",
        "uniform_rate",
        F.when(F.col("max_rate") == INF, INF).otherwise(dynamic).alias("dynamic_rate"),
        (unit * (F.col("_all") - F.col("_last")) + final).alias("weight_sum"),
    )
