"""Stress and point-in-time transforms of a daily table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywright.functions.numeric import as_column
from daywright.operators.rolling import DEFAULT_KEYS, Keys, by_date


def _day(d) -> Column:
    return as_column(d).cast("date")


def truncate_after(daily: DataFrame, day) -> DataFrame:
    """The table as it was known at the end of ``day``."""
    return daily.where(F.col("date") <= _day(day))


def mask_after(daily: DataFrame, day, columns: Sequence[str]) -> DataFrame:
    """Keep every row but blank the values after ``day``."""
    known = F.col("date") <= _day(day)
    return daily.withColumns({c: F.when(known, F.col(c)) for c in columns})


def known_at_probes(daily: DataFrame, probes: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """For each probe date the rows of its series up to it; adds ``probe``.

    The probes of a series are one array row; a day is copied to those that are not before it.
    """
    lists = probes.groupBy(*keys).agg(F.collect_set("probe").alias("_probes"))
    later = F.filter("_probes", lambda p: p >= F.col("date"))
    return daily.join(lists, list(keys)).withColumn("probe", F.explode(later)).drop("_probes")


def masked_at_probes(
    daily: DataFrame, probes: DataFrame, columns: Sequence[str], keys: Keys = DEFAULT_KEYS
) -> DataFrame:
    """One masked copy of its series per probe date; adds ``probe``.

    The probe list of a series (about fifty dates) is one array row, joined on the series
    keys and exploded: an equi-join, not a cross product of tables.
    """
    lists = probes.groupBy(*keys).agg(F.collect_set("probe").alias("_probes"))
    copies = daily.join(lists, list(keys)).withColumn("probe", F.explode("_probes")).drop("_probes")
    return mask_after(copies, F.col("probe"), columns)


def change_from(
    daily: DataFrame,
    day,
    change: Callable[[Column], Column],
    columns: Sequence[str] = ("price",),
    keys: Keys = DEFAULT_KEYS,
) -> DataFrame:
    """Change prices from a date on; a series without a row on that date is unchanged."""
    has_day = F.max(F.col("date") == _day(day)).over(Window.partitionBy(*keys))
    hit = has_day & (F.col("date") >= _day(day))
    return daily.withColumns({c: F.when(hit, change(F.col(c))).otherwise(F.col(c)) for c in columns})


def spike(daily: DataFrame, day, factor: float = 10.0, **kw) -> DataFrame:
    return change_from(daily, day, lambda c: c * factor, **kw)


def crash(daily: DataFrame, day, factor: float = 10.0, **kw) -> DataFrame:
    return change_from(daily, day, lambda c: c / factor, **kw)


def constant_price(daily: DataFrame, value: float = 50000.0, columns: Sequence[str] = ("price",)) -> DataFrame:
    return daily.withColumns({c: F.lit(float(value)) for c in columns})


def scale_second_half(daily: DataFrame, factor: float = 10.0, columns: Sequence[str] = ("price",), keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Multiply the second half of the rows of each series."""
    position = F.row_number().over(by_date(keys)) - 1
    half = F.floor(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / 2)
    late = position >= half
    return daily.withColumns({c: F.when(late, F.col(c) * factor).otherwise(F.col(c)) for c in columns})


def shuffle_prices(daily: DataFrame, seed: int = 42, column: str = "price", keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Permute the prices of a series over its dates.

    The order comes from a hash of date and seed, so a re-run task gives the same permutation.
    """
    mixed = F.md5(F.concat_ws("|", F.date_format("date", "yyyy-MM-dd"), F.lit(str(seed))))
    slot = F.row_number().over(by_date(keys))
    drawn = F.row_number().over(Window.partitionBy(*keys).orderBy(mixed, "date"))
    prices = daily.select(*keys, drawn.alias("_slot"), F.col(column).alias("_price"))
    return (
        daily.withColumn("_slot", slot)
        .join(prices, [*keys, "_slot"])
        .withColumn(column, F.col("_price"))
        .drop("_slot", "_price")
        .select(*daily.columns)
    )
