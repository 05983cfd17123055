"""Investment windows: generation, grouping and expansion of days into windows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daywright.functions.labels import window_label
from daywright.operators.rolling import DEFAULT_KEYS, Keys
from daywright.settings import (
    BACKTEST_END,
    BACKTEST_START,
    WINDOW_BLOCK_DAYS,
    WINDOW_MONTHS,
    expansion_partitions,
)

# Identity of one window of one series after expansion; ``block`` carries the partitioning.
BLOCK = "block"
WINDOW_KEYS = (BLOCK, "window_start", "window_end")

# A window as one number: first day times this, plus the days to its end. A power of two.
WINDOW_SPAN = 1 << 24


def _daily_starts(first: Column, last: Column) -> Column:
    """Every day from first to last; nothing when last is before first."""
    return F.explode(
        F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day"))).otherwise(
            F.array().cast("array<date>")
        )
    )


def windows_in_span(
    spans: DataFrame, first: str, last: str, months: int = WINDOW_MONTHS
) -> DataFrame:
    """Windows with a start on every day that still end inside the row's span."""
    start, end = F.col(first), F.col(last)
    others = [c for c in spans.columns if c not in (first, last)]
    made = spans.select(
        *others, end.alias("_end"), _daily_starts(start, F.add_months(end, -months)).alias("window_start")
    ).withColumn("window_end", F.add_months("window_start", months))
    return made.where(F.col("window_end") <= F.col("_end")).select(
        *others,
        "window_start",
        "window_end",
        window_label(F.col("window_start"), F.col("window_end")).alias("window"),
    )


@dataclass(frozen=True)
class RollingWindows:
    """A window starting on every day of a range; both ends of a window are inclusive."""

    start: str = BACKTEST_START
    end: str = BACKTEST_END
    months: int = WINDOW_MONTHS

    def table(self, spark: SparkSession) -> DataFrame:
        """(window_start, window_end, window), one row per window."""
        span = spark.range(1).select(
            F.lit(self.start).cast("date").alias("first"), F.lit(self.end).cast("date").alias("last")
        )
        return windows_in_span(span, "first", "last", self.months)


def explicit_windows(spark: SparkSession, pairs: list[tuple[date, date]]) -> DataFrame:
    """Window table from given (start, end) pairs."""
    rows = [(a, b) for a, b in pairs]
    return spark.createDataFrame(rows, "window_start date, window_end date").withColumn(
        "window", window_label(F.col("window_start"), F.col("window_end"))
    )


def ends_by_start(windows: DataFrame) -> DataFrame:
    """window_start -> ascending list of window ends."""
    return windows.groupBy("window_start").agg(
        F.array_sort(F.collect_list("window_end")).alias("window_ends")
    )


def window_days(start: Column, end: Column) -> Column:
    """Inclusive day count of a window."""
    return F.datediff(end, start) + 1


def window_number(start: Column, end: Column) -> Column:
    """A window as one LONG, in the order of starts."""
    return F.unix_date(start).cast("long") * WINDOW_SPAN + F.datediff(end, start)


def window_block(start: Column, end: Column | None = None, block_days: int = WINDOW_BLOCK_DAYS) -> Column:
    """The block that a window is expanded in: by its start, and in a table of windows by its length too.

    So a block of a table has at most ``block_days`` starts of ``block_days`` lengths, however many ends a
    start has.
    """
    block = F.floor(F.unix_date(start) / block_days)
    return block if end is None else block * WINDOW_SPAN + F.floor(F.datediff(end, start) / block_days)


def expand_windows(
    days: DataFrame,
    windows: RollingWindows | DataFrame,
    keys: Keys = DEFAULT_KEYS,
    partitions: int | None = None,
    block_days: int = WINDOW_BLOCK_DAYS,
    known: DataFrame | None = None,
) -> DataFrame:
    """Give every day a row in each window that holds it.

    A day falls in about 366 one-year windows, so the expanded rows must not be shuffled.
    Window starts are cut into blocks of ``block_days``; only the *days* are copied to the few
    blocks that need them and shuffled on (keys, block), then expanded in place. Later
    ``partitionBy`` / ``groupBy`` on (keys, block, window) reuse that partitioning. One series
    is thereby spread over many tasks; no group of rows grows beyond one block of one series.

    ``days`` needs ``reach_from``/``reach_to`` from ``fill_gaps``; ``windows`` is a rolling
    range or a table of (window_start, window_end).

    ``known`` holds a number for windows of a day, packed to one row (keys, block, date, known: map
    from ``window_number``). It meets the days before they are expanded, so what it holds is moved once
    and packed; each expanded row then looks its number up in the column ``known``.
    """
    count = partitions or expansion_partitions(days.sparkSession)

    def place(copied: DataFrame) -> DataFrame:
        if known is not None:
            copied = copied.join(known.withColumnRenamed("known", "_known"), [*keys, BLOCK, "date"], "left")
        return copied.repartition(count, *keys, BLOCK)

    if isinstance(windows, RollingWindows):
        rows = _expand_rolling(days, windows, block_days, place)
    else:
        rows = _expand_table(days, windows, block_days, place)
    if known is not None:
        number = window_number(F.col("window_start"), F.col("window_end"))
        rows = rows.withColumn("known", F.try_element_at("_known", number)).drop("_known")
    return rows.drop("reach_from", "reach_to")


def _expand_rolling(days: DataFrame, windows: RollingWindows, block_days: int, place) -> DataFrame:
    """Daily starts follow from the date by arithmetic: no window table and no join."""
    end = F.lit(windows.end).cast("date")
    first = F.greatest(F.add_months("reach_to", -windows.months), F.lit(windows.start).cast("date"))
    last = F.least(F.col("reach_from"), F.add_months(end, -windows.months))
    bounded = days.withColumns({"_first": F.unix_date(first), "_last": F.unix_date(last)})
    copied = bounded.where(F.col("_first") <= F.col("_last")).withColumn(
        BLOCK,
        F.explode(F.sequence(F.floor(F.col("_first") / block_days), F.floor(F.col("_last") / block_days))),
    )
    low = F.greatest(F.col("_first"), (F.col(BLOCK) * block_days).cast("int"))
    high = F.least(F.col("_last"), (F.col(BLOCK) * block_days + block_days - 1).cast("int"))
    return (
        place(copied)
        .withColumn("_start", F.explode(F.sequence(low, high)))
        .withColumn("window_start", F.date_from_unix_date("_start"))
        .withColumn("window_end", F.add_months("window_start", windows.months))
        # Month ends: 28 February plus a year does not reach 29 February.
        .where(F.col("window_end") >= F.col("reach_to"))
        .drop("_first", "_last", "_start")
    )


def _expand_table(days: DataFrame, windows: DataFrame, block_days: int, place) -> DataFrame:
    """Any window table: days are joined by date to the blocks that hold them, windows unfold in place.

    A block travels as one array with a number for each of its windows; only those that hold the day
    stay in it. So nothing is joined by block alone, the plan is the same at every size of the table,
    and no window row moves.
    """
    number = window_number(F.col("window_start"), F.col("window_end"))
    blocks = (
        windows.where(F.col("window_start") <= F.col("window_end"))
        .groupBy(window_block(F.col("window_start"), F.col("window_end"), block_days).alias(BLOCK))
        .agg(F.min("window_start").alias("_a"), F.max("window_end").alias("_b"), F.collect_set(number).alias("_windows"))
    )
    block_dates = blocks.select(BLOCK, "_windows", F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("date"))

    def first(n: Column) -> Column:
        return F.shiftright(n, WINDOW_SPAN.bit_length() - 1).cast("int")

    def last(n: Column) -> Column:
        return first(n) + n.bitwiseAND(F.lit(WINDOW_SPAN - 1)).cast("int")

    holding = F.filter(
        "_windows", lambda n: (first(n) <= F.unix_date("reach_from")) & (F.unix_date("reach_to") <= last(n))
    )
    copied = days.join(block_dates, "date").withColumn("_windows", holding).where(F.size("_windows") > 0)
    return (
        place(copied)
        .withColumn("_window", F.explode("_windows"))
        .withColumn("window_start", F.date_from_unix_date(first(F.col("_window"))))
        .withColumn("window_end", F.date_from_unix_date(last(F.col("_window"))))
        .drop("_windows", "_window")
    )
