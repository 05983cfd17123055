"""Calendar completion, re-indexing and date-set operations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daywright.functions.numeric import as_column
from daywright.operators.rolling import DEFAULT_KEYS, Keys, by_date


def fill_gaps(
    days: DataFrame,
    defaults: Mapping[str, float | None],
    keys: Keys = DEFAULT_KEYS,
    span: tuple[str, str] | None = None,
) -> DataFrame:
    """Add the absent calendar days of each series with placeholder values.

    Each present row generates itself and the gap after it (``lead`` + ``explode``), so there
    is no calendar join and no further exchange. Columns not in ``defaults`` become NULL on
    gap days.

    ``reach_from``/``reach_to`` hold the nearest present days around a row. A window may use
    the row only if it covers both: a gap day at the edge of a window does not belong to it.
    With ``span`` the calendar is nominal: it also runs from span start to span end, and every
    day stands for itself.
    """
    spec = by_date(keys)
    here, nxt = F.col("date"), F.lead("date").over(spec)
    if span is None:
        first, last = here, F.coalesce(F.date_sub(nxt, 1), here)
    else:
        start, end = (F.lit(d).cast("date") for d in span)
        first = F.when(F.lag("date").over(spec).isNull(), F.least(here, start)).otherwise(here)
        last = F.when(nxt.isNull(), F.greatest(here, end)).otherwise(F.date_sub(nxt, 1))
    payload = [c for c in days.columns if c not in keys and c != "date"]
    spread = (
        days.withColumns({"_first": first, "_last": last, "_next": nxt})
        .withColumn("_day", F.explode(F.sequence("_first", "_last")))
    )
    present = F.col("_day") == here
    values = [
        F.when(present, F.col(c)).otherwise(as_column(defaults.get(c)).cast(days.schema[c].dataType)).alias(c)
        for c in payload
    ]
    if span is None:
        reach = [here.alias("reach_from"), F.when(present, here).otherwise(F.col("_next")).alias("reach_to")]
    else:
        reach = [F.col("_day").alias("reach_from"), F.col("_day").alias("reach_to")]
    return spread.select(*keys, F.col("_day").alias("date"), *values, *reach)


def reindex(
    index: DataFrame, sparse: DataFrame, column: str, fill, on: list[str] | str = "date"
) -> DataFrame:
    """Left join of a sparse column onto an index; only *absent* keys get ``fill``."""
    on = [on] if isinstance(on, str) else list(on)
    tagged = sparse.select(*on, column, F.lit(True).alias("_hit"))
    return (
        index.join(tagged, on, "left")
        .withColumn(column, F.when(F.col("_hit"), F.col(column)).otherwise(as_column(fill)))
        .drop("_hit")
    )


def absent_dates(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return wanted.select(*on).join(present.select(*on), on, "left_anti")


def common_dates(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on).join(b.select(*on), on, "left_semi").distinct()


def union_rows(real: DataFrame, placeholders: DataFrame) -> DataFrame:
    return real.unionByName(placeholders, allowMissingColumns=True)
