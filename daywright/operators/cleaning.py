"""Cleaning of the daily table and repair of timestamp columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daywright.functions.numeric import null_if_nan
from daywright.operators.ingest import read_text
from daywright.operators.rolling import DEFAULT_KEYS, Keys, by_date
from daywright.settings import BACKTEST_START, TIMESTAMP_NAME_TOKENS, VALID_TIMESTAMP_FROM


def require_columns(df: DataFrame, columns: Sequence[str], error: type[Exception] = KeyError) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise error(f"missing columns {absent}; available: {df.columns}")


def to_day(c: Column) -> Column:
    """Calendar date of an ISO text, date or timestamp value; missing if the text is no time."""
    return F.to_date(c.try_cast("timestamp_ntz"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Apply the missing-value convention to every floating column."""
    floats = {
        f.name: null_if_nan(F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def keep_last(df: DataFrame, order: str, keys: Keys = (*DEFAULT_KEYS, "date")) -> DataFrame:
    """One row per key: the one with the greatest ``order`` value.

    An aggregate, not ``row_number``: duplicates shrink on the map side, so a date repeated
    in a third of all rows costs no more than any other. ``max_by`` runs per column, because
    plain numbers stay in the hash aggregate where a struct would need a sort.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(
        *[c for c in df.columns if c != order]
    )


def clean_daily(
    raw: DataFrame,
    time: str = "time",
    price: str = "PriceUSD",
    order: str = "_ord",
    keys: Keys = DEFAULT_KEYS,
) -> DataFrame:
    """Day-normalized, de-duplicated daily table with a ``price`` column.

    ``order`` is the row's position in the source; the last row of a day wins. Rows without a
    readable time are left out.
    """
    require_columns(raw, [price], ValueError)
    require_columns(raw, [time, order, *keys])
    days = raw.withColumn("date", to_day(F.col(time)))
    if time != "date":
        days = days.drop(time)
    dated = nan_to_null(days.where(F.col("date").isNotNull()))
    return keep_last(dated, order, (*keys, "date")).withColumnRenamed(price, "price")


def missing_prices(
    daily: DataFrame, since: str = BACKTEST_START, price: str = "price", keys: Keys = DEFAULT_KEYS
) -> DataFrame:
    """Per series: rows without a price since a date, and the first such date."""
    absent = F.col(price).isNull()
    return (
        daily.where(F.col("date") >= F.lit(since).cast("date"))
        .groupBy(*keys)
        .agg(
            F.count_if(absent).alias("missing_prices"),
            F.min(F.when(absent, F.col("date"))).alias("first_missing"),
            F.max("date").alias("latest_date"),
        )
    )


def calendar_gaps(daily: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Calendar days absent between the first and last day of each series."""
    nxt = F.lead("date").over(by_date(keys))
    return (
        daily.select(*keys, "date", nxt.alias("_next"))
        .where(F.datediff("_next", "date") > 1)
        .select(
            *keys,
            F.explode(F.sequence(F.date_add("date", 1), F.date_sub("_next", 1))).alias("date"),
        )
    )


# --- timestamp columns -------------------------------------------------------------------


def timestamp_columns(df: DataFrame, tokens: Sequence[str] = TIMESTAMP_NAME_TOKENS) -> list[str]:
    """Timestamp-typed columns whose lower-cased name holds one of the tokens."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))
        and any(t in f.name.lower() for t in tokens)
    ]


def _epoch(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.expr("timestamp'1970-01-01 00:00:00Z'")


def repair_timestamps(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    valid_from: str = VALID_TIMESTAMP_FROM,
) -> DataFrame:
    """Scale columns stored 1000 times too small and blank what is still too early.

    A column is scaled only if its maximum is before ``valid_from``. The maxima come from
    one aggregate used as scalar subqueries, so the result stays a single lazy plan.
    """
    columns = timestamp_columns(df) if columns is None else list(columns)
    if not columns:
        return df
    bound = F.lit(valid_from)
    repaired = {}
    for name in columns:
        kind = df.schema[name].dataType
        floor = bound.cast(kind)
        epoch = _epoch(df, name)
        too_small = df.select((F.max(name) < floor).alias("low")).scalar()
        scaled = F.when(too_small, epoch + (F.col(name) - epoch) * 1000).otherwise(F.col(name))
        repaired[name] = scaled
    out = df.withColumns(repaired)
    return out.withColumns(
        {
            name: F.when(F.col(name) >= bound.cast(df.schema[name].dataType), F.col(name))
            for name in columns
        }
    )


def parse_text_timestamps(df: DataFrame, columns: Sequence[str] = ("created_at", "end_date")) -> DataFrame:
    """Parse the named columns to timestamps where they are still text; what can't be read is missing."""
    text = {
        c: read_text(F.col(c), "time")
        for c in columns
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)
    }
    return df.withColumns(text) if text else df


def audit_timestamps(
    tables: dict[str, DataFrame], valid_from: str = VALID_TIMESTAMP_FROM
) -> DataFrame | None:
    """Rows (table, column, pre_2020_rows, valid_rows) over all timestamp columns."""
    parts = []
    for table, df in tables.items():
        names = timestamp_columns(df)
        if not names:
            continue
        counts = df.agg(
            *[
                F.struct(
                    F.count_if(F.col(c) < F.lit(valid_from).cast(df.schema[c].dataType)).alias("pre_2020_rows"),
                    F.count(c).alias("valid_rows"),
                ).alias(c)
                for c in names
            ]
        )
        parts.append(
            counts.select(
                F.lit(table).alias("table_name"),
                F.inline(
                    F.array(
                        *[
                            F.struct(
                                F.lit(c).alias("column_name"),
                                F.col(f"`{c}`.pre_2020_rows"),
                                F.col(f"`{c}`.valid_rows"),
                            )
                            for c in names
                        ]
                    )
                ),
            )
        )
    if not parts:
        return None
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def probe_dates(daily: DataFrame, target: int = 50, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """Every k-th day of a series, k = max(days // target, 1)."""
    whole = Window.partitionBy(*keys)
    step = F.greatest(F.floor(F.col("_n") / target), F.lit(1))
    return (
        daily.select(*keys, "date")
        .withColumn("_i", F.row_number().over(by_date(keys)) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .where(F.col("_i") % step == 0)
        .select(*keys, F.col("date").alias("probe"))
    )
