"""Exploratory profiles: describe, correlation, totals, top categories, roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DESCRIBE_COLUMNS = ("PriceUSD", "CapMrktCurUSD", "HashRate")
CORRELATION_COLUMNS = ("PriceUSD", "CapMrktCurUSD", "HashRate", "TxCnt")
QUARTILES = (0.25, 0.5, 0.75)

# A double has 64 bits, read 16 at a time.
RADIX_BITS, RADIX_ROUNDS = 16, 4


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def _each(columns: Sequence[str], field: Callable[[str], dict[str, Column]]) -> Column:
    """Turn one row into one row per column, with the given fields."""
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(c).alias("metric"), *[v.alias(n) for n, v in field(c).items()])
                for c in columns
            ]
        )
    )


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, x), without the missing values."""
    return df.select(_each(columns, lambda c: {"x": F.col(c).cast("double")})).where(
        F.col("x").isNotNull()
    )


def _aggregates(df: DataFrame, columns: Sequence[str], fns: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per metric from a single global aggregate."""
    row = df.agg(
        *[fn(F.col(c).cast("double")).alias(f"{c}|{name}") for c in columns for name, fn in fns.items()]
    )
    return row.select(_each(columns, lambda c: {name: F.col(f"`{c}|{name}`") for name in fns}))


def with_ordered_bits(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add a LONG in the order of the doubles, one for one (both zeros are one value; NaN comes last).

    For x > 0 it is the IEEE pattern. The exponent comes from a logarithm, set right by comparison with
    its power of two; dividing by that power leaves the mantissa without rounding. Each step is a
    projection of its own, so that nothing is computed twice.
    """
    lowest, step = -1022, 1 << 52
    x, a, guess, power = (F.col(c) for c in (column, "_a", "_guess", "_power"))
    high = (power > a) & (guess > lowest)
    low = power * 2 <= a
    sized = (
        df.withColumn("_a", F.abs(x))
        .withColumn("_guess", F.greatest(F.floor(F.log2("_a")), F.lit(lowest)))
        .withColumn("_power", F.pow(F.lit(2.0), F.col("_guess")))
        .withColumns(
            {
                "_exponent": guess + F.when(high, -1).when(low, 1).otherwise(0),
                "_unit": power * F.when(high, 0.5).when(low, 2.0).otherwise(1.0),
            }
        )
    )
    # The bias is 1023, but the mantissa's leading one counts as a step too; subnormals have none.
    bits = (F.col("_exponent") - lowest) * F.lit(step) + (a / F.col("_unit") * F.lit(float(step))).cast("long")
    infinite = F.lit(2047 * step)
    size = F.when(a == 0, F.lit(0).cast("long")).when(a == F.lit(float("inf")), infinite).otherwise(bits)
    with_size = sized.withColumn("_size", F.when(F.isnan(x), infinite + 1).otherwise(size))
    return with_size.withColumn(out, F.when(x < 0, -F.col("_size")).otherwise(F.col("_size"))).drop(
        "_a", "_guess", "_power", "_exponent", "_unit", "_size"
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUARTILES
) -> DataFrame:
    """(metric, p, value): the exact value nearest to position p * (n - 1), counting from 0.

    A radix selection. ``percentile`` would gather all distinct values of a column in one task. Here
    each of four rounds counts 16 bits of the order-preserving image of the values (combined before
    the shuffle), keeps the digit that holds the wanted rank, and narrows to the values with that
    digit. After 64 bits one value is left, however the values are spread. No values are ordered,
    only at most 65,536 counts a metric and rank; later rounds read what is between two values.
    """
    values = _values(df, columns)
    counted = _running(_digits(values, ["metric"], 0), ["metric"])
    total = Window.partitionBy("metric")
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    ranked = counted.withColumn("_n", F.max("_upto").over(total)).withColumn("p", wanted)
    bounds = _holding(ranked.withColumn("rank", F.floor(F.col("p") * (F.col("_n") - 1) + 0.5) + 1))
    for done in range(1, RADIX_ROUNDS):
        # One row a metric and rank: as few as the arguments name.
        inside = values.join(F.broadcast(bounds), "metric").where(F.col("x").between(F.col("lo"), F.col("hi")))
        bounds = _holding(_running(_digits(inside, ["metric", "p", "rank"], done), ["metric", "p"]))
    return bounds.select("metric", "p", F.col("lo").alias("value"))


def _digits(rows: DataFrame, by: list[str], done: int) -> DataFrame:
    """Rows, least and greatest value of each digit after ``done`` digits."""
    shift = 64 - RADIX_BITS * (done + 1)
    digit = F.shiftright("_bits", shift)
    if done:  # the first digit keeps the sign
        digit = digit.bitwiseAND(F.lit((1 << RADIX_BITS) - 1))
    return with_ordered_bits(rows, "x", "_bits").groupBy(*by, digit.alias("digit")).agg(
        F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )


def _running(digits: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    return digits.withColumn("_upto", F.sum("c").over(order))


def _holding(digits: DataFrame) -> DataFrame:
    """The digit that holds each wanted rank, with the rank counted inside it."""
    before = F.col("_upto") - F.col("c")
    return digits.where((before < F.col("rank")) & (F.col("rank") <= F.col("_upto"))).select(
        "metric", "p", "lo", "hi", (F.col("rank") - before).alias("rank")
    )


def describe(df: DataFrame, columns: Sequence[str] = DESCRIBE_COLUMNS) -> DataFrame:
    """One row per metric: count, nulls, mean, std, min, quartiles, max.

    Quartiles are values that occur in the data, by the nearest position.
    """
    columns = _present(df, columns)
    basics = _aggregates(
        df,
        columns,
        {
            "count": F.count,
            "null_count": lambda c: F.count_if(c.isNull()),
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": F.min,
            "max": F.max,
        },
    )
    quartiles = (
        exact_quantiles(df, columns)
        .groupBy("metric")
        .agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p * 100:.0f}") for p in QUARTILES])
    )
    return basics.join(quartiles, "metric", "left").select(
        "metric", "count", "null_count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] = CORRELATION_COLUMNS) -> DataFrame:
    """Long Pearson matrix (metric_a, metric_b, correlation), pairwise-complete, one pass."""
    columns = _present(df, columns)
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        for left, right in {(a, b), (b, a)}:
            cells.append(
                F.struct(
                    F.lit(left).alias("metric_a"),
                    F.lit(right).alias("metric_b"),
                    F.col(f"`{a}|{b}`").alias("correlation"),
                )
            )
    return one.select(F.inline(F.array(*cells)))


def market_totals(
    markets: DataFrame | None = None, odds: DataFrame | None = None, summary: DataFrame | None = None
) -> DataFrame | None:
    """(name, value) totals of the tables and columns that are present."""
    parts = []
    if markets is not None:
        aggs = {"total_markets": F.count(F.lit(1)).cast("double")}
        if "active" in markets.columns:
            aggs["active_markets"] = F.count_if(F.col("active")).cast("double")
            aggs["closed_markets"] = (F.count(F.lit(1)) - F.count_if(F.col("active"))).cast("double")
        if "volume" in markets.columns:
            aggs["total_volume"] = F.coalesce(F.sum("volume"), F.lit(0.0))
            aggs["mean_volume"] = F.avg("volume")
        parts.append(_totals(markets, aggs))
    if odds is not None:
        parts.append(_totals(odds, {"odds_records": F.count(F.lit(1)).cast("double")}))
    if summary is not None and "trade_count" in summary.columns:
        trades = F.coalesce(F.sum("trade_count"), F.lit(0)).cast("double")
        parts.append(_totals(summary, {"total_trades": trades}))
    if not parts:
        return None
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _totals(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    row = df.agg(*[c.alias(n) for n, c in aggs.items()])
    return row.unpivot([], list(aggs), "name", "value")


def top_categories(markets: DataFrame, limit: int = 10) -> DataFrame:
    """Categories with the greatest total volume; a missing category is its own group."""
    return (
        markets.groupBy("category")
        .agg(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))
        .orderBy(F.desc("volume"), F.asc_nulls_last("category"))
        .limit(limit)
    )


def price_series(daily: DataFrame, time: str = "time", price: str = "PriceUSD") -> DataFrame | None:
    if time not in daily.columns or price not in daily.columns:
        return None
    return daily.select(time, price).orderBy(time)


def last_price(daily: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    return daily.groupBy(*keys).agg(
        F.max("date").alias("last_date"), F.max_by("price", "date").alias("last_price")
    )


def _nested(field: T.StructField) -> bool:
    """Columns whose values have no order or no text of their own."""
    return isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType, T.BinaryType))


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column_name, distinct_count) of the plain columns: values are made distinct before they are counted.

    A column without values counts 0.
    """
    plain = [f.name for f in df.schema.fields if not _nested(f)]
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in plain], "column_name string")
    if not plain:
        return names.withColumn("distinct_count", F.lit(0).cast("long"))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(_quoted(c)).cast("string").alias("value")) for c in plain])
    values = df.select(F.inline(cells)).where("value is not null").distinct()
    counts = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    return names.join(counts, "column_name", "left").fillna(0, ["distinct_count"])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column: type, rows, nulls, null share, min, max and the number of distinct values.

    That number is an estimate (``distinct_estimate``), or with ``exact`` counted in one more pass
    (``distinct_count``: 0 for a column without values, null for a nested one).
    """
    stats = []
    for field in df.schema.fields:
        c = F.col(_quoted(field.name))
        low, high = (F.lit(None), F.lit(None)) if _nested(field) else (F.min(c), F.max(c))
        about = F.lit(None).cast("long") if exact or _nested(field) else F.approx_count_distinct(c)
        stats.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(c.isNull()).alias("null_count"),
                low.cast("string").alias("min_value"),
                high.cast("string").alias("max_value"),
                about.alias("distinct_estimate"),
            )
        )
    row = df.agg(F.array(*stats).alias("_stats"))
    out = row.select(F.inline("_stats")).withColumn(
        "null_share", F.try_divide(F.col("null_count"), F.col("row_count"))
    )
    return out.drop("distinct_estimate").join(distinct_counts(df), "column_name", "left") if exact else out


# --- roll-ups of the market tables -------------------------------------------------------


def event_rollup(markets: DataFrame) -> DataFrame:
    """Per event: market count, volume, first creation and last end."""
    return markets.groupBy("event_slug").agg(
        F.count("market_id").alias("market_count"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("total_volume"),
        F.min("created_at").alias("first_market_start"),
        F.max("end_date").alias("last_market_end"),
    )


def market_rollup(markets: DataFrame, tokens: DataFrame, trades: DataFrame) -> DataFrame:
    """Per market: token and trade counts, first and last trade.

    Tokens and trades are reduced to one row per market before they meet the market table.
    """
    per_token = tokens.groupBy("market_id").agg(F.count("token_id").alias("token_count"))
    per_trade = trades.groupBy("market_id").agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.min("timestamp").alias("first_trade"),
        F.max("timestamp").alias("last_trade"),
    )
    base = [c for c in ("market_id", "question", "slug", "volume", "active") if c in markets.columns]
    return (
        markets.select(*base)
        .join(per_token, "market_id", "left")
        .join(per_trade, "market_id", "left")
        .fillna(0, ["token_count", "trade_count"])
    )


def link_trades(trades: DataFrame, tokens: DataFrame, markets: DataFrame) -> DataFrame:
    """Trades with the outcome of their token and the question and event of their market.

    Tokens and markets have one row per key; a market with very many trades is split by
    adaptive skew handling on the trade side.
    """
    token = tokens.select("market_id", "token_id", "outcome")
    market = markets.select("market_id", "question", "event_slug")
    return trades.join(token, ["market_id", "token_id"], "left").join(market, "market_id", "left")

