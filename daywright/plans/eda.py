"""Exploratory report over the daily table and the market tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywright.operators import profile


def eda_report(
    daily: DataFrame | None = None, tables: dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Tables of the report; a part is left out when its input or columns are absent."""
    tables = tables or {}
    out: dict[str, DataFrame | None] = {}
    if daily is not None:
        if any(c in daily.columns for c in profile.DESCRIBE_COLUMNS):
            out["describe"] = profile.describe(daily)
        if sum(c in daily.columns for c in profile.CORRELATION_COLUMNS) >= 2:
            out["correlation"] = profile.correlation_matrix(daily)
        out["price_series"] = profile.price_series(daily)
    markets = tables.get("markets")
    out["market_totals"] = profile.market_totals(
        markets, tables.get("odds_history"), tables.get("summary")
    )
    if markets is not None and {"category", "volume"} <= set(markets.columns):
        out["top_categories"] = profile.top_categories(markets)
    return {name: table for name, table in out.items() if table is not None}


def eda_table(
    daily: DataFrame | None = None,
    tables: dict[str, DataFrame] | None = None,
    described: Sequence[str] = profile.DESCRIBE_COLUMNS,
    correlated: Sequence[str] = profile.CORRELATION_COLUMNS,
    top: int = 10,
) -> DataFrame | None:
    """The whole report as one table (part, name, field, value) of one lazy plan.

    Each input is read once: counts, moments and all correlations of the daily table come from one
    aggregate, totals and categories of the markets from one grouping by category and by nothing.
    Only the quartiles read on: four narrowing rounds.
    """
    tables = tables or {}
    parts: list[DataFrame] = []
    if daily is not None:
        described = [c for c in described if c in daily.columns]
        correlated = [c for c in correlated if c in daily.columns]
        if described or len(correlated) > 1:
            parts.append(_daily_numbers(daily, described, correlated if len(correlated) > 1 else []))
        if described:
            quartiles = profile.exact_quantiles(daily, described)
            field = F.format_string("p%.0f", F.col("p") * 100)
            parts.append(quartiles.select(F.lit("describe").alias("part"), F.col("metric").alias("name"), field.alias("field"), "value"))
    if (markets := tables.get("markets")) is not None:
        parts.append(_market_numbers(markets, top))
    if (odds := tables.get("odds_history")) is not None:
        parts.append(odds.agg(F.array(_cell("totals", "all", "odds_records", F.count(F.lit(1)))).alias("_c")).select(F.inline("_c")))
    if (summary := tables.get("summary")) is not None and "trade_count" in summary.columns:
        traded = F.coalesce(F.sum("trade_count"), F.lit(0))
        parts.append(summary.agg(F.array(_cell("totals", "all", "total_trades", traded)).alias("_c")).select(F.inline("_c")))
    out = parts[0] if parts else None
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _cell(part: str, name: str | Column, field: str, value: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(
        F.lit(part).alias("part"), name.alias("name"), F.lit(field).alias("field"), value.cast("double").alias("value")
    )


def _daily_numbers(daily: DataFrame, described: Sequence[str], correlated: Sequence[str]) -> DataFrame:
    numbers = {
        "count": F.count,
        "null_count": lambda c: F.count_if(c.isNull()),
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }
    cells = [_cell("describe", c, field, fn(F.col(c).cast("double"))) for c in described for field, fn in numbers.items()]
    for a, b in combinations_with_replacement(correlated, 2):
        value = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
        cells += [_cell("correlation", left, right, value) for left, right in sorted({(a, b), (b, a)})]
    return daily.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def _market_numbers(markets: DataFrame, top: int) -> DataFrame:
    """Totals of the markets and the categories of the greatest volume; a missing category is its own."""
    columns = set(markets.columns)
    category = F.col("category") if "category" in columns else F.lit(None).cast("string")
    volume = F.col("volume").cast("double") if "volume" in columns else F.lit(None).cast("double")
    active = F.col("active") if "active" in columns else F.lit(None).cast("boolean")
    slim = markets.select(category.alias("category"), volume.alias("volume"), active.alias("active"))
    sets = slim.rollup("category").agg(
        F.grouping_id().alias("_all"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("active").alias("active"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.avg("volume").alias("mean"),
    )
    place = F.row_number().over(Window.partitionBy("_all").orderBy(F.desc("volume"), F.asc_nulls_last("category")))
    ranked = sets.withColumn("_place", place).where(F.col("_place") <= top)
    totals = [_cell("totals", "all", "total_markets", F.col("n"))]
    if "active" in columns:
        totals.append(_cell("totals", "all", "active_markets", F.col("active")))
        totals.append(_cell("totals", "all", "closed_markets", F.col("n") - F.col("active")))
    if "volume" in columns:
        totals += [_cell("totals", "all", "total_volume", F.col("volume")), _cell("totals", "all", "mean_volume", F.col("mean"))]
    one = F.array(_cell("top_categories", F.col("category"), "volume", F.col("volume")))
    none = F.filter(one, lambda c: F.lit(False))
    listed = one if {"category", "volume"} <= columns else none
    return ranked.select(F.inline(F.when(F.col("_all") == 1, F.array(*totals)).otherwise(listed)))
