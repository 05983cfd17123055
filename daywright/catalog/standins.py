"""The model's input tables, derived from the star-schema tables.

daily        orders by priority (five series) and day: mean order value is the price
mvrv         lineitem by ship day: mean value over a thousand mean quantities
markets      orders: the priority is the text, order value the volume
tokens       distinct (order, line) pairs of lineitem
trades       lineitem; odds: events
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywright.operators.cleaning import to_day
from daywright.operators.windows import RollingWindows
from daywright.plans.strategy import Strategy, baseline_strategy, extended_strategy
from daywright.settings import expansion_partitions

ACTIVITY_PATTERN = "urgent|high"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, as a source with many rows per day."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        F.col("o_orderdate").alias("time"),
        F.col("o_totalprice").alias("PriceUSD"),
        F.col("o_orderkey").alias("_ord"),
    )


def _mean_price(orders: DataFrame, series) -> DataFrame:
    return orders.groupBy(series.alias("series_id"), to_day(F.col("o_orderdate")).alias("date")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("price")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mean_price(table(spark, sf_dir, "orders"), F.col("o_orderpriority"))


def daily_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mean_price(table(spark, sf_dir, "orders"), F.lit("ALL"))


def daily_mvrv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and valuation ratio; a day without shipments has no ratio."""
    ratio = (
        table(spark, sf_dir, "lineitem")
        .groupBy(to_day(F.col("l_shipdate")).alias("date"))
        .agg((F.avg("l_extendedprice") / (F.avg("l_quantity") * 1000)).alias("mvrv"))
    )
    # One row per calendar date: the number of dates bounds the broadcast.
    return daily(spark, sf_dir).join(F.broadcast(ratio), "date", "left")


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("market_id"),
        F.col("o_orderpriority").alias("question"),
        F.concat(F.lit("order-"), F.col("o_orderkey")).alias("slug"),
        F.concat(F.lit("customer-"), F.col("o_custkey")).alias("event_slug"),
        F.col("o_totalprice").alias("volume"),
        (F.col("o_orderstatus") == "O").alias("active"),
        F.col("o_orderdate").alias("created_at"),
    )


def markets_with_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("market_id"))
        .agg(F.max("l_shipdate").alias("end_date"))
    )
    return markets(spark, sf_dir).join(ends, "market_id", "left")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("market_id"), F.col("l_linenumber").alias("token_id"), "l_returnflag"
    )
    # Nearly every row is a pair of its own: pairs are formed behind the shuffle, in parts that don't grow by coalescing.
    dealt = lines.repartition(expansion_partitions(spark), "market_id", "token_id")
    return dealt.groupBy("market_id", "token_id").agg(F.min("l_returnflag").alias("outcome"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("market_id"),
        F.col("l_linenumber").alias("token_id"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("size"),
        F.col("l_linestatus").alias("side"),
    )


def small_unit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose time is stored 1000 times too small; errors carry a zero time."""
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    shrunk = epoch + (F.col("ts").cast("timestamp_ntz") - epoch) / 1000
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.when(F.col("event_type") == "error", epoch).otherwise(shrunk).alias("timestamp"),
    )


def windows(spark: SparkSession, sf_dir: str) -> RollingWindows:
    """A window on every day of the orders' whole span, read from the table."""
    first, last = table(spark, sf_dir, "orders").agg(
        F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))
    ).first()
    return RollingWindows(first.isoformat(), last.isoformat())


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as odds; some belong to no market, some to no token, errors have no price."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + F.lit(6000)).alias("market_id"),
        (F.col("user_id") % 9).alias("token_id"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("price"),
    )


def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers say of their orders; those of one segment say nothing, those of another twice."""
    stats = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'")
    twice = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return stats.withColumn("_n", F.explode(twice)).select(
        F.concat(F.lit("customer-"), "c_custkey").alias("event_slug"),
        F.col("c_nationkey").cast("long").alias("market_count"),
        F.col("c_acctbal").alias("total_volume"),
    )


def market_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The linked tables; a market of low priority names no event."""
    orders = table(spark, sf_dir, "orders")
    slug = F.when(F.col("question") != "5-LOW", F.col("event_slug"))
    return {
        "markets": markets(spark, sf_dir).withColumn("event_slug", slug),
        "tokens": tokens(spark, sf_dir),
        "trades": trades(spark, sf_dir),
        "odds_history": odds(spark, sf_dir),
        "event_stats": event_stats(spark, sf_dir),
        "summary": orders.select((F.col("o_orderkey") * 2).alias("market_id")),
    }


def text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text: times in six layouts, some of them none, some prices no numbers."""
    kind = F.col("o_orderkey") % 8
    at = F.col("o_orderdate")
    time = (
        F.when(kind == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 1, F.date_format(at, "dd.MM.yyyy HH:mm"))
        .when(kind == 2, F.date_format(at, " MM/dd/yyyy"))
        .when(kind == 3, F.date_format(at, "yyyy/MM/dd HH:mm:ss"))
        .when(kind == 4, (F.unix_date(F.to_date(at)).cast("long") * 86400).cast("string"))
        .when(kind == 5, (F.unix_date(F.to_date(at)).cast("long") * 86400000).cast("string"))
        .when(kind == 6, F.concat(F.lit("soon-"), F.col("o_orderkey")))
        .otherwise(F.lit("N/A"))
    )
    price = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("about "), F.col("o_custkey"))).otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", time.alias("created_at"), price.alias("price"), F.col("o_custkey").cast("string").alias("customer")
    )


def baseline() -> Strategy:
    return baseline_strategy(since=None)


def extended(spark: SparkSession, sf_dir: str) -> Strategy:
    return extended_strategy(markets(spark, sf_dir), ACTIVITY_PATTERN, since=None)
