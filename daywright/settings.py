"""Model parameters and the session settings the jobs read."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

# They must stay as they are for results to be comparable.
BACKTEST_START = "2018-01-01"
BACKTEST_END = "2025-12-31"
WINDOW_MONTHS = 12
EARLIEST_PRICE_DATE = "2010-07-18"
UNITS_PER_COIN = 1e8
WEIGHT_SUM_ATOL = 1e-5
WEIGHT_SUM_RTOL = 1e-5
BUDGET_SLACK = 1e-10
EXP_DECAY = 0.9
VALID_TIMESTAMP_FROM = "2020-01-01"
TIMESTAMP_NAME_TOKENS = ("timestamp", "trade", "created_at", "end_date")
MARKET_TEXT_PATTERN = "Bitcoin|BTC|btc"


@dataclass(frozen=True)
class BaselineModel:
    """Moving-average model: fixed values."""

    ma_window: int = 200
    strength: float = 2.0
    exponent_limit: float = 3.0


@dataclass(frozen=True)
class ExtendedModel:
    """Valuation, trend, volatility and activity model: fixed values."""

    ma_window: int = 200
    zscore_window: int = 365
    gradient_span: int = 30
    gradient_gain: float = 2.0
    acceleration_span: int = 14
    acceleration_gain: float = 3.0
    volatility_window: int = 90
    activity_window: int = 30
    zone_deep_value: float = -2.0
    zone_value: float = -1.0
    zone_caution: float = 1.5
    zone_danger: float = 2.5
    volatility_dampening: float = 0.2
    strength: float = 5.0
    exponent_low: float = -5.0
    exponent_high: float = 100.0


SERIES = "series_id"

# Days of window starts that share one task group when windows are expanded.
WINDOW_BLOCK_DAYS = 128


def expansion_partitions(spark: SparkSession) -> int:
    """Partition count for rows that will multiply after the shuffle.

    Adaptive coalescing sees only the small rows before they multiply, so the count is
    fixed from the session instead.
    """
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, 4 * spark.sparkContext.defaultParallelism)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one in spark.checkpoint.dir, or below the warehouse where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/daywright/{name}-{uuid.uuid4().hex}"
