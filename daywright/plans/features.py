"""Feature tables of the two models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daywright.functions import signals
from daywright.functions.numeric import clip, finite_or, neutral_when_zero
from daywright.operators import rolling as R
from daywright.operators.calendar import reindex
from daywright.operators.cleaning import require_columns
from daywright.operators.sentiment import activity_sentiment
from daywright.settings import (
    EARLIEST_PRICE_DATE,
    MARKET_TEXT_PATTERN,
    BaselineModel,
    ExtendedModel,
    expansion_partitions,
)

BASELINE_SIGNALS = ("price_vs_ma",)
EXTENDED_SIGNALS = (
    "price_vs_ma",
    "mvrv_zscore",
    "mvrv_gradient",
    "mvrv_acceleration",
    "mvrv_zone",
    "mvrv_volatility",
    "signal_confidence",
    "sentiment",
)
RANK_DIGITS = 12
# Placeholder signals of a calendar day without data.
BASELINE_GAP = {"price_vs_ma": 0.0}
EXTENDED_GAP = {
    "price_vs_ma": 0.0,
    "mvrv_zscore": 0.0,
    "mvrv_gradient": 0.0,
    "mvrv_acceleration": 0.0,
    "mvrv_zone": 0.0,
    "mvrv_volatility": 0.5,
    "signal_confidence": 0.5,
    "sentiment": 0.0,
}


def _by_series(daily: DataFrame, columns: list[str], since: str | None, keys: R.Keys) -> DataFrame:
    """The wanted columns and days, placed by series for all rolling windows that follow.

    A fixed partition count keeps adaptive coalescing from packing many series into one task:
    the rows are few bytes but each costs hundreds of frame updates.
    """
    days = daily.select(*keys, "date", *columns)
    if since is not None:
        days = days.where(F.col("date") >= F.lit(since).cast("date"))
    return days.repartition(expansion_partitions(daily.sparkSession), *keys)


def _price_signals(daily: DataFrame, ma_window: int, keys: R.Keys) -> DataFrame:
    rows = R.with_rolling_mean(daily, "price", "price_ma", ma_window, ma_window // 2, keys)
    distance = R.distance_to_mean(F.col("price"), F.col("price_ma"))
    return rows.withColumn("price_vs_ma", F.coalesce(clip(distance, -1.0, 1.0), F.lit(0.0)))


def baseline_features(
    daily: DataFrame,
    keys: R.Keys = R.DEFAULT_KEYS,
    since: str | None = EARLIEST_PRICE_DATE,
    model: BaselineModel = BaselineModel(),
) -> DataFrame:
    """(keys, date, price, price_ma, price_vs_ma); the signal is lagged by one row."""
    require_columns(daily, ["price"])
    spec = R.by_date(keys)
    rows = _price_signals(_by_series(daily, ["price"], since, keys), model.ma_window, keys)
    return rows.withColumn("price_vs_ma", R.lagged(F.col("price_vs_ma"), spec, 0.0))


def extended_features(
    daily: DataFrame,
    markets: DataFrame | None = None,
    pattern: str = MARKET_TEXT_PATTERN,
    keys: R.Keys = R.DEFAULT_KEYS,
    since: str | None = EARLIEST_PRICE_DATE,
    model: ExtendedModel = ExtendedModel(),
) -> DataFrame:
    """Baseline columns plus valuation, volatility, confidence and sentiment signals.

    Without an ``mvrv`` column or a market table the affected signals are neutral constants.
    ``price`` and ``price_ma`` are filled with 0 as the other features are; the price as it
    was observed stays in ``observed_price`` for the backtest.
    """
    require_columns(daily, ["price"])
    spec = R.by_date(keys)
    has_mvrv = "mvrv" in daily.columns
    rows = _by_series(daily, ["price", "mvrv"] if has_mvrv else ["price"], since, keys)
    rows = _price_signals(rows.withColumn("observed_price", F.col("price")), model.ma_window, keys)
    rows = _valuation_signals(rows, keys, model) if has_mvrv else _neutral_valuation(rows)
    rows = _with_sentiment(rows, markets, pattern, model)

    neutral = {"mvrv_volatility": 0.5, "sentiment": 0.5}
    lagged = {
        c: R.lagged(F.col(c).cast("double"), spec, neutral.get(c, 0.0))
        for c in EXTENDED_SIGNALS
        if c != "signal_confidence"
    }
    rows = rows.withColumns(lagged).fillna(0.0, ["price", "price_ma"])
    rows = rows.withColumn(
        "signal_confidence",
        signals.signal_confidence(F.col("mvrv_zscore"), F.col("mvrv_gradient"), F.col("price_vs_ma")),
    )
    return rows.select(*keys, "date", "price", "price_ma", *EXTENDED_SIGNALS, "observed_price")


def _valuation_signals(rows: DataFrame, keys: R.Keys, m: ExtendedModel) -> DataFrame:
    z = F.col("mvrv_zscore")
    rows = R.with_zscore(rows, "mvrv", "mvrv_zscore", m.zscore_window, keys)
    rows = rows.withColumn("mvrv_zscore", clip(z, -4.0, 4.0))
    rows = _smoothed_trend(rows, "mvrv_zscore", "mvrv_gradient", m.gradient_span, m.gradient_gain, keys)
    rows = _smoothed_trend(
        rows, "mvrv_gradient", "mvrv_acceleration", m.acceleration_span, m.acceleration_gain, keys
    )
    span = m.volatility_window
    rows = R.with_rolling_std(rows, "mvrv_zscore", "_vol", span, span // 4, keys)
    # Equal deviations over different rows differ in their last bits; they must rank equal.
    rows = rows.withColumn("_vol", F.round("_vol", RANK_DIGITS))
    rows = R.with_percent_rank(rows, "_vol", "mvrv_volatility", 4 * span, span, keys)
    return (
        rows.withColumn("mvrv_zone", signals.valuation_zone(z, m))
        .withColumn("mvrv_volatility", F.coalesce("mvrv_volatility", F.lit(0.5)))
        .drop("_vol", "mvrv")
    )


def _smoothed_trend(
    rows: DataFrame, source: str, out: str, span: int, gain: float, keys: R.Keys
) -> DataFrame:
    """tanh of the smoothed difference over ``span`` rows; missing becomes 0."""
    moved = rows.withColumn("_diff", R.difference(F.col(source), R.by_date(keys), span))
    smooth = R.with_ema(moved, "_diff", "_ema", span, keys)
    return smooth.withColumn(
        out, F.coalesce(F.tanh(F.col("_ema") * gain), F.lit(0.0))
    ).drop("_diff", "_ema")


def _neutral_valuation(rows: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return rows.withColumns(
        {
            "mvrv_zscore": zero,
            "mvrv_gradient": zero,
            "mvrv_acceleration": zero,
            "mvrv_zone": zero,
            "mvrv_volatility": F.lit(0.5),
        }
    )


def _with_sentiment(
    rows: DataFrame, markets: DataFrame | None, pattern: str, m: ExtendedModel
) -> DataFrame:
    if markets is None:
        return rows.withColumn("sentiment", F.lit(0.5))
    daily = activity_sentiment(markets, pattern, m.activity_window)
    # One row per calendar date, whatever the number of markets: dates are the size bound.
    return reindex(rows, F.broadcast(daily), "sentiment", 0.5)


def with_baseline_multiplier(features: DataFrame, model: BaselineModel = BaselineModel()) -> DataFrame:
    clean = finite_or(F.col("price_vs_ma"), 0.0)
    return features.withColumn("multiplier", signals.baseline_multiplier(clean, model))


# Signals that read an exact 0 as neutral when they are weighed.
ZERO_IS_NEUTRAL = ("mvrv_volatility", "signal_confidence", "sentiment")


def with_extended_multiplier(features: DataFrame, model: ExtendedModel = ExtendedModel()) -> DataFrame:
    """Multiplier from the signals present; absent optional columns are neutral.

    Signals are cleaned in a step of their own, so the formula refers to plain columns.
    """
    order = (
        "price_vs_ma",
        "mvrv_zscore",
        "mvrv_gradient",
        "mvrv_acceleration",
        "mvrv_volatility",
        "signal_confidence",
        "sentiment",
    )
    present = [c for c in order if c in features.columns]
    clean = features.withColumns(
        {
            f"_{c}": neutral_when_zero(F.col(c)) if c in ZERO_IS_NEUTRAL else finite_or(F.col(c), 0.0)
            for c in present
        }
    )
    values = [F.col(f"_{c}") if c in present else None for c in order]
    return clean.withColumn("multiplier", signals.extended_multiplier(*values, m=model)).drop(
        *[f"_{c}" for c in present]
    )
