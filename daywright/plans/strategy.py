"""Strategies: how features become weights."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from daywright.operators.rolling import DEFAULT_KEYS, Keys
from daywright.operators.windows import BLOCK, WINDOW_KEYS
from daywright.plans import features as feat


@dataclass(frozen=True)
class Strategy:
    """A multiplier strategy.

    ``features(daily, keys)`` builds the signal table, ``multiplier(features)`` adds the column
    ``multiplier``, ``gap`` holds the signals of a calendar day without data and ``price`` names
    the observed price in the signal table.
    """

    label: str
    features: Callable[[DataFrame, Keys], DataFrame]
    multiplier: Callable[[DataFrame], DataFrame]
    gap: Mapping[str, float] = field(default_factory=dict)
    price: str = "price"


def baseline_strategy(since: str | None = feat.EARLIEST_PRICE_DATE) -> Strategy:
    return Strategy(
        label="Dynamic DCA",
        features=lambda daily, keys: feat.baseline_features(daily, keys, since),
        multiplier=feat.with_baseline_multiplier,
        gap=feat.BASELINE_GAP,
    )


def extended_strategy(
    markets: DataFrame | None = None,
    pattern: str = feat.MARKET_TEXT_PATTERN,
    since: str | None = feat.EARLIEST_PRICE_DATE,
) -> Strategy:
    return Strategy(
        label="Extended DCA",
        features=lambda daily, keys: feat.extended_features(daily, markets, pattern, keys, since),
        multiplier=feat.with_extended_multiplier,
        gap=feat.EXTENDED_GAP,
        price="observed_price",
    )


def aligned(weigh: Callable[[pd.DataFrame], pd.Series], window: pd.DataFrame) -> np.ndarray:
    """The function's weights in the order of the window's days."""
    dated = window.set_axis(pd.DatetimeIndex(pd.to_datetime(window["date"]), name=None))
    result = weigh(dated)
    if isinstance(result, pd.Series):
        return result.reindex(dated.index).fillna(0.0).to_numpy(dtype=float)
    result = np.asarray(result, dtype=float)
    if result.shape != (len(window),):
        raise ValueError(f"{result.shape} weights for a window of {len(window)} days")
    return result


def python_weights(
    expanded: DataFrame,
    weigh: Callable[[pd.DataFrame], pd.Series],
    keys: Keys = DEFAULT_KEYS,
    carry: tuple[str, ...] = ("rate",),
) -> DataFrame:
    """Weights from a user function that sees one window as a date-sorted pandas frame.

    Python gets one block of windows of one series at a time (at most ``block_days`` windows),
    placed there by the expansion already, so no rows move. Prefer a multiplier strategy
    where one can be written. The frame is indexed by date, and a Series that comes back is
    aligned by its index: a day that it leaves out has weight 0, days outside the window are
    ignored. Anything without an index must have one number a day.
    """
    ids = [*keys, *WINDOW_KEYS]
    out = [*ids, "date", *carry]
    schema = T.StructType([expanded.schema[c] for c in out] + [T.StructField("weight", T.DoubleType())])

    def run(block: pd.DataFrame) -> pd.DataFrame:
        bounds = ["window_start", "window_end"]
        block = block.sort_values([*bounds, "date"], ignore_index=True)
        parts = [aligned(weigh, window) for _, window in block.groupby(bounds, sort=False, dropna=False)]
        return block[out].assign(weight=np.concatenate(parts))

    return expanded.groupBy(*keys, BLOCK).applyInPandas(run, schema)
