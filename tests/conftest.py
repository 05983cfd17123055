"""Shared session and small deterministic tables."""

from __future__ import annotations

import os
import sys
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "2")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def price_walk(start="2020-01-01", end="2022-12-31", shift=0) -> pd.DataFrame:
    """A rising price with two seasons and jitter from a multiplicative sequence; no random numbers."""
    dates = pd.date_range(start, end, freq="D")
    t = np.arange(len(dates)) + 17 * shift
    jitter = (t * 7919 + 13) % 1009 / 1009 - 0.5
    price = (240 + 1.7 * t) * (1 + 0.3 * np.cos(t / 41) + 0.12 * np.sin(t / 6.5) + 0.09 * jitter)
    mvrv = 1.9 + 0.9 * np.sin(t / 83) + 0.4 * ((t * 6101 + 5) % 997 / 997 - 0.5)
    return pd.DataFrame({"series_id": "BTC", "date": dates.date, "price": price, "mvrv": mvrv})


DAILY_SCHEMA = "series_id string, date date, price double, mvrv double"


def as_daily(spark, pdf: pd.DataFrame):
    rows = [
        tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r)
        for r in pdf[["series_id", "date", "price", "mvrv"]].itertuples(index=False)
    ]
    return spark.createDataFrame(rows, DAILY_SCHEMA)


@pytest.fixture(scope="session")
def walk() -> pd.DataFrame:
    return price_walk()


@pytest.fixture(scope="session")
def daily(spark, walk):
    return as_daily(spark, walk).cache()


def sequential_weights(multipliers, n_past, stored=None) -> np.ndarray:
    """Weights of one window in exact fractions: what the library is checked against."""
    values = [Fraction(float(v)) for v in multipliers]
    share = Fraction(1, len(values))
    past = max(0, min(n_past, len(values)))
    if stored is not None and len(stored) >= past:
        head = [Fraction(float(v)) for v in stored[:past]]
    else:
        totals = list(accumulate(values))
        head = [share * (v * i / t if t else 1) for i, (v, t) in enumerate(zip(values, totals), 1)][:past]
    excess = sum(head) - past * share
    if past and excess > Fraction(1, 10**10):
        head = [h * past * share / sum(head) for h in head]
    tail = [share] * (len(values) - past)
    if past:
        body = (head + tail)[:-1]
        tail, head = [max(1 - sum(body), Fraction(0))], body
    return np.array([float(w) for w in head + tail])
