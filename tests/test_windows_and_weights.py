import os
import subprocess
import sys
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daywright.functions.labels import window_label_start
from daywright.operators import locked, spd
from daywright.operators.allocation import allocate, window_totals
from daywright.operators.calendar import fill_gaps, reindex
from daywright.operators.windows import RollingWindows, ends_by_start, expand_windows, explicit_windows
from daywright.plans import backtest as B
from daywright.plans import features as feat
from daywright.plans.strategy import baseline_strategy, extended_strategy
from tests.conftest import SF_SMALL, as_daily, sequential_weights

W0, W1 = date(2022, 1, 1), date(2022, 12, 31)


def test_window_count_and_leap_day(spark):
    table = RollingWindows().table(spark)
    assert table.count() == 2557
    leap = table.where("window_start = date'2020-02-29'").first()
    assert leap.window_end == date(2021, 2, 28)
    assert leap.window == "2020-02-29 → 2021-02-28"
    assert table.where("window_start = date'2020-02-29'").select(window_label_start(F.col("window"))).first()[0] == date(2020, 2, 29)


def test_short_range_has_no_windows(spark):
    assert RollingWindows("2020-01-01", "2020-06-30").table(spark).count() == 0


def test_ends_by_start(spark):
    pairs = [(date(2020, 1, 1), date(2020, 3, 1)), (date(2020, 1, 1), date(2020, 2, 1)), (date(2020, 1, 2), date(2020, 2, 2))]
    got = {r.window_start: list(r.window_ends) for r in ends_by_start(explicit_windows(spark, pairs)).collect()}
    assert got[date(2020, 1, 1)] == [date(2020, 2, 1), date(2020, 3, 1)]
    assert len(got) == 2


def single_window(spark, values, stored=None):
    rows = [("s", 0, W0, W1, date(2022, 1, 1 + i), float(v), None if stored is None or i >= len(stored) else float(stored[i]))
            for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "series_id string, block long, window_start date, window_end date, date date, multiplier double, stored double")


def weights_of(df, **kw):
    return np.array([r.weight for r in allocate(df, **kw).orderBy("date").collect()])


@pytest.mark.parametrize(("raw", "n_past", "want"), [
    ([1, 1, 1], 0, [1 / 3] * 3),
    ([1, 2, 3, 4], 4, [0.1840, 0.2454, 0.2761, 0.2945]),
    ([4, 3, 2, 1], 4, [0.25, 0.214286, 0.166667, 0.369048]),
    ([1, 1, 1], 9, [1 / 3] * 3),
])
def test_small_allocations(spark, raw, n_past, want):
    np.testing.assert_allclose(weights_of(single_window(spark, raw), n_past=F.lit(n_past)), want, atol=1e-4)


@pytest.mark.parametrize("n_past", [0, 1, 7, 25])
@pytest.mark.parametrize("stored", [None, [0.05] * 7, [0.05], [0.5] * 25, [0.001] * 30])
def test_allocation_matches_the_rule(spark, n_past, stored):
    raw = np.exp(np.random.default_rng(42).normal(size=25))
    got = weights_of(single_window(spark, raw, stored), n_past=F.lit(n_past), locked=None if stored is None else "stored")
    np.testing.assert_allclose(got, sequential_weights(raw, n_past, stored), atol=1e-12)
    assert got.min() >= 0


def test_zero_multipliers_count_as_neutral(spark):
    np.testing.assert_allclose(weights_of(single_window(spark, [0, 0, 0, 0])), [0.25] * 4)


def rule_spd(pdf: pd.DataFrame, multiplier: pd.Series, start: str, end: str) -> dict:
    """One window by the rule, from a frame indexed by date."""
    price = pdf.price.loc[start:end]
    span = pd.date_range(price.index.min(), price.index.max())
    w = pd.Series(sequential_weights(multiplier.reindex(span).fillna(1.0), len(span)), index=span)
    inv = 1e8 / price
    lo, hi = inv.min(), inv.max()
    return {
        "uniform_percentile": (inv.mean() - lo) / (hi - lo) * 100,
        "dynamic_percentile": ((w * inv).sum() - lo) / (hi - lo) * 100,
        "dynamic_sats_per_dollar": (w * inv).sum(),
    }


@pytest.fixture(scope="module")
def gappy(walk):
    """Two series with gaps, one of them at window edges, and a few missing prices."""
    a = walk[(walk.index % 11 != 4) & ~walk.index.isin(range(360, 372))].copy()
    a.loc[a.index % 97 == 5, "price"] = np.nan
    b = walk.iloc[200:].assign(series_id="ETH", price=lambda d: d.price / 3)
    return pd.concat([a, b])


@pytest.mark.parametrize("which", ["rolling", "table"])
def test_backtest_matches_the_rule_on_every_window(spark, gappy, which):
    windows = RollingWindows("2020-06-01", "2022-08-31")
    if which == "table":
        windows = windows.table(spark)
    features = feat.baseline_features(as_daily(spark, gappy)).cache()
    strategy = baseline_strategy()
    got = B.backtest_features(features, windows, strategy).toPandas()
    mult = strategy.multiplier(features).toPandas()
    assert len(got) == 457 * 2
    assert np.allclose(got.weight_sum, 1.0, atol=1e-12)
    for series, rows in got.groupby("series_id"):
        pdf = gappy[gappy.series_id == series].set_index(pd.to_datetime(gappy[gappy.series_id == series].date)).sort_index()
        m = mult[mult.series_id == series].set_index("date").multiplier
        m.index = pd.to_datetime(m.index)
        for r in rows.sort_values("window_start").iloc[::23].itertuples():
            want = rule_spd(pdf, m, str(r.window_start), str(r.window_end))
            for name, value in want.items():
                assert getattr(r, name) == pytest.approx(value, rel=1e-9), (series, r.window, name)


def test_totals_equal_explicit_weights(spark, gappy):
    windows, strategy = RollingWindows("2020-06-01", "2022-08-31"), extended_strategy()
    features = strategy.features(as_daily(spark, gappy), ("series_id",)).cache()
    a = B.backtest_features(features, windows, strategy)
    b = spd.spd_table(spd.rates_from_weights(B.backtest_weights(features, windows, strategy)))
    both = a.alias("a").join(b.alias("b"), ["series_id", "window_start"])
    diff = both.select(F.max(F.abs(F.col("a.dynamic_sats_per_dollar") / F.col("b.dynamic_sats_per_dollar") - 1)), F.count("*")).first()
    assert diff[0] < 1e-10 and diff[1] == a.count()


def test_blocks_do_not_change_results(spark, daily):
    days = B.multiplier_days(feat.baseline_features(daily), baseline_strategy())
    sums = []
    for block in (7, 128, 1000):
        rows = expand_windows(days, RollingWindows("2020-06-01", "2022-08-31"), block_days=block)
        sums.append(window_totals(rows).agg(F.count("*"), F.round(F.sum("dynamic_rate"), 3)).first())
    assert sums[0] == sums[1] == sums[2]


def test_expanded_rows_are_not_shuffled(spark, daily):
    out = B.backtest(daily, RollingWindows("2020-06-01", "2022-08-31"), baseline_strategy())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # One exchange places the series, one the blocks; nothing after the expansion.
    assert plan.count("Exchange hashpartitioning") == 2


def test_window_tables_meet_days_by_date_and_unfold_in_place(spark, daily):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        table = explicit_windows(spark, [(date(2020, 6, 1), date(2021, 6, 1)), (date(2020, 6, 1), date(2020, 12, 1))])
        out = B.backtest(daily, table, baseline_strategy())
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and "SortMergeJoin [date#" in joins[0] and "block" not in joins[0]
    # What stands above the unfolding of the windows in the plan has no exchange.
    assert "Exchange" not in plan[: plan.index("Generate explode(_windows")]


@pytest.mark.parametrize("today", ["2022-06-15", "2022-01-01", "2022-12-31", "2021-12-01", "2023-01-15"])
def test_past_future_split(spark, daily, today):
    features = feat.baseline_features(daily)
    windows = explicit_windows(spark, [(W0, W1)])
    w = B.window_weights(features, windows, baseline_strategy(), today).orderBy("date").toPandas()
    assert len(w) == 365 and w.weight.sum() == pytest.approx(1.0, abs=1e-12) and (w.weight >= 0).all()
    past = (pd.Timestamp(today) - pd.Timestamp(W0)).days + 1
    future = w.weight.iloc[max(min(past, 365), 0):-1]
    assert np.allclose(future, 1 / 365)


def test_past_weights_do_not_move_while_under_budget(spark, daily):
    features, windows = feat.baseline_features(daily), explicit_windows(spark, [(W0, W1)])
    a = B.window_weights(features, windows, baseline_strategy(), "2022-03-01")
    b = B.window_weights(features, windows, baseline_strategy(), "2022-03-02")
    diff = a.join(b.withColumnRenamed("weight", "w2"), ["series_id", "window_start", "window_end", "date"]).where("date <= date'2022-03-01'")
    assert diff.agg(F.max(F.abs(F.col("weight") - F.col("w2")))).first()[0] < 5e-3


def test_window_beyond_the_data_gets_full_weights(spark, daily):
    windows = explicit_windows(spark, [(date(2022, 7, 1), date(2023, 7, 1)), (date(2019, 6, 1), date(2020, 6, 1))])
    w = B.window_weights(feat.baseline_features(daily), windows, baseline_strategy(), "2022-12-31")
    got = {r.window_start: (r.n, r.s) for r in w.groupBy("window_start").agg(F.count("*").alias("n"), F.sum("weight").alias("s")).collect()}
    assert got[date(2022, 7, 1)] == (366, pytest.approx(1.0)) and got[date(2019, 6, 1)] == (367, pytest.approx(1.0))


def test_locked_table_is_appended_once(spark, daily, tmp_path):
    path = str(tmp_path / "locked")
    features, windows = feat.baseline_features(daily), explicit_windows(spark, [(W0, W1)])
    for day, rows in (("2022-01-10", 10), ("2022-01-10", 10), ("2022-01-12", 12)):
        locked.append_locked(B.window_weights(features, windows, baseline_strategy(), day), path, day)
        assert spark.read.parquet(path).count() == rows
    stored = spark.read.parquet(path)
    again = B.window_weights(features, windows, baseline_strategy(), "2022-01-12", stored)
    same = locked.compare_weights(again.where("date <= date'2022-01-12'"), stored.selectExpr(
        "id series_id", "start_date window_start", "end_date window_end", "DCA_date date", "weight")).first()
    assert same.days == 12 and same.all_equal


def test_the_daily_job_stores_each_day_once(spark, daily, tmp_path):
    path, windows = str(tmp_path / "store"), RollingWindows("2021-01-01", "2022-03-31")
    run = lambda day: B.lock_day(daily, windows, baseline_strategy(), path, day)
    assert run("2021-01-10") == 10
    first = {tuple(r) for r in locked.read_store(spark, path).collect()}
    assert run("2021-01-10") == 0
    assert {tuple(r) for r in locked.read_store(spark, path).collect()} == first
    assert run("2021-01-11") == 1
    stored = locked.read_store(spark, path)
    # A row for each window that is open on the day; what was stored stays as it was.
    assert stored.where("DCA_date = date'2021-01-11'").count() == 11
    assert {tuple(r) for r in stored.where("DCA_date < date'2021-01-11'").collect()} == first
    assert stored.groupBy(*locked.LOCK_KEYS).count().where("count > 1").isEmpty()


def test_a_partly_stored_day_keeps_what_it_holds(spark, daily, tmp_path):
    path, features = str(tmp_path / "store"), feat.baseline_features(daily)
    for end in (W1, date(2022, 3, 1)):
        windows = explicit_windows(spark, [(W0, end)])
        weights = B.window_weights(features, windows, baseline_strategy(), "2022-01-03", locked.read_store(spark, path))
        assert locked.append_locked(weights, path, "2022-01-03") == 3
    assert locked.read_store(spark, path).groupBy("end_date").count().count() == 2


def test_stored_weights_move_before_days_are_expanded(spark, daily):
    windows, features = RollingWindows("2021-01-01", "2022-03-31"), feat.baseline_features(daily)
    stored = locked.to_locked(B.window_weights(features, windows, baseline_strategy(), "2021-02-01"), "2021-02-01")
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    later = B.window_weights(features, windows, baseline_strategy(), "2021-02-05", stored)
    plan = locked.new_locked(later, "2021-02-05")._jdf.queryExecution().executedPlan().toString()
    # The plan is read from its end: the expansion comes before any exchange.
    assert plan.index("Generate explode") < plan.index("Exchange") and "LeftAnti" not in plan
    by_join = locked.new_locked(later.drop("locked_weight"), "2021-02-05", stored)
    rows = locked.new_locked(later, "2021-02-05")
    assert rows.exceptAll(by_join).isEmpty() and by_join.exceptAll(rows).isEmpty() and not rows.isEmpty()


def test_two_weights_for_one_key_stop_the_job(spark):
    rows = [("BTC", W0, W1, W0, 0.1), ("BTC", W0, W1, W0, 0.2)]
    twice = spark.createDataFrame(rows, "id string, start_date date, end_date date, DCA_date date, weight double")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        locked.packed(twice).collect()
    assert locked.packed(twice.limit(1).unionByName(twice.limit(1))).count() == 1


def test_many_ends_of_a_start_are_cut_into_blocks(spark, daily):
    ends = [date(2022, 1, 10 + k) for k in range(20)] + [date(2022, 12, 1)]
    windows = explicit_windows(spark, [(date(2022, 1, 1 + k), e) for k in range(5) for e in ends])
    days = B.multiplier_days(feat.baseline_features(daily), baseline_strategy())
    rows = expand_windows(days, windows, block_days=8).select("window_start", "window_end", "date", "block")
    assert rows.groupBy("block").agg(F.count_distinct("window_start", "window_end").alias("n")).agg(F.max("n")).first()[0] <= 64
    assert rows.count() == rows.drop("block").distinct().count() == sum((e - date(2022, 1, 1 + k)).days + 1 for k in range(5) for e in ends)


USER_FUNCTION = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["strategy_udf"](spark, {data!r}).count())
"""


def test_workers_need_not_have_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "driver.py"
    script.write_text(USER_FUNCTION.format(root=root, data=SF_SMALL))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_weight_sum_assertion(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 1.1)], "series_id string, weight_sum double")
    with pytest.raises(AssertionError):
        spd.assert_weight_sums(rows)
    spd.assert_weight_sums(rows.where("series_id = 'a'"))


def test_gap_rows_and_reindex(spark, walk):
    days = as_daily(spark, walk.iloc[[0, 1, 5]])
    rows = fill_gaps(days, {"price": 0.0}).orderBy("date").collect()
    assert len(rows) == 6 and rows[3].price == 0.0 and rows[3].mvrv is None
    assert rows[3].reach_from == walk.date[1] and rows[3].reach_to == walk.date[5]
    nominal = fill_gaps(days, {"price": 0.0}, span=("2019-12-30", "2020-01-08")).count()
    assert nominal == 10
    sparse = spark.createDataFrame([(walk.date[0], None), (walk.date[1], 2.0)], "date date, v double")
    got = [r.v for r in reindex(days.select("date"), sparse, "v", 0.5).orderBy("date").collect()]
    assert got == [None, 2.0, 0.5]
