import json
import math
from dataclasses import replace
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from daywright.operators import charts, cleaning, metrics, scenarios
from daywright.operators.windows import RollingWindows
from daywright.plans import backtest as B
from daywright.plans import features as feat
from daywright.plans.strategy import Strategy, baseline_strategy, extended_strategy
from daywright.sources.manifest import Manifest
from daywright.sources.report import report_documents
from tests.conftest import as_daily

RANGE = RollingWindows("2021-01-01", "2022-06-30")
SPD_SCHEMA = """series_id string, window_start date, window_end date, window string, min_sats_per_dollar double,
 max_sats_per_dollar double, uniform_sats_per_dollar double, dynamic_sats_per_dollar double,
 uniform_percentile double, dynamic_percentile double"""


def spd_rows(spark, pairs):
    rows = []
    for i, (uniform, dynamic) in enumerate(pairs):
        start, end = date(2020, 1 + i, 1), date(2021, 1 + i, 1)
        rows.append(("s", start, end, f"{start} → {end}", 1000.0, 5000.0, 2500.0, 2800.0, uniform, dynamic))
    return spark.createDataFrame(rows, SPD_SCHEMA)


def decay(values):
    w = 0.9 ** np.arange(len(values))[::-1]
    return float((np.array(values) * w).sum() / w.sum())


def test_metrics_by_hand(spark):
    pairs = [(40.0, 50.0), (50.0, 50.0), (30.0, 20.0), (0.0, 5.0)]
    m = metrics.score_metrics(spd_rows(spark, pairs)).first()
    excess = [10.0, 0.0, -10.0, 5.0]
    relative = [25.0, 0.0, -100 / 3, 50000.0]
    assert (m.total_windows, m.wins, m.losses) == (4, 2, 2)
    assert m.win_rate == 50.0
    assert m.exp_decay_percentile == pytest.approx(decay([50, 50, 20, 5]))
    assert m.score == pytest.approx(25 + m.exp_decay_percentile / 2)
    assert m.mean_excess == pytest.approx(np.mean(excess)) and m.median_excess == pytest.approx(2.5)
    assert m.relative_improvement_pct_mean == pytest.approx(np.mean(relative))
    assert m.relative_improvement_pct_median == pytest.approx(np.median(relative))
    assert math.isinf(m.mean_ratio) and m.median_ratio == pytest.approx((1 + 1.25) / 2)


@pytest.mark.parametrize(("pairs", "rate"), [
    ([(37.5, 62.5), (38.6, 61.4), (38.9, 66.7)], 100.0),
    ([(37.5, 25.0), (38.6, 25.0), (38.9, 25.0)], 0.0),
    ([(37.5, 45.0)], 100.0),
])
def test_all_wins_all_losses_single(spark, pairs, rate):
    spd = spd_rows(spark, pairs)
    assert metrics.score_metrics(spd).first().win_rate == rate
    table = {r.outcome: r for r in metrics.win_loss(spd).collect()}
    assert table["Wins"].percentage == rate and table["Losses"].windows == len(pairs) * (rate == 0)
    assert metrics.under_performers(spd).count() == len(pairs) * (rate == 0)


def test_undefined_window(spark):
    spd = spd_rows(spark, [(40.0, 50.0), (None, None), (30.0, 35.0)])
    m = metrics.score_metrics(spd).first()
    assert m.exp_decay_percentile is None and m.score is None
    assert (m.wins, m.losses, m.mean_excess) == (2, 1, 7.5)
    run = [r.cumulative_excess for r in charts.cumulative_excess(spd).orderBy("date").collect()]
    assert run == [10.0, None, 15.0]


def test_chart_tables(spark):
    spd = spd_rows(spark, [(40.0, 50.0), (50.0, 50.0), (30.0, 20.0), (10.0, 14.0)])
    long = charts.performance_long(spd)
    assert long.count() == 8 and {r.strategy for r in long.collect()} == {"Dynamic DCA", "Uniform DCA"}
    hist = charts.excess_histogram(spd, bins=4).orderBy("bin").collect()
    assert [r.windows for r in hist] == [1, 0, 2, 1] and hist[0].bin_start == -10 and hist[3].bin_end == 10
    flat = charts.excess_histogram(spd_rows(spark, [(40.0, 50.0)])).where("windows > 0").collect()
    assert len(flat) == 1 and flat[0].bin_start <= 10 <= flat[0].bin_end
    summary = charts.metrics_summary(metrics.score_metrics(spd)).orderBy("position").collect()
    assert len(summary) == 12 and summary[1].value == "50.00%" and summary[11].value == "2"


def test_full_analysis_writes_everything(spark, daily, tmp_path):
    out = str(tmp_path / "out")
    tables = B.run_full_analysis(daily, RANGE, baseline_strategy(), out)
    assert tables["spd"].count() == RANGE.table(spark).count()
    assert B.ready(tables["checks"]).count() == 1
    documents = [json.loads(line) for f in (tmp_path / "out" / "report").glob("*.txt") for line in f.read_text().splitlines()]
    (header,) = [x for x in documents if x["chunk"] == "header"]
    assert set(header) == {"series_id", "chunk", "timestamp", "summary_metrics", "windows", "chunks"}
    assert len(header["summary_metrics"]) == 12 and header["windows"] == tables["spd"].count()
    chunks = sorted((x for x in documents if x["chunk"] != "header"), key=lambda x: x["chunk"])
    entries = [e for x in chunks for e in x["window_level_data"]]
    assert len(chunks) == header["chunks"] and len(entries) == header["windows"]
    assert entries[0]["start_date"] == "2021-01-01T00:00:00" and all(len(e) == 9 for e in entries)
    assert [e["start_date"] for e in entries] == sorted(e["start_date"] for e in entries)
    manifest = {r.name: r.rows for r in Manifest(spark, out, "").entries().collect()}
    assert manifest == {name: table.count() for name, table in tables.items()}


def test_a_report_of_any_length_is_cut_into_chunks(spark, daily):
    spd = B.backtest(daily, RANGE, baseline_strategy())
    made = report_documents(charts.window_report(spd), metrics.score_metrics(spd), chunk_days=10).collect()
    sizes = [len(json.loads(r.document)["window_level_data"]) for r in made if r.chunk != "header"]
    assert sum(sizes) == 181 and max(sizes) == 10


def test_a_full_analysis_resumes_where_it_stopped(spark, daily, tmp_path, monkeypatch):
    out, built = str(tmp_path / "out"), []

    def counting(name, fn, fails=False):
        def call(*args, **kw):
            built.append(name)
            if fails:
                raise RuntimeError("lost")
            return fn(*args, **kw)

        return call

    plain = baseline_strategy()
    strategy = replace(plain, features=counting("features", plain.features))
    with monkeypatch.context() as m:
        m.setattr(B.metrics, "spd_summary", counting("spd_summary", B.metrics.spd_summary, fails=True))
        with pytest.raises(RuntimeError):
            B.run_full_analysis(daily, RANGE, strategy, out)
    assert built == ["features", "spd_summary"]
    (tmp_path / "out" / "spd_summary.new").mkdir()  # what a broken write leaves behind
    tables = B.run_full_analysis(daily, RANGE, strategy, out)
    # Features are made once more, of prefixes, in the leakage check; the stored ones are read.
    assert built.count("features") == 2 and len(tables) == 11
    again = len(built)
    B.run_full_analysis(daily, RANGE, strategy, out)
    assert len(built) == again
    changed = daily.withColumn("price", F.col("price") + (F.col("date") == F.lit("2021-03-01").cast("date")).cast("int"))
    B.run_full_analysis(changed, RANGE, strategy, out)
    assert built[again] == "features"


def test_constant_price_is_undefined_not_an_error(spark, daily):
    spd = B.backtest(scenarios.constant_price(daily), RANGE, baseline_strategy())
    row = spd.agg(F.count("*"), F.count("uniform_percentile"), F.count("dynamic_percentile"), F.min("weight_sum")).first()
    assert row[0] == 181 and row[1] == row[2] == 0 and row[3] == pytest.approx(1)


@pytest.mark.parametrize("bad", [None, 0.0, -1000.0])
def test_bad_price_does_not_stop_the_job(spark, daily, bad):
    hit = F.col("date") == F.lit("2021-06-15").cast("date")
    broken = daily.withColumn("price", F.when(hit, F.lit(bad).cast("double")).otherwise(F.col("price")))
    spd = B.backtest(broken, RANGE, baseline_strategy())
    assert spd.count() == 181 and spd.where("abs(weight_sum - 1) > 1e-9").count() == 0
    covered = spd.where("window_start <= date'2021-06-15'")
    if bad == 0.0:
        assert covered.where("max_sats_per_dollar = double('inf') and uniform_percentile is null").count() == covered.count()
    else:
        assert covered.where("uniform_percentile is null").count() == 0


def test_errors_for_missing_columns(spark, daily):
    with pytest.raises(KeyError):
        feat.baseline_features(daily.drop("price"))
    with pytest.raises(KeyError):
        feat.extended_features(daily.withColumnRenamed("price", "close"))
    with pytest.raises(ValueError):
        cleaning.clean_daily(spark.createDataFrame([("a", "2020-01-01", 1)], "series_id string, time string, _ord int"))


def test_empty_and_single_row_and_weekly(spark, daily, walk):
    strategy = baseline_strategy()
    assert B.backtest(daily.limit(0), RANGE, strategy).count() == 0
    one = B.backtest(as_daily(spark, walk[walk.date == date(2021, 7, 1)]), RANGE, strategy)
    assert one.count() == 181 and one.where("uniform_percentile is not null").count() == 0
    weekly = as_daily(spark, walk.iloc[::7].assign(price=lambda d: 10000 + 100.0 * np.arange(len(d))))
    spd = B.backtest(weekly, RANGE, strategy)
    assert spd.count() == 181 and spd.where("abs(weight_sum - 1) > 1e-9").count() == 0


def test_no_look_ahead_in_either_model(spark, daily):
    probes = spark.createDataFrame([("BTC", date(2021, m, 1)) for m in range(1, 7)], "series_id string, probe date")
    for strategy in (baseline_strategy(), extended_strategy()):
        leaks = B.leakage_check(daily, strategy, probes)
        assert leaks.count() == 6 and leaks.where("multiplier_leak").count() == 0


def test_leakage_check_finds_a_peeking_strategy(spark, daily):
    base = baseline_strategy()

    def peek(days, keys):
        from daywright.operators.rolling import by_date

        nxt = F.lead("price").over(by_date(keys))
        return base.features(days, keys).join(
            days.select(*keys, "date", (nxt / F.col("price") - 1).alias("_peek")), [*keys, "date"]
        ).withColumn("price_vs_ma", F.coalesce("_peek", F.lit(0.0))).drop("_peek")

    cheat = Strategy("peek", peek, base.multiplier, base.gap)
    probes = spark.createDataFrame([("BTC", date(2021, 3, 1))], "series_id string, probe date")
    assert B.leakage_check(daily, cheat, probes).where("multiplier_leak").count() == 1


def test_truncated_and_masked_history_agree(spark, daily):
    day = "2021-06-01"
    full = feat.extended_features(daily).where(F.col("date") <= day)
    for known in (scenarios.truncate_after(daily, day), scenarios.mask_after(daily, day, ["price", "mvrv"])):
        part = feat.extended_features(known).where(F.col("date") <= day)
        both = full.join(part.select("date", *[F.col(c).alias(f"_{c}") for c in feat.EXTENDED_SIGNALS]), "date")
        worst = both.agg(*[F.max(F.abs(F.col(c) - F.col(f"_{c}"))).alias(c) for c in feat.EXTENDED_SIGNALS]).first()
        assert max(worst) < 1e-12


def test_extended_without_optional_inputs_is_neutral(spark, daily):
    row = feat.extended_features(daily.drop("mvrv")).agg(
        F.max(F.abs("mvrv_zscore")), F.min("mvrv_volatility"), F.max("sentiment"), F.min("price_ma")).first()
    assert tuple(row) == (0.0, 0.5, 0.5, 0.0)


def test_scenarios(spark, daily, walk):
    total = daily.agg(F.sum("price")).first()[0]
    up = scenarios.spike(daily, "2021-06-01").where("date < date'2021-06-01'").agg(F.sum("price")).first()[0]
    assert up == pytest.approx(walk[walk.date < date(2021, 6, 1)].price.sum())
    assert scenarios.crash(daily, "1999-01-01").agg(F.sum("price")).first()[0] == pytest.approx(total)
    half = scenarios.scale_second_half(daily).agg(F.sum("price")).first()[0]
    n = len(walk) // 2
    assert half == pytest.approx(walk.price[:n].sum() + 10 * walk.price[n:].sum())
    mixed = scenarios.shuffle_prices(daily).toPandas()
    assert sorted(mixed.price) == sorted(walk.price) and (mixed.sort_values("date").price.values != walk.price.values).any()
    again = scenarios.shuffle_prices(daily).toPandas()
    assert mixed.sort_values("date").price.tolist() == again.sort_values("date").price.tolist()


def test_python_strategy_equals_uniform(spark, daily):
    features = feat.baseline_features(daily)
    spd = B.backtest_python(features, RANGE, baseline_strategy(), lambda w: np.full(len(w), 1 / len(w)))
    assert spd.count() == 181 and spd.where("abs(excess_percentile) > 1e-9").count() == 0


def test_many_series_keep_apart(spark, daily):
    two = daily.unionByName(daily.withColumns({"series_id": F.lit("X"), "price": F.col("price") * 7}))
    spd = B.backtest(two, RANGE, baseline_strategy())
    pair = spd.groupBy("window_start").agg((F.max("dynamic_percentile") - F.min("dynamic_percentile")).alias("d"), F.count("*").alias("n"))
    assert pair.where("abs(d) > 1e-8 or n <> 2").count() == 0


def _shares(window):
    raw = np.exp(-2 * window["price_vs_ma"])
    return raw / raw.sum()


def test_user_weights_are_aligned_by_date(spark, daily):
    strategy = baseline_strategy()
    features = strategy.features(daily, ("series_id",))
    run = lambda weigh: B.backtest_python(features, RANGE, strategy, weigh).orderBy("window_start").toPandas()
    straight, backwards = run(_shares), run(lambda w: _shares(w)[::-1])
    pd.testing.assert_frame_equal(straight, backwards)
    first_half = run(lambda w: pd.Series(1 / (len(w) // 2), index=w.index[: len(w) // 2]))
    assert np.allclose(first_half["weight_sum"], 1)


@pytest.mark.parametrize("weigh", [lambda w: w["price_vs_ma"] * 0 + 1.0, lambda w: np.ones(3) / 3], ids=["sum", "length"])
def test_wrong_user_weights_stop_the_backtest(spark, daily, weigh):
    strategy = baseline_strategy()
    features = strategy.features(daily, ("series_id",))
    with pytest.raises(Exception, match="weights"):
        B.backtest_python(features, RANGE, strategy, weigh).select("window_start").collect()


def test_checks_take_a_user_function(spark, daily):
    strategy = baseline_strategy()
    probes = daily.select("series_id", F.max("date").over(Window.partitionBy("series_id")).alias("probe")).distinct()
    probes = probes.withColumn("probe", F.date_sub("probe", 100))
    steady = lambda w: np.full(len(w), 1 / len(w))
    assert B.leakage_check(daily, strategy, probes, weigh=steady).where("multiplier_leak").isEmpty()
    assert not B.leakage_check(daily, strategy, probes, weigh=_shares).where("multiplier_leak").isEmpty()
    checks = B.submission_check(daily, RANGE, strategy, weigh=steady).where("check = 'weights'")
    assert checks.count() > 0 and checks.where("not passed").isEmpty()
