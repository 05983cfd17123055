import warnings
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daywright.operators import cleaning, profile
from daywright.operators.sentiment import activity_sentiment, text_matches
from daywright.plans.eda import eda_report, eda_table
from daywright.sources.daily_csv import load_daily, read_daily_csv, scan_daily
from daywright.sources.market_tables import EDA_TABLES, MARKET_FILES, MARKET_SCHEMAS, load_market_tables
from tests.conftest import SF_SMALL

CSV = """time,PriceUSD,CapMVRVCur,CapMrktCurUSD,HashRate,TxCnt
2020-01-03T00:00:00Z,30,1.5,300,3,33
2020-01-01,10,1.1,100,1,11
2020-01-02,,1.2,200,2,22
2020-01-01 12:30:00,11,1.3,110,1,12
2020-01-06,60,,600,6,66
"""


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "daily.csv"
    path.write_text(CSV)
    return str(path)


def test_daily_csv_keeps_the_last_row_of_a_day(spark, csv):
    rows = {str(r.date): r for r in load_daily(spark, csv).collect()}
    assert sorted(rows) == ["2020-01-01", "2020-01-02", "2020-01-03", "2020-01-06"]
    assert rows["2020-01-01"].price == 11.0 and rows["2020-01-01"].mvrv == 1.3
    assert rows["2020-01-02"].price is None and rows["2020-01-03"].series_id == "ALL"


def test_missing_prices_and_gaps(spark, csv):
    daily = load_daily(spark, csv)
    found = cleaning.missing_prices(daily, "2020-01-01").first()
    assert (found.missing_prices, str(found.first_missing), str(found.latest_date)) == (1, "2020-01-02", "2020-01-06")
    assert [str(r.date) for r in cleaning.calendar_gaps(daily).orderBy("date").collect()] == ["2020-01-04", "2020-01-05"]


def test_csv_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_daily_csv(spark, str(tmp_path / "absent.csv"))
    (tmp_path / "bad.csv").write_text("time,Close\n2020-01-01,1\n")
    with pytest.raises(ValueError):
        load_daily(spark, str(tmp_path / "bad.csv"))


def test_scan_keeps_every_row(spark, csv):
    scanned = scan_daily(spark, csv)
    assert scanned.count() == 5 and scanned.where("hour(time) = 12").count() == 1


def market_files(spark, folder):
    stamp = "timestamp_ntz"
    shrink = "timestamp_ntz'1970-01-01 00:00:00' + (timestamp_ntz'2024-05-01 10:00:00' - timestamp_ntz'1970-01-01 00:00:00') / 1000"
    spark.sql(f"""select * from values
        ('m1', 'Will BTC rise?', 'e1', 'Crypto', 10D, true, {shrink}, '2025-01-01T00:00:00'),
        ('m2', 'Rates?', 'e1', null, 5D, false, {stamp}'1970-01-01 00:00:00', '2024-07-01T00:00:00'),
        ('m3', null, 'e2', 'Crypto', 7D, true, null, null)
        t(market_id, question, event_slug, category, volume, active, created_at, end_date)
        """).write.parquet(f"{folder}/{MARKET_FILES['markets']}")
    spark.sql(f"""select * from values ('m1', 't1', {stamp}'2024-06-01 00:00:00', 0.4D), ('m1', 't1', {stamp}'2019-06-01 00:00:00', 0.5D)
        t(market_id, token_id, timestamp, price)""").write.parquet(f"{folder}/{MARKET_FILES['odds_history']}")


def test_market_tables_are_repaired_and_absent_ones_skipped(spark, tmp_path):
    market_files(spark, str(tmp_path))
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        tables = load_market_tables(spark, str(tmp_path))
    assert set(tables) == {"markets", "odds_history"}
    assert sum(w.category is UserWarning for w in caught) == 4
    got = {r.market_id: r for r in tables["markets"].collect()}
    assert got["m1"].created_at == datetime(2024, 5, 1, 10) and got["m2"].created_at is None
    assert got["m1"].end_date == datetime(2025, 1, 1) and got["m3"].end_date is None
    # The maximum is valid, so nothing is scaled; the early row is blanked.
    odds = [r.timestamp for r in tables["odds_history"].collect()]
    assert sorted(o is None for o in odds) == [False, True]
    audit = {(r.table_name, r.column_name): r for r in cleaning.audit_timestamps(tables).collect()}
    assert len(audit) == 3 and all(r.pre_2020_rows == 0 for r in audit.values())
    assert audit["odds_history", "timestamp"].valid_rows == 1


def test_files_that_drift_and_files_that_are_damaged(spark, tmp_path):
    folder = tmp_path / MARKET_FILES["trades"]
    older = "select 'm1' market_id, 't1' token_id, cast(0.5 as float) price, 3 size, '2024-05-01T00:00:00' timestamp"
    spark.sql(older).coalesce(1).write.mode("append").parquet(str(folder))
    newer = "select 1.5D size, 'BUY' side, timestamp_ntz'2024-05-02 00:00:00' timestamp, 0.25D price, 7L market_id, 't2' token_id, 'x' venue"
    spark.sql(newer).coalesce(1).write.mode("append").parquet(str(folder))
    (folder / "part-broken.parquet").write_bytes(b"PAR1 no table")
    problems = []
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        tables = load_market_tables(spark, str(tmp_path), ["trades", "tokens"], problems=problems)
    assert set(tables) == {"trades"} and sum(w.category is UserWarning for w in caught) == 2
    assert [(p.table, p.path.endswith("part-broken.parquet")) for p in problems] == [("trades", True), ("tokens", False)]
    trades = tables["trades"]
    declared = spark.createDataFrame([], MARKET_SCHEMAS["trades"]).schema
    assert [(f.name, f.dataType) for f in trades.schema.fields[:-1]] == [(f.name, f.dataType) for f in declared.fields]
    got = {r.market_id: r for r in trades.collect()}
    assert (got["m1"].price, got["m1"]["size"], got["m1"].timestamp, got["m1"].side) == (0.5, 3.0, datetime(2024, 5, 1), None)
    assert (got["7"].price, got["7"].side, got["7"].venue, got["m1"].venue) == (0.25, "BUY", "x", None)


def test_only_timestamp_columns_with_known_names_are_repaired(spark):
    df = spark.sql("select timestamp_ntz'1970-01-20 00:00:00' first_market_start, timestamp_ntz'1970-01-20 00:00:00' last_trade, 5L trade_count")
    assert cleaning.timestamp_columns(df) == ["last_trade"]
    row = cleaning.repair_timestamps(df).first()
    assert row.first_market_start.year == 1970 and row.last_trade.year == 2022 and row.trade_count == 5
    both = cleaning.repair_timestamps(df, ["first_market_start"]).first()
    assert both.first_market_start.year == 2022


def test_eda_report(spark, csv, tmp_path):
    market_files(spark, str(tmp_path / "markets"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tables = load_market_tables(spark, str(tmp_path / "markets"))
    report = eda_report(scan_daily(spark, csv), tables)
    assert set(report) == {"describe", "correlation", "price_series", "market_totals", "top_categories"}
    price = report["describe"].where("metric = 'PriceUSD'").first()
    assert (price["count"], price.null_count, price.min, price.p50, price.max) == (4, 1, 10.0, 30.0, 60.0)
    assert report["correlation"].count() == 16
    totals = {r.name: r.value for r in report["market_totals"].collect()}
    assert totals == {"total_markets": 3, "active_markets": 2, "closed_markets": 1, "total_volume": 22,
                      "mean_volume": pytest.approx(22 / 3), "odds_records": 2}
    top = [(r.category, r.volume) for r in report["top_categories"].collect()]
    assert top == [("Crypto", 17.0), (None, 5.0)]
    assert set(eda_report(spark.range(3).toDF("x"), {})) == set()


def test_eda_table_equals_the_parts(spark, csv, tmp_path):
    market_files(spark, str(tmp_path / "markets"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tables = load_market_tables(spark, str(tmp_path / "markets"), EDA_TABLES)
    daily = scan_daily(spark, csv)
    whole = eda_table(daily, tables)
    got = {(r.part, r.name, r.field): r.value for r in whole.collect()}
    parts = eda_report(daily, tables)
    for r in parts["describe"].collect():
        for field in ("count", "null_count", "mean", "std", "min", "p25", "p50", "p75", "max"):
            assert got["describe", r.metric, field] == pytest.approx(r[field])
    for r in parts["correlation"].collect():
        assert got["correlation", r.metric_a, r.metric_b] == pytest.approx(r.correlation, nan_ok=True)
    assert {k[2]: v for k, v in got.items() if k[0] == "totals"} == {r.name: r.value for r in parts["market_totals"].collect()}
    assert {(k[1], v) for k, v in got.items() if k[0] == "top_categories"} == {(r.category, r.volume) for r in parts["top_categories"].collect()}
    assert eda_table() is None


def test_eda_table_reads_each_input_once(spark):
    days = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    markets = spark.read.parquet(f"{SF_SMALL}/part.parquet").selectExpr("p_brand category", "p_retailprice volume", "p_size > 9 active")
    plan = eda_table(days, {"markets": markets}, ["l_tax"], ["l_tax", "l_discount"])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("p_brand" in line for line in scans) == 1
    assert len(scans) == 1 + 1 + 4  # markets, numbers of the days, four rounds of quartiles


@pytest.mark.parametrize("kind", ["normal", "heavy", "few", "constant", "one", "log-uniform", "limits"])
def test_exact_quantiles_on_awkward_data(spark, kind):
    rng = np.random.default_rng(7)
    x = {
        "normal": rng.normal(size=5000),
        "heavy": np.exp(rng.normal(0, 12, size=5000)),
        "few": rng.integers(0, 3, size=5000).astype(float),
        "constant": np.full(100, 4.0),
        "one": np.array([2.5]),
        "log-uniform": 10 ** rng.uniform(-300, 300, size=5000) * rng.choice([-1, 1], size=5000),
        "limits": np.array([-np.inf, -1.8e308, -5e-324, 0.0, 5e-324, 2.3e-308, 1.7e308, np.inf]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.p: r.value for r in profile.exact_quantiles(df, ["x"], probabilities).collect()}
    ordered = np.sort(x)
    want = {p: ordered[int(np.floor(p * (len(x) - 1) + 0.5))] for p in probabilities}
    assert got == want


def test_bits_are_in_the_order_of_the_numbers(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**63), 2**63 - 1, 4000).view(np.float64)
    powers = 2.0 ** np.arange(-1074, 1024)
    x = np.concatenate([x[~np.isnan(x)], powers, -powers, np.nextafter(powers, np.inf), np.nextafter(powers, 0), [0.0, np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = profile.with_ordered_bits(df, "x", "bits").toPandas()
    size = np.abs(got.x.to_numpy()).view(np.int64)
    assert (got.bits.to_numpy() == np.where(got.x < 0, -size, size)).all()


def test_a_profile_keeps_every_column(spark):
    df = spark.sql("select * from values (1, cast(null as string), array(1)), (2, null, array(1)), (2, null, null) t(a, b, c)")
    got = {r.column_name: (r.null_count, r.max_value, r.distinct_count) for r in profile.column_profile(df, exact=True).collect()}
    assert got == {"a": (0, "2", 2), "b": (3, None, 0), "c": (1, None, None)}


def test_correlation_is_pairwise_complete(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, None], "b": [2.0, 1, 4, 3, 9], "c": [5.0, None, 1, 2, 7]})
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    got = profile.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()
    want = pdf.corr()
    assert len(got) == 9
    for r in got:
        assert r.correlation == pytest.approx(want.loc[r.metric_a, r.metric_b])


def test_text_filter_and_sentiment(spark):
    texts = spark.createDataFrame([("bitcoin up",), ("BTC",), ("gold",), (None,)], "q string")
    assert [r[0] for r in texts.select(text_matches(F.col("q"))).collect()] == [True, True, False, False]
    days = pd.date_range("2024-01-01", periods=40, freq="2D")
    rng = np.random.default_rng(3)
    rows = [(f"m{i}-{j}", "Bitcoin?", d.to_pydatetime(), float(rng.integers(1, 50))) for i, d in enumerate(days) for j in range(rng.integers(1, 5))]
    markets = spark.createDataFrame(rows, "market_id string, question string, created_at timestamp_ntz, volume double")
    got = activity_sentiment(markets).orderBy("date").toPandas().sentiment
    pdf = pd.DataFrame(rows, columns=["m", "q", "d", "v"]).groupby("d").agg(n=("m", "count"), v=("v", "sum"))
    rank = lambda s: s.rolling(30, min_periods=1).apply(lambda x: 0.5 if len(x) == 1 else (x.iloc[:-1] < x.iloc[-1]).sum() / (len(x) - 1))
    np.testing.assert_allclose(got, 0.5 * rank(pdf.n) + 0.5 * rank(pdf.v))


def test_column_profile(spark, csv):
    got = {r.column_name: r for r in profile.column_profile(scan_daily(spark, csv)).collect()}
    assert got["PriceUSD"].null_count == 1 and got["PriceUSD"].null_share == pytest.approx(0.2)
    assert got["TxCnt"].distinct_estimate == 5 and got["time"].data_type == "timestamp_ntz"


def test_stream_locks_each_series_day_by_day(spark, daily, tmp_path):
    from datetime import date

    from daywright.operators.windows import explicit_windows
    from daywright.plans import backtest as B
    from daywright.plans import features as feat
    from daywright.plans.strategy import baseline_strategy
    from daywright.streaming.daily_lock import lock_on_arrival

    days, store = str(tmp_path / "days"), str(tmp_path / "locked")
    both = daily.unionByName(daily.withColumn("series_id", F.lit("LAG")))

    def weights_on(session, day):
        windows = explicit_windows(session, [(date(2022, 1, 1), date(2022, 3, 1))])
        return B.window_weights(feat.baseline_features(both), windows, baseline_strategy(), day)

    def arrive(series, *new):
        rows = [(series, date.fromisoformat(d)) for d in new]
        spark.createDataFrame(rows, "series_id string, date date").coalesce(1).write.mode("append").parquet(days)
        stream = spark.readStream.schema("series_id string, date date").parquet(days)
        lock_on_arrival(stream, weights_on, store, str(tmp_path / "checkpoint")).awaitTermination(300)
        got = spark.read.parquet(store).groupBy("id").agg(F.count("*"), F.max("DCA_date")).collect()
        return {r[0]: (r[1], str(r[2])) for r in got}

    assert arrive("BTC", "2022-01-03") == {"BTC": (3, "2022-01-03")}
    # A batch of two days is locked as of each; the series that lags is not touched.
    assert arrive("BTC", "2022-01-05", "2022-01-04") == {"BTC": (5, "2022-01-05")}
    assert arrive("LAG", "2022-01-02") == {"BTC": (5, "2022-01-05"), "LAG": (2, "2022-01-02")}
