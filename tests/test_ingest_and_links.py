"""Permissive reading of text, and the link graph."""

import json
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daywright.operators import cleaning, ingest, links
from daywright.sources.daily_csv import load_daily, read_daily_csv, scan_daily

TIMES = {
    "2024-03-05T06:07:08Z": datetime(2024, 3, 5, 6, 7, 8),
    " 2024-03-05 ": datetime(2024, 3, 5),
    "2024/03/05 06:07:08": datetime(2024, 3, 5, 6, 7, 8),
    "2024/03/05": datetime(2024, 3, 5),
    "05.03.2024 06:07": datetime(2024, 3, 5, 6, 7),
    "05.03.2024": datetime(2024, 3, 5),
    "03/05/2024 06:07": datetime(2024, 3, 5, 6, 7),
    "1709618828": datetime(2024, 3, 5, 6, 7, 8),
    "1709618828500": datetime(2024, 3, 5, 6, 7, 8, 500000),
    "31.02.2024": None,
    "soon": None,
    "99999999999999999999999": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_in_any_layout(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(t,) for t in TIMES], "t string")
        got = {r.t: r.at for r in rows.select("t", ingest.parse_time(F.col("t")).alias("at")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == TIMES


BROKEN = """time,PriceUSD,HashRate
2020-01-01,10,1
not a day,11,2
2020-01-03,eleven,3
2020-01-04,12
2020-01-05,NA,5,6
05.01.2020,13,-
"""


@pytest.fixture
def broken(tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text(BROKEN)
    return str(path)


def test_unreadable_text_is_counted_and_stops_nothing(spark, broken):
    read = scan_daily(spark, broken, rejects=True)
    assert read.count() == 6 and scan_daily(spark, broken).columns == ["time", "PriceUSD", "HashRate"]
    got = {r.column_name: (r.rows, r["values"], r.unreadable, r.first_unreadable) for r in ingest.reject_counts(read, ["time", "PriceUSD", "HashRate"]).collect()}
    assert got["time"] == (6, 5, 1, "not a day") and got["PriceUSD"] == (6, 4, 1, "eleven")
    assert got["HashRate"][:3] == (6, 4, 0) and got["_corrupt"][2:] == (2, "2020-01-04,12")


def test_a_row_without_a_readable_day_is_left_out(spark, broken):
    days = {str(r.date): r.price for r in load_daily(spark, broken).collect()}
    assert days == {"2020-01-01": 10.0, "2020-01-03": None, "2020-01-04": 12.0, "2020-01-05": None}
    assert read_daily_csv(spark, broken, rejects=True).where(F.size("_rejects") > 0).count() == 3


def test_text_columns_of_market_tables(spark):
    rows = spark.createDataFrame([("2024-01-01", "x"), (None, "05.03.2024")], "created_at string, end_date string")
    got = [tuple(r) for r in cleaning.parse_text_timestamps(rows).collect()]
    assert got == [(datetime(2024, 1, 1), None), (None, datetime(2024, 3, 5))]


@pytest.fixture
def tables(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return {
        "markets": make([("m1", "q1", "e1", 3.0), ("m2", "q2", "e9", 4.0), ("m2", "again", "e1", 5.0), ("m3", "q3", None, 1.0)],
                        "market_id string, question string, event_slug string, volume double"),
        "tokens": make([("m1", "t1", "Yes"), ("m1", "t2", "No"), ("m7", "t1", "Yes")], "market_id string, token_id string, outcome string"),
        "odds_history": make([("m1", "t1", datetime(2024, 1, k), k / 10) for k in range(1, 6)] + [("m1", "t9", datetime(2024, 1, 1), 0.5), ("m1", None, None, None)],
                             "market_id string, token_id string, timestamp timestamp_ntz, price double"),
        "event_stats": make([("e1", 2, 8.0), ("e2", 1, 1.0)], "event_slug string, market_count long, total_volume double"),
    }


def test_link_audit_counts_what_does_not_hold(tables):
    got = {r.link: r.asDict() for r in links.link_audit(tables).collect()}
    assert set(got) == {"tokens->markets", "odds_history->tokens", "markets->event_stats"}
    assert got["tokens->markets"] == {"link": "tokens->markets", "child_rows": 3, "keyless_rows": 0, "orphan_rows": 1, "orphan_keys": 1,
                                      "parent_keys": 3, "duplicate_keys": 1, "childless_keys": 2}
    odds = got["odds_history->tokens"]
    assert (odds["child_rows"], odds["keyless_rows"], odds["orphan_rows"], odds["childless_keys"]) == (7, 1, 1, 2)
    events = got["markets->event_stats"]
    assert (events["child_rows"], events["keyless_rows"], events["orphan_keys"], events["childless_keys"]) == (4, 1, 1, 1)
    with pytest.raises(ValueError):
        links.link_audit({"markets": tables["markets"]})


def test_keys_of_several_columns_are_not_mixed_up(spark):
    child = spark.createDataFrame([("a", "bc")], "x string, y string")
    parent = spark.createDataFrame([("ab", "c")], "x string, y string")
    got = links.link_audit({"child": child, "parent": parent}, [links.Link("child", "parent", ("x", "y"))]).first()
    assert got.orphan_rows == 1 and got.childless_keys == 1


def test_the_audit_joins_nothing(tables):
    plan = links.link_audit(tables)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_no_task_of_the_audit_holds_the_keys_of_its_input(tables):
    plan = links.link_audit(tables)._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("REPARTITION_BY") :]
    assert "Aggregate" not in before and "MapInArrow" in before


def test_a_common_key_is_counted_before_the_shuffle(spark):
    batch = pa.RecordBatch.from_pydict({"columns": [0] * 6, "key": ["a", "a", None, "b", None, "a"], "side": [0, 0, 1, 0, 1, 2]})
    got = [tuple(r.values()) for out in links._counted(iter([batch])) for r in out.to_pylist()]
    assert sorted(got, key=str) == [(0, "a", 0, 2), (0, "a", 2, 1), (0, "b", 0, 1), (0, None, 1, 2)]
    child = spark.range(30_000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) AS x")
    got = links.link_audit({"c": child, "p": spark.createDataFrame([(7,), (7,), (8,)], "x long")}, [links.Link("c", "p", ("x",)), links.Link("c", "c", ("x",))]).collect()
    assert {tuple(r) for r in got} == {("c->p", 30_000, 10_000, 9_999, 9_999, 2, 1, 0), ("c->c", 30_000, 10_000, 0, 0, 10_001, 1, 0)}


def test_odds_and_events_are_linked(tables):
    odds = {(r.market_id, r.token_id): r for r in links.link_odds(tables["odds_history"], tables["tokens"], tables["markets"].dropDuplicates(["market_id"])).collect()}
    one = odds["m1", "t1"]
    assert (one.records, one.low, one.high, one.last_odds, one.outcome, one.question) == (5, 0.1, 0.5, 0.5, "Yes", "q1")
    assert odds["m1", "t9"].outcome is None and odds["m1", "t9"].question == "q1" and odds["m1", None].records == 1
    events = {r.event_slug: r for r in links.link_events(tables["event_stats"], tables["markets"]).collect()}
    assert events["e1"].agrees and not events["e2"].agrees and events["e2"].markets == 0
    assert not events["e9"].known and events["e9"].volume == 4.0 and None not in events
