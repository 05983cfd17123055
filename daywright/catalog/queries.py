"""Query registry: name -> (spark, sf_dir) -> DataFrame.

Doubles are rounded only here, so that two engines that add in a different order agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daywright.catalog import standins as S
from daywright.functions import signals
from daywright.functions.labels import window_label_start
from daywright.operators import calendar as C
from daywright.operators import charts, cleaning, ingest, links, locked, metrics, profile, scenarios, spd
from daywright.operators import rolling as R
from daywright.operators import windows as W
from daywright.operators.sentiment import activity_sentiment, daily_activity
from daywright.plans import backtest as B
from daywright.plans import features as feat
from daywright.plans.eda import eda_table
from daywright.settings import scratch_path
from daywright.sources import report

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

MISSING_SINCE = "1996-01-01"
PROBE_DAY = "1999-03-01"
LOCK_DAY, DAY_AFTER_LOCK, NEXT_LOCK_DAY = "2000-01-31", "2000-02-01", "2000-03-31"
MIDWAY_DAY = "1999-06-30"


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def rounded(df: DataFrame, digits: int, **other: int) -> DataFrame:
    """Round every double column; ``other`` names columns with their own digits."""
    return df.withColumns(
        {
            f.name: F.round(F.col(f.name), other.get(f.name, digits))
            for f in df.schema.fields
            if isinstance(f.dataType, T.DoubleType)
        }
    )


def features_rounded(features: DataFrame) -> DataFrame:
    """Means of decimal prices sit on rounding limits; their logarithms do not."""
    logged = features.withColumn("log_price_ma", F.round(F.ln("price_ma"), 8)).drop("price_ma")
    return rounded(logged, 7, price=6, log_price_ma=8)


SPD_COLUMNS = (
    "series_id",
    "window",
    "min_sats_per_dollar",
    "max_sats_per_dollar",
    "uniform_sats_per_dollar",
    "dynamic_sats_per_dollar",
    "uniform_percentile",
    "dynamic_percentile",
    "excess_percentile",
)


def _spd(spark: SparkSession, d: str) -> DataFrame:
    return B.backtest(S.daily(spark, d), S.windows(spark, d), S.baseline())


def _spd_extended(spark: SparkSession, d: str) -> DataFrame:
    return B.backtest(S.daily_mvrv(spark, d), S.windows(spark, d), S.extended(spark, d))


def _extended(spark: SparkSession, d: str) -> DataFrame:
    return feat.extended_features(
        S.daily_mvrv(spark, d), S.markets(spark, d), S.ACTIVITY_PATTERN, since=None
    )


def _weights_on(spark: SparkSession, d: str, day: str, stored: DataFrame | None = None) -> DataFrame:
    days = S.daily_all(spark, d)
    return B.window_weights(
        feat.baseline_features(days, since=None), S.windows(spark, d), S.baseline(), day, stored
    )


# --- sources and cleaning ----------------------------------------------------------------


@query
def clean_daily(spark, d):
    return cleaning.clean_daily(S.raw_daily(spark, d))


@query
def missing_prices(spark, d):
    """Orders still open count as days without a price."""
    days = S.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        cleaning.to_day(F.col("o_orderdate")).alias("date"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
    )
    return cleaning.missing_prices(days, MISSING_SINCE)


@query
def calendar_gaps(spark, d):
    return cleaning.calendar_gaps(S.daily(spark, d))


@query
def repair_timestamps(spark, d):
    return cleaning.repair_timestamps(S.small_unit_events(spark, d))


@query
def audit_timestamps(spark, d):
    events = S.small_unit_events(spark, d)
    return cleaning.audit_timestamps(
        {"stored": events, "repaired": cleaning.repair_timestamps(events)}
    )


@query
def parse_text_timestamps(spark, d):
    return cleaning.parse_text_timestamps(S.text_orders(spark, d)).select("o_orderkey", "created_at")


@query
def ingest_rejects(spark, d):
    kinds = {"created_at": "time", "price": "double", "customer": "long"}
    return ingest.reject_counts(ingest.typed(S.text_orders(spark, d), kinds), list(kinds))


@query
def probe_dates(spark, d):
    return cleaning.probe_dates(S.daily(spark, d))


@query
def last_price(spark, d):
    return profile.last_price(S.daily(spark, d))


# --- windows and calendar ----------------------------------------------------------------


@query
def windows(spark, d):
    spans = S.daily(spark, d).groupBy("series_id").agg(
        F.min("date").alias("first"), F.max("date").alias("last")
    )
    made = W.windows_in_span(spans, "first", "last")
    return made.withColumn("days", W.window_days(F.col("window_start"), F.col("window_end")).cast("long"))


@query
def label_dates(spark, d):
    """Starts read back from the labels of a series' windows."""
    spans = S.daily(spark, d).groupBy("series_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    made = W.windows_in_span(spans, "first", "last")
    return made.select("series_id", "window", window_label_start(F.col("window")).alias("start"))


@query
def ranges_by_start(spark, d):
    """Every start has two ends: one year and half a year later."""
    span = S.daily_all(spark, d).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    both = W.windows_in_span(span, "first", "last", 12).unionByName(
        W.windows_in_span(span, "first", "last", 6)
    )
    return W.ends_by_start(both).select(
        "window_start",
        F.array_join(F.transform("window_ends", lambda e: F.date_format(e, "yyyy-MM-dd")), ",").alias(
            "window_ends"
        ),
    )


@query
def calendar_completion(spark, d):
    filled = C.fill_gaps(S.daily(spark, d), {"price": 0.0})
    return filled.select("series_id", "date", "price", "reach_from", "reach_to")


@query
def reindex_activity(spark, d):
    """Activity volume on the price dates of each series, 0 where a date has none."""
    active = daily_activity(S.markets(spark, d), "urgent").select("date", "volume")
    out = C.reindex(S.daily(spark, d).select("series_id", "date"), F.broadcast(active), "volume", 0.0)
    return rounded(out, 2)


@query
def date_sets(spark, d):
    """Dates of each series that the next one, in the order of priorities, shares or lacks."""
    number = F.substring("series_id", 1, 1).cast("int")
    days = S.daily(spark, d)
    a = days.select(number.alias("pair"), "date")
    b = days.select(((number + 3) % 5 + 1).alias("pair"), "date")
    return C.union_rows(
        C.common_dates(a, b, ["pair", "date"]).withColumn("kind", F.lit("common")),
        C.absent_dates(a, b, ["pair", "date"]).withColumn("kind", F.lit("absent")),
    )


# --- features ----------------------------------------------------------------------------


@query
def features_baseline(spark, d):
    out = feat.with_baseline_multiplier(feat.baseline_features(S.daily(spark, d), since=None))
    return features_rounded(out)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return R.with_zscore(S.daily(spark, d), "price", "z", 365)


@query
def zscore(spark, d):
    return rounded(_scored(spark, d).select("series_id", "date", F.col("z").alias("zscore")), 7)


@query
def ema(spark, d):
    days = S.daily(spark, d)
    out = R.with_ema(R.with_ema(days, "price", "ema_30", 30), "price", "ema_14", 14)
    return rounded(out.select("series_id", "date", "ema_30", "ema_14"), 4)


@query
def ema_gaps(spark, d):
    """Means over the calendar: the days without an order are missing values."""
    days = C.fill_gaps(S.daily(spark, d), {}).select("series_id", "date", "price")
    out = R.with_ema(R.with_ema(days, "price", "ema_30", 30), "price", "ema_3", 3)
    return rounded(out.select("series_id", "date", "ema_30", "ema_3"), 4)


@query
def pct_rank(spark, d):
    ranked = R.with_percent_rank(S.daily(spark, d), "price", "rank_360", 360, 90)
    ranked = R.with_percent_rank(ranked, "price", "rank_30", 30, 1)
    return rounded(ranked.drop("price"), 9)


@query
def zones(spark, d):
    zone = signals.valuation_zone(F.col("z")).alias("zone")
    return _scored(spark, d).groupBy("series_id", zone).agg(F.count(F.lit(1)).alias("days"))


@query
def volatility(spark, d):
    out = R.with_rolling_std(_scored(spark, d), "z", "volatility", 90, 22)
    return rounded(out.select("series_id", "date", "volatility"), 7)


@query
def activity(spark, d):
    return rounded(daily_activity(S.markets(spark, d), S.ACTIVITY_PATTERN), 2)


@query
def sentiment(spark, d):
    return rounded(activity_sentiment(S.markets(spark, d), S.ACTIVITY_PATTERN), 9)


@query
def features_extended(spark, d):
    return features_rounded(_extended(spark, d).drop("observed_price"))


@query
def neutral_features(spark, d):
    """The extended model without its optional inputs, a ratio and market tables, and the multiplier it then gives."""
    out = feat.extended_features(S.daily(spark, d), since=None)
    scored = feat.with_extended_multiplier(out).drop("observed_price")
    fewer = feat.with_extended_multiplier(out.select("series_id", "date", "price_vs_ma", "mvrv_zscore", "mvrv_gradient"))
    both = scored.join(fewer.select("series_id", "date", F.col("multiplier").alias("multiplier_fewer")), ["series_id", "date"])
    return features_rounded(both)


@query
def multiplier_extended(spark, d):
    out = feat.with_extended_multiplier(_extended(spark, d))
    return rounded(
        out.select("series_id", "date", F.log10("multiplier").alias("log_multiplier")), 7
    )


@query
def signal_parts(spark, d):
    """Every signal formula on the lagged features."""
    z, g = F.col("mvrv_zscore"), F.col("mvrv_gradient")
    out = _extended(spark, d).select(
        "series_id",
        "date",
        signals.extreme_boost(z).alias("boost"),
        signals.trend_modifier(g, z).alias("trend"),
        signals.acceleration_modifier(F.col("mvrv_acceleration"), g).alias("acceleration"),
        signals.signal_confidence(z, g, F.col("price_vs_ma")).alias("confidence"),
    )
    return rounded(out, 7)


@query
def reversion_pressure(spark, d):
    out = _scored(spark, d).select("series_id", "date", signals.reversion_pressure(F.col("z")).alias("pressure"))
    return rounded(out, 7)


@query
def softmax(spark, d):
    scaled = S.daily(spark, d).withColumn("x", F.col("price") / 100000)
    return rounded(R.with_softmax(scaled, "x", "share").select("series_id", "date", "share"), 9)


# --- weights and backtest ----------------------------------------------------------------


@query
def alloc_weights(spark, d):
    features = feat.baseline_features(S.daily_all(spark, d), since=None)
    out = B.backtest_weights(features, S.windows(spark, d), S.baseline())
    return rounded(out.select("series_id", "window_start", "date", "weight"), 9)


@query
def weight_summary(spark, d):
    features = feat.baseline_features(S.daily(spark, d), since=None)
    return rounded(spd.weight_summary(B.backtest_weights(features, S.windows(spark, d), S.baseline())), 8)


@query
def check_weights(spark, d):
    features = feat.baseline_features(S.daily(spark, d), since=None)
    return rounded(spd.weight_checks(B.backtest_weights(features, S.windows(spark, d), S.baseline())), 7)


@query
def backtest_spd(spark, d):
    return rounded(_spd(spark, d).select(*SPD_COLUMNS), 4)


@query
def backtest_window_table(spark, d):
    """Backtest over a table of windows: a year and half a year from every start in the span of the days."""
    days = S.daily_all(spark, d)
    span = days.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    both = W.windows_in_span(span, "first", "last", 12).unionByName(W.windows_in_span(span, "first", "last", 6))
    return rounded(B.backtest(days, both, S.baseline()).select(*SPD_COLUMNS), 4)


@query
def backtest_spd_extended(spark, d):
    return rounded(_spd_extended(spark, d).select(*SPD_COLUMNS), 4)


@query
def window_weights_midway(spark, d):
    return rounded(_weights_on(spark, d, MIDWAY_DAY).drop("window_end"), 9)


@query
def locked_update(spark, d):
    """Days decided between two dates, given the weights stored on the first."""
    stored = locked.to_locked(_weights_on(spark, d, LOCK_DAY), LOCK_DAY)
    later = _weights_on(spark, d, NEXT_LOCK_DAY, stored)
    return rounded(locked.new_locked(later, NEXT_LOCK_DAY), 9)


@query
def locked_rerun(spark, d):
    """The lock job run a second time on its day, which adds nothing, and on the day after: a row for each open window."""
    stored = locked.to_locked(_weights_on(spark, d, LOCK_DAY), LOCK_DAY)
    again = locked.new_locked(_weights_on(spark, d, LOCK_DAY, stored), LOCK_DAY).withColumn("run", F.lit("again"))
    after = locked.new_locked(_weights_on(spark, d, DAY_AFTER_LOCK, stored), DAY_AFTER_LOCK).withColumn("run", F.lit("day after"))
    return rounded(again.unionByName(after), 9)


@query
def weights_compare(spark, d):
    a, b = _weights_on(spark, d, LOCK_DAY), _weights_on(spark, d, NEXT_LOCK_DAY)
    return rounded(locked.compare_weights(a, b), 9)


@query
def strategy_udf(spark, d):
    """A user function: shares proportional to exp(-2 x distance), by pandas per window."""

    def weigh(window: pd.DataFrame) -> pd.Series:
        raw = np.exp(-2 * window["price_vs_ma"])
        return raw / raw.sum()

    features = feat.baseline_features(S.daily(spark, d), since=None)
    out = B.backtest_python(features, S.windows(spark, d), S.baseline(), weigh)
    return rounded(out.select(*SPD_COLUMNS), 4)


# --- metrics, checks, charts, report -----------------------------------------------------


@query
def exp_decay(spark, d):
    return rounded(metrics.exp_decay_percentile(_spd(spark, d)), 4)


@query
def spd_summary(spark, d):
    return rounded(metrics.spd_summary(_spd(spark, d)), 4)


@query
def score_metrics(spark, d):
    return rounded(metrics.score_metrics(_spd(spark, d)), 4)


@query
def score_metrics_extended(spark, d):
    return rounded(metrics.score_metrics(_spd_extended(spark, d)), 4)


@query
def win_loss(spark, d):
    return rounded(metrics.win_loss(_spd(spark, d)), 6)


@query
def under_performers(spark, d):
    return rounded(metrics.under_performers(_spd(spark, d)), 4)


@query
def leakage_check(spark, d):
    out = B.leakage_check(S.daily(spark, d), S.baseline())
    return rounded(
        out.select("series_id", "probe", "full_multiplier", "masked_multiplier", "full_weight",
                   "masked_weight", "multiplier_leak", "weight_leak"),
        8,
    )


@query
def submission_check(spark, d):
    return rounded(B.submission_check(S.daily(spark, d), S.windows(spark, d), S.baseline()), 6)


@query
def strategy_udf_check(spark, d):
    """The submission check of a user function; it divides by a sum that includes later days, which is found."""

    def weigh(window: pd.DataFrame) -> pd.Series:
        raw = np.exp(-2 * window["price_vs_ma"])
        return raw / raw.sum()

    out = B.submission_check(S.daily_all(spark, d), S.windows(spark, d), S.baseline(), weigh=weigh)
    return rounded(out, 8)


@query
def performance_long(spark, d):
    return rounded(charts.performance_long(_spd(spark, d)), 4)


@query
def excess_histogram(spark, d):
    return rounded(charts.excess_histogram(_spd(spark, d)), 4)


@query
def cumulative_excess(spark, d):
    return rounded(charts.cumulative_excess(_spd(spark, d)), 3)


@query
def metrics_summary(spark, d):
    return charts.metrics_summary(metrics.score_metrics(_spd(spark, d)))


@query
def window_report(spark, d):
    return rounded(charts.window_report(_spd(spark, d)), 4)


@query
def report_documents(spark, d):
    """The JSON report, numbers to four places, without the time it was made at."""
    results = _spd(spark, d)

    def fixed(table: DataFrame) -> DataFrame:
        doubles = [f.name for f in table.schema.fields if isinstance(f.dataType, T.DoubleType)]
        return table.withColumns({c: F.round(c, 4).cast("decimal(20,4)") for c in doubles})

    documents = report.report_documents(fixed(charts.window_report(results)), fixed(metrics.score_metrics(results)))
    return documents.withColumn("document", F.regexp_replace("document", '"timestamp":"[^"]*",', ""))


# Tables of the full analysis in one: key columns, and the places that numbers are rounded to.
ANALYSIS_TABLES = {
    "spd": (("window",), 4),
    "metrics": ((), 4),
    "spd_summary": ((), 4),
    "checks": (("check", "key"), 6),
    "performance": (("date", "strategy"), 4),
    "excess_histogram": (("bin",), 4),
    "win_loss": (("outcome",), 6),
    "cumulative_excess": (("date",), 3),
    "windows": (("window",), 4),
}


@query
def full_analysis(spark, d):
    """Every table that the full analysis writes, read back, as (name, series, key, field, value)."""
    folder = scratch_path(spark, "full-analysis")
    tables = B.run_full_analysis(S.daily(spark, d), S.windows(spark, d), S.baseline(), folder)
    tables["spd"] = tables["spd"].select(*SPD_COLUMNS)
    out = None
    for name, (keys, digits) in ANALYSIS_TABLES.items():
        table = tables[name]
        numbers = [f.name for f in table.schema.fields if f.name not in keys and isinstance(f.dataType, T.NumericType)]
        fields = [F.struct(F.lit(c).alias("field"), F.round(F.col(c).cast("double"), digits).alias("value")) for c in numbers]
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        rows = table.select(F.lit(name).alias("name"), "series_id", key.alias("key"), F.inline(F.array(*fields)))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- scenarios ---------------------------------------------------------------------------


@query
def scenario_spike(spark, d):
    days = scenarios.spike(S.daily(spark, d), PROBE_DAY)
    return rounded(B.backtest(days, S.windows(spark, d), S.baseline()).select(*SPD_COLUMNS), 4)


@query
def scenario_crash(spark, d):
    return rounded(scenarios.crash(S.daily(spark, d), PROBE_DAY), 6)


@query
def scenario_constant(spark, d):
    days = scenarios.constant_price(S.daily(spark, d))
    return rounded(B.backtest(days, S.windows(spark, d), S.baseline()).select(*SPD_COLUMNS), 4)


@query
def scenario_second_half(spark, d):
    return rounded(scenarios.scale_second_half(S.daily(spark, d)), 5)


@query
def scenario_mask(spark, d):
    masked = scenarios.mask_after(S.daily(spark, d), PROBE_DAY, ["price"])
    return features_rounded(feat.baseline_features(masked, since=None))


@query
def scenario_truncate(spark, d):
    known = scenarios.truncate_after(S.daily(spark, d), PROBE_DAY)
    return features_rounded(feat.baseline_features(known, since=None))


@query
def scenario_shuffle(spark, d):
    return scenarios.shuffle_prices(S.daily(spark, d))


# --- exploration -------------------------------------------------------------------------

LINE_METRICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query
def describe(spark, d):
    return rounded(profile.describe(S.table(spark, d, "lineitem"), LINE_METRICS), 4)


@query
def corr_matrix(spark, d):
    return rounded(profile.correlation_matrix(S.table(spark, d, "lineitem"), LINE_METRICS), 7)


@query
def market_totals(spark, d):
    rollup = profile.market_rollup(S.markets(spark, d), S.tokens(spark, d), S.trades(spark, d))
    return rounded(
        profile.market_totals(S.markets(spark, d), S.table(spark, d, "events"), rollup), 2
    )


@query
def top_categories(spark, d):
    parts = S.table(spark, d, "part").select(
        F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("category"),
        F.col("p_retailprice").alias("volume"),
    )
    return rounded(profile.top_categories(parts), 2)


@query
def event_rollup(spark, d):
    return rounded(profile.event_rollup(S.markets_with_end(spark, d)), 2)


@query
def market_rollup(spark, d):
    return profile.market_rollup(S.markets(spark, d), S.tokens(spark, d), S.trades(spark, d))


@query
def market_links(spark, d):
    """Traded value by question, outcome and side over the linked tables."""
    linked = profile.link_trades(S.trades(spark, d), S.tokens(spark, d), S.markets(spark, d))
    out = linked.groupBy("question", "outcome", "side").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("size").alias("size"), F.sum("price").alias("value")
    )
    return rounded(out, 2)


@query
def eda_report(spark, d):
    """The exploratory report over line items as the daily table, parts as markets, events as odds and orders as summary."""
    parts = S.table(spark, d, "part").select(
        F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("category"),
        F.col("p_retailprice").alias("volume"),
        (F.col("p_size") > 25).alias("active"),
    )
    summary = S.table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("trade_count"))
    tables = {"markets": parts, "odds_history": S.table(spark, d, "events"), "summary": summary}
    return rounded(eda_table(S.table(spark, d, "lineitem"), tables, LINE_METRICS, LINE_METRICS), 4)


@query
def odds_links(spark, d):
    """Odds by question, outcome and event over the linked tables."""
    t = S.market_tables(spark, d)
    return links.link_odds(t["odds_history"], t["tokens"], t["markets"])


@query
def event_links(spark, d):
    t = S.market_tables(spark, d)
    return rounded(links.link_events(t["event_stats"], t["markets"]), 2)


@query
def link_audit(spark, d):
    return links.link_audit(S.market_tables(spark, d))


@query
def profile_orders(spark, d):
    """Profile with exact distinct counts."""
    return profile.column_profile(S.table(spark, d, "orders"), exact=True)


@query
def completeness(spark, d):
    return profile.column_profile(S.table(spark, d, "lineitem")).select(
        "column_name", "row_count", "null_count", "null_share"
    )
