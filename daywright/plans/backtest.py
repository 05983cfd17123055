"""Rolling backtest: daily table -> features -> windows -> weights -> SPD table -> report."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywright.functions.numeric import is_close
from daywright.operators import charts, locked, metrics, spd
from daywright.operators.allocation import allocate, past_days, window_totals
from daywright.operators.calendar import fill_gaps
from daywright.operators.cleaning import probe_dates
from daywright.operators.rolling import DEFAULT_KEYS, Keys
from daywright.operators.scenarios import known_at_probes, masked_at_probes
from daywright.operators.windows import BLOCK, RollingWindows, expand_windows
from daywright.plans.strategy import Strategy, python_weights
from daywright.sources.manifest import Manifest
from daywright.sources.report import write_report


Windows = RollingWindows | DataFrame


def window_span(windows: Windows) -> tuple[str, str]:
    """First start and last end of the windows as ISO dates."""
    if isinstance(windows, RollingWindows):
        return windows.start, windows.end
    first, last = windows.agg(F.min("window_start"), F.max("window_end")).first()
    return first.isoformat(), last.isoformat()


def signal_days(
    features: DataFrame,
    strategy: Strategy,
    keys: Keys = DEFAULT_KEYS,
    span: tuple[str, str] | None = None,
) -> DataFrame:
    """(keys, date, price, rate, signals) for every calendar day of each series."""
    wanted = [c for c in features.columns if c in strategy.gap]
    price = F.col(strategy.price)
    slim = features.select(*keys, "date", price.alias("price"), spd.unit_rate(price).alias("rate"), *wanted)
    return fill_gaps(slim, strategy.gap, keys, span)


def multiplier_days(
    features: DataFrame,
    strategy: Strategy,
    keys: Keys = DEFAULT_KEYS,
    span: tuple[str, str] | None = None,
) -> DataFrame:
    """(keys, date, rate, multiplier) for every calendar day, ready for expansion.

    Both numbers are made once per day here, not once per window that holds the day.
    """
    return strategy.multiplier(signal_days(features, strategy, keys, span)).select(
        *keys, "date", "rate", "multiplier", "reach_from", "reach_to"
    )


def backtest_features(
    features: DataFrame,
    windows: Windows,
    strategy: Strategy,
    keys: Keys = DEFAULT_KEYS,
    validate: bool = True,
) -> DataFrame:
    """SPD table of a multiplier strategy over precomputed features."""
    expanded = expand_windows(multiplier_days(features, strategy, keys), windows, keys)
    results = spd.spd_table(window_totals(expanded, keys=keys), keys)
    return spd.with_right_sums(results) if validate else results


def backtest(
    daily: DataFrame, windows: Windows, strategy: Strategy, keys: Keys = DEFAULT_KEYS
) -> DataFrame:
    return backtest_features(strategy.features(daily, keys), windows, strategy, keys)


def backtest_python(
    features: DataFrame,
    windows: Windows,
    strategy: Strategy,
    weigh: Callable[[pd.DataFrame], pd.Series],
    keys: Keys = DEFAULT_KEYS,
    validate: bool = True,
) -> DataFrame:
    """SPD table for a user function; features come from ``strategy``, weights from ``weigh``.

    With ``validate`` the job fails at a window whose weights do not sum to 1.
    """
    expanded = expand_windows(signal_days(features, strategy, keys), windows, keys)
    results = spd.spd_table(spd.rates_from_weights(python_weights(expanded, weigh, keys), keys=keys), keys)
    return spd.with_right_sums(results) if validate else results


def backtest_weights(
    features: DataFrame, windows: Windows, strategy: Strategy, keys: Keys = DEFAULT_KEYS
) -> DataFrame:
    """(keys, window_start, window_end, date, rate, weight) with every day in the past."""
    expanded = expand_windows(multiplier_days(features, strategy, keys), windows, keys)
    return allocate(expanded, keys=keys).drop("multiplier")


def window_weights(
    features: DataFrame,
    windows: Windows,
    strategy: Strategy,
    current_date,
    stored: DataFrame | None = None,
    keys: Keys = DEFAULT_KEYS,
) -> DataFrame:
    """Weights for full nominal windows with a past/future split at ``current_date``.

    Days without data, before, inside or after the history, get placeholder signals. Stored
    weights are used for the past of a window if they cover all of it; with ``stored`` the table
    has ``locked_weight``, what the store holds for each row.
    """
    days = multiplier_days(features, strategy, keys, span=window_span(windows))
    known = None if stored is None else locked.packed(stored, keys[0], isinstance(windows, RollingWindows))
    expanded = expand_windows(days, windows, keys, known=known)
    if known is not None:
        expanded = expanded.withColumnRenamed("known", locked.LOCKED)
    today = current_date if isinstance(current_date, Column) else F.lit(current_date).cast("date")
    n_past = past_days(F.col("window_start"), F.col("window_end"), today)
    weights = allocate(expanded, keys=keys, n_past=n_past, locked=None if known is None else locked.LOCKED)
    kept = [locked.LOCKED] if known is not None else []
    return weights.select(*keys, "window_start", "window_end", "date", "weight", *kept)


def lock_day(
    daily: DataFrame, windows: Windows, strategy: Strategy, path: str, day, keys: Keys = DEFAULT_KEYS
) -> int:
    """The daily job: decide the weights as of ``day`` given the store at ``path``, and store them. Days touched."""
    stored = locked.read_store(daily.sparkSession, path)
    weights = window_weights(strategy.features(daily, keys), windows, strategy, day, stored, keys)
    return locked.append_locked(weights, path, day, keys[0])


# --- checks ------------------------------------------------------------------------------


def _one_window(days: DataFrame) -> DataFrame:
    no_date = F.lit(None).cast("date")
    return days.withColumns({BLOCK: F.lit(0), "window_start": no_date, "window_end": no_date})


def _span_weights(days: DataFrame, keys: Keys) -> DataFrame:
    """Weights over the whole history of each key as one window."""
    return allocate(_one_window(days), keys=keys).select(*keys, "date", "multiplier", "weight")


def leakage_check(
    daily: DataFrame,
    strategy: Strategy,
    probes: DataFrame | None = None,
    keys: Keys = DEFAULT_KEYS,
    features: DataFrame | None = None,
    weigh: Callable[[pd.DataFrame], pd.Series] | None = None,
) -> DataFrame:
    """Does anything about a probe day change when the days after it are blanked?

    Features are rebuilt from a masked copy of the series for every probe. The multiplier
    must not move. The weight may: when the past overspends its budget all weights are
    scaled by a sum that includes later days, so ``weight_leak`` is reported but informational.

    A user function ``weigh`` sees the whole history as one window. It has no multiplier: its
    weight on the probe day takes that place and must not move. ``features`` are those of the
    unmasked series, if at hand.
    """
    probes = probe_dates(daily, keys=keys) if probes is None else probes
    values = [c for c in daily.columns if c not in (*keys, "date")]
    masked = masked_at_probes(daily, probes, values, keys)
    probe_keys = (*keys, "probe")

    def weighted(made: DataFrame, by: Keys) -> DataFrame:
        if weigh is None:
            return _span_weights(multiplier_days(made, strategy, by), by)
        days = _one_window(signal_days(made, strategy, by))
        return python_weights(days, weigh, by).select(*by, "date", F.col("weight").alias("multiplier"), "weight")

    full = weighted(strategy.features(daily, keys) if features is None else features, keys).select(
        *keys, F.col("date").alias("probe"), F.col("multiplier").alias("full_multiplier"),
        F.col("weight").alias("full_weight"),
    )
    seen = weighted(strategy.features(masked, probe_keys), probe_keys).where(F.col("date") == F.col("probe")).select(
        *probe_keys, F.col("multiplier").alias("masked_multiplier"), F.col("weight").alias("masked_weight")
    )
    same = lambda a, b: F.coalesce(is_close(F.col(a), F.col(b), 1e-9, 1e-12), F.lit(False))
    return seen.join(full, list(probe_keys)).withColumns(
        {
            "multiplier_leak": ~same("masked_multiplier", "full_multiplier"),
            "weight_leak": ~same("masked_weight", "full_weight"),
        }
    )


def prefix_check(
    daily: DataFrame,
    strategy: Strategy,
    probes: DataFrame,
    keys: Keys = DEFAULT_KEYS,
    features: DataFrame | None = None,
) -> DataFrame:
    """(keys, probe, multiplier of the whole series, of the days up to the probe, leak).

    The check of ``leakage_check`` where only the multiplier counts: a probe sees the rows up to its
    day and nothing else, so on average half a series is copied, and no weights are built.
    """
    whole = strategy.features(daily, keys) if features is None else features
    seen = strategy.features(known_at_probes(daily, probes, keys), (*keys, "probe"))

    def at_probe(made: DataFrame, out: str) -> DataFrame:
        slim = made.select(*dict.fromkeys([*keys, *[c for c in ("probe",) if c in made.columns], "date", *[c for c in made.columns if c in strategy.gap]]))
        return strategy.multiplier(slim).withColumnRenamed("multiplier", out)

    known = at_probe(seen.where(F.col("date") == F.col("probe")), "seen_multiplier").select(*keys, "probe", "seen_multiplier")
    full = at_probe(whole, "full_multiplier").select(*keys, F.col("date").alias("probe"), "full_multiplier")
    same = F.coalesce(is_close(F.col("seen_multiplier"), F.col("full_multiplier"), 1e-9, 1e-12), F.lit(False))
    return known.join(full, [*keys, "probe"]).withColumn("leak", ~same)


def submission_check(
    daily: DataFrame,
    windows: Windows,
    strategy: Strategy,
    keys: Keys = DEFAULT_KEYS,
    features: DataFrame | None = None,
    weigh: Callable[[pd.DataFrame], pd.Series] | None = None,
) -> DataFrame:
    """(keys, check, key, detail, passed): leakage, weights, worse windows, win rate.

    Worse windows are listed for information and pass. Ties count as wins in the win rate.
    The weights are built once; each window row yields the entries of all window checks.
    Leakage is probed on every k-th day of the windows' range: the multiplier of the series known on
    that day must be the whole series'. With ``weigh`` the weights of that user function are checked
    instead of the strategy's, on masked copies, as it sees a whole window.
    """
    features = strategy.features(daily, keys) if features is None else features
    probes = probe_dates(daily.where(F.col("date").between(*map(F.lit, window_span(windows)))), keys=keys)
    if weigh is None:
        probed = prefix_check(daily, strategy, probes, keys, features)
        gap, leak = F.col("seen_multiplier") - F.col("full_multiplier"), F.col("leak")
    else:
        probed = leakage_check(daily, strategy, probes, keys, features, weigh)
        gap, leak = F.col("masked_multiplier") - F.col("full_multiplier"), F.col("multiplier_leak")
    leaks = probed.select(
        *keys,
        F.lit("forward_leakage").alias("check"),
        F.date_format("probe", "yyyy-MM-dd").alias("key"),
        F.abs(gap).alias("detail"),
        (~leak).alias("passed"),
    )
    if weigh is None:
        weights = backtest_weights(features, windows, strategy, keys)
    else:
        weights = python_weights(expand_windows(signal_days(features, strategy, keys), windows, keys), weigh, keys)
    results = spd.spd_table(spd.rates_from_weights(weights, keys=keys), keys)
    series = Window.partitionBy(*keys)
    lost = F.col("dynamic_percentile") < F.col("uniform_percentile")
    judged = results.withColumn("_lost", F.coalesce(lost, F.lit(False))).withColumns(
        {
            "_win_rate": 1 - F.avg(F.col("_lost").cast("double")).over(series),
            "_nth": F.row_number().over(series.orderBy("window_start", "window_end")),
        }
    )

    def check(name: str, key: Column, detail: Column, passed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check"), key.alias("key"), detail.alias("detail"), passed.alias("passed")
        )

    right = spd.sums_to_one(F.col("weight_sum")) & (F.col("negative_weights") == 0)
    found = F.array(
        check("weights", F.col("window"), F.col("weight_sum"), right),
        F.when(
            F.col("_lost"),
            check("under_performer", F.col("window"), F.col("excess_percentile"), F.lit(True)),
        ),
        F.when(
            F.col("_nth") == 1,
            check("win_rate", F.lit("all windows"), F.col("_win_rate"), F.col("_win_rate") >= 0.5),
        ),
    )
    of_windows = judged.select(*keys, F.inline(F.filter(found, lambda c: c.isNotNull())))
    return leaks.unionByName(of_windows)


def ready(checks: DataFrame, keys: Keys = DEFAULT_KEYS) -> DataFrame:
    """One row per series: does every check pass?"""
    return checks.groupBy(*keys).agg(F.every("passed").alias("ready"))


# --- full analysis -----------------------------------------------------------------------


def run_full_analysis(
    daily: DataFrame,
    windows: Windows,
    strategy: Strategy,
    output: str,
    keys: Keys = DEFAULT_KEYS,
    weigh: Callable[[pd.DataFrame], pd.Series] | None = None,
    version: str = "",
) -> dict[str, DataFrame]:
    """Backtest, validate and write every table and the report below ``output``.

    With ``weigh`` all of it is about that user function, over the strategy's features.

    Features and the SPD table are written once and read back, so later steps do not repeat
    them and a lost executor costs no more than its own tasks. Each table appears by one rename, after
    which the manifest names it; a run that was cut off resumes behind the last table that the manifest
    lists for the same input. Content of days and windows, the strategy's label and ``version`` say
    what the same input is: functions can't be compared, so a changed one needs another version.
    """
    run = Manifest(daily.sparkSession, output, input_fingerprint(daily, windows, strategy.label, keys, weigh is not None, version))
    features = run.keep("features", lambda: strategy.features(daily, keys))

    def spd_results() -> DataFrame:
        if weigh is None:
            return backtest_features(features, windows, strategy, keys, validate=False)
        return backtest_python(features, windows, strategy, weigh, keys, validate=False)

    results = run.keep("spd", spd_results)
    spd.assert_weight_sums(results)
    steps: dict[str, Callable[[], DataFrame]] = {
        "metrics": lambda: metrics.score_metrics(results, keys),
        "spd_summary": lambda: metrics.spd_summary(results, keys),
        "checks": lambda: submission_check(daily, windows, strategy, keys, features, weigh),
        "performance": lambda: charts.performance_long(results, keys),
        "excess_histogram": lambda: charts.excess_histogram(results, keys=keys),
        "win_loss": lambda: metrics.win_loss(results, keys),
        "cumulative_excess": lambda: charts.cumulative_excess(results, keys),
        "metrics_summary": lambda: charts.metrics_summary(saved["metrics"], keys),
        "windows": lambda: charts.window_report(results, keys),
    }
    saved: dict[str, DataFrame] = {}
    for name, made in steps.items():
        saved[name] = run.keep(name, made)
    write_report(saved["windows"], saved["metrics"], f"{output}/report", keys)
    return {"features": features, "spd": results, **saved}


def input_fingerprint(
    daily: DataFrame, windows: Windows, label: str, keys: Keys, user_function: bool, version: str = ""
) -> str:
    """A digest of what the analysis is made from; the order and the layout of the rows don't matter."""

    def content(table: DataFrame) -> str:
        columns = sorted(table.columns)
        row = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
        # Sums of two independent hashes tell tables apart that hold a row more or less often.
        sums = [F.sum(h.cast("decimal(38,0)")) for h in (row, F.xxhash64(F.lit("second"), row))]
        return "|".join(map(str, (columns, *table.agg(F.count(F.lit(1)), *sums).first())))

    span = repr(windows) if isinstance(windows, RollingWindows) else content(windows)
    text = "\n".join((content(daily), span, label, ",".join(keys), str(user_function), version))
    return hashlib.sha256(text.encode()).hexdigest()
