"""SQL counterparts of the registered queries, over the same tables.

Each is written from the rules: windows by range join, weights day by day. Rounded results
add 0.0, so a negative zero reads as zero.
"""

from __future__ import annotations

from daywright.catalog import standins as S
from daywright.catalog.queries import ANALYSIS_TABLES, DAY_AFTER_LOCK, LINE_METRICS, LOCK_DAY, MIDWAY_DAY, MISSING_SINCE, NEXT_LOCK_DAY, PROBE_DAY


def r(expression: str, digits: int, name: str | None = None) -> str:
    text = f"(round({expression}, {digits}) + 0.0)"
    return f"{text} AS {name}" if name else text


def clipped(x: str, low, high) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(CAST({low} AS DOUBLE), least(CAST({high} AS DOUBLE), {x})) END"


def statement(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


# --- building blocks ---------------------------------------------------------------------


def daily_cte(series: str = "o_orderpriority", name: str = "daily") -> str:
    return f"""{name} AS (
  SELECT {series} AS series_id, CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 6) AS price
  FROM orders GROUP BY 1, 2)"""


def feature_cte(source: str = "daily", name: str = "feat", key: str = "series_id") -> str:
    pvm = clipped("price / price_ma - 1", -1, 1)
    return f"""{name} AS (
  SELECT {key}, date, price, price_ma,
         coalesce(lag(pvm) OVER (PARTITION BY {key} ORDER BY date), 0) AS price_vs_ma
  FROM (SELECT *, coalesce({pvm}, 0) AS pvm
        FROM (SELECT {key}, date, price,
                     CASE WHEN count(price) OVER f >= 100 THEN avg(price) OVER f END AS price_ma
              FROM {source}
              WINDOW f AS (PARTITION BY {key} ORDER BY date ROWS 199 PRECEDING)) a) b)"""


def windows_cte() -> str:
    return """orders_span AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders),
calendar AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM orders_span),
windows AS (
  SELECT date AS window_start, CAST(date + INTERVAL 1 YEAR AS DATE) AS window_end
  FROM calendar, orders_span WHERE CAST(date + INTERVAL 1 YEAR AS DATE) <= b)"""


LOG_MA = "CASE WHEN price_ma > 0 THEN ln(price_ma) END"
BASE_MULTIPLIER = "exp(greatest(-3.0, least(3.0, -2.0 * price_vs_ma)))"


def expanded_cte(multiplier: str = BASE_MULTIPLIER, feat: str = "feat", price: str = "price") -> str:
    """Calendar days between the first and last present day of each window."""
    return f"""spans AS (
  SELECT f.series_id, w.window_start, w.window_end, min(f.date) AS a, max(f.date) AS b
  FROM {feat} f JOIN windows w ON f.date BETWEEN w.window_start AND w.window_end
  GROUP BY 1, 2, 3),
expanded AS (
  SELECT s.series_id, s.window_start, s.window_end, c.date, f.{price} AS price,
         CASE WHEN f.date IS NULL THEN 1.0 ELSE {multiplier} END AS m
  FROM spans s JOIN calendar c ON c.date BETWEEN s.a AND s.b
  LEFT JOIN {feat} f ON f.series_id = s.series_id AND f.date = c.date)"""


def weights_cte(source: str = "expanded", keys: str = "series_id, window_start, window_end",
                n_past: str = "n", stored: str | None = None, name: str = "weights") -> str:
    locked = "sig / n" if stored is None else (
        f"CASE WHEN count(CASE WHEN i <= k THEN {stored} END) OVER p >= k THEN {stored} ELSE sig / n END")
    return f"""{name} AS (
  SELECT *, CASE WHEN k <= 0 THEN 1.0 / n
                 WHEN i = n THEN greatest(1.0 - coalesce(sum(CASE WHEN i < n THEN v END) OVER p, 0), 0)
                 ELSE v END AS weight
  FROM (SELECT *, CASE WHEN i > k THEN 1.0 / n
                       WHEN spent > k / n + 1e-10 THEN u * (k / n) / spent ELSE u END AS v
        FROM (SELECT *, sum(CASE WHEN i <= k THEN u END) OVER p AS spent
              FROM (SELECT *, {locked} AS u
                    FROM (SELECT *, least({n_past}, n) AS k
                          FROM (SELECT *, m / avg(m) OVER (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING) AS sig,
                                       row_number() OVER (PARTITION BY {keys} ORDER BY date) AS i,
                                       CAST(count(*) OVER (PARTITION BY {keys}) AS DOUBLE) AS n
                                FROM {source}) w1) w2
                    WINDOW p AS (PARTITION BY {keys})) w3
              WINDOW p AS (PARTITION BY {keys})) w4) w5
  WINDOW p AS (PARTITION BY {keys}))"""


def spd_cte(source: str = "weights") -> str:
    return f"""rates AS (
  SELECT series_id, window_start, window_end, min(1e8 / price) AS lo, max(1e8 / price) AS hi,
         avg(1e8 / price) AS uni, coalesce(sum(weight * (1e8 / price)), 0) AS dyn
  FROM {source} GROUP BY 1, 2, 3),
spd AS (
  SELECT series_id, window_start, window_end,
         strftime(window_start, '%Y-%m-%d') || ' → ' || strftime(window_end, '%Y-%m-%d') AS window_label,
         lo, hi, uni, dyn,
         CASE WHEN hi > lo THEN (uni - lo) / (hi - lo) * 100 END AS up,
         CASE WHEN hi > lo THEN (dyn - lo) / (hi - lo) * 100 END AS dp
  FROM rates)"""


SPD_SELECT = f"""SELECT series_id, window_label AS "window", {r('lo', 4, 'min_sats_per_dollar')},
 {r('hi', 4, 'max_sats_per_dollar')}, {r('uni', 4, 'uniform_sats_per_dollar')},
 {r('dyn', 4, 'dynamic_sats_per_dollar')}, {r('up', 4, 'uniform_percentile')},
 {r('dp', 4, 'dynamic_percentile')}, {r('dp - up', 4, 'excess_percentile')} FROM spd"""


def baseline_ctes(daily: str | None = None, source: str = "daily") -> list[str]:
    return [daily or daily_cte(), feature_cte(source), windows_cte(), expanded_cte(), weights_cte(), spd_cte()]


# --- extended model ----------------------------------------------------------------------

ACTIVITY = f"""activity AS (
  SELECT CAST(o_orderdate AS DATE) AS date, count(o_orderkey) AS market_count, coalesce(sum(o_totalprice), 0) AS volume
  FROM orders WHERE regexp_matches(lower(o_orderpriority), '{S.ACTIVITY_PATTERN}') GROUP BY 1)"""


def rank_of(x: str, rows: int, min_rows: int, part: str) -> str:
    order = f"{part} ORDER BY date"
    earlier = f"list({x}) OVER ({order} ROWS BETWEEN {rows - 1} PRECEDING AND 1 PRECEDING)"
    n = f"count(*) OVER ({order} ROWS {rows - 1} PRECEDING)"
    valid = f"count({x}) OVER ({order} ROWS {rows - 1} PRECEDING)"
    return f"""CASE WHEN {valid} >= {min_rows} THEN CASE WHEN {n} = 1 THEN 0.5
      ELSE coalesce(len(list_filter({earlier}, lambda v: v < {x})), 0) / CAST(greatest({n} - 1, 1) AS DOUBLE) END END"""


SENTIMENT = f"""ranked AS (
  SELECT date, {rank_of('market_count', 30, 1, '')} AS c, {rank_of('volume', 30, 1, '')} AS v FROM activity),
sentiment AS (SELECT date, coalesce(0.5 * c + 0.5 * v, 0.5) AS sentiment FROM ranked)"""


def zscore_sql(x: str, rows: int, part: str = "PARTITION BY series_id") -> str:
    f = f"({part} ORDER BY date ROWS {rows - 1} PRECEDING)"
    return f"""CASE WHEN count({x}) OVER {f} < {rows // 2} OR {x} IS NULL THEN 0.0
      WHEN stddev_samp({x}) OVER {f} = 0 THEN
        CASE WHEN {x} > avg({x}) OVER {f} THEN 1e300 WHEN {x} < avg({x}) OVER {f} THEN -1e300 ELSE 0.0 END
      ELSE ({x} - avg({x}) OVER {f}) / stddev_samp({x}) OVER {f} END"""


def ema_sql(x: str, span: int, rows: int) -> str:
    alpha = f"CAST({2.0 / (span + 1)!r} AS DOUBLE)"
    values = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY series_id ORDER BY date ROWS {rows} PRECEDING)"
    return f"""CASE WHEN len({values}) > 0 THEN
      list_reduce({values}, lambda a, b: a * (1 - {alpha}) + b * {alpha}) END"""


def diff_sql(x: str, rows: int) -> str:
    return f"{x} - lag({x}, {rows}) OVER (PARTITION BY series_id ORDER BY date)"


def extended_ctes() -> list[str]:
    lag = lambda c, default: (
        f"coalesce(lag({c}) OVER (PARTITION BY series_id ORDER BY date), {default}) AS {c}")
    vol = ("CASE WHEN count(z) OVER (PARTITION BY series_id ORDER BY date ROWS 89 PRECEDING) >= 22 "
           "THEN round(stddev_samp(z) OVER (PARTITION BY series_id ORDER BY date ROWS 89 PRECEDING), 12) END")
    zone = "CASE WHEN z < -2 THEN -2 WHEN z < -1 THEN -1 WHEN z < 1.5 THEN 0 WHEN z < 2.5 THEN 1 ELSE 2 END"
    agree = "1.0 - " + clipped("abs(-z / 4 - (-price_vs_ma)) / 2", 0, 1)
    align = ("CASE WHEN -z / 4 < 0 THEN CASE WHEN grad > 0 THEN 1.0 ELSE 0.5 END "
             "ELSE CASE WHEN grad < 0 THEN 1.0 ELSE 0.5 END END")
    return [
        daily_cte(),
        ACTIVITY,
        SENTIMENT,
        feature_cte(),
        """ratio AS (
  SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) / (avg(l_quantity) * 1000) AS mvrv
  FROM lineitem GROUP BY 1)""",
        f"""x1 AS (SELECT series_id, date, {clipped(zscore_sql('mvrv', 365), -4, 4)} AS z
  FROM (SELECT d.series_id, d.date, mvrv FROM daily d LEFT JOIN ratio r ON r.date = d.date) t)""",
        f"x2 AS (SELECT *, {diff_sql('z', 30)} AS gd FROM x1)",
        f"x3 AS (SELECT *, coalesce(tanh(2 * ({ema_sql('gd', 30, 999)})), 0) AS grad FROM x2)",
        f"x4 AS (SELECT *, {diff_sql('grad', 14)} AS ad FROM x3)",
        f"x5 AS (SELECT *, coalesce(tanh(3 * ({ema_sql('ad', 14, 999)})), 0) AS acc, {vol} AS vol FROM x4)",
        f"""x6 AS (SELECT series_id, date, z, grad, acc, CAST({zone} AS DOUBLE) AS zone,
    coalesce({rank_of('vol', 360, 90, 'PARTITION BY series_id')}, 0.5) AS vrank FROM x5)""",
        """x7 AS (SELECT x6.*, coalesce(s.sentiment, 0.5) AS sentiment
  FROM x6 LEFT JOIN sentiment s ON s.date = x6.date)""",
        f"""x8 AS (SELECT series_id, date, {lag('z', 0.0)}, {lag('grad', 0.0)}, {lag('acc', 0.0)},
    {lag('zone', 0.0)}, {lag('vrank', 0.5)}, {lag('sentiment', 0.5)} FROM x7)""",
        f"""ext AS (SELECT x8.*, f.price, f.price_ma, f.price_vs_ma,
    {clipped(f'0.7 * ({agree}) + 0.3 * ({align})', 0, 1)} AS conf
  FROM x8 JOIN feat f ON f.series_id = x8.series_id AND f.date = x8.date)""",
    ]


BOOST = """CASE WHEN z < -2 THEN 0.8 * (z + 2) * (z + 2) + 0.5 WHEN z < -1 THEN -0.5 * z
  WHEN z >= 2.5 THEN -0.5 * (z - 2.5) * (z - 2.5) - 0.3 WHEN z >= 1.5 THEN -0.3 * (z - 1.5) ELSE 0.0 END"""
NEED = "(CASE WHEN z < -1 THEN 0.1 WHEN z > 1.5 THEN 0.4 ELSE 0.2 END)"
TREND = clipped(
    f"(CASE WHEN grad > {NEED} THEN 1 + 0.5 * least(grad, 1.0) WHEN grad < -{NEED} THEN 0.3 + 0.2 * (1 + grad) ELSE 1.0 END)",
    0.3, 1.5)
ACCEL = clipped("(CASE WHEN acc * grad > 0 THEN 1 + 0.3 * abs(acc) ELSE 1 - 0.2 * abs(acc) END)", 0.5, 1.5)


def exponent_sql() -> str:
    half = lambda c: f"(CASE WHEN {c} = 0 THEN 0.5 ELSE {c} END)"
    conf, vol, sent = half("conf"), half("vrank"), half("sentiment")
    mix = f"((-z + ({BOOST})) * 0.64 + (-price_vs_ma * ({TREND})) * 0.16 + (({sent} - 0.5) * 0.2) * 0.20)"
    momentum = clipped(f"0.85 + 0.30 * (({ACCEL}) - 0.5) / 0.5", 0.85, 1.15)
    sure = f"(CASE WHEN {conf} > 0.7 THEN 1.0 + 0.15 * ({conf} - 0.7) / 0.3 ELSE 1.0 END)"
    calm = f"(CASE WHEN {vol} > 0.8 THEN 1.0 - 0.2 * ({vol} - 0.8) / 0.2 ELSE 1.0 END)"
    return clipped(f"5.0 * {mix} * ({momentum}) * {sure} * {calm}", -5, 100)


def extended_spd_ctes() -> list[str]:
    return [*extended_ctes(), windows_cte(), f"extm AS (SELECT *, exp({exponent_sql()}) AS mult FROM ext)",
            expanded_cte("mult", "extm"), weights_cte(), spd_cte()]


# --- metrics -----------------------------------------------------------------------------

DECAY = """decay AS (
  SELECT series_id, CASE WHEN count(dp) = count(*) THEN sum(dp * pow(0.9, age)) / sum(pow(0.9, age)) END AS ed
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY window_start DESC) - 1 AS age FROM spd) t
  GROUP BY 1)"""
SCORES = """scores AS (
  SELECT s.series_id, avg(CASE WHEN dp > up THEN 1.0 ELSE 0.0 END) * 100 AS win_rate, max(ed) AS ed,
         avg(dp - up) AS me, median(dp - up) AS mde,
         avg((dp - up) / (CASE WHEN up = 0 THEN 0.01 ELSE up END) * 100) AS mr,
         median((dp - up) / (CASE WHEN up = 0 THEN 0.01 ELSE up END) * 100) AS mdr,
         avg(dp / up) AS ra, median(dp / up) AS mdra, count(*) AS n,
         count(CASE WHEN dp > up THEN 1 END) AS wins
  FROM spd s JOIN decay d ON d.series_id = s.series_id GROUP BY 1)"""
SCORE_SELECT = f"""SELECT series_id, {r('0.5 * win_rate + 0.5 * ed', 4, 'score')}, {r('win_rate', 4, 'win_rate')},
 {r('ed', 4, 'exp_decay_percentile')}, {r('me', 4, 'mean_excess')}, {r('mde', 4, 'median_excess')},
 {r('mr', 4, 'relative_improvement_pct_mean')}, {r('mdr', 4, 'relative_improvement_pct_median')},
 {r('ra', 4, 'mean_ratio')}, {r('mdra', 4, 'median_ratio')}, n AS total_windows, wins, n - wins AS losses
 FROM scores"""


def summary_select() -> str:
    rows = [
        ("Final Model Score", "0.5 * win_rate + 0.5 * ed", "{:.2f}%"),
        ("Win Rate", "win_rate", "{:.2f}%"),
        ("Exponential Decay Percentile", "ed", "{:.2f}%"),
        ("Mean Excess Percentile", "me", "{:.2f}%"),
        ("Median Excess Percentile", "mde", "{:.2f}%"),
        ("Mean Relative Improvement", "mr", "{:.2f}%"),
        ("Median Relative Improvement", "mdr", "{:.2f}%"),
        ("Mean Ratio (Dynamic/Uniform)", "ra", "{:.2f}"),
        ("Median Ratio (Dynamic/Uniform)", "mdra", "{:.2f}"),
        ("Total Windows", "n", "{}"),
        ("Wins", "wins", "{}"),
        ("Losses", "n - wins", "{}"),
    ]
    return " UNION ALL ".join(
        f"SELECT series_id, {i} AS position, '{label}' AS metric, format('{fmt}', {x}) AS value FROM scores"
        for i, (label, x, fmt) in enumerate(rows, 1))


# --- nominal windows (past/future split) -------------------------------------------------


def nominal_ctes(day: str, suffix: str = "", stored: str | None = None) -> list[str]:
    """Weights of full nominal windows as of a day."""
    k = f"greatest(datediff('day', window_start, least(DATE '{day}', window_end)) + 1, 0)"
    join = "" if stored is None else (
        f" LEFT JOIN {stored} l ON l.window_start = w.window_start AND l.window_end = w.window_end AND l.date = c.date")
    column = "" if stored is None else ", l.weight AS stored_weight"
    source = f"nominal{suffix}"
    return [
        f"""{source} AS (
  SELECT 'ALL' AS series_id, w.window_start, w.window_end, c.date,
         CASE WHEN f.date IS NULL THEN 1.0 ELSE {BASE_MULTIPLIER} END AS m{column}
  FROM windows w JOIN calendar c ON c.date BETWEEN w.window_start AND w.window_end
  LEFT JOIN feat f ON f.date = c.date{join})""",
        weights_cte(source, n_past=k, stored=None if stored is None else "stored_weight", name=f"w{suffix}"),
    ]


# --- registry ----------------------------------------------------------------------------


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    daily, feat, win = daily_cte(), feature_cte(), windows_cte()
    base = baseline_ctes()
    all_daily = daily_cte("'ALL'")

    q["clean_daily"] = """SELECT series_id, date, price FROM (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS price,
         row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS rn
  FROM orders) t WHERE rn = 1"""
    q["missing_prices"] = f"""SELECT o_orderpriority AS series_id, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS missing_prices,
  min(CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) END) AS first_missing,
  max(CAST(o_orderdate AS DATE)) AS latest_date
  FROM orders WHERE o_orderdate >= DATE '{MISSING_SINCE}' GROUP BY 1"""
    q["calendar_gaps"] = statement([daily, win], """SELECT s.series_id, c.date
  FROM (SELECT series_id, min(date) AS a, max(date) AS b FROM daily GROUP BY 1) s
  JOIN calendar c ON c.date BETWEEN s.a AND s.b
  LEFT JOIN daily d ON d.series_id = s.series_id AND d.date = c.date WHERE d.date IS NULL""")
    shrunk = "CASE WHEN event_type = 'error' THEN 0 ELSE CAST(round(epoch_us(ts) / 1000.0) AS BIGINT) END"
    fixed = f"make_timestamp(({shrunk}) * 1000)"
    q["repair_timestamps"] = f"""SELECT event_id, event_type,
  CASE WHEN {fixed} >= TIMESTAMP '2020-01-01' THEN {fixed} END AS timestamp FROM events"""
    q["audit_timestamps"] = f"""SELECT 'stored' AS table_name, 'timestamp' AS column_name,
  count(CASE WHEN make_timestamp({shrunk}) < TIMESTAMP '2020-01-01' THEN 1 END) AS pre_2020_rows, count(*) AS valid_rows FROM events
  UNION ALL SELECT 'repaired', 'timestamp', 0, count(CASE WHEN {fixed} >= TIMESTAMP '2020-01-01' THEN 1 END) FROM events"""
    probes = """probes AS (
  SELECT series_id, date AS probe FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i,
           count(*) OVER (PARTITION BY series_id) AS n FROM daily) t
  WHERE i % greatest(n // 50, 1) = 0)"""
    q["parse_text_timestamps"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 6 THEN o_orderdate END AS created_at FROM orders"""
    q["ingest_rejects"] = """SELECT 'created_at' AS column_name, count(*) AS "rows", count(CASE WHEN o_orderkey % 8 < 6 THEN 1 END) AS "values",
  count(CASE WHEN o_orderkey % 8 = 6 THEN 1 END) AS unreadable, min(CASE WHEN o_orderkey % 8 = 6 THEN 'soon-' || o_orderkey END) AS first_unreadable FROM orders
  UNION ALL SELECT 'price', count(*), count(CASE WHEN o_orderstatus <> 'P' THEN 1 END), count(CASE WHEN o_orderstatus = 'P' THEN 1 END),
  min(CASE WHEN o_orderstatus = 'P' THEN 'about ' || o_custkey END) FROM orders
  UNION ALL SELECT 'customer', count(*), count(o_custkey), 0, NULL FROM orders UNION ALL SELECT '_corrupt', count(*), 0, 0, NULL FROM orders"""
    q["probe_dates"] = statement([daily, probes], "SELECT * FROM probes")
    q["last_price"] = statement([daily], """SELECT series_id, date AS last_date, price AS last_price FROM daily d
  WHERE date = (SELECT max(date) FROM daily e WHERE e.series_id = d.series_id)""")

    label = "strftime(ws, '%Y-%m-%d') || ' → ' || strftime(we, '%Y-%m-%d')"
    q["windows"] = statement([daily, win], f"""SELECT series_id, ws AS window_start, we AS window_end,
  {label} AS "window", datediff('day', ws, we) + 1 AS days
  FROM (SELECT s.series_id, c.date AS ws, CAST(c.date + INTERVAL 1 YEAR AS DATE) AS we, s.b
        FROM (SELECT series_id, min(date) AS a, max(date) AS b FROM daily GROUP BY 1) s
        JOIN calendar c ON c.date BETWEEN s.a AND CAST(s.b - INTERVAL 1 YEAR AS DATE)) t WHERE we <= b""")
    q["label_dates"] = q["windows"].replace("SELECT series_id, ws AS window_start, we AS window_end,", "SELECT series_id, ws AS start,").replace(
        f"""{label} AS "window", datediff('day', ws, we) + 1 AS days""", f"""{label} AS "window\"""")
    q["ranges_by_start"] = statement([all_daily, win], """SELECT ws AS window_start,
  string_agg(strftime(we, '%Y-%m-%d'), ',' ORDER BY we) AS window_ends
  FROM (SELECT c.date AS ws, CAST(c.date + to_months(m) AS DATE) AS we, s.b
        FROM (SELECT min(date) AS a, max(date) AS b FROM daily) s, (VALUES (12), (6)) v(m), calendar c
        WHERE c.date BETWEEN s.a AND CAST(s.b - to_months(m) AS DATE)) t WHERE we <= b GROUP BY 1""")
    q["calendar_completion"] = statement([daily, win], """SELECT s.series_id, c.date, coalesce(d.price, 0.0) AS price,
  (SELECT max(date) FROM daily p WHERE p.series_id = s.series_id AND p.date <= c.date) AS reach_from,
  (SELECT min(date) FROM daily p WHERE p.series_id = s.series_id AND p.date >= c.date) AS reach_to
  FROM (SELECT series_id, min(date) AS a, max(date) AS b FROM daily GROUP BY 1) s
  JOIN calendar c ON c.date BETWEEN s.a AND s.b
  LEFT JOIN daily d ON d.series_id = s.series_id AND d.date = c.date""")
    q["reindex_activity"] = statement([daily], f"""SELECT d.series_id, d.date, {r('coalesce(a.volume, 0)', 2, 'volume')}
  FROM daily d LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS volume
    FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a ON a.date = d.date""")
    q["date_sets"] = """WITH a AS (SELECT DISTINCT CAST(left(o_orderpriority, 1) AS INTEGER) AS pair, CAST(o_orderdate AS DATE) AS date FROM orders),
b AS (SELECT CASE WHEN pair = 1 THEN 5 ELSE pair - 1 END AS pair, date FROM a)
SELECT pair, date, 'common' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x
UNION ALL SELECT pair, date, 'absent' AS kind FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y"""

    feature_select = f"SELECT series_id, date, price, {r(LOG_MA, 8, 'log_price_ma')}, {r('price_vs_ma', 7, 'price_vs_ma')}"
    q["features_baseline"] = statement([daily, feat], f"{feature_select}, {r(BASE_MULTIPLIER, 7, 'multiplier')} FROM feat")
    zs = f"scored AS (SELECT series_id, date, {zscore_sql('price', 365)} AS z FROM daily)"
    q["zscore"] = statement([daily, zs], f"SELECT series_id, date, {r('z', 7, 'zscore')} FROM scored")
    q["ema"] = statement([daily], f"""SELECT series_id, date, {r(ema_sql('price', 30, 999), 4, 'ema_30')},
  {r(ema_sql('price', 14, 999), 4, 'ema_14')} FROM daily""")
    alpha = {span: f"CAST({2.0 / (span + 1)!r} AS DOUBLE)" for span in (30, 3)}
    step = lambda span: f"""CASE WHEN c.price IS NULL THEN e.y{span} WHEN e.y{span} IS NULL THEN c.price
      ELSE (pow(1 - {alpha[span]}, e.gap + 1) * e.y{span} + {alpha[span]} * c.price) / (pow(1 - {alpha[span]}, e.gap + 1) + {alpha[span]}) END"""  # noqa: E731
    q["ema_gaps"] = f"""WITH RECURSIVE {daily},
days AS (SELECT s.series_id, c.date, d.price, row_number() OVER (PARTITION BY s.series_id ORDER BY c.date) AS n
  FROM (SELECT series_id, min(date) AS a, max(date) AS b FROM daily GROUP BY 1) s
  JOIN (SELECT CAST(unnest(generate_series((SELECT CAST(min(date) AS TIMESTAMP) FROM daily),
    (SELECT CAST(max(date) AS TIMESTAMP) FROM daily), INTERVAL 1 DAY)) AS DATE) AS date) c ON c.date BETWEEN s.a AND s.b
  LEFT JOIN daily d ON d.series_id = s.series_id AND d.date = c.date),
walk AS (SELECT series_id, date, n, price AS y30, price AS y3, 0 AS gap FROM days WHERE n = 1
  UNION ALL SELECT c.series_id, c.date, c.n, {step(30)}, {step(3)}, CASE WHEN c.price IS NULL THEN e.gap + 1 ELSE 0 END
  FROM walk e JOIN days c ON c.series_id = e.series_id AND c.n = e.n + 1)
SELECT series_id, date, {r('y30', 4, 'ema_30')}, {r('y3', 4, 'ema_3')} FROM walk"""
    part = "PARTITION BY series_id"
    q["pct_rank"] = statement([daily], f"""SELECT series_id, date, {r(rank_of('price', 360, 90, part), 9, 'rank_360')},
  {r(rank_of('price', 30, 1, part), 9, 'rank_30')} FROM daily""")
    q["zones"] = statement([daily, zs], """SELECT series_id, CASE WHEN z < -2 THEN -2 WHEN z < -1 THEN -1 WHEN z < 1.5 THEN 0
  WHEN z < 2.5 THEN 1 ELSE 2 END AS zone, count(*) AS days FROM scored GROUP BY 1, 2""")
    q["volatility"] = statement([daily, zs], f"""SELECT series_id, date, {r('''CASE WHEN count(z) OVER v >= 22
  THEN stddev_samp(z) OVER v END''', 7, 'volatility')} FROM scored
  WINDOW v AS (PARTITION BY series_id ORDER BY date ROWS 89 PRECEDING)""")
    q["activity"] = statement([ACTIVITY], f"SELECT date, market_count, {r('volume', 2, 'volume')} FROM activity")
    q["sentiment"] = statement([ACTIVITY, SENTIMENT], f"SELECT date, {r('sentiment', 9, 'sentiment')} FROM sentiment")
    ext = extended_ctes()
    q["features_extended"] = statement(ext, f"""SELECT series_id, date, coalesce(price, 0) AS price, {r(LOG_MA, 8, 'log_price_ma')},
  {r('price_vs_ma', 7, 'price_vs_ma')}, {r('z', 7, 'mvrv_zscore')}, {r('grad', 7, 'mvrv_gradient')},
  {r('acc', 7, 'mvrv_acceleration')}, {r('zone', 7, 'mvrv_zone')}, {r('vrank', 7, 'mvrv_volatility')},
  {r('conf', 7, 'signal_confidence')}, {r('sentiment', 7, 'sentiment')} FROM ext""")
    bare = "SELECT *, 0.0 AS z, 0.0 AS grad, 0.0 AS acc, 0.5 AS vrank, 0.5 AS sentiment FROM feat"
    agree = clipped("1.0 - " + clipped("abs(price_vs_ma) / 2", 0, 1), 0, 1)
    q["neutral_features"] = statement([daily, feat, f"bare AS ({bare})", f"ext AS (SELECT *, 0.7 * ({agree}) + 0.3 * 0.5 AS conf FROM bare)"],
        f"""SELECT series_id, date, coalesce(price, 0) AS price, {r(LOG_MA, 8, 'log_price_ma')}, {r('price_vs_ma', 7, 'price_vs_ma')},
  0.0 AS mvrv_zscore, 0.0 AS mvrv_gradient, 0.0 AS mvrv_acceleration, 0.0 AS mvrv_zone, 0.5 AS mvrv_volatility,
  {r('conf', 7, 'signal_confidence')}, 0.5 AS sentiment, {r(f'exp({exponent_sql()})', 7, 'multiplier')},
  {r(f'exp({exponent_sql()})'.replace('conf', '0.5'), 7, 'multiplier_fewer')} FROM ext""")
    q["multiplier_extended"] = statement(ext, f"SELECT series_id, date, {r(f'({exponent_sql()}) / ln(10)', 7, 'log_multiplier')} FROM ext")
    q["signal_parts"] = statement(ext, f"""SELECT series_id, date, {r(BOOST, 7, 'boost')}, {r(TREND, 7, 'trend')},
  {r(ACCEL, 7, 'acceleration')}, {r('conf', 7, 'confidence')} FROM ext""")
    pressure = clipped("tanh(z * 0.5) + CASE WHEN abs(z) > 2 THEN sign(z) * 0.3 * (abs(z) - 2) ELSE 0 END", -1, 1)
    q["reversion_pressure"] = statement([daily, zs], f"SELECT series_id, date, {r(pressure, 7, 'pressure')} FROM scored")
    q["softmax"] = statement([daily], f"""SELECT series_id, date, {r('ex / sum(ex) OVER (PARTITION BY series_id)', 9, 'share')}
  FROM (SELECT *, exp(price / 100000 - max(price / 100000) OVER (PARTITION BY series_id)) AS ex FROM daily) t""")

    weights = [daily, feat, win, expanded_cte(), weights_cte()]
    q["alloc_weights"] = statement([all_daily, *weights[1:]], f"SELECT series_id, window_start, date, {r('weight', 9, 'weight')} FROM weights")
    q["weight_summary"] = statement(weights, f"""SELECT series_id, window_start, window_end, count(weight) AS n,
  {r('sum(weight)', 8, 'sum_weight')}, {r('min(weight)', 8, 'min_weight')}, {r('max(weight)', 8, 'max_weight')},
  {r('avg(weight)', 8, 'mean_weight')}, {r('stddev_samp(weight)', 8, 'std_weight')} FROM weights GROUP BY 1, 2, 3""")
    q["check_weights"] = statement(weights, f"""SELECT series_id, window_start, window_end, {r('sum(weight)', 7, 'weight_sum')},
  count(CASE WHEN weight < 0 THEN 1 END) AS negative_weights, abs(sum(weight) - 1) <= 1e-8 + 1e-5 AS sum_ok,
  abs(sum(weight) - 1) <= 1e-8 + 1e-5 AND count(CASE WHEN weight < 0 THEN 1 END) = 0 AS passed
  FROM weights GROUP BY 1, 2, 3""")
    q["backtest_spd"] = statement(base, SPD_SELECT)
    both = """windows AS (SELECT * FROM (
  SELECT c.date AS window_start, CAST(c.date + to_months(m) AS DATE) AS window_end, s.b
  FROM (SELECT min(date) AS a, max(date) AS b FROM daily) s, (VALUES (12), (6)) v(m), calendar c
  WHERE c.date BETWEEN s.a AND CAST(s.b - to_months(m) AS DATE)) t WHERE window_end <= b)"""
    all_days = """calendar AS (SELECT CAST(t.s AS DATE) AS date
  FROM (SELECT unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS s FROM daily) t)"""
    q["backtest_window_table"] = statement([all_daily, feat, all_days, both, expanded_cte(), weights_cte(), spd_cte()], SPD_SELECT)
    q["backtest_spd_extended"] = statement(extended_spd_ctes(), SPD_SELECT)

    nominal = [all_daily, feat, win]
    q["window_weights_midway"] = statement([*nominal, *nominal_ctes(MIDWAY_DAY)],
        f"SELECT series_id, window_start, date, {r('weight', 9, 'weight')} FROM w")
    stored = f"stored AS (SELECT window_start, window_end, date, weight FROM w1 WHERE date <= DATE '{LOCK_DAY}')"
    q["locked_update"] = statement(
        [*nominal, *nominal_ctes(LOCK_DAY, "1"), stored, *nominal_ctes(NEXT_LOCK_DAY, "2", "stored")],
        f"""SELECT series_id AS id, window_start AS start_date, window_end AS end_date, date AS "DCA_date", {r('weight', 9, 'weight')}
  FROM w2 WHERE date <= DATE '{NEXT_LOCK_DAY}' AND NOT EXISTS (SELECT 1 FROM stored s
    WHERE s.window_start = w2.window_start AND s.window_end = w2.window_end AND s.date = w2.date)""")
    q["locked_rerun"] = statement(
        [*nominal, *nominal_ctes(LOCK_DAY, "1"), stored, *nominal_ctes(DAY_AFTER_LOCK, "2", "stored")],
        f"""SELECT series_id AS id, window_start AS start_date, window_end AS end_date, date AS "DCA_date", {r('weight', 9, 'weight')},
  'day after' AS run FROM w2 WHERE date = DATE '{DAY_AFTER_LOCK}'""")
    q["weights_compare"] = statement(
        [*nominal, *nominal_ctes(LOCK_DAY, "1"), *nominal_ctes(NEXT_LOCK_DAY, "2")],
        f"""SELECT a.series_id, a.window_start, a.window_end, count(*) AS days, {r('max(abs(a.weight - b.weight))', 9, 'max_diff')},
  max(abs(a.weight - b.weight)) < 1e-12 AS all_equal
  FROM w1 a JOIN w2 b ON a.window_start = b.window_start AND a.window_end = b.window_end AND a.date = b.date
  GROUP BY 1, 2, 3""")
    plain = """weights AS (SELECT *, m / sum(m) OVER (PARTITION BY series_id, window_start, window_end) AS weight FROM expanded)"""
    q["strategy_udf"] = statement(
        [daily, feat, win, expanded_cte("exp(-2 * price_vs_ma)"), plain, spd_cte()], SPD_SELECT)

    q["exp_decay"] = statement([*base, DECAY], f"SELECT series_id, {r('ed', 4, 'exp_decay_percentile')} FROM decay")
    q["spd_summary"] = statement(base, "SELECT series_id, " + ", ".join(
        r(f"{fn}({col})", 4, f"{name}_{lab}")
        for col, name in (("dyn", "spd"), ("dp", "percentile"))
        for fn, lab in (("min", "min"), ("max", "max"), ("avg", "mean"), ("median", "median"))
    ) + " FROM spd GROUP BY 1")
    q["score_metrics"] = statement([*base, DECAY, SCORES], SCORE_SELECT)
    q["score_metrics_extended"] = statement([*extended_spd_ctes(), DECAY, SCORES], SCORE_SELECT)
    q["win_loss"] = statement([*base, DECAY, SCORES], f"""SELECT series_id, 'Wins' AS outcome, wins AS windows, {r('wins * 100.0 / n', 6, 'percentage')} FROM scores
  UNION ALL SELECT series_id, 'Losses', n - wins, {r('(n - wins) * 100.0 / n', 6)} FROM scores""")
    q["under_performers"] = statement(base, f"""SELECT series_id, window_label AS "window", {r('dp', 4, 'dynamic_percentile')},
  {r('up', 4, 'uniform_percentile')}, {r('dp - up', 4, 'delta')} FROM spd WHERE dp < up""")

    masked = """masked AS (
  SELECT d.series_id || '|' || CAST(p.probe AS VARCHAR) AS pk, d.series_id, p.probe, d.date,
         CASE WHEN d.date <= p.probe THEN d.price END AS price
  FROM daily d JOIN probes p ON p.series_id = d.series_id)"""
    whole = f"""full_days AS (
  SELECT s.series_id, c.date, CASE WHEN f.date IS NULL THEN 1.0 ELSE {BASE_MULTIPLIER} END AS m
  FROM (SELECT series_id, min(date) AS a, max(date) AS b FROM daily GROUP BY 1) s
  JOIN calendar c ON c.date BETWEEN s.a AND s.b LEFT JOIN feat f ON f.series_id = s.series_id AND f.date = c.date)"""
    masked_days = f"""masked_days AS (
  SELECT s.pk, s.series_id, s.probe, c.date, CASE WHEN f.date IS NULL THEN 1.0 ELSE {BASE_MULTIPLIER} END AS m
  FROM (SELECT pk, series_id, probe, min(date) AS a, max(date) AS b FROM masked GROUP BY 1, 2, 3) s
  JOIN calendar c ON c.date BETWEEN s.a AND s.b LEFT JOIN mfeat f ON f.pk = s.pk AND f.date = c.date)"""
    leak = [daily, feat, win, probes, masked, feature_cte("masked", "mfeat", "pk"), whole, masked_days,
            weights_cte("full_days", "series_id", name="fw"), weights_cte("masked_days", "pk", name="mw")]
    far = lambda a, b: f"abs({a} - {b}) > 1e-12 + 1e-9 * abs({b})"
    q["leakage_check"] = statement(leak, f"""SELECT mw.series_id, mw.probe, {r('fw.m', 8, 'full_multiplier')},
  {r('mw.m', 8, 'masked_multiplier')}, {r('fw.weight', 8, 'full_weight')}, {r('mw.weight', 8, 'masked_weight')},
  {far('mw.m', 'fw.m')} AS multiplier_leak, {far('mw.weight', 'fw.weight')} AS weight_leak
  FROM mw JOIN fw ON fw.series_id = mw.series_id AND fw.date = mw.probe AND mw.date = mw.probe""")
    checked = [*base, probes, masked, feature_cte("masked", "mfeat", "pk"), whole, masked_days]
    label_of = "strftime(window_start, '%Y-%m-%d') || ' → ' || strftime(window_end, '%Y-%m-%d')"
    verdicts = lambda digits: f"""SELECT series_id, 'weights' AS "check", {label_of} AS key, {r('s', digits, 'detail')},
    abs(s - 1) <= 1e-8 + 1e-5 AND lo >= 0 AS passed
    FROM (SELECT series_id, window_start, window_end, sum(weight) AS s, min(weight) AS lo FROM weights GROUP BY 1, 2, 3) t
  UNION ALL SELECT series_id, 'under_performer', window_label, {r('dp - up', digits)}, true FROM spd WHERE dp < up
  UNION ALL SELECT series_id, 'win_rate', 'all windows', {r('1 - avg(CASE WHEN dp < up THEN 1.0 ELSE 0.0 END)', digits)},
    1 - avg(CASE WHEN dp < up THEN 1.0 ELSE 0.0 END) >= 0.5 FROM spd GROUP BY 1"""  # noqa: E731
    q["submission_check"] = statement(checked, f"""SELECT p.series_id, 'forward_leakage' AS "check", strftime(p.probe, '%Y-%m-%d') AS key,
    {r('abs(d.m - f.m)', 6, 'detail')}, NOT ({far('d.m', 'f.m')}) AS passed
    FROM probes p JOIN full_days f ON f.series_id = p.series_id AND f.date = p.probe
    JOIN masked_days d ON d.series_id = p.series_id AND d.probe = p.probe AND d.date = p.probe
  UNION ALL {verdicts(6)}""")
    own = "exp(-2 * price_vs_ma)"
    plain_weights = "weights AS (SELECT *, m / sum(m) OVER (PARTITION BY series_id, window_start, window_end) AS weight FROM expanded)"
    shares = [f"{n} AS (SELECT *, m / sum(m) OVER (PARTITION BY {k}) AS weight FROM {t})"
              for n, k, t in (("fw", "series_id", "full_days"), ("mw", "pk", "masked_days"))]
    q["strategy_udf_check"] = statement(
        [all_daily, feat, win, expanded_cte(own), plain_weights, spd_cte(), probes, masked, feature_cte("masked", "mfeat", "pk"),
         whole.replace(BASE_MULTIPLIER, own), masked_days.replace(BASE_MULTIPLIER, own), *shares],
        f"""SELECT mw.series_id, 'forward_leakage' AS "check", strftime(mw.probe, '%Y-%m-%d') AS key, {r('abs(mw.weight - fw.weight)', 8, 'detail')},
    NOT ({far('mw.weight', 'fw.weight')}) AS passed
    FROM mw JOIN fw ON fw.series_id = mw.series_id AND fw.date = mw.probe AND mw.date = mw.probe
  UNION ALL {verdicts(8)}""")
    q["performance_long"] = statement(base, f"""SELECT series_id, window_start AS date, 'Dynamic DCA' AS strategy, {r('dp', 4, 'spd_percentile')} FROM spd
  UNION ALL SELECT series_id, window_start, 'Uniform DCA', {r('up', 4)} FROM spd""")
    q["excess_histogram"] = statement([*base, """lim AS (SELECT series_id, min(dp - up) AS x0, max(dp - up) AS x1, avg(dp - up) AS mean FROM spd GROUP BY 1)""",
        """hit AS (SELECT s.series_id, least(CAST(floor(((dp - up) - x0) / ((x1 - x0) / 30)) AS INTEGER), 29) AS bin, count(*) AS windows
  FROM spd s JOIN lim l ON l.series_id = s.series_id GROUP BY 1, 2)"""],
        f"""SELECT l.series_id, CAST(b.bin AS INTEGER) AS bin, {r('x0 + b.bin * ((x1 - x0) / 30)', 4, 'bin_start')},
  {r('x0 + (b.bin + 1) * ((x1 - x0) / 30)', 4, 'bin_end')}, coalesce(h.windows, 0) AS windows, {r('mean', 4, 'mean_excess')}
  FROM lim l CROSS JOIN range(30) b(bin) LEFT JOIN hit h ON h.series_id = l.series_id AND h.bin = b.bin""")
    q["cumulative_excess"] = statement(base, f"""SELECT series_id, window_start AS date,
  {r('sum(dp - up) OVER (PARTITION BY series_id ORDER BY window_start ROWS UNBOUNDED PRECEDING)', 3, 'cumulative_excess')} FROM spd""")
    q["metrics_summary"] = statement([*base, DECAY, SCORES], summary_select())
    q["window_report"] = statement(base, f"""SELECT series_id, window_label AS "window", strftime(window_start, '%Y-%m-%dT00:00:00') AS start_date,
  {r('dp', 4, 'dynamic_percentile')}, {r('up', 4, 'uniform_percentile')}, {r('dp - up', 4, 'excess_percentile')},
  {r('dyn', 4, 'dynamic_sats_per_dollar')}, {r('uni', 4, 'uniform_sats_per_dollar')},
  {r('lo', 4, 'min_sats_per_dollar')}, {r('hi', 4, 'max_sats_per_dollar')} FROM spd""")

    def text(x: str) -> str:
        return f"coalesce(CAST(CAST(round({x}, 4) AS DECIMAL(20, 4)) AS VARCHAR), 'null')"

    def members(pairs: list[tuple[str, str]]) -> str:
        return " || ',' || ".join(f"""'"{name}":' || {value}""" for name, value in pairs)

    scored = [("score", text("0.5 * win_rate + 0.5 * ed")), ("win_rate", text("win_rate")), ("exp_decay_percentile", text("ed")),
              ("mean_excess", text("me")), ("median_excess", text("mde")), ("relative_improvement_pct_mean", text("mr")),
              ("relative_improvement_pct_median", text("mdr")), ("mean_ratio", text("ra")), ("median_ratio", text("mdra")),
              ("total_windows", "n"), ("wins", "wins"), ("losses", "(n - wins)")]
    entry = [("window", """'"' || window_label || '"'"""), ("start_date", """'"' || strftime(window_start, '%Y-%m-%dT00:00:00') || '"'"""),
             ("dynamic_percentile", text("dp")), ("uniform_percentile", text("up")), ("excess_percentile", text("dp - up")),
             ("dynamic_sats_per_dollar", text("dyn")), ("uniform_sats_per_dollar", text("uni")),
             ("min_sats_per_dollar", text("lo")), ("max_sats_per_dollar", text("hi"))]
    q["report_documents"] = statement([*base, DECAY, SCORES, """chunked AS (SELECT *,
  strftime(DATE '1970-01-01' + CAST(floor(datediff('day', DATE '1970-01-01', window_start) / 256.0) * 256 AS INTEGER), '%Y-%m-%d') AS chunk FROM spd)"""],
        f"""SELECT s.series_id, 'header' AS chunk, '{{"series_id":"' || s.series_id || '","chunk":"header","summary_metrics":{{' || {members(scored)}
    || '}},"windows":' || n || ',"chunks":' || (SELECT count(DISTINCT chunk) FROM chunked c WHERE c.series_id = s.series_id) || '}}' AS document FROM scores s
  UNION ALL SELECT series_id, chunk, '{{"series_id":"' || series_id || '","chunk":"' || chunk || '","window_level_data":[' ||
    string_agg('{{' || {members(entry)} || '}}', ',' ORDER BY window_start) || ']}}' FROM chunked GROUP BY 1, 2""")

    sources = {"spd": "backtest_spd", "metrics": "score_metrics", "checks": "submission_check", "performance": "performance_long", "windows": "window_report"}
    numbers = {
        "spd": ["min_sats_per_dollar", "max_sats_per_dollar", "uniform_sats_per_dollar", "dynamic_sats_per_dollar",
                "uniform_percentile", "dynamic_percentile", "excess_percentile"],
        "metrics": ["score", "win_rate", "exp_decay_percentile", "mean_excess", "median_excess", "relative_improvement_pct_mean",
                    "relative_improvement_pct_median", "mean_ratio", "median_ratio", "total_windows", "wins", "losses"],
        "spd_summary": [f"{a}_{b}" for a in ("spd", "percentile") for b in ("min", "max", "mean", "median")],
        "checks": ["detail"],
        "performance": ["spd_percentile"],
        "excess_histogram": ["bin_start", "bin_end", "windows", "mean_excess"],
        "win_loss": ["windows", "percentage"],
        "cumulative_excess": ["cumulative_excess"],
        "windows": ["dynamic_percentile", "uniform_percentile", "excess_percentile", "dynamic_sats_per_dollar",
                    "uniform_sats_per_dollar", "min_sats_per_dollar", "max_sats_per_dollar"],
    }
    q["full_analysis"] = " UNION ALL ".join(
        f"""SELECT '{name}' AS name, series_id, concat_ws('|', '', {", ".join(f'CAST("{k}" AS VARCHAR)' for k in keys) or "NULL"})[2:] AS key,
  unnest([{", ".join(f"'{c}'" for c in numbers[name])}]) AS field, unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in numbers[name])}]) AS value
  FROM ({q[sources.get(name, name)]}) t""" for name, (keys, _) in ANALYSIS_TABLES.items())

    def changed(expression: str) -> str:
        return f"changed AS (SELECT series_id, date, {expression} AS price FROM daily d)"

    has_day = f"EXISTS (SELECT 1 FROM daily e WHERE e.series_id = d.series_id AND e.date = DATE '{PROBE_DAY}')"
    hit = f"d.date >= DATE '{PROBE_DAY}' AND {has_day}"
    spiked = changed(f"CASE WHEN {hit} THEN price * 10 ELSE price END")
    rest = [win, expanded_cte(), weights_cte(), spd_cte()]
    q["scenario_spike"] = statement([daily, spiked, feature_cte("changed"), *rest], SPD_SELECT)
    q["scenario_crash"] = statement([daily, changed(f"CASE WHEN {hit} THEN price / 10 ELSE price END")],
        f"SELECT series_id, date, {r('price', 6, 'price')} FROM changed")
    q["scenario_constant"] = statement([daily, changed("CAST(50000 AS DOUBLE)"), feature_cte("changed"), *rest], SPD_SELECT)
    q["scenario_second_half"] = statement([daily], f"""SELECT series_id, date, {r('''CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY date) - 1
    >= count(*) OVER (PARTITION BY series_id) // 2 THEN price * 10 ELSE price END''', 5, 'price')} FROM daily""")
    q["scenario_mask"] = statement([daily, changed(f"CASE WHEN date <= DATE '{PROBE_DAY}' THEN price END"), feature_cte("changed")],
        f"{feature_select} FROM feat")
    q["scenario_truncate"] = statement([daily, f"changed AS (SELECT * FROM daily WHERE date <= DATE '{PROBE_DAY}')", feature_cte("changed")],
        f"{feature_select} FROM feat")
    q["scenario_shuffle"] = statement([daily], """SELECT a.series_id, a.date, b.price
  FROM (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM daily) a
  JOIN (SELECT series_id, price, row_number() OVER (PARTITION BY series_id
          ORDER BY md5(strftime(date, '%Y-%m-%d') || '|42'), date) AS i FROM daily) b
    ON a.series_id = b.series_id AND a.i = b.i""")

    def line_stats(c: str) -> str:
        at = lambda p: f"max(CASE WHEN rn = floor({p} * (n - 1) + 0.5) + 1 THEN x END)"
        return f"""SELECT '{c}' AS metric, count(x) AS "count", count(*) - count(x) AS null_count, {r('avg(x)', 4, 'mean')},
  {r('stddev_samp(x)', 4, 'std')}, {r('min(x)', 4, 'min')}, {r(at(0.25), 4, 'p25')}, {r(at(0.5), 4, 'p50')},
  {r(at(0.75), 4, 'p75')}, {r('max(x)', 4, 'max')}
  FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) AS rn, count({c}) OVER () AS n FROM lineitem) t"""

    q["describe"] = " UNION ALL ".join(line_stats(c) for c in LINE_METRICS)
    q["corr_matrix"] = " UNION ALL ".join(
        f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, {r(f'corr({a}, {b})', 7, 'correlation')} FROM lineitem"
        for a in LINE_METRICS for b in LINE_METRICS)
    q["market_totals"] = f"""SELECT 'total_markets' AS name, CAST(count(*) AS DOUBLE) AS value FROM orders
  UNION ALL SELECT 'active_markets', CAST(count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS DOUBLE) FROM orders
  UNION ALL SELECT 'closed_markets', CAST(count(CASE WHEN o_orderstatus <> 'O' THEN 1 END) AS DOUBLE) FROM orders
  UNION ALL SELECT 'total_volume', {r('sum(o_totalprice)', 2)} FROM orders
  UNION ALL SELECT 'mean_volume', {r('avg(o_totalprice)', 2)} FROM orders
  UNION ALL SELECT 'odds_records', CAST(count(*) AS DOUBLE) FROM events
  UNION ALL SELECT 'total_trades', CAST(count(*) AS DOUBLE) FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
    stats = " UNION ALL ".join(
        f"""SELECT 'describe' AS part, metric AS name, unnest(['count', 'null_count', 'mean', 'std', 'min', 'max', 'p25', 'p50', 'p75']) AS field,
  unnest([CAST("count" AS DOUBLE), null_count, mean, std, min, max, p25, p50, p75]) AS value FROM ({line_stats(c)}) t""" for c in LINE_METRICS)
    pairs = " UNION ALL ".join(
        f"SELECT 'correlation', '{a}', '{b}', {r(f'corr({a}, {b})', 4)} FROM lineitem" for a in LINE_METRICS for b in LINE_METRICS)
    q["eda_report"] = f"""{stats} UNION ALL {pairs}
  UNION ALL SELECT 'totals', 'all', unnest(['total_markets', 'active_markets', 'closed_markets', 'total_volume', 'mean_volume']),
    unnest([CAST(count(*) AS DOUBLE), count(CASE WHEN p_size > 25 THEN 1 END), count(CASE WHEN p_size <= 25 THEN 1 END),
    {r('sum(p_retailprice)', 4)}, {r('avg(p_retailprice)', 4)}]) FROM part
  UNION ALL SELECT 'totals', 'all', 'odds_records', CAST(count(*) AS DOUBLE) FROM events
  UNION ALL SELECT 'totals', 'all', 'total_trades', CAST(sum(o_custkey % 10) AS DOUBLE) FROM orders
  UNION ALL SELECT 'top_categories', category, 'volume', {r('volume', 4)} FROM (
    SELECT CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS category, sum(p_retailprice) AS volume FROM part GROUP BY 1
    ORDER BY volume DESC, category NULLS LAST LIMIT 10) t"""
    q["top_categories"] = f"""SELECT category, {r('volume', 2, 'volume')} FROM (
  SELECT CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS category, sum(p_retailprice) AS volume FROM part GROUP BY 1
  ORDER BY volume DESC, category NULLS LAST LIMIT 10) t"""
    ends = "ends AS (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1)"
    q["event_rollup"] = statement([ends], f"""SELECT 'customer-' || o_custkey AS event_slug, count(o_orderkey) AS market_count,
  {r('sum(o_totalprice)', 2, 'total_volume')}, min(o_orderdate) AS first_market_start, max(e) AS last_market_end
  FROM orders LEFT JOIN ends ON l_orderkey = o_orderkey GROUP BY 1""")
    q["market_rollup"] = """SELECT o_orderkey AS market_id, o_orderpriority AS question, 'order-' || o_orderkey AS slug,
  o_totalprice AS volume, o_orderstatus = 'O' AS active, count(DISTINCT l_linenumber) AS token_count,
  count(l_orderkey) AS trade_count, min(l_shipdate) AS first_trade, max(l_shipdate) AS last_trade
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5"""
    q["market_links"] = f"""SELECT o_orderpriority AS question, t.outcome, l_linestatus AS side, count(*) AS trades,
  {r('sum(l_quantity)', 2, 'size')}, {r('sum(l_extendedprice)', 2, 'value')}
  FROM lineitem l LEFT JOIN (SELECT l_orderkey AS k, l_linenumber AS n, min(l_returnflag) AS outcome FROM lineitem GROUP BY 1, 2) t
    ON t.k = l.l_orderkey AND t.n = l.l_linenumber
  LEFT JOIN orders ON o_orderkey = l.l_orderkey GROUP BY 1, 2, 3"""
    odds = """odds AS (SELECT event_id + 6000 AS market_id, user_id % 9 AS token_id, ts, CASE WHEN event_type <> 'error' THEN value END AS price FROM events),
tokens AS (SELECT l_orderkey AS market_id, l_linenumber AS token_id, min(l_returnflag) AS outcome FROM lineitem GROUP BY 1, 2),
markets AS (SELECT o_orderkey AS market_id, o_orderpriority AS question,
  CASE WHEN o_orderpriority <> '5-LOW' THEN 'customer-' || o_custkey END AS event_slug, o_totalprice AS volume FROM orders),
event_stats AS (SELECT 'customer-' || c_custkey AS event_slug, CAST(c_nationkey AS BIGINT) AS market_count, c_acctbal AS total_volume
  FROM customer, range(2) t(k) WHERE c_mktsegment <> 'MACHINERY' AND (k = 0 OR c_mktsegment = 'HOUSEHOLD'))"""
    q["odds_links"] = statement([odds], """SELECT o.market_id, o.token_id, count(*) AS records, min(ts) AS first_time, max(ts) AS last_time,
  min(price) AS low, max(price) AS high, arg_max(price, ts) AS last_odds, any_value(outcome) AS outcome, any_value(question) AS question,
  any_value(event_slug) AS event_slug
  FROM odds o LEFT JOIN tokens t ON t.market_id = o.market_id AND t.token_id = o.token_id LEFT JOIN markets m ON m.market_id = o.market_id
  GROUP BY 1, 2""")
    q["event_links"] = statement([odds], f"""SELECT coalesce(s.event_slug, m.event_slug) AS event_slug, s.market_count AS stated_markets,
  {r('s.total_volume', 2, 'stated_volume')}, s.event_slug IS NOT NULL AS known, coalesce(m.n, 0) AS markets, {r('coalesce(m.v, 0)', 2, 'volume')},
  coalesce(s.market_count = m.n AND abs(s.total_volume - m.v) < 0.005, false) AS agrees
  FROM event_stats s FULL JOIN (SELECT event_slug, count(*) AS n, sum(volume) AS v FROM markets WHERE event_slug IS NOT NULL GROUP BY 1) m
    ON m.event_slug = s.event_slug""")

    def audited(name: str, child: str, parent: str, key: str) -> str:
        same = " AND ".join(f"p.{k} = c.{k}" for k in key.split(", "))
        null = " OR ".join(f"{k} IS NULL" for k in key.split(", "))
        has = f"EXISTS (SELECT 1 FROM {parent} p WHERE {same})"
        keys = f"(SELECT {key}, count(*) AS n FROM {parent} WHERE NOT ({null}) GROUP BY ALL)"
        return f"""SELECT '{name}' AS link, (SELECT count(*) FROM {child}) AS child_rows, (SELECT count(*) FROM {child} WHERE {null}) AS keyless_rows,
  (SELECT count(*) FROM {child} c WHERE NOT ({null}) AND NOT {has}) AS orphan_rows,
  (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {child} c WHERE NOT ({null}) AND NOT {has}) t) AS orphan_keys,
  (SELECT count(*) FROM {keys} t) AS parent_keys, (SELECT count(*) FROM {keys} t WHERE n > 1) AS duplicate_keys,
  (SELECT count(*) FROM {keys} c WHERE NOT EXISTS (SELECT 1 FROM {child} p WHERE {same})) AS childless_keys"""

    more = """trades AS (SELECT l_orderkey AS market_id, l_linenumber AS token_id FROM lineitem),
summary AS (SELECT o_orderkey * 2 AS market_id FROM orders)"""
    q["link_audit"] = statement([odds, more], " UNION ALL ".join([
        audited("tokens->markets", "tokens", "markets", "market_id"),
        audited("trades->tokens", "trades", "tokens", "market_id, token_id"),
        audited("odds_history->tokens", "odds", "tokens", "market_id, token_id"),
        audited("summary->markets", "summary", "markets", "market_id"),
        audited("markets->event_stats", "markets", "event_stats", "event_slug")]))
    q["completeness"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
  (count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS null_share FROM lineitem"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    q["profile_orders"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{kind}' AS data_type, count(*) AS row_count, count(*) - count({c}) AS null_count,
  CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value,
  (count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS null_share, count(DISTINCT {c}) AS distinct_count FROM orders"""
        for c, kind in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
                        ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")))
    return q
