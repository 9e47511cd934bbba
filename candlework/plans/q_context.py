"""Queries for resampling, as-of joins and context feature families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.scalar import cash_session
from ..operators import context_features as cf
from ..operators import external_features as ef
from ..operators import micro_features as mf
from ..operators.asof import asof_audit, asof_join
from .inputs import OBSERVATIONS_SQL, bars, bars_sql, observations, table
from .q_features import ATR_OR_NULL_SQL, ATR_SQL, KEY, W, null_at_zero, roll
from .q_labels import atr_bars
from .registry import query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def completed_sql(source: str, seconds: int, expected: int, name: str = "done") -> str:
    slot = f"floor(epoch(ts) / {seconds})"
    return f"""{name} AS (
      SELECT symbol, make_timestamp(CAST(({slot} + 1) * {seconds} * 1000000 AS BIGINT)) AS ts, arg_min(open, ts) AS open,
             max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
      FROM {source} GROUP BY symbol, {slot} HAVING count(*) = {expected})"""


@query(
    "resample_completed_hour",
    KEY + "open:d high:d low:d close:d volume:d",
    f"WITH {bars_sql()}, {completed_sql('bars', 3600, 4)} SELECT * FROM done",
)
def resample_completed_hour(spark, sf_dir):
    return cf.completed_bars(bars(spark, sf_dir), width="1 hour", expected=4)


@query(
    "resample_completed_four_hours",
    KEY + "open:d high:d low:d close:d volume:d",
    f"WITH {bars_sql(per_type=False)}, {completed_sql('bars', 14400, 16)} SELECT * FROM done",
)
def resample_completed_four_hours(spark, sf_dir):
    return cf.completed_bars(bars(spark, sf_dir, per_type=False), width="4 hours", expected=16)


@query(
    "features_directional",
    KEY
    + " ".join(f"return_lag_{k}:d" for k in (1, 2, 3, 5))
    + " return_20:d return_40:d return_80:d "
    + " ".join(f"atr_trend_{h}:d4" for h in (5, 10, 20, 40))
    + " directional_persistence_5:d directional_persistence_10:d directional_persistence_20:d range_position_20:d range_position_50:d candle_close_location:d signed_body_range:d",
    f"""WITH RECURSIVE {ATR_OR_NULL_SQL}, r AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r FROM atr_t {W}),
    x AS (SELECT *, lag(r, 1) OVER w AS return_lag_1, lag(r, 2) OVER w AS return_lag_2, lag(r, 3) OVER w AS return_lag_3,
      lag(r, 5) OVER w AS return_lag_5, close / nullif(lag(close, 20) OVER w, 0) - 1 AS return_20,
      close / nullif(lag(close, 40) OVER w, 0) - 1 AS return_40, close / nullif(lag(close, 80) OVER w, 0) - 1 AS return_80, """
    + ", ".join(f"coalesce((close - lag(close, {h}) OVER w) / nullif(atr, 0), 0) AS atr_trend_{h}" for h in (5, 10, 20, 40))
    + ", "
    + ", ".join(f"{roll('avg', 'sign(r)', n)} AS directional_persistence_{n}" for n in (5, 10, 20))
    + ", "
    + ", ".join(f"{roll('min', 'low', n)} AS lo{n}, {roll('max', 'high', n)} AS hi{n}" for n in (20, 50))
    + f""" FROM r {W})
    SELECT *, """
    + ", ".join(f"coalesce(2 * (close - lo{n}) / nullif(hi{n} - lo{n}, 0) - 1, 0) AS range_position_{n}" for n in (20, 50))
    + """, CASE WHEN high = low THEN 0 ELSE 2 * (close - low) / (high - low) - 1 END AS candle_close_location,
    CASE WHEN high = low THEN 0 ELSE (close - open) / (high - low) END AS signed_body_range FROM x""",
)
def features_directional(spark, sf_dir):
    return cf.directional_features(atr_bars(spark, sf_dir).drop("bar_index"))


# ---------------------------------------------------------------- higher time frame

HTF_COLUMNS = ["return_1", "return_2", "return_4", "return_8", "return_12", "trend_direction", "ma_slope", "distance_ma", "volatility_regime", "range_position", "breakout_state", "persistence"]


def htf_sql(source: str, prefix: str) -> str:
    """CTEs ending in ``htf`` with the twelve features."""
    f20, f14, f40, f8 = (f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)" for n in (20, 14, 40, 8))
    return f"""h0 AS (SELECT *, close / lag(close) OVER w - 1 AS r,
        coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr,
        {roll('avg', 'close', 20)} AS ma FROM {source} {W}),
      h1 AS (SELECT *, {roll('avg', 'tr', 14)} AS a FROM h0),
      h2 AS (SELECT *, {roll('max', 'high', 20)} AS hi, {roll('min', 'low', 20)} AS lo,
        CASE WHEN count(a) OVER {f40} = 40 THEN quantile_cont(a, 0.5) OVER {f40} END AS amed FROM h1),
      htf AS (SELECT symbol, ts, r AS {prefix}_return_1, close / lag(close, 2) OVER w - 1 AS {prefix}_return_2,
        close / lag(close, 4) OVER w - 1 AS {prefix}_return_4, close / lag(close, 8) OVER w - 1 AS {prefix}_return_8,
        close / lag(close, 12) OVER w - 1 AS {prefix}_return_12, sign(close - ma) AS {prefix}_trend_direction,
        (ma - lag(ma, 4) OVER w) / nullif(a, 0) AS {prefix}_ma_slope, (close - ma) / nullif(a, 0) AS {prefix}_distance_ma,
        a / nullif(amed, 0) AS {prefix}_volatility_regime, 2 * (close - lo) / nullif(hi - lo, 0) - 1 AS {prefix}_range_position,
        CASE WHEN count(close) OVER p < 20 THEN 0 WHEN close > max(high) OVER p THEN 1 WHEN close < min(low) OVER p THEN -1 ELSE 0 END AS {prefix}_breakout_state,
        {roll('avg', 'sign(r)', 8)} AS {prefix}_persistence
        FROM h2 {W}, p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


@query(
    "features_higher_timeframe",
    KEY + " ".join(f"h1_{c}:d" for c in HTF_COLUMNS),
    f"WITH {bars_sql(per_type=False)}, {completed_sql('bars', 3600, 4)}, {htf_sql('done', 'h1')} SELECT * FROM htf",
)
def features_higher_timeframe(spark, sf_dir):
    return cf.timeframe_features(cf.completed_bars(bars(spark, sf_dir, per_type=False), width="1 hour", expected=4), "h1")


PREDICTIONS_SQL = "predictions AS (SELECT symbol, ts, ts + INTERVAL 15 MINUTE AS prediction_ts FROM bars)"


def predictions(spark, sf_dir, per_type=False):
    rows = bars(spark, sf_dir, per_type=per_type)
    return rows.select("symbol", "ts", (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("prediction_ts"))


def htf_context(spark, sf_dir):
    features = cf.timeframe_features(cf.completed_bars(bars(spark, sf_dir, per_type=False), width="1 hour", expected=4), "h1")
    return asof_join(
        predictions(spark, sf_dir), features, by=["symbol"], left_time="prediction_ts", right_time="ts", max_age_seconds=2 * 3600, strict=True
    )


HTF_ASOF_SQL = f"""{bars_sql(per_type=False)}, {completed_sql('bars', 3600, 4)}, {htf_sql('done', 'h1')}, {PREDICTIONS_SQL},
matched AS (
  SELECT symbol, ts, prediction_ts, h.ts AS source_ts, CAST(date_diff('second', h.ts, prediction_ts) AS DOUBLE) AS age_seconds,
    h.h1_return_1 AS h1_return_1, h.h1_range_position AS h1_range_position, h.h1_persistence AS h1_persistence
  FROM (SELECT p.symbol, p.ts, p.prediction_ts, CASE WHEN p.prediction_ts - h.ts <= INTERVAL 2 HOUR THEN h END AS h
        FROM predictions p ASOF LEFT JOIN htf h ON p.symbol = h.symbol AND p.prediction_ts >= h.ts))"""


@query(
    "asof_higher_timeframe",
    KEY + "prediction_ts:t source_ts:t age_seconds:d h1_return_1:d h1_range_position:d h1_persistence:d",
    f"WITH {HTF_ASOF_SQL} SELECT * FROM matched",
)
def asof_higher_timeframe(spark, sf_dir):
    return htf_context(spark, sf_dir)


@query(
    "asof_audit_check",
    "family:s rows:l matched_rows:l max_age_seconds:d max_source_ts:t future_observations:l",
    f"""WITH {HTF_ASOF_SQL} SELECT 'h1' AS family, count(*) AS rows, count(source_ts) AS matched_rows,
    max(age_seconds) AS max_age_seconds, max(source_ts) AS max_source_ts,
    count(*) FILTER (WHERE source_ts > prediction_ts) AS future_observations FROM matched""",
)
def asof_audit_check(spark, sf_dir):
    return asof_audit(htf_context(spark, sf_dir), left_time="prediction_ts", family="h1")


# ---------------------------------------------------------------- observations

SHIP_SQL = """ships AS (
  SELECT DISTINCT o_orderpriority AS instrument_or_event_id, l_shipdate + INTERVAL 15 MINUTE AS prediction_ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def ship_times(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("instrument_or_event_id"))
    at = (F.col("l_shipdate") + F.expr("INTERVAL 15 MINUTES")).alias("prediction_ts")
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("instrument_or_event_id", at).distinct()


def observed(spark, sf_dir, days=7):
    source = observations(spark, sf_dir).select("instrument_or_event_id", "value", "source_time_utc", "available_time_utc", "revision_id")
    return asof_join(
        ship_times(spark, sf_dir), source, by=["instrument_or_event_id"], left_time="prediction_ts",
        right_time="available_time_utc", max_age_seconds=days * 86400, order=["revision_id"], strict=True,
    )


OBS_ASOF_SQL = f"""{OBSERVATIONS_SQL}, {SHIP_SQL}, newest AS (
  SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY instrument_or_event_id, available_time_utc ORDER BY revision_id DESC) = 1),
aged AS (
  SELECT s.instrument_or_event_id, s.prediction_ts, n.value, n.source_time_utc, n.available_time_utc, n.revision_id,
    date_diff('second', n.available_time_utc, s.prediction_ts) AS age
  FROM ships s ASOF LEFT JOIN newest n ON s.instrument_or_event_id = n.instrument_or_event_id AND s.prediction_ts >= n.available_time_utc),
observed AS (
  SELECT instrument_or_event_id, prediction_ts, CASE WHEN age <= 604800 THEN value END AS value,
    CASE WHEN age <= 604800 THEN source_time_utc END AS source_time_utc, CASE WHEN age <= 604800 THEN available_time_utc END AS source_ts,
    CASE WHEN age <= 604800 THEN revision_id END AS revision_id, CASE WHEN age <= 604800 THEN CAST(age AS DOUBLE) END AS age_seconds FROM aged)"""


@query(
    "asof_observations",
    "instrument_or_event_id:s prediction_ts:t value:d4 source_time_utc:t revision_id:s source_ts:t age_seconds:d",
    f"WITH {OBS_ASOF_SQL} SELECT * FROM observed",
)
def asof_observations(spark, sf_dir):
    return observed(spark, sf_dir)


@query(
    "asof_wide_summary",
    "instrument_or_event_id:s rows:l matched_rows:l max_age_seconds:d max_source_ts:t future_observations:l",
    f"""WITH {OBS_ASOF_SQL} SELECT instrument_or_event_id, count(*) AS rows, count(source_ts) AS matched_rows, max(age_seconds) AS max_age_seconds,
    max(source_ts) AS max_source_ts, count(*) FILTER (WHERE source_ts > prediction_ts) AS future_observations FROM observed GROUP BY 1""",
)
def asof_wide_summary(spark, sf_dir):
    return asof_audit(observed(spark, sf_dir), left_time="prediction_ts", keys=["instrument_or_event_id"])


LEVELS = {"r2": "1-URGENT", "r5": "2-HIGH", "r10": "3-MEDIUM", "r20": "4-NOT SPECIFIED", "r30": "5-LOW"}
PUBLISHED_SQL = (
    OBSERVATIONS_SQL
    + """, published AS (SELECT * FROM observations
    QUALIFY row_number() OVER (PARTITION BY instrument_or_event_id, available_time_utc ORDER BY revision_id DESC, source_time_utc DESC) = 1)"""
)
WIDE_SQL = (
    PUBLISHED_SQL
    + ", wide AS (SELECT 0 AS symbol, available_time_utc AS ts, "
    + ", ".join(f"max(value) FILTER (WHERE instrument_or_event_id = '{v}') AS {k}" for k, v in LEVELS.items())
    + " FROM published GROUP BY 2)"
)


def wide_levels(spark, sf_dir):
    wide = ef.widen(observations(spark, sf_dir), column="instrument_or_event_id", values=list(LEVELS.values()))
    return wide.withColumnsRenamed({v: k for k, v in LEVELS.items()})


@query("pivot_observations", "ts:t " + " ".join(f"{k}:d4" for k in LEVELS), f"WITH {WIDE_SQL} SELECT * FROM wide")
def pivot_observations(spark, sf_dir):
    return wide_levels(spark, sf_dir).withColumnRenamed("available_time_utc", "ts")


@query(
    "features_rates",
    "ts:t "
    + " ".join(f"{k}_level:d4 {k}_daily_change:d4" for k in LEVELS)
    + " s2s10:d4 s5s30:d4 r10_change_volatility_20d:d4",
    f"""WITH {WIDE_SQL}, d AS (SELECT *, """
    + ", ".join(f"{k} AS {k}_level, {k} - lag({k}) OVER w AS {k}_daily_change" for k in LEVELS)
    + f""" FROM wide {W}) SELECT *, r2 - r10 AS s2s10, r5 - r30 AS s5s30,
    {roll('stddev_samp', 'r10_daily_change', 20)} AS r10_change_volatility_20d FROM d""",
)
def features_rates(spark, sf_dir):
    made = ef.rates_features(
        wide_levels(spark, sf_dir), levels=list(LEVELS), spreads={"s2s10": ("r2", "r10"), "s5s30": ("r5", "r30")}, volatility_of="r10"
    )
    return made.withColumnRenamed("available_time_utc", "ts")


def _frame(n):
    return f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"


@query(
    "features_volatility_index",
    "ts:t r2_level:d4 r2_daily_change:d4 r2_percentile_252d:d r2_high_regime:d r5_minus_r2:d4 r10_minus_r2:d4 r20_minus_r2:d4 r30_level:d4",
    f"""WITH {WIDE_SQL}, x AS (SELECT *, row_number() OVER w AS i, r2 - lag(r2) OVER w AS r2_daily_change,
      CASE WHEN count(r2) OVER {_frame(60)} >= 20 THEN quantile_cont(r2, 0.5) OVER {_frame(60)} END AS med FROM wide {W}),
    k AS (SELECT a.i, count(b.r2) AS n, count(*) FILTER (WHERE b.r2 < a.r2) AS lt, count(*) FILTER (WHERE b.r2 = a.r2) AS eq
          FROM x a JOIN x b ON b.i BETWEEN a.i - 251 AND a.i GROUP BY 1)
    SELECT ts, r2 AS r2_level, r2_daily_change, CASE WHEN r2 IS NOT NULL AND n >= 60 THEN (lt + (eq + 1) / 2.0) / n END AS r2_percentile_252d,
      CASE WHEN r2 > med THEN 1 ELSE 0 END AS r2_high_regime, r5 - r2 AS r5_minus_r2, r10 - r2 AS r10_minus_r2, r20 - r2 AS r20_minus_r2, r30 AS r30_level
    FROM x JOIN k USING (i)""",
)
def features_volatility_index(spark, sf_dir):
    made = ef.volatility_features(wide_levels(spark, sf_dir), index="r2", terms=["r5", "r10", "r20"], extra=["r30"])
    return made.withColumnRenamed("available_time_utc", "ts")


MOVES_SQL = f"""{PUBLISHED_SQL}, series AS (
  SELECT instrument_or_event_id AS symbol, available_time_utc AS ts, value FROM published),
m0 AS (SELECT *, value / lag(value) OVER w - 1 AS return_1, value / lag(value, 4) OVER w - 1 AS return_4 FROM series {W}),
moves AS (SELECT *, {roll('stddev_samp', 'return_1', 16)} AS volatility_16 FROM m0)"""


def instrument_moves(spark, sf_dir):
    return ef.instrument_moves(observations(spark, sf_dir))


@query(
    "features_market_moves",
    "symbol:s ts:t return_1:d return_4:d volatility_16:d",
    f"WITH {MOVES_SQL} SELECT * FROM moves",
)
def features_market_moves(spark, sf_dir):
    return instrument_moves(spark, sf_dir).withColumnsRenamed({"instrument_or_event_id": "symbol", "available_time_utc": "ts"})


MARKETS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


def _market_side(name, short):
    return f"""{short} AS (SELECT p.prediction_ts, CASE WHEN p.prediction_ts - m.ts <= INTERVAL 30 HOUR THEN m END AS m
      FROM times p ASOF LEFT JOIN (SELECT * FROM moves WHERE symbol = '{name}') m ON p.prediction_ts >= m.ts)"""


@query(
    "features_market_context",
    "prediction_ts:t "
    + " ".join(f"market_{s}_return_1:d market_{s}_return_4:d market_{s}_volatility_16:d market_{s}_source_ts:t" for s in MARKETS.values()),
    f"WITH {MOVES_SQL}, times AS (SELECT DISTINCT l_shipdate + INTERVAL 15 MINUTE AS prediction_ts FROM lineitem), "
    + ", ".join(_market_side(n, s) for n, s in MARKETS.items())
    + " SELECT urgent.prediction_ts, "
    + ", ".join(
        f"{s}.m.return_1 AS market_{s}_return_1, {s}.m.return_4 AS market_{s}_return_4, {s}.m.volatility_16 AS market_{s}_volatility_16, {s}.m.ts AS market_{s}_source_ts"
        for s in MARKETS.values()
    )
    + " FROM urgent " + " ".join(f"JOIN {s} USING (prediction_ts)" for s in [*MARKETS.values()][1:]),
)
def features_market_context(spark, sf_dir):
    times = table(spark, sf_dir, "lineitem").select((F.col("l_shipdate") + F.expr("INTERVAL 15 MINUTES")).alias("prediction_ts")).distinct()
    return ef.market_context(times, instrument_moves(spark, sf_dir), MARKETS, left_time="prediction_ts", max_age_seconds=30 * 3600)


# ---------------------------------------------------------------- calendar


def calendar_of(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("d"))
    events = table(spark, sf_dir, "events").select(F.col("ts").alias("d"))
    bounds = orders.union(events).agg(F.to_date(F.min("d")).alias("first_day"), F.to_date(F.max("d")).alias("last_day"))
    return cal.trading_calendar(bounds)


def _obs_sql(day):
    return f"CAST(CASE isodow({day}) WHEN 6 THEN {day} - 1 WHEN 7 THEN {day} + 1 ELSE {day} END AS DATE)"


def _pick(month, isodow, nth):
    """nth (or last, when 0) weekday of a month by numbering the days themselves."""
    order = "DESC" if nth == 0 else "ASC"
    return f"""SELECT d FROM (SELECT d, row_number() OVER (PARTITION BY year(d) ORDER BY d {order}) AS k FROM alldays
      WHERE month(d) = {month} AND isodow(d) = {isodow}) WHERE k = {max(nth, 1)}"""


CALENDAR_SQL = f"""edges AS (SELECT min(d) AS a, max(d) AS b FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT CAST(ts AS DATE) FROM events)),
alldays AS (SELECT CAST(unnest(generate_series(date_trunc('year', a), date_trunc('year', b) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM edges),
years AS (SELECT DISTINCT CAST(year(d) AS BIGINT) AS y FROM alldays),
gauss AS (SELECT y, (19 * (y % 19) + 24) % 30 AS dd, y % 19 AS aa, y % 4 AS bb, y % 7 AS cc FROM years),
gauss2 AS (SELECT y, dd, aa, (2 * bb + 4 * cc + 6 * dd + 5) % 7 AS ee FROM gauss),
easter AS (SELECT y, CASE WHEN dd = 29 AND ee = 6 THEN make_date(y, 4, 19) WHEN dd = 28 AND ee = 6 AND aa > 10 THEN make_date(y, 4, 18)
    ELSE make_date(y, 3, 22) + CAST(dd + ee AS INTEGER) END AS d FROM gauss2),
closed AS (
  SELECT {_obs_sql('make_date(y, 1, 1)')} AS d FROM years UNION SELECT {_obs_sql('make_date(y, 6, 19)')} FROM years
  UNION SELECT {_obs_sql('make_date(y, 7, 4)')} FROM years UNION SELECT {_obs_sql('make_date(y, 12, 25)')} FROM years
  UNION SELECT d - 2 FROM easter UNION SELECT DATE '2025-01-09' FROM years WHERE y = 2025
  UNION {_pick(1, 1, 3)} UNION {_pick(2, 1, 3)} UNION {_pick(5, 1, 0)} UNION {_pick(9, 1, 1)} UNION {_pick(11, 4, 4)}),
base AS (SELECT d, CASE WHEN d IN (SELECT d FROM closed) THEN 1 ELSE 0 END AS holiday FROM alldays, edges WHERE d BETWEEN a AND b),
traded AS (SELECT *, CASE WHEN isodow(d) < 6 AND holiday = 0 THEN 1 ELSE 0 END AS is_trading_day FROM base),
calendar AS (
  SELECT d AS day, is_trading_day, holiday,
    CASE WHEN d IN ({', '.join(f"DATE '{x}'" for x in cal.EARLY_CLOSES)}) THEN 1 ELSE 0 END AS early_close,
    CASE WHEN is_trading_day = 1 AND (d + 1 IN (SELECT d FROM closed) OR d + 2 IN (SELECT d FROM closed) OR d + 3 IN (SELECT d FROM closed)) THEN 1 ELSE 0 END AS day_before_holiday,
    CASE WHEN d IN (SELECT min(d) FROM traded WHERE is_trading_day = 1 GROUP BY year(d), month(d)) THEN 1 ELSE 0 END AS first_trading_day,
    CASE WHEN d IN (SELECT max(d) FROM traded WHERE is_trading_day = 1 GROUP BY year(d), month(d)) THEN 1 ELSE 0 END AS last_trading_day,
    CASE WHEN d IN (SELECT max(d) FROM traded WHERE is_trading_day = 1 GROUP BY year(d), month(d)) THEN 1 ELSE 0 END AS month_end,
    CASE WHEN d IN (SELECT max(d) FROM traded WHERE is_trading_day = 1 GROUP BY year(d), quarter(d)) THEN 1 ELSE 0 END AS quarter_end,
    CASE WHEN d IN (SELECT max(d) FROM traded WHERE is_trading_day = 1 GROUP BY year(d)) THEN 1 ELSE 0 END AS year_end
  FROM traded)"""
FLAGS = ["is_trading_day", *ef.CALENDAR_FLAGS]


@query("calendar_days", "day:t " + " ".join(f"{f}:l" for f in FLAGS), f"WITH {CALENDAR_SQL} SELECT * FROM calendar")
def calendar_days(spark, sf_dir):
    return calendar_of(spark, sf_dir)


@query(
    "features_calendar_context",
    "symbol:s ts:t calendar_holiday:l calendar_day_before_holiday:l calendar_first_trading_day:l calendar_month_end:l",
    f"""WITH {CALENDAR_SQL}, {bars_sql()}, {PREDICTIONS_SQL} SELECT p.symbol, p.ts, c.holiday AS calendar_holiday,
    c.day_before_holiday AS calendar_day_before_holiday, c.first_trading_day AS calendar_first_trading_day, c.month_end AS calendar_month_end
    FROM predictions p LEFT JOIN calendar c ON c.day = (SELECT max(d) FROM (SELECT CAST(p.prediction_ts AS DATE) AS d) x WHERE d <= (SELECT max(day) FROM calendar))""".replace(
        "(SELECT max(d) FROM (SELECT CAST(p.prediction_ts AS DATE) AS d) x WHERE d <= (SELECT max(day) FROM calendar))",
        "least(CAST(p.prediction_ts AS DATE), (SELECT max(day) FROM calendar))",
    ),
)
def features_calendar_context(spark, sf_dir):
    return ef.calendar_context(predictions(spark, sf_dir, per_type=True), calendar_of(spark, sf_dir), left_time="prediction_ts")


@query(
    "features_cash_session",
    KEY + "cash_session_exact:d minutes_to_cash_close:l",
    f"""WITH {bars_sql()}, {PREDICTIONS_SQL}, m AS (SELECT symbol, ts, prediction_ts,
      (hour(prediction_ts - INTERVAL 5 HOUR) * 60 + minute(prediction_ts - INTERVAL 5 HOUR)) AS mm FROM predictions)
    SELECT symbol, ts, CASE WHEN mm >= 570 AND mm < 960 THEN 1 ELSE 0 END AS cash_session_exact, 960 - mm AS minutes_to_cash_close FROM m""",
)
def features_cash_session(spark, sf_dir):
    """All events fall in January, so New York is five hours behind throughout."""
    return predictions(spark, sf_dir, per_type=True).withColumns(cash_session("prediction_ts", F.lit(0)))


# ---------------------------------------------------------------- cross market

CROSS = ["return_1", "return_2", "return_4", "return_8", "return_12", "return_24", "momentum_acceleration", "persistence", "realized_volatility", "range_regime"]


def market_sql(source: str) -> str:
    f12, f24, f96 = _frame(12), _frame(24), _frame(96)
    return f"""k0 AS (SELECT *, close / lag(close) OVER w - 1 AS r, (high - low) / close AS rng, close / lag(close, 4) OVER w - 1 AS r4 FROM {source} {W}),
    market AS (SELECT symbol, ts + INTERVAL 15 MINUTE AS ts, r AS return_1, close / lag(close, 2) OVER w - 1 AS return_2, r4 AS return_4,
      close / lag(close, 8) OVER w - 1 AS return_8, close / lag(close, 12) OVER w - 1 AS return_12, close / lag(close, 24) OVER w - 1 AS return_24,
      r4 - lag(r4, 4) OVER w AS momentum_acceleration, {roll('avg', 'sign(r)', 12)} AS persistence, {roll('stddev_samp', 'r', 24)} AS realized_volatility,
      {roll('avg', 'rng', 12)} / nullif(CASE WHEN count(rng) OVER {f96} = 96 THEN quantile_cont(rng, 0.5) OVER {f96} END, 0) AS range_regime FROM k0 {W})"""


MARKET_SQL = null_at_zero(market_sql("bars"), "close", "lag(close) OVER w", *[f"lag(close, {n}) OVER w" for n in (2, 4, 8, 12, 24)])


@query(
    "features_cross_market_series",
    KEY + " ".join(f"{c}:d" for c in CROSS),
    f"WITH {bars_sql()}, {MARKET_SQL} SELECT * FROM market",
)
def features_cross_market_series(spark, sf_dir):
    return cf.market_features(bars(spark, sf_dir))


def _cross_side(name):
    return f"""{name} AS (SELECT h.ts AS t, CASE WHEN h.ts - m.ts <= INTERVAL 4 HOUR THEN m END AS m
      FROM home h ASOF LEFT JOIN (SELECT * FROM market WHERE symbol = '{name}') m ON h.ts >= m.ts)"""


@query(
    "features_cross_market",
    "prediction_ts:t click_return_4:d view_return_4:d home_minus_click_return_4:d home_minus_click_return_12:d home_click_alignment:d click_view_alignment:d click_minus_view_return_4:d",
    f"""WITH {bars_sql()}, {MARKET_SQL}, home AS (SELECT * FROM market WHERE symbol = 'purchase'), {_cross_side('click')}, {_cross_side('view')}
    SELECT h.ts AS prediction_ts, click.m.return_4 AS click_return_4, view.m.return_4 AS view_return_4,
      h.return_4 - click.m.return_4 AS home_minus_click_return_4, h.return_12 - click.m.return_12 AS home_minus_click_return_12,
      sign(h.return_4) * sign(click.m.return_4) AS home_click_alignment, sign(click.m.return_4) * sign(view.m.return_4) AS click_view_alignment,
      click.m.return_4 - view.m.return_4 AS click_minus_view_return_4
    FROM home h JOIN click ON click.t = h.ts JOIN view ON view.t = h.ts""",
)
def features_cross_market(spark, sf_dir):
    market = cf.market_features(bars(spark, sf_dir))
    home = market.where(F.col("symbol") == "purchase").select(F.col("ts").alias("prediction_ts"), "return_4", "return_12")
    others = {n: market.where(F.col("symbol") == n).drop("symbol") for n in ("click", "view")}
    return cf.cross_market(home, others, home_name="home", time="prediction_ts")


# ---------------------------------------------------------------- microstructure

SPAN = 54000
MICRO = f"""{bars_sql(60)}, placed AS (
  SELECT *, make_timestamp(CAST((floor(epoch(ts) / {SPAN}) + 1) * {SPAN} * 1000000 AS BIGINT)) AS prediction_ts FROM bars),
full_blocks AS (SELECT symbol, prediction_ts FROM placed GROUP BY 1, 2 HAVING count(*) = 15),
b0 AS (SELECT p.*, row_number() OVER x - 1 AS k, close / lag(close) OVER x - 1 AS r, sign(close - open) AS dir,
    max(high) OVER x AS top, min(low) OVER x AS bottom
  FROM placed p JOIN full_blocks USING (symbol, prediction_ts) WINDOW x AS (PARTITION BY symbol, prediction_ts ORDER BY ts)),
b1 AS (SELECT *, lag(r) OVER x AS r1, k - row_number() OVER (PARTITION BY symbol, prediction_ts, dir ORDER BY ts) AS island
  FROM b0 WINDOW x AS (PARTITION BY symbol, prediction_ts ORDER BY ts)),
runs AS (SELECT symbol, prediction_ts, max(n) FILTER (WHERE dir = 1) AS bull, max(n) FILTER (WHERE dir = -1) AS bear
  FROM (SELECT symbol, prediction_ts, dir, island, count(*) AS n FROM b1 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
blocks AS (SELECT symbol, prediction_ts, count(*) AS source_rows, max(ts) + INTERVAL 1 HOUR AS maximum_source_ts, arg_min(open, ts) AS o, arg_max(close, ts) AS c,
    max(high) AS h, min(low) AS l, avg(dir) AS m1_direction_imbalance, avg(CASE WHEN dir > 0 THEN 1.0 ELSE 0.0 END) AS m1_bullish_fraction,
    avg(r) AS m1_return_mean, stddev_pop(r) AS m1_return_std, skewness(r) AS m1_return_skew, sum((least(open, close) - low) - (high - greatest(open, close))) AS wick,
    sqrt(sum(r * r)) AS m1_realized_volatility, max(close) FILTER (WHERE k = 9) AS c9, max(close) FILTER (WHERE k = 0) AS c0,
    max(close) FILTER (WHERE k = 6) AS c6, max(close) FILTER (WHERE k = 7) AS c7, avg(CASE WHEN high = top THEN 1.0 ELSE 0.0 END) AS m1_new_high_fraction,
    avg(CASE WHEN low = bottom THEN 1.0 ELSE 0.0 END) AS m1_new_low_fraction, regr_slope(close, k) AS slope, corr(r, r1) AS m1_return_autocorrelation,
    avg(volume) AS m1_tick_volume_mean, sum(dir * volume) / sum(volume) AS m1_signed_tick_volume_imbalance,
    avg(spread) AS m1_spread_mean, stddev_pop(spread) AS m1_spread_std, max(spread) AS m1_spread_max, arg_max(spread, ts) AS m1_spread_last
  FROM b1 GROUP BY 1, 2),
micro AS (SELECT b.*, c / o - 1 AS m1_block_return, wick / (h - l) AS m1_wick_imbalance, (2 * c - h - l) / (h - l) AS m1_range_position,
    coalesce(bull, 0) AS m1_max_bull_run, coalesce(bear, 0) AS m1_max_bear_run, c / c9 - 1 AS m1_momentum_5, (c / c7 - 1) - (c6 / c0 - 1) AS m1_reversal_structure,
    (c - o) / (h - l) AS m1_distance_from_open, (c - h) / (h - l) AS m1_distance_from_high, (c - l) / (h - l) AS m1_distance_from_low, slope / (h - l) AS m1_trend_slope
  FROM blocks b JOIN runs USING (symbol, prediction_ts))"""
BLOCK_COLUMNS = [
    c for c in (*mf.PRICE_FEATURES, *mf.SPREAD_FEATURES)
    if c not in ("m1_range_expansion", "m1_volatility_acceleration", "m1_tick_volume_change", "m1_spread_change", "m1_range_atr_ratio")
]


def micro_blocks(spark, sf_dir):
    return mf.block_features(bars(spark, sf_dir, 60), bar_seconds=3600)


@query(
    "micro_block_features",
    "symbol:s prediction_ts:t maximum_source_ts:t source_rows:l " + " ".join(f"{c}:d" for c in BLOCK_COLUMNS),
    f"WITH {MICRO} SELECT * FROM micro",
)
def micro_block_features(spark, sf_dir):
    return micro_blocks(spark, sf_dir)


@query(
    "micro_across_blocks",
    "symbol:s prediction_ts:t m1_range_expansion:d m1_volatility_acceleration:d m1_tick_volume_change:d m1_spread_change:d m1_range_atr_ratio:d",
    f"""WITH {MICRO}, atr0 AS (SELECT symbol, ts + INTERVAL 1 HOUR AS prediction_ts, CASE WHEN count(high) OVER y = 14 THEN avg(high - low) OVER y END AS atr
      FROM bars WINDOW y AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING))
    SELECT m.symbol, m.prediction_ts, CASE WHEN count(m1_realized_volatility) OVER y = 20 THEN m1_realized_volatility / nullif(quantile_cont(m1_realized_volatility, 0.5) OVER y, 0) END AS m1_range_expansion,
      m1_realized_volatility / nullif(lag(m1_realized_volatility, 4) OVER w, 0) AS m1_volatility_acceleration,
      m1_tick_volume_mean / nullif(lag(m1_tick_volume_mean) OVER w, 0) - 1 AS m1_tick_volume_change, m1_spread_last - lag(m1_spread_last) OVER w AS m1_spread_change,
      (h - l) / nullif(atr, 0) AS m1_range_atr_ratio
    FROM micro m LEFT JOIN atr0 a ON a.symbol = m.symbol AND a.prediction_ts = m.prediction_ts
    WINDOW w AS (PARTITION BY m.symbol ORDER BY m.prediction_ts), y AS (PARTITION BY m.symbol ORDER BY m.prediction_ts ROWS 19 PRECEDING)""",
)
def micro_across_blocks(spark, sf_dir):
    from ..operators.series import over_series, rolling

    def mean_range(df, w):
        rng = F.col("high") - F.col("low")
        return df.withColumn("atr", rolling(F.avg(rng), w, 14, seen=rng))

    hourly = over_series(bars(spark, sf_dir, 60), mean_range, back=14)
    atr = hourly.select("symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("prediction_ts"), "atr")
    return mf.micro_features(micro_blocks(spark, sf_dir), atr)
