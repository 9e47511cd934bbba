"""Queries for the look-back features of bar tables."""

from __future__ import annotations

import re

from ..functions import scalar
from ..operators import price_features as pf
from .inputs import bars, bars_sql
from .registry import query

BARS = bars_sql()
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
KEY = "symbol:s ts:t "


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"


def roll(agg: str, x: str, n: int) -> str:
    """Rolling aggregate with a full-window guard."""
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {agg}({x}) OVER {frame(n)} END"


def features(spark, sf_dir, *families):
    return pf.price_features(bars(spark, sf_dir), families=families)


@query(
    "features_returns",
    KEY + "returns:d returns_2:d returns_5:d returns_10:d log_returns:d",
    f"""WITH {BARS} SELECT symbol, ts, close / nullif(lag(close) OVER w, 0) - 1 AS returns,
    close / nullif(lag(close, 2) OVER w, 0) - 1 AS returns_2, close / nullif(lag(close, 5) OVER w, 0) - 1 AS returns_5,
    close / nullif(lag(close, 10) OVER w, 0) - 1 AS returns_10,
    CASE WHEN close / nullif(lag(close) OVER w, 0) > 0 THEN ln(close / nullif(lag(close) OVER w, 0)) END AS log_returns FROM bars {W}""",
)
def features_returns(spark, sf_dir):
    return features(spark, sf_dir, "returns")


@query(
    "features_bar_ratios",
    KEY + "high_low_ratio:d close_open_ratio:d",
    f"WITH {BARS} SELECT symbol, ts, (high - low) / nullif(close, 0) AS high_low_ratio, (close - open) / nullif(open, 0) AS close_open_ratio FROM bars",
)
def features_bar_ratios(spark, sf_dir):
    return bars(spark, sf_dir).withColumns(scalar.bar_ratios())


@query(
    "features_candle_anatomy",
    KEY + "body_size:d upper_shadow:d lower_shadow:d",
    f"""WITH {BARS} SELECT symbol, ts, abs(close - open) / nullif(open, 0) AS body_size,
    (high - greatest(open, close)) / nullif(open, 0) AS upper_shadow, (least(open, close) - low) / nullif(open, 0) AS lower_shadow FROM bars""",
)
def features_candle_anatomy(spark, sf_dir):
    return bars(spark, sf_dir).withColumns(scalar.candle_anatomy())


@query(
    "features_candle_asymmetry",
    KEY + "candle_close_location:d signed_body_range:d",
    f"""WITH {BARS} SELECT symbol, ts,
    CASE WHEN high = low THEN 0 ELSE 2 * (close - low) / (high - low) - 1 END AS candle_close_location,
    CASE WHEN high = low THEN 0 ELSE (close - open) / (high - low) END AS signed_body_range FROM bars""",
)
def features_candle_asymmetry(spark, sf_dir):
    return bars(spark, sf_dir).withColumns(scalar.candle_asymmetry())


@query(
    "features_clock",
    KEY + "day_of_week:l is_weekend:l hour_of_day:l is_market_open:l is_asia_session:l is_london_session:l is_new_york_session:l",
    f"""WITH {BARS} SELECT symbol, ts, isodow(ts) - 1 AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    hour(ts) AS hour_of_day, 1 AS is_market_open, CASE WHEN hour(ts) <= 7 THEN 1 ELSE 0 END AS is_asia_session,
    CASE WHEN hour(ts) BETWEEN 8 AND 15 THEN 1 ELSE 0 END AS is_london_session,
    CASE WHEN hour(ts) BETWEEN 13 AND 20 THEN 1 ELSE 0 END AS is_new_york_session FROM bars""",
)
def features_clock(spark, sf_dir):
    return bars(spark, sf_dir).withColumns(scalar.clock_features())


def null_at_zero(sql: str, *divisors: str) -> str:
    """``sql`` in which a division by one of the ``divisors`` is NULL where that is zero, as ``scalar.ratio`` has it."""
    for d in divisors:
        sql, found = re.subn(rf"/ {re.escape(d)}(?![\w.(])", f"/ nullif({d}, 0)", sql)
        if not found:
            raise ValueError(f"nothing is divided by {d}")
    return sql


def ewm_sql(source: str, x: str, alpha: str, *, adjust: bool, out: str) -> str:
    """Recursive decayed mean over ``i`` per symbol (``source`` has symbol, i, x)."""
    if adjust:
        return f"""{out} AS (
          SELECT symbol, i, {x} AS num, CAST(1 AS DOUBLE) AS den FROM {source} WHERE i = 1
          UNION ALL
          SELECT s.symbol, s.i, s.{x} + (1 - {alpha}) * r.num, 1 + (1 - {alpha}) * r.den
          FROM {out} r JOIN {source} s ON s.symbol = r.symbol AND s.i = r.i + 1)"""
    return f"""{out} AS (
      SELECT symbol, i, {x} AS y FROM {source} WHERE i = 1
      UNION ALL
      SELECT s.symbol, s.i, {alpha} * s.{x} + (1 - {alpha}) * r.y
      FROM {out} r JOIN {source} s ON s.symbol = r.symbol AND s.i = r.i + 1)"""


NUMBERED = f"""{BARS}, numbered AS (
  SELECT *, row_number() OVER w AS i, lag(close) OVER w AS before,
         greatest(coalesce(close - lag(close) OVER w, 0), 0) AS gain,
         greatest(-coalesce(close - lag(close) OVER w, 0), 0) AS loss,
         coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr
  FROM bars {W})"""

ATR_SQL = f"""{NUMBERED}, {ewm_sql('numbered', 'tr', '(1.0::DOUBLE / 14)', adjust=True, out='atr_r')},
atr_t AS (
  SELECT n.*, CASE WHEN n.i >= 14 THEN num / den END AS atr, CASE WHEN n.i >= 14 THEN num / den / close END AS atr_pct
  FROM numbered n JOIN atr_r USING (symbol, i))"""

ATR_OR_NULL_SQL = null_at_zero(ATR_SQL, "close")


@query(
    "features_rsi",
    KEY + "rsi:d4",
    f"""WITH RECURSIVE {NUMBERED}, {ewm_sql('numbered', 'gain', '(1.0::DOUBLE / 14)', adjust=True, out='g')},
    {ewm_sql('numbered', 'loss', '(1.0::DOUBLE / 14)', adjust=True, out='l')}
    SELECT n.symbol, n.ts, CASE WHEN n.i < 14 OR l.num = 0 THEN 50
           ELSE 100 - 100 / (1 + (g.num / g.den) / (l.num / l.den)) END AS rsi
    FROM numbered n JOIN g USING (symbol, i) JOIN l USING (symbol, i)""",
)
def features_rsi(spark, sf_dir):
    return features(spark, sf_dir, "rsi")


@query(
    "features_macd",
    KEY + "macd:d4 macd_signal:d4 macd_hist:d4",
    f"""WITH RECURSIVE {NUMBERED}, {ewm_sql('numbered', 'close', '(2.0::DOUBLE / 13)', adjust=False, out='f')},
    {ewm_sql('numbered', 'close', '(2.0::DOUBLE / 27)', adjust=False, out='s')},
    m AS (SELECT f.symbol, f.i, f.y - s.y AS macd FROM f JOIN s USING (symbol, i)),
    {ewm_sql('m', 'macd', '(2.0::DOUBLE / 10)', adjust=False, out='sig')}
    SELECT n.symbol, n.ts, macd, sig.y AS macd_signal, macd - sig.y AS macd_hist
    FROM numbered n JOIN m USING (symbol, i) JOIN sig USING (symbol, i)""",
)
def features_macd(spark, sf_dir):
    return features(spark, sf_dir, "macd")


@query(
    "features_bollinger",
    KEY + "bb_upper:d bb_lower:d bb_width:d bb_pct:d",
    f"""WITH {BARS}, b AS (SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM bars)
    SELECT symbol, ts, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, 4 * s / m AS bb_width,
           (close - (m - 2 * s)) / nullif(4 * s, 0) AS bb_pct FROM b""",
)
def features_bollinger(spark, sf_dir):
    return features(spark, sf_dir, "bands")


@query(
    "features_moving_averages",
    KEY + " ".join(f"sma_{n}:d price_to_sma_{n}:d" for n in pf.SMA_PERIODS),
    f"WITH {BARS}, s AS (SELECT *, "
    + ", ".join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in pf.SMA_PERIODS)
    + " FROM bars) SELECT *, "
    + ", ".join(f"close / sma_{n} AS price_to_sma_{n}" for n in pf.SMA_PERIODS)
    + " FROM s",
)
def features_moving_averages(spark, sf_dir):
    return features(spark, sf_dir, "averages")


@query(
    "features_ema",
    KEY + "ema_12:d4 ema_26:d4",
    f"""WITH RECURSIVE {NUMBERED}, {ewm_sql('numbered', 'close', '(2.0::DOUBLE / 13)', adjust=False, out='f')},
    {ewm_sql('numbered', 'close', '(2.0::DOUBLE / 27)', adjust=False, out='s')}
    SELECT n.symbol, n.ts, f.y AS ema_12, s.y AS ema_26 FROM numbered n JOIN f USING (symbol, i) JOIN s USING (symbol, i)""",
)
def features_ema(spark, sf_dir):
    return features(spark, sf_dir, "ema")


@query("features_atr", KEY + "atr:d4 atr_pct:d4", f"WITH RECURSIVE {ATR_OR_NULL_SQL} SELECT symbol, ts, atr, atr_pct FROM atr_t")
def features_atr(spark, sf_dir):
    return features(spark, sf_dir, "atr")


@query(
    "features_volatility",
    KEY + "volatility_5:d volatility_20:d",
    f"""WITH {BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS r FROM bars {W})
    SELECT symbol, ts, {roll('stddev_samp', 'r', 5)} AS volatility_5, {roll('stddev_samp', 'r', 20)} AS volatility_20 FROM r""",
)
def features_volatility(spark, sf_dir):
    return features(spark, sf_dir, "volatility")


@query(
    "features_volume",
    KEY + "volume_sma:d volume_ratio:d obv:d",
    f"""WITH {BARS}, s AS (SELECT *, {roll('avg', 'volume', 20)} AS volume_sma,
      coalesce(sign(close - lag(close) OVER w) * volume, 0) AS step FROM bars {W})
    SELECT symbol, ts, volume_sma, volume / nullif(volume_sma, 0) AS volume_ratio, sum(step) OVER w AS obv FROM s {W}""",
)
def features_volume(spark, sf_dir):
    return features(spark, sf_dir, "volume")


FEATURES_ALL_SQL = f"""WITH RECURSIVE {NUMBERED}, {ewm_sql('numbered', 'gain', '(1.0::DOUBLE / 14)', adjust=True, out='g')}, {ewm_sql('numbered', 'loss', '(1.0::DOUBLE / 14)', adjust=True, out='l')},
    {ewm_sql('numbered', 'tr', '(1.0::DOUBLE / 14)', adjust=True, out='a')}, {ewm_sql('numbered', 'close', '(2.0::DOUBLE / 13)', adjust=False, out='f')}, {ewm_sql('numbered', 'close', '(2.0::DOUBLE / 27)', adjust=False, out='s')},
    m AS (SELECT f.symbol, f.i, f.y - s.y AS macd FROM f JOIN s USING (symbol, i)), {ewm_sql('m', 'macd', '(2.0::DOUBLE / 10)', adjust=False, out='sig')},
    base AS (SELECT n.*, CASE WHEN n.i < 14 OR l.num = 0 THEN 50 ELSE 100 - 100 / (1 + (g.num / g.den) / (l.num / l.den)) END AS rsi, macd, sig.y AS macd_signal, macd - sig.y AS macd_hist, f.y AS ema_12, s.y AS ema_26,
      CASE WHEN n.i >= 14 THEN a.num / a.den END AS atr FROM numbered n JOIN g USING (symbol, i) JOIN l USING (symbol, i) JOIN a USING (symbol, i) JOIN f USING (symbol, i) JOIN s USING (symbol, i) JOIN m USING (symbol, i) JOIN sig USING (symbol, i)),
    w1 AS (SELECT *, close / before - 1 AS returns, close / lag(close, 2) OVER w - 1 AS returns_2, close / lag(close, 5) OVER w - 1 AS returns_5, close / lag(close, 10) OVER w - 1 AS returns_10, ln(close / before) AS log_returns,
      {roll('avg', 'close', 20)} AS bm, {roll('stddev_samp', 'close', 20)} AS bs, {', '.join(f"{roll('avg', 'close', n)} AS sma_{n}" for n in pf.SMA_PERIODS)}, {roll('avg', 'volume', 20)} AS volume_sma,
      coalesce(sign(close - before) * volume, 0) AS step FROM base {W})
    SELECT *, (high - low) / close AS high_low_ratio, (close - open) / open AS close_open_ratio, bm + 2 * bs AS bb_upper, bm - 2 * bs AS bb_lower, 4 * bs / bm AS bb_width, (close - (bm - 2 * bs)) / nullif(4 * bs, 0) AS bb_pct,
      {', '.join(f"close / sma_{n} AS price_to_sma_{n}" for n in pf.SMA_PERIODS)}, atr / close AS atr_pct, {roll('stddev_samp', 'returns', 5)} AS volatility_5, {roll('stddev_samp', 'returns', 20)} AS volatility_20,
      volume / nullif(volume_sma, 0) AS volume_ratio, sum(step) OVER w AS obv, abs(close - open) / open AS body_size, (high - greatest(open, close)) / open AS upper_shadow, (least(open, close) - low) / open AS lower_shadow,
      isodow(ts) - 1 AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, hour(ts) AS hour_of_day, 1 AS is_market_open, CASE WHEN hour(ts) <= 7 THEN 1 ELSE 0 END AS is_asia_session,
      CASE WHEN hour(ts) BETWEEN 8 AND 15 THEN 1 ELSE 0 END AS is_london_session, CASE WHEN hour(ts) BETWEEN 13 AND 20 THEN 1 ELSE 0 END AS is_new_york_session FROM w1 {W}"""

FEATURES_OR_NULL_SQL = null_at_zero(
    FEATURES_ALL_SQL.replace("ln(close / before)", "CASE WHEN close / before > 0 THEN ln(close / before) END"),
    "before", *[f"lag(close, {n}) OVER w" for n in (2, 5, 10)], "close", "open", "bm", *[f"sma_{n}" for n in pf.SMA_PERIODS],
)


@query(
    "features_all",
    KEY + " ".join(f"{f}:l" if f in pf.SESSION_FEATURES else f"{f}:q" if f.startswith("price_to_sma") else f"{f}:d4" if f in ("rsi", "macd", "macd_signal", "macd_hist", "ema_12", "ema_26", "atr", "atr_pct") else f"{f}:d" for f in pf.FEATURES),
    FEATURES_OR_NULL_SQL,
)
def features_all(spark, sf_dir):
    """All 42 features in one blocked pass."""
    return features(spark, sf_dir, *pf.FAMILIES)
