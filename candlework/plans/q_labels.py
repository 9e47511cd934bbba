"""Queries for forward-looking labels and rule outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels
from ..functions.scalar import asymmetric_labels, ratio
from ..operators import context_features as cf
from ..operators import labels as lb
from ..operators import price_features as pf
from .inputs import bars, bars_sql
from .q_features import ATR_SQL, KEY, NUMBERED, W, null_at_zero, roll
from .registry import query


def atr_bars(spark, sf_dir, **kw):
    return pf.price_features(bars(spark, sf_dir), families=("atr",), **kw)


def touches_sql(source: str, up: str, down: str, h: int) -> str:
    """First upper/lower touch offsets by a self join on position."""
    return f"""touch AS (
      SELECT a.symbol, a.i, min(CASE WHEN b.high >= {up} THEN b.i - a.i END) AS u,
             min(CASE WHEN b.low <= {down} THEN b.i - a.i END) AS d, count(b.i) AS seen,
             max(b.high) AS hi, min(b.low) AS lo, arg_max(b.close, b.i) AS last_close, max(b.ts) AS last_ts
      FROM {source} a LEFT JOIN {source} b ON b.symbol = a.symbol AND b.i > a.i AND b.i <= a.i + {h} GROUP BY 1, 2)"""


TP, SL, HOLD = 40.0, 15.0, 40
LONG_TOUCH = touches_sql("numbered", f"a.close + {TP}", f"a.close - {SL}", HOLD)


def outcome_sql(u: str, d: str, same: str, none: str) -> str:
    return f"""CASE WHEN {u} IS NULL AND {d} IS NULL THEN {none} WHEN {u} = {d} THEN {same}
      WHEN {d} IS NULL OR {u} < {d} THEN 1 ELSE 0 END"""


@query(
    "label_take_profit_before_stop",
    KEY + "target:l",
    f"""WITH {NUMBERED}, {LONG_TOUCH} SELECT n.symbol, n.ts, {outcome_sql('u', 'd', '0', 'NULL')} AS target
    FROM numbered n JOIN touch USING (symbol, i)""",
)
def label_take_profit(spark, sf_dir):
    return lb.take_profit_label(bars(spark, sf_dir), tp=F.lit(TP), sl=F.lit(SL), max_bars=HOLD)


@query(
    "label_take_profit_tp_first_unresolved_sl",
    KEY + "target:l",
    f"""WITH {NUMBERED}, {LONG_TOUCH} SELECT n.symbol, n.ts, {outcome_sql('u', 'd', '1', '0')} AS target
    FROM numbered n JOIN touch USING (symbol, i)""",
)
def label_take_profit_tp_first(spark, sf_dir):
    return lb.take_profit_label(
        bars(spark, sf_dir), tp=F.lit(TP), sl=F.lit(SL), max_bars=HOLD, same_bar_rule="tp_first", unresolved_policy="sl"
    )


def _directional_sql(short_win: str, short_loss: str) -> str:
    return f"""WITH {NUMBERED}, {LONG_TOUCH}, short AS (
      SELECT a.symbol, a.i, min(CASE WHEN {short_win} THEN b.i - a.i END) AS u, min(CASE WHEN {short_loss} THEN b.i - a.i END) AS d
      FROM numbered a LEFT JOIN numbered b ON b.symbol = a.symbol AND b.i > a.i AND b.i <= a.i + {HOLD} GROUP BY 1, 2),
    o AS (SELECT n.symbol, n.ts, n.close, t.last_close, {outcome_sql('t.u', 't.d', '0', 'NULL')} AS lo,
                 {outcome_sql('s.u', 's.d', '0', 'NULL')} AS so
          FROM numbered n JOIN touch t USING (symbol, i) JOIN short s USING (symbol, i))
    SELECT symbol, ts, CASE WHEN lo = 1 AND so = 0 THEN 1 WHEN lo = 0 AND so = 1 THEN 0 WHEN last_close IS NULL THEN 2
      WHEN last_close >= close + {TP} THEN 1 WHEN last_close <= close - {SL} THEN 0
      WHEN last_close > close THEN 1 WHEN last_close < close THEN 0 ELSE 2 END AS target FROM o"""


@query("label_directional", KEY + "target:l", _directional_sql(f"b.low <= a.close - {TP}", f"b.high >= a.close + {SL}"))
def label_directional(spark, sf_dir):
    return lb.directional_label(bars(spark, sf_dir), tp=F.lit(TP), sl=F.lit(SL), max_bars=HOLD)


@query("label_directional_legacy_short", KEY + "target:l", _directional_sql(f"b.high >= a.close - {TP}", f"b.low <= a.close + {SL}"))
def label_directional_legacy(spark, sf_dir):
    return lb.directional_label(bars(spark, sf_dir), tp=F.lit(TP), sl=F.lit(SL), max_bars=HOLD, legacy_short=True)


FORWARD_SQL = f"""{ATR_SQL}, fwd AS (
  SELECT *, lead(close, 5) OVER w AS c5, close / lag(close, 5) OVER w - 1 AS returns_5 FROM atr_t {W}),
labelled AS (
  SELECT *, CASE WHEN close = 0 THEN 2 WHEN c5 IS NULL THEN NULL
    WHEN c5 / close - 1 > coalesce(atr_pct, 0) THEN 1 WHEN c5 / close - 1 < -coalesce(atr_pct, 0) THEN 0 ELSE 2 END AS target
  FROM fwd)"""


@query("label_forward_atr", KEY + "target:l", f"WITH RECURSIVE {FORWARD_SQL} SELECT symbol, ts, target FROM labelled")
def label_forward_atr(spark, sf_dir):
    return atr_bars(spark, sf_dir, ahead=5, extra=lambda df, w: df.withColumn("target", lb.forward_atr_column(w)))


PASSAGE = touches_sql("atr_t", "a.close + a.atr", "a.close - a.atr", 5)
PASSAGE_CASE = "CASE WHEN seen < 5 THEN 4 WHEN u IS NULL AND d IS NULL THEN 2 WHEN u = d THEN 3 WHEN d IS NULL OR u < d THEN 1 ELSE 0 END"


@query(
    "label_first_passage",
    KEY + "first_passage_target:l first_hit_bar:l upper_barrier:d4 lower_barrier:d4",
    f"""WITH RECURSIVE {ATR_SQL}, {PASSAGE} SELECT n.symbol, n.ts, {PASSAGE_CASE} AS first_passage_target,
    CASE WHEN seen = 5 THEN least(u, d) END AS first_hit_bar, close + atr AS upper_barrier, close - atr AS lower_barrier
    FROM atr_t n JOIN touch USING (symbol, i)""",
)
def label_first_passage(spark, sf_dir):
    reach = F.col("atr")

    def extra(df, w):
        return df.withColumns(
            {**lb.first_passage_columns(w, 5), "upper_barrier": F.col("close") + reach, "lower_barrier": F.col("close") - reach}
        )

    return atr_bars(spark, sf_dir, ahead=5, extra=extra)


@query(
    "label_first_passage_reconstruction",
    "rows:l matching:l match_pct:d",
    f"""WITH RECURSIVE {ATR_SQL} SELECT count(*) AS rows, count(*) AS matching, 100.0 AS match_pct FROM atr_t""",
)
def label_reconstruction(spark, sf_dir):
    """Frame formulation against range-join formulation: they must agree on every row."""
    b = atr_bars(spark, sf_dir, ahead=5, extra=lambda df, w: df.withColumns(lb.first_passage_columns(w, 5)))
    again = lb.first_passage_by_range(b)
    same = F.col("first_passage_target") == F.col("reconstructed")
    return b.join(again, ["symbol", "bar_index"]).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("matching"), (100.0 * F.avg(same.cast("int"))).alias("match_pct")
    )


@query(
    "label_touch_offsets",
    KEY + "first_upper:l first_lower:l",
    f"WITH {NUMBERED}, {LONG_TOUCH} SELECT n.symbol, n.ts, u AS first_upper, d AS first_lower FROM numbered n JOIN touch USING (symbol, i)",
)
def label_touch_offsets(spark, sf_dir):
    return lb.take_profit_label(bars(spark, sf_dir), tp=F.lit(TP), sl=F.lit(SL), max_bars=HOLD)


RESOLUTION_SQL = """CASE WHEN u IS NULL AND d IS NULL THEN 'unresolved' WHEN u = d THEN 'both' WHEN least(u, d) = 1 THEN '1_bar'
  WHEN least(u, d) = 2 THEN '2_bars' WHEN least(u, d) = 3 THEN '3_bars' WHEN least(u, d) <= 5 THEN '4_5_bars'
  WHEN least(u, d) <= 10 THEN '6_10_bars' WHEN least(u, d) <= 20 THEN '11_20_bars' WHEN least(u, d) <= 40 THEN '21_40_bars'
  ELSE 'over_40_bars' END"""


@query(
    "label_resolution_times",
    "symbol:s bin:s n:l share:d tp_first:l sl_first:l",
    f"""WITH {NUMBERED}, {LONG_TOUCH}, b AS (SELECT symbol, {RESOLUTION_SQL} AS bin, u, d FROM touch)
    SELECT symbol, bin, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY symbol) AS share,
      count(*) FILTER (WHERE coalesce(u, 999) < coalesce(d, 999)) AS tp_first,
      count(*) FILTER (WHERE coalesce(u, 999) > coalesce(d, 999)) AS sl_first FROM b GROUP BY 1, 2""",
)
def label_resolution_times(spark, sf_dir):
    touched = lb.take_profit_label(bars(spark, sf_dir), tp=F.lit(TP), sl=F.lit(SL), max_bars=HOLD)
    return lb.resolution_times(touched, ["symbol"])


HORIZONS = (1, 2, 3, 4, 5, 8)


@query(
    "label_multi_horizon",
    KEY + " ".join(f"first_passage_target_{h}:l" for h in HORIZONS),
    f"WITH RECURSIVE {ATR_SQL}, {touches_sql('atr_t', 'a.close + a.atr', 'a.close - a.atr', 8)} SELECT n.symbol, n.ts, "
    + ", ".join(
        f"""CASE WHEN seen < {h} THEN 4 WHEN coalesce(u, 99) > {h} AND coalesce(d, 99) > {h} THEN 2 WHEN u = d THEN 3
        WHEN coalesce(u, 99) < coalesce(d, 99) THEN 1 ELSE 0 END AS first_passage_target_{h}"""
        for h in HORIZONS
    )
    + " FROM atr_t n JOIN touch USING (symbol, i)",
)
def label_multi_horizon(spark, sf_dir):
    return lb.multi_horizon_labels(atr_bars(spark, sf_dir).drop("bar_index"), horizons=HORIZONS)


RULES_SQL = f"""ruled AS (
  SELECT *, sign(close / lag(close, 3) OVER w - 1) AS momentum_3,
    sign({roll('avg', 'close', 10)} - {roll('avg', 'close', 20)}) AS ma_10_20,
    CASE WHEN count(close) OVER p < 20 THEN 0 WHEN close >= max(high) OVER p THEN 1 WHEN close <= min(low) OVER p THEN -1 ELSE 0 END AS breakout_20,
    sign(close - open) AS completed_bar_direction FROM SRC
  {W}, p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
long_rules AS (
  SELECT symbol, ts, 'momentum_3' AS rule, CAST(momentum_3 AS BIGINT) AS direction FROM ruled
  UNION ALL SELECT symbol, ts, 'ma_10_20', CAST(ma_10_20 AS BIGINT) FROM ruled
  UNION ALL SELECT symbol, ts, 'breakout_20', CAST(breakout_20 AS BIGINT) FROM ruled
  UNION ALL SELECT symbol, ts, 'completed_bar_direction', CAST(completed_bar_direction AS BIGINT) FROM ruled)"""


@query(
    "rules_direction",
    KEY + "rule:s direction:l",
    f"WITH {bars_sql()}, {null_at_zero(RULES_SQL, 'lag(close, 3) OVER w').replace('SRC', 'bars')} SELECT symbol, ts, rule, direction FROM long_rules",
)
def rules_direction(spark, sf_dir):
    return cf.long_rules(cf.direction_rules(bars(spark, sf_dir)), ["symbol", "ts"])


def ruled_outcomes(spark, sf_dir, divide=ratio):
    """Outcomes of every rule; each rule is its own series so all share one pass."""
    ruled = cf.direction_rules(atr_bars(spark, sf_dir).drop("bar_index"), divide=divide).where(F.col("atr").isNotNull())
    long = cf.long_rules(ruled, ["symbol", "ts", "high", "low", "close", "atr"])
    return lb.rule_outcomes(long, by=("symbol", "rule"), divide=divide)


OUTCOMES_SQL = f"""{ATR_SQL}, {RULES_SQL.replace('SRC', 'atr_t')}, {touches_sql('atr_t', 'a.close + a.atr', 'a.close - a.atr', 5)},
outcomes AS (
  SELECT n.symbol, n.ts, r.rule, r.direction, r.direction * (last_close - close) / close AS terminal_return,
    CASE WHEN r.direction > 0 THEN hi - close ELSE close - lo END / close AS mfe,
    CASE WHEN r.direction > 0 THEN lo - close ELSE close - hi END / close AS mae,
    CASE WHEN r.direction > 0 THEN u ELSE d END AS good, CASE WHEN r.direction > 0 THEN d ELSE u END AS poor, last_ts
  FROM atr_t n JOIN touch USING (symbol, i) JOIN long_rules r USING (symbol, ts)
  WHERE seen = 5 AND r.direction IN (-1, 1) AND atr IS NOT NULL),
outcome_rows AS (
  SELECT *, CAST(good IS NOT NULL AS INT) AS reached_plus_1atr, CAST(poor IS NOT NULL AS INT) AS reached_minus_1atr,
    CASE WHEN good IS NULL AND poor IS NULL THEN 'UNRESOLVED' WHEN good = poor THEN 'SAME_BAR_TIE'
         WHEN poor IS NULL OR good < poor THEN 'FAVORABLE' ELSE 'ADVERSE' END AS first_passage FROM outcomes)"""

OUTCOMES_OR_NULL = ("close", "lag(close, 3) OVER w")


@query(
    "rules_outcomes",
    KEY + "rule:s direction:l terminal_return:d mfe:d mae:d reached_plus_1atr:l reached_minus_1atr:l first_passage:s maximum_outcome_ts:t",
    f"WITH RECURSIVE {null_at_zero(OUTCOMES_SQL, *OUTCOMES_OR_NULL)} SELECT *, last_ts AS maximum_outcome_ts FROM outcome_rows",
)
def rules_outcomes(spark, sf_dir):
    return ruled_outcomes(spark, sf_dir)


BOUNDARY_SQL = f"""{FORWARD_SQL}, forward AS (
  SELECT *, lead(returns_5, 5) OVER w AS forward_return FROM labelled {W}),
boundary AS (
  SELECT *, abs(atr_pct) AS threshold_return, forward_return / abs(atr_pct) AS forward_move_atr,
    abs(forward_return / abs(atr_pct)) AS absolute_move_atr, abs(abs(forward_return / abs(atr_pct)) - 1) AS boundary_distance_atr,
    abs(atr) AS threshold_price_points, forward_return * atr / atr_pct AS forward_move_price_points,
    CASE WHEN forward_return > abs(atr_pct) THEN 1 WHEN forward_return < -abs(atr_pct) THEN 0 ELSE 2 END AS reconstructed_target
  FROM forward WHERE forward_return IS NOT NULL AND atr_pct IS NOT NULL)"""


def boundary_rows(spark, sf_dir, divide=ratio):
    def extra(df, w):
        df = df.withColumns({"target": lb.forward_atr_column(w), "returns_5": pf.pct_change(F.col("close"), w, 5, divide)})
        return df.withColumn("forward_return", F.lead("returns_5", 5).over(w))

    rows = atr_bars(spark, sf_dir, ahead=5, extra=extra, divide=divide)
    return rows.where(F.col("forward_return").isNotNull() & F.col("atr_pct").isNotNull()).withColumns(lb.boundary_columns(divide=divide))


@query(
    "label_boundary_distance",
    KEY + "target:l reconstructed_target:l threshold_return:d4 forward_move_atr:d4 absolute_move_atr:d4 boundary_distance_atr:d4 threshold_price_points:d4 forward_move_price_points:d4",
    f"WITH RECURSIVE {null_at_zero(BOUNDARY_SQL, 'close', 'lag(close, 5) OVER w', 'abs(atr_pct)', 'atr_pct')} SELECT * FROM boundary",
)
def label_boundary_distance(spark, sf_dir):
    return boundary_rows(spark, sf_dir)


@query(
    "label_asymmetric",
    "symbol:s rows:l buy:l sell:l both:l",
    f"""WITH RECURSIVE {FORWARD_SQL} SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE target = 1) AS buy,
    count(*) FILTER (WHERE target = 0) AS sell, 0 AS both FROM labelled WHERE target IS NOT NULL GROUP BY 1""",
)
def label_asymmetric(spark, sf_dir):
    rows = label_forward_atr(spark, sf_dir).where(F.col("target").isNotNull()).withColumns(asymmetric_labels())
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("buy_success").alias("buy"),
        F.sum("sell_success").alias("sell"),
        F.count_if((F.col("buy_success") == 1) & (F.col("sell_success") == 1)).alias("both"),
    )


@query(
    "label_economic_sanity",
    "symbol:s rows:l mean_signed_return:d mean_after_spread:d win_rate:d",
    f"""WITH {NUMBERED}, p AS (
      SELECT symbol, CASE WHEN close > open THEN 1 ELSE -1 END AS side, close, spread * 0.0001 AS cost, lead(close, 5) OVER w AS c5 FROM numbered {W}),
    r AS (SELECT symbol, side * (c5 / nullif(close, 0) - 1) AS s, side * (c5 / nullif(close, 0) - 1) - cost / nullif(close, 0) AS net FROM p WHERE c5 IS NOT NULL)
    SELECT symbol, count(*) AS rows, avg(s) AS mean_signed_return, avg(net) AS mean_after_spread,
      avg(CASE WHEN s > 0 THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END) AS win_rate FROM r GROUP BY 1""",
)
def label_economic_sanity(spark, sf_dir):
    side = F.when(F.col("close") > F.col("open"), 1).otherwise(-1)
    return levels.endpoint_economics(
        bars(spark, sf_dir), side=side, horizon=5, cost=F.col("spread") * 0.0001, keys=["symbol"]
    )
