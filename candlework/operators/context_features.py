"""Completed-bar resampling and the feature families built on other series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import candle_asymmetry, centred_location, ratio, ratio_or_zero
from .asof import Source, asof_many
from .price_features import pct_change, true_range
from .series import over_series, rolling

DIRECTIONAL_BACK = 81


def completed_bars(bars: DataFrame, *, width: str, expected: int, by: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Wider bars, stamped when their last bar closes; incomplete ones are dropped."""
    extra = [F.sum("volume").alias("volume")] if "volume" in bars.columns else []
    return (
        bars.groupBy(*by, F.window(ts, width).alias("_w"))
        .agg(
            F.min_by("open", ts).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", ts).alias("close"),
            *extra,
            F.count("close").alias("_n"),
        )
        .where(F.col("_n") == expected)
        .select(*by, F.col("_w.end").alias(ts), "open", "high", "low", "close", *(["volume"] if extra else []))
    )


def directional_columns(w: WindowSpec, atr: str = "atr") -> dict[str, Column]:
    """Eighteen direction features; warm-up of the located ones is 0, not NULL."""
    c, r = F.col("close"), F.col("_r")
    out: dict[str, Column] = {f"return_lag_{k}": F.lag(r, k).over(w) for k in (1, 2, 3, 5)}
    out |= {f"return_{h}": pct_change(c, w, h) for h in (20, 40, 80)}
    out |= {f"atr_trend_{h}": ratio_or_zero(c - F.lag(c, h).over(w), F.col(atr)) for h in (5, 10, 20, 40)}
    out |= {f"directional_persistence_{n}": rolling(F.avg(F.signum(r)), w, n, seen=r) for n in (5, 10, 20)}
    for n in (20, 50):
        lo = rolling(F.min("low"), w, n, seen=F.col("low"))
        hi = rolling(F.max("high"), w, n, seen=F.col("high"))
        out[f"range_position_{n}"] = centred_location(c - lo, hi - lo)
    return out | candle_asymmetry()


def directional_features(bars: DataFrame, *, atr: str = "atr", by: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumn("_r", pct_change(F.col("close"), w))
        return df.withColumns(directional_columns(w, atr)).drop("_r")

    return over_series(bars, build, by=by, ts=ts, back=DIRECTIONAL_BACK)


def direction_rules(bars: DataFrame, *, by: Sequence[str] = ("symbol",), ts: str = "ts", divide: Callable[[Column, Column], Column] = ratio) -> DataFrame:
    """Four causal direction rules as columns (1, -1, 0 or NULL in the warm-up).

    ``divide`` says what the momentum over a zero close is; an undefined one has no direction (0).
    """

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        c = F.col("close")
        prior = w.rowsBetween(-20, -1)
        full = F.count("close").over(prior) == 20
        hi, lo = F.max("high").over(prior), F.min("low").over(prior)
        fast, slow = (rolling(F.avg(c), w, n, seen=c) for n in (10, 20))
        return df.withColumn("_m3", pct_change(c, w, 3, divide)).withColumns(
            {
                "momentum_3": F.when(F.isnan("_m3"), 0.0).otherwise(F.signum("_m3")),
                "ma_10_20": F.signum(fast - slow),
                "breakout_20": F.when(full & (c >= hi), 1.0).when(full & (c <= lo), -1.0).otherwise(0.0),
                "completed_bar_direction": F.signum(c - F.col("open")),
            }
        ).drop("_m3")

    return over_series(bars, build, by=by, ts=ts, back=21)


RULES = ("momentum_3", "ma_10_20", "breakout_20", "completed_bar_direction")


def long_rules(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per bar and rule."""
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("int").alias("direction")) for r in RULES])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.rule", "_p.direction")


def timeframe_features(bars: DataFrame, prefix: str, *, by: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Twelve features of a wider time frame; ATR here is a plain rolling mean."""

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        c = F.col("close")
        df = df.withColumns({"_r": pct_change(c, w), "_tr": true_range(w), "_ma": rolling(F.avg(c), w, 20, seen=c)})
        df = df.withColumn("_atr", rolling(F.avg("_tr"), w, 14, seen=F.col("_tr")))
        r, ma, atr = F.col("_r"), F.col("_ma"), F.col("_atr")
        hi = rolling(F.max("high"), w, 20, seen=c)
        lo = rolling(F.min("low"), w, 20, seen=c)
        prior = w.rowsBetween(-20, -1)
        full = F.count("close").over(prior) == 20
        out = {
            "return_1": r,
            **{f"return_{h}": pct_change(c, w, h) for h in (2, 4, 8, 12)},
            "trend_direction": F.signum(c - ma),
            "ma_slope": ratio(ma - F.lag(ma, 4).over(w), atr),
            "distance_ma": ratio(c - ma, atr),
            "volatility_regime": ratio(atr, rolling(F.percentile(atr, 0.5), w, 40, seen=atr)),
            "range_position": 2.0 * ratio(c - lo, hi - lo) - 1.0,
            "breakout_state": F.when(full & (c > F.max("high").over(prior)), 1.0)
            .when(full & (c < F.min("low").over(prior)), -1.0)
            .otherwise(0.0),
            "persistence": rolling(F.avg(F.signum(r)), w, 8, seen=r),
        }
        return df.withColumns({f"{prefix}_{k}": v for k, v in out.items()})

    made = over_series(bars, build, by=by, ts=ts, back=54, rows=512)
    return made.select(*by, ts, *[c for c in made.columns if c.startswith(f"{prefix}_")])


def market_features(bars: DataFrame, *, by: Sequence[str] = ("symbol",), ts: str = "ts", bar_minutes: int = 15, keep: Sequence[str] = ()) -> DataFrame:
    """Ten features of another market's bars, stamped at bar close."""

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        c = F.col("close")
        df = df.withColumns({"_r": pct_change(c, w), "_rng": ratio(F.col("high") - F.col("low"), c), "return_4": pct_change(c, w, 4)})
        r, rng = F.col("_r"), F.col("_rng")
        return df.withColumns(
            {
                "return_1": r,
                **{f"return_{h}": pct_change(c, w, h) for h in (2, 8, 12, 24)},
                "momentum_acceleration": F.col("return_4") - F.lag("return_4", 4).over(w),
                "persistence": rolling(F.avg(F.signum(r)), w, 12, seen=r),
                "realized_volatility": rolling(F.stddev_samp(r), w, 24, seen=r),
                "range_regime": ratio(rolling(F.avg(rng), w, 12, seen=rng), rolling(F.percentile(rng, 0.5), w, 96, seen=rng)),
            }
        )

    made = over_series(bars, build, by=by, ts=ts, back=97, rows=1024)
    names = ["return_1", "return_2", "return_4", "return_8", "return_12", "return_24", "momentum_acceleration", "persistence", "realized_volatility", "range_regime"]
    return made.select(*by, (F.col(ts) + F.make_dt_interval(mins=F.lit(bar_minutes))).alias(ts), *keep, *names)


def cross_market(
    home: DataFrame,
    others: dict[str, DataFrame],
    *,
    home_name: str,
    time: str,
    max_age_seconds: int = 4 * 3600,
) -> DataFrame:
    """Attach other markets' features and the spread/alignment columns.

    ``home`` needs ``return_4`` and ``return_12``; each entry of ``others`` is a
    ``market_features`` frame of one series without its key column.
    """
    sources = [
        Source(frame, "ts", max_age_seconds, prefix=f"{name}_", source_time=f"{name}_source_ts", age=f"{name}_age_seconds")
        for name, frame in others.items()
    ]
    out = asof_many(home, sources, left_time=time)
    h4, h12 = F.col("return_4"), F.col("return_12")
    names = list(others)
    made: dict[str, Column] = {}
    for name in names:
        made[f"{home_name}_minus_{name}_return_4"] = h4 - F.col(f"{name}_return_4")
        made[f"{home_name}_minus_{name}_return_12"] = h12 - F.col(f"{name}_return_12")
        made[f"{home_name}_{name}_alignment"] = F.signum(h4) * F.signum(F.col(f"{name}_return_4"))
    if len(names) == 2:
        a, b = names
        made[f"{a}_{b}_alignment"] = F.signum(F.col(f"{a}_return_4")) * F.signum(F.col(f"{b}_return_4"))
        made[f"{a}_minus_{b}_return_4"] = F.col(f"{a}_return_4") - F.col(f"{b}_return_4")
    return out.withColumns(made)
