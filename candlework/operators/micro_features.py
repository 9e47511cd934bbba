"""Features of fixed blocks of fine bars, and of the sequence of blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import ratio, ratio_or_zero
from .series import over_series, rolling

# Feature names in contract order.
PRICE_FEATURES = [
    "m1_block_return", "m1_direction_imbalance", "m1_bullish_fraction", "m1_return_mean", "m1_return_std", "m1_return_skew",
    "m1_range_expansion", "m1_wick_imbalance", "m1_range_position", "m1_realized_volatility", "m1_volatility_acceleration",
    "m1_max_bull_run", "m1_max_bear_run", "m1_momentum_5", "m1_reversal_structure", "m1_distance_from_open",
    "m1_distance_from_high", "m1_distance_from_low", "m1_new_high_fraction", "m1_new_low_fraction", "m1_trend_slope",
    "m1_return_autocorrelation", "m1_range_atr_ratio", "m1_tick_volume_mean", "m1_tick_volume_change",
    "m1_signed_tick_volume_imbalance",
]
SPREAD_FEATURES = ["m1_spread_mean", "m1_spread_std", "m1_spread_max", "m1_spread_last", "m1_spread_change"]


def _longest_run(direction: int, running: WindowSpec) -> Column:
    """Length of the run of ``direction`` that ends at each row."""
    broken = F.max(F.when(F.col("_dir") != direction, F.col("_k"))).over(running)
    return F.col("_k") - F.coalesce(broken, F.lit(-1))


def block_features(bars: DataFrame, *, bar_seconds: int = 60, expected: int = 15, by: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """One row per complete block, stamped with the block's end (prediction time).

    A block holds at most ``expected`` bars of one series, so its window and its
    aggregate share one small shuffle group.  Needs ``volume`` and ``spread``.
    """
    span = bar_seconds * expected
    end = F.timestamp_seconds((F.floor(F.unix_timestamp(ts) / span) + 1) * span)
    keys = [*by, "prediction_ts"]
    w = Window.partitionBy(*keys).orderBy(ts)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    o, h, l, c, v, s = (F.col(x) for x in ("open", "high", "low", "close", "volume", "spread"))
    rows = bars.withColumn("prediction_ts", end).withColumns(
        {
            "_k": F.row_number().over(w) - 1,
            "_r": ratio(c, F.lag(c).over(w)) - 1.0,
            "_dir": F.signum(c - o),
            "_top": F.max(h).over(upto),
            "_bottom": F.min(l).over(upto),
        }
    )
    rows = rows.withColumns({"_r1": F.lag("_r").over(w), "_bull": _longest_run(1, upto), "_bear": _longest_run(-1, upto)})
    r, k = F.col("_r"), F.col("_k")
    both = F.col("_r1").isNotNull()

    def at(position: int) -> Column:
        return F.max(F.when(k == position, c))

    last, half = expected - 1, expected // 2
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.col(ts)).alias("_last_bar"),
        F.min_by("open", ts).alias("_o"),
        F.max_by("close", ts).alias("_c"),
        F.max(h).alias("_h"),
        F.min(l).alias("_l"),
        F.avg("_dir").alias("m1_direction_imbalance"),
        F.avg((F.col("_dir") > 0).cast("double")).alias("m1_bullish_fraction"),
        F.avg(r).alias("m1_return_mean"),
        F.stddev_pop(r).alias("m1_return_std"),
        F.skewness(r).alias("_skew"),
        F.count(r).alias("_nr"),
        F.sum((F.least(o, c) - l) - (h - F.greatest(o, c))).alias("_wick"),
        F.sqrt(F.sum(r * r)).alias("m1_realized_volatility"),
        F.max(F.when(F.col("_dir") == 1, F.col("_bull"))).alias("_max_bull"),
        F.max(F.when(F.col("_dir") == -1, F.col("_bear"))).alias("_max_bear"),
        at(last - 5).alias("_c5"),
        at(0).alias("_c0"),
        at(half - 1).alias("_ca"),
        at(half).alias("_cb"),
        F.avg((h == F.col("_top")).cast("double")).alias("m1_new_high_fraction"),
        F.avg((l == F.col("_bottom")).cast("double")).alias("m1_new_low_fraction"),
        F.regr_slope(c, k.cast("double")).alias("_slope"),
        F.corr(F.when(both, r), F.col("_r1")).alias("_ac"),
        F.var_pop(F.when(both, r)).alias("_v0"),
        F.var_pop("_r1").alias("_v1"),
        F.avg(v).alias("m1_tick_volume_mean"),
        F.sum(F.col("_dir") * v).alias("_sv"),
        F.sum(v).alias("_tv"),
        F.avg(s).alias("m1_spread_mean"),
        F.stddev_pop(s).alias("m1_spread_std"),
        F.max(s).alias("m1_spread_max"),
        F.max_by("spread", ts).alias("m1_spread_last"),
    ).where(F.col("_n") == expected)
    rng = F.col("_h") - F.col("_l")
    n = F.col("_nr")
    return agg.select(
        *keys,
        (F.col("_last_bar") + F.make_dt_interval(secs=F.lit(bar_seconds))).alias("maximum_source_ts"),
        F.col("_n").alias("source_rows"),
        rng.alias("_block_range"),
        (ratio(F.col("_c"), F.col("_o")) - 1.0).alias("m1_block_return"),
        "m1_direction_imbalance",
        "m1_bullish_fraction",
        "m1_return_mean",
        "m1_return_std",
        F.when(F.col("m1_return_std") > 0, F.col("_skew") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0).alias("m1_return_skew"),
        ratio_or_zero(F.col("_wick"), rng).alias("m1_wick_imbalance"),
        ratio_or_zero(2.0 * F.col("_c") - F.col("_h") - F.col("_l"), rng).alias("m1_range_position"),
        "m1_realized_volatility",
        F.coalesce("_max_bull", F.lit(0)).cast("double").alias("m1_max_bull_run"),
        F.coalesce("_max_bear", F.lit(0)).cast("double").alias("m1_max_bear_run"),
        (ratio(F.col("_c"), F.col("_c5")) - 1.0).alias("m1_momentum_5"),
        (ratio(F.col("_c"), F.col("_cb")) - ratio(F.col("_ca"), F.col("_c0"))).alias("m1_reversal_structure"),
        ratio_or_zero(F.col("_c") - F.col("_o"), rng).alias("m1_distance_from_open"),
        ratio_or_zero(F.col("_c") - F.col("_h"), rng).alias("m1_distance_from_high"),
        ratio_or_zero(F.col("_c") - F.col("_l"), rng).alias("m1_distance_from_low"),
        "m1_new_high_fraction",
        "m1_new_low_fraction",
        ratio_or_zero(F.col("_slope"), rng).alias("m1_trend_slope"),
        F.when((F.col("_v0") > 0) & (F.col("_v1") > 0), F.col("_ac")).otherwise(0.0).alias("m1_return_autocorrelation"),
        "m1_tick_volume_mean",
        ratio_or_zero(F.col("_sv"), F.col("_tv")).alias("m1_signed_tick_volume_imbalance"),
        "m1_spread_mean",
        "m1_spread_std",
        "m1_spread_max",
        "m1_spread_last",
    )


def micro_features(blocks: DataFrame, atr: DataFrame | None = None, *, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add the across-block features; ``atr`` is (keys, prediction_ts, atr)."""

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        vol, tv = F.col("m1_realized_volatility"), F.col("m1_tick_volume_mean")
        return df.withColumns(
            {
                "m1_range_expansion": ratio(vol, rolling(F.percentile(vol, 0.5), w, 20, seen=vol)),
                "m1_volatility_acceleration": ratio(vol, F.lag(vol, 4).over(w)),
                "m1_tick_volume_change": ratio(tv, F.lag(tv).over(w)) - 1.0,
                "m1_spread_change": F.col("m1_spread_last") - F.lag("m1_spread_last").over(w),
            }
        )

    out = over_series(blocks, build, by=by, ts="prediction_ts", back=20, rows=512)
    if atr is None:
        return out
    joined = out.join(atr, [*by, "prediction_ts"], "left")
    return joined.withColumn("m1_range_atr_ratio", ratio(F.col("_block_range"), F.col("atr"))).drop("_block_range", "atr")
