"""Forward-looking labels over a bounded number of bars.

Paths are read with ``lead`` inside halo blocks; a row never sees more than
the stated horizon and rows without enough future are NULL or INCOMPLETE.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .series import over_series

# Class codes.
SELL, BUY, NO_TRADE, TIE, INCOMPLETE = 0, 1, 2, 3, 4
CLASS_NAMES = {0: "SELL", 1: "BUY", 2: "NO_TRADE", 3: "SAME_BAR_TIE", 4: "INCOMPLETE"}
TP_FIRST = ("tp_first", "take_profit_first")
SL_FIRST = ("sl_first", "conservative_sl", "stop_loss_first")


def class_name(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in CLASS_NAMES.items():
        out = F.when(c == code, name).otherwise(out)
    return out


def first_offset(hit, w: WindowSpec, horizon: int) -> Column:
    """Smallest k in 1..horizon for which ``hit(high, low)`` holds k bars ahead."""
    return F.coalesce(
        *[F.when(hit(F.lead("high", k).over(w), F.lead("low", k).over(w)), F.lit(k)) for k in range(1, horizon + 1)]
    )


def barrier_offsets(w: WindowSpec, upper: Column, lower: Column, horizon: int) -> dict[str, Column]:
    """First bar touching the upper and the lower level, separately."""
    return {
        "first_upper": first_offset(lambda hi, lo: hi >= upper, w, horizon),
        "first_lower": first_offset(lambda hi, lo: lo <= lower, w, horizon),
    }


def resolve_touch(up: Column, down: Column, on_up, on_down, on_both, unresolved) -> Column:
    """Outcome of two touch offsets; NULL offsets mean never touched."""
    far = F.lit(1 << 30)
    u, d = F.coalesce(up, far), F.coalesce(down, far)
    return (
        F.when((u == far) & (d == far), unresolved)
        .when(u == d, on_both)
        .when(u < d, on_up)
        .otherwise(on_down)
    )


def _same_bar(rule: str) -> Column:
    if rule in TP_FIRST:
        return F.lit(1)
    if rule in SL_FIRST:
        return F.lit(0)
    if rule == "drop":
        return F.lit(None).cast("int")
    raise ValueError(f"Unsupported same_bar_rule: {rule}")


def _unresolved(policy: str) -> Column:
    if policy not in ("drop", "sl", "tp"):
        raise ValueError(f"Unsupported unresolved_policy: {policy}")
    return F.lit({"drop": None, "sl": 0, "tp": 1}[policy]).cast("int")


def take_profit_label(
    bars: DataFrame,
    *,
    tp: str | Column,
    sl: str | Column,
    max_bars: int = 40,
    same_bar_rule: str = "conservative_sl",
    unresolved_policy: str = "drop",
    by: Sequence[str] = ("symbol",),
    ts: str = "ts",
) -> DataFrame:
    """1 when the take-profit price is touched before the stop, 0 for the reverse.

    ``tp`` and ``sl`` are price distances from the close.
    """
    tp, sl = (F.col(x) if isinstance(x, str) else x for x in (tp, sl))
    both, none = _same_bar(same_bar_rule), _unresolved(unresolved_policy)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumns(barrier_offsets(w, F.col("close") + tp, F.col("close") - sl, max_bars))
        label = resolve_touch(F.col("first_upper"), F.col("first_lower"), F.lit(1), F.lit(0), both, none)
        return df.withColumn("target", label.cast("int"))

    return over_series(bars, build, by=by, ts=ts, ahead=max_bars)


def directional_label(
    bars: DataFrame,
    *,
    tp: str | Column,
    sl: str | Column,
    max_bars: int = 40,
    same_bar_rule: str = "conservative_sl",
    unresolved_policy: str = "drop",
    legacy_short: bool = False,
    by: Sequence[str] = ("symbol",),
    ts: str = "ts",
) -> DataFrame:
    """Three classes from a long and a short trade, then from the last close.

    ``legacy_short`` tests the short side with the long side's comparisons, as
    some recorded label sets did.
    """
    tp, sl = (F.col(x) if isinstance(x, str) else x for x in (tp, sl))
    both, none = _same_bar(same_bar_rule), _unresolved(unresolved_policy)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        c = F.col("close")
        levels = {f"long_{k}": v for k, v in barrier_offsets(w, c + tp, c - sl, max_bars).items()}
        if legacy_short:
            levels["short_win"] = first_offset(lambda hi, lo: hi >= c - tp, w, max_bars)
            levels["short_loss"] = first_offset(lambda hi, lo: lo <= c + sl, w, max_bars)
        else:
            levels["short_win"] = first_offset(lambda hi, lo: lo <= c - tp, w, max_bars)
            levels["short_loss"] = first_offset(lambda hi, lo: hi >= c + sl, w, max_bars)
        levels["last_close"] = F.last("close").over(w.rowsBetween(1, max_bars))
        df = df.withColumns(levels)
        long_side = resolve_touch(F.col("long_first_upper"), F.col("long_first_lower"), F.lit(1), F.lit(0), both, none)
        short_side = resolve_touch(F.col("short_win"), F.col("short_loss"), F.lit(1), F.lit(0), both, none)
        last = F.col("last_close")
        move = ratio(last, c) - 1.0
        fallback = (
            F.when(last.isNull(), NO_TRADE)
            .when(last >= c + tp, BUY)
            .when(last <= c - sl, SELL)
            .when(move > 0, BUY)
            .when(move < 0, SELL)
            .otherwise(NO_TRADE)
        )
        label = F.when((long_side == 1) & (short_side == 0), BUY).when((long_side == 0) & (short_side == 1), SELL).otherwise(fallback)
        return df.withColumn("target", label.cast("int")).drop(*levels)

    return over_series(bars, build, by=by, ts=ts, ahead=max_bars)


def forward_atr_column(w: WindowSpec, horizon: int = 5, multiplier: float = 1.0, *, atr_pct: str = "atr_pct") -> Column:
    """Sign of the forward close return beyond a volatility threshold."""
    ahead = F.lead("close", horizon).over(w)
    move = ratio(ahead, F.col("close")) - 1.0
    limit = F.abs(F.coalesce(F.col(atr_pct), F.lit(0.0)) * multiplier)
    return (
        F.when(F.col("close") == 0, NO_TRADE)
        .when(ahead.isNull(), F.lit(None))
        .when(move > limit, BUY)
        .when(move < -limit, SELL)
        .otherwise(NO_TRADE)
        .cast("int")
    )


def forward_atr_label(bars: DataFrame, *, horizon: int = 5, multiplier: float = 1.0, by: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    return over_series(
        bars, lambda df, w: df.withColumn("target", forward_atr_column(w, horizon, multiplier)), by=by, ts=ts, ahead=horizon
    )


def first_passage_columns(w: WindowSpec, horizon: int, multiplier: float = 1.0, *, atr: str = "atr", suffix: str = "") -> dict[str, Column]:
    c, reach = F.col("close"), F.col(atr) * multiplier
    up = first_offset(lambda hi, lo: hi >= c + reach, w, horizon)
    down = first_offset(lambda hi, lo: lo <= c - reach, w, horizon)
    complete = F.lead("close", horizon).over(w).isNotNull()
    label = resolve_touch(up, down, F.lit(BUY), F.lit(SELL), F.lit(TIE), F.lit(NO_TRADE))
    return {
        f"first_passage_target{suffix}": F.when(complete, label).otherwise(INCOMPLETE).cast("int"),
        f"first_hit_bar{suffix}": F.when(complete, F.least(up, down)),
    }


def first_passage_label(
    bars: DataFrame, *, horizon: int = 5, multiplier: float = 1.0, atr: str = "atr", by: Sequence[str] = ("symbol",), ts: str = "ts"
) -> DataFrame:
    """Which of close ± multiplier·ATR is touched first within ``horizon`` bars."""

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns(
            {
                **first_passage_columns(w, horizon, multiplier, atr=atr),
                "upper_barrier": F.col("close") + F.col(atr) * multiplier,
                "lower_barrier": F.col("close") - F.col(atr) * multiplier,
            }
        )

    return over_series(bars, build, by=by, ts=ts, ahead=horizon)


def multi_horizon_labels(
    bars: DataFrame, *, horizons: Sequence[int] = (1, 2, 3, 4, 5, 8), multiplier: float = 1.0, atr: str = "atr", by: Sequence[str] = ("symbol",), ts: str = "ts"
) -> DataFrame:
    """First-passage labels for several horizons from one read of the path."""

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        c, reach, longest = F.col("close"), F.col(atr) * multiplier, max(horizons)
        df = df.withColumns(
            {
                "_up": first_offset(lambda hi, lo: hi >= c + reach, w, longest),
                "_down": first_offset(lambda hi, lo: lo <= c - reach, w, longest),
                **{f"_end_{h}": F.lead("close", h).over(w) for h in horizons},
            }
        )
        made = {}
        for h in horizons:
            up, down = (F.when(F.col(x) <= h, F.col(x)) for x in ("_up", "_down"))
            complete = F.col(f"_end_{h}").isNotNull()
            label = resolve_touch(up, down, F.lit(BUY), F.lit(SELL), F.lit(TIE), F.lit(NO_TRADE))
            made[f"first_passage_target_{h}"] = F.when(complete, label).otherwise(INCOMPLETE).cast("int")
            made[f"first_hit_bar_{h}"] = F.when(complete, F.least(up, down))
        return df.withColumns(made).drop("_up", "_down", *[f"_end_{h}" for h in horizons])

    return over_series(bars, build, by=by, ts=ts, ahead=max(horizons))


def first_passage_by_range(indexed: DataFrame, *, horizon: int = 5, multiplier: float = 1.0, atr: str = "atr", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Second formulation of the first-passage label, used as a cross-check.

    Every row is sent to the ``horizon`` rows that look at it, so the join is an
    equi-join on position and its size is horizon times the table.
    """
    keys = list(by)
    reach = F.col(atr) * multiplier
    future = indexed.select(*keys, F.col("high").alias("f_high"), F.col("low").alias("f_low"), F.col("bar_index").alias("_at"))
    looks = future.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("bar_index", F.col("_at") - F.col("offset"))
    base = indexed.select(*keys, "bar_index", (F.col("close") + reach).alias("up"), (F.col("close") - reach).alias("down"))
    return (
        base.join(looks, [*keys, "bar_index"], "left")
        .groupBy(*keys, "bar_index")
        .agg(
            F.count("offset").alias("seen"),
            F.min(F.when(F.col("f_high") >= F.col("up"), F.col("offset"))).alias("fu"),
            F.min(F.when(F.col("f_low") <= F.col("down"), F.col("offset"))).alias("fd"),
        )
        .select(
            *keys,
            "bar_index",
            F.when(F.col("seen") < horizon, INCOMPLETE)
            .otherwise(resolve_touch(F.col("fu"), F.col("fd"), F.lit(BUY), F.lit(SELL), F.lit(TIE), F.lit(NO_TRADE)))
            .cast("int")
            .alias("reconstructed"),
        )
    )


def rule_outcomes(
    bars: DataFrame,
    *,
    direction: str = "direction",
    horizon: int = 5,
    atr: str = "atr",
    by: Sequence[str] = ("symbol",),
    ts: str = "ts",
    divide: Callable[[Column, Column], Column] = ratio,
) -> DataFrame:
    """What happened in the ``horizon`` bars after a decided direction.

    Rows without a direction of ±1 or without the full horizon are left out.  ``divide`` says what a return on a close
    of zero is.
    """

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        c, a, d = F.col("close"), F.col(atr), F.col(direction)
        path = w.rowsBetween(1, horizon)
        long = d > 0
        up = first_offset(lambda hi, lo: hi >= c + a, w, horizon)
        down = first_offset(lambda hi, lo: lo <= c - a, w, horizon)
        df = df.withColumns(
            {
                "_up": up,
                "_down": down,
                "_hi": F.max("high").over(path),
                "_lo": F.min("low").over(path),
                "_end": F.lead("close", horizon).over(w),
                "maximum_outcome_ts": F.lead(ts, horizon).over(w),
            }
        )
        good = F.when(long, F.col("_up")).otherwise(F.col("_down"))
        poor = F.when(long, F.col("_down")).otherwise(F.col("_up"))
        return df.withColumns(
            {
                "terminal_return": divide(d * (F.col("_end") - c), c),
                "mfe": divide(F.when(long, F.col("_hi") - c).otherwise(c - F.col("_lo")), c),
                "mae": divide(F.when(long, F.col("_lo") - c).otherwise(c - F.col("_hi")), c),
                "reached_plus_1atr": good.isNotNull(),
                "reached_minus_1atr": poor.isNotNull(),
                "first_passage": resolve_touch(
                    good, poor, F.lit("FAVORABLE"), F.lit("ADVERSE"), F.lit("SAME_BAR_TIE"), F.lit("UNRESOLVED")
                ),
            }
        ).where(F.col("_end").isNotNull() & d.isin(-1, 1)).drop("_up", "_down", "_hi", "_lo", "_end")

    return over_series(bars, build, by=by, ts=ts, ahead=horizon)


def boundary_columns(multiplier: float = 1.0, divide: Callable[[Column, Column], Column] = ratio) -> dict[str, Column]:
    """Distance of a realised forward move from the label threshold.

    Needs ``forward_return``, ``atr`` and ``atr_pct``.
    """
    move, rel = F.col("forward_return"), F.abs(F.col("atr_pct"))
    in_atr = divide(move, rel)
    limit = rel * multiplier
    return {
        "threshold_return": limit,
        "forward_move_atr": in_atr,
        "absolute_move_atr": F.abs(in_atr),
        "boundary_distance_atr": F.abs(F.abs(in_atr) - multiplier),
        "threshold_price_points": F.abs(F.col("atr")) * multiplier,
        "forward_move_price_points": divide(move * F.col("atr"), F.col("atr_pct")),
        "reconstructed_target": F.when(move > limit, BUY).when(move < -limit, SELL).otherwise(NO_TRADE).cast("int"),
    }


# Resolution-time bins, upper bound in bars and name.
RESOLUTION_BINS = [(1, "1_bar"), (2, "2_bars"), (3, "3_bars"), (5, "4_5_bars"), (10, "6_10_bars"), (20, "11_20_bars"), (40, "21_40_bars")]


def resolution_bin(up: Column, down: Column) -> Column:
    """Bin of the first touch; ``both`` when one bar touches the two levels."""
    first = F.least(up, down)
    out = F.lit("over_40_bars")
    for bound, name in reversed(RESOLUTION_BINS):
        out = F.when(first <= bound, name).otherwise(out)
    return F.when(first.isNull(), "unresolved").when(up == down, "both").otherwise(out)


def resolution_times(touched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count and share per resolution bin from ``first_upper``/``first_lower``."""
    binned = touched.groupBy(*keys, resolution_bin(F.col("first_upper"), F.col("first_lower")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce("first_upper", F.lit(99999)) < F.coalesce("first_lower", F.lit(99999))).alias("tp_first"),
        F.count_if(F.coalesce("first_upper", F.lit(99999)) > F.coalesce("first_lower", F.lit(99999))).alias("sl_first"),
    )
    return binned.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
