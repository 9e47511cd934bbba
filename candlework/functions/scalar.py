"""Row-wise expressions: safe division, candle shape, clock features, signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"

# UTC session bounds, hours inclusive.
SESSIONS = {"asia": (0, 7), "london": (8, 15), "new_york": (13, 20)}


def number(x: Column) -> Column:
    """Treat NaN as missing, the way the rest of the library expects it."""
    return F.when(~F.isnan(x), x)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL when the denominator is zero."""
    return num / F.nullif(den, F.lit(0.0))


def quotient(num: Column, den: Column) -> Column:
    """``num / den`` in floating point: over zero it is infinite, or NaN for 0 / 0."""
    return F.when(den == 0, num * F.lit(float("inf"))).otherwise(ratio(num, den))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NaN where a side does not vary (Spark's ``corr`` ends with an error there)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(ratio(F.covar_pop(a, b), spread))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def centred_location(num: Column, den: Column) -> Column:
    """Position inside a range scaled to [-1, 1]; 0 when it is undefined."""
    return F.coalesce(2.0 * ratio(num, den) - 1.0, F.lit(0.0))


def bar_ratios(divide: Callable[[Column, Column], Column] = ratio) -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {"high_low_ratio": divide(h - l, c), "close_open_ratio": divide(c - o, o)}


def candle_anatomy(divide: Callable[[Column, Column], Column] = ratio) -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "body_size": divide(F.abs(c - o), o),
        "upper_shadow": divide(h - F.greatest(c, o), o),
        "lower_shadow": divide(F.least(c, o) - l, o),
    }


def candle_asymmetry() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "candle_close_location": centred_location(c - l, h - l),
        "signed_body_range": ratio_or_zero(c - o, h - l),
    }


def clock_features(ts: str = "ts") -> dict[str, Column]:
    """Weekday (Monday 0), hour and session flags of a UTC bar time."""
    day = F.weekday(F.col(ts))
    hour = F.hour(F.col(ts))
    flags = {f"is_{name}_session": hour.between(lo, hi).cast("int") for name, (lo, hi) in SESSIONS.items()}
    return {
        "day_of_week": day,
        "is_weekend": (day >= 5).cast("int"),
        "hour_of_day": hour,
        "is_market_open": F.lit(1),
        **flags,
    }


def cash_session(ts: str, early_close: Column) -> dict[str, Column]:
    """New York cash session flag and minutes to its close (13:00 on short days)."""
    local = F.from_utc_timestamp(F.col(ts), NEW_YORK)
    minute = F.hour(local) * 60 + F.minute(local)
    close = F.when(F.coalesce(early_close, F.lit(0)) == 1, F.lit(13 * 60)).otherwise(F.lit(16 * 60))
    return {
        "cash_session_exact": ((minute >= 9 * 60 + 30) & (minute < close)).cast("double"),
        "minutes_to_cash_close": (close - minute).cast("long"),
    }


def reconstruct_ohlc(shadow_scale: str = "open") -> dict[str, Column]:
    """Prices rebuilt from features.

    Shadows are stored as a share of the open.  ``open`` scales them back,
    ``raw`` adds them as they are (the form some recorded studies used).
    """
    close = ratio(F.col("atr"), F.col("atr_pct"))
    opened = ratio(close, 1.0 + F.col("close_open_ratio"))
    scale = opened if shadow_scale == "open" else F.lit(1.0)
    return {
        "open": opened,
        "high": F.greatest(opened, close) + F.col("upper_shadow") * scale,
        "low": F.least(opened, close) - F.col("lower_shadow") * scale,
        "close": close,
    }


def decide_signal(buy: Column, sell: Column, buy_threshold: float, sell_threshold: float) -> Column:
    """1 buy, -1 sell, 0 none; when both qualify the larger wins and ties buy."""
    can_buy, can_sell = buy >= buy_threshold, sell >= sell_threshold
    return (
        F.when(can_buy & can_sell, F.when(buy >= sell, 1).otherwise(-1))
        .when(can_buy, 1)
        .when(can_sell, -1)
        .otherwise(0)
    )


def threshold_signal(score: Column, threshold: float) -> Column:
    """1 where a single score reaches the threshold, else 0 (also without a score)."""
    return F.coalesce((score >= threshold).cast("int"), F.lit(0))


def signal_probability(signal: Column, buy: Column, sell: Column, none: Column) -> Column:
    return F.when(signal == 1, buy).when(signal == -1, sell).otherwise(none)


def direction_score(buy: Column, sell: Column) -> Column:
    return buy / F.greatest(buy + sell, F.lit(1e-12))


def activity_score(buy: Column, sell: Column) -> Column:
    return buy + sell


def asymmetric_labels(target: str = "target") -> dict[str, Column]:
    return {
        "buy_success": (F.col(target) == 1).cast("int"),
        "sell_success": (F.col(target) == 0).cast("int"),
    }
