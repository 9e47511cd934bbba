"""The 42 look-back features of a bar table, in one blocked pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import scalar
from .series import BLOCK, HOME, INDEX, decay_reach, decayed_mean, over_series, rolling, running_sum

SMA_PERIODS = (10, 20, 50, 200)
EMA_SPANS = (12, 26)
MACD_SPANS = (12, 26, 9)
RSI_PERIOD = 14
ATR_PERIOD = 14
BAND_PERIOD = 20
BAND_WIDTH = 2.0
VOLUME_PERIOD = 20

# Feature names in contract order.
FEATURES = (
    ["returns", "returns_2", "returns_5", "returns_10", "log_returns", "high_low_ratio", "close_open_ratio"]
    + ["rsi", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_lower", "bb_width", "bb_pct"]
    + [f"sma_{n}" for n in SMA_PERIODS]
    + [f"ema_{n}" for n in EMA_SPANS]
    + [f"price_to_sma_{n}" for n in SMA_PERIODS]
    + ["atr", "atr_pct", "volatility_5", "volatility_20", "volume_sma", "volume_ratio", "obv"]
    + ["body_size", "upper_shadow", "lower_shadow", "day_of_week", "is_weekend", "hour_of_day", "is_market_open"]
    + ["is_asia_session", "is_london_session", "is_new_york_session"]
)
SESSION_FEATURES = FEATURES[-7:]
# Features that do not carry the price level.
NORMALIZED_FEATURES = [
    "returns", "returns_2", "returns_5", "returns_10", "log_returns", "high_low_ratio", "close_open_ratio", "rsi",
    "bb_width", "bb_pct", "price_to_sma_10", "price_to_sma_20", "price_to_sma_50", "price_to_sma_200", "atr_pct",
    "volatility_5", "volatility_20", "volume_ratio",
]
FAMILIES = ("returns", "rsi", "macd", "bands", "averages", "ema", "atr", "volatility", "volume", "candle", "clock")

#: Divides by prices: ``scalar.ratio`` (NULL over zero) or ``scalar.quotient`` (infinite or NaN).
Divide = Callable[[Column, Column], Column]

_SPANS = [2.0 / (n + 1) for n in (*EMA_SPANS, *MACD_SPANS)]
_ALPHAS = [*_SPANS, 1.0 / RSI_PERIOD, 1.0 / ATR_PERIOD]
#: Halo of the decayed means; the signal line is a decayed mean of another one.
EWM_BACK = max(decay_reach(a) for a in _ALPHAS) + decay_reach(2.0 / (MACD_SPANS[2] + 1))
EWM_ROWS = 2048


def feature_family(name: str) -> str:
    if name in SESSION_FEATURES:
        return "session_time"
    return "normalized_relative" if name in NORMALIZED_FEATURES else "price_level_or_scale_dependent"


def pct_change(x: Column, w: WindowSpec, n: int = 1, divide: Divide = scalar.ratio) -> Column:
    return divide(x, F.lag(x, n).over(w)) - 1.0


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def return_columns(w: WindowSpec, divide: Divide = scalar.ratio) -> dict[str, Column]:
    c = F.col("close")
    growth = divide(c, F.lag(c).over(w))
    return {
        "returns": pct_change(c, w, divide=divide),
        **{f"returns_{n}": pct_change(c, w, n, divide) for n in (2, 5, 10)},
        "log_returns": F.when(growth == 0, divide(F.lit(-1.0), growth)).otherwise(F.ln(growth)),
        **scalar.bar_ratios(divide),
    }


def _ewm(x: Column, alpha: float, w: WindowSpec, *, adjust: bool, min_periods: int = 0) -> Column:
    return decayed_mean(x, alpha, w, back=EWM_BACK, rows=EWM_ROWS, adjust=adjust, min_periods=min_periods)


def add_rsi(df: DataFrame, w: WindowSpec) -> DataFrame:
    """50 both in the warm-up and while the average loss is zero."""
    change = F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0))
    df = df.withColumn("_chg", change)
    gain = _ewm(F.greatest(F.col("_chg"), F.lit(0.0)), 1.0 / RSI_PERIOD, w, adjust=True, min_periods=RSI_PERIOD)
    loss = _ewm(F.greatest(-F.col("_chg"), F.lit(0.0)), 1.0 / RSI_PERIOD, w, adjust=True, min_periods=RSI_PERIOD)
    df = df.withColumns({"_gain": gain, "_loss": loss})
    rs = scalar.ratio(F.col("_gain"), F.col("_loss"))
    return df.withColumn("rsi", F.coalesce(100.0 - 100.0 / (1.0 + rs), F.lit(50.0))).drop("_chg", "_gain", "_loss")


def add_macd(df: DataFrame, w: WindowSpec) -> DataFrame:
    fast, slow, signal = (2.0 / (n + 1) for n in MACD_SPANS)
    c = F.col("close")
    df = df.withColumns({"_f": _ewm(c, fast, w, adjust=False), "_s": _ewm(c, slow, w, adjust=False)})
    df = df.withColumn("macd", F.col("_f") - F.col("_s")).drop("_f", "_s")
    df = df.withColumn("macd_signal", _ewm(F.col("macd"), signal, w, adjust=False))
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def band_columns(w: WindowSpec, divide: Divide = scalar.ratio) -> dict[str, Column]:
    c = F.col("close")
    mid = rolling(F.avg(c), w, BAND_PERIOD, seen=c)
    dev = rolling(F.stddev_samp(c), w, BAND_PERIOD, seen=c)
    upper, lower = mid + BAND_WIDTH * dev, mid - BAND_WIDTH * dev
    return {
        "bb_upper": upper,
        "bb_lower": lower,
        "bb_width": divide(upper - lower, mid),
        "bb_pct": scalar.ratio(c - lower, upper - lower),
    }


def add_averages(df: DataFrame, w: WindowSpec, periods: Sequence[int] = SMA_PERIODS, divide: Divide = scalar.ratio) -> DataFrame:
    """Moving averages as differences of one running sum per block.

    The cost per row does not depend on the period.  The running sum starts at
    the block's halo, so its magnitude (and rounding error) stays small.
    """
    c = F.col("close")
    df = df.withColumn("_run", F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = {n: F.col("_run") - F.coalesce(F.lag("_run", n).over(w), F.lit(0.0)) for n in periods}
    df = df.withColumns({f"sma_{n}": F.when(F.col(INDEX) >= n - 1, total[n] / n) for n in periods})
    return df.withColumns({f"price_to_sma_{n}": divide(c, F.col(f"sma_{n}")) for n in periods}).drop("_run")


def ema_columns(w: WindowSpec) -> dict[str, Column]:
    return {f"ema_{n}": _ewm(F.col("close"), 2.0 / (n + 1), w, adjust=False) for n in EMA_SPANS}


def add_atr(df: DataFrame, w: WindowSpec, divide: Divide = scalar.ratio) -> DataFrame:
    df = df.withColumn("_tr", true_range(w))
    atr = _ewm(F.col("_tr"), 1.0 / ATR_PERIOD, w, adjust=True, min_periods=ATR_PERIOD)
    return df.withColumn("atr", atr).withColumn("atr_pct", divide(F.col("atr"), F.col("close"))).drop("_tr")


def add_volatility(df: DataFrame, w: WindowSpec, divide: Divide = scalar.ratio) -> DataFrame:
    df = df.withColumn("_r", pct_change(F.col("close"), w, divide=divide))
    r = F.col("_r")
    return df.withColumns({f"volatility_{n}": rolling(F.stddev_samp(r), w, n, seen=r) for n in (5, 20)}).drop("_r")


def volume_columns(w: WindowSpec) -> dict[str, Column]:
    v = F.col("volume")
    sma = rolling(F.avg(v), w, VOLUME_PERIOD, seen=v)
    return {"volume_sma": sma, "volume_ratio": scalar.ratio(v, sma)}


def signed_volume(w: WindowSpec) -> Column:
    step = F.signum(F.col("close") - F.lag("close").over(w)) * F.col("volume")
    return F.when(F.col(HOME), F.coalesce(step, F.lit(0.0)))


def price_features(
    bars: DataFrame,
    *,
    by: Sequence[str] = ("symbol",),
    ts: str = "ts",
    families: Sequence[str] = FAMILIES,
    rows: int = EWM_ROWS,
    ahead: int = 0,
    extra=None,
    divide: Divide = scalar.ratio,
) -> DataFrame:
    """Add the requested feature families to a bar table.

    ``extra(frame, window)`` may add further columns in the same pass, with
    frames reaching at most ``ahead`` rows forward.  ``divide`` says what
    ratios to a price of zero are.
    """
    decayed = {"rsi", "macd", "ema", "atr"} & set(families)
    back = EWM_BACK if decayed else max(SMA_PERIODS)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        if "returns" in families:
            df = df.withColumns(return_columns(w, divide))
        if "rsi" in families:
            df = add_rsi(df, w)
        if "macd" in families:
            df = add_macd(df, w)
        if "bands" in families:
            df = df.withColumns(band_columns(w, divide))
        if "averages" in families:
            df = add_averages(df, w, divide=divide)
        if "ema" in families:
            df = df.withColumns(ema_columns(w))
        if "atr" in families:
            df = add_atr(df, w, divide)
        if "volatility" in families:
            df = add_volatility(df, w, divide)
        if "volume" in families:
            df = df.withColumns({**volume_columns(w), "_signed": signed_volume(w)})
        if "candle" in families:
            df = df.withColumns(scalar.candle_anatomy(divide))
        if "clock" in families:
            df = df.withColumns(scalar.clock_features(ts))
        return extra(df, w) if extra else df

    out = over_series(bars, build, by=by, ts=ts, back=back, ahead=ahead, rows=rows, keep_blocks=True).drop(HOME)
    if "volume" not in families:
        return out.drop(BLOCK)
    return running_sum(out, {"obv": "_signed"}, by=by).drop("_signed")


def complete_rows(df: DataFrame, features: Sequence[str] = tuple(FEATURES), target: str | None = "target") -> DataFrame:
    """Keep rows whose features (and label, if any) are all present."""
    needed = [c for c in features if c in df.columns] + ([target] if target else [])
    return df.na.drop(subset=needed)
