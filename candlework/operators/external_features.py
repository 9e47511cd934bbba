"""Features of published observations: rates, volatility indices, markets, calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalar import cash_session
from .asof import Source, asof_join, asof_many
from .price_features import pct_change
from .series import over_series, rolling


#: Of several rows of an instrument published at one moment, the latest revision counts, then that of the latest source time.
PUBLISHED = ("revision_id", "source_time_utc")


def widen(observations: DataFrame, *, column: str, values: Sequence[str], time: str = "available_time_utc", value: str = "value", order: Sequence[str] = PUBLISHED) -> DataFrame:
    """One row per publication time, one column per instrument or field; all revisions take part."""
    return observations.groupBy(time).pivot(column, list(values)).agg(F.max_by(value, F.struct(*order)))


def _single(wide: DataFrame) -> DataFrame:
    return wide.withColumn("_one", F.lit(0))


def diff(x: str, w: WindowSpec) -> Column:
    return F.col(x) - F.lag(x).over(w)


def rates_features(wide: DataFrame, *, levels: Sequence[str], spreads: dict[str, tuple[str, str]], volatility_of: str, time: str = "available_time_utc") -> DataFrame:
    """Levels, daily changes, curve spreads and the 20-row deviation of changes."""

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumns({f"{x}_daily_change": diff(x, w) for x in levels})
        change = F.col(f"{volatility_of}_daily_change")
        return df.withColumns(
            {
                **{f"{x}_level": F.col(x) for x in levels},
                **{name: F.col(a) - F.col(b) for name, (a, b) in spreads.items()},
                f"{volatility_of}_change_volatility_20d": rolling(F.stddev_samp(change), w, 20, seen=change),
            }
        )

    out = over_series(_single(wide), build, by=("_one",), ts=time, back=21, rows=512, cell_seconds=30 * 86400)
    return out.select(
        time,
        *[f"{x}_{k}" for x in levels for k in ("level", "daily_change")],
        *spreads,
        f"{volatility_of}_change_volatility_20d",
    )


def rolling_percentile_rank(x: Column, w: WindowSpec, n: int, min_periods: int) -> Column:
    """Average rank of the current value inside its window, as a share."""
    frame = F.collect_list(x).over(w.rowsBetween(-(n - 1), 0))
    below = F.size(F.filter(frame, lambda v: v < x))
    equal = F.size(F.filter(frame, lambda v: v == x))
    return F.when(x.isNotNull() & (F.size(frame) >= min_periods), (below + (equal + 1) / 2.0) / F.size(frame))


def volatility_features(wide: DataFrame, *, index: str, terms: Sequence[str], extra: Sequence[str] = (), time: str = "available_time_utc") -> DataFrame:
    """Level, change, yearly percentile rank, high regime, term spreads, other levels."""
    x = F.col(index)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        usual = rolling(F.percentile(x, 0.5), w, 60, seen=x, min_periods=20)
        return df.withColumns(
            {
                f"{index}_level": x,
                f"{index}_daily_change": diff(index, w),
                f"{index}_percentile_252d": rolling_percentile_rank(x, w, 252, 60),
                f"{index}_high_regime": F.coalesce((x > usual).cast("double"), F.lit(0.0)),
                **{f"{t}_minus_{index}": F.col(t) - x for t in terms},
                **{f"{e}_level": F.col(e) for e in extra},
            }
        )

    out = over_series(_single(wide), build, by=("_one",), ts=time, back=252, rows=1024, cell_seconds=30 * 86400)
    names = [f"{index}_level", f"{index}_daily_change", f"{index}_percentile_252d", f"{index}_high_regime"]
    return out.select(time, *names, *[f"{t}_minus_{index}" for t in terms], *[f"{e}_level" for e in extra])


def instrument_moves(observations: DataFrame, *, by: Sequence[str] = ("instrument_or_event_id",), time: str = "available_time_utc") -> DataFrame:
    """Return over 1 and 4 rows and 16-row return deviation of every instrument, over the values as they were published."""
    published = observations.groupBy(*by, time).agg(F.max_by("value", F.struct(*PUBLISHED)).alias("value"))

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        v = F.col("value")
        df = df.withColumn("return_1", pct_change(v, w))
        r = F.col("return_1")
        return df.withColumns({"return_4": pct_change(v, w, 4), "volatility_16": rolling(F.stddev_samp(r), w, 16, seen=r)})

    out = over_series(published, build, by=by, ts=time, back=17)
    return out.select(*by, time, "return_1", "return_4", "volatility_16")


def market_context(predictions: DataFrame, moves: DataFrame, instruments: dict[str, str], *, left_time: str, max_age_seconds: int = 4 * 3600, key: str = "instrument_or_event_id", time: str = "available_time_utc") -> DataFrame:
    """Newest moves of several instruments at each prediction time, side by side.

    ``instruments`` maps an instrument to the prefix of its columns.  All of
    them are matched in a single as-of pass that reads the moves once.
    """
    sources = [
        Source(
            moves, time, max_age_seconds, prefix=f"market_{short}_", source_time=f"market_{short}_source_ts", age=f"market_{short}_age_seconds",
            only=F.col(key) == name, without=(key,),
        )
        for name, short in instruments.items()
    ]
    return asof_many(predictions, sources, left_time=left_time, strict=True)


CALENDAR_FLAGS = [
    "holiday", "early_close", "day_before_holiday", "first_trading_day", "last_trading_day", "month_end", "quarter_end", "year_end",
]


def calendar_context(predictions: DataFrame, calendar: DataFrame, *, left_time: str, day: str = "day") -> DataFrame:
    """Calendar flags of the day (usable for one day) and the cash-session clock."""
    flags = calendar.select(F.col(day).cast("timestamp").alias(day), *[F.col(c).cast("int").alias(f"calendar_{c}") for c in CALENDAR_FLAGS])
    joined = asof_join(predictions, flags, left_time=left_time, right_time=day, max_age_seconds=86400)
    clock = cash_session(left_time, F.col("calendar_early_close"))
    return joined.withColumns({f"calendar_{k}": v for k, v in clock.items()})
