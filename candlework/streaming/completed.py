"""Completed-bar resampling of a stream: the same operator, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completed_bars_stream(bars: DataFrame, *, width: str, expected: int, delay: str, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """Wider bars emitted once (append mode) when the watermark passes their end.

    State is one row per open (series, window).  Bars with fewer than
    ``expected`` parts are dropped, as in the batch form.
    """
    return (
        bars.withWatermark(ts, delay)
        .groupBy(by, F.window(ts, width).alias("_w"))
        .agg(
            F.min_by("open", ts).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", ts).alias("close"),
            F.count(F.lit(1)).alias("_n"),
        )
        .where(F.col("_n") == expected)
        .select(by, F.col("_w.end").alias(ts), "open", "high", "low", "close")
    )
