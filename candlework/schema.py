"""Column contracts of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

BAR = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
MICRO_BAR = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "tick_volume", "spread", "real_volume")],
    ]
)
OBSERVATION = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("dataset_version", T.StringType()),
        T.StructField("instrument_or_event_id", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("source_time_utc", T.TimestampType()),
        T.StructField("available_time_utc", T.TimestampType()),
        T.StructField("received_time_utc", T.TimestampType()),
        T.StructField("revision_id", T.StringType()),
        T.StructField("quality_flags", T.StringType()),
        T.StructField("raw_batch_sha256", T.StringType()),
    ]
)
SIDECAR = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("schema_version", "source", "symbol", "timeframe", "requested_start", "requested_end", "actual_start", "actual_end", "actual_first_timestamp", "actual_last_timestamp", "retrieved_at_utc")],
        *[T.StructField(c, T.LongType()) for c in ("row_count", "chunk_count", "duplicate_count")],
        T.StructField("from_cache", T.BooleanType()),
        T.StructField("fallback_used", T.BooleanType()),
    ]
)
# Keys every sidecar must carry.
SIDECAR_REQUIRED = [
    "source", "symbol", "timeframe", "requested_start", "requested_end", "actual_start", "actual_end", "actual_first_timestamp",
    "actual_last_timestamp", "row_count", "chunk_count", "duplicate_count", "retrieved_at_utc", "from_cache", "fallback_used",
]
# Name fragments a feature must not contain, and bar interval lengths in seconds.
FORBIDDEN_NAME_PARTS = ("target", "future", "label", "outcome", "lead")
INTERVAL_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400}
