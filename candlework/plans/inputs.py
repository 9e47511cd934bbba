"""Bars, observations and score tables read from the analytics tables.

Each builder has the same definition in SQL next to it, so every query and its
SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, times as UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def bars(spark: SparkSession, sf_dir: str, minutes: int = 15, *, per_type: bool = True) -> DataFrame:
    """Price bars from events; one series per event type or a single series."""
    events = table(spark, sf_dir, "events").withColumn("symbol", F.col("event_type") if per_type else F.lit("ALL"))
    order = F.struct("ts", "event_id")
    width = f"{minutes} minutes"
    return (
        events.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
            F.avg("user_id").alias("spread"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "spread")
    )


def bars_sql(minutes: int = 15, *, per_type: bool = True, name: str = "bars") -> str:
    symbol = "event_type" if per_type else "'ALL'"
    start = f"make_timestamp(CAST(floor(epoch(ts) / {minutes * 60}) * {minutes * 60} * 1000000 AS BIGINT))"
    return f"""{name} AS (
      SELECT {symbol} AS symbol, {start} AS ts,
             first(value ORDER BY events.ts, event_id) AS open, max(value) AS high, min(value) AS low,
             last(value ORDER BY events.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume,
             avg(user_id) AS spread
      FROM events GROUP BY 1, 2)"""


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals, one series per order priority."""
    orders = table(spark, sf_dir, "orders")
    key = F.struct("o_orderdate", "o_orderkey")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.date_trunc("day", "o_orderdate").alias("ts")).agg(
        F.min_by("o_totalprice", key).alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", key).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


DAILY_SQL = """daily AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts,
         first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long point-in-time observations: daily average order price per priority.

    Every seventh day is published a second time ten days later, as a revision.
    """
    daily = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("instrument_or_event_id"), F.date_trunc("day", "o_orderdate").alias("source_time_utc"))
        .agg(F.avg("o_totalprice").alias("value"))
    )
    day = F.datediff("source_time_utc", F.lit("1970-01-01"))
    published = F.array(
        F.struct(F.lit("initial").alias("revision_id"), F.lit(0).alias("late"), F.lit(1.0).alias("scale")),
        F.struct(F.lit("revision_1").alias("revision_id"), F.lit(10).alias("late"), F.lit(1.0123457).alias("scale")),
    )
    chosen = F.when(day % 7 == 0, published).otherwise(F.slice(published, 1, 1))
    return daily.withColumn("p", F.explode(chosen)).select(
        F.lit("orders").alias("source"),
        F.lit("v1").alias("dataset_version"),
        "instrument_or_event_id",
        F.lit("avg_price").alias("field"),
        (F.col("value") * F.col("p.scale")).alias("value"),
        "source_time_utc",
        (F.col("source_time_utc") + F.make_dt_interval(days=F.col("p.late"), hours=F.lit(18))).alias("available_time_utc"),
        (F.col("source_time_utc") + F.make_dt_interval(days=F.col("p.late"), hours=F.lit(18))).alias("received_time_utc"),
        F.col("p.revision_id").alias("revision_id"),
        F.lit("ok").alias("quality_flags"),
        F.sha2(F.concat_ws("|", F.col("instrument_or_event_id"), F.date_format("source_time_utc", "yyyy-MM-dd")), 256).alias("raw_batch_sha256"),
    )


OBSERVATIONS_SQL = """obs_base AS (
  SELECT o_orderpriority AS instrument_or_event_id, date_trunc('day', o_orderdate) AS source_time_utc,
         avg(o_totalprice) AS value FROM orders GROUP BY 1, 2),
observations AS (
  SELECT instrument_or_event_id, 'avg_price' AS field, source_time_utc, value, 'initial' AS revision_id,
         source_time_utc + INTERVAL 18 HOUR AS available_time_utc FROM obs_base
  UNION ALL
  SELECT instrument_or_event_id, 'avg_price', source_time_utc, value * CAST(1.0123457 AS DOUBLE), 'revision_1',
         source_time_utc + INTERVAL 10 DAY + INTERVAL 18 HOUR FROM obs_base
  WHERE date_diff('day', DATE '1970-01-01', CAST(source_time_utc AS DATE)) % 7 = 0)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row table with an actual class, a predicted class and class scores."""
    li = table(spark, sf_dir, "lineitem")
    actual = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        actual.alias("target"),
        (F.col("l_partkey") % 3).cast("int").alias("predicted"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 101).cast("double").alias("_a"),
        ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 97).cast("double").alias("_b"),
        ((F.col("l_suppkey") * 5 + F.col("l_orderkey")) % 89).cast("double").alias("_c"),
    ).select(
        "l_orderkey", "l_linenumber", "ts", "quantity", "extendedprice", "discount", "tax", "target", "predicted",
        ((F.col("_a") + 1) / (F.col("_a") + F.col("_b") + F.col("_c") + 3)).alias("sell_proba"),
        ((F.col("_b") + 1) / (F.col("_a") + F.col("_b") + F.col("_c") + 3)).alias("buy_proba"),
        ((F.col("_c") + 1) / (F.col("_a") + F.col("_b") + F.col("_c") + 3)).alias("no_trade_proba"),
    )


SCORED_SQL = """scored_base AS (
  SELECT l_orderkey, l_linenumber, l_shipdate AS ts, l_quantity AS quantity, l_extendedprice AS extendedprice,
         l_discount AS discount, l_tax AS tax,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS target,
         CAST(l_partkey % 3 AS INTEGER) AS predicted,
         CAST((l_partkey * 7 + l_suppkey) % 101 AS DOUBLE) AS a,
         CAST((l_partkey * 3 + l_linenumber) % 97 AS DOUBLE) AS b,
         CAST((l_suppkey * 5 + l_orderkey) % 89 AS DOUBLE) AS c
  FROM lineitem),
scored AS (
  SELECT l_orderkey, l_linenumber, ts, quantity, extendedprice, discount, tax, target, predicted,
         (a + 1) / (a + b + c + 3) AS sell_proba, (b + 1) / (a + b + c + 3) AS buy_proba,
         (c + 1) / (a + b + c + 3) AS no_trade_proba
  FROM scored_base)"""

#: Position of a score row in time order, split into small cells even when one day is very large.
SCORED_ORDER = ("ts", "l_orderkey", "l_linenumber")


SCORED_SPLIT_SQL = (
    SCORED_SQL
    + """,
split_rows AS (
  SELECT *, CASE WHEN i < CAST(floor(CAST(floor(n * 0.8) AS DOUBLE) * 0.9) AS BIGINT) THEN 'train'
                 WHEN i < CAST(floor(n * 0.8) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY ts, l_orderkey, l_linenumber) - 1 AS i, count(*) OVER () AS n FROM scored))"""
)
