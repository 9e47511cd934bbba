"""Splits found by counting cells, against numbered rows."""

from pyspark.sql import functions as F

from candlework.operators import splits as sp


def test_labels_are_those_of_numbered_rows(spark):
    """Two thirds of the rows share one time, so both boundaries of series B lie inside it."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("symbol"),
        F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 40)).when(F.col("id") % 3 == 1, F.lit(10)).otherwise(F.lit(0)).cast("timestamp").alias("ts"),
        "id",
    ).unionByName(spark.createDataFrame([("A", None, -1)], "symbol string, ts timestamp, id long"))
    cell, inner = F.unix_timestamp("ts"), F.floor(F.col("id") / 100).cast("long")
    got = sp.split_labels(rows, by=["symbol"], order=["ts", "id"], cell=cell, inner=[inner])
    want = sp.chronological_split(rows, order=["ts", "id"], cells=[cell, inner])
    assert sorted(map(tuple, got.select("id", "split").collect())) == sorted(map(tuple, want.select("id", "split").collect()))
    assert {r["split"] for r in got.where("ts = timestamp_seconds(10)").collect()} == {"train", "validation", "test"}
