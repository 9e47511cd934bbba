"""Blocks and class models keep all cores busy (F20)."""

import threading

from pyspark.sql import functions as F

from candlework.operators import models as ml
from candlework.operators.series import block_tasks, over_series


def test_class_models_are_fitted_side_by_side(spark, monkeypatch):
    train = spark.range(60).select((F.col("id") % 7).cast("double").alias("a"), F.rand(1).alias("b"), (F.col("id") % 3).cast("int").alias("target"))
    real, meet = ml.binary_trees, threading.Barrier(3)

    def waiting(**params):
        meet.wait(timeout=60)  # broken if a fit begins only when another has ended
        return real(**params)

    together = ml.fit_classes(train, ["a", "b"], trees=2, depth=2)
    monkeypatch.setattr(ml, "binary_trees", waiting)
    again = ml.fit_classes(train, ["a", "b"], trees=2, depth=2)
    assert list(again.models) == [0, 1, 2]
    columns = ["a", "target", *ml.SCORE_COLUMNS.values()]
    assert sorted(again.transform(train).select(columns).collect()) == sorted(together.transform(train).select(columns).collect())


def test_blocks_are_not_joined_to_one_task_per_core(spark):
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 1).alias("symbol"), F.timestamp_seconds(F.col("id") * 900).alias("ts"), F.col("id").alias("x"))
    out = over_series(rows, lambda df, w: df.withColumn("before", F.lag("x").over(w)), back=1, rows=16)
    assert out.where("before = x - 1").count() == 2999
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == block_tasks(rows) and sum(sizes) == 3000
