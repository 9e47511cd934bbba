"""Tables over splits in which a class does not occur."""

import math

import pytest

from candlework.functions.scalar import correlation
from candlework.operators import tables as tb


def test_label_audit_of_a_label_that_never_occurs(spark):
    rows = [("train", int(k % 3 == 0), int(k % 3 == 1)) for k in range(30)] + [("test", 0, int(k % 2)) for k in range(10)] + [("one", 1, 0)]
    got = {r["split"]: r for r in tb.label_audit(spark.createDataFrame(rows, "split string, buy_success int, sell_success int")).collect()}
    assert got["train"].label_pearson_correlation == pytest.approx(-0.5)
    assert math.isnan(got["test"].label_pearson_correlation) and got["test"].both_zero_count == 5
    assert math.isnan(got["one"].label_pearson_correlation) and got["one"].rows == 1


def test_correlation_reads_pairs_only(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (None, 100.0), (50.0, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    found = df.agg(correlation(df.x, df.y).alias("c"), correlation(df.x * 0, df.y).alias("flat")).first()
    assert found.c == pytest.approx(df.na.drop().corr("x", "y")) and math.isnan(found.flat)
    assert df.where("x > 99").agg(correlation(df.x, df.y)).first()[0] is None


def test_direction_symmetry_of_splits_without_a_side(spark):
    rows = [("train", k % 3, 1.0 + k, 2.0 * k) for k in range(9)] + [("validation", 1, 1.5, 3.0), ("validation", 2, 0.2, 0.1), ("test", 2, 0.3, 0.1)]
    df = spark.createDataFrame(rows, "split string, target int, absolute_move_atr double, forward_move_price_points double")
    got = {r["split"]: r for r in tb.direction_symmetry(df).collect()}
    assert got["train"].buy_to_sell_count_ratio == 1 and got["train"].buy_median_excess_atr == 4 and got["train"].sell_median_move_points == 6
    assert got["validation"].buy_to_sell_count_ratio == math.inf and got["validation"].buy_median_excess_atr == 0.5
    assert (got["test"].buy_count, got["test"].sell_count, got["test"].buy_median_excess_atr) == (0, 0, None) and math.isnan(got["test"].buy_to_sell_count_ratio)


def test_forward_relation_of_one_class(spark):
    rows = [("A", k, 2, 0.01 * k) for k in range(8)]
    df = spark.createDataFrame(rows, "symbol string, at long, target int, forward_1 double").selectExpr("symbol", "timestamp_seconds(at) AS ts", "target", "forward_1")
    got = tb.forward_relation(df, horizons=[1]).collect()
    assert len(got) == 4 and sum(r["count"] for r in got) == 8 and all(math.isnan(r["corr"]) and r["target_rate"] == 2 for r in got)
