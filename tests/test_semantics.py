"""Edge rules on small literal frames."""

import math

import pytest
from pyspark.sql import functions as F

from candlework.functions import bins, calendar, levels, scalar
from candlework.operators import context_features as cf
from candlework.operators import labels as lb
from candlework.operators import quality as ql
from candlework.streaming.completed import completed_bars_stream


def path(spark, highs, lows):
    rows = [("A", k, 100.0, float(h), float(l), 100.0, 10.0) for k, (h, l) in enumerate(zip(highs, lows))]
    df = spark.createDataFrame(rows, "symbol string, k long, open double, high double, low double, close double, atr double")
    return df.withColumn("ts", F.timestamp_seconds(F.col("k") * 900)).drop("k")


@pytest.mark.parametrize(
    "highs, lows, label",
    [
        ([100, 105, 105, 105, 105, 110], [100] * 6, 1),
        ([100] * 6, [100, 95, 95, 95, 95, 90], 0),
        ([100, 110, 100, 100, 100, 100], [100, 90, 100, 100, 100, 100], 3),
        ([100] * 6, [100] * 6, 2),
        ([100, 100, 100, 100, 100], [100] * 5, 4),
        ([100, 100, 100, 100, 100, 100, 110], [100] * 7, 2),
    ],
)
def test_first_passage_edges(spark, highs, lows, label):
    got = lb.first_passage_label(path(spark, highs, lows), horizon=5).orderBy("ts").first()
    assert got.first_passage_target == label


def test_take_profit_same_bar_rules(spark):
    bars = path(spark, [100, 120, 100], [100, 80, 100])
    for rule, want in (("tp_first", 1), ("sl_first", 0), ("drop", None)):
        got = lb.take_profit_label(bars, tp=F.lit(10.0), sl=F.lit(10.0), max_bars=2, same_bar_rule=rule).orderBy("ts").first()
        assert got.target == want
    with pytest.raises(ValueError):
        lb.take_profit_label(bars, tp=F.lit(1.0), sl=F.lit(1.0), same_bar_rule="other")


def test_forward_label_checks_in_order(spark):
    rows = [("A", k, c, a) for k, (c, a) in enumerate([(100.0, 0.05), (0.0, None), (106.0, None), (106.0, 0.01), (106.0, 0.01)])]
    df = spark.createDataFrame(rows, "symbol string, k long, close double, atr_pct double").withColumn("ts", F.timestamp_seconds(F.col("k") * 900))
    got = [r.target for r in lb.forward_atr_label(df, horizon=2).orderBy("ts").collect()]
    assert got == [1, 2, 2, None, None]


def test_completed_bars_drop_incomplete_buckets(spark):
    rows = [("A", k, float(k), k + 2.0, k - 2.0, k + 1.0) for k in (0, 1, 2, 3, 4, 5, 7)]
    df = spark.createDataFrame(rows, "symbol string, k long, open double, high double, low double, close double").withColumn("ts", F.timestamp_seconds(F.col("k") * 900))
    got = cf.completed_bars(df.drop("k"), width="1 hour", expected=4).collect()
    assert len(got) == 1 and (got[0].open, got[0].high, got[0].low, got[0].close) == (0.0, 5.0, -2.0, 4.0)
    assert got[0].ts.hour == 1


def test_stream_emits_completed_bars(spark, tmp_path):
    rows = [("A", k, float(k), k + 2.0, k - 2.0, k + 1.0) for k in range(13)]
    df = spark.createDataFrame(rows, "symbol string, k long, open double, high double, low double, close double").withColumn("ts", F.timestamp_seconds(F.col("k") * 900)).drop("k")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = (
        completed_bars_stream(stream, width="1 hour", expected=4, delay="0 seconds")
        .writeStream.format("memory").queryName("done").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    q.processAllAvailable()
    q.stop()
    assert spark.table("done").count() == 3


def test_signal_decision(spark):
    rows = [(0.8, 0.8), (0.9, 0.75), (0.1, 0.7), (0.7, 0.1), (0.2, 0.2)]
    df = spark.createDataFrame(rows, "b double, s double")
    got = [r[0] for r in df.select(scalar.decide_signal(F.col("b"), F.col("s"), 0.7, 0.7)).collect()]
    assert got == [1, 1, -1, 1, 0]


def test_bin_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.15,), (1.0,)], "x double")
    edges = [k / 10 for k in range(11)]
    right = [r[0] for r in df.select(bins.bin_right_closed(F.col("x"), edges, list(range(10)), include_lowest=True)).collect()]
    left = [r[0] for r in df.select(bins.bin_left_closed(F.col("x"), edges, list(range(10)), include_highest=True)).collect()]
    assert right == [0, 0, 1, 9] and left == [0, 1, 1, 9]


def test_known_holidays(spark):
    days = {str(r.day) for r in calendar.holidays(spark.createDataFrame([(2024,), (2021,)], "year int")).collect()}
    assert {"2024-03-29", "2024-05-27", "2024-11-28", "2021-12-24", "2021-07-05", "2021-06-18"} <= days


def test_fills_and_double_slippage(spark):
    made = levels.trade_results(quantity=F.lit(1.0), direction=F.lit(1), entry=F.lit(100.0), exit=F.lit(110.0), point=F.lit(1.0), tick=F.lit(1.0), commission=0.0, slippage=0.01)
    r = spark.range(1).select(*[v.alias(k) for k, v in made.items()]).first()
    assert math.isclose(r.net_pnl, 110 * 0.99 - 101) and math.isclose(r.slippage, 1.0 + 1.1)


def test_forbidden_names():
    assert ql.forbidden_names(["rsi", "Future_x", "lead_1"]) == ["Future_x", "lead_1"]
    with pytest.raises(ql.ContractError):
        ql.check_feature_names(["target_mean"])


def test_bar_contract(spark):
    rows = [("A", 0, 1.0, 2.0, 0.5, 1.5), ("A", 0, 1.0, 2.0, 0.5, 1.5), ("A", 1, 1.0, 0.9, 0.5, 1.5)]
    df = spark.createDataFrame(rows, "symbol string, k long, open double, high double, low double, close double").withColumn("ts", F.timestamp_seconds("k"))
    report = ql.bar_violations(df)
    r = report.first()
    assert (r.duplicate_times, r.high_below_body, r.non_positive) == (1, 1, 0)
    with pytest.raises(ql.ContractError):
        ql.require_valid(report)
