"""Queries whose SQL divides by prices of zero as floating point does, on the bars of ``test_zero_prices``."""

import math

import pytest
from pyspark.sql import functions as F

import oracle_check
from __spark_entry__ import oracle_sql, queries
from candlework.functions.scalar import quotient
from candlework.operators.linear import single_feature_fits
from test_zero_prices import made  # noqa: F401

NAMES = [
    "model_single_feature_fits",
    "permutation_selection_counts",
    "study_asymmetric_labels",
    "study_label_distribution",
    "table_boundary_fragility",
    "table_condition_rates",
    "table_direction_symmetry",
    "table_forward_relation",
    "table_multiplier_sweep",
    "table_regime_structure",
    "table_regimes",
    "table_sessions",
    "table_target_drift_bars",
]


def test_quotient_over_zero(spark):
    rows = [(1.0, 0.0), (-2.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (1.0, 3.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(quotient(F.col("a"), F.col("b")).cast("string")).collect()]
    assert got == ["Infinity", "-Infinity", "NaN", None, None, str(1 / 3)]


@pytest.mark.parametrize("name", NAMES)
def test_infinite_ratios_match_sql(spark, made, name):  # noqa: F811
    path, con = made
    why, rows = oracle_check.compare(spark, con, path, queries()[name], oracle_sql()[name])
    assert why is None and rows > 0, why


def test_every_bar_is_rebuilt_as_far_as_its_features_tell(spark, made):  # noqa: F811
    path, con = made
    got = {(r.symbol, r.ts): r for r in queries()["reconstruct_prices"](spark, path).collect()}
    bars = con.execute(
        "SELECT event_type, time_bucket(INTERVAL 15 MINUTE, events.ts) AS bar, arg_min(value, events.ts) = 0, arg_max(value, events.ts) = 0, row_number() OVER (PARTITION BY event_type ORDER BY bar) FROM events GROUP BY 1, 2"
    ).fetchall()
    want = {(symbol, at): (opens, closes) for symbol, at, opens, closes, i in bars if i >= 14}
    assert got.keys() == want.keys() and any(opens and closes for opens, closes in want.values())
    for bar, (opens, closes) in want.items():
        row = got[bar]
        assert row.close_error == 0 and row.open_error == (None if closes else 0)
        assert row.high_error == row.low_error == (None if opens or closes else 0)


def test_a_feature_with_infinite_values_has_no_fit(spark):
    rows = [(float("inf") if k == 3 else 1.0 * k, float("nan") if k == 5 else 1.0 * (k % 7), 1.0 * (k % 5), int(k % 3 == 0)) for k in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    got = {r.feature: r for r in single_feature_fits(df, ["a", "b", "c"], label="y", undefined=True).collect()}
    alone = single_feature_fits(df, ["c"], label="y").first()
    for name in "ab":
        assert math.isnan(got[name].intercept) and (got[name].rows, got[name].slope, got[name].gradient) == (60, 0.0, None)
    assert (got["c"].rows, got["c"].intercept, got["c"].slope) == (60, alone.intercept, alone.slope) and got["c"].gradient <= 1e-9
    default = {r.feature: r for r in single_feature_fits(df, ["a", "b"], label="y").collect()}
    assert math.isnan(default["a"].intercept) and default["b"].rows == 59 and default["b"].gradient <= 1e-9
