"""Exits that stay open over bars reaching both levels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlework.operators import staging
from candlework.operators import trades as tr

BARS = "symbol string, bar_index long, ts timestamp, high double, low double, close double, signal int"


def bars_of(spark, high, low, close, signal):
    ts = pd.date_range("2024-01-01", periods=len(high), freq="min")
    known = lambda x: None if np.isnan(x) else float(x)
    rows = [("A", i, ts[i].to_pydatetime(), known(high[i]), known(low[i]), float(close[i]), int(signal[i])) for i in range(len(high))]
    return staging.stage(spark.createDataFrame(rows, BARS))


def test_rounds_do_not_follow_runs_of_double_touches(spark):
    n = 60
    high, low = np.full(n, 9.0), np.full(n, 1.0)
    low[-1] = 5.0
    bars = bars_of(spark, high, low, np.full(n, 5.0), np.ones(n))
    with staging.collecting() as made:
        got = tr.candidate_exits(bars, tp=F.lit(2.0), sl=F.lit(2.0), same_bar_rule="drop").collect()
    assert len(made) <= 5
    assert all(r.exit_index == n - 1 for r in got) and {r.exit_reason for r in got if r.entry_index < n - 1} == {"take_profit"}


@pytest.mark.parametrize("steps", [16, 64])
def test_first_one_sided_matches_scan(spark, monkeypatch, steps):
    monkeypatch.setattr(tr, "FRONT_STEPS", steps)
    rng = np.random.default_rng(3)
    n = 4400
    # Widening bars: all of a group are on its fronts.
    reach = np.where(np.arange(n) < 2200, np.sort(rng.exponential(8, n)), rng.exponential(8, n))
    mid = rng.normal(0, 0.4, n)
    high, low = np.round(mid + reach, 1), np.round(mid - reach, 1)
    high[rng.random(n) < 0.01], low[rng.random(n) < 0.01] = np.nan, np.nan
    close = rng.normal(0, 1, n)
    up, down = close + rng.exponential(30, n), close - rng.exponential(30, n)
    bars = bars_of(spark, high, low, close, np.ones(n))
    levels = spark.createDataFrame(pd.DataFrame({"symbol": "A", "bar_index": np.arange(n), "up": up, "down": down}))
    got = {r.bar_index: r.touch_index for r in tr.first_one_sided(levels, bars).collect()}
    assert len(got) == n
    with np.errstate(invalid="ignore"):
        for i in range(0, n, 3):
            hit = np.nonzero((high[i + 1 :] >= up[i]) != (low[i + 1 :] <= down[i]))[0]
            assert got[i] == (i + 1 + hit[0] if len(hit) else None)
