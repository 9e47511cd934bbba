"""Queries over prices of zero, and ratios that end in half a last digit, against their SQL."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest

import oracle_check
from __spark_entry__ import oracle_sql, queries

NAMES = [
    "features_all",
    "drift_all_features",
    "features_atr",
    "features_bar_ratios",
    "features_candle_anatomy",
    "features_cross_market_series",
    "features_cross_market",
    "features_directional",
    "features_returns",
    "label_boundary_distance",
    "label_economic_sanity",
    "rules_direction",
    "rules_outcomes",
    "strategy_control_differences",
]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Events of three types, two a bar; some bars open, close or stay at zero."""
    rng, rows = np.random.default_rng(4), []
    for k, kind in enumerate(("click", "purchase", "view")):
        for bar in range(240):
            first, last = np.round(rng.exponential(50, 2) + 0.01, 2)
            if bar % 40 == 7 * k + 3:
                first, last = ((0.0, last), (first, 0.0), (0.0, 0.0))[bar // 40 % 3]
            if bar % 40 == 30:
                first, last = 6.4, 3.17  # close / open - 1 is -0.5046875
            at = datetime(2024, 1, 19) + timedelta(minutes=15 * bar)
            rows += [(at + timedelta(seconds=k), kind, first), (at + timedelta(seconds=60 + k), kind, last)]
    events = pd.DataFrame(rows, columns=["ts", "event_type", "value"])
    events["event_id"], events["user_id"], events["props"] = range(len(rows)), 7 + np.arange(len(rows)) % 11, "{}"
    path = str(tmp_path_factory.mktemp("zero"))
    duckdb.connect().register("made", events).execute(f"COPY (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, props FROM made) TO '{path}/events.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return path, con


@pytest.mark.parametrize("name", NAMES)
def test_zero_price_matches_sql(spark, made, name):
    path, con = made
    why, rows = oracle_check.compare(spark, con, path, queries()[name], oracle_sql()[name])
    assert why is None and rows > 0, why
