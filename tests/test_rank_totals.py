"""Sums per rank bin without ranking all rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from candlework.operators import tables as tb


def test_totals_of_rank_bins(spark):
    rng = np.random.default_rng(5)
    n = 3000
    wide = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 40, n), unit="D"), "k": rng.permutation(n), "hit": rng.integers(0, 2, n)})
    wide["spread"] = rng.normal(0, 1, n)
    wide["common"] = np.where(rng.random(n) < 0.9, 0.05, rng.integers(0, 9, n) / 100)
    wide["flat"] = 1.0
    wide.loc[::7, "spread"] = np.nan
    columns = ["spread", "common", "flat"]
    df = spark.createDataFrame(wide).withColumn("spread", F.nanvl("spread", F.lit(None)))
    rows = tb.rank_bin_totals(df, columns, 4, tie_order=["ts", "k"], totals={"hits": F.col("hit")}).collect()
    got = {(r["feature"], r["bin"]): (r["count"], r["hits"]) for r in rows}
    want = {}
    for c in columns:
        known = wide[wide[c].notna()].sort_values([c, "ts", "k"]).reset_index(drop=True)
        bins = np.maximum(np.ceil(known.index * 4 / (len(known) - 1)) - 1, 0).astype(int)
        for b, part in known.groupby(bins):
            want[c, b] = (len(part), part["hit"].sum())
    assert got == want
