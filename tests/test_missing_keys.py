"""Rows without a key or a time: never counted, never lost without a word."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from candlework.operators import metrics, permute, quality, trades
from candlework.operators.asof import asof_join
from candlework.operators.series import time_cell, unplaced_rows, with_row_index


def at(hour, day=1):
    return dt.datetime(2024, 1, day, hour)


def test_index_counts_placed_rows_only(spark):
    rows = [("a", at(h), float(h)) for h in range(5)] + [("a", None, 9.0), ("a", None, 8.0), (None, at(1), 7.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, v double")
    got = with_row_index(df, ["symbol"], ["ts"], [time_cell("ts")], total="n_rows").orderBy("ts").collect()
    assert [(r["bar_index"], r["n_rows"]) for r in got] == [(k, 5) for k in range(5)]
    assert unplaced_rows(df, ["symbol"], ["ts"]).count() == 3


def test_index_crosses_chunks_of_cells(spark):
    df = spark.range(30_000).select(F.lit("a").alias("symbol"), F.col("id").alias("at"))
    got = with_row_index(df, ["symbol"], ["at"], [F.col("at")], total="n_rows")
    assert got.where("bar_index <> at OR n_rows <> 30000").count() == 0


def test_asof_keeps_every_left_row(spark):
    left = spark.createDataFrame([("a", at(5), 1), ("a", None, 2), (None, at(5), 3), ("b", at(5), 4)], "k string, ts timestamp, i int")
    right = spark.createDataFrame([("a", at(3), 10.0), (None, at(4), 11.0), ("a", None, 12.0), ("a", at(6), 13.0)], "k string, rt timestamp, v double")
    got = asof_join(left, right, by=["k"], left_time="ts", right_time="rt", max_age_seconds=None)
    assert {r["i"]: r["v"] for r in got.collect()} == {1: 10.0, 2: None, 3: None, 4: None}


def test_calibration_keeps_null_groups(spark):
    df = spark.createDataFrame([(None if k % 2 else "x", k % 3 == 0, k / 40) for k in range(40)], "g string, y boolean, s double")
    got = metrics.quantile_calibration(df.withColumn("y", F.col("y").cast("int")), actual="y", score="s", n=4, keys=["g"])
    assert got.agg(F.sum("count")).first()[0] == 40


def test_broken_contract_names_all_series(spark):
    report = spark.createDataFrame([(f"s{k}", *[1] * len(quality.RULES)) for k in range(9)], ", ".join(["symbol string", *[f"{r} int" for r in quality.RULES]]))
    with pytest.raises(quality.ContractError, match="'series': 9"):
        quality.require_valid(report)


def test_one_pass_null_equals_ranked_hashes(spark):
    df = spark.range(400).select(F.lit("r").alias("rule"), "id", (F.sin("id") * 3).alias("v"), (F.col("id") % 4 == 0).alias("sel"))
    observed, null = permute.matched_selection_null(df, value="v", selected=F.col("sel"), keys=["rule"], row_key=["id"], permutations=40)
    hashes = df.select("v", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("perm"), "id").withColumn("h", permute._flip(permute._hash(42, ["id"])))
    want = {}
    for r in hashes.collect():
        want.setdefault(r["perm"], []).append((r["h"], r["v"]))
    got = {r["perm"]: r for r in null.collect()}
    assert set(got) == set(want)
    for perm, pairs in want.items():
        chosen = [v for _, v in sorted(pairs)[:100]]
        assert got[perm]["selected"] == 100
        assert abs(got[perm]["statistic"] - sum(chosen) / 100) < 1e-9 and abs(got[perm]["win_rate"] - sum(v > 0 for v in chosen) / 100) < 1e-12


def test_links_of_trades_in_small_blocks(spark):
    entries = [(("a" if k % 2 else "b"), k, k + 1 + (k * 7) % 5) for k in range(60)]
    df = spark.createDataFrame(entries, "symbol string, entry_index long, exit_index long")
    want = set()
    for s in ("a", "b"):
        free = -1
        for symbol, start, end in entries:
            if symbol == s and start > free:
                want.add((s, start))
                free = end
    for rows in (4, 4096):
        got = trades.non_overlapping(df, block_rows=rows).where("accepted")
        assert {(r["symbol"], r["entry_index"]) for r in got.collect()} == want
