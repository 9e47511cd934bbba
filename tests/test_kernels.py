"""Kernels against pandas and brute force; results must not depend on block size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlework.operators import ecdf as ed
from candlework.operators import permute as pm
from candlework.operators import price_features as pf
from candlework.operators import trades as tr
from candlework.operators.asof import Source, asof_join, asof_many
from candlework.operators.series import over_series, rolling, running_sum, time_cell, with_row_index


def pandas_of(df, order=("symbol", "ts")):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_row_index_is_exact(spark, walk):
    got = pandas_of(with_row_index(spark.createDataFrame(walk), ["symbol"], ["ts"], [time_cell("ts", 7200)], total="n"))
    assert (got["bar_index"] == walk.groupby("symbol").cumcount().to_numpy()).all()
    assert got.groupby("symbol")["n"].first().to_dict() == {"A": 700, "B": 45}


@pytest.mark.parametrize("total", ["_n", "_sum", "_base", "_chunk", "_before", "_start", "_pos"])
def test_row_index_takes_any_name_for_its_total(spark, walk, total):
    got = with_row_index(spark.createDataFrame(walk), ["symbol"], ["ts"], [time_cell("ts", 7200)], total=total)
    assert {(r.symbol, r[total]) for r in got.select("symbol", total).distinct().collect()} == {("A", 700), ("B", 45)}


@pytest.mark.parametrize("rows", [64, 300, 5000])
def test_rolling_does_not_depend_on_blocks(spark, walk, rows):
    def build(df, w):
        return df.withColumn("m", rolling(F.avg("close"), w, 50, seen=F.col("close")))

    got = pandas_of(over_series(spark.createDataFrame(walk), build, back=60, rows=rows))
    want = walk.groupby("symbol")["close"].rolling(50).mean().to_numpy()
    np.testing.assert_allclose(got["m"].to_numpy(dtype=float), want, rtol=1e-12)


def test_features_match_pandas(spark, walk):
    got = pandas_of(pf.price_features(spark.createDataFrame(walk)))
    for symbol, g in walk.groupby("symbol"):
        mine = got[got.symbol == symbol]
        c = g["close"].reset_index(drop=True)
        change = c.diff().fillna(0)
        up = change.clip(lower=0).ewm(com=13, min_periods=14).mean()
        down = (-change.clip(upper=0)).ewm(com=13, min_periods=14).mean()
        rsi = (100 - 100 / (1 + up / down.replace(0, np.nan))).fillna(50)
        macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        h, l = g["high"].reset_index(drop=True), g["low"].reset_index(drop=True)
        tr_ = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
        want = {
            "rsi": rsi, "macd": macd, "macd_signal": macd.ewm(span=9, adjust=False).mean(), "ema_26": c.ewm(span=26, adjust=False).mean(),
            "atr": tr_.ewm(com=13, min_periods=14).mean(), "sma_20": c.rolling(20).mean(), "sma_200": c.rolling(200).mean(),
            "volatility_20": c.pct_change().rolling(20).std(), "obv": (np.sign(c.diff()) * g["volume"].reset_index(drop=True)).fillna(0).cumsum(),
        }
        for name, series in want.items():
            np.testing.assert_allclose(mine[name].to_numpy(dtype=float), series.to_numpy(), rtol=1e-9, atol=1e-9, err_msg=name)


def test_running_sum_and_maximum(spark, walk):
    df = with_row_index(spark.createDataFrame(walk), ["symbol"], ["ts"], [time_cell("ts")])
    got = pandas_of(running_sum(df, {"total": "volume"}, maximum={"peak": "close"}, rows=37))
    assert np.allclose(got["total"], walk.groupby("symbol")["volume"].cumsum())
    assert np.allclose(got["peak"], walk.groupby("symbol")["close"].cummax())


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_asof_matches_merge_asof(spark, partitions):
    rng = np.random.default_rng(1)
    t0 = pd.Timestamp("2024-01-01")
    src = pd.DataFrame({"at": t0 + pd.to_timedelta(np.sort(rng.integers(0, 200_000, 80)), unit="s"), "v": rng.normal(size=80)})
    src = src.drop_duplicates("at")
    src.loc[src.index[::7], "v"] = np.nan
    left = pd.DataFrame({"t": t0 + pd.to_timedelta(np.sort(rng.choice(200_000, 150, replace=False)), unit="s")})
    left.loc[0, "t"] = src["at"].iloc[0]
    left = left.sort_values("t")
    want = pd.merge_asof(left, src, left_on="t", right_on="at", tolerance=pd.Timedelta(seconds=3000))
    right = spark.createDataFrame(src).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = asof_join(spark.createDataFrame(left), right, left_time="t", right_time="at", max_age_seconds=3000, partitions=partitions)
    got = got.toPandas().sort_values("t").reset_index(drop=True)
    pd.testing.assert_series_equal(got["v"].astype(float), want["v"], check_names=False)
    assert (got["source_ts"].fillna(t0) == want["at"].fillna(t0)).all()


def test_asof_rejects_bad_prediction_times(spark):
    at = F.timestamp_seconds(F.floor(F.col("id") / 2) * 60)
    left, right = spark.range(6).select(at.alias("t")), spark.range(3).select(F.timestamp_seconds("id").alias("at"), F.col("id").alias("v"))
    join = lambda df: asof_join(df, right, left_time="t", right_time="at", max_age_seconds=None, strict=True)
    with pytest.raises(ValueError, match="3 prediction times"):
        join(left)
    with pytest.raises(TypeError, match="UTC"):
        join(left.distinct().withColumn("t", F.col("t").cast("timestamp_ntz")))
    assert join(left.distinct()).count() == 3


def test_asof_splits_a_heavy_moment_and_reads_shared_frames_once(spark):
    moment = F.timestamp_seconds(F.lit(1_000_000))
    left = spark.range(4000).select(F.col("id").alias("row"), moment.alias("t"))
    moves = spark.range(3000).select(F.timestamp_seconds(F.lit(999_000) + F.col("id") % 1000).alias("at"), (F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    sources = [Source(moves, "at", None, order=("v",), prefix=f"s{k}_", source_time=f"s{k}_at", age=f"s{k}_age", only=F.col("k") == k, without=("k",)) for k in range(3)]
    got = asof_many(left, sources, left_time="t", partitions=8)
    want = {k: max((999_000 + i % 1000, i) for i in range(3000) if i % 3 == k)[1] for k in range(3)}
    assert [tuple(r) for r in got.select("s0_v", "s1_v", "s2_v").distinct().collect()] == [tuple(want[k] for k in range(3))]
    assert got.count() == 4000
    (stored,) = {x.split("/stage-")[0] + "/stage-" + x.split("/stage-")[1].split("/")[0] for x in got.inputFiles()}
    sizes = [r["count"] for r in spark.read.parquet(stored).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_asof_revision_only_after_publication(spark):
    rows = [("2024-01-01", "initial", 1.0), ("2024-01-05", "revision_1", 2.0)]
    src = spark.createDataFrame(rows, "d string, revision string, v double").select(F.col("d").cast("timestamp").alias("at"), "revision", "v")
    left = spark.createDataFrame([("2024-01-04",), ("2024-01-05",), ("2024-03-01",)], "d string").select(F.col("d").cast("timestamp").alias("t"))
    got = asof_join(left, src, left_time="t", right_time="at", max_age_seconds=7 * 86400, order=["revision"]).orderBy("t").collect()
    assert [r.v for r in got] == [1.0, 2.0, None]


def test_ecdf_statistics(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": np.round(rng.normal(size=600), 1), "y": rng.integers(0, 2, 600)})
    pdf.loc[:250, "x"] = 0.5  # a value holding a large share of the rows
    df = spark.createDataFrame(pdf)
    long = ed.unpivot(df, ["x"], keep=["y"], cells=ed.value_cells(df, ["x"], 8))
    table = ed.ecdf(long, {"a": F.col("y") == 1, "b": F.col("y") == 0})
    got = table.groupBy("feature").agg(
        ed.auc("a", "b").alias("auc"), ed.ks("a", "b").alias("ks"), ed.wasserstein("a", "b").alias("w"), ed.quantile("a", 0.3).alias("q")
    ).first()
    a, b = pdf.x[pdf.y == 1].to_numpy(), pdf.x[pdf.y == 0].to_numpy()
    grid = np.sort(pdf.x.unique())
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    wins = (a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()
    assert got.auc == pytest.approx(wins)
    assert got.ks == pytest.approx(np.abs(fa - fb).max())
    assert got.w == pytest.approx((np.abs(fa - fb)[:-1] * np.diff(grid)).sum())
    assert got.q == pytest.approx(np.quantile(a, 0.3))


def test_random_selection_is_exact_and_partition_independent(spark):
    rows = spark.range(3000).select(F.lit("k").alias("g"), "id", (F.col("id") % 10).cast("double").alias("v"))
    results = []
    for n in (2, 7):
        observed, null = pm.matched_selection_null(
            rows.repartition(n), value="v", selected=F.col("id") < 500, keys=["g"], row_key=["id"], permutations=20
        )
        got = {r.perm: (r.selected, round(r.statistic, 12)) for r in null.collect()}
        assert len(got) == 20 and all(s == 500 for s, _ in got.values())
        results.append(got)
    assert results[0] == results[1]
    assert len({m for _, m in results[0].values()}) > 10


def test_label_permutation_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": range(400), "s": np.round(rng.random(400), 2), "y": rng.random(400) < 0.3})
    df = spark.createDataFrame(pdf)
    observed, null = pm.label_permutation_null(df, positive=F.col("y"), score="s", row_key=["id"], permutations=5)
    obs = {r.metric: r.observed for r in observed.collect()}
    a, b = pdf.s[pdf.y].to_numpy(), pdf.s[~pdf.y].to_numpy()
    assert obs["roc_auc"] == pytest.approx((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())
    for r in null.collect():
        assert r.selected == pdf.y.sum() and 0 < r.statistic < 1


def test_shuffled_columns_keep_values(spark):
    rows = spark.range(500).select("id", (F.col("id") * 2).alias("v"))
    got = pm.shuffled_columns(rows, ["v"], row_key=["id"], permutations=2).toPandas()
    for _, g in got.groupby("perm"):
        assert sorted(g["id"]) == list(range(500)) and sorted(g["v"]) == [2 * k for k in range(500)]
        assert (g["v"] != 2 * g["id"]).mean() > 0.9


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 26, 50, 101, 1000, 4099])
def test_permuted_numbers_are_permutations(spark, n):
    spread = spark.range(n).withColumn("perm", F.explode(F.array(F.lit(1), F.lit(2), F.lit(77))))
    got = pm.permuted_numbers(spread, "id", n).toPandas()
    orders = {p: tuple(g.sort_values("id")["_source"]) for p, g in got.groupby("perm")}
    assert all(sorted(o) == list(range(n)) for o in orders.values())
    if n >= 50:
        assert len(set(orders.values())) == 3
        assert all(abs(np.corrcoef(np.arange(n), o)[0, 1]) < 5 / np.sqrt(n) for o in orders.values())


def test_label_permutation_follows_the_exact_law(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"s": np.round(rng.random(3000) ** 2, 2), "y": rng.random(3000) < 0.2})
    pdf.loc[::400, "s"] = None
    df = spark.createDataFrame(pdf).withColumn("s", F.when(~F.isnan("s"), F.col("s")))
    _, null = pm.label_permutation_null(df, positive=F.col("y"), score="s", permutations=199, values_per_cell=9)
    auc = np.array([r.statistic for r in null.where("metric = 'roc_auc'").collect()])
    kept = pdf.dropna()
    n, k, t = len(kept), int(kept.y.sum()), kept.groupby("s").size().to_numpy().astype(float)
    sd = np.sqrt((n + 1) / (12 * k * (n - k)) * (1 - (t**3 - t).sum() / (n**3 - n)))
    assert len(auc) == 199 and abs(auc.mean() - 0.5) < 4 * sd / np.sqrt(199) and 0.8 < auc.std(ddof=1) / sd < 1.2


def test_first_touch_matches_scan(spark, walk):
    bars = with_row_index(spark.createDataFrame(walk), ["symbol"], ["ts"], [time_cell("ts")]).cache()
    queries = bars.select("symbol", "bar_index", (F.col("close") + 6).alias("up"), (F.col("close") - 9).alias("down"))
    got = pandas_of(tr.first_touch(queries, bars), ("symbol", "bar_index"))
    k = 0
    for _, g in walk.groupby("symbol"):
        hi, lo, c = (g[x].to_numpy() for x in ("high", "low", "close"))
        for i in range(len(g)):
            hit = np.nonzero((hi[i + 1 :] >= c[i] + 6) | (lo[i + 1 :] <= c[i] - 9))[0]
            value = got["touch_index"].iloc[k]
            assert (pd.isna(value) and len(hit) == 0) or value == i + 1 + hit[0]
            k += 1


@pytest.mark.parametrize("block", [4, 50, 4096])
def test_non_overlapping_matches_greedy(spark, block):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for symbol, n in (("A", 160), ("B", 30)):
        entries = np.sort(rng.choice(600, n, replace=False))
        exits = np.minimum(entries + rng.integers(1, 25, n), 620)
        busy, taken = -1, []
        for e, x in zip(entries, exits):
            ok = e > busy
            taken.append(bool(ok))
            busy = x if ok else busy
            rows.append((symbol, int(e), int(x)))
        want[symbol] = taken
    df = spark.createDataFrame(rows, "symbol string, entry_index long, exit_index long")
    got = pandas_of(tr.non_overlapping(df, block_rows=block), ("symbol", "entry_index"))
    for symbol, g in got.groupby("symbol"):
        assert g["accepted"].tolist() == want[symbol]
