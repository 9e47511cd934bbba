"""Summary tables over labelled rows: class shares, drift, regimes, conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import bin_by_edges, rank_bin
from ..functions.scalar import correlation, quotient
from . import ecdf as ed
from .series import cell_ranks, placeable, same, time_cell, with_row_index
from .staging import stage

SHARES = ("sell_pct", "buy_pct", "no_trade_pct")


def class_shares(target: str = "target", where: Column | None = None, prefix: str = "") -> list[Column]:
    """Row count and percentage of every class, optionally of a subset of rows."""
    keep = F.lit(True) if where is None else where
    n = F.count_if(keep)
    t = F.col(target)
    return [n.alias(f"{prefix}row_count")] + [
        (100.0 * F.count_if(keep & (t == k)) / F.nullif(n, F.lit(0))).alias(f"{prefix}{name}") for k, name in enumerate(SHARES)
    ]


def class_summary(df: DataFrame, keys: Sequence[str] = ("split",), target: str = "target") -> DataFrame:
    return df.groupBy(*keys).agg(*class_shares(target))


def class_distribution(df: DataFrame, keys: Sequence[str] = (), target: str = "target", classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Long form (class, count, percentage); absent classes appear with 0."""
    t = F.col(target)
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(t == k).alias(f"_c{k}") for k in classes])
    entries = F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"_c{k}").alias("count")) for k in classes])
    return wide.select(*keys, "_n", F.explode(entries).alias("_e")).select(
        *keys, "_e.class", "_e.count", (100.0 * F.col("_e.count") / F.col("_n")).alias("percentage")
    )


def paired_shares(df: DataFrame, memberships: Column, *, target: str = "target", split: str = "split") -> DataFrame:
    """Class shares per (dimension, group) and split, with validation minus train.

    ``memberships`` is an array of (dimension, group) structs: a row may belong
    to several groups.  Both splits are aggregated side by side, so the
    comparison needs no self-join.
    """
    both = ("train", "validation")
    rows = df.where(F.col(split).isin(*both)).select(target, split, F.explode(memberships).alias("_m"))
    wide = rows.groupBy("_m.dimension", "_m.group").agg(
        *[c for s in both for c in class_shares(target, F.col(split) == s, f"{s}_")]
    )
    gaps = [(F.col(f"validation_{x}") - F.col(f"train_{x}")).alias(f"validation_minus_train_{x}_pp") for x in SHARES]
    sides = F.array(
        *[
            F.struct(F.lit(s).alias("split"), F.col(f"{s}_row_count").alias("row_count"), *[F.col(f"{s}_{x}").alias(x) for x in SHARES])
            for s in both
        ]
    )
    return (
        wide.select("dimension", "group", F.explode(sides).alias("_s"), *gaps)
        .where(F.col("_s.row_count") > 0)
        .select("dimension", "group", "_s.*", *[f"validation_minus_train_{x}_pp" for x in SHARES])
    )


def _entry(dimension: str, group: Column) -> Column:
    return F.struct(F.lit(dimension).alias("dimension"), group.cast("string").alias("group"))


def calendar_memberships(ts: str = "ts") -> Column:
    t = F.col(ts)
    return F.array(
        _entry("overall", F.lit("all")),
        _entry("year", F.year(t)),
        _entry("year_month", F.date_format(t, "yyyy-MM")),
        _entry("month_of_year", F.month(t)),
        _entry("weekday", F.weekday(t)),
        _entry("utc_hour", F.hour(t)),
    )


def session_memberships(ts: str = "ts") -> Column:
    """Hour plus every named session the hour lies in; the rest is unassigned."""
    h = F.hour(ts)
    named = F.filter(
        F.array(
            F.when(h.between(0, 7), "asia_00_07"),
            F.when(h.between(8, 15), "london_08_15"),
            F.when(h.between(13, 20), "new_york_13_20"),
            F.when(h.between(13, 15), "london_new_york_overlap_13_15"),
            F.when(h > 20, "unassigned"),
        ),
        lambda x: x.isNotNull(),
    )
    return F.concat(F.array(_entry("utc_hour", h)), F.transform(named, lambda x: _entry("session", x)))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], *, keep: Column | None = None, keys: Sequence[str] = (), cells: int | None = None, cuts: dict | None = None) -> DataFrame:
    """(keys, feature, edges): exact quantiles of the kept rows per column."""
    cuts = cuts or ed.value_cells(df, columns, cells)
    rows = df if keep is None else df.where(keep)
    table = ed.ecdf(ed.unpivot(rows, columns, keep=keys, cells=cuts), {"g": F.lit(True)}, keys=[*keys, "feature"])
    return table.groupBy(*keys, "feature").agg(F.array(*[ed.quantile("g", p) for p in probs]).alias("edges"))


def medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str], *, cells: int | None = None, cuts: dict | None = None) -> DataFrame:
    """Exact medians of several columns per key, without holding a group in memory."""
    long = exact_quantiles(df, columns, [0.5], keys=keys, cells=cells, cuts=cuts)
    return long.groupBy(*keys).pivot("feature", list(columns)).agg(F.max(F.col("edges")[0])).withColumnsRenamed(
        {c: f"{c}_median" for c in columns}
    )


def inner_edges(edges: Column) -> Column:
    """Distinct edges without the lowest and the highest (those become infinite)."""
    unique = F.array_sort(F.array_distinct(edges))
    return F.when(F.size(unique) > 2, F.slice(unique, F.lit(2), F.size(unique) - 2)).otherwise(F.array().cast("array<double>"))


def regime_table(df: DataFrame, *, ts: str = "ts", target: str = "target", split: str = "split") -> DataFrame:
    """Class shares and price statistics per regime whose edges come from train rows.

    Regimes: close quintiles, atr_pct tertiles and calendar year.  Needs
    ``close``, ``returns`` and ``atr_pct``; the rows are read several times, so
    they are staged once.
    """
    rows = stage(df.where(F.col(split).isin("train", "validation")).select(ts, target, split, "close", "returns", "atr_pct"))
    train = F.col(split) == "train"
    cuts = ed.value_cells(rows, ["close", "returns", "atr_pct"])
    price = exact_quantiles(rows, ["close"], [0, 0.2, 0.4, 0.6, 0.8, 1], keep=train, cuts=cuts)
    swing = exact_quantiles(rows, ["atr_pct"], [0, 1 / 3, 2 / 3, 1], keep=train, cuts=cuts)
    edges = price.unionByName(swing).groupBy(F.lit(1).alias("_one")).pivot("feature", ["close", "atr_pct"]).agg(F.first("edges"))
    edges = edges.select("_one", inner_edges(F.col("close")).alias("_pe"), inner_edges(F.col("atr_pct")).alias("_ve"))
    placed = rows.withColumn("_one", F.lit(1)).join(edges, "_one")
    level = F.concat(F.lit("Q"), (bin_by_edges(F.col("close"), F.col("_pe"), right_closed=True) + 1).cast("string"))
    swing_bin = bin_by_edges(F.col("atr_pct"), F.col("_ve"), right_closed=True)
    swing_name = F.when(swing_bin == 0, "low").when(swing_bin == 1, "medium").otherwise("high")
    groups = F.array(
        _entry("price_quantile_train_edges", level), _entry("atr_pct_train_tertiles", swing_name), _entry("year", F.year(ts))
    )
    long = placed.select(target, split, "close", "returns", "atr_pct", F.explode(groups).alias("_m")).select(
        target, split, "close", "returns", "atr_pct", F.col("_m.dimension").alias("dimension"), F.col("_m.group").alias("regime")
    )
    keys = ["dimension", "regime", split]
    stats = long.groupBy(*keys).agg(
        *class_shares(target),
        F.avg("close").alias("close_mean"),
        F.avg("returns").alias("returns_mean"),
        F.avg("atr_pct").alias("atr_pct_mean"),
    )
    return same(stats, medians(long, ["close", "returns"], keys, cuts=cuts), keys, "left")


def _ranked_cells(df: DataFrame, columns: Sequence[str], names: Sequence[str], ts: str, cells: int | None, near: Sequence[float] = ()) -> tuple[DataFrame, list[str]]:
    """Long rows with the cells (value, then time inside a very common value) that their ranks are counted by."""
    cuts = ed.value_cells(df, columns, cells, near=near)
    long = ed.unpivot(df, columns, keep=list(dict.fromkeys([*names, ts])), cells=cuts).where(F.col("value").isNotNull())
    within = F.when(F.col("heavy"), time_cell(ts)).otherwise(F.lit(0).cast("long"))
    return long.withColumnRenamed("cell", "value_cell").withColumn("time_cell", within), ["value_cell", "time_cell"]


def rank_bins(df: DataFrame, columns: Sequence[str], q: int, *, tie_order: Sequence[str], keep: Sequence[str], ts: str = "ts", cells: int | None = None) -> DataFrame:
    """Long (keep, feature, value, bin): equal-frequency bins of ranks, ties by ``tie_order``.

    A value that fills more than one cell's share of the rows is ranked in time
    cells, so one very common value does not end up in one task.
    """
    long, at = _ranked_cells(df, columns, [*keep, *tie_order], ts, cells)
    ranked = with_row_index(long, ["feature"], ["value", *tie_order], [F.col(c) for c in at], index="_rank", total="_n")
    return ranked.withColumn("bin", rank_bin(F.col("_rank"), F.col("_n"), q)).select(*keep, "feature", "value", "bin")


def rank_bin_totals(df: DataFrame, columns: Sequence[str], q: int, *, tie_order: Sequence[str], totals: dict[str, Column], ts: str = "ts") -> DataFrame:
    """(feature, bin, count, totals): how many rows ``rank_bins`` puts in each bin, and sums over them.

    Rows are only counted per cell.  A cell whose ranks lie in one bin is added as a whole; rows are ranked in the cells
    that a bin edge cuts, ``q - 1`` per column at most.  ``df`` is read three times.
    """
    sums = [F.sum(t).alias(t) for t in totals]
    values = df.withColumns(totals)
    long, at = _ranked_cells(values, columns, [*totals, *tie_order], ts, None, [k / q for k in range(1, q)])
    long = placeable(long, at)
    placed = stage(cell_ranks(long.groupBy("feature", *at).agg(F.count(F.lit(1)).alias("count"), *sums), ["feature"], at, "count"))
    of = lambda rank: rank_bin(rank, F.col("_total"), q)
    last = F.col("_start") + F.col("count") - 1
    whole = placed.where(of(F.col("_start")) == of(last)).select("feature", of(F.col("_start")).alias("bin"), "count", *totals)
    cut = placed.where(of(F.col("_start")) != of(last)).select("feature", *at, "_start", "_total")
    inside = long.join(F.broadcast(cut), ["feature", *at])
    rank = F.col("_start") + F.row_number().over(Window.partitionBy("feature", *at).orderBy("value", *tie_order)) - 1
    split = inside.select("feature", of(rank).alias("bin"), F.lit(1).cast("long").alias("count"), *totals)
    return whole.unionByName(split).groupBy("feature", "bin").agg(F.sum("count").alias("count"), *sums)


def condition_rates(df: DataFrame, conditions: dict[str, Column], *, target: str = "target") -> DataFrame:
    """Class rates of the rows that satisfy each condition (they may overlap)."""
    t = F.col(target)
    hits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull())
    return df.select(target, F.explode(hits).alias("condition")).groupBy("condition").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(t).alias("target_rate"),
        F.avg((t == 1).cast("double")).alias("buy_rate"),
        F.avg((t == 0).cast("double")).alias("sell_rate"),
    )


def label_audit(df: DataFrame, *, keys: Sequence[str] = ("split",), buy: str = "buy_success", sell: str = "sell_success") -> DataFrame:
    """Prevalence, overlap and correlation of two binary labels."""
    b, s = F.col(buy), F.col(sell)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(b).alias("buy_success_prevalence"),
        F.avg(s).alias("sell_success_prevalence"),
        F.count_if((b == 0) & (s == 0)).alias("both_zero_count"),
        F.count_if((b == 1) & (s == 1)).alias("both_one_count"),
        F.count_if((b == 1) | (s == 1)).alias("directional_count"),
        correlation(b, s).alias("label_pearson_correlation"),
    )
    return out.withColumns(
        {
            "both_zero_rate": F.col("both_zero_count") / F.col("rows"),
            "are_strict_complements": ((F.col("both_zero_count") == 0) & (F.col("both_one_count") == 0)).cast("int"),
            "are_mutually_exclusive": (F.col("both_one_count") == 0).cast("int"),
        }
    )


def boundary_summary(rows: DataFrame, *, keys: Sequence[str] = ("split", "target")) -> DataFrame:
    """How close labelled rows lie to the label threshold."""
    near = F.col("boundary_distance_atr")
    shares = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        *[(100.0 * F.avg((near <= b).cast("double"))).alias(f"within_{name}_atr_pct") for b, name in ((0.05, "0_05"), (0.10, "0_10"), (0.25, "0_25"))],
    )
    with_abs = rows.withColumn("absolute_forward_move_points", F.abs("forward_move_price_points"))
    mids = medians(with_abs, ["boundary_distance_atr", "absolute_move_atr", "threshold_price_points", "absolute_forward_move_points"], keys)
    return same(shares, mids, keys, "left") if keys else shares.join(mids)


def direction_symmetry(rows: DataFrame, *, key: str = "split", target: str = "target") -> DataFrame:
    """Buy against sell rows: counts, ratio, median excess beyond the threshold, median move.

    Every key of ``rows`` is in the result; without sell rows the ratio is infinite, or NaN without either.
    """
    sides = rows.where(F.col(target).isin(0, 1)).withColumn("excess", F.col("absolute_move_atr") - 1.0)
    counts = rows.groupBy(key).agg(F.count_if(F.col(target) == 1).alias("buy_count"), F.count_if(F.col(target) == 0).alias("sell_count"))
    mids = medians(sides, ["excess", "forward_move_price_points"], [key, target])
    wide = mids.groupBy(key).agg(
        *[
            F.max(F.when(F.col(target) == k, F.col(f"{c}_median"))).alias(f"{side}_median_{name}")
            for k, side in ((1, "buy"), (0, "sell"))
            for c, name in (("excess", "excess_atr"), ("forward_move_price_points", "move_points"))
        ]
    )
    return same(counts, wide, [key], "left").withColumn("buy_to_sell_count_ratio", quotient(F.col("buy_count").cast("double"), F.col("sell_count")))


def forward_relation(df: DataFrame, *, horizons: Sequence[int], target: str = "target", tie_order: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Correlation with, and class rate per quartile of, the forward return of each horizon.

    Needs columns ``forward_<h>``.
    """
    names = [f"forward_{h}" for h in horizons]
    t = F.col(target)
    bins = rank_bin_totals(df, names, 4, tie_order=tie_order, totals={"_sum": t.cast("double"), "_known": t.isNotNull().cast("long")})
    rates = bins.select("feature", "bin", "count", (F.col("_sum") / F.nullif(F.col("_known"), F.lit(0))).alias("target_rate"))
    wide = df.agg(*[correlation(t, F.col(n)).alias(n) for n in names])
    corr = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("corr")) for n in names])).alias("_c")).select("_c.*")
    return rates.join(corr, "feature")


def multiplier_sweep(df: DataFrame, multipliers: Sequence[float], *, forward: str = "forward_return", atr_pct: str = "atr_pct") -> DataFrame:
    """Label shares for several threshold multipliers, from one aggregation.

    Every multiplier is a set of conditional counts, so rows are not copied.
    """
    move, limit = F.col(forward), F.abs(F.coalesce(F.col(atr_pct), F.lit(0.0)))
    known = df.where(move.isNotNull())
    wide = known.agg(
        F.count(F.lit(1)).alias("n"),
        *[c for k, m in enumerate(multipliers) for c in (F.count_if(move > limit * m).alias(f"b{k}"), F.count_if(move < -limit * m).alias(f"s{k}"))],
    )
    rows = F.array(*[F.struct(F.lit(float(m)).alias("multiplier"), F.col(f"b{k}").alias("b"), F.col(f"s{k}").alias("s")) for k, m in enumerate(multipliers)])
    return wide.select("n", F.explode(rows).alias("_r")).select(
        "_r.multiplier",
        F.col("n").alias("row_count"),
        (100.0 * F.col("_r.s") / F.col("n")).alias("sell_pct"),
        (100.0 * F.col("_r.b") / F.col("n")).alias("buy_pct"),
        (100.0 * (F.col("n") - F.col("_r.b") - F.col("_r.s")) / F.col("n")).alias("no_trade_pct"),
    )


def target_evaluation(labelled: DataFrame, *, keys: Sequence[str], target: str = "target") -> DataFrame:
    """Wins, losses, win rate, points and profit factor of ±1-point trades."""
    t = F.col(target)
    out = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_observations"),
        F.count(t).alias("total_trades"),
        F.count_if(t == 1).alias("wins"),
        F.count_if(t == 0).alias("losses"),
        F.count_if(t.isNull()).alias("dropped"),
    )
    return out.withColumns(
        {
            "win_rate": F.coalesce(F.col("wins") / F.nullif(F.col("total_trades"), F.lit(0)), F.lit(0.0)),
            "pnl_points": (F.col("wins") - F.col("losses")).cast("double"),
            "profit_factor": F.when(F.col("losses") > 0, F.col("wins") / F.col("losses")).otherwise(F.lit(float("inf"))),
        }
    )


def importance_summary(importances: DataFrame, *, folds: Sequence[int]) -> DataFrame:
    """Mean, spread and rank of feature importances over folds, one column per fold."""
    ranked = importances.withColumn("rank", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("importance"), "feature")))
    stats = ranked.groupBy("feature").agg(
        F.avg("importance").alias("importance_mean"),
        F.stddev_samp("importance").alias("importance_std"),
        F.min("importance").alias("importance_min"),
        F.max("importance").alias("importance_max"),
        F.avg("rank").alias("rank_mean"),
        F.stddev_samp("rank").alias("rank_std"),
        F.min("rank").alias("rank_min"),
        F.max("rank").alias("rank_max"),
        *[F.max(F.when(F.col("fold") == f, F.col("importance"))).alias(f"fold_{f}") for f in folds],
        *[F.max(F.when(F.col("fold") == f, F.col("rank"))).alias(f"fold_{f}_rank") for f in folds],
    )
    return stats


def top_rows(df: DataFrame, metric: str, k: int, *, keys: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """The ``k`` largest rows by ``metric`` overall or per key."""
    order = [F.desc(metric), *tie]
    if not keys:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")
