"""Drift and separability of features between samples or classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import bin_by_edges
from . import ecdf as ed
from .staging import stage
from .tables import inner_edges

DECILES = [k / 10 for k in range(11)]
PSI_FLOOR = 1e-6
PSI_DEGENERATE = 27.631


def moments(df: DataFrame, features: Sequence[str], groups: dict[str, Column]) -> DataFrame:
    """(feature, mean_g, var_g) with population variances, from one aggregation."""
    wide = df.agg(
        *[
            agg(F.when(cond, F.col(f).cast("double"))).alias(f"{stat}_{g}__{f}")
            for f in features
            for g, cond in groups.items()
            for stat, agg in (("mean", F.avg), ("var", F.var_pop))
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), *[F.col(f"{stat}_{g}__{f}").alias(f"{stat}_{g}") for g in groups for stat in ("mean", "var")])
            for f in features
        ]
    )
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


def _table(df: DataFrame, features: Sequence[str], groups: dict[str, Column], keep: Sequence[str], cells: int | None) -> DataFrame:
    """Stored distribution rows: several statistics are read off them.  ``df`` is read twice and should be stored."""
    cuts = ed.value_cells(df, features, cells, of="value")
    long = ed.unpivot(df, features, keep=keep).drop("cell", "heavy")
    return stage(ed.ecdf(long, groups, place=lambda hist: ed.distinct_cells(hist, cuts)))


def stability_index(table: DataFrame, a: str, b: str) -> DataFrame:
    """(feature, psi) from distribution rows, bins being deciles of sample ``a``."""
    edges = table.groupBy("feature").agg(F.array(*[ed.quantile(a, p) for p in DECILES]).alias("edges"))
    edges = edges.select("feature", "edges", F.size(F.array_distinct("edges")).alias("_d"), inner_edges(F.col("edges")).alias("_in"))
    binned = table.join(edges, "feature").withColumn("_bin", bin_by_edges(F.col("value"), F.col("_in"), right_closed=False))
    counts = binned.groupBy("feature", "_bin").agg(
        F.sum(f"n_{a}").alias("_na"),
        F.sum(f"n_{b}").alias("_nb"),
        F.max(f"t_{a}").alias("_ta"),
        F.max(f"t_{b}").alias("_tb"),
        F.max("_d").alias("_d"),
        F.sum(F.when((F.col(f"n_{b}") > 0) & (F.col("value") != F.col("edges")[0]), F.lit(1)).otherwise(0)).alias("_other"),
    )
    pa = F.greatest(F.col("_na") / F.nullif(F.col("_ta"), F.lit(0)), F.lit(PSI_FLOOR))
    pb = F.greatest(F.col("_nb") / F.nullif(F.col("_tb"), F.lit(0)), F.lit(PSI_FLOOR))
    summed = counts.groupBy("feature").agg(
        F.sum((pb - pa) * F.ln(pb / pa)).alias("_psi"), F.max("_d").alias("_d"), F.sum("_other").alias("_other")
    )
    flat = F.when(F.col("_other") == 0, 0.0).otherwise(PSI_DEGENERATE)
    return summed.select("feature", F.when(F.col("_d") < 2, flat).otherwise(F.col("_psi")).alias("psi"))


def drift_table(df: DataFrame, features: Sequence[str], *, split: str = "split", cells: int | None = None, family=None) -> DataFrame:
    """KS, PSI, Wasserstein, means and deviations of validation against train."""
    rows = df.where(F.col(split).isin("train", "validation"))
    groups = {s: F.col(split) == s for s in ("train", "validation")}
    table = _table(rows, features, groups, [split], cells)
    stats = table.groupBy("feature").agg(
        ed.ks("train", "validation").alias("ks_statistic"),
        ed.wasserstein("train", "validation").alias("wasserstein"),
        F.max("t_train").alias("_n"),
        F.max("t_validation").alias("_m"),
    )
    m = moments(rows, features, groups)
    out = stats.join(stability_index(table, "train", "validation"), "feature").join(m, "feature")
    sd = F.sqrt("var_train")
    out = out.select(
        "feature",
        "ks_statistic",
        ed.ks_pvalue(F.col("ks_statistic"), F.col("_n"), F.col("_m")).alias("ks_pvalue"),
        "psi",
        "wasserstein",
        F.when(sd > 0, F.col("wasserstein") / sd).otherwise(0.0).alias("wasserstein_train_std_units"),
        F.col("mean_train").alias("train_mean"),
        F.col("mean_validation").alias("validation_mean"),
        sd.alias("train_std"),
        F.sqrt("var_validation").alias("validation_std"),
    )
    if family is None:
        return out
    named = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(family(f)))])
    return out.withColumn("family", named[F.col("feature")])


def family_rollup(drift: DataFrame) -> DataFrame:
    """Count, mean/median/max KS and mean PSI per feature family.

    Its input has one row per feature, so a plain percentile is enough.
    """
    return drift.groupBy("family").agg(
        F.count(F.lit(1)).alias("features"),
        F.avg("ks_statistic").alias("mean_ks"),
        F.max("ks_statistic").alias("max_ks"),
        F.percentile("ks_statistic", 0.5).alias("median_ks"),
        F.avg("psi").alias("mean_psi"),
    )


def standardised_difference(a: str, b: str) -> Column:
    pooled = F.sqrt((F.col(f"var_{a}") + F.col(f"var_{b}")) / 2.0)
    return F.when(pooled > 0, (F.col(f"mean_{a}") - F.col(f"mean_{b}")) / pooled).otherwise(0.0)


def mutual_information(table: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(feature, mutual_information) between decile bins of a feature and the class."""
    everything = table.withColumns({"c_all": sum(F.col(f"c_{g}") for g in groups), "t_all": sum(F.col(f"t_{g}") for g in groups)})
    edges = everything.groupBy("feature").agg(F.array(*[ed.quantile("all", p) for p in DECILES]).alias("edges"))
    edges = edges.select("feature", inner_edges(F.col("edges")).alias("_in"))
    counts = (
        everything.join(edges, "feature")
        .groupBy("feature", bin_by_edges(F.col("value"), F.col("_in"), right_closed=False).alias("_bin"))
        .agg(*[F.sum(f"n_{g}").alias(f"n_{g}") for g in groups], *[F.max(f"t_{g}").alias(f"t_{g}") for g in groups])
    )
    n = sum(F.col(f"t_{g}") for g in groups).cast("double")
    row = sum(F.col(f"n_{g}") for g in groups)
    parts = [F.when(F.col(f"n_{g}") > 0, F.col(f"n_{g}") / n * F.ln(F.col(f"n_{g}") * n / (row * F.col(f"t_{g}")))).otherwise(0.0) for g in groups]
    return counts.groupBy("feature").agg(F.sum(sum(parts)).alias("mutual_information"))


CLASS_GROUPS = {"sell": 0, "buy": 1, "none": 2}


def class_separability(df: DataFrame, features: Sequence[str], *, target: str = "target", cells: int | None = None) -> DataFrame:
    """Per feature: mutual information, SMD and AUC of buy against sell and against none."""
    groups = {g: F.col(target) == k for g, k in CLASS_GROUPS.items()}
    rows = df.where(F.col(target).isin(0, 1, 2))
    table = _table(rows, features, groups, [target], cells)
    aucs = table.groupBy("feature").agg(
        ed.auc("buy", "sell").alias("buy_vs_sell_auc"), ed.auc("buy", "none").alias("buy_vs_no_trade_auc")
    )
    m = moments(rows, features, groups).select(
        "feature",
        standardised_difference("buy", "sell").alias("buy_vs_sell_smd"),
        standardised_difference("buy", "none").alias("buy_vs_no_trade_smd"),
    )
    out = aucs.join(m, "feature").join(mutual_information(table, list(groups)), "feature")
    return out.withColumns({f"{c}_separability_auc": F.greatest(F.col(f"{c}_auc"), 1.0 - F.col(f"{c}_auc")) for c in ("buy_vs_sell", "buy_vs_no_trade")})


PAIRS = (("buy", "none", "BUY_vs_NO_TRADE"), ("sell", "none", "SELL_vs_NO_TRADE"), ("buy", "sell", "BUY_vs_SELL"))


def pairwise_separation(df: DataFrame, features: Sequence[str], *, splits: Sequence[str] = ("train", "validation"), split: str = "split", target: str = "target", cells: int | None = None) -> DataFrame:
    """KS and robust median effect for every feature, class pair and split.

    All classes of all splits are counted in one distribution table.
    """
    groups = {f"{s}_{g}": (F.col(split) == s) & (F.col(target) == k) for s in splits for g, k in CLASS_GROUPS.items()}
    rows = df.where(F.col(split).isin(*splits))
    table = _table(rows, features, groups, [split, target], cells)
    pairs = [(s, f"{s}_{a}", f"{s}_{b}", name) for s in splits for a, b, name in PAIRS]
    table = table.withColumns(
        {
            **{f"c_{a}__{b}": F.col(f"c_{a}") + F.col(f"c_{b}") for _, a, b, _ in pairs},
            **{f"t_{a}__{b}": F.col(f"t_{a}") + F.col(f"t_{b}") for _, a, b, _ in pairs},
        }
    )
    stats = [c for g in groups for c in (ed.quantile(g, 0.5).alias(f"med_{g}"), F.max(f"t_{g}").alias(f"size_{g}"))]
    for _, a, b, _ in pairs:
        u = f"{a}__{b}"
        stats += [ed.ks(a, b).alias(f"ks_{u}"), (ed.quantile(u, 0.75) - ed.quantile(u, 0.25)).alias(f"iqr_{u}")]
    wide = table.groupBy("feature").agg(*stats)
    entries = []
    for s, a, b, name in pairs:
        u = f"{a}__{b}"
        gap = F.abs(F.col(f"med_{a}") - F.col(f"med_{b}"))
        entries.append(
            F.struct(
                F.lit(s).alias("split"),
                F.lit(name).alias("comparison"),
                F.col(f"size_{a}").alias("left_count"),
                F.col(f"size_{b}").alias("right_count"),
                F.col(f"ks_{u}").alias("ks_statistic"),
                F.when(F.col(f"iqr_{u}") == 0, gap).otherwise(gap / F.nullif(F.col(f"iqr_{u}"), F.lit(0.0))).alias("absolute_median_iqr_effect"),
            )
        )
    out = wide.select("feature", F.explode(F.array(*entries)).alias("_e")).select("feature", "_e.*")
    return out.withColumn("ks_pvalue", ed.ks_pvalue(F.col("ks_statistic"), F.col("left_count"), F.col("right_count")))


def separation_summary(separation: DataFrame, *, keys: Sequence[str] = ("split", "comparison"), top: int = 5) -> DataFrame:
    """Per split and pair: median/max KS, how many features reach 0.1, the best features."""
    ranked = F.sort_array(F.collect_list(F.struct(F.col("ks_statistic"), F.col("feature"))), asc=False)
    return separation.groupBy(*keys).agg(
        F.percentile("ks_statistic", 0.5).alias("median_ks"),
        F.max("ks_statistic").alias("max_ks"),
        F.count_if(F.col("ks_statistic") >= 0.1).alias("features_ks_at_least_0_1"),
        F.array_join(F.transform(F.slice(ranked, 1, top), lambda x: x["feature"]), ",").alias("top_features"),
        F.percentile("absolute_median_iqr_effect", 0.5).alias("median_absolute_median_iqr_effect"),
    )


def concentration(importances: DataFrame, *, keys: Sequence[str] = (), value: str = "importance") -> DataFrame:
    """Top shares, Herfindahl index and normalised entropy of importances."""
    total = importances.groupBy(*keys).agg(
        F.sum(value).alias("_t"),
        F.max(value).alias("_m1"),
        F.sum(F.col(value) * F.col(value)).alias("_sq"),
        F.sum(F.when(F.col(value) > 0, F.col(value) * F.ln(F.col(value)))).alias("_xlx"),
        F.count(F.lit(1)).alias("_n"),
        F.slice(F.sort_array(F.collect_list(value), asc=False), 1, 2).alias("_two"),
    )
    t = F.col("_t")
    return total.select(
        *keys,
        (F.col("_m1") / F.nullif(t, F.lit(0.0))).alias("top1_share"),
        (F.aggregate("_two", F.lit(0.0), lambda a, x: a + x) / F.nullif(t, F.lit(0.0))).alias("top2_share"),
        (F.col("_sq") / F.nullif(t * t, F.lit(0.0))).alias("herfindahl"),
        (-(F.col("_xlx") / F.nullif(t, F.lit(0.0)) - F.ln(t)) / F.nullif(F.ln(F.col("_n")), F.lit(0.0))).alias("normalised_entropy"),
    )
