"""Classification, ranking and calibration metrics as tidy tables.

Every metric comes from one conditional aggregation (confusion counts, means)
or from distribution rows (AUC, average precision), per any set of keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bins
from ..functions.scalar import direction_score
from . import ecdf as ed
from .labels import CLASS_NAMES
from .series import same
from .staging import stage

CLASSES = (0, 1, 2)


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _mean(parts: Sequence[Column]) -> Column:
    return sum(parts) / len(parts)


def confusion(df: DataFrame, *, keys: Sequence[str] = (), actual: str = "target", predicted: str = "predicted", classes: Sequence[int] = CLASSES) -> DataFrame:
    """One row per key with a count ``n_<actual>_<predicted>`` for every pair."""
    a, p = F.col(actual), F.col(predicted)
    return df.groupBy(*keys).agg(*[F.count_if((a == i) & (p == j)).alias(f"n_{i}_{j}") for i in classes for j in classes])


def confusion_long(wide: DataFrame, *, keys: Sequence[str] = (), classes: Sequence[int] = CLASSES) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(i).alias("actual"), F.lit(j).alias("predicted"), F.col(f"n_{i}_{j}").alias("count")) for i in classes for j in classes]
    )
    return wide.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def _margins(classes: Sequence[int]) -> tuple[dict, dict, dict, Column]:
    hit = {k: F.col(f"n_{k}_{k}") for k in classes}
    support = {k: sum(F.col(f"n_{k}_{j}") for j in classes) for k in classes}
    emitted = {k: sum(F.col(f"n_{i}_{k}") for i in classes) for k in classes}
    return hit, support, emitted, sum(support.values())


def class_scores(classes: Sequence[int] = CLASSES) -> dict[str, Column]:
    """Precision, recall, F1 and support per class, over a confusion row."""
    hit, support, emitted, n = _margins(classes)
    out = {}
    for k in classes:
        out[f"precision_{k}"] = _div(hit[k], emitted[k])
        out[f"recall_{k}"] = _div(hit[k], support[k])
        out[f"f1_{k}"] = _div(2.0 * hit[k], emitted[k] + support[k])
        out[f"support_{k}"] = support[k].cast("double")
        out[f"predicted_pct_{k}"] = _div(100.0 * emitted[k], n)
    return out


def summary_scores(classes: Sequence[int] = CLASSES) -> dict[str, Column]:
    hit, support, emitted, n = _margins(classes)
    present = sum(F.when(support[k] > 0, 1).otherwise(0) for k in classes)
    recalls = sum(_div(hit[k], support[k]) for k in classes)
    f1 = [_div(2.0 * hit[k], emitted[k] + support[k]) for k in classes]
    return {
        "accuracy": _div(sum(hit.values()), n),
        "balanced_accuracy": _div(recalls, present),
        "macro_f1": _mean(f1),
        "weighted_precision": _div(sum(support[k] * _div(hit[k], emitted[k]) for k in classes), n),
        "weighted_recall": _div(sum(hit.values()), n),
        "weighted_f1": _div(sum(support[k] * f for k, f in zip(classes, f1)), n),
    }


def direction_scores() -> dict[str, Column]:
    """The buy/sell view of a three-class confusion row."""
    hit, support, emitted, n = _margins(CLASSES)
    traded = support[0] + support[1]
    return {
        "accuracy_on_actual_buy_sell_rows": _div(hit[0] + hit[1], traded),
        "actual_directional_row_count": traded.cast("double"),
        "predicted_buy_sell_pct": _div(100.0 * (emitted[0] + emitted[1]), n),
        "predicted_no_trade_pct": _div(100.0 * emitted[2], n),
    }


def melt(wide: DataFrame, names: Sequence[str], *, keys: Sequence[str] = (), name: str = "metric") -> DataFrame:
    """Long (keys, metric, value) from a metric row."""
    parts = F.array(*[F.struct(F.lit(n).alias(name), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select(*keys, F.explode(parts).alias("_m")).select(*keys, "_m.*")


def classification_report(df: DataFrame, *, keys: Sequence[str] = (), actual: str = "target", predicted: str = "predicted", classes: Sequence[int] = CLASSES) -> DataFrame:
    wide = confusion(df, keys=keys, actual=actual, predicted=predicted, classes=classes)
    made = {**summary_scores(classes), **class_scores(classes)}
    if tuple(classes) == CLASSES:
        made |= direction_scores()
    return melt(wide.select(*keys, *[v.alias(k) for k, v in made.items()]), list(made), keys=keys)


def score_table(df: DataFrame, positive: Column, score: str, *, keys: Sequence[str] = (), cells: int | None = None) -> DataFrame:
    """Distribution rows of a score with groups ``pos`` and ``neg``; the scores are stored once."""
    rows = stage(df.select(*keys, F.col(score).alias("value"), positive.alias("_pos")))
    rows = rows.withColumn("cell", ed.value_cells(rows, ["value"], cells)["value"][0])
    return ed.ecdf(rows, {"pos": F.col("_pos"), "neg": ~F.col("_pos")}, keys=list(keys))


def ranking_metrics(df: DataFrame, positive: Column, score: str, *, keys: Sequence[str] = (), cells: int | None = None) -> DataFrame:
    """ROC-AUC and average precision per key (NULL when a class is missing)."""
    table = score_table(df, positive, score, keys=keys, cells=cells)
    both = (F.max("t_pos") > 0) & (F.max("t_neg") > 0)
    return table.groupBy(*keys).agg(
        F.when(both, ed.auc("pos", "neg")).alias("roc_auc"), F.when(both, ed.average_precision("pos", "neg")).alias("pr_auc")
    )


def one_vs_rest_auc(df: DataFrame, scores: dict[int, str], *, target: str = "target", cells: int | None = None) -> DataFrame:
    """AUC of every class score against the rest, and their mean."""
    names = list(scores.values())
    label = F.create_map(*[x for k, n in scores.items() for x in (F.lit(n), F.lit(k))])
    long = ed.unpivot(df, names, keep=[target], cells=ed.value_cells(df, names, cells))
    own = F.col(target) == label[F.col("feature")]
    per = ed.ecdf(long, {"pos": own, "neg": ~own}).groupBy("feature").agg(ed.auc("pos", "neg").alias("roc_auc"))
    mean = per.agg(F.lit("macro").alias("feature"), F.avg("roc_auc").alias("roc_auc"))
    return per.unionByName(mean)


def binary_metrics(df: DataFrame, *, actual: str, score: str, threshold: float = 0.5, keys: Sequence[str] = (), cells: int | None = None) -> DataFrame:
    """Threshold metrics, Brier, log loss, score spread, ROC-AUC and average precision."""
    y, p = F.col(actual), F.col(score)
    hat = (p >= threshold).cast("int")
    safe = F.greatest(F.lit(1e-15), F.least(F.lit(1.0 - 1e-15), p))
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(y).alias("positive_count"),
        *[F.count_if((y == i) & (hat == j)).alias(f"n_{i}_{j}") for i in (0, 1) for j in (0, 1)],
        F.avg(F.pow(p - y, F.lit(2.0))).alias("brier_score"),
        F.avg(F.when(y == 1, -F.ln(safe)).otherwise(-F.ln(1.0 - safe))).alias("log_loss"),
        F.avg(p).alias("score_mean"),
        F.stddev_pop(p).alias("score_std"),
        (100.0 * F.avg(p.between(0.45, 0.55).cast("double"))).alias("near_half_pct"),
    )
    scores = class_scores((0, 1))
    base = wide.select(
        *keys,
        "rows",
        "positive_count",
        (F.col("positive_count") / F.col("rows")).alias("prevalence"),
        *[summary_scores((0, 1))[m].alias(m) for m in ("accuracy", "balanced_accuracy", "macro_f1")],
        *[scores[f"{m}_1"].alias(m) for m in ("precision", "recall", "f1")],
        "brier_score",
        "log_loss",
        "score_mean",
        "score_std",
        "near_half_pct",
    )
    ranks = ranking_metrics(df, y == 1, score, keys=keys, cells=cells)
    if keys:
        return same(base, ranks, keys)
    one = F.lit(1)
    return base.withColumn("_one", one).join(ranks.withColumn("_one", one), "_one").drop("_one")


def calibration(df: DataFrame, bin_column: Column, *, actual: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean score and observed rate per bin."""
    return (
        df.withColumn("bin", bin_column)
        .where(F.col("bin").isNotNull())
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(score).alias("mean_score"),
            F.avg(F.col(actual).cast("double")).alias("observed_rate"),
        )
    )


def uniform_bins(score: str, n: int = 10, *, right_closed: bool = True) -> Column:
    """Equal-width bins of [0, 1]; both ends always belong to a bin."""
    edges = [k / n for k in range(n + 1)]
    if right_closed:
        return bins.bin_right_closed(F.col(score), edges, list(range(n)), include_lowest=True)
    return bins.bin_left_closed(F.col(score), edges, list(range(n)), include_highest=True)


def quantile_calibration(df: DataFrame, *, actual: str, score: str, n: int = 10, keys: Sequence[str] = (), cells: int | None = None) -> DataFrame:
    """Calibration in equal-frequency bins with exact quantile edges (right-closed)."""
    from .tables import exact_quantiles

    edges = exact_quantiles(df, [score], [k / n for k in range(n + 1)], keys=keys, cells=cells)
    inner = edges.select(*keys, F.lit(1).alias("_one"), F.slice("edges", 2, n - 1).alias("_in"))
    placed = same(df.withColumn("_one", F.lit(1)), inner, [*keys, "_one"])
    return calibration(placed, bins.bin_by_edges(F.col(score), F.col("_in"), right_closed=True), actual=actual, score=score, keys=keys)


def three_views(df: DataFrame, *, keys: Sequence[str] = (), target: str = "target", predicted: str = "predicted", buy: str = "buy_proba", sell: str = "sell_proba", none: str = "no_trade_proba") -> DataFrame:
    """Activity filter, direction and emitted-trade quality of a three-class model."""
    t, p = F.col(target), F.col(predicted)
    rows = df.withColumns({"_act": 1.0 - F.col(none), "_dir": direction_score(F.col(buy), F.col(sell))})
    traded, emitted, right = t != 2, p != 2, (p == t) & (t != 2) & (p != 2)
    wide = rows.groupBy(*keys).agg(
        F.avg((t == p).cast("double")).alias("multiclass_accuracy"),
        F.avg((traded == emitted).cast("double")).alias("filter_accuracy"),
        _div(F.count_if(traded & emitted), F.count_if(emitted)).alias("filter_precision"),
        _div(F.count_if(traded & emitted), F.count_if(traded)).alias("filter_recall"),
        F.count_if(traded).alias("directional_rows"),
        _div(F.count_if(traded & ((t == 1) == (p == 1))), F.count_if(traded)).alias("direction_accuracy"),
        F.count_if(emitted).alias("emitted_rows"),
        (100.0 * F.avg(emitted.cast("double"))).alias("emitted_pct"),
        F.count_if(right).alias("correct_direction_count"),
        _div(F.count_if(right), F.count_if(emitted)).alias("correct_direction_precision"),
    )
    act = ranking_metrics(rows, traded, "_act", keys=keys).select(*keys, F.col("roc_auc").alias("filter_roc_auc"))
    way = ranking_metrics(rows.where(traded), t == 1, "_dir", keys=keys).select(*keys, F.col("roc_auc").alias("direction_roc_auc"))
    return same(same(wide, act, keys, "left"), way, keys, "left") if keys else wide.join(act).join(way)


def direction_metrics(df: DataFrame, *, keys: Sequence[str] = (), target: str = "target", buy: str = "buy_proba", sell: str = "sell_proba") -> DataFrame:
    """Conditional buy-against-sell metrics on rows whose class is buy or sell."""
    rows = df.where(F.col(target).isin(0, 1)).withColumn("_score", direction_score(F.col(buy), F.col(sell)))
    return binary_metrics(rows, actual=target, score="_score", keys=keys)


def combination_metrics(df: DataFrame, *, keys: Sequence[str] = (), target: str = "target", buy: str = "buy_proba", sell: str = "sell_proba", threshold: float = 0.5) -> DataFrame:
    """Two binary models read together: dominance rates over all rows."""
    b, s = F.col(buy), F.col(sell)
    return df.groupBy(*keys).agg(
        F.count_if(F.col(target) != 2).alias("actual_directional_rows"),
        F.avg((b > s).cast("double")).alias("buy_dominates_rate"),
        F.avg(((b < threshold) & (s < threshold)).cast("double")).alias("neither_dominates_rate"),
        F.avg(b).alias("mean_buy_probability"),
        F.avg(s).alias("mean_sell_probability"),
        F.corr(b, s).alias("probability_correlation"),
    )


def probability_summary(df: DataFrame, score: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """min, p10, p25, median, p75, p90, max of a probability, exact."""
    from .tables import exact_quantiles

    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    names = ["min", "p10", "p25", "median", "p75", "p90", "max"]
    q = exact_quantiles(df, [score], probs, keys=keys)
    return q.select(*keys, "feature", *[F.col("edges")[k].alias(n) for k, n in enumerate(names)])


def signal_report(df: DataFrame, *, keys: Sequence[str] = (), signal: str = "signal") -> DataFrame:
    """Counts and shares of emitted signals with mean and maximum probabilities."""
    s = F.col(signal)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(s == 1).alias("buy_signals"),
        F.count_if(s == -1).alias("sell_signals"),
        F.count_if(s == 0).alias("no_trade_signals"),
        F.avg((s == 1).cast("double")).alias("buy_ratio"),
        F.avg((s == -1).cast("double")).alias("sell_ratio"),
        F.avg("buy_proba").alias("mean_buy_proba"),
        F.avg("sell_proba").alias("mean_sell_proba"),
        F.max("buy_proba").alias("max_buy_proba"),
        F.max("sell_proba").alias("max_sell_proba"),
    )


def majority_baseline(df: DataFrame, *, keys: Sequence[str] = (), target: str = "target") -> DataFrame:
    """Metrics of always predicting the most common class (lowest code on ties)."""
    t = F.col(target)
    counts = df.groupBy(*keys).agg(*[F.count_if(t == k).alias(f"_c{k}") for k in CLASSES])
    n = sum(F.col(f"_c{k}") for k in CLASSES)
    best = F.greatest(*[F.col(f"_c{k}") for k in CLASSES])
    pick = F.when(F.col("_c0") == best, 0).when(F.col("_c1") == best, 1).otherwise(2)
    share = best / n
    present = sum(F.when(F.col(f"_c{k}") > 0, 1).otherwise(0) for k in CLASSES)
    return counts.select(
        *keys,
        pick.alias("majority_class"),
        share.alias("accuracy"),
        (F.lit(1.0) / present).alias("balanced_accuracy"),
        (2.0 * share / (1.0 + share) / len(CLASSES)).alias("macro_f1"),
    )


def prior_baseline(df: DataFrame, *, row_key: Sequence[str], runs: int = 20, seed: int = 42, target: str = "target") -> DataFrame:
    """Average metrics of ``runs`` random predictions drawn from the class priors.

    A draw is a hash of (seed, run, row key), so it does not depend on how rows
    are partitioned.  Only its digest is made per row and run: shares are
    compared as digits of the hash.  All runs are counted in one aggregation.
    """
    t = F.col(target)
    priors = df.agg(*[F.avg((t == k).cast("double")).alias(f"_p{k}") for k in (0, 1)]).first()
    p0, p1 = float(priors[0] or 0.0), float(priors[1] or 0.0)
    # The row's part of the hashed name is put together once, before the runs are made.
    named = df.select(target, F.concat_ws("|", F.lit(""), *[F.col(c).cast("string") for c in row_key]).alias("_row"))
    starts = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(f"{seed}|{r}").alias("start")) for r in range(runs)])
    digest = F.md5(F.concat("_d.start", "_row").cast("binary")).alias("_digest")
    drawn = named.select(target, "_row", F.explode(starts).alias("_d")).select(target, F.col("_d.run").alias("run"), digest)
    guess = F.when(hash_below("_digest", p0), 0).when(hash_below("_digest", p0 + p1), 1).otherwise(2)
    report = drawn.select(target, "run", guess.alias("predicted"))
    wide = confusion(report, keys=["run"], actual=target)
    made = summary_scores()
    per_run = wide.select("run", *[made[m].alias(m) for m in ("accuracy", "balanced_accuracy", "macro_f1")])
    return per_run.agg(F.count(F.lit(1)).alias("runs"), *[F.avg(m).alias(m) for m in ("accuracy", "balanced_accuracy", "macro_f1")])


def hash_below(digest: str, share: float) -> Column:
    """Whether the first 32 bits of an MD5 in hex, as a uniform number in [0, 1), lie below ``share``."""
    first = math.ceil(share * (1 << 32))
    return F.lit(True) if first >= 1 << 32 else F.col(digest) < F.lit(f"{max(first, 0):08x}")


def class_label(c: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in CLASS_NAMES.items() for x in (F.lit(k), F.lit(v))]), c)


def compare_models(metrics: DataFrame, *, baseline: str, model: str = "model", metric: str = "metric", value: str = "value") -> DataFrame:
    """Every model's metric next to the baseline's, with the difference."""
    base = metrics.where(F.col(model) == baseline).select(metric, F.col(value).alias("baseline_value"))
    return metrics.join(base, metric, "left").withColumn("difference", F.col(value) - F.col("baseline_value"))


def fold_summary(metrics: DataFrame, *, keys: Sequence[str] = ("treatment", "metric"), value: str = "value", sample: bool = False) -> DataFrame:
    """Mean, deviation (population unless ``sample``), min and max over folds."""
    dev = F.stddev_samp if sample else F.stddev_pop
    return metrics.groupBy(*keys).agg(
        F.avg(value).alias("mean"), dev(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("folds")
    )


def verdict(metrics: DataFrame, rules: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """First verdict whose conditions all hold.

    ``metrics`` is (keys, metric, value); ``rules`` is (priority, verdict,
    metric, op, threshold) with one row per condition, op one of
    ``>= > <= < = !=``.  A rule with a missing metric does not hold.
    """
    v, lim, op = F.col("value"), F.col("threshold"), F.col("op")
    ok = (
        F.when(op == ">=", v >= lim).when(op == ">", v > lim).when(op == "<=", v <= lim)
        .when(op == "<", v < lim).when(op == "=", v == lim).when(op == "!=", v != lim)
    )
    sizes = rules.groupBy("priority", "verdict").agg(F.count(F.lit(1)).alias("_need"))
    met = metrics.join(rules, "metric").withColumn("_ok", F.coalesce(ok, F.lit(False)))
    held = met.groupBy(*keys, "priority", "verdict").agg(F.count_if("_ok").alias("_held")).join(sizes, ["priority", "verdict"])
    return held.where(F.col("_held") == F.col("_need")).groupBy(*keys).agg(F.min_by("verdict", "priority").alias("verdict"))
