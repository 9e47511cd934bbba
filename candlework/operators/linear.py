"""Many linear models from few passes: one-feature logistic fits together, and fold-additive least squares."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as mt
from .staging import stage

MAX_STEPS = 25


def long_features(rows: DataFrame, features: Sequence[str], label: str, *, undefined: bool = False) -> DataFrame:
    """(feature, x, y), a row per feature of every row; missing values are left out, NaN too unless ``undefined``."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return rows.select(F.explode(entries).alias("_e"), F.col(label).cast("double").alias("y")).select("_e.*", "y").where("x IS NOT NULL AND y IS NOT NULL" + ("" if undefined else " AND NOT isnan(x)"))


def single_feature_fits(rows: DataFrame, features: Sequence[str], *, label: str, steps: int = MAX_STEPS, tolerance: float = 1e-9, undefined: bool = False) -> DataFrame:
    """(feature, rows, mean, std, intercept, slope, gradient) of a logistic model per feature, on the standardised feature.

    All features take their Newton steps together: a step is one grouped aggregate of gradient and Hessian over the long
    table, and its five sums per feature are all that is held.  A constant feature keeps slope 0.  Steps end when no mean gradient is
    above ``tolerance``, or after ``steps`` (a feature that separates the classes has no finite fit).  ``gradient`` is the
    larger mean gradient at the coefficients returned.

    A feature with an infinite value (with ``undefined``, or NaN) has no mean to be standardised by, so it has no fit: intercept NaN, slope 0 and
    no gradient.
    """
    spark = rows.sparkSession
    long = stage(long_features(rows, features, label, undefined=undefined))
    sizes = {r["feature"]: r for r in long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).collect()}
    now = {f: (0.0, 0.0) for f, r in sizes.items() if math.isfinite(r["mean"])}
    schema = "feature string, mean double, std double, b0 double, b1 double"
    left: dict[str, float] = {}
    for step in range(steps + 1 if now else 0):
        model = spark.createDataFrame([(f, sizes[f]["mean"], sizes[f]["std"], *b) for f, b in now.items()], schema)
        z = F.when(F.col("std") > 0, (F.col("x") - F.col("mean")) / F.col("std")).otherwise(0.0)
        at = long.join(F.broadcast(model), "feature").select("feature", "y", z.alias("z"), (1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * z)))).alias("p"))
        g, w = F.col("y") - F.col("p"), F.col("p") * (1 - F.col("p"))
        sums = at.groupBy("feature").agg(F.sum(g).alias("g0"), F.sum(g * F.col("z")).alias("g1"), F.sum(w).alias("h00"), F.sum(w * F.col("z")).alias("h01"), F.sum(w * F.col("z") * F.col("z")).alias("h11"))
        found = {r["feature"]: r for r in sums.collect()}
        left = {f: max(abs(r["g0"]), abs(r["g1"])) / sizes[f]["n"] for f, r in found.items()}
        if step == steps or max(left.values(), default=0.0) <= tolerance:
            break
        for f, r in found.items():
            if left[f] > tolerance:
                now[f] = newton(now[f], r)
    out = [(f, r["n"], r["mean"], r["std"], *now.get(f, (math.nan, 0.0)), left.get(f)) for f, r in sizes.items()]
    return spark.createDataFrame(out, "feature string, rows long, mean double, std double, intercept double, slope double, gradient double")


def newton(at: tuple[float, float], sums) -> tuple[float, float]:
    det = sums["h00"] * sums["h11"] - sums["h01"] * sums["h01"]
    if not det > 1e-12 * sums["h00"] * sums["h00"]:
        return (at[0] + sums["g0"] / sums["h00"], at[1]) if sums["h00"] > 0 else at
    return at[0] + (sums["h11"] * sums["g0"] - sums["h01"] * sums["g1"]) / det, at[1] + (sums["h00"] * sums["g1"] - sums["h01"] * sums["g0"]) / det


def single_feature_scores(fits: DataFrame, rows: DataFrame, features: Sequence[str], *, label: str) -> DataFrame:
    """(feature, y, score) of every row under every feature's model."""
    z = F.when(F.col("std") > 0, (F.col("x") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return long_features(rows, features, label).join(F.broadcast(fits), "feature").select("feature", F.col("y").cast("int").alias("y"), (1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * z)))).alias("score"))


def fold_grams(rows: DataFrame, features: Sequence[str], *, label: str, segment: str) -> dict[int, list[list[float]]]:
    """Per segment the products of (1, features, label) with one another, summed over its rows.

    One pass: every task adds its batches to a small matrix per segment, and these are added up by segment and place.
    Segments and features are few; their matrices are all that reaches the driver.  Rows with a missing value are left out.
    """
    size = len(features) + 2

    def summed(batches):
        import numpy as np
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[batch.column(c).to_numpy(zero_copy_only=False) for c in [*features, label]]])
            own = batch.column(segment).to_numpy(zero_copy_only=False)
            for s in np.unique(own):
                part = x[own == s]
                total[int(s)] = total.get(int(s), 0) + part.T @ part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([m.ravel().tolist() for m in total.values()], pa.list_(pa.float64()))], names=["segment", "cells"])

    narrow = rows.select(F.col(segment).cast("int").alias(segment), *[F.col(c).cast("double").alias(c) for c in [*features, label]]).na.drop()
    narrow = narrow.where(" AND ".join(f"NOT isnan(`{c}`)" for c in [*features, label]))
    cells = narrow.mapInArrow(summed, "segment int, cells array<double>").select("segment", F.posexplode("cells").alias("at", "v"))
    out: dict[int, list[list[float]]] = {}
    for r in cells.groupBy("segment", "at").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["segment"], [[0.0] * size for _ in range(size)])[r["at"] // size][r["at"] % size] = r["v"]
    return out


def solved(gram, chosen: Sequence[int], ridge: float = 1e-9) -> tuple[float, list[float]]:
    """Intercept and coefficients of the label on the chosen columns, from a matrix of products."""
    import numpy as np

    g = np.array(gram)
    n, sums = g[0, 0], g[0]
    mean = sums / n
    cov = g / n - np.outer(mean, mean)
    keep = [k for k in chosen if cov[k, k] > 1e-12 * max(1.0, mean[k] ** 2)]
    beta = np.zeros(len(chosen))
    if keep:
        std = np.sqrt(cov[keep, keep])
        corr = cov[np.ix_(keep, keep)] / np.outer(std, std)
        got = np.linalg.solve(corr + ridge * np.eye(len(keep)), cov[keep, -1] / std) / std
        beta[[list(chosen).index(k) for k in keep]] = got
    return float(mean[-1] - beta @ mean[list(chosen)]), beta.tolist()


def fold_ablation(indexed: DataFrame, treatments: dict[str, Sequence[str]], *, label: str, n_splits: int = 5, index: str = "bar_index", total: str = "n_rows") -> DataFrame:
    """(treatment, fold, metric, value): least-squares scores of every feature subset on every walk-forward fold.

    The series is cut into the first training stretch and the test windows.  Each stretch's products are summed once; the
    training products of a fold are those of all stretches before its window, so any number of folds and subsets takes one
    pass to fit and one to score.  A subset without features is the training share of the label (the majority baseline).
    """
    features = list(dict.fromkeys(f for names in treatments.values() for f in names))
    size = F.floor(F.col(total) / (n_splits + 1))
    from_end = F.col(total) - F.col(index)  # 1 is the last row
    segment = F.greatest(F.lit(0), n_splits + 1 - F.ceil(from_end / size)).cast("int")
    rows = stage(indexed.select(*features, label, segment.alias("_segment")))
    grams = fold_grams(rows, features, label=label, segment="_segment")
    models, running = [], None
    for fold in range(1, n_splits + 1):
        before = grams.get(fold - 1)
        if before is not None:
            running = before if running is None else [[a + b for a, b in zip(x, y)] for x, y in zip(running, before)]
        if running is None:
            continue
        for name, names in treatments.items():
            intercept, beta = solved(running, [features.index(f) + 1 for f in names])
            by_name = dict(zip(names, beta))
            models.append((name, fold, intercept, [by_name.get(f, 0.0) for f in features]))
    model = rows.sparkSession.createDataFrame(models, "treatment string, fold int, intercept double, beta array<double>")
    values = F.array(*[F.col(f).cast("double") for f in features])
    test = rows.na.drop().select(F.col("_segment").alias("fold"), F.col(label).cast("int").alias("y"), values.alias("_x")).where("fold > 0")
    linear = F.col("intercept") + F.aggregate(F.zip_with("_x", "beta", lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v)
    scored = stage(test.join(F.broadcast(model), "fold").select("treatment", "fold", "y", F.greatest(F.lit(0.0), F.least(F.lit(1.0), linear)).alias("score")))
    wide = mt.binary_metrics(scored, actual="y", score="score", keys=["treatment", "fold"])
    return mt.melt(wide, ["accuracy", "balanced_accuracy", "macro_f1", "roc_auc", "brier_score"], keys=["treatment", "fold"])


