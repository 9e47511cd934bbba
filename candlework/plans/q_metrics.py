"""Queries for two-sample statistics, class metrics and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bins
from ..functions.scalar import activity_score, decide_signal, direction_score, signal_probability, threshold_signal
from ..operators import metrics as mt
from ..operators import price_features as pf
from ..operators import splits as sp
from ..operators import tables as tb
from ..operators import twosample as ts
from ..operators.staging import stage
from .inputs import SCORED_ORDER, SCORED_SPLIT_SQL, SCORED_SQL, bars, scored
from .q_features import FEATURES_ALL_SQL, FEATURES_OR_NULL_SQL
from .q_tables import scored_cells, scored_split
from .registry import query, rounded

NUMBERS = ["quantity", "extendedprice", "discount", "tax"]
LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value, split, target FROM split_rows" for f in NUMBERS) + ")"


def study_split(spark, sf_dir):
    """Split rows stored once: the two-sample statistics read them several times."""
    rows = scored(spark, sf_dir).withColumn("symbol", F.lit("ALL"))
    time, band = scored_cells()
    return stage(sp.split_labels(rows, by=["symbol"], order=SCORED_ORDER, cell=time, inner=[band]).select("split", "target", *NUMBERS))


def ks_sql(cond_a: str, cond_b: str, keys: str = "feature", source: str = "long") -> str:
    """(keys, ks, w1, n, m) from running shares over distinct values."""
    return f"""SELECT {keys}, max(abs(fa - fb)) AS ks, coalesce(sum(abs(fa - fb) * (nx - value)), 0) AS w1, max(ta) AS n, max(tb) AS m FROM (
      SELECT {keys}, value, sum(na) OVER (PARTITION BY {keys} ORDER BY value) / sum(na) OVER (PARTITION BY {keys}) AS fa,
        sum(nb) OVER (PARTITION BY {keys} ORDER BY value) / sum(nb) OVER (PARTITION BY {keys}) AS fb,
        sum(na) OVER (PARTITION BY {keys}) AS ta, sum(nb) OVER (PARTITION BY {keys}) AS tb, lead(value) OVER (PARTITION BY {keys} ORDER BY value) AS nx
      FROM (SELECT {keys}, value, CAST(count(*) FILTER (WHERE {cond_a}) AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE {cond_b}) AS DOUBLE) AS nb
            FROM {source} WHERE ({cond_a}) OR ({cond_b}) GROUP BY {keys}, value)) GROUP BY {keys}"""


PVALUE_SQL = """least(1.0, greatest(0.0, 2 * (SELECT sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * lam * lam * j * j)) FROM (SELECT unnest(generate_series(1, 100)) AS j))))"""


@query(
    "drift_features",
    "feature:s family:s ks_statistic:d psi:d wasserstein:d4 wasserstein_train_std_units:d train_mean:d4 validation_mean:d4 train_std:d4 validation_std:d4",
    f"""WITH {SCORED_SPLIT_SQL}, {LONG_SQL}, k AS ({ks_sql("split = 'train'", "split = 'validation'")}),
    e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM long WHERE split = 'train' GROUP BY 1),
    b AS (SELECT feature, split, len(list_filter(q[2:len(q) - 1], lambda x: x <= value)) AS bin FROM long JOIN e USING (feature) WHERE split <> 'test'),
    c AS (SELECT feature, bin, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'validation') AS v FROM b GROUP BY 1, 2),
    p AS (SELECT feature, greatest(a / sum(a) OVER (PARTITION BY feature), 1e-6) AS pa, greatest(v / sum(v) OVER (PARTITION BY feature), 1e-6) AS pv FROM c),
    psi AS (SELECT feature, sum((pv - pa) * ln(pv / pa)) AS psi FROM p GROUP BY 1),
    m AS (SELECT feature, avg(value) FILTER (WHERE split = 'train') AS tm, avg(value) FILTER (WHERE split = 'validation') AS vm,
      stddev_pop(value) FILTER (WHERE split = 'train') AS tsd, stddev_pop(value) FILTER (WHERE split = 'validation') AS vsd FROM long GROUP BY 1)
    SELECT feature, 'price_level_or_scale_dependent' AS family, ks AS ks_statistic, psi, w1 AS wasserstein, w1 / tsd AS wasserstein_train_std_units, tm AS train_mean, vm AS validation_mean, tsd AS train_std, vsd AS validation_std
    FROM k JOIN psi USING (feature) JOIN m USING (feature)""",
)
def drift_features(spark, sf_dir):
    return ts.drift_table(study_split(spark, sf_dir), NUMBERS, family=pf.feature_family)


@query(
    "drift_family_rollup",
    "family:s features:l mean_ks:d median_ks:d max_ks:d",
    f"""WITH {SCORED_SPLIT_SQL}, {LONG_SQL}, k AS ({ks_sql("split = 'train'", "split = 'validation'")})
    SELECT 'price_level_or_scale_dependent' AS family, count(*) AS features, avg(ks) AS mean_ks, quantile_cont(ks, 0.5) AS median_ks, max(ks) AS max_ks FROM k""",
)
def drift_family_rollup(spark, sf_dir):
    return ts.family_rollup(drift_features(spark, sf_dir))


@query(
    "drift_top_features",
    "feature:s ks_statistic:d",
    f"""WITH {SCORED_SPLIT_SQL}, {LONG_SQL}, k AS ({ks_sql("split = 'train'", "split = 'validation'")})
    SELECT feature, ks AS ks_statistic FROM k ORDER BY ks DESC, feature LIMIT 2""",
)
def drift_top_features(spark, sf_dir):
    return tb.top_rows(drift_features(spark, sf_dir), "ks_statistic", 2, tie=["feature"])


def all_sql(features: str) -> str:
    """CTEs ending in ``long``: the features of every bar, one row per value."""
    return features.replace("WITH RECURSIVE ", "WITH RECURSIVE all_features AS (WITH RECURSIVE ", 1) + (
        "), study AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-26' THEN 'validation' ELSE 'test' END AS split, CASE WHEN close > open THEN 1 WHEN close < open THEN 0 ELSE 2 END AS target FROM all_features), long AS ("
        + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(CAST({f} AS DOUBLE), 9) AS value, split, target FROM study WHERE {f} IS NOT NULL" for f in pf.FEATURES)
        + ")"
    )


ALL_SQL = all_sql(FEATURES_ALL_SQL)


def feature_study(spark, sf_dir):
    """All 42 features, split by date, with the direction of the bar as class; stored once."""
    day = lambda d: F.lit(d).cast("timestamp")
    split = F.when(F.col("ts") < day("2024-01-20"), "train").when(F.col("ts") < day("2024-01-26"), "validation").otherwise("test")
    target = F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), 0).otherwise(2)
    rows = pf.price_features(bars(spark, sf_dir), extra=lambda df, w: df.withColumns({"split": split, "target": target}))
    return stage(rows.select("split", "target", *[rounded(F.col(f), 9).alias(f) for f in pf.FEATURES]))


@query(
    "drift_all_features",
    "feature:s ks_statistic:d4 train_mean:d4 validation_mean:d4",
    f"""{all_sql(FEATURES_OR_NULL_SQL)}, k AS ({ks_sql("split = 'train'", "split = 'validation'")}),
    m AS (SELECT feature, avg(value) FILTER (WHERE split = 'train') AS train_mean, avg(value) FILTER (WHERE split = 'validation') AS validation_mean FROM long GROUP BY 1)
    SELECT feature, CASE WHEN NOT isnan(ks) THEN ks END AS ks_statistic, train_mean, validation_mean FROM k JOIN m USING (feature)""",
)
def drift_all_features(spark, sf_dir):
    return ts.drift_table(feature_study(spark, sf_dir), list(pf.FEATURES), family=pf.feature_family)


@query(
    "separability_all_features",
    "feature:s split:s comparison:s ks_statistic:d4",
    f"""{ALL_SQL}, p AS ({" UNION ALL ".join(f"SELECT '{n}' AS comparison, q.* FROM ({ks_sql(f'target = {a}', f'target = {b}', 'feature, split')}) q WHERE split <> 'test'" for n, a, b in (("BUY_vs_NO_TRADE", 1, 2), ("SELL_vs_NO_TRADE", 0, 2), ("BUY_vs_SELL", 1, 0)))})
    SELECT feature, split, comparison, ks AS ks_statistic FROM p""",
)
def separability_all_features(spark, sf_dir):
    return ts.pairwise_separation(feature_study(spark, sf_dir), list(pf.FEATURES))


def auc_sql(pos: str, neg: str, keys: str = "feature", source: str = "long", value: str = "value") -> str:
    """Rank-sum AUC by average ranks over the rows of both classes."""
    part = f"PARTITION BY {keys} " if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}(sum(CASE WHEN y THEN rk ELSE 0 END) - CAST(sum(CAST(y AS INT)) AS DOUBLE) * (sum(CAST(y AS INT)) + 1) / 2.0)
        / (CAST(sum(CAST(y AS INT)) AS DOUBLE) * sum(CAST(NOT y AS INT))) AS auc
      FROM (SELECT {lead}y, rank() OVER ({part}ORDER BY v) + (count(*) OVER (PARTITION BY {lead}v) - 1) / 2.0 AS rk
            FROM (SELECT {lead}({pos}) AS y, {value} AS v FROM {source} WHERE ({pos}) OR ({neg}))){group}"""


MI_SQL = f"""e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM long GROUP BY 1),
    bb AS (SELECT feature, target, len(list_filter(q[2:len(q) - 1], lambda x: x <= value)) AS bin FROM long JOIN e USING (feature)),
    cc AS (SELECT feature, bin, target, CAST(count(*) AS DOUBLE) AS n FROM bb GROUP BY 1, 2, 3),
    mi AS (SELECT feature, sum(n / t * ln(n * t / (rb * ct))) AS mi FROM (
      SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS rb, sum(n) OVER (PARTITION BY feature, target) AS ct FROM cc) GROUP BY 1)"""


@query(
    "separability_classes",
    "feature:s mutual_information:d buy_vs_sell_smd:d buy_vs_sell_auc:d buy_vs_sell_separability_auc:d buy_vs_no_trade_smd:d buy_vs_no_trade_auc:d buy_vs_no_trade_separability_auc:d",
    f"""WITH {SCORED_SPLIT_SQL}, long AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS value, target FROM split_rows WHERE split = 'train'" for f in NUMBERS)}),
    a AS ({auc_sql('target = 1', 'target = 0')}), b AS ({auc_sql('target = 1', 'target = 2')}), {MI_SQL},
    s AS (SELECT feature, avg(value) FILTER (WHERE target = 0) AS m0, avg(value) FILTER (WHERE target = 1) AS m1, avg(value) FILTER (WHERE target = 2) AS m2,
      var_pop(value) FILTER (WHERE target = 0) AS v0, var_pop(value) FILTER (WHERE target = 1) AS v1, var_pop(value) FILTER (WHERE target = 2) AS v2 FROM long GROUP BY 1)
    SELECT feature, mi AS mutual_information, (m1 - m0) / sqrt((v1 + v0) / 2) AS buy_vs_sell_smd, a.auc AS buy_vs_sell_auc, greatest(a.auc, 1 - a.auc) AS buy_vs_sell_separability_auc,
      (m1 - m2) / sqrt((v1 + v2) / 2) AS buy_vs_no_trade_smd, b.auc AS buy_vs_no_trade_auc, greatest(b.auc, 1 - b.auc) AS buy_vs_no_trade_separability_auc
    FROM a JOIN b USING (feature) JOIN mi USING (feature) JOIN s USING (feature)""",
)
def separability_classes(spark, sf_dir):
    rows = study_split(spark, sf_dir).where(F.col("split") == "train")
    return ts.class_separability(rows, NUMBERS)


PAIR_LIST = [("BUY_vs_NO_TRADE", 1, 2), ("SELL_vs_NO_TRADE", 0, 2), ("BUY_vs_SELL", 1, 0)]
PAIR_SQL = f"""pk AS ({' UNION ALL '.join(f"SELECT '{n}' AS comparison, q.* FROM ({ks_sql(f'target = {a}', f'target = {b}', 'feature, split')}) q WHERE split <> 'test'" for n, a, b in PAIR_LIST)}),
pm AS ({' UNION ALL '.join(f"SELECT '{n}' AS comparison, feature, split, abs(quantile_cont(value, 0.5) FILTER (WHERE target = {a}) - quantile_cont(value, 0.5) FILTER (WHERE target = {b})) AS gap, quantile_cont(value, 0.75) FILTER (WHERE target IN ({a}, {b})) - quantile_cont(value, 0.25) FILTER (WHERE target IN ({a}, {b})) AS iqr FROM long GROUP BY 2, 3" for n, a, b in PAIR_LIST)}),
pairs AS (SELECT feature, split, comparison, n AS left_count, m AS right_count, ks AS ks_statistic, CASE WHEN iqr = 0 THEN gap ELSE gap / iqr END AS absolute_median_iqr_effect,
  sqrt(n * m / (n + m)) * ks AS lam FROM pk JOIN pm USING (feature, split, comparison))"""


@query(
    "separability_pairs",
    "feature:s split:s comparison:s left_count:l right_count:l ks_statistic:d ks_pvalue:d absolute_median_iqr_effect:d",
    f"""WITH {SCORED_SPLIT_SQL}, {LONG_SQL}, {PAIR_SQL}, js AS (SELECT unnest(generate_series(1, 100)) AS j),
    pv AS (SELECT feature, split, comparison, 2 * sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * lam * lam * j * j)) AS p FROM pairs CROSS JOIN js GROUP BY 1, 2, 3)
    SELECT *, CASE WHEN lam < 0.2 THEN 1 ELSE least(1, greatest(0, p)) END AS ks_pvalue FROM pairs JOIN pv USING (feature, split, comparison)""",
)
def separability_pairs(spark, sf_dir):
    return ts.pairwise_separation(study_split(spark, sf_dir), NUMBERS)


@query(
    "separability_summary",
    "split:s comparison:s median_ks:d max_ks:d features_ks_at_least_0_1:l median_absolute_median_iqr_effect:d top_features:s",
    f"""WITH {SCORED_SPLIT_SQL}, {LONG_SQL}, {PAIR_SQL} SELECT split, comparison, quantile_cont(ks_statistic, 0.5) AS median_ks, max(ks_statistic) AS max_ks,
    count(*) FILTER (WHERE ks_statistic >= 0.1) AS features_ks_at_least_0_1, quantile_cont(absolute_median_iqr_effect, 0.5) AS median_absolute_median_iqr_effect,
    string_agg(feature, ',' ORDER BY ks_statistic DESC, feature DESC) AS top_features FROM pairs GROUP BY 1, 2""",
)
def separability_summary(spark, sf_dir):
    return ts.separation_summary(separability_pairs(spark, sf_dir))


@query(
    "correlation_pairs",
    "split:s quantity_price:d price_discount:d scores:d",
    f"WITH {SCORED_SPLIT_SQL} SELECT split, corr(quantity, extendedprice) AS quantity_price, corr(extendedprice, discount) AS price_discount, corr(buy_proba, sell_proba) AS scores FROM split_rows GROUP BY 1",
)
def correlation_pairs(spark, sf_dir):
    return scored_split(spark, sf_dir).groupBy("split").agg(
        F.corr("quantity", "extendedprice").alias("quantity_price"), F.corr("extendedprice", "discount").alias("price_discount"), F.corr("buy_proba", "sell_proba").alias("scores")
    )


FOLD_SQL = """folds AS (SELECT fold, s.* FROM split_rows s CROSS JOIN (SELECT unnest(generate_series(1, 5)) AS fold) f WHERE i < n - (6 - fold) * (n // 6)),
importance AS (""" + " UNION ALL ".join(f"SELECT fold, '{f}' AS feature, abs(corr({f}, target)) AS importance FROM folds GROUP BY 1" for f in NUMBERS) + ")"


def importances(spark, sf_dir):
    """Per fold, the absolute correlation of each feature with the class on the fold's train rows."""
    from ..operators.splits import walk_forward

    train = walk_forward(scored_split(spark, sf_dir)).where(F.col("role") == "train")
    wide = train.groupBy("fold").agg(*[F.abs(F.corr(f, F.col("target").cast("double"))).alias(f) for f in NUMBERS])
    return mt.melt(wide, NUMBERS, keys=["fold"], name="feature").withColumnRenamed("value", "importance")


@query(
    "importance_stability",
    "feature:s importance_mean:d importance_std:d importance_min:d importance_max:d rank_mean:d rank_std:d " + " ".join(f"fold_{k}:d" for k in range(1, 6)),
    f"""WITH {SCORED_SPLIT_SQL}, {FOLD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) AS rk FROM importance)
    SELECT feature, avg(importance) AS importance_mean, stddev_samp(importance) AS importance_std, min(importance) AS importance_min, max(importance) AS importance_max,
    avg(rk) AS rank_mean, stddev_samp(rk) AS rank_std, """ + ", ".join(f"max(importance) FILTER (WHERE fold = {k}) AS fold_{k}" for k in range(1, 6)) + " FROM r GROUP BY 1",
)
def importance_stability(spark, sf_dir):
    return tb.importance_summary(importances(spark, sf_dir), folds=range(1, 6))


@query(
    "importance_concentration",
    "fold:l top1_share:d top2_share:d herfindahl:d normalised_entropy:d",
    f"""WITH {SCORED_SPLIT_SQL}, {FOLD_SQL}, p AS (SELECT fold, importance / sum(importance) OVER (PARTITION BY fold) AS p, row_number() OVER (PARTITION BY fold ORDER BY importance DESC) AS k FROM importance)
    SELECT fold, max(p) AS top1_share, sum(p) FILTER (WHERE k <= 2) AS top2_share, sum(p * p) AS herfindahl, -sum(p * ln(p)) / ln(count(*)) AS normalised_entropy FROM p GROUP BY 1""",
)
def importance_concentration(spark, sf_dir):
    return ts.concentration(importances(spark, sf_dir), keys=["fold"])


# ---------------------------------------------------------------- classification


def report_sql(source: str) -> str:
    per = " UNION ALL ".join(f"SELECT split, {k} AS c, count(*) FILTER (WHERE target = {k} AND predicted = {k}) AS hit, count(*) FILTER (WHERE target = {k}) AS sup, count(*) FILTER (WHERE predicted = {k}) AS emi, count(*) AS n FROM {source} GROUP BY 1" for k in range(3))
    return f"""per AS ({per}), pc AS (SELECT *, coalesce(hit * 1.0 / nullif(emi, 0), 0) AS pr, coalesce(hit * 1.0 / nullif(sup, 0), 0) AS re, coalesce(2.0 * hit / nullif(emi + sup, 0), 0) AS f1 FROM per),
    report AS (
      SELECT split, 'precision_' || c AS metric, pr AS value FROM pc UNION ALL SELECT split, 'recall_' || c, re FROM pc UNION ALL SELECT split, 'f1_' || c, f1 FROM pc
      UNION ALL SELECT split, 'support_' || c, sup FROM pc UNION ALL SELECT split, 'predicted_pct_' || c, 100.0 * emi / n FROM pc
      UNION ALL SELECT split, 'accuracy', sum(hit) * 1.0 / any_value(n) FROM pc GROUP BY 1 UNION ALL SELECT split, 'balanced_accuracy', avg(re) FROM pc GROUP BY 1
      UNION ALL SELECT split, 'macro_f1', avg(f1) FROM pc GROUP BY 1 UNION ALL SELECT split, 'weighted_precision', sum(sup * pr) / any_value(n) FROM pc GROUP BY 1
      UNION ALL SELECT split, 'weighted_recall', sum(sup * re) / any_value(n) FROM pc GROUP BY 1 UNION ALL SELECT split, 'weighted_f1', sum(sup * f1) / any_value(n) FROM pc GROUP BY 1
      UNION ALL SELECT split, 'accuracy_on_actual_buy_sell_rows', sum(hit) * 1.0 / sum(sup) FROM pc WHERE c < 2 GROUP BY 1
      UNION ALL SELECT split, 'actual_directional_row_count', sum(sup) FROM pc WHERE c < 2 GROUP BY 1
      UNION ALL SELECT split, 'predicted_buy_sell_pct', 100.0 * sum(emi) / any_value(n) FROM pc WHERE c < 2 GROUP BY 1
      UNION ALL SELECT split, 'predicted_no_trade_pct', 100.0 * emi / n FROM pc WHERE c = 2)"""


@query("metrics_classification_report", "split:s metric:s value:d", f"WITH {SCORED_SPLIT_SQL}, {report_sql('split_rows')} SELECT * FROM report")
def metrics_classification_report(spark, sf_dir):
    return mt.classification_report(scored_split(spark, sf_dir), keys=["split"])


@query(
    "metrics_confusion",
    "actual:l predicted:l count:l",
    f"WITH {SCORED_SQL} SELECT target AS actual, predicted, count(*) AS count FROM scored GROUP BY 1, 2",
)
def metrics_confusion(spark, sf_dir):
    return mt.confusion_long(mt.confusion(scored(spark, sf_dir)))


def ap_sql(pos: str, keys: str, source: str, value: str) -> str:
    return f"""SELECT {keys}, sum(n1 / t1 * c1 / c) AS ap FROM (
      SELECT {keys}, v, n1, sum(n1) OVER (PARTITION BY {keys} ORDER BY v DESC) AS c1, sum(nn) OVER (PARTITION BY {keys} ORDER BY v DESC) AS c, sum(n1) OVER (PARTITION BY {keys}) AS t1
      FROM (SELECT {keys}, {value} AS v, CAST(count(*) FILTER (WHERE {pos}) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS nn FROM {source} GROUP BY {keys}, {value})) GROUP BY {keys}"""


@query(
    "metrics_roc_auc",
    "feature:s roc_auc:d",
    f"""WITH {SCORED_SQL}, a AS (SELECT 'sell_proba' AS feature, * FROM ({auc_sql('target = 0', 'target <> 0', '', 'scored', 'sell_proba')})
      UNION ALL SELECT 'buy_proba', * FROM ({auc_sql('target = 1', 'target <> 1', '', 'scored', 'buy_proba')})
      UNION ALL SELECT 'no_trade_proba', * FROM ({auc_sql('target = 2', 'target <> 2', '', 'scored', 'no_trade_proba')}))
    SELECT feature, auc AS roc_auc FROM a UNION ALL SELECT 'macro', avg(auc) FROM a""",
)
def metrics_roc_auc(spark, sf_dir):
    return mt.one_vs_rest_auc(scored(spark, sf_dir), {0: "sell_proba", 1: "buy_proba", 2: "no_trade_proba"})


@query(
    "metrics_average_precision",
    "split:s roc_auc:d pr_auc:d",
    f"""WITH {SCORED_SPLIT_SQL}, a AS ({auc_sql('target = 1', 'target <> 1', 'split', 'split_rows', 'buy_proba')}), p AS ({ap_sql('target = 1', 'split', 'split_rows', 'buy_proba')})
    SELECT split, auc AS roc_auc, ap AS pr_auc FROM a JOIN p USING (split)""",
)
def metrics_average_precision(spark, sf_dir):
    return mt.ranking_metrics(scored_split(spark, sf_dir), F.col("target") == 1, "buy_proba", keys=["split"])


BINARY = "rows:l positive_count:l prevalence:d accuracy:d balanced_accuracy:d macro_f1:d precision:d recall:d f1:d brier_score:d log_loss:d score_mean:d score_std:d near_half_pct:d roc_auc:d pr_auc:d"


def binary_sql(source: str, y: str, p: str, threshold: float) -> str:
    return f"""base AS (SELECT split, ({y}) AS y, {p} AS p, CAST({p} >= {threshold} AS INT) AS h FROM {source}),
    c AS (SELECT split, count(*) AS rows, sum(y) AS pos, CAST(count(*) FILTER (WHERE y = 1 AND h = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE y = 0 AND h = 1) AS DOUBLE) AS fp,
      CAST(count(*) FILTER (WHERE y = 1 AND h = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE y = 0 AND h = 0) AS DOUBLE) AS tn, avg((p - y) * (p - y)) AS brier,
      avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS ll, avg(p) AS sm, stddev_pop(p) AS sd, 100 * avg(CASE WHEN p BETWEEN 0.45 AND 0.55 THEN 1.0 ELSE 0.0 END) AS nh FROM base GROUP BY 1),
    a AS ({auc_sql('y = 1', 'y = 0', 'split', 'base', 'p')}), ap AS ({ap_sql('y = 1', 'split', 'base', 'p')})
    SELECT split, rows, pos AS positive_count, pos * 1.0 / rows AS prevalence, (tp + tn) / rows AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy,
      (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2 AS macro_f1, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
      brier AS brier_score, ll AS log_loss, sm AS score_mean, sd AS score_std, nh AS near_half_pct, auc AS roc_auc, ap AS pr_auc FROM c JOIN a USING (split) JOIN ap USING (split)"""


@query("metrics_binary", "split:s " + BINARY, f"WITH {SCORED_SPLIT_SQL}, {binary_sql('split_rows', 'CAST(target = 1 AS INT)', 'buy_proba', 0.4)}")
def metrics_binary(spark, sf_dir):
    rows = scored_split(spark, sf_dir).withColumn("y", (F.col("target") == 1).cast("int"))
    return mt.binary_metrics(rows, actual="y", score="buy_proba", threshold=0.4, keys=["split"])


@query(
    "metrics_conditional_direction",
    "split:s " + BINARY,
    f"WITH {SCORED_SPLIT_SQL}, d AS (SELECT split, target, buy_proba / (buy_proba + sell_proba) AS score FROM split_rows WHERE target < 2), {binary_sql('d', 'target', 'score', 0.5)}",
)
def metrics_conditional_direction(spark, sf_dir):
    return mt.direction_metrics(scored_split(spark, sf_dir), keys=["split"])


@query(
    "metrics_combination",
    "split:s actual_directional_rows:l buy_dominates_rate:d neither_dominates_rate:d mean_buy_probability:d mean_sell_probability:d probability_correlation:d",
    f"""WITH {SCORED_SPLIT_SQL} SELECT split, count(*) FILTER (WHERE target <> 2) AS actual_directional_rows, avg(CASE WHEN buy_proba > sell_proba THEN 1.0 ELSE 0.0 END) AS buy_dominates_rate,
    avg(CASE WHEN buy_proba < 0.5 AND sell_proba < 0.5 THEN 1.0 ELSE 0.0 END) AS neither_dominates_rate, avg(buy_proba) AS mean_buy_probability, avg(sell_proba) AS mean_sell_probability, corr(buy_proba, sell_proba) AS probability_correlation FROM split_rows GROUP BY 1""",
)
def metrics_combination(spark, sf_dir):
    return mt.combination_metrics(scored_split(spark, sf_dir), keys=["split"])


@query(
    "metrics_three_views",
    "split:s multiclass_accuracy:d filter_accuracy:d filter_precision:d filter_recall:d filter_roc_auc:d directional_rows:l direction_accuracy:d direction_roc_auc:d emitted_rows:l emitted_pct:d correct_direction_count:l correct_direction_precision:d",
    f"""WITH {SCORED_SPLIT_SQL}, x AS (SELECT *, 1 - no_trade_proba AS act, buy_proba / (buy_proba + sell_proba) AS dir FROM split_rows),
    fa AS ({auc_sql('target <> 2', 'target = 2', 'split', 'x', 'act')}), da AS ({auc_sql('target = 1', 'target = 0', 'split', 'x', 'dir')}),
    c AS (SELECT split, avg(CASE WHEN target = predicted THEN 1.0 ELSE 0.0 END) AS multiclass_accuracy, avg(CASE WHEN (target <> 2) = (predicted <> 2) THEN 1.0 ELSE 0.0 END) AS filter_accuracy,
      count(*) FILTER (WHERE target <> 2 AND predicted <> 2) * 1.0 / count(*) FILTER (WHERE predicted <> 2) AS filter_precision, count(*) FILTER (WHERE target <> 2 AND predicted <> 2) * 1.0 / count(*) FILTER (WHERE target <> 2) AS filter_recall,
      count(*) FILTER (WHERE target <> 2) AS directional_rows, count(*) FILTER (WHERE target <> 2 AND (target = 1) = (predicted = 1)) * 1.0 / count(*) FILTER (WHERE target <> 2) AS direction_accuracy,
      count(*) FILTER (WHERE predicted <> 2) AS emitted_rows, 100.0 * count(*) FILTER (WHERE predicted <> 2) / count(*) AS emitted_pct, count(*) FILTER (WHERE predicted = target AND target <> 2) AS correct_direction_count,
      count(*) FILTER (WHERE predicted = target AND target <> 2) * 1.0 / count(*) FILTER (WHERE predicted <> 2) AS correct_direction_precision FROM x GROUP BY 1)
    SELECT c.*, fa.auc AS filter_roc_auc, da.auc AS direction_roc_auc FROM c JOIN fa USING (split) JOIN da USING (split)""",
)
def metrics_three_views(spark, sf_dir):
    return mt.three_views(scored_split(spark, sf_dir), keys=["split"])


# ---------------------------------------------------------------- calibration and histograms

CAL = "bin:l count:l mean_score:d observed_rate:d"
CAL_AGG = "count(*) AS count, avg(buy_proba) AS mean_score, avg(CASE WHEN target = 1 THEN 1.0 ELSE 0.0 END) AS observed_rate FROM scored"


def labelled_scores(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("y", (F.col("target") == 1).cast("int"))


@query(
    "calibration_uniform_right_closed",
    CAL,
    f"WITH {SCORED_SQL} SELECT greatest(CAST(ceil(buy_proba * 10) AS INT) - 1, 0) AS bin, {CAL_AGG} GROUP BY 1",
)
def calibration_uniform_right(spark, sf_dir):
    return mt.calibration(labelled_scores(spark, sf_dir), mt.uniform_bins("buy_proba"), actual="y", score="buy_proba")


@query(
    "calibration_uniform_left_closed",
    CAL,
    f"WITH {SCORED_SQL} SELECT least(CAST(floor(buy_proba * 10) AS INT), 9) AS bin, {CAL_AGG} GROUP BY 1",
)
def calibration_uniform_left(spark, sf_dir):
    return mt.calibration(labelled_scores(spark, sf_dir), mt.uniform_bins("buy_proba", right_closed=False), actual="y", score="buy_proba")


@query(
    "calibration_quantile",
    CAL,
    f"""WITH {SCORED_SQL}, e AS (SELECT quantile_cont(buy_proba, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM scored)
    SELECT len(list_filter(q, lambda x: x < buy_proba)) AS bin, {CAL_AGG}, e GROUP BY 1""",
)
def calibration_quantile(spark, sf_dir):
    return mt.quantile_calibration(labelled_scores(spark, sf_dir), actual="y", score="buy_proba")


def range_case(edges, x):
    return "CASE " + " ".join(f"WHEN {x} >= {a} AND {x} < {b} THEN '{n}'" for a, b, n in zip(edges, edges[1:], bins.range_labels(edges))) + " END"


@query(
    "calibration_fixed_buckets",
    "bin:s count:l mean_score:d observed_rate:d",
    f"WITH {SCORED_SQL} SELECT * FROM (SELECT {range_case(bins.CALIBRATION_EDGES, 'buy_proba')} AS bin, {CAL_AGG} GROUP BY 1) WHERE bin IS NOT NULL",
)
def calibration_fixed(spark, sf_dir):
    edges = bins.CALIBRATION_EDGES
    return mt.calibration(labelled_scores(spark, sf_dir), bins.bin_left_closed(F.col("buy_proba"), edges, bins.range_labels(edges)), actual="y", score="buy_proba")


@query(
    "histogram_probability",
    "bin:s count:l",
    f"WITH {SCORED_SQL} SELECT * FROM (SELECT {range_case(bins.PROBABILITY_EDGES, 'buy_proba')} AS bin, count(*) AS count FROM scored GROUP BY 1) WHERE bin IS NOT NULL",
)
def histogram_probability(spark, sf_dir):
    edges = bins.PROBABILITY_EDGES
    label = bins.bin_left_closed(F.col("buy_proba"), edges, bins.range_labels(edges)).alias("bin")
    return scored(spark, sf_dir).groupBy(label).agg(F.count(F.lit(1)).alias("count")).where("bin IS NOT NULL")


@query(
    "summary_probability",
    "feature:s min:d p10:d p25:d median:d p75:d p90:d max:d",
    f"""WITH {SCORED_SQL} SELECT 'buy_proba' AS feature, min(buy_proba) AS min, quantile_cont(buy_proba, 0.1) AS p10, quantile_cont(buy_proba, 0.25) AS p25, quantile_cont(buy_proba, 0.5) AS median,
    quantile_cont(buy_proba, 0.75) AS p75, quantile_cont(buy_proba, 0.9) AS p90, max(buy_proba) AS max FROM scored""",
)
def summary_probability(spark, sf_dir):
    return mt.probability_summary(scored(spark, sf_dir), "buy_proba")


# ---------------------------------------------------------------- signals and baselines

SIGNAL_SQL = """signals AS (SELECT *, CASE WHEN buy_proba >= 0.45 AND sell_proba >= 0.4 THEN CASE WHEN buy_proba >= sell_proba THEN 1 ELSE -1 END
  WHEN buy_proba >= 0.45 THEN 1 WHEN sell_proba >= 0.4 THEN -1 ELSE 0 END AS signal FROM scored)"""


def signals(spark, sf_dir):
    b, s, n = (F.col(f"{x}_proba") for x in ("buy", "sell", "no_trade"))
    return scored(spark, sf_dir).withColumn("signal", decide_signal(b, s, 0.45, 0.4)).withColumn("signal_proba", signal_probability(F.col("signal"), b, s, n))


@query(
    "signal_frame",
    "l_orderkey:l l_linenumber:l signal:l signal_proba:d direction:d activity:d",
    f"""WITH {SCORED_SQL}, {SIGNAL_SQL} SELECT l_orderkey, l_linenumber, signal, CASE signal WHEN 1 THEN buy_proba WHEN -1 THEN sell_proba ELSE no_trade_proba END AS signal_proba,
    buy_proba / (buy_proba + sell_proba) AS direction, buy_proba + sell_proba AS activity FROM signals""",
)
def signal_frame(spark, sf_dir):
    b, s = F.col("buy_proba"), F.col("sell_proba")
    return signals(spark, sf_dir).withColumns({"direction": direction_score(b, s), "activity": activity_score(b, s)})


@query(
    "signal_binary",
    "signal:l rows:l mean_proba:d",
    f"WITH {SCORED_SQL} SELECT CAST(buy_proba >= 0.4 AS INT) AS signal, count(*) AS rows, avg(buy_proba) AS mean_proba FROM scored GROUP BY 1",
)
def signal_binary(spark, sf_dir):
    """Signals of a model with one score."""
    rows = scored(spark, sf_dir).withColumn("signal", threshold_signal(F.col("buy_proba"), 0.4))
    return rows.groupBy("signal").agg(F.count(F.lit(1)).alias("rows"), F.avg("buy_proba").alias("mean_proba"))


@query(
    "signal_report",
    "rows:l buy_signals:l sell_signals:l no_trade_signals:l buy_ratio:d sell_ratio:d mean_buy_proba:d mean_sell_proba:d max_buy_proba:d max_sell_proba:d",
    f"""WITH {SCORED_SQL}, {SIGNAL_SQL} SELECT count(*) AS rows, count(*) FILTER (WHERE signal = 1) AS buy_signals, count(*) FILTER (WHERE signal = -1) AS sell_signals, count(*) FILTER (WHERE signal = 0) AS no_trade_signals,
    avg(CASE WHEN signal = 1 THEN 1.0 ELSE 0.0 END) AS buy_ratio, avg(CASE WHEN signal = -1 THEN 1.0 ELSE 0.0 END) AS sell_ratio, avg(buy_proba) AS mean_buy_proba, avg(sell_proba) AS mean_sell_proba,
    max(buy_proba) AS max_buy_proba, max(sell_proba) AS max_sell_proba FROM signals""",
)
def signal_report(spark, sf_dir):
    return mt.signal_report(signals(spark, sf_dir))


@query(
    "baseline_majority",
    "split:s majority_class:l accuracy:d balanced_accuracy:d macro_f1:d",
    f"""WITH {SCORED_SPLIT_SQL}, c AS (SELECT split, target, count(*) AS n FROM split_rows GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n DESC, target) AS k, sum(n) OVER (PARTITION BY split) AS t, count(*) OVER (PARTITION BY split) AS classes FROM c)
    SELECT split, target AS majority_class, n / t AS accuracy, 1.0 / classes AS balanced_accuracy, 2.0 * n / (t + n) / 3 AS macro_f1 FROM r WHERE k = 1""",
)
def baseline_majority(spark, sf_dir):
    return mt.majority_baseline(scored_split(spark, sf_dir), keys=["split"])


@query(
    "baseline_prior_random",
    "runs:l accuracy:d balanced_accuracy:d macro_f1:d",
    f"""WITH {SCORED_SQL}, p AS (SELECT avg(CAST(target = 0 AS INT)) AS p0, avg(CAST(target = 1 AS INT)) AS p1 FROM scored),
    u AS (SELECT run, target, CAST('0x' || left(md5('42|' || run || '|' || l_orderkey || '|' || l_linenumber), 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM scored, range(20) AS r(run)),
    g AS (SELECT run, target, CASE WHEN u < p0 THEN 0 WHEN u < p0 + p1 THEN 1 ELSE 2 END AS guess FROM u, p),
    k AS (SELECT run, c, count(*) FILTER (WHERE target = c AND guess = c) AS hit, count(*) FILTER (WHERE target = c) AS support, count(*) FILTER (WHERE guess = c) AS emitted, count(*) AS n FROM g, range(3) AS t(c) GROUP BY 1, 2),
    m AS (SELECT run, sum(hit) / max(n) AS accuracy, avg(hit / support) FILTER (WHERE support > 0) AS balanced_accuracy, avg(coalesce(2.0 * hit / nullif(emitted + support, 0), 0)) AS macro_f1 FROM k GROUP BY 1)
    SELECT count(*) AS runs, avg(accuracy) AS accuracy, avg(balanced_accuracy) AS balanced_accuracy, avg(macro_f1) AS macro_f1 FROM m""",
)
def baseline_prior_random(spark, sf_dir):
    return mt.prior_baseline(scored(spark, sf_dir), row_key=["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- comparisons and verdicts


def model_metrics(spark, sf_dir):
    """Two decision rules on the same rows, as two models."""
    rows = scored_split(spark, sf_dir).where(F.col("split") == "validation")
    argmax = F.when((F.col("sell_proba") >= F.col("buy_proba")) & (F.col("sell_proba") >= F.col("no_trade_proba")), 0).when(
        F.col("buy_proba") >= F.col("no_trade_proba"), 1
    ).otherwise(2)
    models = F.array(F.struct(F.lit("stored").alias("model"), F.col("predicted").alias("p")), F.struct(F.lit("argmax").alias("model"), argmax.alias("p")))
    long = rows.withColumn("_m", F.explode(models)).select("target", F.col("_m.model").alias("model"), F.col("_m.p").alias("predicted"))
    return mt.classification_report(long, keys=["model"])


MODEL_SQL = """models AS (SELECT 'stored' AS split, target, predicted FROM split_rows WHERE split = 'validation'
  UNION ALL SELECT 'argmax', target, CASE WHEN sell_proba >= buy_proba AND sell_proba >= no_trade_proba THEN 0 WHEN buy_proba >= no_trade_proba THEN 1 ELSE 2 END FROM split_rows WHERE split = 'validation')"""


@query(
    "comparison_models",
    "model:s metric:s value:d baseline_value:d difference:d",
    f"""WITH {SCORED_SPLIT_SQL}, {MODEL_SQL}, {report_sql('models')}, paired AS (SELECT split AS model, metric, value, max(value) FILTER (WHERE split = 'stored') OVER (PARTITION BY metric) AS baseline_value FROM report)
    SELECT *, value - baseline_value AS difference FROM paired""",
)
def comparison_models(spark, sf_dir):
    return mt.compare_models(model_metrics(spark, sf_dir), baseline="stored")


@query(
    "comparison_folds",
    "metric:s mean:d std:d min:d max:d folds:l",
    f"""WITH {SCORED_SPLIT_SQL}, models AS (SELECT CAST(fold AS VARCHAR) AS split, target, predicted FROM split_rows CROSS JOIN (SELECT unnest(generate_series(1, 5)) AS fold)
      WHERE i >= n - (6 - fold) * (n // 6) AND i < n - (5 - fold) * (n // 6)), {report_sql('models')}
    SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, count(*) AS folds FROM report GROUP BY 1""",
)
def comparison_folds(spark, sf_dir):
    from ..operators.splits import walk_forward

    test = walk_forward(scored_split(spark, sf_dir)).where(F.col("role") == "test")
    return mt.fold_summary(mt.classification_report(test, keys=["fold"]), keys=["metric"])


RULES = [
    (1, "STRONG", "accuracy", ">=", 0.6), (1, "STRONG", "macro_f1", ">=", 0.5), (2, "WEAK", "accuracy", ">=", 0.2), (2, "WEAK", "macro_f1", ">", 0.1), (3, "NONE", "accuracy", ">=", 0.0),
]


@query(
    "comparison_verdict",
    "model:s verdict:s",
    f"""WITH {SCORED_SPLIT_SQL}, {MODEL_SQL}, {report_sql('models')}, w AS (SELECT split AS model, max(value) FILTER (WHERE metric = 'accuracy') AS acc, max(value) FILTER (WHERE metric = 'macro_f1') AS f FROM report GROUP BY 1)
    SELECT model, CASE WHEN acc >= 0.6 AND f >= 0.5 THEN 'STRONG' WHEN acc >= 0.2 AND f > 0.1 THEN 'WEAK' ELSE 'NONE' END AS verdict FROM w""",
)
def comparison_verdict(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "priority int, verdict string, metric string, op string, threshold double")
    return mt.verdict(model_metrics(spark, sf_dir), rules, keys=["model"])
