"""Model training, scoring, importances and fold loops on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as mt
from .labels import BUY, NO_TRADE, SELL

# Class codes and the score column of each.
SCORE_COLUMNS = {SELL: "sell_proba", BUY: "buy_proba", NO_TRADE: "no_trade_proba"}


def scaling(features: Sequence[str]) -> list:
    """Assemble in contract order, then centre and scale on the rows fitted on.

    A constant feature scales to zero, so it is tolerated.
    """
    return [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]


def binary_trees(*, trees: int = 500, depth: int = 6, step: float = 0.05, subsample: float = 0.8, seed: int = 42, validation: str | None = None, patience: float = 0.001) -> GBTClassifier:
    """Boosted trees; with ``validation`` (a boolean column) boosting stops early."""
    extra = {"validationIndicatorCol": validation, "validationTol": patience} if validation else {}
    return GBTClassifier(labelCol="_label", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed, **extra)


@dataclass
class ClassScores:
    """One boosted model per class behind a shared scaler; scores sum to one."""

    scaler: PipelineModel
    models: dict[int, object]

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.scaler.transform(df)
        keep = df.columns
        for k, model in self.models.items():
            scored = model.transform(out)
            out = scored.withColumn(f"_p{k}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        total = sum(F.col(f"_p{k}") for k in self.models)
        scores = {SCORE_COLUMNS[k]: F.coalesce(F.col(f"_p{k}") / F.nullif(total, F.lit(0.0)), F.lit(1.0 / len(self.models))) for k in self.models}
        return out.select(*keep, *[v.alias(k) for k, v in scores.items()])

    def importances(self, features: Sequence[str]) -> list[tuple[str, float]]:
        """Mean importance over the class models (as many rows as features)."""
        total = [0.0] * len(features)
        for model in self.models.values():
            for i, v in enumerate(model.featureImportances.toArray()):
                total[i] += float(v) / len(self.models)
        return list(zip(features, total))


def fit_classes(train: DataFrame, features: Sequence[str], *, target: str = "target", classes: Sequence[int] = (SELL, BUY, NO_TRADE), **params) -> ClassScores:
    """Scaler fitted on the training rows only, then one model per class.

    The models are fitted side by side: a level of a tree is a short job with as many tasks as ``train`` has partitions,
    so one fit alone leaves cores idle at the end of each.
    """
    scaler = Pipeline(stages=scaling(features)).fit(train)
    validation = params.get("validation")
    rows = scaler.transform(train).select("features", target, *([validation] if validation else [])).persist()

    def fit(k: int):
        return binary_trees(**params).fit(rows.withColumn("_label", (F.col(target) == k).cast("double")))

    try:
        rows.count()  # cached once, not by each fit
        with ThreadPool(len(classes)) as pool:
            models = dict(zip(classes, pool.map(inheritable_thread_target(train.sparkSession)(fit), classes)))
    finally:
        rows.unpersist()
    return ClassScores(scaler, models)


def argmax_class(sell: str = "sell_proba", buy: str = "buy_proba", none: str = "no_trade_proba") -> Column:
    s, b, n = F.col(sell), F.col(buy), F.col(none)
    return F.when((s >= b) & (s >= n), SELL).when(b >= n, BUY).otherwise(NO_TRADE)


def fit_binary(train: DataFrame, features: Sequence[str], *, label: str, estimator=None) -> PipelineModel:
    rows = train.withColumn("_label", F.col(label).cast("double"))
    estimator = estimator or LogisticRegression(labelCol="_label", maxIter=50)
    return Pipeline(stages=[*scaling(features), estimator]).fit(rows)


def binary_score(model: PipelineModel, df: DataFrame, *, label: str, out: str = "score") -> DataFrame:
    scored = model.transform(df.withColumn("_label", F.col(label).cast("double")))
    return scored.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def small_network(features: Sequence[str], *, hidden: Sequence[int] = (32, 16), rounds: int = 50, seed: int = 42) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(labelCol="_label", layers=[len(features), *hidden, 2], maxIter=rounds, seed=seed)


def importance_table(model: ClassScores, features: Sequence[str], spark) -> DataFrame:
    return spark.createDataFrame(model.importances(features), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def same_after_reload(model: PipelineModel, df: DataFrame, path: str, *, label: str) -> DataFrame:
    """Save, load, score again; counts rows whose score changed (must be zero)."""
    model.write().save(path)
    again = PipelineModel.load(path)
    a, b = binary_score(model, df, label=label), binary_score(again, df, label=label)
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("changed_rows"))


def single_feature_models(train: DataFrame, test: DataFrame, features: Sequence[str], *, label: str) -> DataFrame:
    """Accuracy and AUC of a one-feature logistic model per feature (short fixed list)."""
    parts = []
    for f in features:
        scored = binary_score(fit_binary(train, [f], label=label), test, label=label)
        parts.append(scored.select(F.lit(f).alias("feature"), F.col(label).alias("_y"), "score"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return mt.binary_metrics(rows, actual="_y", score="score", keys=["feature"])


def treatment_folds(folds: DataFrame, treatments: dict[str, Sequence[str]], *, label: str, n_folds: int, estimator=None) -> DataFrame:
    """(treatment, fold, metric, value): a fit per treatment and fold on that fold's train rows.

    The loop submits Spark fits; only fitted parameters live on the driver.
    """
    parts = []
    for name, features in treatments.items():
        for fold in range(1, n_folds + 1):
            rows = folds.where(F.col("fold") == fold)
            model = fit_binary(rows.where("role = 'train'"), features, label=label, estimator=estimator)
            scored = binary_score(model, rows.where("role = 'test'"), label=label)
            parts.append(scored.select(F.lit(name).alias("treatment"), F.lit(fold).alias("fold"), F.col(label).alias("_y"), "score"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    wide = mt.binary_metrics(rows, actual="_y", score="score", keys=["treatment", "fold"])
    return mt.melt(wide, ["accuracy", "balanced_accuracy", "macro_f1", "roc_auc", "brier_score"], keys=["treatment", "fold"])


def column_permutation_auc(model: PipelineModel, rows: DataFrame, columns: Sequence[str], *, label: str, row_key: Sequence[str], permutations: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """AUC after the named columns are shuffled as one block, per permutation."""
    from .permute import shuffled_columns

    positive = F.col(label) == 1
    observed = mt.ranking_metrics(binary_score(model, rows, label=label), positive, "score").select(F.col("roc_auc").alias("observed"))
    mixed = shuffled_columns(rows, columns, row_key=row_key, permutations=permutations, seed=seed)
    null = mt.ranking_metrics(binary_score(model, mixed, label=label), positive, "score", keys=["perm"])
    return observed, null.select("perm", F.col("roc_auc").alias("statistic"))
