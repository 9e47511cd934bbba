"""Chronological splits, walk-forward folds and their boundary checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import INDEX, cell_ranks, placeable, time_cell, with_row_index
from .staging import stage

SPLITS = ("train", "validation", "test")


def _cut(n: Column, share: float) -> Column:
    return F.floor(n * F.lit(1.0 - share))


def chronological_split(
    df: DataFrame,
    *,
    by: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts",),
    cells: Sequence[Column] | None = None,
    test_size: float = 0.2,
    validation_size: float = 0.1,
    purge_bars: int = 0,
) -> DataFrame:
    """Label every row train, validation or test by its position in its series.

    ``purge_bars`` drops that many rows before each boundary (labels that look
    forward would otherwise cross it); the default keeps them.
    """
    cells = cells or [time_cell(order[0])]
    rows = with_row_index(df.drop(INDEX), by, list(order), cells, total="n_rows")
    test_at = _cut(F.col("n_rows"), test_size)
    validation_at = _cut(test_at, validation_size)
    i = F.col(INDEX)
    out = rows.withColumn("split", F.when(i < validation_at, "train").when(i < test_at, "validation").otherwise("test"))
    if purge_bars:
        out = out.where(~(i.between(validation_at - purge_bars, validation_at - 1) | i.between(test_at - purge_bars, test_at - 1)))
    return out


def split_labels(
    df: DataFrame, *, by: Sequence[str], order: Sequence[str], cell: Column, inner: Sequence[Column], test_size: float = 0.2, validation_size: float = 0.1
) -> DataFrame:
    """The split of ``chronological_split`` without the positions.

    Rows are counted per ``cell`` and get the split of their cell; only the cells that a boundary cuts (two per series
    at most) are numbered, by ``inner`` cells.  ``df`` is read three times.
    """
    celled = placeable(df.withColumn("_cell", cell), [*by, "_cell"])
    counted = celled.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_rows"))

    def of(i: Column) -> Column:
        test_at = _cut(F.col("_total"), test_size)
        return F.when(i < _cut(test_at, validation_size), "train").when(i < test_at, "validation").otherwise("test")

    ranked = cell_ranks(counted, by, ["_cell"], "_rows")
    placed = stage(ranked.select(*by, "_cell", F.col("_start").alias("_before"), "_total", of(F.col("_start")).alias("_first"), of(F.col("_start") + F.col("_rows") - 1).alias("_last")))
    whole = celled.join(placed.where("_first = _last"), [*by, "_cell"]).withColumn("split", F.col("_first"))
    cut = celled.join(placed.where("_first <> _last"), [*by, "_cell"])
    numbered = with_row_index(cut, [*by, "_cell"], list(order), list(inner), index="_at")
    split = numbered.withColumn("split", of(F.col("_before") + F.col("_at")))
    return whole.unionByName(split.drop("_at")).drop("_cell", "_before", "_total", "_first", "_last")


def split_metadata(split_rows: DataFrame, *, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    return split_rows.groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("row_count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


def split_by_metadata(df: DataFrame, metadata: DataFrame, *, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Assign splits from recorded boundaries instead of positions.

    ``metadata`` has three rows per key at most, so the keyed join stays small.
    """
    bounds = metadata.groupBy(*keys).pivot("split", list(SPLITS)).agg(F.max("last_ts"))
    t = F.col(ts)
    return (
        df.join(bounds.withColumnsRenamed({s: f"_{s}" for s in SPLITS}), list(keys))
        .withColumn("split", F.when(t <= F.col("_train"), "train").when(t <= F.col("_validation"), "validation").when(t <= F.col("_test"), "test"))
        .drop(*[f"_{s}" for s in SPLITS])
    )


def boundary_violations(metadata: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """One row per rule: does each split end before the next one starts?"""
    wide = metadata.groupBy(*keys).agg(
        *[F.max(F.when(F.col("split") == s, F.col("last_ts"))).alias(f"{s}_last") for s in SPLITS],
        *[F.min(F.when(F.col("split") == s, F.col("first_ts"))).alias(f"{s}_first") for s in SPLITS],
    )
    rules = F.array(
        F.struct(F.lit("train_before_validation").alias("rule"), (F.col("train_last") < F.col("validation_first")).alias("ok")),
        F.struct(F.lit("validation_before_test").alias("rule"), (F.col("validation_last") < F.col("test_first")).alias("ok")),
        F.struct(
            F.lit("all_splits_present").alias("rule"),
            (F.col("train_last").isNotNull() & F.col("validation_last").isNotNull() & F.col("test_last").isNotNull()).alias("ok"),
        ),
    )
    return wide.select(*keys, F.explode(rules).alias("r")).select(*keys, "r.rule", F.col("r.ok").alias("passed"))


def walk_forward(indexed: DataFrame, *, n_splits: int = 5, index: str = INDEX, total: str = "n_rows") -> DataFrame:
    """Expanding folds: each row once per fold in which it is trained on or tested.

    Test windows are ``n // (n_splits + 1)`` rows long and lie at the end of the
    series; a fold trains on everything before its test window.
    """
    i, n = F.col(index), F.col(total)
    size = F.floor(n / (n_splits + 1))
    roles = []
    for fold in range(1, n_splits + 1):
        start = n - (n_splits + 1 - fold) * size
        role = F.when(i < start, "train").when(i < start + size, "test")
        roles.append(F.struct(F.lit(fold).alias("fold"), role.alias("role")))
    return indexed.withColumn("_f", F.explode(F.array(*roles))).where("_f.role IS NOT NULL").select("*", "_f.fold", "_f.role").drop("_f")


def fold_metadata(folds: DataFrame, *, ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    return folds.groupBy(*keys, "fold", "role").agg(
        F.count(F.lit(1)).alias("row_count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


def internal_holdout(train: DataFrame, *, share: float = 0.15, classes: Sequence[int] = (0, 1), target: str = "target", by: Sequence[str] = ("symbol",), ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Last share of the training rows, and whether both parts hold every class."""
    rows = with_row_index(train.drop(INDEX, "n_rows"), by, [ts], [time_cell(ts)], total="n_rows")
    part = F.when(F.col(INDEX) < _cut(F.col("n_rows"), share), "fit").otherwise("holdout")
    rows = rows.withColumn("part", part)
    check = rows.groupBy(*by, "part").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(F.when(F.col(target).isin(*classes), F.col(target))).alias("classes"),
    )
    return rows, check.withColumn("complete", F.col("classes") == len(classes))


def positions(indexed: DataFrame, start: int, stop: int | None = None, index: str = INDEX) -> DataFrame:
    """Positional slice ``[start, stop)`` of every series."""
    keep = F.col(index) >= start
    return indexed.where(keep if stop is None else keep & (F.col(index) < stop))
