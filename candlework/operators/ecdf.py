"""Weighted empirical distributions and the statistics read off them.

Rows are first reduced to one row per distinct value with a count per group.
Cumulative counts are then built in two levels over value cells, and every
statistic (KS, Wasserstein, AUC, average precision, exact quantiles) is one
more aggregation over that table.  No group's values are ever held in one
buffer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import same
from .staging import stage


#: Rows of a cell that the number of cells aims at, the fewest and the most cells, and the size of the sketches
#: (their ranks are right to about 0.3 %, a fraction of a cell).
ROWS_PER_CELL, FEWEST_CELLS, MOST_CELLS, SKETCH_K = 100_000, 8, 256, 1024
#: Cells on each side of a quantile that ``value_cells`` is told to look near (3 of 256 are 1.2 %, four times what a sketch is off).
NEAR_CELLS = 3


def value_cells(df: DataFrame, columns: Sequence[str], cells: int | None = None, *, near: Sequence[float] = (), of: str | None = None) -> dict[str, tuple[Column, Column]]:
    """Per column, a monotone cell number and a flag for single-value cells.

    Cut points come from mergeable quantile sketches, one per column, all built in one pass; ``MOST_CELLS`` numbers
    per column reach the driver, and as many of them are used as the rows ask for.  Cut points need not be accurate: they decide
    how work is split, never the result.  A value that takes more than a cell's
    share of the rows gets a cell of its own and is flagged.  With ``near``, cells lie close only around these quantiles
    and all values between two of them share one: short expressions for callers that look inside those cells alone.
    ``of`` names the value column of a long table that the cells are to be read from instead.
    """
    number = lambda c: F.col(c).cast("double")
    sketches = [F.kll_sketch_agg_double(F.when(~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")), number(c)), SKETCH_K).alias(f"_k{j}") for j, c in enumerate(columns)]
    probs = F.array(*[F.lit(k / MOST_CELLS) for k in range(1, MOST_CELLS)])
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *sketches, *[F.count(F.when(~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")), 1)).alias(f"_c{j}") for j, c in enumerate(columns)])
    row = counted.select("_n", *[F.when(F.col(f"_c{j}") > 0, F.kll_sketch_get_quantile_double(f"_k{j}", probs)).alias(f"_q{j}") for j in range(len(columns))]).first()
    if near:
        middles = [round(p * MOST_CELLS) - 1 for p in near]
        kept = sorted({k for m in middles for k in range(m - NEAR_CELLS, m + NEAR_CELLS + 1) if 0 <= k < MOST_CELLS - 1})
    wanted = cells or max(FEWEST_CELLS, min(MOST_CELLS, -(-row["_n"] // ROWS_PER_CELL)))
    step = max(1, MOST_CELLS // min(wanted, MOST_CELLS))
    out = {}
    for j, name in enumerate(columns):
        points = row[f"_q{j}"] or []
        edges = [points[k] for k in kept] if near and points else points[step - 1 :: step]
        unique = sorted(set(edges))
        heavy = [e for k, e in enumerate(edges) if k and edges[k - 1] == e]
        out[name] = (
            _cell(F.col(of or name), unique, sorted(set(heavy))),
            F.col(of or name).isin(sorted(set(heavy))) if heavy else F.lit(False),
        )
    return out


def _cell(value: Column, edges: list[float], heavy: list[float]) -> Column:
    """Balanced comparison tree over the cut points."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            base = F.lit(2 * lo)
            if lo and edges[lo - 1] in heavy:
                return F.when(value == F.lit(edges[lo - 1]), F.lit(2 * lo - 1)).otherwise(base)
            return base
        mid = (lo + hi) // 2
        return F.when(value < F.lit(edges[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(edges)).cast("int")


def unpivot(df: DataFrame, columns: Sequence[str], *, keep: Sequence[str], cells: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Long form (feature, value, cell, heavy) of the named columns."""
    if cells is None:
        cells = {c: (F.lit(0), F.lit(False)) for c in columns}
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(c).cast("double").alias("value"),
                cells[c][0].alias("cell"),
                cells[c][1].alias("heavy"),
            )
            for c in columns
        ]
    )
    return df.select(*keep, F.explode(entries).alias("_e")).select(*keep, "_e.*")


def distinct_cells(hist: DataFrame, cells: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Cell of every distinct value of a long table; ``cells`` from ``value_cells`` with ``of`` its value column."""
    at = F.lit(0)
    for name, (cell, _) in reversed(cells.items()):
        at = F.when(F.col("feature") == name, cell).otherwise(at)
    return hist.withColumn("cell", at)


def ecdf(df: DataFrame, groups: dict[str, Column], *, keys: Sequence[str] = ("feature",), value: str = "value", cell: str = "cell", place: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per distinct value: counts ``n_g``, cumulative ``c_g``, totals ``t_g``, ``next_value``.

    ``groups`` are conditions over the rows of ``df``; NULL values are left out.  ``place`` adds the cell to distinct
    values, so that it is not computed for every row.
    """
    names = list(groups)
    keyed = [*keys, cell]
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*(keys if place else keyed), value)
        .agg(*[F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long").alias(f"n_{g}") for g, cond in groups.items()])
    )
    if place:
        hist = stage(place(hist))
    inside = Window.partitionBy(*keyed).orderBy(value)
    along = Window.partitionBy(*keys).orderBy(cell)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = hist.groupBy(*keyed).agg(F.min(value).alias("_lo"), *[F.sum(f"n_{g}").alias(f"_s_{g}") for g in names])
    offsets = totals.select(
        *keyed,
        F.lead("_lo").over(along).alias("_next"),
        *[F.coalesce(F.sum(f"_s_{g}").over(before), F.lit(0)).alias(f"_o_{g}") for g in names],
        *[F.sum(f"_s_{g}").over(Window.partitionBy(*keys)).alias(f"t_{g}") for g in names],
    )
    local = hist.withColumns(
        {
            "_lead": F.lead(value).over(inside),
            **{f"c_{g}": F.sum(f"n_{g}").over(inside.rowsBetween(Window.unboundedPreceding, 0)) for g in names},
        }
    )
    return same(local, offsets, keyed).select(
        *keyed,
        value,
        F.coalesce("_lead", "_next").alias("next_value"),
        *[F.col(f"n_{g}") for g in names],
        *[(F.col(f"c_{g}") + F.col(f"_o_{g}")).alias(f"c_{g}") for g in names],
        *[F.col(f"t_{g}") for g in names],
    )


def _c(name: str, g: str) -> Column:
    return F.col(f"{name}_{g}")


def _share(g: str) -> Column:
    """Cumulative share of a group; NULL when the group is empty."""
    return _c("c", g) / F.nullif(_c("t", g), F.lit(0))


def ks(a: str, b: str) -> Column:
    """Two-sample Kolmogorov-Smirnov statistic (aggregate over ``ecdf`` rows)."""
    return F.max(F.abs(_share(a) - _share(b)))


def ks_pvalue(stat: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of a KS statistic (Kolmogorov series)."""
    size = F.sqrt(n * m / (n + m))
    lam = size * stat
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc + F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * lam * lam * j * j),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))


def wasserstein(a: str, b: str, value: str = "value") -> Column:
    """Area between the two distribution functions."""
    gap = F.abs(_share(a) - _share(b))
    return F.coalesce(F.sum(gap * (F.col("next_value") - F.col(value))), F.lit(0.0))


def auc(pos: str, neg: str) -> Column:
    """Rank-sum AUC with half credit for ties."""
    below = _c("c", neg) - _c("n", neg)
    pairs = F.nullif(_c("t", pos).cast("double") * _c("t", neg), F.lit(0.0))
    return F.sum(_c("n", pos) * (below + 0.5 * _c("n", neg)) / pairs)


def average_precision(pos: str, neg: str) -> Column:
    """Step-wise area under precision and recall, thresholds from high to low."""
    at_least_pos = _c("t", pos) - _c("c", pos) + _c("n", pos)
    at_least_neg = _c("t", neg) - _c("c", neg) + _c("n", neg)
    return F.sum(F.when(_c("n", pos) > 0, _c("n", pos) / F.nullif(_c("t", pos), F.lit(0)) * at_least_pos / (at_least_pos + at_least_neg)))


def quantile(g: str, p: float, value: str = "value") -> Column:
    """Exact linearly interpolated quantile of group ``g``."""
    pos = (_c("t", g) - 1) * F.lit(float(p))
    lo = F.min(F.when(_c("c", g) > F.floor(pos), F.col(value)))
    hi = F.min(F.when(_c("c", g) > F.ceil(pos), F.col(value)))
    frac = F.max(pos - F.floor(pos))
    return lo + frac * (hi - lo)

