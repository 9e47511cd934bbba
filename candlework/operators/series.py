"""Ordered-series kernels: row index, halo blocks, running totals, decayed means.

A window partitioned only by the series key sends a whole series to one task.
The kernels here cut every series into blocks of a fixed number of rows
instead.  A block also receives copies of the neighbouring rows its frames can
reach, so a row frame gives the same answer as it would over the whole series,
and one series holding most of the table is spread over as many tasks as it
has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

INDEX = "bar_index"
BLOCK = "_block"
HOME = "_home"
MIN_BLOCK_ROWS = 2048
#: Steps of the first cell column that are scanned together.
CELLS_PER_CHUNK = 4096


def time_cell(ts: str, seconds: int = 86400) -> Column:
    """Grid cell of a timestamp; non-decreasing in time."""
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / F.lit(seconds)).cast("long")


def with_row_index(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    cells: Sequence[Column],
    *,
    index: str = INDEX,
    total: str | None = None,
) -> DataFrame:
    """Zero-based position of each row inside its series.

    ``cells`` are expressions that, read as a tuple, never decrease along
    ``order``.  Rows are numbered inside a cell and shifted by the number of
    rows in earlier cells.  The table of cell counts is scanned in two levels as
    well: ``CELLS_PER_CHUNK`` cells at a time, and the totals of those chunks.

    A row without key or time has no place in a series: it is left
    out before anything is counted, and ``unplaced_rows`` returns it.
    """
    names = [f"_cell{k}" for k in range(len(cells))]
    celled = placeable(df.withColumns(dict(zip(names, cells))), [*by, *names])
    keys = [*by, *names]
    counts = celled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    starts = _cell_starts(counts, by, names, "_index_total" if total else None)
    local = celled.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    placed = local.join(starts, keys).withColumn("_index", (F.col("_start") + F.col("_pos") - 1).cast("long"))
    return placed.drop("_start", "_pos", *names).withColumnsRenamed({"_index": index, **({"_index_total": total} if total else {})})


def placeable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows in which none of the columns is NULL."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def unplaced_rows(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that no series can hold because a key or an order column is NULL."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in [*by, *order]]))


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys equal each other; the keys come once, from the left."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    equal = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, equal, how).drop(*[f"_right_{k}" for k in keys])


def _cell_starts(counts: DataFrame, by: Sequence[str], names: Sequence[str], total: str | None) -> DataFrame:
    """Rows in earlier cells of the same series, for every cell.

    The first cell column is coarsened to a chunk; chunks are summed first, so a
    task scans the cells of one chunk or the chunks of one series.
    """
    chunk = F.floor(F.col(names[0]) / CELLS_PER_CHUNK).alias("_chunk")
    chunked = counts.withColumn("_chunk", chunk)
    sums = chunked.groupBy(*by, "_chunk").agg(F.sum("_n").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_sum").over(Window.partitionBy(*by)).alias(total)] if total else []
    bases = sums.select(*by, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), *extra)
    inside = Window.partitionBy(*by, "_chunk").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.select(*by, "_chunk", *names, F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_before"))
    start = (F.col("_base") + F.col("_before")).alias("_start")
    return local.join(bases, [*by, "_chunk"]).select(*by, *names, start, *([total] if total else []))


def cell_ranks(counted: DataFrame, by: Sequence[str], cells: Sequence[str], n: str) -> DataFrame:
    """Counted cells with the rows of earlier cells (``_start``) and of the whole series (``_total``).

    A step function of a row's position that is equal at a cell's first and last row holds for all its rows, so
    only cells that a step cuts need an order inside.
    """
    starts = _cell_starts(counted.withColumn("_n", F.col(n)), by, cells, "_total")
    return counted.join(starts, [*by, *cells])


def block_rows(back: int, ahead: int) -> int:
    """Rows per block: long enough that copied rows stay a small share."""
    return max(MIN_BLOCK_ROWS, 4 * (back + ahead))


def in_blocks(
    df: DataFrame,
    *,
    back: int = 0,
    ahead: int = 0,
    rows: int | None = None,
    index: str = INDEX,
) -> DataFrame:
    """Assign rows to blocks, copying ``back``/``ahead`` neighbours into each.

    Adds ``_block`` and ``_home`` (true on the one copy that owns the row).
    """
    rows = rows or block_rows(back, ahead)
    i = F.col(index)
    first = F.greatest(F.lit(0), F.floor((i - ahead) / rows)).cast("long")
    last = F.floor((i + back) / rows).cast("long")
    own = F.floor(i / rows).cast("long")
    spread = df.withColumn(BLOCK, F.explode(F.sequence(first, last))) if back or ahead else df.withColumn(BLOCK, own)
    return spread.withColumn(HOME, F.col(BLOCK) == own)


def block_tasks(df: DataFrame) -> int:
    """Tasks that blocks are dealt to: a number that Spark keeps.

    Blocks are small and costly, and adaptive execution would join them, by their bytes, to about one task per core;
    one task more than cores then doubles the time.
    """
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def over_series(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    by: Sequence[str] = ("symbol",),
    ts: str = "ts",
    back: int = 0,
    ahead: int = 0,
    rows: int | None = None,
    cell_seconds: int = 86400,
    keep_blocks: bool = False,
) -> DataFrame:
    """Run ``build(frame, window)`` over every series, block by block.

    ``window`` carries partitioning and order only; frames inside ``build`` may
    reach at most ``back`` rows behind and ``ahead`` rows in front of a row.
    A frame that is already indexed is used as it is.
    """
    indexed = df if INDEX in df.columns else with_row_index(df, by, [ts], [time_cell(ts, cell_seconds)])
    blocked = in_blocks(indexed, back=back, ahead=ahead, rows=rows).repartition(block_tasks(df), *by, BLOCK)
    w = Window.partitionBy(*by, BLOCK).orderBy(INDEX)
    out = build(blocked, w).where(F.col(HOME))
    return out if keep_blocks else out.drop(BLOCK, HOME)


def running_sum(
    df: DataFrame,
    columns: dict[str, str],
    *,
    by: Sequence[str] = ("symbol",),
    index: str = INDEX,
    rows: int = MIN_BLOCK_ROWS,
    maximum: dict[str, str] | None = None,
) -> DataFrame:
    """Cumulative sums (and running maxima) along each series in two levels.

    ``columns`` and ``maximum`` map a new column to its source column.  Block
    totals are scanned along the series, rows only inside their own block.
    """
    maximum = maximum or {}
    base = df if BLOCK in df.columns else df.withColumn(BLOCK, F.floor(F.col(index) / rows).cast("long"))
    keys = [*by, BLOCK]
    inside = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy(*keys).agg(
        *[F.sum(src).alias(f"_tot_{new}") for new, src in columns.items()],
        *[F.max(src).alias(f"_tot_{new}") for new, src in maximum.items()],
    )
    carried = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_tot_{new}").over(before), F.lit(0)).alias(f"_car_{new}") for new in columns],
        *[F.max(f"_tot_{new}").over(before).alias(f"_car_{new}") for new in maximum],
    )
    local = base.withColumns(
        {
            **{new: F.coalesce(F.sum(src).over(inside), F.lit(0)) for new, src in columns.items()},
            **{new: F.max(src).over(inside) for new, src in maximum.items()},
        }
    )
    joined = local.join(carried, keys)
    return joined.withColumns(
        {
            **{new: F.col(new) + F.col(f"_car_{new}") for new in columns},
            **{new: F.greatest(F.col(new), F.col(f"_car_{new}")) for new in maximum},
        }
    ).drop(BLOCK, *[f"_car_{new}" for new in (*columns, *maximum)])


def rolling(agg: Column, w: WindowSpec, n: int, *, seen: Column, min_periods: int | None = None) -> Column:
    """``agg`` over the last ``n`` rows, NULL until enough values were seen."""
    frame = w.rowsBetween(-(n - 1), 0)
    need = n if min_periods is None else min_periods
    return F.when(F.count(seen).over(frame) >= need, agg.over(frame))


def decay_reach(alpha: float) -> int:
    """Rows after which an exponential weight is below double precision."""
    return math.ceil(40.0 / -math.log1p(-alpha))


def decayed_mean(
    x: Column,
    alpha: float,
    w: WindowSpec,
    *,
    back: int,
    rows: int,
    adjust: bool,
    min_periods: int = 0,
) -> Column:
    """Exponentially weighted mean inside halo blocks.

    The weight of a row older than the halo is below double precision, so a
    block needs nothing from before its halo.  Weights are taken relative to
    the block start to keep the powers finite.
    """
    if back < decay_reach(alpha):
        raise ValueError("look-back halo is shorter than the decay reach")
    beta = 1.0 - alpha
    if (back + rows) * -math.log(beta) > 690:
        raise ValueError("block is too long for this decay rate")
    i = F.col(INDEX)
    k = i - F.greatest(F.lit(0), F.col(BLOCK) * rows - back)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    first_weight = 1.0 if adjust else alpha
    weight = F.when(i == 0, F.lit(1.0)).otherwise(F.lit(first_weight))
    total = F.sum(weight * x * F.pow(F.lit(beta), -k)).over(upto) * F.pow(F.lit(beta), k)
    mean = total * (1.0 - beta) / (1.0 - F.pow(F.lit(beta), i + 1)) if adjust else total
    return F.when(i + 1 >= min_periods, mean) if min_periods else mean
