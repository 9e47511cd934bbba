"""Permutation nulls that never sort a whole table in one place.

A permutation is the order of a 64-bit hash of (seed, permutation, row key).
Choosing exactly ``k`` rows at random means finding the ``k``-th smallest hash,
which is done by counting leading bits: rows are only counted map-side, never
shuffled per permutation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import with_row_index
from .staging import stage

LEAD_BITS = 10
NEXT_BITS = 12
#: Largest number of (key, permutation) entries that is broadcast.
BROADCAST_ENTRIES = 1_000_000
#: Half the width of the bracket of a k-th hash, in deviations.
BRACKET_DEVIATIONS = 8.0
#: Distinct scores of a cell, the unit of work of shuffled labels.
VALUES_PER_CELL = 20_000
#: Keyed bijections: a prime below 2**31 (products of residues fit a long), rounds, and passes that bring a number back
#: inside (after one pass in a small table, and with a probability below 1e-24 otherwise, all numbers are).
MODULUS, ROUNDS, WALKS = 2147483647, 6, 24


def _hash(seed: int, row_key: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(seed), F.col("perm"), *[F.col(c) for c in row_key])


def _bits(h: Column, start: int, width: int) -> Column:
    """``width`` bits of the hash below its first ``start`` bits."""
    return F.shiftrightunsigned(F.shiftleft(h, start) if start else h, 64 - width)


def _boundary(counts: DataFrame, keys: Sequence[str], bucket: str, need: str) -> DataFrame:
    """Bucket in which the ``need``-th row lies and how many rows lie before it."""
    w = Window.partitionBy(*keys).orderBy(bucket)
    run = counts.withColumn("_cum", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hit = run.where((F.col("_cum") >= F.col(need)) & (F.col("_cum") - F.col("_n") < F.col(need)))
    return hit.select(*keys, F.col(bucket), (F.col(need) - F.col("_cum") + F.col("_n")).alias(f"{need}_left"))


def _per_key(table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pack the permutation rows of a key into one array (as long as there are permutations)."""
    return table.groupBy(*keys).agg(F.collect_list(F.struct("perm", *columns)).alias("_perms"))


def _spread(rows: DataFrame, packed: DataFrame, keys: Sequence[str], columns: Sequence[str], small: bool) -> DataFrame:
    """One row per input row and permutation, with that permutation's columns."""
    joined = rows.join(F.broadcast(packed) if small else packed, list(keys)).withColumn("_p", F.explode("_perms"))
    return joined.select(*rows.columns, F.col("_p.perm").alias("perm"), *[F.col(f"_p.{c}").alias(c) for c in columns])


def selection_cutoffs(rows: DataFrame, sizes: DataFrame, *, keys: Sequence[str], row_key: Sequence[str], permutations: int, seed: int = 42) -> DataFrame:
    """(keys, perm, cutoff): rows whose hash is at most ``cutoff`` form the random selection.

    ``sizes`` is (keys, k).  Hashes are compared as unsigned bit strings.  ``rows``
    is read three times, so it should be a stored table.
    """
    by = [*keys, "perm"]
    sizes = stage(sizes)
    small = sizes.count() * permutations <= BROADCAST_ENTRIES
    perms = sizes.where(F.col("k") > 0).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    h = F.col("_h")

    first = _spread(rows, _per_key(perms, keys, ["k"]), keys, ["k"], small).withColumn("_h", _hash(seed, row_key))
    counts = first.groupBy(*by, "k", _bits(h, 0, LEAD_BITS).alias("b0")).agg(F.count(F.lit(1)).alias("_n"))
    lead = _boundary(counts, [*by], "b0", "k")

    second = _spread(rows, _per_key(lead, keys, ["b0", "k_left"]), keys, ["b0", "k_left"], small).withColumn("_h", _hash(seed, row_key))
    inside = second.where(_bits(h, 0, LEAD_BITS) == F.col("b0"))
    counts = inside.groupBy(*by, "b0", "k_left", _bits(h, LEAD_BITS, NEXT_BITS).alias("b1")).agg(F.count(F.lit(1)).alias("_n"))
    next_ = _boundary(counts, [*by, "b0"], "b1", "k_left")

    third = _spread(rows, _per_key(next_, keys, ["b0", "b1", "k_left_left"]), keys, ["b0", "b1", "k_left_left"], small).withColumn("_h", _hash(seed, row_key))
    few = third.where((_bits(h, 0, LEAD_BITS) == F.col("b0")) & (_bits(h, LEAD_BITS, NEXT_BITS) == F.col("b1")))
    # All rows left share their leading 22 bits, so signed order equals unsigned order.
    ranked = few.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h")))
    return ranked.where(F.col("_r") == F.col("k_left_left")).select(*by, F.col("_h").alias("cutoff"))


def _flip(h: Column) -> Column:
    """Map unsigned order onto signed order."""
    return h.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def random_selections(rows: DataFrame, cutoffs: DataFrame, *, keys: Sequence[str], row_key: Sequence[str], seed: int = 42) -> DataFrame:
    """The selected rows of every permutation (exactly ``k`` of them each)."""
    cutoffs = stage(cutoffs)
    small = cutoffs.count() <= BROADCAST_ENTRIES
    spread = _spread(rows, _per_key(cutoffs, keys, ["cutoff"]), keys, ["cutoff"], small).withColumn("_h", _hash(seed, row_key))
    return spread.where(_flip(F.col("_h")) <= _flip(F.col("cutoff"))).drop("_h", "cutoff")


def _bracketed_null(rows: DataFrame, sizes: DataFrame, *, keys: Sequence[str], row_key: Sequence[str], permutations: int, seed: int) -> DataFrame:
    """Means of random selections in one pass over the rows.

    The k-th of N even hashes lies within a few deviations of k / N.  Rows below
    that bracket are only summed; the few inside keep their hash and are ranked.
    A permutation whose k-th hash is not inside its bracket is left out, and the
    caller counts them.
    """
    share = F.col("k") / F.col("rows")
    spread = BRACKET_DEVIATIONS * F.sqrt(F.col("k") * (1 - share) + 1) / F.col("rows")
    bounds = sizes.select(*keys, "k", (share - spread).alias("_low"), (share + spread).alias("_high"))
    drawn = rows.join(bounds, list(keys)).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    drawn = drawn.withColumn("_h", _flip(_hash(seed, row_key)))
    unit = (F.shiftrightunsigned(_flip(F.col("_h")), 11) * F.lit(2.0**-53)).alias("_u")
    near = drawn.withColumn("_u", unit).where(F.col("_u") <= F.col("_high")).withColumn("_h", F.when(F.col("_u") >= F.col("_low"), F.col("_h")))
    cells = near.groupBy(*keys, "perm", "k", "_h").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_v"), F.count("_v").alias("_m"), F.count_if(F.col("_v") > 0).alias("_up")
    )
    order = Window.partitionBy(*keys, "perm").orderBy(F.col("_h").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    upto = cells.select(*keys, "perm", "k", "_h", *[F.sum(c).over(order).alias(c) for c in ("_n", "_v", "_m", "_up")])
    found = upto.where((F.col("_n") == F.col("k")) & F.col("_h").isNotNull())
    return found.select(*keys, "perm", F.col("k").alias("selected"), (F.col("_v") / F.col("_m")).alias("statistic"), (F.col("_up") / F.col("_m")).alias("win_rate"))


def matched_selection_null(rows: DataFrame, *, value: str, selected: Column, keys: Sequence[str], row_key: Sequence[str], permutations: int = 500, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Observed mean of the selected rows, and its null under random selections of equal size.

    Returns ``(observed, null)``; ``null`` has one row per key and permutation.
    """
    slim = stage(rows.select(*keys, *row_key, F.col(value).alias("_v"), selected.alias("_sel")))
    observed = slim.groupBy(*keys).agg(F.count_if("_sel").alias("k"), F.avg(F.when(F.col("_sel"), F.col("_v"))).alias("observed"), F.count(F.lit(1)).alias("rows"))
    population = slim.drop("_sel")
    sizes = stage(observed.where("k > 0").select(*keys, "k", "rows"))
    null = stage(_bracketed_null(population, sizes, keys=keys, row_key=row_key, permutations=permutations, seed=seed))
    if null.count() == sizes.count() * permutations:
        return observed, null
    cut = selection_cutoffs(population, observed.select(*keys, "k"), keys=keys, row_key=row_key, permutations=permutations, seed=seed)
    null = random_selections(population, cut, keys=keys, row_key=row_key, seed=seed).groupBy(*keys, "perm").agg(
        F.count(F.lit(1)).alias("selected"), F.avg("_v").alias("statistic"), F.avg((F.col("_v") > 0).cast("double")).alias("win_rate")
    )
    return observed, null


def null_summary(observed: DataFrame, null: DataFrame, *, keys: Sequence[str], sample: bool = False) -> DataFrame:
    """Mean, deviation, quantiles, range and one-sided p-value of a null.

    A null has as many rows per key as there are permutations, so plain
    percentiles are enough.
    """
    dev = F.stddev_samp if sample else F.stddev_pop
    both = null.join(observed, list(keys)) if keys else null.withColumn("_one", F.lit(1)).join(observed.withColumn("_one", F.lit(1)), "_one")
    s = F.col("statistic")
    return both.groupBy(*keys, "observed").agg(
        F.count(F.lit(1)).alias("iterations"),
        F.avg(s).alias("random_mean"),
        dev(s).alias("random_std"),
        F.min(s).alias("random_min"),
        F.percentile(s, 0.05).alias("random_q05"),
        F.percentile(s, 0.5).alias("random_median"),
        F.percentile(s, 0.95).alias("random_q95"),
        F.max(s).alias("random_max"),
        ((F.count_if(s >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("one_sided_p_value"),
    )


def label_permutation_null(rows: DataFrame, *, positive: Column, score: str, row_key: Sequence[str] = (), permutations: int = 199, seed: int = 42, values_per_cell: int = VALUES_PER_CELL) -> tuple[DataFrame, DataFrame]:
    """ROC-AUC and average precision under shuffled labels, without shuffling a row.

    Rows of equal score are alike, so a shuffled labelling is only the number of positives at every distinct score: a
    multivariate hypergeometric draw.  It is drawn down a tree: first the positives of a range of scores (a cell), then
    those of its scores, with a generator seeded by (seed, permutation, cell).  A draw costs one step per distinct score
    whatever the number of rows.  Cells hold ``values_per_cell`` scores on average, so their number follows the data;
    one row per cell (three numbers) reaches the driver.  ``row_key`` is not needed any more.  Rows without a score or a label take no part.  At most 10^9
    rows, numpy's bound for such draws.
    """
    slim = rows.select(F.col(score).cast("double").alias("value"), positive.alias("_pos")).where("value IS NOT NULL AND NOT isnan(value) AND _pos IS NOT NULL")
    hist = stage(slim.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_if("_pos").alias("pos")))
    cells = max(1, -(-hist.count() // values_per_cell))
    hist = stage(hist.repartitionByRange(cells, "value").withColumn("cell", F.spark_partition_id()))
    sizes = hist.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).orderBy("cell").collect()
    numbers, n = [r["cell"] for r in sizes], [r["n"] for r in sizes]
    total, k = sum(n), sum(r["pos"] for r in sizes)

    def split(batches):
        import numpy as np
        import pandas as pd

        below = np.cumsum([0, *n[:-1]])
        for pdf in batches:
            for perm in pdf["perm"]:
                got = np.random.default_rng([seed, int(perm)]).multivariate_hypergeometric(n, k)
                above = got.sum() - np.cumsum(got)
                yield pd.DataFrame({"cell": numbers, "perm": perm, "k": got, "above": above, "below": below})

    def inside(values, draws):
        import numpy as np
        import pandas as pd

        values = values.sort_values("value")
        own = values["n"].to_numpy()
        out = []
        for cell, perm, drawn, above, below in draws[["cell", "perm", "k", "above", "below"]].itertuples(index=False):
            got = values["pos"].to_numpy() if perm == 0 else np.random.default_rng([seed, int(perm), int(cell)]).multivariate_hypergeometric(own, drawn)
            upto = below + np.cumsum(own)
            higher = above + drawn - np.cumsum(got) + got
            out.append((perm, float(got @ (upto - (own - 1) / 2)), float((got * higher / (total - upto + own)).sum())))
        return pd.DataFrame(out, columns=["perm", "ranks", "shares"])

    perms = rows.sparkSession.range(1, permutations + 1, 1, min(permutations, max(1, cells))).select(F.col("id").alias("perm"))
    drawn = perms.mapInPandas(split, "cell int, perm long, k long, above long, below long")
    real, upto, above = [], 0, k
    for r in sizes:
        above -= r["pos"]
        real.append((r["cell"], 0, r["pos"], above, upto))
        upto += r["n"]
    drawn = drawn.unionByName(rows.sparkSession.createDataFrame(real, "cell int, perm long, k long, above long, below long"))
    parts = hist.groupBy("cell").cogroup(drawn.groupBy("cell")).applyInPandas(inside, "perm long, ranks double, shares double")
    found = parts.groupBy("perm").agg(
        ((F.sum("ranks") - k * (k + 1) / 2) / F.nullif(F.lit(float(k) * (total - k)), F.lit(0.0))).alias("roc_auc"), (F.sum("shares") / F.nullif(F.lit(float(k)), F.lit(0.0))).alias("pr_auc")
    )
    long = stage(found.select("perm", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("statistic")) for m in ("roc_auc", "pr_auc")])).alias("_m")).select("perm", F.lit(k).cast("long").alias("selected"), "_m.*"))
    return long.where("perm = 0").select("metric", F.col("statistic").alias("observed")), long.where("perm > 0")


def _round_key(seed: int, perm: Column, number: int) -> Column:
    """A residue from seed, permutation and round; both engines of the tests compute it alike."""
    x = (F.lit(seed % MODULUS) + perm * 7919 + 104729 * number) % MODULUS
    return ((x * x) % MODULUS * 48271 + 11) % MODULUS


def _feistel(left: Column, right: Column, width: int, height: int, number: int, seed: int, perm: Column) -> tuple[Column, Column]:
    """One round on (left below ``width``, right below ``height``); rounds turn the halves in turn."""
    moved, by, size = (left, right, width) if number % 2 == 0 else (right, left, height)
    turned = (moved + (by + _round_key(seed, perm, 2 * number)) * (by + _round_key(seed, perm, 2 * number + 1)) % MODULUS) % size
    return (turned, right) if number % 2 == 0 else (left, turned)


def permuted_numbers(df: DataFrame, index: str, n: int, *, perm: str = "perm", seed: int = 42, out: str = "_source") -> DataFrame:
    """``out``: where permutation ``perm`` of the numbers 0 .. n - 1 sends ``index``.

    A keyed bijection: the number is a place in a rectangle of about the square root of ``n`` on a side, whose two
    coordinates turn each other for ``ROUNDS`` rounds.  What leaves the range (one number in the square root of ``n``)
    goes round again until it is inside; that ends, since the way leads through a cycle that starts inside.  Nothing is sorted or
    moved, and any permutation can be asked for any number.
    """
    width = max(1, math.isqrt(n - 1) + 1 if n else 1)
    height = max(1, -(-n // width))
    p = F.col(perm).cast("long")
    step = df.withColumns({"_left": F.col(index) % width, "_right": F.floor(F.col(index) / width)})
    for k in range(ROUNDS):
        left, right = _feistel(F.col("_left"), F.col("_right"), width, height, k, seed, p)
        step = step.withColumns({"_left": left, "_right": right})

    def turned(k: int):
        return lambda b: F.struct(*[c.alias(side) for side, c in zip("lr", _feistel(b["l"], b["r"], width, height, k, seed, p))])

    def again(x: Column) -> Column:
        both = F.struct((x % width).alias("l"), F.floor(x / width).alias("r"))
        for k in range(ROUNDS):  # a one-element array binds the value that a round reads twice
            both = F.transform(F.array(both), turned(k))[0]
        return both["r"] * width + both["l"]

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.col("_at"), lambda x, _: F.when(x < n, x).otherwise(again(x)))
    placed = step.withColumn("_at", F.col("_right") * width + F.col("_left")).drop("_left", "_right")
    return placed.withColumn(out, F.when(F.col("_at") < n, F.col("_at")).otherwise(walked)).drop("_at")


def permuted_numbers_sql(table: str, index: str, n: str, *, perm: str = "perm", seed: int = 42, out: str = "_source", name: str = "permuted") -> str:
    """The same in SQL: CTEs that end in ``name``, with the columns of ``table`` and ``out``; ``n`` names a column."""
    base = lambda k: f"(({seed % MODULUS} + {perm} * 7919 + {104729 * k}) % {MODULUS})"
    square = lambda k: f"((({base(k)} * {base(k)}) % {MODULUS} * 48271 + 11) % {MODULUS})"
    size = f"CAST(ceil(sqrt({n})) AS BIGINT)"
    ctes = [f"{name}_0 AS (SELECT *, CAST({index} AS BIGINT) AS at_, {size} AS width_, CAST(ceil({n} / CAST({size} AS DOUBLE)) AS BIGINT) AS height_ FROM {table})"]
    last = f"{name}_0"
    for walk in range(4):
        ctes.append(f"{name}_w{walk} AS (SELECT *, at_ % width_ AS l_, at_ // width_ AS r_ FROM {last})")
        last = f"{name}_w{walk}"
        for k in range(ROUNDS):
            a, b, s = ("l_", "r_", "width_") if k % 2 == 0 else ("r_", "l_", "height_")
            ctes.append(f"{name}_w{walk}_{k} AS (SELECT * REPLACE (({a} + (({b} + {square(2 * k)}) * ({b} + {square(2 * k + 1)})) % {MODULUS}) % {s} AS {a}) FROM {last})")
            last = f"{name}_w{walk}_{k}"
        moved = "r_ * width_ + l_" if walk == 0 else f"CASE WHEN at_ < {n} THEN at_ ELSE r_ * width_ + l_ END"
        ctes.append(f"{name}_{walk + 1} AS (SELECT * EXCLUDE (l_, r_) REPLACE ({moved} AS at_) FROM {last})")
        last = f"{name}_{walk + 1}"
    return ", ".join([*ctes, f"{name} AS (SELECT * EXCLUDE (at_, width_, height_), at_ AS {out} FROM {last})"])


def shuffled_columns(rows: DataFrame, columns: Sequence[str], *, row_key: Sequence[str], permutations: int, seed: int = 42) -> DataFrame:
    """Rows whose named columns come, as one block, from another row: for each of the permutations, each row once.

    The rows are numbered once, in hash cells.  A permutation is a bijection of the numbers that is computed where it is
    needed (``permuted_numbers``), so no copy of the table is sorted or numbered; the block columns are joined by number, and
    only the other side has a row per permutation.
    """
    keep = [c for c in rows.columns if c not in columns]
    hashed = rows.withColumns({"_one": F.lit(0), "_h": F.xxhash64(F.lit(seed), *[F.col(c) for c in row_key])})
    numbered = stage(with_row_index(hashed, ["_one"], ["_h", *row_key], [F.shiftright("_h", 48)], index="_i").drop("_one", "_h"))
    home = numbered.select(*keep, "_i").withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    away = numbered.select(*columns, F.col("_i").alias("_source"))
    return permuted_numbers(home, "_i", numbered.count(), seed=seed).drop("_i").join(away, "_source").drop("_source")
