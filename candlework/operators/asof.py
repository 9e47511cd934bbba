"""Point-in-time joins: newest source row available at or before a moment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import placeable
from .staging import stage, unstage


@dataclass(frozen=True)
class Source:
    """One right-hand side of an as-of join.

    ``order`` breaks ties between rows of the same time; a match older than
    ``max_age_seconds`` counts as missing (``None`` means no limit).  ``only``
    keeps some rows; sources that differ in it (and in names) but share a frame are read from it together.
    """

    frame: DataFrame
    time: str
    max_age_seconds: int | None
    order: Sequence[str] = ()
    prefix: str = ""
    source_time: str = "source_ts"
    age: str = "age_seconds"
    only: Column | None = None
    without: Sequence[str] = ()

    def columns(self, by: Sequence[str]) -> list[str]:
        return [c for c in self.frame.columns if c not in by and c not in self.without]


def require_predictions(left: DataFrame, by: Sequence[str], left_time: str) -> None:
    """Raise unless the moments asked for are instants and come once per key (rows without a time apart)."""
    kind = left.schema[left_time].dataType.typeName()
    if kind != "timestamp":
        raise TypeError(f"{left_time} is {kind}; prediction times must be UTC instants")
    twice = left.where(F.col(left_time).isNotNull()).groupBy(*by, left_time).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    found = twice.agg(F.count(F.lit(1)).alias("times"), F.min(left_time).alias("first")).first()
    if found["times"]:
        raise ValueError(f"{found['times']} prediction times come more than once, the first is {found['first']}")


def asof_many(left: DataFrame, sources: Sequence[Source], *, by: Sequence[str] = (), left_time: str, strict: bool = False, partitions: int | None = None) -> DataFrame:
    """Attach to every left row the newest row of each source at or before its time.

    All source columns but the keys come over (with the source's prefix), with
    the matched time and its age.  A matched row keeps its NULL values and never
    falls through to an older row.  ``strict`` asks for unique instants on the left.

    Every table is read once, into one union of left and source rows that is dealt to range partitions of (keys, time).
    A partition's state is the last row it holds of each source; states are merged along the partitions, and rows look
    back inside their own partition, then at the state before it.  Partitions follow the rows, so neither a long key nor a busy
    day, nor many left rows at one moment, land in one task.  A left row without a key or time matches nothing
    and stays in the result; source rows without a key or time match nothing.
    """
    if strict:
        require_predictions(left, by, left_time)
    own = F.struct(*[F.col(c) for c in left.columns])
    both = left.select(*by, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), own.alias("_left"), F.xxhash64(own).alias("_tie"))
    shared: dict[tuple, list[int]] = {}
    for k, s in enumerate(sources):
        shared.setdefault((id(s.frame), s.time, tuple(s.order)), []).append(k)
    ranks = []
    for g, (members, (_, time, tied)) in enumerate((m, key) for key, m in shared.items()):
        frame = sources[members[0]].frame
        packed = []
        for k in members:
            own = F.struct(F.col(time).alias("_t"), *[F.col(c).alias(f"v_{c}") for c in sources[k].columns(by)])
            packed.append((own if sources[k].only is None else F.when(sources[k].only, own)).alias(f"_src{k}"))
        # Equal times are told apart by the source's own order; the last one is what a match sees.
        rank = [F.struct(*[F.col(c) for c in tied]).alias(f"_rank{g}")] if tied else []
        ranks += [f"_rank{g}"] if tied else []
        right = placeable(frame, [*by, time]).select(*by, F.col(time).alias("_time"), F.lit(0).alias("_side"), *packed, *rank)
        both = both.unionByName(right, allowMissingColumns=True)
    names = [f"_src{k}" for k in range(len(sources))]
    order = ["_time", "_side", *ranks]
    read = stage(both)
    shards = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(read.repartitionByRange(shards, *by, *order, "_tie").withColumn("_part", F.spark_partition_id()).drop("_tie"))
    unstage(read)
    keys = [*by, "_part"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    states = dealt.groupBy(*keys).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.struct("_time", *ranks))).alias(n) for n in names])
    carried = states.select(*keys, *[F.last(n, ignorenulls=True).over(before).alias(f"_carry{n}") for n in names])
    hit = dealt.withColumns({n: F.last(n, ignorenulls=True).over(inside) for n in names}).where(F.col("_side") == 1)
    joined = hit.join(carried, keys, "left").select("_left", *[F.coalesce(n, f"_carry{n}").alias(n) for n in names])

    out = [F.col(f"_left.{c}").alias(c) for c in left.columns]
    at = F.unix_micros(F.col(f"_left.{left_time}").cast("timestamp"))
    for n, s in zip(names, sources):
        seconds = (at - F.unix_micros(F.col(f"{n}._t").cast("timestamp"))) / F.lit(1e6)
        fresh = F.col(n).isNotNull() if s.max_age_seconds is None else seconds <= s.max_age_seconds
        out += [
            F.when(fresh, F.col(f"{n}.v_{c}")).alias(f"{s.prefix}{c}") for c in s.columns(by) if c != s.time
        ]
        out += [F.when(fresh, F.col(f"{n}._t")).alias(s.source_time), F.when(fresh, seconds).alias(s.age)]
    return joined.select(*out)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str] = (),
    left_time: str,
    right_time: str,
    max_age_seconds: int | None,
    order: Sequence[str] = (),
    prefix: str = "",
    strict: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """As-of join with a single source; see ``asof_many``."""
    source = Source(right, right_time, max_age_seconds, order, prefix)
    return asof_many(left, [source], by=by, left_time=left_time, strict=strict, partitions=partitions)


def asof_audit(joined: DataFrame, *, left_time: str, family: str | None = None, keys: Sequence[str] = (), source_time: str = "source_ts", age: str = "age_seconds") -> DataFrame:
    """Coverage and causality summary of an as-of result, one row per family."""
    grouping = [F.lit(family).alias("family")] if family else [F.col(k) for k in keys]
    return joined.groupBy(*grouping).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(source_time).alias("matched_rows"),
        F.max(age).alias("max_age_seconds"),
        F.max(source_time).alias("max_source_ts"),
        F.count_if(F.col(source_time) > F.col(left_time)).alias("future_observations"),
    )
