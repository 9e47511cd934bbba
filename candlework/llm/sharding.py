"""Shards of near-equal bytes from a minimax contiguous partition of atomic groups.

Groups (rows of equal text) are ordered by the digest of their text, so the order is even and never depends on the
table's own.  The smallest capacity at which a greedy walk fits all groups into the shards is found by binary search.
The walk needs group boundaries only near its cuts, so groups are first summed into cells of equal digest prefix; the
walk is checked with cells that may not be cut (its result is feasible) and with cells that may be cut anywhere (a
lower bound), and the cells in which the two can differ are split by two more digits until they agree.  What is held
at once is a few thousand cells, whatever the number of groups.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlework.llm.common import stage, text_or_empty

SHARDS = 16
#: Rows of a cell in which slots are numbered.
SLOT_ROWS = 20_000
DIGITS = 2

# The largest boundary that is not above x, by position in the array ``ends`` (which starts with 0).
_FIND = (
    "aggregate(sequence(1, 40), struct(0 AS lo, size(ends) - 1 AS hi), (s, z) -> "
    "CASE WHEN s.lo = s.hi THEN s WHEN ends[CAST((s.lo + s.hi + 1) div 2 AS INT)] <= {x} THEN struct(CAST((s.lo + s.hi + 1) div 2 AS INT) AS lo, s.hi AS hi) "
    "ELSE struct(s.lo AS lo, CAST((s.lo + s.hi + 1) div 2 AS INT) - 1 AS hi) END, s -> s.lo)"
)
_WHOLE = f"ends[{_FIND.format(x='p + c')}]"
_LOOSE = f"CASE WHEN p + c >= total THEN total WHEN atomic[{_FIND.format(x='p + c')}] THEN {_WHOLE} ELSE p + c END"


def _walk(step: str, capacity: str, shards: int) -> str:
    """All cuts of the greedy walk, the last of which is the total if the capacity is enough."""
    body = step.replace("p + c", f"element_at(w, -1) + {capacity}")
    return f"aggregate(sequence(1, {shards}), array(0L), (w, k) -> array_append(w, {body}))"


def _smallest(step: str, shards: int) -> str:
    """The smallest capacity whose walk ends at the total."""
    fits = f"element_at({_walk(step, '((b.lo + b.hi) div 2)', shards)}, -1) >= total"
    return (
        "aggregate(sequence(1, 63), struct(0L AS lo, total AS hi), (b, z) -> CASE WHEN b.lo >= b.hi THEN b "
        f"WHEN {fits} THEN struct(b.lo AS lo, (b.lo + b.hi) div 2 AS hi) ELSE struct((b.lo + b.hi) div 2 + 1 AS lo, b.hi AS hi) END, b -> b.hi)"
    )


def _summed(groups: DataFrame, digits: int) -> DataFrame:
    return groups.groupBy(F.substring("name", 1, digits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("groups"))


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[str]]:
    """Smallest capacity and the upper bounds (exclusive, on ``name``) of all shards but the last.

    ``groups`` has ``name`` (hexadecimal digest, distinct) and ``bytes`` (positive).
    """
    digits, cells = DIGITS, stage(_summed(groups, DIGITS))
    while True:
        order = W.partitionBy(F.lit(1)).orderBy("cell")  # cells, whose number is bounded
        placed = cells.withColumn("end", F.sum("bytes").over(order))
        row = placed.agg(F.sort_array(F.collect_list(F.struct("end", (F.col("groups") == 1).alias("atomic"), "cell"))).alias("c"))
        row = row.select(
            F.expr("concat(array(0L), c.end)").alias("ends"),
            F.expr("concat(c.atomic, array(true))").alias("atomic"),
            F.expr("concat(array(''), c.cell)").alias("names"),
            F.expr("coalesce(element_at(c.end, -1), 0L)").alias("total") if not cells.isEmpty() else F.lit(0).cast("long").alias("total"),
        )
        row = row.withColumns({"loose": F.expr(_smallest(_LOOSE, shards)), "whole": F.expr(_smallest(_WHOLE, shards))})
        row = row.withColumns({"early": F.expr(_walk(_WHOLE, "loose", shards)), "late": F.expr(_walk(_LOOSE, "whole", shards))})
        # Cells that can hold a cut at some capacity between the bounds.
        near = "exists(sequence(1, size(early) - 1), j -> ends[i] > early[j] AND ends[i - 1] < late[j])"
        picked = F.expr(f"transform(filter(sequence(0, size(ends) - 1), i -> i > 0 AND NOT atomic[i - 1] AND {near}), i -> names[i])")
        split = stage(row.select(F.explode(picked).alias("cell")))
        if split.isEmpty():
            walk = F.expr(_walk(_WHOLE, "whole", shards))
            bounds = F.expr("transform(slice(walk, 2, size(walk) - 2), p -> names[array_position(ends, p) - 1])")
            found = row.withColumn("walk", walk).select("whole", bounds.alias("names")).first()
            return int(found["whole"]), [f"{name}~" if name else "" for name in found["names"]]
        digits += DIGITS
        inside = groups.withColumn("cell", F.substring("name", 1, digits - DIGITS)).join(split.hint("broadcast"), "cell", "left_semi")
        same = cells.join(split.hint("broadcast"), "cell", "left_anti")
        cells = stage(same.unionByName(_summed(inside, digits)))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text plus 1; a null text counts as empty and shares a group with empty texts.
    Rows of equal text are never parted; sizes of shards are as equal as contiguous groups allow.  Repeated rows are
    placed one by one; an empty table gives no rows; with fewer groups than shards some shards stay empty; other
    columns are left out.
    """
    text = text_or_empty()
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("name"),
        )
    )
    groups = stage(rows.groupBy("name").agg(F.sum("size").alias("bytes")))
    _, bounds = minimax_cuts(groups, shards)
    upper = F.array(*[F.lit(b) for b in bounds]).cast("array<string>")
    shard = F.size(F.filter(upper, lambda b: (b < F.col("name")))).cast("int")
    cells = max(1, rows.count() // (shards * SLOT_ROWS))
    dealt = rows.withColumn("shard", shard).withColumn("cell", F.pmod(F.xxhash64("doc_id", "name"), F.lit(cells)))
    counts = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "name"))
    return (
        dealt.withColumn("at", inside)
        .join(starts, ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("at") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
