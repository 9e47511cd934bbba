"""Binning rules.  Which side of a bin is closed is always explicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_right_closed(x: Column, edges: Sequence[float], labels: Sequence, *, include_lowest: bool = False) -> Column:
    """``(edge, next]`` bins; values outside are NULL."""
    out = F.lit(None)
    for k in range(len(edges) - 2, -1, -1):
        inside = (x > edges[k]) & (x <= edges[k + 1])
        if include_lowest and k == 0:
            inside = (x >= edges[0]) & (x <= edges[1])
        out = F.when(inside, F.lit(labels[k])).otherwise(out)
    return out


def bin_left_closed(x: Column, edges: Sequence[float], labels: Sequence, *, include_highest: bool = False) -> Column:
    """``[edge, next)`` bins; values outside are NULL."""
    out = F.lit(None)
    last = len(edges) - 2
    for k in range(last, -1, -1):
        inside = (x >= edges[k]) & (x < edges[k + 1])
        if include_highest and k == last:
            inside = (x >= edges[k]) & (x <= edges[k + 1])
        out = F.when(inside, F.lit(labels[k])).otherwise(out)
    return out


def bin_by_edges(x: Column, inner: Column, *, right_closed: bool) -> Column:
    """Bin number from an array of inner edges, outer edges being infinite."""
    if right_closed:
        return F.size(F.filter(inner, lambda e: e < x))
    return F.size(F.filter(inner, lambda e: e <= x))


def rank_bin(index: Column, n: Column, q: int) -> Column:
    """Equal-frequency bin of a zero-based rank out of ``n`` (right-closed rank edges)."""
    return F.greatest(F.ceil(index * F.lit(q) / F.greatest(n - 1, F.lit(1))) - 1, F.lit(0)).cast("int")


# Probability histogram and calibration buckets (left-closed).
PROBABILITY_EDGES = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.90, 0.95, 1.00]
CALIBRATION_EDGES = [0.50, 0.60, 0.70, 0.80, 0.90, 1.00]


def range_labels(edges: Sequence[float]) -> list[str]:
    return [f"{a:.2f}-{b:.2f}" for a, b in zip(edges, edges[1:])]
