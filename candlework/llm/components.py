"""Connected components of links, by contraction; nothing but link tables is held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm.common import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b); label is the smallest node of its component.

    Each round hangs every node under its smallest neighbour, shortens the chains to their roots, and contracts the
    links.  The number of nodes with links at least halves a round.
    """
    edges = stage(links.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
    labels = stage(edges.selectExpr("a AS node").union(edges.selectExpr("b AS node")).distinct().selectExpr("node", "node AS label"))
    while not edges.isEmpty():
        both = edges.union(edges.selectExpr("b AS a", "a AS b"))
        parent = stage(both.groupBy("a").agg(F.min("b").alias("b")).selectExpr("a AS node", "least(a, b) AS up"))
        while True:
            top = parent.selectExpr("node AS up", "up AS higher")
            higher = stage(parent.join(top, "up").selectExpr("node", "higher AS up", "higher < up AS moved"))
            unstage(parent)
            parent = higher
            if parent.where("moved").isEmpty():
                break
        roots = parent.selectExpr("node AS label", "up")
        placed = stage(labels.join(roots, "label", "left").selectExpr("node", "coalesce(up, label) AS label"))
        left, right = parent.selectExpr("node AS a", "up AS x"), parent.selectExpr("node AS b", "up AS y")
        open_edges = stage(edges.join(left, "a").join(right, "b").where("x <> y").selectExpr("least(x, y) AS a", "greatest(x, y) AS b").distinct())
        unstage(labels, parent, edges)
        labels, edges = placed, open_edges
    unstage(edges)
    return labels
