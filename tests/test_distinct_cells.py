"""Cells of distinct values are those of the rows."""

from pyspark.sql import functions as F

from candlework.operators import ecdf as ed


def test_cells_of_distinct_values(spark):
    df = spark.range(2000).select((F.col("id") * 1.5).alias("a"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 50).alias("b"))
    edges = {"a": ([300.0, 900.0, 2100.0], []), "b": ([7.0, 30.0], [7.0])}
    cells = lambda of: {c: (ed._cell(F.col(of or c), *edges[c]), F.lit(False)) for c in edges}
    rows = ed.unpivot(df, ["a", "b"], keep=[], cells=cells(None)).select("feature", "value", "cell").distinct()
    hist = ed.unpivot(df, ["a", "b"], keep=[]).select("feature", "value").distinct()
    got = ed.distinct_cells(hist, cells("value")).select("feature", "value", "cell")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
