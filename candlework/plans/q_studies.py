"""Composed studies: several operators in one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import asymmetric_labels
from ..operators import labels as lb
from ..operators import splits as sp
from ..operators import tables as tb
from ..operators.staging import stage
from .q_features import ATR_SQL
from .q_labels import PASSAGE, PASSAGE_CASE, atr_bars
from .q_tables import BAR_SPLIT, STUDY_SQL, study_rows
from .registry import query

PASSAGE_ROWS = f"""{ATR_SQL}, {PASSAGE}, passed AS (SELECT n.symbol, n.ts, {PASSAGE_CASE} AS target FROM atr_t n JOIN touch USING (symbol, i) WHERE atr IS NOT NULL), {BAR_SPLIT.replace('SRC', 'passed')}"""


def passage_rows(spark, sf_dir):
    """ATR bars with the five-bar first-passage class and a chronological split."""
    rows = atr_bars(spark, sf_dir, ahead=5, extra=lambda df, w: df.withColumns(lb.first_passage_columns(w, 5)))
    kept = rows.where(F.col("atr").isNotNull()).select("symbol", "ts", F.col("first_passage_target").alias("target"))
    return sp.chronological_split(stage(kept))


@query(
    "study_first_passage",
    "split:s class:l count:l percentage:d",
    f"""WITH RECURSIVE {PASSAGE_ROWS}, c AS (SELECT unnest([0, 1, 2, 3, 4]) AS class), s AS (SELECT split, count(*) AS total FROM bar_split GROUP BY 1)
    SELECT s.split, c.class, count(r.target) AS count, 100.0 * count(r.target) / any_value(s.total) AS percentage
    FROM s CROSS JOIN c LEFT JOIN bar_split r ON r.split = s.split AND r.target = c.class GROUP BY 1, 2""",
)
def study_first_passage(spark, sf_dir):
    return tb.class_distribution(passage_rows(spark, sf_dir), ["split"], classes=(0, 1, 2, 3, 4))


@query(
    "study_first_passage_directional",
    "symbol:s split:s rows:l buy_share:d",
    f"WITH RECURSIVE {PASSAGE_ROWS} SELECT symbol, split, count(*) AS rows, avg(target) AS buy_share FROM bar_split WHERE target IN (0, 1) GROUP BY 1, 2",
)
def study_first_passage_directional(spark, sf_dir):
    """Only decided rows (ties, open and incomplete paths are left out)."""
    rows = passage_rows(spark, sf_dir).where(F.col("target").isin(0, 1))
    return rows.groupBy("symbol", "split").agg(F.count(F.lit(1)).alias("rows"), F.avg("target").alias("buy_share"))


@query(
    "study_asymmetric_labels",
    "split:s rows:l both_zero_count:l directional_count:l label_pearson_correlation:d",
    f"""WITH RECURSIVE {STUDY_SQL}, x AS (SELECT split, CAST(target = 1 AS INT) AS b, CAST(target = 0 AS INT) AS s FROM bar_split)
    SELECT split, count(*) AS rows, count(*) FILTER (WHERE b = 0 AND s = 0) AS both_zero_count, count(*) FILTER (WHERE b + s > 0) AS directional_count, corr(b, s) AS label_pearson_correlation FROM x GROUP BY 1""",
)
def study_asymmetric_labels(spark, sf_dir):
    return tb.label_audit(study_rows(spark, sf_dir).withColumns(asymmetric_labels()))
