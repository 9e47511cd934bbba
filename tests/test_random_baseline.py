"""Random guesses from class priors: shares compared as digits of a hash."""

import hashlib

import pytest
from pyspark.sql import functions as F

from candlework.operators import metrics as mt


@pytest.mark.parametrize("share", [0.0, 1e-12, 0.25, 1 / 3, 0.999999999999, 1.0])
def test_hash_below_is_the_share_of_the_number(spark, share):
    edge = int(share * (1 << 32))
    firsts = [x for x in (0, 1, edge - 1, edge, edge + 1, (1 << 32) - 1) if 0 <= x < 1 << 32]
    rows = spark.createDataFrame([(f"{x:08x}" + end, x) for x in firsts for end in ("0" * 24, "f" * 24)], "d string, x long")
    for r in rows.select("x", mt.hash_below("d", share).alias("below")).collect():
        assert r.below == (r.x / (1 << 32) < share)


def test_guesses_are_those_of_the_named_hash(spark):
    keyed = [(i, None if i % 7 == 0 else str(i % 5), i % 3) for i in range(300)]
    got = mt.prior_baseline(spark.createDataFrame(keyed, "a long, b string, target int"), row_key=["a", "b"], runs=3).first()
    hits = 0
    p0, p01 = 100 / 300, 100 / 300 + 100 / 300
    for run in range(3):
        for a, b, t in keyed:
            name = "|".join(["42", str(run), str(a), *([b] if b is not None else [])])
            u = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / (1 << 32)
            hits += t == (0 if u < p0 else 1 if u < p01 else 2)
    assert got.runs == 3 and got.accuracy == pytest.approx(hits / 900)
