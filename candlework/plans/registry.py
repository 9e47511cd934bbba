"""Catalogue of named queries, each with a result contract and an optional SQL twin.

A contract such as ``"symbol:s ts:t close:d n:l"`` fixes names, types and
rounding of a result on both sides: ``s`` string, ``t`` timestamp, ``l`` long,
``d`` double rounded to 6 digits, ``dK`` double rounded to K digits, ``q`` double
rounded to 12 digits and then to 6 (quotients of sums: their last bits follow the
order of adding, which must not decide a half).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _parse(contract: str) -> list[tuple[str, str]]:
    return [tuple(part.rsplit(":", 1)) for part in contract.split()]


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "t":
        return c.cast("timestamp").alias(name)
    if kind == "l":
        return c.cast("long").alias(name)
    r = rounded(rounded(c, 12) if kind == "q" else c, int(kind[1:] or 6))
    return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "s":
        return f'CAST("{name}" AS VARCHAR) AS "{name}"'
    if kind == "t":
        return f'CAST("{name}" AS TIMESTAMP) AS "{name}"'
    if kind == "l":
        return f'CAST("{name}" AS BIGINT) AS "{name}"'
    x = f'round(CAST("{name}" AS DOUBLE), 12)' if kind == "q" else f'CAST("{name}" AS DOUBLE)'
    r = f'round({x}, {int(kind[1:] or 6)})'
    return f'CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS "{name}"'


def rounded(c: Column, digits: int) -> Column:
    """Rounded as SQL engines round doubles: the scaled double itself, halves away from zero.

    Spark's own ``round`` takes the shortest decimal form of the number, and differs where that ends in a 5.
    """
    scale = F.lit(10.0**digits)
    x = c.cast("double")
    return F.when(F.abs(x) < 1e290, F.round(x * scale, 0) / scale).otherwise(x)


def shaped(df: DataFrame, contract: str) -> DataFrame:
    return df.select(*[_spark_column(*part) for part in _parse(contract)])


def query(name: str, contract: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``.

    ``sql`` is a statement, optionally starting with ``WITH``; its last select
    must deliver the contract's columns.
    """

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: shaped(fn(spark, sf_dir), contract)
        if sql is not None:
            ORACLES[name] = f"SELECT {', '.join(_sql_column(*p) for p in _parse(contract))} FROM ({sql}) AS result"
        return fn

    return wrap
