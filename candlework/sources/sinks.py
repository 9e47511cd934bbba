"""Writers.  Immutable outputs refuse to replace what exists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_immutable(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_dataset(df: DataFrame, metadata: DataFrame, path: str, *, by: str = "symbol", ts: str = "ts") -> None:
    """Processed rows, clustered by series and time, with their metadata beside them.

    Rows are range-partitioned on (series, time), so one long series spans many
    files and time filters prune row groups.
    """
    df.repartitionByRange(by, ts).sortWithinPartitions(by, ts).write.mode("errorifexists").parquet(f"{path}/data")
    metadata.write.mode("errorifexists").json(f"{path}/metadata")


def write_metrics(df: DataFrame, path: str, *, fmt: str = "csv") -> None:
    """Metric tables (one row per metric) as CSV or JSON."""
    writer = df.coalesce(1).write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unsupported metric format: {fmt}")


def provenance_json(df: DataFrame, column: str = "provenance") -> DataFrame:
    """One JSON document per row of a summary frame."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))
