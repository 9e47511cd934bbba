"""Reading tables, staging, and small helpers shared by the operators."""

from __future__ import annotations

import os
import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.operators.staging import stage, staging_dir, unstage

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
BATCH_ROWS = 1000

__all__ = ["BYTE_TOKENIZER", "PIECE_MODEL", "WORD_TOKENIZER", "arrow_schema", "documents", "kept", "mounted_dir", "stage", "table", "text_or_empty", "tokenizer_path", "unstage"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the folder can be set in the environment."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands Python at most ``BATCH_ROWS`` rows at once.

    A batch is held by the JVM and by the worker, outside the heap; with long texts the usual 10,000 rows are too many.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)
    return df


def arrow_schema(ddl: str):
    """Arrow's form of a schema; to be called on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def kept(name: str, make):
    """An object that a worker process makes once and later tasks find again (functions come by value, globals do not stay)."""
    home = sys.modules.setdefault("candlework_worker_objects", types.ModuleType("candlework_worker_objects"))
    if name not in vars(home):
        vars(home)[name] = make()
    return vars(home)[name]


def mounted_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, as a path that every worker can map into memory.

    Mapping needs a mounted file system; a store without one is refused instead of being replaced by a local folder.
    """
    shared = staging_dir(spark)
    if "://" in shared and not shared.startswith("file://") or shared.startswith(("hdfs:", "s3")):
        raise ValueError(f"memory-mapped models need a mounted shared folder, not {shared}")
    path = shared.removeprefix("file://").removeprefix("file:")
    path = os.path.join("/" + path.lstrip("/"), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path
