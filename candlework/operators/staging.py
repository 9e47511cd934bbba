"""Write an expensive intermediate once and read it back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []
_SCOPES: list[list[DataFrame]] = []


def staging_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Only a session that runs in one process may do without; it gets a folder of
    its own, which is removed when Python ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        atexit.register(shutil.rmtree, _FALLBACK[0], ignore_errors=True)
    return _FALLBACK[0]


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the staging folder.

    Cuts the lineage, survives lost executors, and keeps column pruning and
    filter pushdown for whatever reads it next.
    """
    path = f"{staging_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    for made in _SCOPES:
        made.append(out)
    return out


@contextmanager
def collecting():
    """A list that gets every table staged while it is open, for a caller who knows when their last reader has run."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.pop()


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables; only for frames whose last reader has run (others are left as they are)."""
    for df in frames:
        path = vars(df).pop("_staged_at", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
