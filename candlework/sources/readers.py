"""Readers of landed files and of sealed parts of a stored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import NEW_YORK, number
from ..operators.series import with_row_index
from ..schema import BAR, OBSERVATION, SIDECAR

PRICE = ("open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str, *, columns: Sequence[str] | None = None) -> DataFrame:
    """Stored bars with a fixed schema; only the named columns are read."""
    df = spark.read.schema(BAR).parquet(path)
    return df.select(*columns) if columns else df


def read_csv_bars(spark: SparkSession, path: str, *, symbol: str | None = None) -> DataFrame:
    """CSV bars with a header: parse the date, keep price columns, drop incomplete rows."""
    names = ["Date", "Open", "High", "Low", "Close", "Volume"]
    fields = (["symbol STRING"] if symbol is None else []) + ["Date TIMESTAMP"] + [f"{n} DOUBLE" for n in names[1:]]
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(", ".join(fields)).csv(path)
    key = F.col("symbol") if symbol is None else F.lit(symbol)
    return raw.select(key.alias("symbol"), F.col("Date").alias("ts"), *[number(F.col(n)).alias(n.lower()) for n in names[1:]]).na.drop()


def vendor_bars(raw: DataFrame, *, symbol: str = "symbol") -> DataFrame:
    """Vendor rates (epoch seconds, ``tick_volume``) in the bar schema."""
    return raw.select(
        symbol,
        F.timestamp_seconds(F.col("time")).alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in PRICE[:4]],
        F.col("tick_volume").cast("double").alias("volume"),
    )


def merge_chunks(chunks: DataFrame, *, by: Sequence[str] = ("symbol",), ts: str = "ts", chunk: str = "chunk_id", start: Column | None = None, end: Column | None = None, end_exclusive: bool = False) -> DataFrame:
    """One row per key and time out of overlapping chunks, the latest chunk winning.

    Adds ``copies``, the number of rows merged into each.
    """
    t = F.col(ts)
    kept = chunks
    if start is not None:
        kept = kept.where(t >= start)
    if end is not None:
        kept = kept.where(t < end if end_exclusive else t <= end)
    rest = [c for c in chunks.columns if c not in (*by, ts, chunk)]
    merged = kept.groupBy(*by, ts).agg(F.max_by(F.struct(*rest), chunk).alias("_r"), F.count(F.lit(1)).alias("copies"))
    return merged.select(*by, ts, *[F.col(f"_r.{c}").alias(c) for c in rest], "copies")


def observation_rows(df: DataFrame, *, source: str, version: str, instrument: Column, field: Column, value: Column, source_time: Column, available: Column, received: Column | None = None, revision: Column | None = None) -> DataFrame:
    """Project any frame to the long observation schema."""
    digest = F.sha2(F.concat_ws("|", instrument, field, source_time.cast("string"), value.cast("string")), 256)
    made = {
        "source": F.lit(source),
        "dataset_version": F.lit(version),
        "instrument_or_event_id": instrument,
        "field": field,
        "value": value.cast("double"),
        "source_time_utc": source_time,
        "available_time_utc": available,
        "received_time_utc": available if received is None else received,
        "revision_id": F.lit("initial") if revision is None else revision,
        "quality_flags": F.lit("ok"),
        "raw_batch_sha256": digest,
    }
    return df.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in OBSERVATION])


def _local_evening(day: Column, hour: int) -> Column:
    """A New York wall-clock hour of a date, as UTC."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.make_dt_interval(hours=F.lit(hour)), NEW_YORK)


def read_yield_curve(spark: SparkSession, path: str, tags: dict[str, str], *, row_tag: str = "entry", date_tag: str = "NEW_DATE") -> DataFrame:
    """Yield-curve XML to observations, usable from 18:00 New York time of the day.

    ``tags`` maps an XML tag to an instrument name; other tags are not parsed.
    """
    schema = ", ".join([f"`{date_tag}` STRING", *[f"`{t}` DOUBLE" for t in tags]])
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)
    pairs = F.array(*[F.struct(F.lit(n).alias("i"), F.col(t).alias("v")) for t, n in tags.items()])
    day = F.to_date(F.substring(date_tag, 1, 10))
    long = raw.select(day.alias("day"), F.explode(pairs).alias("p")).where(F.col("p.v").isNotNull())
    return observation_rows(
        long, source="yield_curve", version="v1", instrument=F.col("p.i"), field=F.lit("yield_percent"), value=F.col("p.v"),
        source_time=F.col("day").cast("timestamp"), available=_local_evening(F.col("day"), 18),
    )


def read_index_history(spark: SparkSession, path: str, instrument: str, *, value_columns: Sequence[str] = ("CLOSE", "VALUE"), cutoff: Column | None = None) -> DataFrame:
    """Daily index CSV (header in any case, MM/dd/yyyy dates) to observations.

    The first of ``value_columns`` present is the value; rows are usable from
    17:00 New York time and cut at ``cutoff``.
    """
    raw = spark.read.option("header", True).csv(path)
    tidy = raw.toDF(*[c.strip().upper() for c in raw.columns])
    chosen = next((c for c in value_columns if c in tidy.columns), None)
    if chosen is None:
        raise ValueError(f"no value column among {tidy.columns}")
    day = F.to_date(F.trim("DATE"), "MM/dd/yyyy")
    rows = tidy.select(day.alias("day"), F.col(chosen).cast("double").alias("v")).na.drop()
    out = observation_rows(
        rows, source="index_history", version="v1", instrument=F.lit(instrument), field=F.lit("close"), value=F.col("v"),
        source_time=F.col("day").cast("timestamp"), available=_local_evening(F.col("day"), 17),
    )
    return out if cutoff is None else out.where(F.col("available_time_utc") <= cutoff)


def sealed_scan(df: DataFrame, *, columns: Sequence[str], until: Column | None = None, since: Column | None = None, ts: str = "ts") -> DataFrame:
    """Only the named columns of only the allowed time range; both reach the file scan."""
    out = df.select(*dict.fromkeys(columns))
    if until is not None:
        out = out.where(F.col(ts) <= until)
    if since is not None:
        out = out.where(F.col(ts) >= since)
    return out


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIDECAR).option("multiLine", False).json(path)


#: Digests that one digest of the next level covers.
DIGEST_FANOUT = 4096


def file_manifest(spark: SparkSession, path: str, *, pattern: str = "*", fanout: int = DIGEST_FANOUT) -> DataFrame:
    """(file, length, sha256) of every file below ``path``, named relative to it; ``sha256`` is the root of a tree of digests.

    A file is read in the blocks that Spark's text source deals out, cut at line feeds, whatever it contains.  The pieces
    are numbered along the file, ``fanout`` neighbours make a range with one digest, ranges make larger ranges, and the
    root is hashed with the length.  No value holds more than a piece (a stretch without a line feed) or ``fanout``
    digests, and the result does not depend on how the file was dealt out.  Empty files, which Spark's readers leave out, are not listed.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    relative = lambda c: F.substring_index(c, f"/{name}/", -1)
    options = {"recursiveFileLookup": "true", "pathGlobFilter": pattern}
    listed = spark.read.format("binaryFile").options(**options).load(path).select(relative("path").alias("file"), "length")
    text = spark.read.format("text").options(lineSep="\n", **options).load(path)
    pieces = text.select(
        relative("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"), F.sha2(F.col("value").cast("binary"), 256).alias("digest")
    )
    ranges = with_row_index(pieces, ["file"], ["_at", "_row"], [F.col("_at"), F.shiftright("_row", 12)], index="number").select("file", "number", "digest")
    for _ in range(3):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "digest"))), lambda x: x["digest"]), "")
        ranges = ranges.groupBy("file", F.floor(F.col("number") / fanout).alias("number")).agg(F.sha2(joined, 256).alias("digest"))
    root = ranges.groupBy("file").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "digest"))), lambda x: x["digest"]), ""), 256).alias("digest"))
    return listed.join(root, "file").select("file", "length", F.sha2(F.concat_ws(":", "length", "digest"), 256).alias("sha256"))


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed or changed between two manifests."""
    b = before.select("file", F.col("sha256").alias("before"))
    a = after.select("file", F.col("sha256").alias("after"))
    state = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
        .when(F.col("before") != F.col("after"), "changed").otherwise("same")
    )
    return b.join(a, "file", "full").withColumn("state", state)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row per key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
