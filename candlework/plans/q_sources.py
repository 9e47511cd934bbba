"""Queries for readers, sinks, validation and data contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import number, quotient, reconstruct_ohlc
from ..operators import price_features as pf
from ..operators import quality as ql
from ..operators.splits import split_metadata
from ..operators.staging import stage, staging_dir
from ..schema import INTERVAL_SECONDS
from ..sources import readers as rd
from ..sources import sinks as sk
from .inputs import DAILY_SQL, OBSERVATIONS_SQL, SCORED_SPLIT_SQL, bars, bars_sql, daily_bars, observations, table
from .q_features import KEY, NUMBERED
from .q_tables import scored_split
from .registry import query

OHLCV = KEY + "open:d high:d low:d close:d volume:d"


def _folder(spark):
    return f"{staging_dir(spark)}/landing-{uuid.uuid4().hex}"


@query("scan_parquet_bars", OHLCV, f"WITH {bars_sql()} SELECT * FROM bars")
def scan_parquet_bars(spark, sf_dir):
    """Write bars once as an immutable table and read them with the fixed schema."""
    path = _folder(spark)
    sk.write_immutable(bars(spark, sf_dir).select("symbol", "ts", *rd.PRICE), path)
    return rd.read_bars(spark, path)


@query("scan_csv_bars", OHLCV, f"WITH {DAILY_SQL} SELECT * FROM daily")
def scan_csv_bars(spark, sf_dir):
    path = _folder(spark)
    named = {"ts": "Date", **{c: c.capitalize() for c in rd.PRICE}}
    daily_bars(spark, sf_dir).select("symbol", "ts", *rd.PRICE).withColumnsRenamed(named).write.option("header", True).csv(path)
    return rd.read_csv_bars(spark, path)


@query(
    "scan_vendor_bars",
    OHLCV,
    "SELECT o_orderpriority AS symbol, o_orderdate AS ts, max(o_totalprice) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, min(o_totalprice) AS close, count(*) AS volume FROM orders GROUP BY 1, 2",
)
def scan_vendor_bars(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.unix_timestamp("o_orderdate").alias("time")).agg(
        F.max("o_totalprice").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.min("o_totalprice").alias("close"), F.count(F.lit(1)).alias("tick_volume")
    )
    return rd.vendor_bars(raw)


CHUNK_SQL = f"""{bars_sql()}, chunks AS (SELECT symbol, ts, close, 1 AS chunk_id FROM bars WHERE day(ts) <= 16 UNION ALL SELECT symbol, ts, close + 0.5, 2 FROM bars WHERE day(ts) >= 14)"""


def chunks(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "ts", "close")
    first = b.where(F.day("ts") <= 16).withColumn("chunk_id", F.lit(1))
    second = b.where(F.day("ts") >= 14).withColumn("close", F.col("close") + 0.5).withColumn("chunk_id", F.lit(2))
    return first.unionByName(second)


@query(
    "merge_overlapping_chunks",
    KEY + "close:d copies:l",
    f"WITH {CHUNK_SQL} SELECT symbol, ts, arg_max(close, chunk_id) AS close, count(*) AS copies FROM chunks WHERE ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-25' GROUP BY 1, 2",
)
def merge_overlapping_chunks(spark, sf_dir):
    return rd.merge_chunks(chunks(spark, sf_dir), start=F.lit("2024-01-03").cast("timestamp"), end=F.lit("2024-01-25").cast("timestamp"))


@query(
    "merge_chunks_end_exclusive",
    "symbol:s rows:l duplicates:l last_ts:t",
    f"WITH {CHUNK_SQL}, m AS (SELECT symbol, ts, count(*) AS copies FROM chunks WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2) SELECT symbol, count(*) AS rows, sum(copies - 1) AS duplicates, max(ts) AS last_ts FROM m GROUP BY 1",
)
def merge_chunks_end_exclusive(spark, sf_dir):
    merged = rd.merge_chunks(chunks(spark, sf_dir), end=F.lit("2024-01-25").cast("timestamp"), end_exclusive=True)
    return merged.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("copies") - 1).alias("duplicates"), F.max("ts").alias("last_ts"))


@query("merge_latest_per_key", KEY + "close:d", f"WITH {CHUNK_SQL} SELECT symbol, ts, arg_max(close, chunk_id) AS close FROM chunks GROUP BY 1, 2")
def merge_latest_per_key(spark, sf_dir):
    return rd.latest_per_key(chunks(spark, sf_dir), ["symbol", "ts"], ["chunk_id"])


OBS = "instrument_or_event_id:s field:s value:d source_time_utc:t available_time_utc:t"
NY = "timezone('America/New_York', day + INTERVAL {h} HOUR)"


def _utc(h):
    return f"(timezone('UTC', timezone('America/New_York', day + INTERVAL {h} HOUR)))"


@query(
    "scan_yield_curve_xml",
    OBS,
    f"""WITH d AS (SELECT date_trunc('day', o_orderdate) AS day, max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS a, max(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS b FROM orders GROUP BY 1),
    l AS (SELECT day, '2Y' AS i, a AS v FROM d UNION ALL SELECT day, '10Y', b FROM d)
    SELECT i AS instrument_or_event_id, 'yield_percent' AS field, v AS value, day AS source_time_utc, {_utc(18)} AS available_time_utc FROM l WHERE v IS NOT NULL""",
)
def scan_yield_curve_xml(spark, sf_dir):
    path = _folder(spark)
    p = F.col("o_totalprice")
    wide = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("NEW_DATE")).agg(
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", p)).alias("BC_2YEAR"),
        F.max(F.when(F.col("o_orderpriority") == "5-LOW", p)).alias("BC_10YEAR"),
        F.count(F.lit(1)).alias("BC_OTHER"),
    )
    wide.write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path)
    return rd.read_yield_curve(spark, path, {"BC_2YEAR": "2Y", "BC_10YEAR": "10Y"})


@query(
    "scan_index_history_csv",
    OBS,
    f"""WITH d AS (SELECT date_trunc('day', o_orderdate) AS day, max(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT 'VIX' AS instrument_or_event_id, 'close' AS field, v AS value, day AS source_time_utc, {_utc(17)} AS available_time_utc FROM d WHERE {_utc(17)} <= TIMESTAMP '2000-01-01'""",
)
def scan_index_history_csv(spark, sf_dir):
    path = _folder(spark)
    daily = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "MM/dd/yyyy").alias("Date")).agg(F.max("o_totalprice").alias(" close"))
    daily.write.option("header", True).csv(path)
    return rd.read_index_history(spark, path, "VIX", cutoff=F.lit("2000-01-01").cast("timestamp"))


@query(
    "build_observation_rows",
    OBS + " revision_id:s hash_ok:l",
    f"""WITH {bars_sql(60)} SELECT symbol AS instrument_or_event_id, 'close' AS field, close AS value, ts AS source_time_utc, ts + INTERVAL 1 HOUR AS available_time_utc, 'initial' AS revision_id, 1 AS hash_ok FROM bars""",
)
def build_observation_rows(spark, sf_dir):
    b = bars(spark, sf_dir, 60)
    rows = rd.observation_rows(
        b, source="bars", version="v1", instrument=F.col("symbol"), field=F.lit("close"), value=F.col("close"), source_time=F.col("ts"), available=F.col("ts") + F.expr("INTERVAL 1 HOUR")
    )
    return rows.withColumn("hash_ok", F.col("raw_batch_sha256").rlike("^[0-9a-f]{64}$").cast("int"))


BROKEN_SQL = f"""{bars_sql()}, broken AS (SELECT symbol, ts, open, CASE WHEN minute(ts) = 15 AND hour(ts) = 3 THEN low ELSE high END AS high, low, CASE WHEN minute(ts) = 30 AND hour(ts) = 5 THEN -1 ELSE close END AS close FROM bars
  UNION ALL SELECT symbol, ts, open, high, low, close FROM bars WHERE hour(ts) = 7)"""


def broken_bars(spark, sf_dir):
    b = bars(spark, sf_dir).select("symbol", "ts", "open", "high", "low", "close")
    at = lambda h, m: (F.hour("ts") == h) & (F.minute("ts") == m)
    bad = b.withColumns({"high": F.when(at(3, 15), F.col("low")).otherwise(F.col("high")), "close": F.when(at(5, 30), -1.0).otherwise(F.col("close"))})
    return bad.unionByName(b.where(F.hour("ts") == 7))


@query(
    "validate_bars",
    "symbol:s rows:l duplicate_times:l null_values:l non_positive:l high_below_body:l low_above_body:l first_ts:t last_ts:t",
    f"""WITH {BROKEN_SQL} SELECT symbol, count(*) AS rows, count(*) - count(DISTINCT ts) AS duplicate_times, 0 AS null_values, count(*) FILTER (WHERE least(open, high, low, close) <= 0) AS non_positive,
    count(*) FILTER (WHERE high < greatest(open, close)) AS high_below_body, count(*) FILTER (WHERE low > least(open, close)) AS low_above_body, min(ts) AS first_ts, max(ts) AS last_ts FROM broken GROUP BY 1""",
)
def validate_bars(spark, sf_dir):
    return ql.bar_violations(broken_bars(spark, sf_dir))


@query(
    "validate_chunks",
    "chunk_id:l rows:l non_positive:l high_below_body:l low_above_body:l",
    f"""WITH {BROKEN_SQL} SELECT day(ts) % 4 AS chunk_id, count(*) AS rows, count(*) FILTER (WHERE least(open, high, low, close) <= 0) AS non_positive,
    count(*) FILTER (WHERE high < greatest(open, close)) AS high_below_body, count(*) FILTER (WHERE low > least(open, close)) AS low_above_body FROM broken GROUP BY 1""",
)
def validate_chunks(spark, sf_dir):
    return ql.bar_violations(broken_bars(spark, sf_dir).withColumn("chunk_id", F.day("ts") % 4), keys=["chunk_id"])


@query(
    "validate_coverage",
    "symbol:s first_ts:t last_ts:t rows:l starts_in_time:l ends_in_time:l",
    f"""WITH {DAILY_SQL} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows, CAST(min(ts) <= TIMESTAMP '1995-01-08' AS INT) AS starts_in_time, CAST(max(ts) >= TIMESTAMP '2002-01-01' - INTERVAL 7 DAY AS INT) AS ends_in_time FROM daily GROUP BY 1""",
)
def validate_coverage(spark, sf_dir):
    return ql.coverage(daily_bars(spark, sf_dir), start=F.lit("1995-01-01").cast("timestamp"), end=F.lit("2002-01-01").cast("timestamp"))


@query(
    "profile_bars",
    "symbol:s rows:l first_ts:t last_ts:t duplicates:l nulls:l nonzero_volume_rows:l positive_spread_rows:l",
    f"""WITH {bars_sql()} SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, 0 AS duplicates, 0 AS nulls, count(*) FILTER (WHERE volume <> 0) AS nonzero_volume_rows, count(*) FILTER (WHERE spread > 0) AS positive_spread_rows FROM bars GROUP BY 1""",
)
def profile_bars(spark, sf_dir):
    return ql.profile(bars(spark, sf_dir), spread="spread")


@query(
    "validate_dataset",
    "column:s violations:l",
    f"""WITH {NUMBERED}, r AS (SELECT *, close / before - 1 AS returns, (high - low) / close AS high_low_ratio, CAST(hour(ts) AS INT) % 4 AS target FROM numbered)
    SELECT 'returns' AS "column", count(*) - count(returns) AS violations FROM r UNION ALL SELECT 'high_low_ratio', count(*) - count(high_low_ratio) FROM r UNION ALL SELECT 'target', count(*) FILTER (WHERE target > 2) FROM r""",
)
def validate_dataset(spark, sf_dir):
    rows = pf.price_features(bars(spark, sf_dir), families=("returns",)).withColumn("target", F.hour("ts") % 4)
    return ql.dataset_violations(rows, ["returns", "high_low_ratio"])


@query(
    "validate_dataset_contract",
    "rule:s violations:l",
    f"""WITH {bars_sql()}, d AS (SELECT symbol, ts, close / nullif(open - 500, 0) AS ratio, CAST(hour(ts) % 4 AS INT) AS target FROM bars UNION ALL SELECT symbol, ts, close / nullif(open - 500, 0), 0 FROM bars WHERE hour(ts) = 3)
    SELECT 'empty' AS rule, CAST(count(*) = 0 AS INT) AS violations FROM d UNION ALL SELECT 'repeated_times', count(*) - count(DISTINCT (symbol, ts)) FROM d UNION ALL SELECT 'missing_times', 0 UNION ALL SELECT 'not_numeric', 1
    UNION ALL SELECT 'not_finite_rows', count(*) FILTER (WHERE ratio IS NULL) FROM d UNION ALL SELECT 'unknown_labels', count(*) FILTER (WHERE target NOT IN (0, 1, 2)) FROM d""",
)
def validate_dataset_contract(spark, sf_dir):
    """A dataset with planted faults: repeated times, an unknown label, a text feature."""
    b = bars(spark, sf_dir).select("symbol", "ts", (F.col("close") / F.nullif(F.col("open") - 500, F.lit(0.0))).alias("ratio"), (F.hour("ts") % 4).cast("int").alias("target"), F.lit("text").alias("session"))
    rows = b.unionByName(b.where(F.hour("ts") == 3).withColumn("target", F.lit(0)))
    return ql.dataset_contract(rows, ["ratio", "session"])


@query(
    "validate_observations",
    "instrument_or_event_id:s rows:l missing_available:l available_before_source:l bad_hash:l",
    f"WITH {OBSERVATIONS_SQL} SELECT instrument_or_event_id, count(*) AS rows, 0 AS missing_available, 0 AS available_before_source, 0 AS bad_hash FROM observations GROUP BY 1",
)
def validate_observations(spark, sf_dir):
    return ql.observation_violations(observations(spark, sf_dir))


@query(
    "provenance_summary",
    "symbol:s actual_first_timestamp:t actual_last_timestamp:t row_count:l duplicate_count:l chunk_count:l",
    f"WITH {CHUNK_SQL} SELECT symbol, min(ts) AS actual_first_timestamp, max(ts) AS actual_last_timestamp, count(*) AS row_count, count(*) - count(DISTINCT ts) AS duplicate_count, count(DISTINCT chunk_id) AS chunk_count FROM chunks GROUP BY 1",
)
def provenance_summary(spark, sf_dir):
    return ql.provenance(chunks(spark, sf_dir), chunk="chunk_id")


@query(
    "cache_contract",
    "symbol:s accepted:l reason:s",
    f"""WITH {CHUNK_SQL}, s AS (SELECT symbol, count(*) - count(DISTINCT ts) AS d, count(*) AS n FROM chunks GROUP BY 1)
    SELECT symbol, CAST(symbol NOT IN ('error', 'view') AS INT) AS accepted, CASE symbol WHEN 'error' THEN 'fallback_data' WHEN 'view' THEN 'timeframe_mismatch' END AS reason FROM s""",
)
def cache_contract(spark, sf_dir):
    """Sidecars written as JSON next to the data, read back and judged against requests."""
    path = _folder(spark)
    p = ql.provenance(chunks(spark, sf_dir), chunk="chunk_id")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    p.select(
        F.lit("1").alias("schema_version"), F.lit("events").alias("source"), "symbol", F.when(F.col("symbol") == "view", "1h").otherwise("15m").alias("timeframe"),
        F.lit("2024-01-01").alias("requested_start"), F.lit("2024-01-31").alias("requested_end"),
        *[text(c).alias(n) for c, n in (("actual_first_timestamp", "actual_start"), ("actual_last_timestamp", "actual_end"), ("actual_first_timestamp", "actual_first_timestamp"), ("actual_last_timestamp", "actual_last_timestamp"))],
        F.lit("2024-02-01").alias("retrieved_at_utc"), "row_count", "chunk_count", "duplicate_count", F.lit(False).alias("from_cache"), (F.col("symbol") == "error").alias("fallback_used"),
    ).write.json(path)
    requests = p.select("symbol", F.lit("15m").alias("timeframe"), F.lit("2024-01-01").alias("requested_start"), F.lit("2024-01-31").alias("requested_end"))
    return ql.judge_sidecars(rd.read_sidecars(spark, path), requests)


TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


def _copied(spark, source, target):
    """Copy one file with the file systems of both paths."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


@query(
    "manifest_files",
    "file:s state:s",
    "SELECT * FROM (VALUES " + ", ".join(f"('{t}.parquet', 'same')" for t in TABLES) + ", ('copy/region.parquet', 'same'), ('copy/nation.parquet', 'changed'), ('copy/supplier.parquet', 'removed'), ('copy/part.parquet', 'added')) AS t(file, state)",
)
def manifest_files(spark, sf_dir):
    """The stored manifest of all input files against a second reading, and that of a folder before and after changes."""
    before, after = _folder(spark), _folder(spark)
    for folder, names in ((before, {"region": "region", "nation": "nation", "supplier": "supplier"}), (after, {"region": "region", "nation": "region", "part": "part"})):
        for name, source in names.items():
            _copied(spark, f"{sf_dir}/{source}.parquet", f"{folder}/{name}.parquet")
    manifest = lambda path: rd.file_manifest(spark, path, pattern="*.parquet")
    whole = rd.manifest_changes(stage(manifest(sf_dir)), manifest(sf_dir)).select("file", "state")
    moved = rd.manifest_changes(stage(manifest(before)), manifest(after)).select(F.concat(F.lit("copy/"), "file").alias("file"), "state")
    # A table that lies in several files is one entry.
    table = F.regexp_extract("file", r"^((?:copy/)?[^/]+)", 1)
    worst = F.max_by("state", F.when(F.col("state") == "same", 0).otherwise(1))
    return whole.unionByName(moved).groupBy(table.alias("file")).agg(worst.alias("state"))


@query(
    "manifest_verification",
    "symbol:s row_count:l recorded:l verified:l",
    f"WITH {DAILY_SQL} SELECT symbol, count(*) AS row_count, count(*) AS recorded, 1 AS verified FROM daily GROUP BY 1",
)
def manifest_verification(spark, sf_dir):
    """Recorded row counts joined with what the stored table really holds."""
    path = _folder(spark)
    daily = daily_bars(spark, sf_dir)
    sk.write_dataset(daily, ql.provenance(daily), path)
    recorded = spark.read.schema("symbol STRING, row_count LONG").json(f"{path}/metadata").withColumnRenamed("row_count", "recorded")
    found = ql.provenance(rd.read_bars(spark, f"{path}/data", columns=["symbol", "ts"]))
    return found.join(recorded, "symbol").withColumn("verified", (F.col("row_count") == F.col("recorded")).cast("int"))


@query(
    "sink_metric_table",
    "split:s row_count:l",
    f"WITH {SCORED_SPLIT_SQL} SELECT split, count(*) AS row_count FROM split_rows GROUP BY 1",
)
def sink_metric_table(spark, sf_dir):
    path = _folder(spark)
    sk.write_metrics(split_metadata(scored_split(spark, sf_dir)).select("split", "row_count"), path)
    return spark.read.option("header", True).schema("split STRING, row_count LONG").csv(path)


@query(
    "scan_sealed_train_validation",
    "rows:l first_ts:t last_ts:t quantity_total:d",
    "SELECT count(*) AS rows, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts, sum(l_quantity) AS quantity_total FROM lineitem WHERE l_shipdate <= TIMESTAMP '1999-06-30'",
)
def scan_sealed_train_validation(spark, sf_dir):
    """Only two columns and only the allowed range leave the file scan."""
    until = F.lit("1999-06-30").cast("timestamp_ntz")
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = ql.assert_boundary(rd.sealed_scan(raw, columns=["l_shipdate", "l_quantity"], until=until, ts="l_shipdate"), ts="l_shipdate", until=until)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.min("l_shipdate").alias("first_ts"), F.max("l_shipdate").alias("last_ts"), F.sum("l_quantity").alias("quantity_total"))


@query(
    "scan_sealed_test",
    "rows:l first_ts:t",
    "SELECT count(*) AS rows, min(l_shipdate) AS first_ts FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-07-01'",
)
def scan_sealed_test(spark, sf_dir):
    since = F.lit("1999-07-01").cast("timestamp_ntz")
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = rd.sealed_scan(raw, columns=["l_shipdate"], since=since, ts="l_shipdate")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.min("l_shipdate").alias("first_ts"))


PROBES = [("w1", "1995-01-01", "1995-01-10"), ("w2", "1998-03-01", "1998-03-03"), ("w3", "2001-07-01", "2001-07-31")]


@query(
    "probe_history",
    "symbol:s w_w1:l w_w2:l w_w3:l accepted:l reason:s",
    f"WITH {DAILY_SQL}, c AS (SELECT symbol, max(ts) AS l, "
    + ", ".join(f"count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '{lo}' AND TIMESTAMP '{hi}') AS w_{w}" for w, lo, hi in PROBES)
    + """ FROM daily GROUP BY 1), r AS (SELECT *, CASE WHEN w_w1 = 0 THEN 'no_rows_in_w1' WHEN w_w2 = 0 THEN 'no_rows_in_w2' WHEN w_w3 = 0 THEN 'no_rows_in_w3' WHEN l < TIMESTAMP '2001-07-31' THEN 'ends_early' END AS reason FROM c)
    SELECT *, CAST(reason IS NULL AS INT) AS accepted FROM r""",
)
def probe_history(spark, sf_dir):
    windows = spark.createDataFrame(PROBES, "window_id string, lo string, hi string").withColumns({c: F.col(c).cast("timestamp") for c in ("lo", "hi")})
    daily = stage(daily_bars(spark, sf_dir).select("symbol", "ts"))
    counts = ql.window_counts(daily, windows).groupBy("symbol").pivot("window_id", [w for w, _, _ in PROBES]).agg(F.max("rows"))
    judged = ql.history_probe(daily, windows, endpoint=F.lit("2001-07-31").cast("timestamp"))
    return judged.join(counts.withColumnsRenamed({w: f"w_{w}" for w, _, _ in PROBES}), "symbol")


@query(
    "probe_many_windows",
    "symbol:s window_id:l rows:l",
    f"""WITH {DAILY_SQL}, w AS (SELECT i AS window_id, TIMESTAMP '1992-01-01' + to_hours(CAST(i * 7 AS INTEGER)) AS lo, TIMESTAMP '1992-01-01' + to_hours(CAST(i * 7 + i % 900 AS INTEGER)) AS hi FROM range(10000) AS r(i))
    SELECT d.symbol, window_id, count(*) FILTER (WHERE d.ts BETWEEN lo AND hi) AS rows FROM daily d, w GROUP BY 1, 2""",
)
def probe_many_windows(spark, sf_dir):
    """Ten thousand overlapping windows of up to 900 hours."""
    hours = lambda c: F.timestamp_seconds(F.unix_timestamp(F.lit("1992-01-01").cast("timestamp")) + c * 3600)
    windows = spark.range(10_000).select(F.col("id").alias("window_id"), hours(F.col("id") * 7).alias("lo"), hours(F.col("id") * 7 + F.col("id") % 900).alias("hi"))
    return ql.window_counts(stage(daily_bars(spark, sf_dir).select("symbol", "ts")), windows)


LINEAGE_SQL = """lineage AS (
  SELECT 'features' AS report_id, l_orderkey, l_linenumber FROM split_rows WHERE split <> 'test' UNION ALL
  SELECT 'tuning', l_orderkey, l_linenumber FROM split_rows WHERE split = 'validation' OR (split = 'test' AND l_orderkey % 97 = 0) UNION ALL
  SELECT 'tuning', l_orderkey, l_linenumber FROM split_rows WHERE split = 'validation')"""


def lineage(rows):
    """What two earlier reports read; the second has looked at some rows of the holdout, and at others twice."""
    read = lambda name, where: rows.where(where).select(F.lit(name).alias("report_id"), "l_orderkey", "l_linenumber")
    return read("features", "split <> 'test'").unionByName(read("tuning", "split = 'validation' OR (split = 'test' AND l_orderkey % 97 = 0)")).unionByName(read("tuning", "split = 'validation'"))


@query(
    "audit_exposed_rows",
    "report_id:s read_rows:l exposed_rows:l",
    f"WITH {SCORED_SPLIT_SQL}, {LINEAGE_SQL} SELECT report_id, count(DISTINCT (l_orderkey, l_linenumber)) AS read_rows, count(DISTINCT (l_orderkey, l_linenumber)) FILTER (WHERE split = 'test') AS exposed_rows FROM lineage JOIN split_rows USING (l_orderkey, l_linenumber) GROUP BY 1",
)
def audit_exposed_rows(spark, sf_dir):
    rows = stage(scored_split(spark, sf_dir).select("l_orderkey", "l_linenumber", "split"))
    return ql.exposed_rows(rows.where("split = 'test'"), lineage(rows), keys=["l_orderkey", "l_linenumber"])


@query(
    "audit_holdout_rules",
    "rule:s passed:l",
    f"""WITH {SCORED_SPLIT_SQL}, {LINEAGE_SQL}, b AS (SELECT max(ts) FILTER (WHERE split = 'train') AS tl, min(ts) FILTER (WHERE split = 'validation') AS vf, max(ts) FILTER (WHERE split = 'validation') AS vl, min(ts) FILTER (WHERE split = 'test') AS sf FROM split_rows),
    e AS (SELECT count(*) AS n FROM lineage JOIN split_rows USING (l_orderkey, l_linenumber) WHERE split = 'test')
    SELECT 'holdout_after_validation' AS rule, CAST(sf > vl AS INT) AS passed FROM b UNION ALL SELECT 'train_before_validation', CAST(tl < vf AS INT) FROM b UNION ALL SELECT 'holdout_not_exposed', CAST(n = 0 AS INT) FROM e UNION ALL SELECT 'no_forbidden_columns', 1 FROM b""",
)
def audit_holdout_rules(spark, sf_dir):
    """The planted exposure breaks its rule; the others hold."""
    rows = stage(scored_split(spark, sf_dir))
    keys = ["l_orderkey", "l_linenumber"]
    exposure = ql.exposed_rows(rows.where("split = 'test'"), lineage(rows), keys=keys)
    return ql.holdout_rules(split_metadata(rows), columns=["quantity", "discount"], exposure=exposure)


@query(
    "align_missing_keys",
    KEY + "close:d",
    f"WITH {bars_sql()} SELECT b.symbol, b.ts, b.close FROM bars b WHERE NOT EXISTS (SELECT 1 FROM bars p WHERE p.symbol = b.symbol AND p.ts = b.ts - INTERVAL 15 MINUTE)",
)
def align_missing_keys(spark, sf_dir):
    """Bars whose predecessor is missing: the rows an exact alignment cannot cover."""
    b = bars(spark, sf_dir)
    shifted = b.select("symbol", (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("ts"))
    return ql.missing_keys(b.select("symbol", "ts", "close"), shifted, ["symbol", "ts"])


@query(
    "join_exact_alignment",
    KEY + "close:d score:d",
    f"WITH {bars_sql()} SELECT b.symbol, b.ts, b.close, p.close AS score FROM bars b LEFT JOIN bars p ON p.symbol = b.symbol AND p.ts = b.ts - INTERVAL 15 MINUTE",
)
def join_exact_alignment(spark, sf_dir):
    b = bars(spark, sf_dir)
    shifted = b.select("symbol", (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("ts"), F.col("close").alias("score"))
    return b.select("symbol", "ts", "close").join(shifted, ["symbol", "ts"], "left")


@query(
    "repeated_rows_across_splits",
    "repeated:l same_target:l different_target:l",
    f"""WITH {SCORED_SPLIT_SQL}, k AS (SELECT DISTINCT quantity, discount, tax, target FROM split_rows WHERE split = 'train'), u AS (SELECT DISTINCT quantity, discount, tax FROM k)
    SELECT count(*) AS repeated, count(k.target) AS same_target, count(*) - count(k.target) AS different_target FROM split_rows s JOIN u USING (quantity, discount, tax)
    LEFT JOIN k ON k.quantity = s.quantity AND k.discount = s.discount AND k.tax = s.tax AND k.target = s.target WHERE s.split = 'test'""",
)
def repeated_rows_across_splits(spark, sf_dir):
    rows = stage(scored_split(spark, sf_dir))
    return ql.repeated_rows(rows.where("split = 'train'"), rows.where("split = 'test'"), ["quantity", "discount", "tax"])


@query(
    "reconstruct_prices",
    KEY + "open_error:d high_error:d low_error:d close_error:d",
    f"WITH {NUMBERED} SELECT symbol, ts, 0 AS open_error, 0 AS high_error, 0 AS low_error, 0 AS close_error FROM numbered WHERE i >= 14",
)
def reconstruct_prices(spark, sf_dir):
    """Prices rebuilt from features must equal the bars they came from.

    Shares of a zero price say nothing about the other prices of the bar: an error that is not known is NULL.
    """
    rows = pf.price_features(bars(spark, sf_dir), families=("returns", "atr", "candle"), divide=quotient).where(F.col("atr").isNotNull())
    real = {c: F.col(f"real_{c}") for c in ("open", "high", "low", "close")}
    rows = rows.withColumnsRenamed({c: f"real_{c}" for c in real})
    rebuilt = rows.withColumns(reconstruct_ohlc())
    return rebuilt.withColumns({f"{c}_error": F.round(number(F.abs(F.col(c) - v)), 6) for c, v in real.items()})


@query(
    "intervals_bar_close",
    KEY + "interval:s closes_at:t",
    f"WITH {bars_sql(60)} SELECT symbol, ts, '1h' AS interval, ts + INTERVAL 1 HOUR AS closes_at FROM bars",
)
def intervals_bar_close(spark, sf_dir):
    """Bar close from the interval dimension (seven rows)."""
    dim = spark.createDataFrame(list(INTERVAL_SECONDS.items()), "interval string, seconds long")
    b = bars(spark, sf_dir, 60).withColumn("interval", F.lit("1h"))
    return b.join(dim, "interval").withColumn("closes_at", F.col("ts") + F.make_dt_interval(secs=F.col("seconds")))


PROBE_FEATURES = [f for f in pf.FEATURES if f not in pf.SESSION_FEATURES]


@query(
    "causality_perturbation",
    "feature:s compared:l changed:l",
    "WITH " + NUMBERED + ", n AS (SELECT count(*) AS compared FROM numbered WHERE ts <= TIMESTAMP '2024-01-20') "
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, compared, 0 AS changed FROM n" for f in PROBE_FEATURES),
)
def causality_perturbation(spark, sf_dir):
    """Changing prices after a probe time must not change any feature up to it."""
    b = bars(spark, sf_dir)
    probe = F.lit("2024-01-20").cast("timestamp")
    moved = b.withColumns({c: F.when(F.col("ts") > probe, F.col(c) + 25.0).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    before, after = (pf.price_features(x).where(F.col("ts") <= probe) for x in (b, moved))
    return ql.perturbation_differences(before, after, PROBE_FEATURES, keys=["symbol", "ts"])
