"""Data contracts: validation reports, coverage, provenance, leakage rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FORBIDDEN_NAME_PARTS, SIDECAR_REQUIRED
from .asof import asof_join
from .series import time_cell, with_row_index
from .splits import SPLITS
from .staging import stage

PRICES = ("open", "high", "low", "close")
#: Probe windows that are sent to every task at most.
BROADCAST_WINDOWS = 100_000


class ContractError(ValueError):
    """Raised when a table breaks its contract."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")


def forbidden_names(names: Sequence[str]) -> list[str]:
    """Names that hint at labels or future values (schema only, no data is read)."""
    return [n for n in names if any(part in n.lower() for part in FORBIDDEN_NAME_PARTS)]


def check_feature_names(names: Sequence[str]) -> None:
    bad = forbidden_names(names)
    if bad:
        raise ContractError(f"forbidden feature names: {bad}")


def bar_violations(bars: DataFrame, *, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Counts of broken bar rules per key.

    Duplicates are counted through (key, time) groups, which also combine
    map-side, instead of a distinct count per key.
    """
    require_columns(bars, [*keys, ts, *PRICES])
    o, h, l, c = (F.col(x) for x in PRICES)
    rules = {
        "null_values": sum((F.col(x).isNull() | F.isnan(x)).cast("int") for x in PRICES) > 0,
        "non_positive": F.least(o, h, l, c) <= 0,
        "high_below_body": h < F.greatest(o, c),
        "low_above_body": l > F.least(o, c),
    }
    per_time = bars.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(v).alias(k) for k, v in rules.items()])
    return per_time.groupBy(*keys).agg(
        F.sum("_n").alias("rows"),
        F.sum(F.col("_n") - 1).alias("duplicate_times"),
        *[F.sum(k).alias(k) for k in rules],
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


RULES = ("duplicate_times", "null_values", "non_positive", "high_below_body", "low_above_body")


def require_valid(report: DataFrame) -> None:
    """Raise when any rule is broken, with the number of broken series and where they are all listed."""
    bad = report.where(sum(F.col(r) for r in RULES) > 0)
    if not bad.isEmpty():
        kept = stage(bad)
        totals = kept.agg(F.count(F.lit(1)).alias("series"), *[F.sum(r).alias(r) for r in RULES]).first()
        raise ContractError(f"bar contract broken: {totals.asDict()}, first {kept.first().asDict()}, all in {kept.inputFiles()[0].rsplit('/', 1)[0]}")


def coverage(bars: DataFrame, *, start: Column, end: Column, slack_days: int = 7, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Does every series reach both ends of the requested range, within a slack?"""
    slack = F.make_dt_interval(days=F.lit(slack_days))
    return bars.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("rows")).withColumns(
        {"starts_in_time": F.col("first_ts") <= start + slack, "ends_in_time": F.col("last_ts") >= end - slack}
    )


def profile(bars: DataFrame, *, keys: Sequence[str] = ("symbol",), ts: str = "ts", volume: str = "volume", spread: str | None = None) -> DataFrame:
    """Row counts, time range, duplicates, missing values and activity of each series."""
    values = [c for c in bars.columns if c not in (*keys, ts)]
    per_time = bars.groupBy(*keys, ts).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(sum(F.col(c).isNull().cast("int") for c in values)).alias("_nulls"),
        F.count_if(F.col(volume) != 0).alias("_vol"),
        *([F.count_if(F.col(spread) > 0).alias("_spr")] if spread else []),
    )
    return per_time.groupBy(*keys).agg(
        F.sum("_n").alias("rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.sum(F.col("_n") - 1).alias("duplicates"),
        F.sum("_nulls").alias("nulls"),
        F.sum("_vol").alias("nonzero_volume_rows"),
        *([F.sum("_spr").alias("positive_spread_rows")] if spread else []),
    )


def dataset_violations(df: DataFrame, features: Sequence[str], *, target: str = "target", classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """(column, violations): non-finite features, labels outside the classes."""
    check_feature_names(features)
    counts = [F.count_if(F.col(f).isNull() | F.isnan(f) | (F.abs(f) == float("inf"))).alias(f) for f in features]
    wide = df.agg(*counts, F.count_if(~F.coalesce(F.col(target).isin(*classes), F.lit(False))).alias(target))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in (*features, target)])
    return wide.select(F.explode(pairs).alias("_p")).select("_p.*")


def dataset_contract(df: DataFrame, features: Sequence[str], *, keys: Sequence[str] = ("symbol",), ts: str = "ts", target: str = "target", classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """(rule, violations) of a processed dataset: it has rows, times that come once per series, numeric and finite features, known labels.

    Forbidden feature names raise, as they are read off the schema.  Rows repeated at a time are counted beyond the first one.
    """
    check_feature_names(features)
    kinds = dict(df.dtypes)
    numeric = [f for f in features if kinds[f].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    finite = [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) < float("inf")) for f in numeric]
    bad = F.lit(False)
    for ok in finite:
        bad = bad | ~ok
    per = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"), F.count_if(~F.coalesce(F.col(target).isin(*classes), F.lit(False))).alias("_labels"))
    sums = per.agg(
        (F.coalesce(F.sum("_n"), F.lit(0)) == 0).cast("long").alias("empty"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated_times"),
        F.count_if(F.col(ts).isNull()).alias("missing_times"),
        F.lit(len(features) - len(numeric)).cast("long").alias("not_numeric"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("not_finite_rows"),
        F.coalesce(F.sum("_labels"), F.lit(0)).alias("unknown_labels"),
    )
    rules = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in sums.columns])
    return sums.select(F.explode(rules).alias("_r")).select("_r.*")


def observation_violations(obs: DataFrame) -> DataFrame:
    """Broken rules of the long observation contract, one row per instrument."""
    return obs.groupBy("instrument_or_event_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("available_time_utc").isNull()).alias("missing_available"),
        F.count_if(F.col("available_time_utc") < F.col("source_time_utc")).alias("available_before_source"),
        F.count_if(~F.coalesce(F.col("raw_batch_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))).alias("bad_hash"),
    )


def provenance(bars: DataFrame, *, keys: Sequence[str] = ("symbol",), ts: str = "ts", chunk: str | None = None) -> DataFrame:
    """What a stored series really holds."""
    per_time = bars.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    out = per_time.groupBy(*keys).agg(
        F.min(ts).alias("actual_first_timestamp"),
        F.max(ts).alias("actual_last_timestamp"),
        F.sum("_n").alias("row_count"),
        F.sum(F.col("_n") - 1).alias("duplicate_count"),
    )
    if chunk is None:
        return out
    chunks = bars.select(*keys, chunk).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("chunk_count"))
    return out.join(chunks, list(keys))


def judge_sidecars(sidecars: DataFrame, requests: DataFrame) -> DataFrame:
    """Accept or reject cached data by its sidecar, with the first reason.

    ``requests`` is (symbol, timeframe, requested_start, requested_end).
    """
    r = requests.select("symbol", *[F.col(c).alias(f"_{c}") for c in ("timeframe", "requested_start", "requested_end")])
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in SIDECAR_REQUIRED if c != "symbol"]), lambda x: x.isNotNull())
    reason = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), missing[0]))
        .when(F.col("fallback_used"), "fallback_data")
        .when(F.col("timeframe") != F.col("_timeframe"), "timeframe_mismatch")
        .when((F.col("requested_start") != F.col("_requested_start")) | (F.col("requested_end") != F.col("_requested_end")), "range_mismatch")
        .when(F.col("row_count") <= 0, "empty")
    )
    return sidecars.join(r, "symbol").select("symbol", reason.isNull().alias("accepted"), reason.alias("reason"))


def window_counts(series: DataFrame, windows: DataFrame, *, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """(keys, window_id, lo, hi, rows): rows of every series in every closed window, however many windows there are.

    A window's rows are the series' row number at its end less that before its start.  Row numbers come from the index
    of the series and are looked up as of both moments in one as-of pass, so rows are never paired with windows.  The
    result has a row per series and window, empty ones too.
    """
    cells = [time_cell(ts)]
    numbered = with_row_index(series.select(*keys, ts), keys, [ts], cells, index="_number").withColumnRenamed(ts, "_seen_ts")
    asked = series.select(*keys).distinct().join(F.broadcast(windows) if windows.count() <= BROADCAST_WINDOWS else windows, how="cross")
    edges = F.array(F.struct(F.lit(0).alias("end"), (F.col("lo") - F.expr("INTERVAL 1 MICROSECOND")).alias("t")), F.struct(F.lit(1).alias("end"), F.col("hi").alias("t")))
    left = asked.select(*keys, "window_id", "lo", "hi", F.explode(edges).alias("_e")).select(*keys, "window_id", "lo", "hi", F.col("_e.end").alias("_end"), F.col("_e.t").alias("_at"))
    met = asof_join(left, numbered, by=list(keys), left_time="_at", right_time="_seen_ts", max_age_seconds=None, order=["_number"])
    upto = F.coalesce(F.col("_number") + 1, F.lit(0))
    return met.groupBy(*keys, "window_id", "lo", "hi").agg(F.sum(F.when(F.col("_end") == 1, upto).otherwise(-upto)).alias("rows"))


def history_probe(series: DataFrame, windows: DataFrame, *, endpoint: Column, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Has a series rows in every probe window (window_id, lo, hi) and does it reach the endpoint?

    The reason names the first empty window by start, then id.
    """
    counts = window_counts(series, windows, keys=keys, ts=ts)
    first = F.min_by("window_id", F.struct("lo", "window_id"))
    empty = counts.where("rows = 0").groupBy(*keys).agg(first.alias("_empty"))
    last = series.groupBy(*keys).agg(F.max(ts).alias("last_ts"))
    reason = F.when(F.col("_empty").isNotNull(), F.concat(F.lit("no_rows_in_"), F.col("_empty").cast("string"))).when(F.col("last_ts") < endpoint, "ends_early")
    return last.join(empty, list(keys), "left").select(*keys, reason.isNull().alias("accepted"), reason.alias("reason"))


def exposed_rows(holdout: DataFrame, lineage: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """(report_id, read_rows, exposed_rows): how many rows of a sealed holdout earlier reports have read.

    ``lineage`` has a row per report and row key that it read.  Keys are counted once per report, however often they
    were read; keys that are in no holdout are what a report may read.
    """
    read = lineage.select("report_id", *keys).distinct()
    sealed = holdout.select(*keys).distinct().withColumn("_sealed", F.lit(1))
    return read.join(sealed, list(keys), "left").groupBy("report_id").agg(F.count(F.lit(1)).alias("read_rows"), F.count("_sealed").alias("exposed_rows"))


def holdout_rules(metadata: DataFrame, *, columns: Sequence[str], exposure: DataFrame | None = None) -> DataFrame:
    """One row per eligibility rule of a sealed holdout; ``exposure`` is what ``exposed_rows`` found."""
    wide = metadata.agg(
        *[F.max(F.when(F.col("split") == s, F.col("last_ts"))).alias(f"{s}_last") for s in SPLITS],
        *[F.min(F.when(F.col("split") == s, F.col("first_ts"))).alias(f"{s}_first") for s in SPLITS],
    )
    seen = exposure.agg(F.coalesce(F.sum("exposed_rows"), F.lit(0)).alias("_seen")).first()["_seen"] if exposure is not None else 0
    rules = {
        "holdout_after_validation": F.col("test_first") > F.col("validation_last"),
        "train_before_validation": F.col("train_last") < F.col("validation_first"),
        "holdout_not_exposed": F.lit(seen == 0),
        "no_forbidden_columns": F.lit(not forbidden_names(columns)),
    }
    parts = F.array(*[F.struct(F.lit(n).alias("rule"), v.alias("passed")) for n, v in rules.items()])
    return wide.select(F.explode(parts).alias("_r")).select("_r.*")


def assert_boundary(df: DataFrame, *, ts: str = "ts", until: Column | None = None, since: Column | None = None) -> DataFrame:
    """``df``, or an error if any of its rows lies outside the allowed range or has no time."""
    outside = F.col(ts).isNull()
    if until is not None:
        outside = outside | (F.col(ts) > until)
    if since is not None:
        outside = outside | (F.col(ts) < since)
    found = df.where(outside).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).first()
    if found["n"]:
        raise ValueError(f"{found['n']} rows outside the sealed range, from {found['first']} to {found['last']}")
    return df


def missing_keys(required: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``required`` without a partner: empty when the alignment is complete."""
    return required.join(available, list(keys), "left_anti")


def repeated_rows(reference: DataFrame, probe: DataFrame, columns: Sequence[str], *, target: str = "target", digits: int = 10) -> DataFrame:
    """Probe rows whose rounded features also occur in the reference split.

    The reference is reduced to one row per feature hash before the join, so a
    very common row cannot multiply the result.
    """
    rounded = [F.round(c, digits) for c in columns]
    key = [F.xxhash64(*rounded).alias("_h"), F.md5(F.concat_ws("|", *[r.cast("string") for r in rounded])).alias("_m")]
    known = reference.select(*key, F.col(target).alias("_t")).groupBy("_h", "_m").agg(F.collect_set("_t").alias("_targets"))
    hit = probe.select(*key, target).join(known, ["_h", "_m"])
    same = F.array_contains("_targets", F.col(target))
    return hit.agg(F.count(F.lit(1)).alias("repeated"), F.count_if(same).alias("same_target"), F.count_if(~same).alias("different_target"))


def perturbation_differences(original: DataFrame, perturbed: DataFrame, features: Sequence[str], *, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(feature, compared, changed) between two feature tables at the same keys."""
    b = perturbed.select(*keys, *[F.col(f).alias(f"_{f}") for f in features])
    joined = original.select(*keys, *features).join(b, list(keys))
    wide = joined.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(~F.coalesce(F.abs(F.col(f) - F.col(f"_{f}")) <= tolerance, F.col(f).isNull() & F.col(f"_{f}").isNull())).alias(f) for f in features],
    )
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("changed")) for f in features])
    return wide.select(F.col("_n").alias("compared"), F.explode(parts).alias("_p")).select("compared", "_p.*")
