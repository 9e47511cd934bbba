"""Quality rules with risk-controlled cutoffs.

Base counts and five scores are computed per document.  A score rejects a document above a cutoff.  Each cutoff is
chosen per stratum (language) from labelled documents: a fixed grid is walked from lax to strict for as long as the
exact binomial test refutes a false rejection rate of ``ALPHA`` or more.  ``ALPHA`` is an equal part of ``RISK``, the
rate at which all scores together may reject good documents of a stratum.  The tests of one score and stratum form a
fixed sequence, and the level ``DELTA`` is divided by the number of scores times strata, so with probability
1 - DELTA no score rejects more than ``ALPHA`` of the good documents of any stratum, and all scores together no more than
``RISK``, whichever of the cutoffs that passed is taken.  The one taken rejects the most bad documents, a good one counting ``GOOD_COSTS`` times against it;
of equals the laxest.  A stratum with fewer than ln(DELTA / tests) / ln(1 - ALPHA) good labels that pass the base
rule gets no cutoff (297 for 20 tests): there even no false rejection at all proves nothing.  Only DataFrame functions
are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlework.llm.common import stage

#: Highest rate of good documents that the rules may reject in a stratum, and the chance that any stratum breaks it.
RISK, DELTA = 0.10, 0.05
GOOD_COSTS = 10
MIN_WORDS = 50

#: Scores are integers that grow as a text gets worse; cutoffs are steps * step with 1 <= steps <= levels.
SCORES = {
    "symbols": ("1000 * _q_symbols div greatest(_q_words, 1)", 25, 80),
    "dup_lines": ("1000 * _q_dup_lines div greatest(_q_lines, 1)", 20, 50),
    "repeats": ("1000 * _q_repeats div greatest(_q_words, 1)", 10, 50),
    "long_words": ("1000 * _q_chars div greatest(_q_words, 1)", 250, 80),
    "short_words": ("20000 - 1000 * _q_chars div greatest(_q_words, 1)", 250, 80),
}
#: Each score's part of the risk.  It sets how many labels a stratum needs: at 2 % 297 good ones for 20 tests, at 1 % 597.
ALPHA = RISK / len(SCORES)


def features(docs: DataFrame) -> DataFrame:
    """Adds the base counts (columns ``_q_*``) to the rows of ``docs``; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_q_list", F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    out = out.withColumn("_q_rows", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumns(
        {
            "_q_words": F.size("_q_list").cast("long"),
            "_q_chars": F.length(F.array_join("_q_list", "")).cast("long"),
            "_q_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "_q_lines": F.size("_q_rows").cast("long"),
            "_q_dup_lines": (F.size("_q_rows") - F.size(F.array_distinct("_q_rows"))).cast("long"),
            "_q_hash": F.expr("CASE WHEN size(_q_list) > 3 THEN transform(sequence(1, size(_q_list) - 2), i -> xxhash64(_q_list[i - 1], _q_list[i], _q_list[i + 1])) ELSE array() END"),
        }
    )
    # Only texts in which a hash comes twice are looked at word by word.
    out = out.withColumn(
        "_q_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(_q_hash)) < size(_q_hash) THEN "
            "array_sort(transform(sequence(1, size(_q_list) - 2), i -> struct(array_join(slice(_q_list, i, 3), ' ') AS w, i AS i))) END"
        ),
    )
    out = out.withColumn(
        "_q_spots",
        F.expr("array_sort(transform(filter(_q_sorted, (x, j) -> (j > 0 AND _q_sorted[j - 1].w = x.w) OR get(_q_sorted, j + 1).w = x.w), x -> x.i))"),
    )
    covered = F.expr("aggregate(_q_spots, struct(0L AS n, -9 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last), a -> a.n)")
    out = out.withColumn("_q_repeats", F.coalesce(covered, F.lit(0)).cast("long"))
    out = out.withColumn("_q_failed", (F.col("_q_words") < MIN_WORDS) | (100 * F.col("_q_repeats") > 50 * F.col("_q_words")))
    return out.drop("_q_list", "_q_rows", "_q_hash", "_q_sorted", "_q_spots")


def cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with ``_q_cut_<score>``, the chosen cutoff or null.

    Calibrates on the labelled documents that do not fail the base rule; a document with several labels counts once,
    as good if any of them says so.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_q_doc")).agg(F.max("quality").cast("long").alias("_q_good"))
    held = scored.where(~F.col("_q_failed")).join(known, F.col("doc_id") == F.col("_q_doc"))
    levels = [f"least({n} + 1, (greatest(0, {score}) + {step} - 1) div {step})" for score, step, n in SCORES.values()]
    named = ", ".join(f"'{name}', {level}" for name, level in zip(SCORES, levels))
    # ``above`` counts the cutoffs below the score: the document is rejected at cutoff s * step exactly if above > s.
    long = held.select("_q_stratum", "_q_good", F.expr(f"stack({len(SCORES)}, {named}) AS (score, above)"))
    counts = long.groupBy("_q_stratum", "score", "above").agg(F.sum("_q_good").alias("good"), F.sum(1 - F.col("_q_good")).alias("bad"))
    per = counts.groupBy("_q_stratum", "score").agg(F.sum("good").alias("n"), F.collect_list(F.struct("above", "good", "bad")).alias("at"))
    size = F.expr("CASE score " + " ".join(f"WHEN '{k}' THEN {n}" for k, (_, _, n) in SCORES.items()) + " END")
    beyond = "aggregate(filter(at, e -> e.above > s), 0L, (a, e) -> a + e.{})"
    grid = per.withColumn("s", F.explode(F.sequence(F.lit(1), size))).withColumns({"k": F.expr(beyond.format("good")), "bad": F.expr(beyond.format("bad"))})
    whole = W.partitionBy(F.lit(1))  # scores times strata times levels: a table that does not grow with the documents
    tests = grid.withColumn("m", F.size(F.collect_set(F.struct("_q_stratum", "score")).over(whole)))
    log_top = f"aggregate(CASE WHEN k > 0 THEN sequence(1L, k) ELSE array() END, 0D, (a, j) -> a + ln((n - k + j) / j)) + k * ln({alpha}D) + (n - k) * ln(1 - {alpha}D)"
    tail = f"aggregate(CASE WHEN k > 0 THEN reverse(sequence(1L, k)) ELSE array() END, struct(1D AS t, 1D AS sum), (a, i) -> struct(a.t * i / (n - i + 1) * (1 - {alpha}D) / {alpha}D AS t, a.sum + a.t * i / (n - i + 1) * (1 - {alpha}D) / {alpha}D AS sum), a -> a.sum)"
    passed = tests.where(F.expr(f"k <= n * {alpha}D")).where(F.expr(f"exp({log_top}) * {tail} <= {delta}D / m"))
    # k falls as s grows, so the passing cutoffs are the lax end of the sequence.
    chosen = passed.groupBy("_q_stratum", "score").agg(F.max_by("s", F.struct(F.col("bad") - GOOD_COSTS * F.col("k"), "s")).alias("s"))
    return chosen.groupBy("_q_stratum").agg(
        *[F.max(F.when(F.col("score") == name, F.col("s") * step)).cast("long").alias(f"_q_cut_{name}") for name, (_, step, _) in SCORES.items()]
    )


def judged(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` with the base counts, the cutoffs of their stratum and ``_q_kept``.

    One row comes out per row that goes in.  Null texts have no words and fail the base rule; a null stratum is a
    stratum of its own; repeated rows are judged alike; empty tables (documents or labels) are fine; extra columns
    pass through, and a column of this module's (``_q_*``) is replaced.
    """
    kept_columns = [c for c in docs.columns if not c.startswith("_q_")]
    scored = stage(features(docs.select(*kept_columns)).withColumn("_q_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))))
    return apply(scored, cutoffs(scored, labels, alpha, delta))


def apply(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    rejected = " OR ".join(f"coalesce({score} > _q_cut_{name}, false)" for name, (score, _, _) in SCORES.items())
    return scored.join(chosen, "_q_stratum", "left").withColumn("_q_kept", ~F.col("_q_failed") & ~F.expr(rejected))


def verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document the base counts, the base rule and the verdict."""
    stratum = options.get("stratum", "lang")
    narrow = features(docs.select("doc_id", "text", stratum)).drop("text")
    scored = stage(narrow.withColumn("_q_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))))
    chosen = cutoffs(scored, labels, options.get("alpha", ALPHA), options.get("delta", DELTA))
    return apply(scored, chosen).select(
        "doc_id",
        F.col("_q_words").alias("n_words"),
        F.col("_q_chars").alias("word_chars"),
        F.col("_q_symbols").alias("n_symbols"),
        F.col("_q_dup_lines").alias("n_dup_lines"),
        F.col("_q_repeats").alias("n_repeat_words"),
        F.col("_q_failed").alias("base_failed"),
        F.col("_q_kept").alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their columns."""
    return judged(docs, labels, **options).where("_q_kept").select(*docs.columns)


def _sql() -> str:
    score = {k: v[0].replace(" div ", " // ") for k, v in SCORES.items()}
    levels = " UNION ALL ".join(
        f"SELECT stratum, '{k}' AS score, least({n} + 1, (greatest(0, {score[k]}) + {step} - 1) // {step}) AS above, {n} AS levels, {step} AS step, good FROM held" for k, (_, step, n) in SCORES.items()
    )
    cuts = " AND ".join(f"NOT coalesce({score[k]} > (SELECT max(c.s * c.step) FROM chosen c WHERE c.stratum = f.stratum AND c.score = '{k}'), false)" for k in SCORES)
    blank = r"[\x20\x09-\x0D]"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS body,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM base WHERE len(w) >= 3),
spots AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM spots) GROUP BY doc_id),
f0 AS (
  SELECT b.doc_id, b.stratum, len(w) AS _q_words, len(array_to_string(w, '')) AS _q_chars,
    len(body) - len(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS _q_symbols,
    len(l) AS _q_lines, len(l) - len(list_distinct(l)) AS _q_dup_lines, coalesce(c.n, 0) AS _q_repeats
  FROM base b LEFT JOIN covered c ON c.doc_id = b.doc_id),
f AS (SELECT *, _q_words < {MIN_WORDS} OR 100 * _q_repeats > 50 * _q_words AS failed FROM f0),
held AS (SELECT f.*, l.good FROM f JOIN (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1) l USING (doc_id) WHERE NOT failed),
lev AS ({levels}),
per AS (SELECT stratum, score, levels, step, sum(good) AS n, list(above) FILTER (WHERE good = 1) AS ups, list(above) FILTER (WHERE good = 0) AS bad_ups FROM lev GROUP BY ALL),
grid AS (SELECT *, unnest(range(1, levels + 1)) AS s FROM per),
tests AS (SELECT *, coalesce(len(list_filter(ups, lambda x: x > s)), 0) AS k, coalesce(len(list_filter(bad_ups, lambda x: x > s)), 0) AS bad, (SELECT count(*) FROM per) AS m FROM grid),
chosen AS (
  SELECT stratum, score, step, arg_max(s, (bad - {GOOD_COSTS} * k) * 1000 + s) AS s FROM tests
  WHERE k <= n * {ALPHA} AND list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) <= {DELTA} / m
  GROUP BY ALL)
SELECT doc_id, CAST(_q_words AS BIGINT) AS n_words, CAST(_q_chars AS BIGINT) AS word_chars, CAST(_q_symbols AS BIGINT) AS n_symbols,
  CAST(_q_dup_lines AS BIGINT) AS n_dup_lines, CAST(_q_repeats AS BIGINT) AS n_repeat_words, failed AS base_failed,
  NOT failed AND {cuts} AS kept
FROM f"""


SQL = _sql()
