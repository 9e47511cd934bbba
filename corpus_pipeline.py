"""From raw documents to token ids: quality rules, near-duplicate removal, repeated passages, decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its rows are written as Parquet
and read again as the next one's docs (``run`` does so in the shared folder), so a lost executor costs no more than a
stage.  A stage's own intermediate tables are deleted when the next stage begins, its rows being written then.

Rows with null, empty and very long texts, ties, repeated rows, empty tables and extra columns pass every stage as its
operator says; each stage below names what becomes of them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm import bpe, decontaminate, near_duplicates, quality, suffix_dedup
from candlework.llm.common import WORD_TOKENIZER, documents, stage, table, tokenizer_path, unstage
from candlework.operators.staging import collecting

#: A passage of more than 50 words has more bytes than this in any of the languages (about six a word).
PASSAGE_BYTES = 200

_LEFT: list[DataFrame] = []


def tidy(step):
    """``step``, which deletes what the stage before it has staged, and leaves what it stages to the next one."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        unstage(*_LEFT)
        _LEFT.clear()
        with collecting() as made:
            out = step(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    return run_step


@tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: also null and empty texts, which have no words; repeated rows are judged alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@tidy
def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest doc_id.

    Of repeated rows of an id one stays; rows without an id all stay; null and empty texts are alike only to each other.
    """
    return near_duplicates.keep_one_of_each(docs)


@tidy
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``PASSAGE_BYTES`` bytes that stand anywhere else are cut out everywhere; documents with nothing left go.

    Null, empty and shorter texts stay as they are; repeated rows make each other's strings repeated.
    """
    cut = suffix_dedup.without_repeats(docs, PASSAGE_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


@tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; null and empty texts and empty benchmarks overlap nothing."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), share=decontaminate.SHARE)


@tidy
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded text; null texts count as empty."""
    return bpe.encode_documents(docs, tokenizer_path(WORD_TOKENIZER), keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicate_removal", near_duplicate_removal),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: SQL cannot express signatures, suffix sorting, seeds or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, step in STAGES:
        done = stage(step(spark, docs, sf_dir))
        unstage(docs)
        docs = done
    unstage(*_LEFT)
    _LEFT.clear()
    return docs
