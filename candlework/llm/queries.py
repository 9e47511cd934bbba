"""The registered queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm import bpe, decontaminate, html_text, kneser_ney, near_duplicates, periodic_runs, prefix_trie, quality, sentence_pieces, sharding, suffix_dedup, token_counts, token_files
from candlework.llm.common import BYTE_TOKENIZER, PIECE_MODEL, WORD_TOKENIZER, documents, table, tokenizer_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(documents(spark, sf_dir), tokenizer_path(BYTE_TOKENIZER)).withColumn("n_shared", F.round("n_shared", 9))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), share=decontaminate.SHARE)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), tokenizer_path(WORD_TOKENIZER))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_bytes(documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_rows(spark, token_files.write_token_files(documents(spark, sf_dir), tokenizer_path(WORD_TOKENIZER)))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(documents(spark, sf_dir))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(documents(spark, sf_dir), tokenizer_path(PIECE_MODEL))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(documents(spark, sf_dir), as_test=True)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), as_test=True)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_bpe, op4_html_extraction, op5_quality_rules, op6_suffix_dedup, op7_token_files, op8_kneser_ney, op9_sharding, op10_near_duplicates, op11_sentence_pieces, op12_periodic_runs, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op5_quality_rules": quality.SQL, "op13_prefix_trie": prefix_trie.SQL}
