"""Queries over the whole tables, one per operator, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontam, html_extract, lm_mixing, minhash, mixing, quality_knn, quality_rules, secrets, sharding, spelling, url_filter, whitening
from .session import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op2_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.place(table(spark, sf_dir, "documents")))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.filter("is_secret").select("doc_id", "word_index", "candidate", "probability")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digest(url_filter.judge(table(spark, sf_dir, "pages")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.digest(lm_mixing.score(table(spark, sf_dir, "documents")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(table(spark, sf_dir, "documents")))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    (conv_id, _, *pair), (_, _, second, text) = chat_format.PLANTED
    planted = spark.range(2).select(F.lit(conv_id).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, pair[0]).otherwise(second).alias("role"), F.lit(text).alias("text"))
    return chat_format.digest(chat_format.format_chats(chats.union(planted)))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.group_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_curriculum_mixing": op2_curriculum_mixing,
    "op3_secret_scans": op3_secret_scans,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_neighbours": op6_quality_neighbours,
    "op7_url_filters": op7_url_filters,
    "op8_decontamination": op8_decontamination,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_sharding": op10_sharding,
    "op11_chat_format": op11_chat_format,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": minhash.ORACLE_SQL,
    "op2_curriculum_mixing": mixing.ORACLE_SQL,
    "op5_quality_rules": quality_rules.oracle_sql(),
    "op7_url_filters": url_filter.ORACLE_SQL,
    "op11_chat_format": chat_format.oracle_sql(),
}
