"""From raw documents to sharded training text: filter, deduplicate, decontaminate, mix, shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog_engine.llm import decontam, minhash, mixing, quality_rules, sharding
from catalog_engine.llm.session import remove, scratch, table, written


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps. Null and empty texts have no words and go; repeated rows and null ids are judged row by row."""
    return quality_rules.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group, on shingles of five words at a similarity of 0.8 or more.

    Of repeated rows one stays; null ids come last; texts without words stay, all of
    them; a text of fewer than five words is one shingle.
    """
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Null and empty texts hold none and stay; an empty benchmark drops nothing."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per pass that the mix takes of them, in training order. Texts without words take no place and go; rows of a null source are a source of their own."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every mixed row; equal rows are rows of their own."""
    return sharding.digest(sharding.shard(docs))


STAGES = [
    ("quality_rules", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The shuffle of the last stage is drawn by hashes that SQL has not; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; what a stage wrote on the way is deleted after it, and its input after the next."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as paths:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        remove(spark, before)
        before = paths
    return STAGES[-1][1](spark, docs, sf_dir)
