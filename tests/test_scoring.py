"""A batch of continuous scoring leaves its tables and nothing else on disk."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().endswith(".data")}


def test_a_batch_leaves_no_shuffles(spark, tmp_path):
    from catalog_engine.plans import fixtures as fx
    from catalog_engine.streaming import scoring

    market = fx.market(spark, SF).withColumn("asin", F.concat(F.lit("B0"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))).drop("p_partkey")
    scoring.score_batch(fx.products(spark, SF), fx.offers(spark, SF), market, str(tmp_path / "warm"), 0, buckets=2)
    before = shuffle_files(spark)
    scoring.score_batch(fx.products(spark, SF), fx.offers(spark, SF), market, str(tmp_path / "scores"), 0, buckets=2)
    assert not shuffle_files(spark) - before
    assert spark.read.parquet(str(tmp_path / "scores" / "results")).count() > 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
