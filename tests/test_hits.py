"""Hits of query texts that many attempts and many offers share."""

from collections import Counter

from pyspark.sql import functions as F

from catalog_engine.operators import joins


def test_hits_of_a_frequent_text_are_made_in_many_tasks(spark):
    attempts = spark.createDataFrame([(i % 300, "often" if i % 3 else None if i % 2 else "never") for i in range(900)] + [(1, "once"), (2, "nothing named")], "id long, query_text string").coalesce(1)
    executions = spark.createDataFrame([("often", "completed"), ("once", "failed"), ("once", "completed")], "query_text string, status string")
    offers = spark.createDataFrame([(i, ["often", "never"] if i % 2 else ["often"]) for i in range(200)] + [(None, ["often", "once"]), (None, ["once"]), (7, ["often", "often"]), (8, None), (9, [])], "offer_id long, search_queries array<string>").coalesce(1)
    named = offers.select("offer_id", F.explode("search_queries").alias("query_text"))
    want = attempts.join(executions, "query_text", "left").join(named, "query_text", "left")
    got = joins.query_hits(attempts, executions, offers)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    per_task = [r["count"] for r in got.filter("query_text = 'often'").groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(per_task) > 16 and max(per_task) < sum(per_task) / 8
