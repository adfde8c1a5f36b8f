"""SQL functions and views give what the Column functions give."""

import os

import pytest
from pyspark.sql import functions as F

from catalog_engine import api
from catalog_engine.functions import cost, normalize, scores
from catalog_engine.operators import text

SF = "/root/testdata/sf0.001"


def test_sql_functions(spark):
    api.register(spark)
    df = spark.createDataFrame([(0.05,), (0.3,), (0.42,), (0.9,)], "m double")
    df.createOrReplaceTempView("margins")
    got = spark.sql("SELECT score_profit(m) AS a, supplier_profit_score(m) AS b FROM margins").collect()
    want = df.select(scores.score_profit(df.m).alias("a"), cost.supplier_profit_score(df.m).alias("b")).collect()
    assert [(pytest.approx(x["a"]), x["b"]) for x in want] == [(x["a"], x["b"]) for x in got]
    r = spark.sql("SELECT tier_price(array(named_struct('min_qty', 10D, 'price_cny', 5D), named_struct('min_qty', 200D, 'price_cny', 4D)), 9D, 200D) AS p, retry_backoff(7) AS s, validate_asin(' b000000001 ') AS a").first()
    assert tuple(r) == (4.0, 60.0, "B000000001")


def test_query_plan_as_a_table_function(spark):
    api.register(spark)
    fields = "asin string, brand string, generic_name string, supply_name string, relation string, category string, package_quantity int, material array<string>, use_case array<string>"
    rows = [("a", "Acme Pro", "Acme red bolt 同款", "螺栓件", "replacement", "patio_heater", 4, [" steel ", ""], None), ("b", None, "gear", "齿轮件", None, "Tools", None, None, ["garden", "pro"]), ("c", "x", "", "", None, None, 0, None, None), ("d", "Z-1 (R)", "z-1 (r) lamp", "lamp", "unknown", " ", -1, ["z"], [])]
    df = spark.createDataFrame(rows, fields).repartition(3)
    df.createOrReplaceTempView("named")
    got = spark.sql("SELECT * FROM query_plan_udtf(TABLE(named) PARTITION BY asin)")
    want = text.query_plan(df, text.query_texts(df.columns)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 48
    narrow = spark.sql("SELECT count(*) AS n, count(DISTINCT text) AS t FROM query_plan_udtf(TABLE(SELECT asin, generic_name FROM named) PARTITION BY asin)").first()
    assert narrow["n"] == 48 and narrow["t"] > 12
    assert spark.sql("SELECT total_score(0.5D, 1D, 0D, 0.2D, 1D, 1D) AS s").first()["s"] == pytest.approx(100 * (0.1 + 0.25 + 0.03 + 0.1 + 0.1))


def test_functions_from_columns(spark):
    api.register(spark)
    rows = [("10K+", 5.0, 3.0, 0.4), ("$1,200.50", None, 0.0, 2.0), ("(5)", 400.0, None, None), ("12.5%", 90.0, 30.0, 0.7), ("soon", 1.0, 1.0, 1.0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, a double, b double, c double")
    df.createOrReplaceTempView("given")
    got = spark.sql("SELECT parse_numeric(s) n, parse_lower_bound(s) l, parse_numeric_simple(s) m, score_competition(a, c) x, score_logistics(a, b, b, c) y, score_demand(a, b, c, a, b, c) z, opportunity_estimate(a, b, c) o, score_risk(s, s, s, c) r, score_supply(a, c, b, b, a, c, c, a, a > 1) p FROM given").collect()
    f, n = F.col, normalize.numeric(F.col("s"))
    features = df.select(f("a").alias("n_offers"), f("c").alias("avg_repeat"), f("b").alias("min_moq"), f("b").alias("min_days"), f("a").alias("min_price"), f("c").alias("avg_match"), f("c").alias("factory_score"), f("a").alias("avg_sales"), (f("a") > 1).alias("any_fba"))
    want = df.select(n["exact"], n["lower_bound"], normalize.numeric_simple(f("s")), scores.score_competition(f("a"), f("c")), scores.score_logistics(f("a"), f("b"), f("b"), f("c")), scores.score_demand(f("a"), f("b"), f("c"), f("a"), f("b"), f("c")), scores.opportunity_estimate(f("a"), f("b"), f("c")), scores.score_risk(f("s"), f("s"), f("s"), f("c"))).collect()
    assert [tuple(r)[:8] for r in got] == [tuple(r) for r in want]
    assert [r["p"] for r in got] == [r[0] for r in features.select(scores.score_supply()).collect()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_views(spark):
    api.register(spark, SF)
    assert spark.sql("SELECT count(*) FROM offers WHERE tier_price(price_tiers, base_price_cny, 200) IS NULL").first()[0] == 0
