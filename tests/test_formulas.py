"""Golden values, bounds and missing-evidence rules of the formulas."""

import pytest
from pyspark.sql import functions as F

from catalog_engine.functions import cost, normalize, predicates, scores, supplier
from catalog_engine.operators import matching, research, setops, specs, windows

PRODUCT = "asin string, price double, category string, length_cm double, width_cm double, height_cm double, weight_kg double, base_price_cny double, price_tiers array<struct<min_qty:double,price_cny:double>>"


def one(df):
    return df.first()


def test_profit_of_a_small_product(spark):
    df = spark.createDataFrame([("a", 30.0, "Clothing", 20.0, 10.0, 5.0, 0.4, 50.0, [(1.0, 40.0), (100.0, 30.0), (500.0, 10.0)])], PRODUCT)
    r = one(cost.with_profit(df))
    assert r["purchase_cost"] == pytest.approx(30 * 0.145)
    assert r["shipping_cost"] == pytest.approx(2.0 + 2.8)
    assert r["fba_fee"] == 3.43
    assert r["commission"] == pytest.approx(30 * 0.17)
    assert r["return_loss"] == pytest.approx(30 * 0.20 * 0.30)
    assert r["net_profit"] == pytest.approx(30 - r["total_cost"])


@pytest.mark.parametrize("price", [None, 0.0, -3.0, float("nan"), float("inf")])
def test_missing_price_is_named_and_not_zero(spark, price):
    df = spark.createDataFrame([("a", price, None, 1.0, 1.0, 1.0, 1.0, 5.0, None)], PRODUCT)
    r = one(cost.with_profit(df))
    assert r["missing_fields"] == ["selling_price"] and r["net_profit"] is None and r["purchase_cost"] is None


def test_missing_evidence_order(spark):
    rows = [("no offer price", 9.0, None, 1.0, 1.0, 1.0, 1.0, None, []), ("no sides", 9.0, None, None, 1.0, 1.0, None, 5.0, None)]
    got = {r["asin"]: r["missing_fields"] for r in cost.with_profit(spark.createDataFrame(rows, PRODUCT)).collect()}
    assert got == {"no offer price": ["purchase_price"], "no sides": ["weight_kg", "length_cm"]}


@pytest.mark.parametrize("tiers,qty,want", [([(10.0, 5.0), (200.0, 4.0)], 200, 4.0), ([(300.0, 5.0), (500.0, 4.0)], 200, 5.0), ([(-1.0, 5.0)], 200, 7.0), ([(5.0, 3.0), (5.0, 2.0)], 200, 3.0), (None, 200, 7.0)])
def test_tier_price(spark, tiers, qty, want):
    df = spark.createDataFrame([(tiers, 7.0)], "t array<struct<min_qty:double,price_cny:double>>, b double")
    assert one(df.select(cost.tier_price(F.col("t"), F.col("b"), F.lit(qty)).alias("p")))["p"] == want


def test_profit_score_is_monotone_and_bounded(spark):
    got = [r["s"] for r in spark.range(0, 101).select("id", scores.score_profit(F.col("id") / 100).alias("s")).orderBy("id").collect()]
    assert got == sorted(got) and got[0] == 0.0 and got[-1] == 1.0
    assert got[30] == pytest.approx(0.5)


def test_scores_without_evidence_are_null(spark):
    n = F.lit(None).cast("double")
    r = one(spark.range(1).select(scores.score_competition(n, n).alias("c"), scores.score_logistics(n, n, n, n).alias("l"), scores.clamp(n).alias("x")))
    assert (r["c"], r["l"], r["x"]) == (None, None, None)


def test_hard_filters_give_all_reasons_in_order(spark):
    c = {"margin": F.lit(0.1), "total": F.lit(40.0), "moq": F.lit(600), "suppliers": F.lit(0), "price": F.lit(10.0), "monthly_sales": F.lit(None).cast("double"), "title": F.lit("Ant Bait trap")}
    assert one(spark.range(1).select(scores.hard_filter_reasons(c).alias("r")))["r"] == ["margin_too_low", "score_too_low", "moq_exceeded", "no_supplier", "price_too_low", "restricted_product"]


def test_supplier_scores_use_known_parts_only(spark):
    n = F.lit(None)
    r = one(spark.range(1).select(supplier.quality_score(n.cast("int"), n.cast("double"), F.lit(False), n.cast("int")).alias("q"), supplier.quality_score(n.cast("int"), n.cast("double"), n.cast("boolean"), n.cast("int")).alias("none"), supplier.candidate_score(n.cast("double"), n.cast("double"), F.lit(1.0)).alias("c")))
    assert (r["q"], r["none"], r["c"]) == (0.45, None, 0.1)


@pytest.mark.parametrize("cell,exact,low", [("10K+", None, 10000.0), ("$1,200.50", 1200.5, None), ("(5)", -5.0, None), ("12.5%", 12.5, None), ("3万", 30000.0, None), ("n/a", None, None), ("about 5", None, None), (None, None, None), ("2.5亿", 2.5e8, None)])
def test_numeric(spark, cell, exact, low):
    r = one(spark.createDataFrame([(cell,)], "c string").select(normalize.numeric(F.col("c")).alias("n")))["n"]
    assert (r["exact"], r["lower_bound"]) == (exact, low)


@pytest.mark.parametrize("cell,want", [("2d 3h 15m", 184500.0), ("1h", 3600.0), ("1h later", None), ("", None), (None, None)])
def test_duration(spark, cell, want):
    assert one(spark.createDataFrame([(cell,)], "c string").select(normalize.duration_seconds(F.col("c")).alias("s")))["s"] == want


@pytest.mark.parametrize("cell,want", [("$12 34", 12.34), ("$1234", 12.34), ("List: $5", None), ("¥1,000", 6.7), ("19.99", 19.99), ("600", 4.02)])
def test_price_text(spark, cell, want):
    got = one(spark.createDataFrame([(cell,)], "c string").select(normalize.price_usd(F.col("c")).alias("p")))["p"]
    assert got == (None if want is None else pytest.approx(want))


def test_headers(spark):
    df = spark.createDataFrame([("a", "b", "c")], "`﻿Search_Term` string, `Monthly  Searches` string, other string")
    out = normalize.canonical_headers(df, {"keyword": ["search term"], "search_volume": ["monthly searches"]}, True, ("keyword",))
    assert out.columns == ["keyword", "search_volume", "other"]
    with pytest.raises(ValueError, match="MISSING_IDENTITY"):
        normalize.canonical_headers(df.select("other"), {"keyword": []}, True, ("keyword",))
    twice = spark.createDataFrame([("a", "b")], "keyword string, `search term` string")
    with pytest.raises(ValueError, match="both mean"):
        normalize.canonical_headers(twice, {"keyword": ["search term"]}, True)


def test_evidence_from_the_future_or_long_ago_is_not_trusted(spark):
    rows = [("ok", "2024-01-31 23:00:00"), ("old", "2023-12-01 00:00:00"), ("future", "2024-02-01 01:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("observed_at"), F.lit("extracted").alias("status"), F.lit("v").alias("value"), F.lit("s").alias("source_type"), F.lit("r").alias("source_ref"), F.lit(None).cast("string").alias("artifact_hash"), F.lit(0.5).alias("confidence"), F.lit(None).cast("timestamp").alias("expires_at"))
    got = {r["k"]: r["x"] for r in df.select("k", predicates.trusted_evidence(F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("x")).collect()}
    assert got == {"ok": True, "old": False, "future": False}


def test_conflicts_beat_scores(spark):
    m = matching.match_decision(F.array(F.lit("x")), F.lit(False), F.lit(False), F.array().cast("array<string>"), F.array(F.lit("price")), F.lit(0.99))
    assert one(spark.range(1).select(m.alias("m")))["m"]["decision"] == "reject"


def test_rank_is_a_total_order_under_any_partitioning(spark):
    df = spark.range(300).select((F.col("id") % 5).alias("asin"), F.col("id").alias("source_pos"), (F.col("id") % 3 / 3).alias("candidate_score"), F.lit(None).cast("double").alias("profit_margin"), F.lit(None).cast("double").alias("net_profit"), F.lit(None).cast("double").alias("profit_score"))
    got = [sorted((r["asin"], r["offer_rank"], r["source_pos"]) for r in windows.rank_offers(df.repartition(n), ["asin"]).collect()) for n in (1, 17)]
    assert got[0] == got[1]


def test_dedupe_is_idempotent_and_keeps_rows_without_id(spark):
    df = spark.createDataFrame([("a", 1, 0, "t"), ("A ", 1, 1, None), ("", 5, 2, None), (None, 5, 3, None)], "asin string, source_rank int, source_pos int, title string")
    once = windows.dedupe_products(df).drop("first_pos")
    assert sorted(r["source_pos"] for r in once.collect()) == [0, 2, 3]
    assert sorted(map(tuple, windows.dedupe_products(once).drop("first_pos").collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_fit_ramps(spark):
    c = F.col("x").cast("double")
    r = spark.createDataFrame([(None,), (200.0,), (3000.0,)], "x double").select(research.ramp_down(c, 200, 3000).alias("d")).collect()
    assert [x["d"] for x in r] == [0.5, 1.0, 0.0]


SPECS = [
    ("Stainless Steel Insulated Water Bottle 24oz with Straw Lid, 2 Pack, 3 x 3 x 10 inch black", {"category": "保温杯", "material": "不锈钢", "color": "黑色", "capacity_ml": 709.8, "pack_count": 2, "dimensions_cm": [7.62, 7.62, 25.4]}, {"保温", "吸管"}),
    ("304不锈钢保温杯 700ml 黑色 带吸管 2只装 7.5x7.5x25cm 380g", {"category": "保温杯", "material": "不锈钢", "capacity_ml": 700.0, "pack_count": 2, "dimensions_cm": [7.5, 7.5, 25.0], "weight_g": 380.0}, {"吸管"}),
    ("Queen Size 4 Piece Sheet Set Comfy Breathable Cooling Sheets Deep Pockets Extra Soft Wrinkle Free White Microfiber", {"category": "床品套件", "material": "聚酯纤维", "color": "白色", "pack_count": 4}, {"床单式", "深口袋", "透气", "凉感", "柔软", "防皱"}),
    ("床单三件套 纯色", {"pack_count": 3, "category": "床品套件"}, {"纯色", "床单式"}),
    ("deck box 5 加仑 10 * 20 * 30 kg battery", {"capacity_ml": 18927.1, "dimensions_cm": [10.0, 20.0, 30.0], "weight_g": 30000.0, "risk_flags": ["battery"]}, set()),
    ("model 1304 in 3040 grey, 12 lbs", {"material": None, "capacity_ml": None, "weight_g": 5443.1, "color": "灰色"}, set()),
    (None, {"category": None, "pack_count": None, "dimensions_cm": None, "features": []}, set()),
]


def test_specs_of_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(SPECS)], "i int, t string").withColumns({c: F.lit("clash") for c in ("_low", "_Numbers")})
    got = {r["i"]: r["spec"].asDict() for r in specs.extract_specs(df, "t").collect()}
    for i, (_, want, features) in enumerate(SPECS):
        assert {k: got[i][k] for k in want} == want and features <= set(got[i]["features"])


def test_reason_union_keeps_first_order(spark):
    w = lambda s: F.array(*[F.lit(x) for x in s.split()])
    assert one(spark.range(1).select(setops.reason_union(w("b a"), F.lit(None).cast("array<string>"), w("a c")).alias("r")))["r"] == ["b", "a", "c"]
