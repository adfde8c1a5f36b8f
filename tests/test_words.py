"""Search words, containment of words in texts, and relevance of titles."""

import random

from pyspark.sql import functions as F

from catalog_engine.functions import predicates
from catalog_engine.operators import containment, keywords

TITLES = {
    "24 oz Stainless Steel Insulated Water Bottle with Straw Lid, 2 Pack": (["不锈钢保温杯", "保温杯", "水杯", "不锈钢", "吸管", "带盖", "24 oz Stainless Steel Insulated Water Bottle with", "24 oz Stainless Steel Insulated Water Bottle", "24 oz Stainless"], ["710ml", "大容量", "2个装"]),
    "B07984JN3L": ([], ["3L", "大容量"]),
    "Extra Thick Non-Slip Yoga Mat for Home Fitness": (["瑜伽垫", "防滑", "Extra Thick Non-Slip Yoga Mat for Home Fitness", "Extra Thick Non-Slip Yoga Mat Home Fitness", "Extra Thick Non-Slip"], []),
    "Liquid Ant Killer Bait Stations for Indoor Ant Control, 12 Count": (["灭蚁饵剂"], ["12盒装"]),
    "Kitchen Towel Set of 4, 10x10x5 inches": (["毛巾"], ["4条装", "多尺寸规格"]),
    "Set of 6 cups 2 gallon": (["Set of 6 cups 2 gallon"], ["7.6L", "大容量", "6件套"]),
    "solid 150 ml vial": (["solid 150 ml vial"], ["150ml", "小容量"]),
    None: ([], []),
}


def test_words_of_titles(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "t string")
    for r in df.select("t", keywords.title_keywords(F.col("t")).alias("w"), keywords.dimension_keywords(F.col("t")).alias("d")).collect():
        words, sizes = TITLES[r["t"]]
        assert r["d"] == sizes and (r["w"] == words if len(words) != 1 else r["w"][0] == words[0])


def test_enriched_and_supply_words(spark):
    rows = [(["3L", "大容量"], []), (["12盒装"], ["液体蚂蚁诱饵盒", "家用灭蚁药", "杀虫饵剂"]), (["1件套", "2件套", "3件套"], ["deck box", "3L", "B07984JN3L"]), ([], ["ABC1", "ant trap 灭蚁", "lamp", " "])]
    df = spark.createDataFrame([(i, d, v) for i, (d, v) in enumerate(rows)], "i int, d array<string>, v array<string>")
    got = [tuple(r) for r in df.orderBy("i").select(keywords.enriched_keywords(F.col("d"), F.col("v")), keywords.supply_chain_keywords(F.col("v"))).collect()]
    assert got[0][0] == [] and got[1][0] == ["液体蚂蚁诱饵盒", "家用灭蚁药", "杀虫饵剂", "液体蚂蚁诱饵盒 12盒装", "家用灭蚁药 12盒装"]
    assert got[2][0] == ["deck box", "deck box 1件套", "deck box 2件套"] and got[2][1] == ["户外储物箱", "庭院收纳箱"]
    assert got[3][1] == ["灭蚁饵剂", "蚂蚁诱饵盒", "ant trap 灭蚁", "lamp"]


def test_aliases_touch_in_both_directions(spark):
    df = spark.createDataFrame([(["水杯"],), (["BOTTLE opener", " "],), ([],), (["304"],), ([None, "mat"],)], "w array<string>")
    got = [r[0] for r in df.select(containment.expand_keywords(F.col("w"))).collect()]
    assert "保温杯" in got[0] and "thermos" in got[0] and got[1][0] == "BOTTLE opener" and "水杯" in got[1] and got[2] == [] and "不锈钢" in got[3] and "瑜伽垫" in got[4] and "厨房垫" in got[4]


def plain_match(offers, keys, top_k):
    out = []
    for key, words in keys:
        seen = []
        for w in (w.strip() for w in words if w and w.strip()):
            group = [w]
            for g in containment.ALIASES:
                if any((t.lower() in w.lower() or w.lower() in t.lower()) if t.isascii() else (t in w or w in t) for t in g):
                    group += g
            seen = list(dict.fromkeys([*seen, *group]))
        scored = [(-sum(x.lower() in (t or "").lower() for x in seen), -at, i) for i, t, at in offers]
        out += [(key, i, -s, n + 1) for n, (s, _, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:top_k])]
    return sorted(out)


def test_matches_equal_a_plain_scan(spark):
    rnd = random.Random(2)
    words = ["the", "Gear", "铝", "水杯", "不锈钢 304", "x", "Storage Box", "zz", "lamp-oil", "é"]
    offers = [(i, " ".join(rnd.choice(["the gear", "Vacuum BOTTLE", "铝合金", "304钢", "lamp-oil", "xyz", "boxes", "storage  box", "É"]) for _ in range(rnd.randint(0, 5))) if i % 17 else None, i % 5) for i in range(120)]
    keys = [(f"k{i}", rnd.sample(words, rnd.randint(0, 4))) for i in range(12)] + [("all", ["e", "t"])]
    o = spark.createDataFrame(offers, "offer_id long, text string, imported_at long").repartition(4).withColumn("Word", F.lit("clash"))
    k = spark.createDataFrame(keys, "key string, words array<string>")
    got = containment.imported_offer_match(o, k, top_k=7)
    assert sorted(map(tuple, got.select("key", "offer_id", "score", "rank").collect())) == plain_match(offers, keys, 7)
    assert containment.imported_offer_match(o, k.limit(0)).count() == 0 and containment.imported_offer_match(o.limit(0), k).count() == 0


def test_grams_beyond_what_is_sent_are_joined(spark):
    texts = spark.createDataFrame([(1, "Abcde 水杯"), (2, "abd"), (3, None), (4, "")], "id long, text string")
    words = spark.createDataFrame([("BCD",), ("水",), ("水杯",), ("ab",), ("xyz",), ("",), (None,)], "w string")
    got = [sorted(map(tuple, containment.containing_texts(texts, words, "id", "text", "w", most_sent=n).collect())) for n in (0, 100)]
    assert got[0] == got[1] == [(1, "ab"), (1, "bcd"), (1, "水"), (1, "水杯"), (2, "ab")]


RELEVANT = [
    ("户外取暖器", "新款 户外取暖器大号", True), ("取暖器", "户外取暖器 包邮", True), ("取暖", "户外取暖器", False), ("户外 取暖器", "大号户外取暖器", True), ("户外 取暖器", "取暖器 户外", False),
    ("patio heater 取暖器", "patio HEATER 户外取暖器", True), ("patio heater cover set", "patio heater cover", True), ("patio heater", "patio heaters", False), ("a b", "a b", False), (None, "x", False), ("heater", "heater", False),
]


def test_terms_of_titles(spark):
    df = spark.createDataFrame(RELEVANT, "q string, t string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", predicates.relevant_terms(F.col("q"), F.col("t")).alias("got")).collect())


def test_an_assessor_goes_first(spark):
    n, own = F.lit(None).cast("double"), lambda q, t: F.when(F.contains(t, F.lit("!")), F.lit(True))
    df = spark.createDataFrame([("patio heater", "other!"), ("patio heater", "patio heater"), ("patio heater", "lamp")], "q string, t string")
    got = df.select(predicates.offer_relevant(F.lit(None).cast("boolean"), n, n, n, F.lit(False), F.col("q"), F.col("t"), own).alias("r")).collect()
    assert [r["r"] for r in got] == [True, True, False]
