"""Fields of product and offer pages: nested, single-quoted and broken markup, tiers, identity and merging."""

import json

import pytest
from pyspark.sql import functions as F

from catalog_engine.sources import detail, markup

TREE = "<div id=a class='x y'><p>one<p>two <b>bold</b><ul><li>1<li>2<ul><li>2a</ul><li>3</ul></div></span><table><tr><th> Key : <td>v<tr><td>Other<td>w</table><script>no <b>x</script><template><p>hid</template>&amp; end<br>line"


def test_tree_of_open_and_nested_elements():
    t = markup.Tree(TREE)
    texts = lambda s: [t.text(i) for i in t.find(s)]
    assert texts("p")[:2] == ["one", "two bold"]
    assert texts("ul li") == ["1", "2\n2a", "2a", "3"] and texts("ul ul li") == ["2a"]
    assert texts("div#a.y.x b") == ["bold"] and texts("#b") == [] and texts(".x") == texts("div")
    assert t.row("key") == "v" and t.row("OTHER") == "w" and t.row("v") is None
    assert t.text(0).endswith("& end\nline") and "no " not in t.text(0) and "hid" not in t.text(0)


def test_titles_as_pages_write_them(spark, tmp_path):
    import duckdb

    from catalog_engine.plans import queries, queries_inputs  # noqa: F401

    titles = ["a &amp;&amp; b&amp", "token = &quot;77&quot;", "&amp;lt;b&amp;gt; &lt;i&gt;", " \n x \t y&#38;  ", "a &nbsp;b\u00a0", "&", "", "two\x0blines", "<b>bold</b>"]
    pages = [(i, f'<!-- \n --><html lang="en">\n<head><title>{t}</title></head>\n<nav class=n><a href="/{i}">x</a></nav></html>') for i, t in enumerate(titles)] + [(90, "<p>none</p>"), (91, "<title>open")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["page_selectors"](spark, str(tmp_path)).collect())
    assert got == sorted(duck.execute(queries.ORACLE_SQL["page_selectors"]).fetchall()) and len(got) == len(pages)
    assert got[0][1] == "a && b&amp" and got[1][1] == "token = &quot;77&quot;"
    t = markup.Tree("<p>a\n<i x='1'>b &amp; <img>c</i>\nd<p>e")
    assert [t.source(i) for i in range(1, 5)] == ["", "b &amp; <img>c", "", ""]


@pytest.mark.parametrize("page", ["", "<", "<![weird[x]]><p>a", "<!-- open", "</div></p>text", "<div " * 50, "<a href='x", "\x00<p>퟿"])
def test_broken_pages_parse(page):
    markup.Tree(page).find("p")


def test_deep_pages_take_linear_time():
    import time

    times = []
    for n in (4_000, 16_000):
        start = time.process_time()
        markup.Tree("<div>" * n + "</span>" * n + "<p>" * n)
        times.append(time.process_time() - start)
    assert times[1] < 12 * max(times[0], 0.01)


def product(spark, *pages):
    e = detail.product_evidence(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"))
    out = {}
    for r in e.collect():
        out.setdefault(r["entity_ref"], {})[r["field_name"]] = r["value"]
    return [out[i] for i in range(len(pages))]


def test_product_pages(spark):
    nested = """<div id='feature-bullets'><ul><li><span>A &amp; b</span></li><li> </li><li>Reviewed #7 times</li></ul></div>
      <div id="merchant-info"><div><span>Ships from <b>Depot</b></span></div><div>Sold by <a>Acme Ltd</a> and Fulfilled by Big Co</div></div>
      <div id=altImages><ul><li><img src="http://x/1.jpg"><li><img src="data:1"></ul></div><table><tr><th> Item Weight<td>1.5 pounds<tr><th>Package Dimensions</th><td>10 x 4 x 12 inches</td></tr></table>
      <span id='productTitle'> A
      title </span><span class="a-price a-text-price">Typical: <span class='a-offscreen'>$30.00</span></span><span class="a-price"><span class="a-offscreen">List: $30</span></span><span class=a-offscreen>$24.50</span>
      <div id="SalesRank">Best Sellers Rank: #1,234 in Tools</div><i id="acrPopover" title="4.6 out of 5 stars"></i><a id=bylineInfo>Visit the Acme Store</a><div id="aplus"></div>"""
    images = """<div id="altImages" data-secondary-images='["http://a/1.jpg", "x", "http://a/2.jpg"]'></div><img id=landingImage data-a-dynamic-image='{"https://b/1.jpg":[1,2]}' src="https://b/0.jpg"><dl><dt>Brand Name<dd>by Acme</dl>"""
    objects = """<div id="altImages" data-secondary-images='{"http://a/1.jpg": [1]}'></div><div id="detailBullets_feature_div">rated #9 of all</div><span class="a-icon-star"><span class="a-icon-alt">3.9 out of 5</span></span>"""
    a, b, c, none = product(spark, nested, images, objects, None)
    assert json.loads(a["bullet_points"]) == ["A & b", "Reviewed #7 times"] and (a["seller"], a["fulfillment"]) == ("Acme Ltd", "Depot")
    assert json.loads(a["secondary_images"]) == ["http://x/1.jpg"] and float(a["weight_kg"]) == pytest.approx(1.5 * 0.453592) and json.loads(a["package_dimensions"]) == [30.48, 25.4, 10.16] == json.loads(a["product_dimensions"])
    assert (a["title"], a["price"], a["list_price"], a["bsr"], a["rating"], a["brand"], a["a_plus"]) == ("A title", "30.0", "$30.00", "1234", "4.6", "Acme Store", "true")
    assert json.loads(b["secondary_images"]) == ["http://a/1.jpg", "http://a/2.jpg"] and b["main_image"] == "https://b/1.jpg" and b["brand"] == "Acme"
    assert json.loads(c["secondary_images"]) == ["http://a/1.jpg"] and c["bsr"] is None and c["rating"] == "3.9"
    assert len(none) == 25 and set(none.values()) == {None}


def test_evidence_rows_and_own_parser(spark):
    pages = spark.createDataFrame([(1, "<b id=productTitle>x</b>")], "page_id int, html string")
    e = {r["field_name"]: r for r in detail.product_evidence(pages).collect()}
    assert (e["title"]["status"], e["title"]["confidence"]) == ("extracted", 0.9) and (e["seller"]["status"], e["seller"]["expires_at"]) == ("missing", None)
    own = detail.product_evidence(pages, parser=lambda h: {"whole": h}).first()
    assert own["field_name"] == "whole" and own["value"] == "<b id=productTitle>x</b>"


RICH = {
    "offerId": "780485617589", "beginAmount": 10, "skuMap": {"黑色/M": "sku-1"}, "attributes": [{"name": "材质", "value": "硅胶"}, {"name": "规格", "value": "M"}, {"name": "产地", "value": "浙江义乌"}, {"name": "包装", "value": "彩盒"}],
    "detailImageUrls": ["https://img.example/detail.jpg"], "skuImages": ["https://img.example/sku.jpg"], "companyType": "生产厂家", "companyYears": 8, "companyAddress": "浙江金华", "transactionVolume": "100万+",
    "certifications": ["CE"], "supportCustom": True, "customLogo": True, "sampleAvailable": False, "returnPolicy": "7天无理由退货",
}
NESTED = {
    "offerInfo": {
        "saleInfo": {"minOrderQuantity": "20", "priceRangeList": [{"startQuantity": "20", "price": "25.5"}, {"startQuantity": "100", "price": "¥21"}, {"startQuantity": "100", "price": "22.0"}, {"startQuantity": "x", "price": 1}]},
        "detailInfo": {"attributes": [{"attributeName": "材质", "value": "304不锈钢"}, {"attributeName": "颜色", "value": "黑色"}, {"attributeName": "包装尺寸", "value": "8x8x26cm"}, {"attributeName": "毛重", "value": "0.45kg"}, {"attributeName": "发货期", "value": "7天"}, {"attributeName": "专利", "value": "外观专利"}]},
        "description": "品牌授权产品",
    }
}
script = lambda v: f"<script>var a = 1; window.data = {json.dumps(v, ensure_ascii=False)};</script>"
HEATER = {"offerId": "1", "subject": "48000BTU 丙烷金字塔户外取暖器", "beginAmount": 5, "price": 680, "companyType": "生产厂家", "companyYears": 9, "supportCustom": True}
# page, address, expected id, what must come out
OFFERS = [
    (script(NESTED), None, None, {"moq": 20, "base_price_cny": 22.0, "price_tiers": [(20, 25.5), (100, 22.0)], "delivery_days": 7, "product_dimensions_cm": "8.0x8.0x26.0cm", "product_weight_g": 450.0, "material": "不锈钢", "color": "黑色", "risk_flags": ["patent_claim", "brand_authorization_required"]}),
    ("<div>起订量 30件</div><div>阶梯价 30件 ¥12.8 100件 ¥10.5</div><div>包装尺寸 6*6*18cm 重量 260g 交期 8天 外观专利</div>", None, None, {"moq": 30, "base_price_cny": 10.5, "price_tiers": [(30, 12.8), (100, 10.5)], "delivery_days": 8, "product_dimensions_cm": "6.0x6.0x18.0cm", "product_weight_g": 260.0, "risk_flags": ["patent_claim"]}),
    ("<body>请登录后继续访问 验证码</body>", None, None, {"error_code": "AUTH_REQUIRED", "moq": None}),
    ("<body>滑动滑块完成验证码</body>", None, None, {"error_code": "CAPTCHA"}),
    ("<body>访问过于频繁，请稍后再试</body>", None, None, {"error_code": "RATE_LIMITED"}),
    ("<html><h1>商品详情</h1><p>系统错误模板</p></html>", None, None, {"error_code": "INVALID_OFFER_PAGE"}),
    (None, None, None, {"error_code": "INVALID_OFFER_PAGE"}),
    (script({"offerId": "123"}), None, None, {"error_code": None, "moq": None, "price_tiers": None, "n_fields": 0}),
    (script(RICH), None, None, {"sku_options": '{"黑色/M": "sku-1"}', "origin": "浙江义乌", "package_details": "彩盒", "specification": "M", "supplier_type": "生产厂家", "supplier_years": 8, "detail_images": ["https://img.example/detail.jpg"], "certifications": ["CE"], "customization": "true", "sample_available": "false", "is_factory": True, "evidence_completeness": 1.0, "material": "硅胶"}),
    (script({"offerId": "222", "beginAmount": 10}), None, "111", {"error_code": "OFFER_ID_MISMATCH", "moq": None}),
    (script({"offerId": "999", "beginAmount": 10}), "https://detail.example/offer/123.html", "123", {"error_code": "OFFER_ID_MISMATCH"}),
    (script({"offerId": "123"}) + script({"offerId": "123", "beginAmount": 25, "attributes": [{"name": "材质", "value": "硅胶"}]}), None, "123", {"moq": 25, "material": "硅胶"}),
    ("商品 起订量 30件 材质 硅胶" + script({"offerId": "123", "beginAmount": None, "attributes": [{"name": "材质", "value": None}]}), None, "123", {"moq": 30, "material": "硅胶"}),
    ("<body>起订量 20件 价格 ￥12 材质 硅胶</body>", None, "123", {"error_code": "OFFER_ID_UNVERIFIED"}),
    ('<link rel="canonical" href="https://detail.example/offer/123.html"><body>商品详情</body>', None, "123", {"error_code": None, "moq": None}),
    ("<body>商品详情</body>", "https://detail.example/x?offerId=123", "123", {"error_code": None}),
    (script({"offerId": "123", "beginAmount": 20, "relatedOffers": [{"offerId": "777"}]}) + '<a href="https://detail.example/offer/999.html">相关推荐</a>', None, "123", {"error_code": None, "moq": 20}),
    ("<link href='https://detail.example/offer/999.html' rel='x canonical'>" + script({"offerId": "123", "beginAmount": 20}), None, "123", {"error_code": "OFFER_ID_MISMATCH"}),
    (script({"offerId": "123"}) + script({"offerId": "999", "beginAmount": 20, "attributes": [{"name": "材质", "value": "硅胶"}]}), None, "123", {"error_code": "OFFER_ID_MISMATCH"}),
    (script(HEATER), None, None, {"function": "户外取暖", "product_type": "full_product", "base_price_cny": 680.0, "factory_evidence": {"supplier_type": "生产厂家", "supplier_years": "9", "customization": "true"}, "evidence_completeness": 0.6}),
    (script({"offerId": "5", "a": [{"b": [[{"skuPriceList": [{"quantity": 1, "discountPrice": 9}, {"quantity": 100, "price": 5}, {"quantity": 100, "price": 6}]}]]}]}), None, None, {"base_price_cny": 6.0, "price_tiers": [(1, 9.0), (100, 6.0)]}),
]


def test_offer_pages(spark):
    pages = spark.createDataFrame([(i, *p[:3]) for i, p in enumerate(OFFERS)], "page_id int, html string, url string, want string").withColumns({c: F.lit("clash") for c in ("id", "Text", "spec", "fields", "profile")})
    got = {r["page_id"]: r.asDict(recursive=True) for r in detail.offer_evidence(pages, url_col="url", expected_col="want").collect()}
    assert len(got) == len(OFFERS)
    for i, (*_, want) in enumerate(OFFERS):
        for k, v in want.items():
            found = [tuple(t.values()) for t in got[i][k]] if k == "price_tiers" and got[i][k] else got[i][k]
            assert found == v, (i, k)
    heater = got[19]["category_profile"]
    assert (heater["category"], heater["subtype"], heater["heat_output_btu"], heater["fuel_type"]) == ("patio_heater", "pyramid_heater", 48000.0, "propane")
    assert got[0]["provenance"]["moq"] == {"status": "extracted", "confidence": 0.95} and got[7]["provenance"]["moq"] == {"status": "missing", "confidence": None}


def test_bare_numbers_are_no_material(spark):
    objects = [
        ({"offerId": "1", "companyYears": 304, "attributes": [{"name": "材质", "value": "硅胶"}]}, "硅胶"), ({"offerId": "1", "companyYears": 316, "companyType": "factory"}, "硅胶"), ({"offerId": "1", "price": 304, "x": [316, "铝"]}, "铝合金"),
        ({"offerId": "1", "attributes": [{"name": "材质", "value": 304}]}, "不锈钢"), ({"offerId": "1", "subject": "304 保温杯"}, "不锈钢"), ({"offerId": "1", "x": ["stainless", 5, "steel"]}, "钢"),
    ]
    pages = spark.createDataFrame([(i, "<p>材质 硅胶</p>" + script(o)) for i, (o, _) in enumerate(objects)], "page_id int, html string")
    got = {r["page_id"]: (r["material"], r["supplier_years"]) for r in detail.offer_evidence(pages).collect()}
    assert [got[i][0] for i in range(len(objects))] == [want for _, want in objects] and (got[0][1], got[1][1]) == (304, 316)


def test_offer_pages_of_an_empty_table(spark):
    assert detail.offer_evidence(spark.createDataFrame([], "page_id int, html string")).count() == 0
