"""Readers of export files, nested payloads, time series and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nm

#: Header aliases of the two export kinds (fixed values).
KEYWORD_HEADERS = {
    "keyword": ["keywords", "search term", "search terms", "关键词", "关键字", "搜索词", "流量词"],
    "search_volume": ["monthly search volume", "searches", "搜索量", "月搜索量"],
    "purchase_volume": ["monthly purchase volume", "purchases", "购买量", "月购买量"],
    "purchase_rate": ["conversion rate", "购买率", "转化率"],
    "competing_products": ["competing product", "product count", "competition", "竞品数", "竞争商品数", "商品数"],
    "spr": [],
    "organic_rank": ["natural rank", "自然排名"],
    "ad_rank": ["sponsored rank", "广告排名"],
    "trend": ["search trend", "趋势", "搜索趋势"],
    "duration": ["time period", "period", "时长", "周期"],
}
KEYWORD_NUMBERS = ("search_volume", "purchase_volume", "purchase_rate", "competing_products", "spr", "organic_rank", "ad_rank")
COMPETITOR_HEADERS = {
    "seller": ["sellers", "store", "store name", "seller name", "卖家", "卖家名称", "店铺", "店铺名称", "商家"],
    "brand": ["brand name", "品牌", "品牌名称"],
    "asin": ["商品asin", "product asin", "parent asin"],
    "title": ["product title", "product name", "商品标题", "标题", "产品名称", "商品名称"],
    "price": ["avg price", "average price", "价格", "售价", "均价", "平均价格"],
    "rating": ["ratings", "star", "stars", "review rating", "评分", "星级", "星评"],
    "review_count": ["reviews", "review counts", "num reviews", "ratings count", "评论数", "评价数", "评分数", "评论数量"],
    "launch_date": ["listing date", "date first available", "first available", "上架时间", "上架日期", "首次上架", "上架"],
    "monthly_sales": ["sales", "units sold", "monthly units", "月销量", "销量", "月销", "月销售量"],
    "monthly_revenue": ["revenue", "sales revenue", "月销售额", "销售额", "月营收", "月销额"],
    "seller_product_count": ["seller products", "product count", "products", "卖家商品数", "在售商品数", "商品数", "在售数"],
}
COMPETITOR_NUMBERS = ("price", "rating", "review_count", "monthly_sales", "monthly_revenue", "seller_product_count")


def read_export(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV export as text columns with its file name and row position; ragged rows fail the read.

    ``source_pos`` grows along a file however the file is split: the block's first
    byte above the row's number in the task. ``multi_line`` reads cells with line
    breaks, one task a file.
    """
    raw = spark.read.csv(path, header=True, encoding="UTF-8", mode="FAILFAST", enforceSchema=False, multiLine=multi_line)
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 27) - 1))
    return raw.withColumns({"source_file": F.col("_metadata.file_path"), "source_pos": F.shiftleft(F.col("_metadata.file_block_start"), 27) + nth})


def keyword_rows(df: DataFrame) -> DataFrame:
    """Normalised keyword rows: number pairs (exact, lower bound), trend text, duration in seconds."""
    df = nm.canonical_headers(df, KEYWORD_HEADERS, strict=True, required=("keyword",))
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    out = df.withColumn("keyword", F.lower(nm.text(F.col("keyword"))))
    for c in KEYWORD_NUMBERS:
        pair = nm.numeric(has(c))
        out = out.withColumns({c: pair["exact"], f"{c}_lower_bound": pair["lower_bound"]})
    return out.withColumns({"trend": nm.text(has("trend")), "duration_seconds": nm.duration_seconds(has("duration"))})


def competitor_rows(df: DataFrame) -> DataFrame:
    """Normalised competitor rows; a missing seller falls back to the brand."""
    df = nm.canonical_headers(df, COMPETITOR_HEADERS, strict=False, required=("seller", "brand"))
    names, taken = [c for c in COMPETITOR_HEADERS if c in df.columns], {c.lower() for c in df.columns}
    texts, numbers = (next(n for i in range(len(taken) + 1) if (n := f"_{stem}{'_' * i}") not in taken) for stem in ("texts", "numbers"))
    # cells go through as one array in steps: each is worked out once, and the code for a row stays small enough to be compiled
    rows = df.withColumn(texts, F.transform(F.array(*[F.col(c).cast("string") for c in names]), nm.spaced)).withColumn(texts, F.transform(texts, nm.known))
    has = lambda c: F.get(texts, F.lit(names.index(c))) if c in names else F.lit(None).cast("string")
    rows = rows.withColumn(numbers, F.transform(F.transform(F.array(*map(has, COMPETITOR_NUMBERS)), nm.bare_number), lambda t: F.round(nm.number_value(t), 4)))
    rows = rows.withColumns({c: has(c) for c in ("seller", "asin", "title", "brand", "launch_date")} | {c: F.get(numbers, F.lit(i)) for i, c in enumerate(COMPETITOR_NUMBERS)}).drop(texts, numbers)
    return rows.withColumns({"seller": F.coalesce("seller", "brand"), "asin": nm.asin(F.col("asin")), "launch_date": nm.date(F.col("launch_date"))})


def _first(v: Column, kind: str, *paths: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def offer_payloads(df: DataFrame, json_col: str) -> DataFrame:
    """Offers of nested search responses: the first list under the preferred keys, with alternative names of each field."""
    v = F.try_parse_json(F.col(json_col))
    items = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ("$.data.offers", "$.data.list", "$.offers", "$.list", "$.items", "$")])
    out = df.select(*[c for c in df.columns if c != json_col], F.posexplode(items).alias("source_pos", "item"))
    i = F.col("item")
    return out.select(
        *[c for c in out.columns if c != "item"],
        _first(i, "string", "$.offerId", "$.offer_id", "$.id").alias("offer_id"),
        _first(i, "string", "$.subject", "$.title", "$.name").alias("title_cn"),
        _first(i, "string", "$.companyName", "$.supplier", "$.seller").alias("supplier"),
        # the second tier's price, or the first's
        _first(i, "double", "$.priceTiers[1].price", "$.priceTiers[0].price", "$.price", "$.base_price_cny").alias("base_price_cny"),
        _first(i, "int", "$.moq", "$.minOrder", "$.quantityBegin").alias("moq"),
    )


def imported_offers(df: DataFrame, json_col: str) -> DataFrame:
    """Offers written by hand: a missing id is made from the row's content; rows without title and name are dropped."""
    v = F.try_parse_json(F.col(json_col))
    made = F.concat(F.lit("import-"), F.substring(F.sha1(F.to_json(v)), 1, 12))
    title, name = _first(v, "string", "$.title", "$.title_cn", "$.subject"), _first(v, "string", "$.supplier", "$.company", "$.name")
    out = df.withColumns({"offer_id": F.coalesce(_first(v, "string", "$.offer_id", "$.id"), made), "title_cn": title, "supplier": name, "base_price_cny": _first(v, "double", "$.price", "$.base_price_cny")})
    return out.filter(F.col("title_cn").isNotNull() | F.col("supplier").isNotNull()).drop(json_col)


def last_value(series: Column) -> Column:
    """Last value of a flat [time, value, ...] array; -1 means missing."""
    return F.nullif(F.try_element_at(series, F.lit(-1)), F.lit(-1.0))


def price_history(df: DataFrame, price: str = "price_series", rating: str = "rating_series", ranks: str | None = None, lengths: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Current price (cents to USD), rating (tenths), best rank, sides (mm to cm) and weight (g to kg)."""
    out = df.withColumns({"price": last_value(F.col(price)) / 100, "rating": last_value(F.col(rating)) / 10})
    if ranks:
        out = out.withColumn("bsr_rank", F.array_min(F.filter(F.transform(F.map_values(ranks), last_value), lambda x: x.isNotNull())))
    for c in lengths:
        out = out.withColumn(c.replace("_mm", "_cm"), F.col(c) / 10)
    return out.withColumn("weight_kg", F.col(weight) / 1000) if weight else out


def bestseller_items(df: DataFrame, json_col: str) -> DataFrame:
    """Products of bestseller items; the price is a number or an object with a value."""
    v = F.try_parse_json(F.col(json_col))
    return df.withColumns(
        {
            "asin": nm.asin(_first(v, "string", "$.asin")), "title": _first(v, "string", "$.title"), "price": _first(v, "double", "$.price.value", "$.price"), "bsr_rank": _first(v, "int", "$.rank", "$.position"),
            "rating": _first(v, "double", "$.rating"), "review_count": _first(v, "int", "$.ratings_total", "$.reviews"), "main_image_url": _first(v, "string", "$.image", "$.images[0].link", "$.images[0]"),
        }
    ).drop(json_col)


def market_detail(df: DataFrame, json_col: str) -> DataFrame:
    """Flat market metrics of nested detail: epoch milliseconds, Y flags, fallbacks by field."""
    v = F.try_parse_json(F.col(json_col))
    flag = _first(v, "string", "$.fba", "$.isFba")
    return df.withColumns(
        {
            "est_monthly_sales": _first(v, "int", "$.monthlySales", "$.sales.month", "$.units"), "search_volume_monthly": _first(v, "int", "$.searches", "$.keyword.searches"), "top10_revenue_share": _first(v, "double", "$.top10Share", "$.share.top10"),
            "listed_at": F.timestamp_millis(_first(v, "bigint", "$.listedAt", "$.availableDate")), "is_fba": F.when(flag.isNotNull(), F.upper(flag) == "Y"),
        }
    ).drop(json_col)


def candidate_exports(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All export documents under a path with their file name and time; unreadable ones are skipped. Documents are whole files, or lines of them."""
    raw = spark.read.option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    raw = raw.filter("_corrupt_record is null") if "_corrupt_record" in raw.columns else raw
    return raw.withColumns({"export_id": F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""), "exported_at": F.col("_metadata.file_modification_time")})


def page_evidence(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", observed: str = "2025-01-01 00:00:00") -> DataFrame:
    """Long evidence rows of pages: each field extracted (confidence 0.9) or missing (0), expiring after a day."""
    h = F.coalesce(F.col(html_col), F.lit(""))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    fields = {
        "title": blank(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        "heading": blank(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1)),
        "language": blank(F.regexp_extract(h, r'(?i)<html[^>]*\blang="([^"]*)"', 1)),
        "charset": blank(F.regexp_extract(h, r'(?i)<meta[^>]*charset="?([a-z0-9-]+)', 1)),
        "n_links": F.nullif(F.regexp_count(h, F.lit("(?i)<a\\s")), F.lit(0)).cast("string"),
        "canonical": blank(F.regexp_extract(h, r'(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1)),
        "image": blank(F.regexp_extract(h, r'(?i)<meta[^>]*property="og:image"[^>]*content="([^"]*)"', 1)),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("field_name"), v.alias("value")) for k, v in fields.items()])
    out = pages.select(F.col(id_col).alias("entity_ref"), F.inline(rows))
    seen = F.lit(observed).cast("timestamp")
    found = F.col("value").isNotNull()
    return out.withColumns({"status": F.when(found, "extracted").otherwise("missing"), "confidence": F.when(found, 0.9).otherwise(0.0), "observed_at": seen, "expires_at": seen + F.expr("interval 1 day")})
