"""Domain tables derived from the driver's star tables, and the same as DuckDB common table expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Product categories by part type.
CATEGORIES = {"STANDARD": "Home & Kitchen", "SMALL": "Toys & Games", "ECONOMY": "Clothing", "MEDIUM": "Electronics", "PROMO": "Health & Personal Care", "LARGE": "Sports"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asin, title, brand, category, price, ranks and measures; some parts lack measures."""
    p = read(spark, sf_dir, "part")
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CATEGORIES.items()))
    side = lambda x: F.when(F.col("p_partkey") % 17 != 0, F.col("p_size") * F.lit(x))
    return p.select(
        "p_partkey",
        F.concat(F.lit("B0"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("asin"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.try_element_at(table, "p_type").alias("category"),
        (F.col("p_retailprice") / 20).alias("price"),
        (F.col("p_partkey") + 1).alias("bsr_rank"),
        side(1.0).alias("length_cm"),
        side(0.6).alias("width_cm"),
        side(0.4).alias("height_cm"),
        side(0.05).alias("weight_kg"),
        F.col("p_partkey").alias("source_pos"),
    )


PRODUCT = (
    "product AS (SELECT p_partkey, 'B0' || lpad(p_partkey::VARCHAR, 8, '0') AS asin, p_name AS title, p_brand AS brand, "
    + "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items()) + " END AS category, "
    + "p_retailprice / 20 AS price, p_partkey + 1 AS bsr_rank, "
    + ", ".join(f"CASE WHEN p_partkey % 17 <> 0 THEN p_size * {x}::DOUBLE END AS {n}" for n, x in (("length_cm", 1.0), ("width_cm", 0.6), ("height_cm", 0.4), ("weight_kg", 0.05)))
    + ", p_partkey AS source_pos FROM part)"
)


def offer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per wholesale tier of a part and supplier: distinct (min_qty, price_cny)."""
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_partkey", "l_suppkey", (F.col("l_quantity") * 10).alias("min_qty"), (F.col("l_extendedprice") / F.col("l_quantity") / 50).alias("price_cny")).distinct()


TIER = "tier AS (SELECT DISTINCT l_partkey, l_suppkey, l_quantity * 10 AS min_qty, l_extendedprice / l_quantity / 50 AS price_cny FROM lineitem)"


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part and supplier, with its tiers as a sorted array."""
    li = read(spark, sf_dir, "lineitem")
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", (F.col("s_nationkey") % 3).alias("_kind"))
    price = F.col("l_extendedprice") / F.col("l_quantity") / 50
    o = li.groupBy("l_partkey", "l_suppkey").agg(
        F.array_sort(F.collect_set(F.struct((F.col("l_quantity") * 10).alias("min_qty"), price.alias("price_cny")))).alias("price_tiers"),
        F.min(price).alias("base_price_cny"),
        (F.min("l_quantity") * 10).alias("moq"),
        (F.sum("l_quantity") * 20).alias("monthly_sales"),
        (F.sum(F.col("l_discount").cast("decimal(12,4)")).cast("double") / F.count("*") * 5).alias("repeat_buyer_rate"),
        (F.min(F.dayofyear("l_shipdate")) % 60).alias("delivery_days"),
        (F.max("l_tax") * 12).alias("match_quality_score"),
    )
    factory = F.when(F.col("_kind") == 0, F.lit(True)).when(F.col("_kind") == 1, F.lit(False))
    return o.join(s, "l_suppkey").select(
        F.col("l_partkey").alias("p_partkey"),
        F.concat(F.lit("B0"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("asin"),
        F.concat(F.lit("9"), F.lpad(F.col("l_suppkey").cast("string"), 8, "0")).alias("offer_id"),
        F.col("s_name").alias("supplier"),
        "price_tiers", "base_price_cny", "moq", "monthly_sales", "repeat_buyer_rate", "delivery_days", "match_quality_score",
        factory.alias("is_factory"),
        (F.col("l_suppkey") % 5 == 0).alias("fba_ready"),
        F.when(F.col("l_suppkey") % 11 == 0, "mock").otherwise("live").alias("source"),
        F.col("l_suppkey").alias("source_pos"),
    )


OFFER = """offer AS (
  SELECT l_partkey AS p_partkey, 'B0' || lpad(l_partkey::VARCHAR, 8, '0') AS asin, '9' || lpad(l_suppkey::VARCHAR, 8, '0') AS offer_id, s_name AS supplier,
         min(l_extendedprice / l_quantity / 50) AS base_price_cny, min(l_quantity) * 10 AS moq, sum(l_quantity) * 20 AS monthly_sales,
         sum(l_discount::DECIMAL(12,4))::DOUBLE / count(*) * 5 AS repeat_buyer_rate, min(dayofyear(l_shipdate)) % 60 AS delivery_days,
         max(l_tax) * 12 AS match_quality_score, CASE s_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_factory,
         l_suppkey % 5 = 0 AS fba_ready, CASE WHEN l_suppkey % 11 = 0 THEN 'mock' ELSE 'live' END AS source, l_suppkey AS source_pos
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey, l_suppkey, s_name, s_nationkey)"""


def competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part and supplier as a seller's listing; the niche is the part type."""
    li = read(spark, sf_dir, "lineitem")
    p = read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    s = read(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    sales = li.groupBy("l_partkey", "l_suppkey").agg(
        F.sum("l_quantity").alias("q"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("rev"), F.count("*").alias("n"), F.min("l_shipdate").alias("first")
    )
    return sales.join(p, "l_partkey").join(s, "l_suppkey").select(
        F.col("p_type").alias("niche"),
        F.col("s_name").alias("seller"),
        F.concat(F.lit("B0"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("asin"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.when(F.col("l_partkey") % 23 != 0, F.col("p_retailprice") / 20).alias("price"),
        ((F.col("l_suppkey") % 21 + 30) / 10).alias("rating"),
        (F.col("n") * (F.col("l_suppkey") % 97)).alias("review_count"),
        F.date_add(F.to_date("first"), 9000).alias("launch_date"),
        (F.col("q") * 3).alias("monthly_sales"),
        F.col("rev").alias("monthly_revenue"),
        F.when(F.col("l_suppkey") % 4 == 0, F.col("l_suppkey") % 70).alias("seller_product_count"),
        F.col("l_partkey").alias("source_pos"),
    )


COMPETITOR = """competitor AS (
  SELECT p_type AS niche, s_name AS seller, 'B0' || lpad(l_partkey::VARCHAR, 8, '0') AS asin, p_name AS title, p_brand AS brand,
         CASE WHEN l_partkey % 23 <> 0 THEN p_retailprice / 20 END AS price, (l_suppkey % 21 + 30) / 10 AS rating,
         count(*) * (l_suppkey % 97) AS review_count, (min(l_shipdate)::DATE + 9000)::DATE AS launch_date, sum(l_quantity) * 3 AS monthly_sales,
         sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS monthly_revenue, CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey % 70 END AS seller_product_count,
         l_partkey AS source_pos
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  GROUP BY p_type, s_name, l_partkey, l_suppkey, p_name, p_brand, p_retailprice)"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: sellers, revenue share of the largest one, sales, and monthly quantities."""
    li = read(spark, sf_dir, "lineitem")
    by = li.groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("rev"), F.sum("l_quantity").alias("q"))
    top = by.groupBy("l_partkey").agg(F.count("*").alias("competing_listings"), (F.max("rev").cast("double") / F.sum("rev").cast("double")).alias("top10_revenue_share"), F.sum("q").alias("q"))
    months = li.groupBy("l_partkey", F.month("l_shipdate").cast("string").alias("m")).agg(F.sum("l_quantity").alias("mq"))
    cv = months.groupBy("l_partkey").agg(F.count("*").alias("nm"), F.sum("mq").alias("sm"), F.sum(F.col("mq") * F.col("mq")).alias("sq"))
    var = (F.col("sq") - F.col("sm") * F.col("sm") / F.col("nm")) / (F.col("nm") - 1)
    cv = cv.select("l_partkey", F.when((F.col("nm") >= 3) & (F.col("sm") > 0), F.sqrt(F.greatest(F.lit(0.0), var)) / (F.col("sm") / F.col("nm"))).alias("season_cv"))
    return top.join(cv, "l_partkey").select(
        F.col("l_partkey").alias("p_partkey"),
        "competing_listings",
        "top10_revenue_share",
        (F.col("q") / 2).alias("est_monthly_sales"),
        (F.col("q") / 60).alias("est_daily_sales"),
        (F.col("competing_listings") * 150).alias("search_volume_monthly"),
        (F.col("l_partkey") % 100 / 500).alias("opportunity_score"),
        "season_cv",
    )


MARKET = """mby AS (SELECT l_partkey, l_suppkey, sum(l_extendedprice::DECIMAL(18,2)) AS rev, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
mtop AS (SELECT l_partkey, count(*) AS competing_listings, max(rev)::DOUBLE / sum(rev)::DOUBLE AS top10_revenue_share, sum(q) AS q FROM mby GROUP BY l_partkey),
mmon AS (SELECT l_partkey, month(l_shipdate) AS m, sum(l_quantity) AS mq FROM lineitem GROUP BY ALL),
mcv AS (SELECT l_partkey, count(*) AS nm, sum(mq) AS sm, sum(mq * mq) AS sq FROM mmon GROUP BY l_partkey),
market AS (
  SELECT t.l_partkey AS p_partkey, competing_listings, top10_revenue_share, q / 2 AS est_monthly_sales, q / 60 AS est_daily_sales,
         competing_listings * 150 AS search_volume_monthly, t.l_partkey % 100 / 500 AS opportunity_score,
         CASE WHEN nm >= 3 AND sm > 0 THEN sqrt(greatest(0.0, (sq - sm * sm / nm) / (nm - 1))) / (sm / nm) END AS season_cv
  FROM mtop t JOIN mcv c ON c.l_partkey = t.l_partkey)"""


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
