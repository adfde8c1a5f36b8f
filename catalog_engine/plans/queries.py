"""Registered queries: one operator of the inventory (or a chain of them) on the driver's tables, with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost
from ..operators import aggregates, joins, research, windows
from ..rules import COST
from ..sources import writers
from ..sources.buckets import shuffles_removed, work_dir
from ..streaming import scoring
from . import fixtures as fx
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c, n: int = 6):
    return F.round(c, n)


def half_up(x: str, n: int) -> str:
    """DuckDB text that rounds a double as Spark does: half up on its shortest decimal form."""
    return f"round(({x})::VARCHAR::DECIMAL(38,18), {n})::DOUBLE"


# --- DuckDB text of formulas that several oracles share -----------------------------------------

PICK = """pick AS (
  SELECT l_partkey AS p_partkey, '9' || lpad(l_suppkey::VARCHAR, 8, '0') AS offer_id,
         coalesce(arg_max(price_cny, min_qty) FILTER (WHERE min_qty <= 200), arg_min(price_cny, min_qty)) AS tier_price
  FROM (SELECT l_partkey, l_suppkey, min_qty, min(price_cny) AS price_cny FROM tier GROUP BY ALL) GROUP BY ALL)"""

_quality = """least(1.0, greatest(0.0,
      (0.35 * (CASE WHEN monthly_sales >= 5000 THEN 1.0 WHEN monthly_sales >= 1000 THEN 0.85 WHEN monthly_sales >= 300 THEN 0.7 WHEN monthly_sales >= 50 THEN 0.55 ELSE 0.35 END)::DOUBLE
       + 0.30 * least(1.0, greatest(0.0, repeat_buyer_rate))
       + coalesce(0.25 * (CASE WHEN is_factory THEN 1.0 WHEN NOT is_factory THEN 0.45 END)::DOUBLE, 0.0)
       + 0.10 * (CASE WHEN delivery_days <= 7 THEN 1.0 WHEN delivery_days <= 15 THEN 0.85 WHEN delivery_days <= 30 THEN 0.65 ELSE 0.35 END)::DOUBLE)
      / (0.35::DOUBLE + 0.30::DOUBLE + CASE WHEN is_factory IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END + 0.10::DOUBLE)))"""
_business = """least(1.0, greatest(0.0, 0.65 * (CASE WHEN moq <= 50 THEN 1.0 WHEN moq <= 100 THEN 0.85 WHEN moq <= 300 THEN 0.65 WHEN moq <= 500 THEN 0.45 ELSE 0.25 END)::DOUBLE
       + 0.35 * (CASE WHEN base_price_cny <= 20 THEN 1.0 WHEN base_price_cny <= 50 THEN 0.8 WHEN base_price_cny <= 100 THEN 0.6 ELSE 0.4 END)::DOUBLE))"""
STEP = f"""oscore AS (
  SELECT *, {half_up("0.65 * least(1.0, greatest(0.0, match_quality_score)) + 0.25 * quality_score + 0.10 * business_score", 4)} AS candidate_score
  FROM (SELECT *, {half_up(_quality, 4)} AS quality_score, {half_up(_business, 4)} AS business_score FROM offer))"""

_rate = lambda pairs, default: "CASE category " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in pairs) + f" ELSE {default}::DOUBLE END"
_bands = "CASE " + " ".join(f"WHEN greatest(length_cm, width_cm, height_cm) * {COST.cm_to_in}::DOUBLE <= {a} AND weight_kg * {COST.kg_to_oz}::DOUBLE <= {b} THEN {c}::DOUBLE" for a, b, c in COST.bands) + f" ELSE {COST.bands[-1][2]}::DOUBLE END"

PRICED = f"""priced AS (
  SELECT *, purchase_cost + shipping_cost + fba_fee + commission + ad_cost + return_loss + exchange_loss AS total_cost,
         price - (purchase_cost + shipping_cost + fba_fee + commission + ad_cost + return_loss + exchange_loss) AS net_profit,
         (price - (purchase_cost + shipping_cost + fba_fee + commission + ad_cost + return_loss + exchange_loss)) / price AS profit_margin
  FROM (SELECT p.*, s.* EXCLUDE (p_partkey, asin, source_pos), s.source_pos AS offer_pos, tier_price, tier_price * 0.145::DOUBLE AS purchase_cost,
          2.0::DOUBLE + 2.8::DOUBLE * greatest(weight_kg, length_cm * width_cm * height_cm / 6000.0::DOUBLE, CASE WHEN weight_kg IS NOT NULL THEN 1.0::DOUBLE END) * CASE WHEN weight_kg IS NULL THEN NULL ELSE 1 END AS shipping_cost,
          CASE WHEN weight_kg IS NOT NULL THEN {_bands} END AS fba_fee,
          price * {_rate(COST.commission, COST.default_commission)} AS commission, price * 0.25::DOUBLE * 0.20::DOUBLE AS ad_cost,
          price * {_rate(COST.returns, COST.default_return)} * 0.30::DOUBLE AS return_loss, price * 0.01::DOUBLE AS exchange_loss
        FROM product p JOIN oscore s ON s.p_partkey = p.p_partkey JOIN pick k ON k.p_partkey = p.p_partkey AND k.offer_id = s.offer_id))"""

RANKED = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY asin ORDER BY rank_score DESC, candidate_score DESC, coalesce(profit_margin, -1) DESC, coalesce(net_profit, -1) DESC, offer_pos) AS offer_rank
  FROM (SELECT *, {half_up('0.70 * candidate_score + 0.30 * coalesce(profit_score, 0.0)', 4)} AS rank_score
        FROM (SELECT *, CASE WHEN profit_margin <= 0 THEN 0.0::DOUBLE WHEN profit_margin >= 0.40 THEN 1.0::DOUBLE ELSE {half_up('profit_margin / 0.40', 4)} END AS profit_score FROM priced)))"""

OFFERS = (fx.PRODUCT, fx.TIER, fx.OFFER, PICK, STEP, PRICED, RANKED)

FEATURES = f"""feat AS (
  SELECT asin, count(*) AS n_offers, sum(round(repeat_buyer_rate::VARCHAR::DECIMAL(38,18), 6)::DECIMAL(38,6))::DOUBLE / count(repeat_buyer_rate) AS avg_repeat, min(moq) AS min_moq, min(delivery_days) AS min_days,
         min(base_price_cny) AS min_price, sum(round(match_quality_score::VARCHAR::DECIMAL(38,18), 6)::DECIMAL(38,6))::DOUBLE / count(match_quality_score) AS avg_match, coalesce(bool_or(fba_ready), false) AS any_fba,
         sum((CASE WHEN is_factory THEN 1.0 WHEN NOT is_factory THEN 0.45 END)::DECIMAL(38,6))::DOUBLE / nullif(count(is_factory), 0) AS factory_score,
         sum(monthly_sales::DECIMAL(38,6))::DOUBLE / count(monthly_sales) AS avg_sales
  FROM offer WHERE source <> 'mock' AND base_price_cny > 0 AND moq > 0 GROUP BY asin)"""

CL = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {}))".format

DIMS = f"""dims AS (
  SELECT *, CASE WHEN profit_margin <= 0.10 THEN 0.0 WHEN profit_margin >= 0.50 THEN 1.0 ELSE 1.0 / (1.0 + exp(-(ln(19.0::DOUBLE) / (0.50 - 0.30)) * (profit_margin - 0.30))) END AS profit_score_d,
         CASE WHEN price < 15 THEN least(dem, 0.5) ELSE dem END AS demand_score,
         CASE WHEN top10_revenue_share > 0.6 THEN comp * 0.5 ELSE comp END AS competition_score,
         {CL('sup + CASE WHEN any_fba THEN 0.08::DOUBLE ELSE 0.0 END')} AS supply_score,
         CASE WHEN weight_kg IS NOT NULL THEN {CL("0.40::DOUBLE * CASE WHEN length_cm * width_cm * height_cm / 6000.0::DOUBLE / weight_kg <= 1.2 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 1.2::DOUBLE / (length_cm * width_cm * height_cm / 6000.0::DOUBLE / weight_kg)) END + 0.35::DOUBLE * " + CL('1.0 - weight_kg / 2.0::DOUBLE') + " + 0.25::DOUBLE * " + CL('1.0 - greatest(length_cm, width_cm, height_cm) / 45.0::DOUBLE'))} END AS logistics_score,
         (CASE WHEN category LIKE '%Health & Personal Care%' THEN 0.7::DOUBLE ELSE 1.0 END) * (CASE WHEN season_cv > 0.4 THEN 0.7::DOUBLE ELSE 1.0 END) AS risk_score
  FROM (SELECT *,
      0.30::DOUBLE * (CASE WHEN opportunity_score > 0.05 THEN 1.0 ELSE 0.0 END)::DOUBLE + 0.20::DOUBLE * {CL('est_daily_sales / 10.0::DOUBLE')} + 0.15::DOUBLE * {CL('search_volume_monthly / 2000.0::DOUBLE')}
        + 0.10::DOUBLE * (0.5::DOUBLE * {CL('1.0 - ln(bsr_rank::DOUBLE) / ln(50000.0::DOUBLE)')} + 0.5::DOUBLE * {CL('est_monthly_sales / 300.0::DOUBLE')}) AS dem,
      {CL('1.0 - (competing_listings - 20.0::DOUBLE) / 180.0::DOUBLE')} AS comp,
      0.20::DOUBLE * {CL('n_offers / 3.0::DOUBLE')} + 0.18::DOUBLE * coalesce(avg_repeat, 0.0) + 0.12::DOUBLE * (CASE WHEN min_moq <= 100 THEN 1.0::DOUBLE ELSE {CL('100.0::DOUBLE / min_moq')} END)
        + 0.12::DOUBLE * {CL('1.0 - min_days / 25.0::DOUBLE')} + 0.08::DOUBLE * (CASE WHEN min_moq * min_price <= 50000 THEN 1.0::DOUBLE ELSE 50000.0::DOUBLE / (min_moq * min_price) END)
        + 0.15::DOUBLE * {CL('avg_match / 0.6::DOUBLE')} + 0.10::DOUBLE * coalesce(factory_score, 0.65::DOUBLE) + 0.05::DOUBLE * {CL('avg_sales / 1000.0::DOUBLE')} AS sup
    FROM (SELECT asin, title, brand, category, price, bsr_rank, length_cm, width_cm, height_cm, weight_kg, net_profit, profit_margin, offer_id AS best_offer_id, top_match, top_candidate, supplier_count, best_moq
          FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY (net_profit IS NULL)::INT, offer_rank) AS nth, first(match_quality_score) OVER w AS top_match, first(rank_score) OVER w AS top_candidate,
                       count(*) OVER (PARTITION BY asin) AS supplier_count, min(moq) OVER (PARTITION BY asin) AS best_moq
                FROM ranked WINDOW w AS (PARTITION BY asin ORDER BY offer_rank)) WHERE nth = 1) b
    LEFT JOIN feat USING (asin) LEFT JOIN (SELECT 'B0' || lpad(p_partkey::VARCHAR, 8, '0') AS asin, * EXCLUDE (p_partkey) FROM market) USING (asin)))"""

SCORED = """scored AS (
  SELECT *, total_score IS NOT NULL AND rejection = '' AS passed
  FROM (SELECT *, CASE WHEN total_score IS NULL THEN CASE WHEN weight_kg IS NULL THEN 'missing_logistics_dimensions' WHEN competition_score IS NULL THEN 'missing_market_evidence' WHEN supply_score IS NULL THEN 'supply' END
      ELSE concat_ws(',', CASE WHEN profit_margin < 0.20 THEN 'margin_too_low' END, CASE WHEN total_score < 50 THEN 'score_too_low' END, CASE WHEN best_moq > 500 THEN 'moq_exceeded' END,
        CASE WHEN price < 15 AND profit_margin < 0.30 THEN 'price_too_low' END, CASE WHEN est_monthly_sales < 200 THEN 'monthly_sales_too_low' END,
        CASE WHEN top_match < 0.45 THEN 'supplier_match_too_low' END, CASE WHEN top_candidate < 0.45 THEN 'supplier_candidate_too_low' END) END AS rejection
    FROM (SELECT *, (0.20::DOUBLE * profit_score_d + 0.25::DOUBLE * demand_score + 0.20::DOUBLE * competition_score + 0.15::DOUBLE * supply_score + 0.10::DOUBLE * logistics_score + 0.10::DOUBLE * risk_score) * 100.0 AS total_score FROM dims)))"""

PIPELINE = (*OFFERS, FEATURES, fx.MARKET, DIMS, SCORED)


def _market(spark: SparkSession, d: str) -> DataFrame:
    m = fx.market(spark, d)
    return m.withColumn("asin", F.concat(F.lit("B0"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))).drop("p_partkey")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.score_products(fx.products(spark, d), fx.offers(spark, d), _market(spark, d))


@query(
    "candidate_pipeline",
    fx.with_ctes(*PIPELINE) + "SELECT asin, best_offer_id, " + half_up("net_profit", 6) + " AS net_profit, " + half_up("profit_margin", 6) + " AS profit_margin, " + half_up("profit_score_d", 6) + " AS profit_score, " + half_up("demand_score", 6) + " AS demand_score, "
    "" + half_up("competition_score", 6) + " AS competition_score, " + half_up("supply_score", 6) + " AS supply_score, " + half_up("logistics_score", 6) + " AS logistics_score, " + half_up("risk_score", 6) + " AS risk_score, " + half_up("total_score", 4) + " AS total_score, passed, rejection AS rejection_reasons FROM scored",
)
def candidate_pipeline(spark: SparkSession, d: str) -> DataFrame:
    names = ["profit_score", "demand_score", "competition_score", "supply_score", "logistics_score", "risk_score"]
    return scored(spark, d).select(
        "asin", "best_offer_id", r6("net_profit").alias("net_profit"), r6("profit_margin").alias("profit_margin"), *[r6(n).alias(n) for n in names], r6("total_score", 4).alias("total_score"), "passed",
        F.array_join("rejection_reasons", ",").alias("rejection_reasons"),
    )


@query("continuous_scoring", fx.with_ctes(*PIPELINE) + "SELECT asin, best_offer_id, " + half_up("total_score", 4) + " AS total_score, passed FROM scored")
def continuous_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, the second of which comes again: old prices and half of the offers, then the right prices and the other offers."""
    products, offers, path = fx.products(spark, d), fx.offers(spark, d), work_dir(spark, "scores")
    with shuffles_removed(spark):  # the batches read one market table
        _market(spark, d).write.parquet(f"{path}/market")
    market = spark.read.parquet(f"{path}/market")
    corrected = F.col("p_partkey") % 3 == 0
    old = products.withColumns({"price": F.when(corrected, F.col("price") * 2).otherwise(F.col("price"))})
    even = F.col("source_pos") % 2 == 0
    batches = [(old, offers.filter(even)), (products.filter(corrected), offers.filter(~even))]
    for n in (0, 1, 1):
        scoring.score_batch(*batches[n], market, path, n, buckets=8)
    return scoring.current_scores(spark, path).select("asin", "best_offer_id", r6("total_score", 4).alias("total_score"), "passed")


@query("profit_breakdown", fx.with_ctes(*OFFERS) + "SELECT asin, offer_id, " + ", ".join(f"{half_up(c, 6)} AS {c}" for c in ("purchase_cost", "total_cost", "net_profit", "profit_margin")) + ", " + half_up("shipping_cost", 6) + " AS shipping_cost, fba_fee FROM priced WHERE total_cost IS NOT NULL")
def profit_breakdown(spark: SparkSession, d: str) -> DataFrame:
    p = pipeline.priced_offers(fx.products(spark, d), fx.offers(spark, d)).filter(F.size("missing_fields") == 0)
    return p.select("asin", "offer_id", *[r6(c).alias(c) for c in ("purchase_cost", "total_cost", "net_profit", "profit_margin", "shipping_cost")], "fba_fee")


@query("rank_offers_by_profit", fx.with_ctes(*OFFERS) + "SELECT asin, offer_id, rank_score, offer_rank FROM ranked WHERE offer_rank <= 5")
def rank_offers_by_profit(spark: SparkSession, d: str) -> DataFrame:
    p = pipeline.priced_offers(fx.products(spark, d), fx.offers(spark, d))
    return p.filter("offer_rank <= 5").select("asin", "offer_id", "rank_score", F.col("offer_rank").cast("long").alias("offer_rank"))


@query("best_profit", fx.with_ctes(*OFFERS) + "SELECT asin, arg_min(offer_id, offer_rank) AS offer_id, " + half_up("arg_min(net_profit, offer_rank)", 6) + " AS net_profit FROM ranked WHERE net_profit IS NOT NULL GROUP BY asin")
def best_profit(spark: SparkSession, d: str) -> DataFrame:
    p = windows.best_profit(pipeline.priced_offers(fx.products(spark, d), fx.offers(spark, d)), ["asin"])
    return p.select("asin", "offer_id", r6("net_profit").alias("net_profit"))


@query("rank_candidates", fx.with_ctes(*PIPELINE) + "SELECT asin, " + half_up("total_score", 4) + " AS total_score FROM scored WHERE passed ORDER BY scored.total_score DESC, top_candidate DESC, net_profit DESC, bsr_rank LIMIT 50")
def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.candidates(scored(spark, d), 50).select("asin", r6("total_score", 4).alias("total_score"))


@query("tier_price", fx.with_ctes(fx.TIER, PICK) + "SELECT p_partkey, offer_id, tier_price FROM pick")
def tier_price(spark: SparkSession, d: str) -> DataFrame:
    t = fx.offer_tiers(spark, d).withColumn("pos", F.col("price_cny"))
    picked = joins.tier_price_long(t, ["l_partkey", "l_suppkey"], 200.0)
    return picked.select(F.col("l_partkey").alias("p_partkey"), F.concat(F.lit("9"), F.lpad(F.col("l_suppkey").cast("string"), 8, "0")).alias("offer_id"), "tier_price")


@query("fee_tier", fx.with_ctes(fx.PRODUCT) + f"SELECT asin, CASE WHEN weight_kg IS NOT NULL THEN {_bands} END AS fee FROM product")
def fee_tier(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return fx.products(spark, d).select("asin", cost.fee_band(c("length_cm"), c("width_cm"), c("height_cm"), c("weight_kg")).alias("fee"))


@query("category_rate", fx.with_ctes(fx.PRODUCT) + f"SELECT asin, {_rate(COST.commission, COST.default_commission)} AS rate FROM product")
def category_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("category"), F.lit(v).alias("rate")) for k, v in COST.commission])
    rates = spark.range(1).select(F.inline(rows))
    return joins.keyed_rate(fx.products(spark, d), rates, "category", "rate", COST.default_commission).select("asin", "rate")


@query("product_offers", fx.with_ctes(fx.PRODUCT, fx.OFFER) + "SELECT p.asin, p.price, o.offer_id, o.moq FROM product p LEFT JOIN offer o ON o.asin = p.asin")
def product_offers(spark: SparkSession, d: str) -> DataFrame:
    return joins.product_offers(fx.products(spark, d).select("asin", "price"), fx.offers(spark, d)).select("asin", "price", "offer_id", "moq")


@query("supplier_scores", fx.with_ctes(fx.OFFER, STEP) + "SELECT asin, offer_id, quality_score, business_score, candidate_score FROM oscore")
def supplier_scores(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.offer_scores(fx.offers(spark, d)).select("asin", "offer_id", "quality_score", "business_score", "candidate_score")


@query("supply_features", fx.with_ctes(fx.OFFER, FEATURES) + "SELECT asin, n_offers, " + half_up("avg_repeat", 6) + " AS avg_repeat, min_moq, min_days, min_price, " + half_up("avg_match", 6) + " AS avg_match, any_fba, " + half_up("factory_score", 6) + " AS factory_score, avg_sales FROM feat")
def supply_features(spark: SparkSession, d: str) -> DataFrame:
    f = aggregates.supply_features(fx.offers(spark, d)).filter("n_offers > 0")
    return f.select("asin", "n_offers", r6("avg_repeat").alias("avg_repeat"), "min_moq", "min_days", "min_price", r6("avg_match").alias("avg_match"), "any_fba", r6("factory_score").alias("factory_score"), "avg_sales")


@query("overseas_warehouse_cost", fx.with_ctes(fx.PRODUCT) + "SELECT asin, round(length_cm * width_cm * height_cm / 1000000.0::DOUBLE * (p_partkey % 120) * (CASE WHEN p_partkey % 120 <= 30 THEN 0.0 WHEN p_partkey % 120 <= 90 THEN 0.5 ELSE 0.9 END)::DOUBLE + (CASE WHEN weight_kg <= 1 THEN 4.5 WHEN weight_kg <= 2 THEN 6.5 ELSE 9.5 END)::DOUBLE * 1.08::DOUBLE, 6) AS fee FROM product WHERE weight_kg IS NOT NULL")
def overseas_warehouse_cost(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    fee = cost.warehouse_cost(c("length_cm") * c("width_cm") * c("height_cm") / F.lit(1000000.0), c("p_partkey") % 120, c("weight_kg"), ((1, 4.5), (2, 6.5), (30, 9.5)), ((30, 0.0), (90, 0.5), (365, 0.9)), 0.08)
    return fx.products(spark, d).filter("weight_kg is not null").select("asin", r6(fee).alias("fee"))


# --- seller research ---------------------------------------------------------------------------

SELLERS = """sel AS (
  SELECT niche, seller, arg_max(c, (coalesce(monthly_revenue, '-infinity'::DOUBLE), coalesce(monthly_sales, '-infinity'::DOUBLE), -source_pos)) AS rep,
         arg_min(seller_product_count, source_pos) FILTER (WHERE seller_product_count IS NOT NULL) AS reported, count(*) AS sample_count,
         sum(monthly_sales::DECIMAL(38,6))::DOUBLE AS total_monthly_sales, sum(monthly_revenue::DECIMAL(38,6))::DOUBLE AS total_monthly_revenue, list_sort(list(DISTINCT brand)) AS brands
  FROM competitor c GROUP BY niche, seller)"""
SHARES = "shares AS (SELECT niche, lower(brand) AS brand_key, count(*) AS n, sum(count(*)) OVER (PARTITION BY niche) AS samples FROM competitor GROUP BY niche, lower(brand))"

_c4 = lambda x: f"round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x})), 4)"
SHORTLIST = f"""short AS (
  SELECT niche, seller, asin, excluded, product_count, launch_months, monthly_sales,
         CASE WHEN excluded THEN 'excluded' WHEN product_count <= 15 AND monthly_revenue >= 5000 AND monthly_sales >= 150 THEN 'low_competition_efficient'
              WHEN launch_months <= 12 AND review_count <= 300 AND monthly_sales >= 100 THEN 'new_rising'
              WHEN rating >= 3.5 AND rating <= 4.3 AND monthly_sales >= 120 AND review_count <= 1500 THEN 'differentiation_opportunity' ELSE 'stable_niche' END AS fit_category,
         CASE WHEN excluded THEN 0.0 ELSE round((0.30::DOUBLE * demand + 0.30::DOUBLE * low + 0.20::DOUBLE * fresh + 0.20::DOUBLE * room) * 100, 1) END AS fit_score, reasons
  FROM (SELECT *, reasons <> '' AS excluded, {_c4('monthly_sales / 500.0::DOUBLE')} AS demand,
          round(({_c4('(3000.0::DOUBLE - review_count) / 2800.0::DOUBLE')} + {_c4('(60.0::DOUBLE - product_count) / 50.0::DOUBLE')}) / 2, 4) AS low, {_c4('(36.0::DOUBLE - launch_months) / 30.0::DOUBLE')} AS fresh,
          CASE WHEN rating >= 3.8 AND rating <= 4.3 THEN 1.0 WHEN rating < 3.8 THEN {_c4('(rating - 3.0::DOUBLE) / (3.8::DOUBLE - 3.0::DOUBLE)')} ELSE {_c4('(5.0::DOUBLE - rating) / (5.0::DOUBLE - 4.3::DOUBLE)')} END AS room
    FROM (SELECT *, concat_ws(',', CASE WHEN monthly_sales IS NULL THEN 'missing_monthly_sales' END, CASE WHEN price IS NULL THEN 'missing_price' END, CASE WHEN review_count >= 5000 THEN 'head_seller_reviews' END,
                 CASE WHEN monthly_revenue >= 200000 THEN 'head_seller_revenue' END, CASE WHEN samples >= 8 AND share >= 0.35 THEN 'brand_monopoly' END) AS reasons
      FROM (SELECT s.niche, s.seller, rep.asin, rep.brand, rep.price, rep.rating, rep.review_count, rep.monthly_sales, rep.monthly_revenue, coalesce(reported, sample_count) AS product_count,
                   round(greatest(0, DATE '2025-01-01' - rep.launch_date) / 30.4375::DOUBLE, 2) AS launch_months, n / samples AS share, samples
            FROM sel s LEFT JOIN shares b ON b.niche = s.niche AND b.brand_key = lower(rep.brand)))))"""


@query("seller_shortlist", fx.with_ctes(fx.COMPETITOR, SELLERS, SHARES, SHORTLIST) + "SELECT niche, seller, asin, product_count, launch_months, fit_category, fit_score, reasons AS exclusion_reasons, row_number() OVER (PARTITION BY niche ORDER BY excluded, CASE WHEN NOT excluded THEN fit_score END DESC NULLS LAST, coalesce(monthly_sales, 0) DESC, seller) - 1 AS rank_index FROM short")
def seller_shortlist(spark: SparkSession, d: str) -> DataFrame:
    s = research.shortlist(fx.competitors(spark, d), "2025-01-01")
    return s.select("niche", "seller", "asin", "product_count", "launch_months", "fit_category", "fit_score", F.array_join("exclusion_reasons", ",").alias("exclusion_reasons"), F.col("rank_index").cast("long").alias("rank_index"))


@query("shortlist_files", fx.with_ctes(fx.COMPETITOR, SELLERS, SHARES, SHORTLIST) + "SELECT excluded, fit_category, count(*) AS n, count(DISTINCT seller) AS n_sellers, (SELECT count(*) FROM short s WHERE s.fit_category IS NOT DISTINCT FROM t.fit_category) AS n_in_summary FROM short t GROUP BY excluded, fit_category")
def shortlist_files(spark: SparkSession, d: str) -> DataFrame:
    """The shortlist written in two partitions with its summary beside it, and both read back."""
    path = work_dir(spark, "shortlist")
    writers.write_seller_shortlist(research.shortlist(fx.competitors(spark, d), "2025-01-01"), path)
    sellers = spark.read.parquet(f"{path}/sellers").withColumn("excluded", F.col("excluded").cast("boolean")).groupBy("excluded", "fit_category").agg(F.count("*").alias("n"), F.count_distinct("seller").alias("n_sellers"))
    summary = spark.read.parquet(f"{path}/summary").select(F.col("fit_category").alias("kind"), F.col("n").alias("n_in_summary"))
    return sellers.join(summary, F.col("fit_category").eqNullSafe(F.col("kind")), "left").drop("kind")


@query("seller_aggregate", fx.with_ctes(fx.COMPETITOR, SELLERS) + "SELECT niche, seller, rep.asin AS asin, reported AS reported_product_count, sample_count AS sample_product_count, total_monthly_sales, total_monthly_revenue, array_to_string(brands, ',') AS brands FROM sel")
def seller_aggregate(spark: SparkSession, d: str) -> DataFrame:
    s = aggregates.seller_aggregate(fx.competitors(spark, d), niche=["niche"])
    return s.select("niche", "seller", "rep.asin", "reported_product_count", "sample_product_count", "total_monthly_sales", "total_monthly_revenue", F.array_join("brands", ",").alias("brands"))


@query("brand_shares", fx.with_ctes(fx.COMPETITOR, SHARES) + "SELECT niche, brand_key, n, samples::BIGINT AS samples, n / samples AS share FROM shares")
def brand_shares(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.brand_shares(fx.competitors(spark, d), ["niche"]).select("niche", "brand_key", "n", "samples", "share")


@query("category_counts", fx.with_ctes(fx.COMPETITOR, SELLERS, SHARES, SHORTLIST) + "SELECT niche, fit_category, count(*) AS n FROM short GROUP BY ALL")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.histogram(research.shortlist(fx.competitors(spark, d), "2025-01-01"), "fit_category", ["niche"])


@query("competitor_market_stats", fx.with_ctes(fx.COMPETITOR) + f"""SELECT asin, {half_up('sum(price::DECIMAL(38,6))::DOUBLE / count(price)', 2)} AS avg_price, {half_up('sum(review_count::DECIMAL(38,6))::DOUBLE / count(review_count)', 0)} AS avg_reviews, count(*) AS n_competitors,
 round(max(monthly_revenue) FILTER (WHERE nth = 1) / sum(monthly_revenue::DECIMAL(38,6))::DOUBLE, 9) AS head_revenue_share, round(max(monthly_revenue) / sum(monthly_revenue::DECIMAL(38,6))::DOUBLE, 9) AS top_revenue_share
 FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY seller) AS nth FROM competitor) WHERE nth <= 10 GROUP BY asin""")
def competitor_market_stats(spark: SparkSession, d: str) -> DataFrame:
    s = aggregates.competitor_market_stats(fx.competitors(spark, d), ["asin"], pos="seller")
    return s.withColumns({c: r6(c, 9) for c in ("head_revenue_share", "top_revenue_share")})
