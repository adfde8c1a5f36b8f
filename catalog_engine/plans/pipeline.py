"""The candidate pipeline: offers priced and ranked per product, six scores, filters and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cost, scores, supplier
from ..operators.aggregates import supply_columns
from ..operators.windows import rank_candidates, rank_offers
from ..rules import COST, SCORE, CostRules, ScoreRules


def offer_scores(offers: DataFrame) -> DataFrame:
    """Adds quality, business and candidate scores to offers."""
    c = F.col
    out = offers.withColumns(
        {"quality_score": supplier.quality_score(c("monthly_sales"), c("repeat_buyer_rate"), c("is_factory"), c("delivery_days")), "business_score": supplier.business_score(c("moq"), c("base_price_cny"))}
    )
    return out.withColumn("candidate_score", supplier.candidate_score(c("match_quality_score"), c("quality_score"), c("business_score")))


def priced_offers(products: DataFrame, offers: DataFrame, r: CostRules = COST) -> DataFrame:
    """Each product-offer pair with its cost breakdown and rank; the pair's key is (asin, offer_id)."""
    own = ["asin", "title", "brand", "category", "price", "bsr_rank", "length_cm", "width_cm", "height_cm", "weight_kg"]
    pairs = products.select(*own).join(offer_scores(offers), "asin")
    pairs = cost.with_profit(pairs, r)
    pairs = pairs.withColumn("profit_score", cost.supplier_profit_score(F.col("profit_margin")))
    return rank_offers(pairs, ["asin"])


def score_products(products: DataFrame, offers: DataFrame, market: DataFrame, cost_rules: CostRules = COST, r: ScoreRules = SCORE) -> DataFrame:
    """One row per product that has offers: best offer's profit, six scores, total, passed and reasons."""
    # one grouping of the priced pairs gives the best offer, the top offer's scores and the supply features
    pairs = priced_offers(products, offers, cost_rules)
    nth = F.row_number().over(Window.partitionBy("asin", F.trim("offer_id")).orderBy("offer_rank"))
    pairs = pairs.withColumn("_first", nth == 1)
    kept = lambda c: F.when(F.col("_first"), c)
    own = ["title", "brand", "category", "price", "bsr_rank", "length_cm", "width_cm", "height_cm", "weight_kg", "net_profit", "profit_margin", "missing_fields"]
    best = F.min_by(F.struct(*own, F.col("offer_id").alias("best_offer_id")), kept(F.struct(F.col("net_profit").isNull(), "offer_rank")))
    out = pairs.groupBy("asin").agg(
        best.alias("_best"),
        F.min_by("match_quality_score", kept(F.col("offer_rank"))).alias("top_match"),
        F.min_by("rank_score", kept(F.col("offer_rank"))).alias("top_candidate"),
        F.count_if("_first").alias("supplier_count"),
        F.min(kept(F.col("moq"))).alias("best_moq"),
        *[v.alias(k) for k, v in supply_columns().items()],
    )
    out = out.select("asin", "_best.*", *[n for n in out.columns if n not in ("asin", "_best")]).join(market, "asin", "left")
    c = F.col
    dims = {
        "profit": scores.score_profit(c("profit_margin"), r),
        "demand": scores.score_demand(c("bsr_rank"), c("est_monthly_sales"), c("opportunity_score"), c("search_volume_monthly"), c("price"), daily_sales=c("est_daily_sales"), r=r),
        "competition": scores.score_competition(c("competing_listings"), c("top10_revenue_share"), r=r),
        "supply": scores.score_supply(r),
        "logistics": scores.score_logistics(c("weight_kg"), c("length_cm"), c("width_cm"), c("height_cm"), r=r),
        "risk": scores.score_risk(c("category"), c("brand"), c("title"), c("season_cv"), r),
    }
    out = out.withColumns({f"{k}_score": v for k, v in dims.items()})
    out = out.withColumn("total_score", scores.total_score({k: c(f"{k}_score") for k in dims}, r))
    reasons = scores.hard_filter_reasons(
        {
            "margin": c("profit_margin"), "total": c("total_score"), "moq": c("best_moq"), "suppliers": c("supplier_count"), "price": c("price"),
            "monthly_sales": c("est_monthly_sales"), "brand": c("brand"), "title": c("title"), "category": c("category"), "match": c("top_match"), "candidate": c("top_candidate"),
        },
        r,
    )
    stopped = F.concat(
        scores.cost_evidence_reasons(c("missing_fields")),
        F.when(F.size("missing_fields") == 0, scores.score_evidence_reasons(c("competition_score"), c("supply_score"), c("logistics_score"), F.coalesce("n_priced", F.lit(0)), F.coalesce("n_with_moq", F.lit(0)))).otherwise(F.array().cast("array<string>")),
    )
    scored = c("total_score").isNotNull()
    out = out.withColumns({"rejection_reasons": F.when(scored, reasons).otherwise(stopped)})
    return out.withColumn("passed", scored & (F.size("rejection_reasons") == 0))


def candidates(scored: DataFrame, top_n: int | None = None) -> DataFrame:
    """The ranked candidates of a run."""
    ranked = scored.withColumn("candidate_score", F.col("top_candidate")).withColumn("source_pos", F.col("bsr_rank"))
    return rank_candidates(ranked, top_n)
