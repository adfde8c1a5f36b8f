"""The six score dimensions, hard filters and their reasons as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import SCORE, ScoreRules


def clamp(c: Column) -> Column:
    """The value held to [0, 1]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def ratio(value: Column, target: float) -> Column:
    """Missing counts as nothing shown."""
    return clamp(F.coalesce(value.cast("double"), F.lit(0.0)) / F.lit(target))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any non-blank word occurs in the text, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        if w.strip():
            out = out | F.contains(low, F.lit(w.lower()))
    return out


def brand_listed(brand: Column, brands: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(F.trim(brand)).isin([b.lower() for b in brands]) if brands else F.lit(False), F.lit(False))


def score_profit(margin: Column, r: ScoreRules = SCORE) -> Column:
    k = math.log(19) / (r.profit_ceiling - r.profit_target)
    curve = clamp(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-k) * (margin - F.lit(r.profit_target)))))
    return F.when(margin <= r.profit_floor, F.lit(0.0)).when(margin >= r.profit_ceiling, F.lit(1.0)).otherwise(curve)


def score_demand(
    bsr_rank: Column,
    monthly_sales: Column,
    opportunity: Column,
    search_volume: Column,
    price: Column,
    daily_sales: Column | None = None,
    daily_revenue: Column | None = None,
    trends_up: Column | None = None,
    r: ScoreRules = SCORE,
) -> Column:
    """Evidence that is not given counts as none; an unknown rank is neutral; cheap products are capped."""
    none = F.lit(None).cast("double")
    opp = F.when(F.coalesce(opportunity, F.lit(0.0)) > r.opportunity, F.lit(1.0)).otherwise(F.lit(0.0))
    rank = F.when(bsr_rank > 0, clamp(F.lit(1.0) - F.log(bsr_rank.cast("double")) / F.lit(math.log(r.bsr_base)))).otherwise(F.lit(0.5))
    base = (
        F.lit(0.30) * opp
        + F.lit(0.25) * ratio(none if daily_revenue is None else daily_revenue, r.daily_revenue)
        + F.lit(0.20) * ratio(none if daily_sales is None else daily_sales, r.daily_sales)
        + F.lit(0.15) * ratio(search_volume, r.search_volume)
        + F.lit(0.10) * (F.lit(0.5) * rank + F.lit(0.5) * ratio(monthly_sales, r.monthly_sales))
    )
    base = F.when((price != 0) & (price < r.price_floor), F.least(base, F.lit(0.5))).otherwise(base)
    bonus = F.lit(0.0) if trends_up is None else F.when(trends_up, F.lit(r.trend_bonus)).otherwise(F.lit(0.0))
    return clamp(base + bonus)


def score_competition(
    listings: Column, top10_share: Column, top4_share: Column | None = None, monopoly: Column | None = None, low_review_count: Column | None = None, r: ScoreRules = SCORE
) -> Column:
    """Null (no evidence) if both listings and top-10 share are missing."""
    s = clamp(F.lit(1.0) - (F.coalesce(listings.cast("double"), F.lit(0.0)) - F.lit(r.sellers_low)) / F.lit(r.sellers_high - r.sellers_low))
    if top4_share is not None:
        s = F.when(top4_share > r.top4_share, s * r.top4_penalty).otherwise(s)
    s = F.when(top10_share > r.top10_share, s * r.top10_penalty).otherwise(s)
    if monopoly is not None:
        s = F.when(monopoly, s * r.monopoly_penalty).otherwise(s)
    if low_review_count is not None:
        s = F.when(low_review_count >= r.low_review_count, F.least(F.lit(1.0), s + r.low_review_bonus)).otherwise(s)
    return F.when(listings.isNotNull() | top10_share.isNotNull(), clamp(s))


def score_supply(r: ScoreRules = SCORE) -> Column:
    """Over the columns of operators.aggregates.supply_features; null without an offer that has price and MOQ."""
    col = F.col
    neutral = lambda cond, value, otherwise: F.when(cond, value).otherwise(F.lit(otherwise))
    moq = F.when(col("min_moq") <= r.moq_ok, F.lit(1.0)).otherwise(clamp(F.lit(r.moq_ok) / col("min_moq")))
    first = col("min_moq") * col("min_price")
    base = (
        F.lit(0.20) * clamp(col("n_offers") / F.lit(r.min_suppliers))
        + F.lit(0.18) * F.coalesce(col("avg_repeat"), F.lit(0.0))
        + F.lit(0.12) * moq
        + F.lit(0.12) * neutral(col("min_days").isNotNull(), clamp(F.lit(1.0) - col("min_days") / F.lit(r.delivery_days)), 0.5)
        + F.lit(0.08) * neutral(first.isNotNull(), F.when(first <= r.capital, F.lit(1.0)).otherwise(clamp(F.lit(r.capital) / first)), 0.5)
        + F.lit(0.15) * neutral(col("avg_match").isNotNull(), clamp(col("avg_match") / F.lit(r.match_target)), 0.5)
        + F.lit(0.10) * F.coalesce(col("factory_score"), F.lit(0.65))
        + F.lit(0.05) * neutral(col("avg_sales").isNotNull(), clamp(col("avg_sales") / F.lit(1000.0)), 0.5)
    )
    bonus = F.when(col("any_fba"), F.lit(r.fba_bonus)).otherwise(F.lit(0.0))
    return F.when(col("n_offers") > 0, clamp(base + bonus))


def score_logistics(weight: Column, length: Column, width: Column, height: Column, attrs: Column | None = None, ratio_max: float | None = None, kg_max: float | None = None, side_max: float | None = None, r: ScoreRules = SCORE) -> Column:
    """Null if a measure is missing; a blacklisted attribute gives 0; zero weight counts as half a kilo."""
    w = F.when(weight == 0, F.lit(0.5)).otherwise(weight)
    side = F.greatest(length, width, height)
    side = F.when(side == 0, F.lit(20.0)).otherwise(side)
    most = F.lit(ratio_max or r.volumetric_ratio)
    by_volume = length * width * height / F.lit(6000.0) / w
    shape = F.when((length != 0) & (width != 0) & (height != 0), F.when(by_volume <= most, F.lit(1.0)).otherwise(clamp(most / by_volume))).otherwise(F.lit(0.8))
    score = clamp(F.lit(0.40) * shape + F.lit(0.35) * clamp(F.lit(1.0) - w / F.lit(kg_max or r.max_weight)) + F.lit(0.25) * clamp(F.lit(1.0) - side / F.lit(side_max or r.max_side)))
    if attrs is not None:
        listed = F.arrays_overlap(F.transform(attrs, lambda a: F.lower(a)), F.array(*[F.lit(a) for a in r.blacklist_attrs]))
        score = F.when(F.coalesce(listed, F.lit(False)), F.lit(0.0)).otherwise(score)
    known = weight.isNotNull() & length.isNotNull() & width.isNotNull() & height.isNotNull()
    return F.when(known, score)


def season_cv(seasonality: Column) -> Column:
    """Sample deviation over mean of a map's values; null under three values or without a positive mean."""
    values = F.filter(F.map_values(seasonality), lambda v: v.isNotNull())
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    square = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return F.when((n >= 3) & (mean > 0), F.sqrt(square / (n - 1)) / mean)


def score_risk(category: Column, brand: Column, title: Column, cv: Column | None = None, r: ScoreRules = SCORE) -> Column:
    named = F.trim(F.coalesce(category, F.lit("")))
    cert = contains_any(F.lit(None).cast("string"), ())
    for c in r.cert_categories:
        cert = cert | F.contains(named, F.lit(c))
    s = F.lit(1.0)
    s = F.when(brand_listed(brand, r.brands), s * r.brand_penalty).otherwise(s)
    s = F.when(cert, s * r.cert_penalty).otherwise(s)
    s = F.when(contains_any(F.concat_ws(" ", title, category), r.restricted), s * r.restricted_penalty).otherwise(s)
    if cv is not None:
        s = F.when(cv > r.season_cv, s * r.season_penalty).otherwise(s)
    return clamp(s)


def total_score(scores: dict[str, Column], r: ScoreRules = SCORE) -> Column:
    """Weighted sum of the dimensions, times 100, unrounded; null if a dimension has no evidence."""
    out = None
    for name, weight in r.weights:
        part = F.lit(weight) * scores[name]
        out = part if out is None else out + part
    return out * F.lit(100.0)


def opportunity_estimate(volume: Column, rate: Column, difficulty: Column) -> Column:
    """Estimated keyword opportunity; a difficulty above 1 is a competitor count."""
    ease = F.when(difficulty > 1, F.lit(1.0) - F.least(difficulty / F.lit(100000.0), F.lit(1.0))).otherwise(difficulty)
    return F.lit(0.45) * F.least(volume / F.lit(10000.0), F.lit(1.0)) + F.lit(0.30) * F.coalesce(F.least(rate, F.lit(1.0)), F.lit(0.5)) + F.lit(0.25) * F.coalesce(ease, F.lit(0.5))


#: Order in which reasons are given.
REASONS = (
    "margin_too_low score_too_low moq_exceeded no_supplier price_too_low monthly_sales_too_low brand_excluded restricted_product "
    "supplier_match_too_low supplier_spec_too_low supplier_spec_conflict supplier_candidate_too_low target_supplier_contract_not_passed"
).split()


def hard_filter_reasons(c: dict[str, Column], r: ScoreRules = SCORE) -> Column:
    """All failing reasons in fixed order. Inputs that are not given, or null, skip their test.

    Keys: margin, total, moq, suppliers, price, monthly_sales, brand, title, category,
    match, spec, conflicts (array), candidate, contract_category, contract_decision.
    """
    none = F.lit(None)
    get = lambda k, t="double": c.get(k, none.cast(t))
    text = F.concat_ws(" ", get("title", "string"), get("category", "string"))
    tests = [
        get("margin") < r.min_margin,
        get("total") < r.min_total,
        get("moq") > r.max_moq,
        get("suppliers") < r.min_supplier_count,
        (get("price") < r.min_price) & (get("margin") < r.price_margin),
        get("monthly_sales") < r.min_monthly_sales,
        brand_listed(get("brand", "string"), r.brands),
        contains_any(text, r.restricted),
        get("match") < r.min_match,
        get("spec") < r.min_spec,
        F.size(get("conflicts", "array<string>")) > r.max_conflicts,
        get("candidate") < r.min_candidate,
        get("contract_category", "string").isNotNull() & ~F.coalesce(get("contract_decision", "string") == "keep", F.lit(False)),
    ]
    return F.array_compact(F.array(*[F.when(t, F.lit(code)) for code, t in zip(REASONS, tests)]))


def cost_evidence_reasons(missing: Column) -> Column:
    """Rejection codes of the fields that stopped the cost model; empty if none."""
    has = lambda *names: F.arrays_overlap(missing, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(has("purchase_price"), F.array(F.lit("missing_purchase_price")))
        .when(has("weight_kg", "length_cm", "width_cm", "height_cm"), F.array(F.lit("missing_logistics_dimensions")))
        .otherwise(F.transform(missing, lambda m: F.concat(F.lit("missing_"), m)))
    )


def score_evidence_reasons(competition: Column, supply: Column, logistics: Column, priced: Column, with_moq: Column) -> Column:
    """Rejection codes of the first score dimension without evidence; priced and with_moq count offers that have each."""
    gaps = F.array_compact(F.array(F.when(priced == 0, F.lit("missing_purchase_price")), F.when(with_moq == 0, F.lit("missing_moq"))))
    both = F.array(F.lit("missing_purchase_price"), F.lit("missing_moq"))
    return (
        F.when(competition.isNull(), F.array(F.lit("missing_market_evidence")))
        .when(supply.isNull(), F.when(F.size(gaps) == 0, both).otherwise(gaps))
        .when(logistics.isNull(), F.array(F.lit("missing_logistics_dimensions")))
        .otherwise(F.array().cast("array<string>"))
    )
