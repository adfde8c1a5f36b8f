"""Rule sets as frozen dataclasses; operators take one and default to these.

Values that results depend on are stated once, here.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CostRules:
    """Cost model of a product bought wholesale and sold at retail (fixed values)."""

    cny_to_usd: float = 0.145
    exchange_loss: float = 0.01
    base_fee: float = 2.0
    per_kg: float = 2.8
    least_kg: float = 1.0
    volumetric_divisor: float = 6000.0
    cm_to_in: float = 0.393701
    kg_to_oz: float = 35.274
    #: (longest side in inches, weight in ounces, fee) of each size band in order; the last fee holds beyond.
    bands: tuple[tuple[float, float, float], ...] = ((15, 16, 3.43), (18, 320, 5.95), (60, 1120, 10.50), (108, 2400, 19.85))
    commission: tuple[tuple[str, float], ...] = (("Electronics", 0.08), ("Home & Kitchen", 0.15), ("Toys & Games", 0.15), ("Beauty & Personal Care", 0.15), ("Clothing", 0.17), ("Jewelry", 0.20), ("Books", 0.15))
    default_commission: float = 0.15
    returns: tuple[tuple[str, float], ...] = (("Clothing", 0.20), ("Shoes", 0.18), ("Electronics", 0.12), ("Home & Kitchen", 0.06), ("Toys & Games", 0.05))
    default_return: float = 0.06
    return_loss: float = 0.30
    acos: float = 0.25
    ad_share: float = 0.20
    batch_qty: int = 200


@dataclass(frozen=True)
class ScoreRules:
    """Curves of the six score dimensions and the hard filters (fixed values)."""

    weights: tuple[tuple[str, float], ...] = (("profit", 0.20), ("demand", 0.25), ("competition", 0.20), ("supply", 0.15), ("logistics", 0.10), ("risk", 0.10))
    profit_floor: float = 0.10
    profit_target: float = 0.30
    profit_ceiling: float = 0.50
    opportunity: float = 0.05
    daily_revenue: float = 50.0
    daily_sales: float = 10.0
    search_volume: float = 2000.0
    bsr_base: float = 50000.0
    monthly_sales: float = 300.0
    price_floor: float = 15.0
    trend_bonus: float = 0.10
    sellers_low: float = 20.0
    sellers_high: float = 200.0
    top4_share: float = 0.40
    top4_penalty: float = 0.7
    top10_share: float = 0.6
    top10_penalty: float = 0.5
    monopoly_penalty: float = 0.5
    low_review_count: int = 5
    low_review_bonus: float = 0.10
    min_suppliers: float = 3.0
    moq_ok: float = 100.0
    delivery_days: float = 25.0
    capital: float = 50000.0
    match_target: float = 0.6
    fba_bonus: float = 0.08
    volumetric_ratio: float = 1.2
    max_weight: float = 2.0
    max_side: float = 45.0
    blacklist_attrs: tuple[str, ...] = ("battery", "liquid", "fragile_high", "magnetic")
    brand_penalty: float = 0.5
    cert_penalty: float = 0.7
    restricted_penalty: float = 0.25
    season_penalty: float = 0.7
    season_cv: float = 0.4
    cert_categories: tuple[str, ...] = ("Toys & Games > Infant Toys", "Health & Personal Care", "Electronics > Car Electronics")
    restricted: tuple[str, ...] = ("pesticide", "insecticide", "ant killer", "ant bait", "bait station", "liquid bait", "poison", "杀虫", "灭蚁", "蚂蚁药", "农药", "药剂")
    brands: tuple[str, ...] = ()
    min_margin: float = 0.20
    min_total: float = 50.0
    max_moq: float = 500.0
    min_supplier_count: int = 1
    min_price: float = 15.0
    price_margin: float = 0.30
    min_monthly_sales: float = 200.0
    min_match: float = 0.45
    min_spec: float = 0.45
    max_conflicts: int = 0
    min_candidate: float = 0.45


@dataclass(frozen=True)
class SellerRules:
    """Exclusions, categories and fit curves of the seller shortlist (fixed values)."""

    head_reviews: float = 5000
    head_revenue: float = 200000
    brand_share: float = 0.35
    brand_samples: int = 8
    efficient: tuple[float, float, float] = (15, 5000, 150)  # products, revenue, sales
    rising: tuple[float, float, float] = (12, 300, 100)  # months, reviews, sales
    differing: tuple[float, float, float, float] = (3.5, 4.3, 120, 1500)  # rating from, to, sales, reviews
    stable_sales: float = 80
    demand_target: float = 500
    reviews: tuple[float, float] = (200, 3000)
    products: tuple[float, float] = (10, 60)
    months: tuple[float, float] = (6, 36)
    ideal_rating: tuple[float, float] = (3.8, 4.3)
    weights: tuple[float, float, float, float] = (0.30, 0.30, 0.20, 0.20)
    representative_by: str = "monthly_revenue"


COST, SCORE, SELLER = CostRules(), ScoreRules(), SellerRules()

#: Seller rules by outdoor category (fixed values).
SELLER_PROFILES = {
    "outdoor_storage": replace(SELLER, head_reviews=4000, head_revenue=300000, efficient=(20, 8000, 60), rising=(15, 250, 40), differing=(3.5, 4.3, 40, 1500), stable_sales=25, demand_target=250),
    "patio_heater": replace(SELLER, head_reviews=3000, head_revenue=250000, efficient=(15, 8000, 40), rising=(15, 200, 30), differing=(3.5, 4.3, 30, 1200), stable_sales=20, demand_target=180),
    "patio_furniture_sets": replace(SELLER, head_reviews=3000, head_revenue=400000, efficient=(15, 15000, 25), rising=(15, 200, 20), differing=(3.5, 4.3, 20, 1200), stable_sales=12, demand_target=120),
    "patio_umbrellas_shade": replace(SELLER, head_reviews=4000, head_revenue=300000, efficient=(18, 8000, 60), rising=(15, 250, 40), differing=(3.5, 4.3, 40, 1500), stable_sales=25, demand_target=250),
}
#: Logistics limits by outdoor category: volumetric ratio, kg, cm (fixed values).
LOGISTICS_PROFILES = {"outdoor_storage": (8.0, 100.0, 300.0), "patio_heater": (5.0, 80.0, 300.0), "patio_furniture_sets": (10.0, 250.0, 400.0), "patio_umbrellas_shade": (8.0, 50.0, 400.0)}
