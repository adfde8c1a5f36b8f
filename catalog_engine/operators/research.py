"""Seller shortlist: exclusions, category and fit of each seller of a niche."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import SELLER, SellerRules
from .aggregates import brand_shares, seller_aggregate
from .windows import shortlist_order


def clamp4(c: Column) -> Column:
    return F.when(c.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4))


def ramp_up(v: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high; unknown is neutral."""
    return F.when(v.isNull(), F.lit(0.5)).otherwise(clamp4((v - F.lit(float(low))) / F.lit(float(high - low))))


def ramp_down(v: Column, good: float, poor: float) -> Column:
    return F.when(v.isNull(), F.lit(0.5)).otherwise(clamp4((F.lit(float(poor)) - v) / F.lit(float(poor - good))))


def rating_room(v: Column, low: float, high: float) -> Column:
    """1 inside the ideal range, falling to 0 at 3.0 and 5.0."""
    below, above = (v - F.lit(3.0)) / F.lit(max(low - 3.0, 1e-6)), (F.lit(5.0) - v) / F.lit(max(5.0 - high, 1e-6))
    return F.when(v.isNull(), F.lit(0.5)).when((v >= low) & (v <= high), F.lit(1.0)).when(v < low, clamp4(below)).otherwise(clamp4(above))


def launch_months(launch: Column, as_of: Column) -> Column:
    return F.round(F.greatest(F.lit(0), F.datediff(as_of, launch)) / F.lit(30.4375), 2)


def fit_factors(r: SellerRules = SELLER) -> dict[str, Column]:
    low = F.round((ramp_down(F.col("review_count"), *r.reviews) + ramp_down(F.col("product_count"), *r.products)) / 2, 4)
    return {"demand_proven": ramp_up(F.col("monthly_sales"), 0.0, r.demand_target), "low_competition": low, "freshness": ramp_down(F.col("launch_months"), *r.months), "differentiation_room": rating_room(F.col("rating"), *r.ideal_rating)}


def fit_score(factors: dict[str, Column], r: SellerRules = SELLER) -> Column:
    out = F.lit(0.0)
    for w, c in zip(r.weights, factors.values()):
        out = out + F.lit(w) * c
    return F.round(out * 100, 1)


def exclusion_reasons(r: SellerRules = SELLER) -> Column:
    """All reasons in fixed order over the seller's representative row and its brand's share."""
    c = F.col
    tests = [
        (c("monthly_sales").isNull(), "missing_monthly_sales"),
        (c("price").isNull(), "missing_price"),
        (c("review_count") >= r.head_reviews, "head_seller_reviews"),
        (c("monthly_revenue") >= r.head_revenue, "head_seller_revenue"),
        ((c("brand_samples") >= r.brand_samples) & (c("brand_share") >= r.brand_share), "brand_monopoly"),
    ]
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests]))


def fit_category(r: SellerRules = SELLER) -> Column:
    """First kind that fits, in order; otherwise a stable niche."""
    c = F.col
    return (
        F.when((c("product_count") <= r.efficient[0]) & (c("monthly_revenue") >= r.efficient[1]) & (c("monthly_sales") >= r.efficient[2]), "low_competition_efficient")
        .when((c("launch_months") <= r.rising[0]) & (c("review_count") <= r.rising[1]) & (c("monthly_sales") >= r.rising[2]), "new_rising")
        .when((c("rating") >= r.differing[0]) & (c("rating") <= r.differing[1]) & (c("monthly_sales") >= r.differing[2]) & (c("review_count") <= r.differing[3]), "differentiation_opportunity")
        .otherwise("stable_niche")
    )


def shortlist(rows: DataFrame, as_of: str, niche: list[str] | None = None, r: SellerRules = SELLER) -> DataFrame:
    """One ranked row per seller of each niche, eligible ones first. Two shuffles: by seller, and by niche for shares and ranks."""
    niche = niche or ["niche"]
    sellers = seller_aggregate(rows, r.representative_by, niche)
    sellers = sellers.select(*niche, "seller", "rep.*", "reported_product_count", "sample_product_count", "total_monthly_sales", "total_monthly_revenue", "brands")
    sellers = sellers.withColumns(
        {
            "product_count": F.coalesce("reported_product_count", "sample_product_count"),
            "product_count_source": F.when(F.col("reported_product_count").isNotNull(), "reported").otherwise("sample"),
            "launch_months": launch_months(F.col("launch_date"), F.lit(as_of).cast("date")),
            "brand_key": F.lower(F.trim("brand")),
        }
    )
    shares = brand_shares(rows, niche).select(*niche, "brand_key", F.col("share").alias("brand_share"), F.col("samples").alias("brand_samples"))
    out = sellers.join(shares, [*niche, "brand_key"], "left")
    factors = fit_factors(r)
    out = out.withColumn("exclusion_reasons", exclusion_reasons(r)).withColumn("excluded", F.size("exclusion_reasons") > 0)
    keep = lambda c: F.when(~F.col("excluded"), c)
    out = out.withColumns({"fit_category": F.when(F.col("excluded"), "excluded").otherwise(fit_category(r)), "fit_score": F.coalesce(keep(fit_score(factors, r)), F.lit(0.0)), **{k: keep(v) for k, v in factors.items()}})
    return shortlist_order(out, niche)
