"""Supplier quality, business and candidate scores (fixed step tables), and which offers count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import clamp


def steps(value: Column, table: tuple[tuple[float, float], ...], otherwise: float, up: bool) -> Column:
    """First step that the value reaches (up: >=, else <=); null stays null."""
    out = F.lit(otherwise)
    for limit, score in reversed(table):
        out = F.when(value >= limit if up else value <= limit, F.lit(score)).otherwise(out)
    return F.when(value.isNotNull(), out)


def sales_step(v: Column) -> Column:
    return steps(v, ((5000, 1.0), (1000, 0.85), (300, 0.7), (50, 0.55)), 0.35, True)


def delivery_step(v: Column) -> Column:
    return steps(v, ((7, 1.0), (15, 0.85), (30, 0.65)), 0.35, False)


def moq_step(v: Column) -> Column:
    return steps(v, ((50, 1.0), (100, 0.85), (300, 0.65), (500, 0.45)), 0.25, False)


def price_step(v: Column) -> Column:
    return steps(v, ((20, 1.0), (50, 0.8), (100, 0.6)), 0.4, False)


def repeat_rate(v: Column) -> Column:
    """A rate above 1 is a percentage."""
    return clamp(F.when(v > 1, v / 100).otherwise(v))


def weighted(parts: list[tuple[float, Column]]) -> Column:
    """Mean of the known parts by weight (4 decimals); null if none is known."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for w, c in parts:
        total = total + F.coalesce(F.lit(w) * c, F.lit(0.0))
        weight = weight + F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.when(weight > 0, F.round(clamp(total / weight), 4))


def quality_score(monthly_sales: Column, repeat: Column, is_factory: Column, days: Column) -> Column:
    factory = F.when(is_factory, F.lit(1.0)).when(~is_factory, F.lit(0.45))
    return weighted([(0.35, sales_step(monthly_sales)), (0.30, F.when(repeat.isNotNull(), repeat_rate(repeat))), (0.25, factory), (0.10, delivery_step(days))])


def business_score(moq: Column, base_price: Column) -> Column:
    return weighted([(0.65, moq_step(moq)), (0.35, price_step(base_price))])


def completeness(parts: list[tuple[float, Column]]) -> Column:
    out = F.lit(0.0)
    for w, c in parts:
        out = out + F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.round(out, 4)


def candidate_score(match: Column, quality: Column, business: Column) -> Column:
    """Unknown counts as 0."""
    zero = F.lit(0.0)
    m = F.when(match.isNotNull(), clamp(match)).otherwise(zero)
    return F.round(F.lit(0.65) * m + F.lit(0.25) * F.coalesce(quality, zero) + F.lit(0.10) * F.coalesce(business, zero), 4)


def real_offer(offer_id: Column) -> Column:
    return F.coalesce(offer_id.rlike(r"^\d{8,}$"), F.lit(False))


def reusable_offer(offer_id: Column, rejected: Column, score: Column) -> Column:
    """A real offer that was not rejected, with no score or one above 0.40."""
    return real_offer(offer_id) & ~F.coalesce(rejected, F.lit(False)) & (score.isNull() | (score > 0.40))
