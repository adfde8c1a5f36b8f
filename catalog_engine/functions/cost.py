"""Cost and profit of a product-offer pair as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import COST, CostRules


def positive(c: Column) -> Column:
    """The number if it is finite and above zero, else null."""
    x = c.try_cast("double")
    return F.when((x > 0) & ~F.isnan(x) & (x < F.lit(float("inf"))), x)


def positive_tiers(tiers: Column) -> Column:
    """Tiers (min_qty, price_cny) whose two numbers are positive, in their order."""
    clean = F.transform(tiers, lambda t: F.struct(positive(t["min_qty"]).alias("min_qty"), positive(t["price_cny"]).alias("price_cny")))
    return F.filter(clean, lambda t: t["min_qty"].isNotNull() & t["price_cny"].isNotNull())


def tier_price(tiers: Column, base: Column, qty: Column) -> Column:
    """Price of the largest tier that the quantity reaches; below all of them the lowest tier; without tiers the base price. First tier wins ties."""
    clean = positive_tiers(tiers)
    q = qty.cast("double")

    def better(want):
        return lambda best, t: F.when(best.isNull() | want(t, best), t).otherwise(best)

    none = F.lit(None).cast("struct<min_qty:double,price_cny:double>")
    reached = F.aggregate(F.filter(clean, lambda t: t["min_qty"] <= q), none, better(lambda t, b: t["min_qty"] > b["min_qty"]))
    lowest = F.aggregate(clean, none, better(lambda t, b: t["min_qty"] < b["min_qty"]))
    return positive(F.coalesce(reached["price_cny"], lowest["price_cny"], base))


def fee_band(length: Column, width: Column, height: Column, weight_kg: Column, r: CostRules = COST) -> Column:
    """Fee of the first size band that holds the product; the last one beyond all bands."""
    side, oz = F.greatest(length, width, height) * F.lit(r.cm_to_in), weight_kg * F.lit(r.kg_to_oz)
    out = F.lit(r.bands[-1][2])
    for most_in, most_oz, fee in reversed(r.bands):
        out = F.when((side <= most_in) & (oz <= most_oz), F.lit(fee)).otherwise(out)
    return F.when(length.isNotNull() & width.isNotNull() & height.isNotNull() & weight_kg.isNotNull(), out)


def keyed_rate(category: Column, rates: tuple[tuple[str, float], ...], default: float) -> Column:
    """Rate of the category, or the default."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in rates))
    return F.coalesce(F.try_element_at(table, F.coalesce(category, F.lit(""))), F.lit(default))


def shipping(length: Column, width: Column, height: Column, weight_kg: Column, r: CostRules = COST) -> Column:
    """First-leg freight; null if any measure is missing. A zero side gives no volumetric weight."""
    volume = F.when((length != 0) & (width != 0) & (height != 0), length * width * height / F.lit(r.volumetric_divisor)).otherwise(F.lit(0.0))
    known = length.isNotNull() & width.isNotNull() & height.isNotNull() & weight_kg.isNotNull()
    return F.when(known, F.lit(r.base_fee) + F.lit(r.per_kg) * F.greatest(weight_kg, volume, F.lit(r.least_kg)))


COST_PARTS = ("purchase_cost", "shipping_cost", "fba_fee", "commission", "ad_cost", "return_loss", "exchange_loss")


def with_profit(df: DataFrame, r: CostRules = COST, qty: Column | None = None) -> DataFrame:
    """Adds the profit breakdown to rows of price, category, measures, price_tiers and base_price_cny.

    ``missing_fields`` names what stops the calculation, in the order of the checks;
    all amounts are null then. Steps are projections of their own, so that the tier
    lookup is computed once.
    """
    col = F.col
    out = df.withColumns({"_price": positive(col("price")), "_wholesale": tier_price(col("price_tiers"), col("base_price_cny"), F.lit(r.batch_qty) if qty is None else qty)})
    sides = [col("length_cm"), col("width_cm"), col("height_cm"), col("weight_kg")]
    gaps = F.array_compact(F.array(*[F.when(col(n).isNull(), F.lit(n)) for n in ("weight_kg", "length_cm", "width_cm", "height_cm")]))
    missing = F.when(col("_price").isNull(), F.array(F.lit("selling_price"))).when(col("_wholesale").isNull(), F.array(F.lit("purchase_price"))).otherwise(gaps)
    known = F.size("missing_fields") == 0
    price = col("_price")
    parts = {
        "purchase_cost": col("_wholesale") * F.lit(r.cny_to_usd),
        "shipping_cost": shipping(*sides, r=r),
        "fba_fee": fee_band(*sides, r=r),
        "commission": price * keyed_rate(col("category"), r.commission, r.default_commission),
        "ad_cost": price * F.lit(r.acos) * F.lit(r.ad_share),
        "return_loss": price * keyed_rate(col("category"), r.returns, r.default_return) * F.lit(r.return_loss),
        "exchange_loss": price * F.lit(r.exchange_loss),
    }
    out = out.withColumn("missing_fields", missing).withColumns({k: F.when(known, v) for k, v in parts.items()})
    total = col(COST_PARTS[0])
    for k in COST_PARTS[1:]:
        total = total + col(k)
    out = out.withColumn("total_cost", total)
    return out.withColumns({"net_profit": price - col("total_cost"), "profit_margin": (price - col("total_cost")) / price}).drop("_price", "_wholesale")


def supplier_profit_score(margin: Column) -> Column:
    """0 up to no margin, 1 from two fifths, linear between (4 decimals)."""
    return F.when(margin <= 0, F.lit(0.0)).when(margin >= 0.40, F.lit(1.0)).when(margin.isNotNull(), F.round(margin / 0.40, 4))


def warehouse_cost(cubic_m: Column, days: Column, weight_kg: Column, bands: tuple[tuple[float, float], ...], rates: tuple[tuple[int, float], ...], surcharge: float) -> Column:
    """Alternative to marketplace fulfilment: storage by age band (rate per cubic metre and day) plus handling by weight band and fuel surcharge."""
    daily = F.lit(rates[-1][1])
    for most, rate in reversed(rates):
        daily = F.when(days <= most, F.lit(rate)).otherwise(daily)
    fee = F.lit(bands[-1][1])
    for most, amount in reversed(bands):
        fee = F.when(weight_kg <= most, F.lit(amount)).otherwise(fee)
    return cubic_m * days * daily + fee * F.lit(1 + surcharge)
