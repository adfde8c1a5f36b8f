"""Dedup, ranking and top-k per key. Ties end at an explicit position column, never at row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(*columns: str) -> Column:
    """How many of the columns hold something: neither null nor an empty string."""
    return sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in columns), F.lit(0))


def first_per_key(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; one shuffle by key, cut early inside each task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def dedupe_products(df: DataFrame, rank: str = "source_rank", pos: str = "source_pos", fields: tuple[str, ...] = ("title", "price", "bsr_rank", "rating", "review_count", "main_image_url", "listing_url")) -> DataFrame:
    """Best row per product id (trimmed, upper case): lowest rank, then most complete, then first. Blank ids pass.

    ``first_pos`` is where the id first appeared, which is the output order.
    """
    keyed = df.withColumn("_key", F.upper(F.trim(F.coalesce(F.col("asin"), F.lit("")))))
    # rows without an id are keys of their own, so one window serves both
    key = F.when(F.col("_key") != "", F.concat(F.lit("k"), "_key")).otherwise(F.concat(F.lit("r"), F.col(pos).cast("string")))
    keyed = keyed.withColumn("_key", key)
    firsts = Window.partitionBy("_key")
    keyed = keyed.withColumn("first_pos", F.min(pos).over(firsts))
    present = [c for c in fields if c in df.columns]
    order = [F.col(rank).asc_nulls_last(), filled(*present).desc(), F.col(pos).asc()]
    return first_per_key(keyed, ["_key"], order).drop("_key")


def rank_offers(df: DataFrame, product: list[str], base: str = "candidate_score", margin: str = "profit_margin", net: str = "net_profit", profit_score: str = "profit_score", pos: str = "source_pos") -> DataFrame:
    """Adds rank_score and offer_rank: 0.7 candidate + 0.3 profit score (4 decimals), then base, margin, net (unknown: -1), position."""
    b = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(base), F.lit(0.0))))
    out = df.withColumn("rank_score", F.round(F.lit(0.70) * b + F.lit(0.30) * F.coalesce(F.col(profit_score), F.lit(0.0)), 4))
    order = [F.desc("rank_score"), b.desc(), F.coalesce(F.col(margin), F.lit(-1.0)).desc(), F.coalesce(F.col(net), F.lit(-1.0)).desc(), F.asc(pos)]
    return out.withColumn("offer_rank", F.row_number().over(Window.partitionBy(*product).orderBy(*order)))


def dedupe_offers(ranked: DataFrame, product: list[str], offer_id: str = "offer_id", url: str | None = None, rank: str = "offer_rank") -> DataFrame:
    """Keeps the best-ranked row of each offer: same id, else same URL (lower case), else the row itself."""
    key = F.when(F.trim(F.coalesce(F.col(offer_id).cast("string"), F.lit(""))) != "", F.concat(F.lit("offer:"), F.trim(F.col(offer_id).cast("string"))))
    if url:
        key = F.coalesce(key, F.when(F.trim(F.coalesce(F.col(url), F.lit(""))) != "", F.concat(F.lit("url:"), F.lower(F.trim(F.col(url))))))
    key = F.coalesce(key, F.concat(F.lit("row:"), F.col(rank).cast("string")))
    return first_per_key(ranked.withColumn("_offer", key), [*product, "_offer"], [F.asc(rank)]).drop("_offer")


def best_profit(ranked: DataFrame, product: list[str], rank: str = "offer_rank") -> DataFrame:
    """First ranked offer that has a profit."""
    return first_per_key(ranked.filter(F.col("net_profit").isNotNull()), product, [F.asc(rank)])


def dedupe_keywords(df: DataFrame, keyword: str = "keyword", pos: str = "source_pos") -> DataFrame:
    """First row of each keyword whatever its case, with how many repeats it had."""
    key = F.lower(F.trim(F.regexp_replace(F.col(keyword), r"\s+", " ")))
    keyed = df.filter(key.isNotNull() & (key != "")).withColumn("_key", key)
    keyed = keyed.withColumn("duplicates", F.count("*").over(Window.partitionBy("_key")) - 1)
    return first_per_key(keyed, ["_key"], [F.asc(pos)]).drop("_key")


def dedupe_records(df: DataFrame, pos: str = "source_pos", fields: tuple[str, ...] = ("title", "price", "bsr_rank", "rating", "review_count", "main_image_url", "listing_url", "category")) -> DataFrame:
    """Best scored record per product id: score (unknown: 0), top candidate score, net profit, completeness, first."""
    present = [c for c in fields if c in df.columns]
    zero = F.lit(0.0)
    order = [F.coalesce("total_score", zero).desc(), F.coalesce("candidate_score", zero).desc(), F.coalesce("net_profit", zero).desc(), filled(*present).desc(), F.asc(pos)]
    key = F.upper(F.trim(F.coalesce(F.col("asin"), F.lit(""))))
    keyed = df.withColumn("_key", F.when(key != "", F.concat(F.lit("k"), key)).otherwise(F.concat(F.lit("r"), F.col(pos).cast("string"))))
    return first_per_key(keyed, ["_key"], order).drop("_key")


def rank_candidates(df: DataFrame, top_n: int | None = None, secondary: str = "net_profit", pos: str = "source_pos", run: list[str] | None = None) -> DataFrame:
    """Records that passed, by total, top candidate score, secondary key and position; the limit is the caller's report size."""
    order = [F.desc("total_score"), F.coalesce("candidate_score", F.lit(0.0)).desc(), F.coalesce(secondary, F.lit(0.0)).desc(), F.asc(pos)]
    passed = df.filter(F.col("total_score").isNotNull() & F.col("passed"))
    if run:
        return top_per_key(passed, run, order, top_n or 2**31 - 1)
    ordered = passed.orderBy(*order)
    return ordered.limit(top_n) if top_n else ordered


def review_fallback(df: DataFrame, run: list[str], top_n: int = 5, pos: str = "source_pos") -> DataFrame:
    """For runs where nothing passed: records with offers that are scored or have reasons, best first."""
    none_passed = df.groupBy(*run).agg(F.coalesce(F.bool_or("passed"), F.lit(False)).alias("any")).filter("not any").select(*run)
    able = df.filter((F.col("n_offers") > 0) & ((F.col("total_score").isNotNull() & F.col("net_profit").isNotNull()) | (F.size("rejection_reasons") > 0)))
    order = [F.col("total_score").desc_nulls_last(), F.coalesce("net_profit", F.lit(0.0)).desc(), F.asc(pos)]
    return top_per_key(able.join(none_passed, run, "left_semi"), run, order, top_n)


def top_candidates(df: DataFrame, by: str, n: int, pos: str = "source_pos") -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), F.asc(pos)).limit(n)


def search_candidates(df: DataFrame, text: str, columns: tuple[str, ...] = ("asin", "title", "supplier")) -> DataFrame:
    """Rows in which any of the columns contains the text, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
    return df.filter(hit)


def merge_query_hits(hits: DataFrame, per_query: int, limit: int, product: list[str]) -> DataFrame:
    """Hits of several queries as one offer list: per-query limit, first row of an offer kept, its queries gathered, by sales."""
    cut = top_per_key(hits, [*product, "query"], [F.asc("source_pos")], per_query, "_nth").drop("_nth")
    whole = F.struct("source_pos", "query", "monthly_sales")
    one = cut.groupBy(*product, "offer_id").agg(F.min_by(whole, F.struct("source_pos", "query")).alias("first"), F.array_sort(F.collect_set("query")).alias("queries"))
    order = [F.coalesce("first.monthly_sales", F.lit(0.0)).desc(), F.asc("first.source_pos"), F.asc("offer_id")]
    return top_per_key(one, product, order, limit).select(*product, "offer_id", "rank", F.col("first.monthly_sales").alias("monthly_sales"), "queries")


def market_cap(df: DataFrame, run: list[str], cap: int, pos: str = "source_pos") -> DataFrame:
    """Flags the first ``cap`` products of each run for the costly stage; no row is dropped."""
    return df.withColumn("in_market", F.row_number().over(Window.partitionBy(*run).orderBy(pos)) <= cap)


def shortlist_order(df: DataFrame, niche: list[str]) -> DataFrame:
    """rank_index from 0: eligible by fit and sales, then excluded by sales."""
    sales = F.coalesce("monthly_sales", F.lit(0.0))
    order = [F.asc("excluded"), F.when(~F.col("excluded"), F.col("fit_score")).desc_nulls_last(), sales.desc(), F.asc("seller")]
    return df.withColumn("rank_index", F.row_number().over(Window.partitionBy(*niche).orderBy(*order)) - 1)


def result_page(df: DataFrame, order: list[Column], limit: int, least: int = 1, most: int = 50) -> DataFrame:
    """One page, newest first; the page size is clamped to the report's range."""
    return df.orderBy(*order).limit(max(least, min(most, limit)))


def best_match(df: DataFrame, product: list[str], pos: str = "source_pos") -> DataFrame:
    return first_per_key(df, product, [F.col("confidence").desc_nulls_last(), F.asc(pos)])


def group_cv(df: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """Sample deviation over mean of each group's values; null under three values or without a positive mean."""
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("dev"))
    return stats.withColumn("cv", F.when((F.col("n") >= least) & (F.col("mean") > 0), F.col("dev") / F.col("mean")))
