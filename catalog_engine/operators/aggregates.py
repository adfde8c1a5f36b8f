"""Group aggregates. Cross-row sums of measured values are decimal, so they do not depend on partition order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cost import positive


def exact_sum(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,6)")).cast("double")


def exact_avg(c: Column) -> Column:
    """Mean from an exact sum; null over no values."""
    return F.try_divide(F.sum(c.cast("decimal(38,6)")).cast("double"), F.count(c).cast("double"))


def share(condition: Column) -> Column:
    """Share of rows for which the condition holds, 0.0 over no rows."""
    return F.coalesce(F.try_divide(F.count_if(condition).cast("double"), F.count("*").cast("double")), F.lit(0.0))


def supply_columns() -> dict[str, Column]:
    """Aggregates of a product's offers: what those that have both a price and an MOQ show; n_priced and n_with_moq count over real offers. Without real offers all are null."""
    real = ~F.coalesce(F.col("source") == "mock", F.lit(False))
    price = F.when(real, F.coalesce(positive(F.col("base_price_cny")), positive(F.get("price_tiers", 0)["price_cny"])))
    moq = F.when(real, positive(F.col("moq")))
    ok = price.isNotNull() & moq.isNotNull()
    only = lambda c: F.when(ok, c)
    out = {
        "n_offers": F.count_if(ok),
        "n_priced": F.count(price),
        "n_with_moq": F.count(moq),
        "avg_repeat": exact_avg(only(F.col("repeat_buyer_rate"))),
        "min_moq": F.min(only(F.col("moq"))),
        "min_days": F.min(only(F.col("delivery_days"))),
        "min_price": F.min(only(positive(F.col("base_price_cny")))),
        "avg_match": exact_avg(only(F.col("match_quality_score"))),
        "any_fba": F.coalesce(F.bool_or(only(F.col("fba_ready"))), F.lit(False)),
        "factory_score": exact_avg(only(F.when(F.col("is_factory"), F.lit(1.0)).when(~F.col("is_factory"), F.lit(0.45)))),
        "avg_sales": exact_avg(only(F.col("monthly_sales"))),
    }
    return {k: F.when(F.count_if(real) > 0, v) for k, v in out.items()}


def supply_features(offers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``supply_columns`` of each product that has real offers."""
    found = offers.groupBy(*(keys or ["asin"])).agg(*[v.alias(k) for k, v in supply_columns().items()])
    return found.filter("n_offers is not null")


def seller_aggregate(rows: DataFrame, by: str = "monthly_revenue", niche: list[str] | None = None, pos: str = "source_pos") -> DataFrame:
    """Per seller (trimmed, blank dropped): the representative row, counts, null-safe sums and sorted brands."""
    rows = rows.withColumn("seller", F.trim("seller")).filter("seller <> ''")
    low = F.lit(float("-inf"))
    order = F.struct(F.coalesce(F.col(by).cast("double"), low), F.coalesce(F.col("monthly_sales").cast("double"), low), -F.col(pos))
    fields = ["asin", "title", "brand", "price", "rating", "review_count", "launch_date", "monthly_sales", "monthly_revenue"]
    return rows.groupBy(*(niche or []), "seller").agg(
        F.max_by(F.struct(*fields), order).alias("rep"),
        F.min_by("seller_product_count", F.when(F.col("seller_product_count").isNotNull(), F.col(pos))).alias("reported_product_count"),
        F.count("*").alias("sample_product_count"),
        exact_sum(F.col("monthly_sales")).alias("total_monthly_sales"),
        exact_sum(F.col("monthly_revenue")).alias("total_monthly_revenue"),
        F.array_sort(F.collect_set(F.when(F.col("brand") != "", F.col("brand")))).alias("brands"),
    )


def brand_shares(rows: DataFrame, niche: list[str] | None = None) -> DataFrame:
    """Per brand (trimmed, lower case): its share of the rows that have a brand, and how many those are."""
    keys = niche or []
    branded = rows.filter(F.col("brand") != "").withColumn("brand_key", F.lower(F.trim("brand")))
    counts = branded.groupBy(*keys, "brand_key").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("samples"))
    joined = counts.join(totals, keys) if keys else counts.withColumn("samples", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return joined.filter("brand_key <> ''").withColumn("share", F.col("n") / F.col("samples"))


def quality_summary(rows: DataFrame, file: list[str], key: str, fields: list[str], count_empty: bool) -> DataFrame:
    """Per imported file: source, normalised, duplicate, missing-key and empty rows."""
    empty = F.lit(True)
    for c in fields:
        empty = empty & F.col(c).isNull()
    keyed = rows.withColumn("_empty", empty).withColumn("_key", F.when(~empty, F.lower(F.col(key))))
    per = keyed.groupBy(*file, "_key").agg(F.count("*").alias("n"), F.count_if("_empty").alias("n_empty"))
    has = F.col("_key").isNotNull()
    out = per.groupBy(*file).agg(
        (F.sum("n") if count_empty else F.sum(F.col("n") - F.col("n_empty"))).alias("source_rows"),
        F.count_if(has).alias("normalised_rows"),
        F.sum(F.when(has, F.col("n") - 1).otherwise(0)).alias("duplicate_rows"),
        F.sum(F.when(has, 0).otherwise(F.col("n") - F.col("n_empty"))).alias("missing_key_rows"),
        F.sum("n_empty").alias("empty_rows"),
    )
    return out


def export_audit(rows: DataFrame, export: str = "export_id") -> DataFrame:
    """Per export: status and evidence counts, rates (0.0 when empty), readiness, means (null when empty), source histogram, label.

    Columns read: status, source, has_market, has_supplier, total_score, profit_margin, n_issues, conflicts.
    """
    status = lambda s: F.count_if(F.col("status") == s)
    n = F.count("*")
    hist = rows.groupBy(export, "source").agg(F.count("*").alias("n")).groupBy(export).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("unknown")), "n")))).alias("sources"))
    out = rows.groupBy(export).agg(
        n.alias("n_rows"),
        *[status(s).alias(f"n_{s}") for s in ("ready", "needs_review", "conflict_review", "mock_review", "blocked")],
        F.count_if(F.col("source") == "mock").alias("n_mock"),
        F.count_if(F.coalesce(F.col("source") != "mock", F.lit(True))).alias("n_real"),
        share(F.col("has_market")).alias("market_rate"),
        share(F.col("has_supplier")).alias("supplier_rate"),
        (F.coalesce(F.bool_and("has_market"), F.lit(False)) & (n > 0)).alias("market_ready"),
        (F.coalesce(F.bool_and("has_supplier"), F.lit(False)) & (n > 0)).alias("supplier_ready"),
        exact_avg(F.col("total_score")).alias("avg_score"),
        exact_avg(F.col("profit_margin")).alias("avg_margin"),
        F.sum("n_issues").alias("n_issues"),
    )
    label = F.when(F.col("n_blocked") > 0, "blocked").when(F.col("n_mock") > 0, "mock_review").when(F.col("n_conflict_review") > 0, "conflict_review").when(F.col("n_ready") >= 0.7 * F.col("n_rows"), "ready").otherwise("needs_review")
    return out.join(hist, export).withColumn("quality", label)


def export_run_list(rows: DataFrame, export: str = "export_id") -> DataFrame:
    """Per export: rows, mock rows, mean score (1 decimal), greatest margin (4 decimals)."""
    return rows.groupBy(export).agg(F.count("*").alias("n_rows"), F.count_if(F.col("source") == "mock").alias("n_mock"), F.round(exact_avg(F.col("total_score")), 1).alias("avg_score"), F.round(F.max("profit_margin"), 4).alias("max_margin"))


def suspicious_prices(rows: DataFrame, run: list[str], low: float = 1.0, high: float = 5000.0, show: int = 20) -> DataFrame:
    """Per run: how many top offers cost under ``low`` or over ``high``, the first ids of them for the report, and the mean margin."""
    odd = (F.col("purchase_cost") < low) | (F.col("purchase_cost") > high)
    nth = F.row_number().over(Window.partitionBy(*run, odd).orderBy("source_pos"))
    marked = rows.withColumns({"_odd": odd, "_nth": nth})
    shown = F.array_sort(F.collect_list(F.when(F.col("_odd") & (F.col("_nth") <= show), F.struct("source_pos", "asin"))))
    return marked.groupBy(*run).agg(F.count_if("_odd").alias("n_suspicious"), F.transform(shown, lambda x: x["asin"]).alias("examples"), exact_avg(F.col("profit_margin")).alias("avg_margin"))


def competitor_market_stats(rows: DataFrame, keys: list[str], first: int = 10, pos: str = "source_pos") -> DataFrame:
    """Per product, over its first competitors: mean price (2 decimals), mean reviews, count, revenue share of the first, and of the top by revenue."""
    cut = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).filter(F.col("_nth") <= first)
    total = exact_sum(F.col("monthly_revenue"))
    return cut.groupBy(*keys).agg(
        F.round(exact_avg(F.col("price")), 2).alias("avg_price"),
        F.round(exact_avg(F.col("review_count")), 0).alias("avg_reviews"),
        F.count("*").alias("n_competitors"),
        F.try_divide(F.max(F.when(F.col("_nth") == 1, F.col("monthly_revenue"))), F.nullif(total, F.lit(0.0))).alias("head_revenue_share"),
        F.try_divide(F.max("monthly_revenue"), F.nullif(total, F.lit(0.0))).alias("top_revenue_share"),
    )


def best_keyword(rows: DataFrame, keys: list[str], pos: str = "source_pos") -> DataFrame:
    """Per product: its keyword row of the greatest search volume, then purchase volume, then the first. Metrics that it lacks stay null."""
    low = F.lit(float("-inf"))
    order = F.struct(F.coalesce(F.col("search_volume").cast("double"), low), F.coalesce(F.col("purchase_volume").cast("double"), low), -F.col(pos))
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("best")).select(*keys, "best.*")


def _rate(cond, of):
    """Share of the rows of ``of`` that meet the condition, to six digits; null where there are none."""
    return F.round(F.try_divide(F.count_if(of & cond).cast("double"), F.count_if(of).cast("double")), 6)


def match_metrics(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision at 1 and 5 over cases that have a right offer; false-match rate and no-match accuracy over those that have none. Null where no case counts.

    A case counts only with a ranked list; one with a right offer also needs no_match
    to be false and correct_ids to be filled. A false match is a no-match case for
    which anything was ranked.
    """
    ranked, right, none = F.col("ranked_ids"), F.col("correct_ids"), F.coalesce("no_match", F.lit(False))
    has = ranked.isNotNull() & (F.col("no_match") == F.lit(False)) & (F.size(right) > 0)
    has, none = F.coalesce(has, F.lit(False)), none & ranked.isNotNull()
    hit = lambda k: F.arrays_overlap(F.slice(ranked, 1, k), right)
    return cases.groupBy(*(by or [])).agg(
        F.count("*").alias("n_cases"),
        _rate(hit(1), has).alias("precision_at_1"),
        _rate(hit(5), has).alias("precision_at_5"),
        _rate(F.size(ranked) > 0, none).alias("false_match_rate"),
        _rate(F.size(ranked) == 0, none).alias("no_match_accuracy"),
    )


def recommendation_metrics(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Quality of recommendations over reviewed cases with a prediction.

    Columns: recommendation_label, recommendation_status, supplier_count, mock_count,
    field_completeness, retries, cost, pipeline_success. A mean or rate over all cases
    is null unless every case has its field; supplier rates also need 0 <= mock <= all.
    """
    n = F.count("*")
    every = lambda ok: (n > 0) & (F.count_if(F.coalesce(ok, F.lit(False))) == n)
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,6)")).cast("double")
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    suppliers = every(number("supplier_count") & number("mock_count") & (F.col("supplier_count") >= 0) & (F.col("mock_count") >= 0) & (F.col("mock_count") <= F.col("supplier_count")))
    status = F.col("recommendation_status")
    known = every(status.isNotNull())
    labelled = F.coalesce(F.col("recommendation_label").isin("recommend", "reject") & status.isNotNull(), F.lit(False))
    recommended = labelled & (status == "recommend")
    mean = lambda c: F.when(every(number(c)), share(total(c), n.cast("double")))
    return cases.groupBy(*(by or [])).agg(
        n.alias("n_cases"),
        mean("field_completeness").alias("field_completeness"),
        F.when(suppliers, share(total("supplier_count") - total("mock_count"), total("supplier_count"))).alias("real_supplier_rate"),
        F.when(suppliers, share(total("mock_count"), total("supplier_count"))).alias("mock_contamination_rate"),
        _rate(F.col("recommendation_label") == "recommend", recommended).alias("recommendation_precision"),
        F.when(known, share(F.count_if(status == "needs_manual_review").cast("double"), n.cast("double"))).alias("manual_review_rate"),
        F.when(every(number("cost")) & known, share(total("cost"), F.count_if(recommended).cast("double"))).alias("cost_per_approved_candidate"),
        mean("retries").alias("average_retries"),
        F.when(every(F.col("pipeline_success").isNotNull()), share(F.count_if("pipeline_success").cast("double"), n.cast("double"))).alias("pipeline_success_rate"),
    )


def all_or_nothing(cases: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean of each field, null unless every case has it."""
    return cases.groupBy(*(by or [])).agg(F.count("*").alias("n_cases"), *[F.when((F.count_if(F.col(c).isNull()) == 0) & (F.count("*") > 0), F.round(exact_avg(F.col(c)), 6)).alias(f"avg_{c}") for c in fields])


def contract_metrics(cases: DataFrame, by: str = "category_id") -> DataFrame:
    """Decision and reason quality for each category and, where the category is null, over all. A reason counts where one is expected: it is right if it is among the mismatch reasons."""
    good = F.col("decision") == F.col("expected_decision")
    asked = F.coalesce(F.col("expected_reason") != "", F.lit(False))
    return cases.groupingSets([[by], []], by).agg(
        F.count("*").alias("n_cases"),
        _rate(good, F.lit(True)).alias("decision_accuracy"),
        _rate(F.col("expected_decision") == "keep", F.col("decision") == "keep").alias("keep_precision"),
        _rate(F.col("decision") == "reject", F.col("expected_decision") == "reject").alias("reject_recall"),
        _rate(F.array_contains(F.coalesce("mismatch_reasons", F.array().cast("array<string>")), F.col("expected_reason")), asked).alias("reason_accuracy"),
    )


def query_hit_rates(hits: DataFrame, keys: list[str], least: float = 0.2) -> DataFrame:
    """Per query: hit rate (null unless completed) and its flag."""
    n, relevant = F.count("*"), F.count_if("relevant")
    out = hits.groupBy(*keys).agg(n.alias("n_offers"), relevant.alias("n_relevant"), F.bool_and(F.col("status") == "completed").alias("completed"))
    rate = F.when(F.col("completed"), F.round(F.col("n_relevant") / F.greatest(F.lit(1), F.col("n_offers")), 6))
    return out.withColumn("hit_rate", rate).withColumn("flag", F.when(F.col("hit_rate").isNull(), F.lit(None)).when(F.col("n_offers") == 0, "NO_RESULTS").when(F.col("hit_rate") < least, "LOW_RELEVANCE"))


def status_counts(df: DataFrame, statuses: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows by status and in all."""
    return df.groupBy(*(by or [])).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses], F.count("*").alias("total"))


def run_status_rollup(nodes: DataFrame, run: list[str], export_required: bool = True, stage: str = "stage", order: str = "node_id", cancelling: str | None = None) -> DataFrame:
    """One status per run: running (cancel_requested if the run's flag says so), then human_required, retry_wait for waiting and pending nodes, failed or timed_out, cancelled.

    Otherwise the export decides where one is required: without an export node the run
    waits to be resumed (retry_wait), and if the last one has not succeeded it failed.
    """
    has = lambda *s: F.bool_or(F.col("status").isin(*s))
    export = F.when(F.col(stage) == "export", F.col(order)) if export_required else F.lit(None).cast("long")
    asked = F.bool_or(F.col(cancelling)) if cancelling else F.lit(False)
    flags = nodes.groupBy(*run).agg(
        has("running").alias("r"), has("human_required").alias("h"), has("retry_wait", "pending").alias("p"), has("failed", "timed_out").alias("f"), has("cancelled").alias("c"), F.count("*").alias("n_nodes"), F.max_by("status", export).alias("e"), asked.alias("a")
    )
    c = F.col
    status = F.when(c("r"), F.when(c("a"), "cancel_requested").otherwise("running")).when(c("h"), "human_required").when(c("p"), "retry_wait").when(c("f"), "failed").when(c("c"), "cancelled")
    if export_required:
        status = status.when(c("e").isNull(), "retry_wait").when(c("e") != "succeeded", "failed")
    return flags.select(*run, "n_nodes", status.otherwise("success").alias("status"))


def histogram(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), column).agg(F.count("*").alias("n"))


def field_completeness(df: DataFrame, fields: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """One row per field: rows, filled rows and their share; in one pass over the table."""
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"f_{c}") for c in fields])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"f_{c}").alias("filled"), F.lit(float((weights or {}).get(c, 1.0))).alias("weight")) for c in fields])
    rows = one.select("n", F.inline(pairs))
    return rows.withColumn("share", F.coalesce(F.try_divide(F.col("filled").cast("double"), F.col("n").cast("double")), F.lit(0.0)))


def run_counters(df: DataFrame, run: list[str]) -> DataFrame:
    """Crawled, matched and calculated rows of each run, and how many repeats its ids had."""
    return df.groupBy(*run).agg(F.count("*").alias("crawled"), F.count_if(F.col("n_offers") > 0).alias("matched"), F.count("net_profit").alias("calculated"), (F.count("asin") - F.count_distinct("asin")).alias("duplicates_removed"))
