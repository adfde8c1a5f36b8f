"""Decisions on scored candidates: review status, brief, recommendation, report conclusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _list(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def review_status(has_supplier: Column, conflicts: Column, missing: Column, match_score: Column, passed: Column) -> Column:
    return (
        F.when(~has_supplier, "no_supplier").when(F.size(conflicts) > 0, "conflict").when(F.size(missing) > 0, "needs_specs").when((match_score >= 0.8) & passed, "ready").otherwise("needs_review")
    )


def sourcing_quality(count: Column, mock: Column, no_supplier: Column, conflict: Column, ready: Column) -> Column:
    """Label of an export from its status counts."""
    return F.when((count == 0) | (no_supplier == count), "blocked").when(mock > 0, "mock_review").when(conflict > 0, "conflict_review").when(ready / count >= 0.7, "ready").otherwise("needs_review")


def decision_brief(c: dict[str, Column]) -> Column:
    """struct(action, confidence, positives, risks, next_steps).

    Keys: passed, reasons, margin, match, spec, missing, conflicts (arrays), has_supplier,
    has_supplier_evidence, has_market, has_rich_market.
    """
    margin, match, spec = c["margin"], c["match"], c["spec"]
    flag = lambda cond, code: F.when(cond, F.lit(code))
    no = lambda cond: ~F.coalesce(cond, F.lit(False))
    positives = _list(
        F.when(c["has_rich_market"], "market_data_rich").when(c["has_market"], "market_data_basic"), flag(c["has_supplier_evidence"], "supplier_evidence"),
        flag(match >= 0.55, "match_quality"), flag(spec >= 0.7, "spec_match"), flag(margin >= 0.18, "margin"),
    )
    named = lambda prefix, xs, n: F.transform(F.slice(xs, 1, n), lambda x: F.concat(F.lit(prefix), x))
    risks = F.slice(
        F.array_distinct(
            F.concat(
                _list(flag(no(c["has_market"] | c["has_rich_market"]), "market_data_missing"), flag(no(c["has_supplier_evidence"]), "supplier_missing"), flag(match < 0.55, "match_quality"), flag(spec < 0.7, "spec_match"), flag(margin < 0.18, "margin")),
                named("rejection:", c["reasons"], 4), named("conflict:", c["conflicts"], 3), named("missing:", c["missing"], 3),
            )
        ),
        1, 8,
    )
    gaps = (F.size(c["missing"]) > 0) | (F.size(c["conflicts"]) > 0)
    open_points = gaps | (F.size(c["reasons"]) > 0)
    ready = c["passed"] & ~gaps & c["has_rich_market"]
    action = F.when(~c["has_supplier"], "blocked_no_supplier").when(ready, "ready_to_sample").when(open_points, "manual_verify").otherwise("score_review")
    confidence = (
        F.when(~c["has_supplier"], "low").when(ready, "high").when(open_points, F.when(c["has_supplier_evidence"] & (c["has_market"] | c["has_rich_market"]), "medium").otherwise("low")).otherwise("medium")
    )
    has = lambda *names: F.arrays_overlap(c["reasons"], F.array(*[F.lit(n) for n in names]))
    verify = _list(
        flag(gaps, "verify_specs"), flag(has("margin_too_low") | F.coalesce(margin < 0.18, F.lit(False)), "renegotiate_cost"), flag(has("supplier_match_too_low", "supplier_spec_too_low"), "compare_more_suppliers"), F.lit("accept_or_reject_supplier")
    )
    words = lambda s: F.array(*[F.lit(w) for w in s.split()])
    steps = F.when(~c["has_supplier"], words("find_supplier retry_1688")).when(ready, words("open_supplier request_quote save_shortlist")).when(open_points, verify).otherwise(words("inspect_score accept_or_reject_supplier"))
    return F.struct(action.alias("action"), confidence.alias("confidence"), positives.alias("positives"), risks.alias("risks"), F.slice(F.array_distinct(steps), 1, 5).alias("next_steps"))


def recommend(accepted: Column, in_review: Column, rejected: Column, evidence_gaps: Column) -> Column:
    """First status from the routes of a product's offers and its evidence gaps."""
    return (
        F.when((accepted > 0) & (F.size(evidence_gaps) == 0), "recommend")
        .when((accepted > 0) | (in_review > 0), "needs_manual_review")
        .when(rejected > 0, "reject")
        .otherwise("insufficient_data")
    )


def finalize(status: Column, accepted: Column, has_score: Column, passed: Column, has_profit: Column, has_market: Column, reasons: Column, score_reasons: Column, tasks: Column) -> Column:
    """struct(status, reasons, tasks) after profit, market and score are known; without accepted offers the status stays."""
    done = _list(F.when(has_score, "complete_scoring_evidence"), F.when(has_profit, "calculate_profit"), F.when(has_market, "evaluate_market"))
    open_tasks = F.filter(tasks, lambda t: ~F.array_contains(done, t))
    final = F.when(accepted == 0, F.coalesce(status, F.lit("insufficient_data"))).when(~has_score, "needs_manual_review").when(~passed, "reject").when(~has_profit | ~has_market, "needs_manual_review").otherwise("recommend")
    more = F.when((accepted > 0) & ~has_score, F.array(F.lit("complete_scoring_evidence"))).when(
        (accepted > 0) & passed, _list(F.when(~has_profit, "calculate_profit"), F.when(~has_market, "evaluate_market"))
    ).otherwise(F.array().cast("array<string>"))
    out = F.when(final == "recommend", F.when(accepted > 0, F.array().cast("array<string>")).otherwise(reasons)).when((accepted > 0) & (final == "reject"), F.concat(reasons, score_reasons)).otherwise(reasons)
    return F.struct(final.alias("status"), F.array_distinct(out).alias("reasons"), F.array_distinct(F.concat(open_tasks, more)).alias("tasks"))


def data_gaps(c: dict[str, Column]) -> Column:
    """Codes of what a report lacks. Keys: invalid, supplier, url, moq, sales, searches, dimensions, risk_flags."""
    flag = lambda cond, code: F.when(cond, F.lit(code))
    return _list(
        flag(c["invalid"], "invalid_supplier"),
        flag(c["supplier"].isNull() | c["url"].isNull(), "no_live_offer"),
        flag(F.coalesce(c["moq"], F.lit(0)) == 0, "no_moq"),
        flag((F.coalesce(c["sales"], F.lit(0)) == 0) & (F.coalesce(c["searches"], F.lit(0)) == 0), "no_market_data"),
        flag(c["dimensions"].isNull(), "no_dimensions"),
        flag(F.coalesce(F.size(c["risk_flags"]), F.lit(0)) <= 0, "no_brand_check"),
    )


def conclusion(invalid: Column, gaps: Column, passed: Column, score: Column, margin: Column, reasons: Column) -> Column:
    """Report conclusion: manual review, recommend, eliminate or hold; a recommendation below 80 points or 30 % margin is held."""
    s, m = F.coalesce(score, F.lit(0.0)), F.coalesce(margin, F.lit(0.0))
    first = (
        F.when(invalid, "manual_review_invalid_supply").when(F.size(gaps) > 0, "manual_review").when(passed & (s >= 75) & (m >= 0.25), "recommend").when(~passed & (F.size(reasons) > 0), "eliminate").otherwise("hold")
    )
    return F.when((first == "recommend") & ((s < 80) | (m < 0.30)), "hold").otherwise(first)


#: Gap codes and the step that closes each, in order.
STEPS = (("invalid_supplier", "confirm_live_supplier"), ("no_live_offer", "confirm_live_supplier"), ("no_moq", "confirm_moq_and_tiers"), ("no_market_data", "collect_market_data"), ("no_dimensions", "measure_and_recost"), ("no_brand_check", "check_brand_and_compliance"))


def next_steps(gaps: Column) -> Column:
    steps = F.array_distinct(_list(*[F.when(F.array_contains(gaps, g), F.lit(s)) for g, s in STEPS]))
    return F.when(F.size(steps) == 0, F.array(F.lit("quote_and_sample"))).otherwise(steps)
