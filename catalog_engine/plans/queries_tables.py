"""Queries over windows, aggregates, joins, sets, decisions and run events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import aggregates as ag
from ..operators import decisions, joins, matching, setops, windows
from ..streaming import events as ev
from . import fixtures as fx
from .queries import OFFERS, PIPELINE, half_up, query, scored
from .queries_text import events



def none():
    return F.array().cast("array<string>")


# --- windows, dedup, ranking ---------------------------------------------------------------------


@query("dedupe_products", "SELECT asin, p_partkey FROM (SELECT *, upper(trim(p_brand)) AS asin, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END DESC, p_partkey) AS nth FROM part) WHERE nth = 1")
def dedupe_products(spark, d):
    p = fx.read(spark, d, "part").select("p_partkey", F.lower("p_brand").alias("asin"), F.col("p_size").alias("source_rank"), F.col("p_partkey").alias("source_pos"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"))
    return windows.dedupe_products(p).select(F.upper("asin").alias("asin"), "p_partkey")


@query("dedupe_ranked_offers", "SELECT l_partkey, l_suppkey % 7 AS offer, min(l_suppkey) AS first FROM lineitem GROUP BY l_partkey, l_suppkey % 7")
def dedupe_ranked_offers(spark, d):
    li = fx.read(spark, d, "lineitem").select("l_partkey", (F.col("l_suppkey") % 7).alias("offer"), "l_suppkey", F.col("l_suppkey").alias("offer_rank"))
    return windows.dedupe_offers(li, ["l_partkey"], "offer").select("l_partkey", "offer", F.col("l_suppkey").alias("first"))


@query("dedupe_keywords", "SELECT lower(event_type) AS keyword, min(event_id) AS event_id, count(*) - 1 AS duplicates FROM events GROUP BY lower(event_type)")
def dedupe_keywords(spark, d):
    e = events(spark, d).select("event_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), "event_type")).alias("keyword"))
    return windows.dedupe_keywords(e, pos="event_id").select(F.lower(F.trim("keyword")).alias("keyword"), "event_id", "duplicates")


@query("dedupe_records", fx.with_ctes(*PIPELINE) + "SELECT brand AS asin, asin AS kept FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY coalesce(total_score, 0) DESC, coalesce(top_candidate, 0) DESC, coalesce(net_profit, 0) DESC, bsr_rank) AS nth FROM scored) WHERE nth = 1")
def dedupe_records(spark, d):
    s = scored(spark, d).select(F.col("asin").alias("kept"), F.col("brand").alias("asin"), "total_score", F.col("top_candidate").alias("candidate_score"), "net_profit", F.col("bsr_rank").alias("source_pos"))
    return windows.dedupe_records(s, fields=()).select("asin", "kept")


@query("review_fallback", fx.with_ctes(*PIPELINE) + ", none AS (SELECT brand, title FROM scored GROUP BY brand, title HAVING NOT coalesce(bool_or(passed), false)) SELECT brand, title, asin, rank FROM (SELECT brand, title, asin, row_number() OVER (PARTITION BY brand, title ORDER BY total_score DESC NULLS LAST, coalesce(net_profit, 0) DESC, bsr_rank) AS rank FROM scored SEMI JOIN none USING (brand, title) WHERE n_offers > 0 AND (total_score IS NOT NULL AND net_profit IS NOT NULL OR rejection <> '')) WHERE rank <= 5")
def review_fallback(spark, d):
    s = scored(spark, d).withColumn("source_pos", F.col("bsr_rank"))
    return windows.review_fallback(s, ["brand", "title"]).select("brand", "title", "asin", F.col("rank").cast("long").alias("rank"))


@query("top_candidates", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_candidates(spark, d):
    return windows.top_candidates(fx.read(spark, d, "orders"), "o_totalprice", 25, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("search_candidates", fx.with_ctes(fx.PRODUCT) + "SELECT asin, title FROM product WHERE lower(title) LIKE '%bolt%' OR lower(asin) LIKE '%bolt%'")
def search_candidates(spark, d):
    return windows.search_candidates(fx.products(spark, d), "BOLT", ("asin", "title")).select("asin", "title")


@query("top_offers_per_product", fx.with_ctes(fx.OFFER) + "SELECT asin, offer_id, rank FROM (SELECT asin, offer_id, row_number() OVER (PARTITION BY asin ORDER BY monthly_sales DESC, source_pos) AS rank FROM offer) WHERE rank <= 3")
def top_offers_per_product(spark, d):
    o = windows.top_per_key(fx.offers(spark, d), ["asin"], [F.desc("monthly_sales"), F.asc("source_pos")], 3)
    return o.select("asin", "offer_id", F.col("rank").cast("long").alias("rank"))


HITS_SQL = "hit AS (SELECT l_partkey, l_linenumber AS query, l_suppkey AS offer_id, min(l_quantity) AS monthly_sales, l_suppkey AS source_pos FROM lineitem GROUP BY ALL), cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, query ORDER BY source_pos) AS nth FROM hit) WHERE nth <= 3), one AS (SELECT l_partkey, offer_id, arg_min(monthly_sales, query) AS s, array_to_string(list_sort(list(DISTINCT query)), ',') AS queries FROM cut GROUP BY ALL)"


@query("merge_query_hits", f"WITH {HITS_SQL} SELECT * FROM (SELECT l_partkey, offer_id, row_number() OVER (PARTITION BY l_partkey ORDER BY s DESC, offer_id) AS rank, s AS monthly_sales, queries FROM one) WHERE rank <= 5")
def merge_query_hits(spark, d):
    h = fx.read(spark, d, "lineitem").groupBy("l_partkey", F.col("l_linenumber").alias("query"), F.col("l_suppkey").alias("offer_id")).agg(F.min("l_quantity").alias("monthly_sales")).withColumn("source_pos", F.col("offer_id"))
    m = windows.merge_query_hits(h, 3, 5, ["l_partkey"])
    return m.select("l_partkey", "offer_id", F.col("rank").cast("long").alias("rank"), "monthly_sales", F.array_join(F.transform("queries", lambda q: q.cast("string")), ",").alias("queries"))


@query("market_cap", "SELECT p_type, count(*) FILTER (WHERE nth <= 40) AS in_market, count(*) FILTER (WHERE nth > 40) AS skipped FROM (SELECT p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS nth FROM part) GROUP BY p_type")
def market_cap(spark, d):
    m = windows.market_cap(fx.read(spark, d, "part"), ["p_type"], 40, "p_partkey")
    return m.groupBy("p_type").agg(F.count_if("in_market").alias("in_market"), F.count_if(~F.col("in_market")).alias("skipped"))


@query("result_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def result_page(spark, d):
    return windows.result_page(fx.read(spark, d, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 500).select("o_orderkey")


@query("seasonality_cv", "WITH m AS (SELECT l_partkey, month(l_shipdate) AS mo, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_partkey, count(*) AS n, CASE WHEN count(*) >= 3 AND avg(q) > 0 THEN " + half_up("stddev_samp(q) / avg(q)", 6) + " END AS cv FROM m GROUP BY l_partkey")
def seasonality_cv(spark, d):
    m = fx.read(spark, d, "lineitem").groupBy("l_partkey", F.month("l_shipdate").alias("mo")).agg(F.sum("l_quantity").alias("q"))
    return windows.group_cv(m, ["l_partkey"], "q").select("l_partkey", "n", F.round("cv", 6).alias("cv"))


@query("best_match", fx.with_ctes(fx.OFFER) + "SELECT asin, offer_id FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY match_quality_score DESC, source_pos) AS nth FROM offer) WHERE nth = 1")
def best_match(spark, d):
    return windows.best_match(fx.offers(spark, d).withColumn("confidence", F.col("match_quality_score")), ["asin"]).select("asin", "offer_id")


# --- joins ---------------------------------------------------------------------------------------


@query("latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_per_key(spark, d):
    return joins.latest_per_key(fx.read(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("candidate_view", "SELECT c_custkey, o.o_orderkey AS order_o_orderkey, e.event_type AS event_event_type FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) e ON e.user_id = c_custkey")
def candidate_view(spark, d):
    o = joins.latest_per_key(fx.read(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    e = joins.latest_per_key(events(spark, d), ["user_id"], "ts", "event_id").select(F.col("user_id").alias("c_custkey"), "event_type")
    return joins.candidate_view(fx.read(spark, d, "customer").select("c_custkey"), {"order": o, "event": e}, "c_custkey")


@query("reviewed_results", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status, p_partkey % 4 = 0 AS is_saved FROM part WHERE p_partkey % 5 <> 0")
def reviewed_results(spark, d):
    p = fx.read(spark, d, "part").select("p_partkey")
    dec = p.filter("p_partkey % 3 = 0").withColumn("status", F.lit("accepted"))
    return joins.reviewed_results(p, dec, p.filter("p_partkey % 4 = 0"), p.filter("p_partkey % 5 = 0"), "p_partkey")


@query("hidden_except", "SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0")
def hidden_except(spark, d):
    p = fx.read(spark, d, "part").select("p_partkey")
    return setops.hidden_except(p, p.filter("p_partkey % 5 = 0"), "p_partkey")


@query("accepted_offers", fx.with_ctes(*OFFERS) + "SELECT asin, offer_id, asin || ':' || offer_id AS review_key FROM ranked WHERE offer_rank <= 5 AND offer_pos % 3 = 0")
def accepted_offers(spark, d):
    from . import pipeline

    o = pipeline.priced_offers(fx.products(spark, d), fx.offers(spark, d))
    o = o.withColumn("review_key", joins.review_key(F.col("asin"), F.col("offer_id"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("offer_rank")))
    dec = o.select("review_key", F.when(F.col("source_pos") % 3 == 0, "accepted").otherwise("rejected").alias("status"))
    return joins.accepted_offers(o, dec).select("asin", "offer_id", "review_key")


@query("query_hits", "SELECT p_partkey, p_type AS query_text, s_suppkey AS offer_id FROM part LEFT JOIN supplier ON s_suppkey % 6 = CASE p_type WHEN 'SMALL' THEN 0 WHEN 'LARGE' THEN 1 ELSE 9 END")
def query_hits(spark, d):
    a = fx.read(spark, d, "part").select("p_partkey", F.col("p_type").alias("query_text"))
    execs = spark.range(1).select(F.explode(F.array(F.lit("SMALL"), F.lit("LARGE"))).alias("query_text"), F.lit("completed").alias("status"))
    k = F.col("s_suppkey") % 6
    o = fx.read(spark, d, "supplier").select(F.col("s_suppkey").alias("offer_id"), F.when(k == 0, F.array(F.lit("SMALL"))).when(k == 1, F.array(F.lit("LARGE"))).otherwise(none()).alias("search_queries"))
    return joins.query_hits(a, execs, o).select("p_partkey", "query_text", "offer_id")


@query("resume_delta", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 2 = 1")
def resume_delta(spark, d):
    o = fx.read(spark, d, "orders").select("o_orderkey", "o_totalprice").withColumn("input_fingerprint", joins.fingerprint("o_orderkey", "o_totalprice"))
    changed = F.when(F.col("o_orderkey") % 10 == 0, F.lit("stale")).otherwise(F.col("input_fingerprint"))
    done = o.filter("o_orderkey % 2 = 0").withColumn("input_fingerprint", changed)
    return joins.resume_delta(o, done, ["o_orderkey", "input_fingerprint"]).select("o_orderkey")


@query("dependency_fingerprints", "SELECT o_custkey AS node, sha256(string_agg(coalesce(o_orderstatus, ''), '|' ORDER BY o_orderstatus)) AS dependency_fingerprint FROM orders GROUP BY o_custkey")
def dependency_fingerprints(spark, d):
    o = fx.read(spark, d, "orders")
    return joins.dependency_fingerprints(o.select(F.col("o_custkey").alias("node")).distinct(), o.select(F.col("o_custkey").alias("node"), F.col("o_orderstatus").alias("output_hash")), ["node"])


@query("labels_predictions", "SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id) WHERE toxic = 0")
def labels_predictions(spark, d):
    lab = fx.read(spark, d, "labels").select(F.col("doc_id").alias("case_id"), "quality", (F.col("toxic") == 0).alias("reviewed"))
    return joins.labels_predictions(lab, fx.read(spark, d, "documents").select(F.col("doc_id").alias("case_id"), "lang")).select(F.col("case_id").alias("doc_id"), "quality", "lang")


# --- aggregates ----------------------------------------------------------------------------------

EXPORT_SQL = "ex AS (SELECT o_custkey % 200 AS export_id, o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'blocked' WHEN o_orderkey % 5 = 0 THEN 'needs_review' ELSE 'ready' END AS status, CASE WHEN o_orderkey % 97 = 0 THEN 'mock' ELSE 'live' END AS source, o_orderkey % 3 <> 0 AS has_market, o_totalprice AS total_score, (o_orderkey % 60) / 100 AS profit_margin, (o_orderkey % 4)::INT AS n_issues FROM orders)"


def exports(spark, d):
    k = F.col("o_orderkey")
    return fx.read(spark, d, "orders").select((F.col("o_custkey") % 200).alias("export_id"), "o_orderkey", F.when(k % 17 == 0, "blocked").when(k % 5 == 0, "needs_review").otherwise("ready").alias("status"), F.when(k % 97 == 0, "mock").otherwise("live").alias("source"), (k % 3 != 0).alias("has_market"), F.lit(True).alias("has_supplier"), F.col("o_totalprice").alias("total_score"), ((k % 60) / 100).alias("profit_margin"), (k % 4).cast("int").alias("n_issues"))


@query("export_audit", f"WITH {EXPORT_SQL} SELECT export_id, count(*) AS n_rows, count(*) FILTER (WHERE status = 'ready') AS n_ready, count(*) FILTER (WHERE source = 'mock') AS n_mock, " + half_up("count(*) FILTER (WHERE has_market) / count(*)::DOUBLE", 6) + " AS market_rate, bool_and(has_market) AS market_ready, " + half_up("sum(total_score::DECIMAL(38,6))::DOUBLE / count(*)", 4) + " AS avg_score, sum(n_issues)::BIGINT AS n_issues, CASE WHEN count(*) FILTER (WHERE status = 'blocked') > 0 THEN 'blocked' WHEN count(*) FILTER (WHERE source = 'mock') > 0 THEN 'mock_review' WHEN count(*) FILTER (WHERE status = 'ready') >= 0.7 * count(*) THEN 'ready' ELSE 'needs_review' END AS quality FROM ex GROUP BY export_id")
def export_audit(spark, d):
    a = ag.export_audit(exports(spark, d))
    return a.select("export_id", "n_rows", "n_ready", "n_mock", F.round("market_rate", 6).alias("market_rate"), "market_ready", F.round("avg_score", 4).alias("avg_score"), "n_issues", "quality")


@query("export_run_list", f"WITH {EXPORT_SQL} SELECT export_id, count(*) AS n_rows, count(*) FILTER (WHERE source = 'mock') AS n_mock, " + half_up("sum(total_score::DECIMAL(38,6))::DOUBLE / count(*)", 1) + " AS avg_score, " + half_up("max(profit_margin)", 4) + " AS max_margin FROM ex GROUP BY export_id")
def export_run_list(spark, d):
    return ag.export_run_list(exports(spark, d))


@query("smoke_gates", f"WITH {EXPORT_SQL} SELECT export_id FROM ex GROUP BY export_id HAVING count(*) FILTER (WHERE has_market) / count(*)::DOUBLE >= 0.7")
def smoke_gates(spark, d):
    return ag.export_audit(exports(spark, d)).filter("market_rate >= 0.7 and supplier_ready").select("export_id")


@query("suspicious_prices", fx.with_ctes(*OFFERS) + "SELECT category, count(*) FILTER (WHERE weight_kg IS NOT NULL AND (purchase_cost < 1 OR purchase_cost > 5000)) AS n_suspicious FROM ranked WHERE offer_rank = 1 GROUP BY category")
def suspicious_prices(spark, d):
    from . import pipeline

    o = pipeline.priced_offers(fx.products(spark, d), fx.offers(spark, d)).filter("offer_rank = 1")
    return ag.suspicious_prices(o, ["category"]).select("category", "n_suspicious")


@query("quality_summary", "WITH r AS (SELECT event_type AS f, event_id % 9 = 0 AS e, CASE WHEN event_id % 9 <> 0 AND event_id % 7 <> 0 THEN user_id END AS k FROM events) SELECT f AS source_file, count(*) FILTER (WHERE NOT e) AS source_rows, count(DISTINCT k) AS normalised_rows, count(k) - count(DISTINCT k) AS duplicate_rows, count(*) FILTER (WHERE NOT e AND k IS NULL) AS missing_key_rows, count(*) FILTER (WHERE e) AS empty_rows FROM r GROUP BY f")
def quality_summary(spark, d):
    i = F.col("event_id")
    e = events(spark, d).select(F.col("event_type").alias("source_file"), F.when((i % 9 != 0) & (i % 7 != 0), F.col("user_id").cast("string")).alias("keyword"), F.when(i % 9 != 0, F.col("value")).alias("volume"))
    return ag.quality_summary(e, ["source_file"], "keyword", ["keyword", "volume"], count_empty=False)


@query("keyword_metrics", "SELECT user_id, arg_max(event_type, (value, -event_id)) AS keyword, max(value) AS search_volume FROM events GROUP BY user_id")
def keyword_metrics(spark, d):
    k = events(spark, d).select("user_id", F.col("event_type").alias("keyword"), F.col("value").alias("search_volume"), F.lit(None).cast("double").alias("purchase_volume"), F.col("event_id").alias("source_pos"))
    return ag.best_keyword(k, ["user_id"]).select("user_id", "keyword", "search_volume")


@query("opportunity_estimate", "SELECT event_id, " + half_up("0.45 * least(value * 100 / 10000, 1.0) + 0.30 * least((event_id % 100) / 100, 1.0) + 0.25 * CASE WHEN event_id % 3 = 0 THEN 1.0 - least(event_id * 10 / 100000, 1.0) ELSE 0.5 END", 6) + " AS score FROM events")
def opportunity_estimate(spark, d):
    i = F.col("event_id")
    s = scores.opportunity_estimate(F.col("value") * 100, i % 100 / 100, F.when((i % 3 == 0) & (i > 0), (i * 10).cast("double")).when(i == 0, F.lit(1.0)))
    return events(spark, d).select("event_id", F.round(s, 6).alias("score"))


_CASES = """c AS (
  SELECT doc_id, lang, doc_id % 11 <> 0 AS reviewed, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE quality = 0 END AS no_match,
    CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN [] ELSE list_transform(generate_series(0, (doc_id % 6)::BIGINT), lambda i: (doc_id + i * 3) % 10) END AS ranked,
    CASE WHEN doc_id % 5 = 0 THEN [] ELSE [toxic, 4] END AS correct FROM labels JOIN documents USING (doc_id)),
e AS (SELECT *, coalesce(no_match = false AND len(correct) > 0 AND ranked IS NOT NULL, false) AS m, coalesce(no_match, false) AND ranked IS NOT NULL AS z FROM c WHERE reviewed)"""
_SHARE = lambda cond, of: half_up(f"count(*) FILTER (WHERE {of} AND {cond}) / nullif(count(*) FILTER (WHERE {of}), 0)::DOUBLE", 6)


@query(
    "match_metrics",
    f"WITH {_CASES} SELECT lang, count(*) AS n_cases, {_SHARE('list_has_any(ranked[:1], correct)', 'm')} AS precision_at_1, {_SHARE('list_has_any(ranked[:5], correct)', 'm')} AS precision_at_5, {_SHARE('len(ranked) > 0', 'z')} AS false_match_rate, {_SHARE('len(ranked) = 0', 'z')} AS no_match_accuracy FROM e GROUP BY lang",
)
def match_metrics(spark, d):
    """Labelled documents as cases: label 0 means that there is no right offer; some cases have no ranked list, some an empty one."""
    c, i = F.col, F.col("doc_id")
    ranked = F.when(i % 7 == 0, F.lit(None)).when(i % 7 == 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), i % 6), lambda k: (i + k * 3) % 10))
    right = F.when(i % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(c("toxic").cast("long"), F.lit(4).cast("long")))
    cases = fx.read(spark, d, "labels").join(fx.read(spark, d, "documents").select("doc_id", "lang"), "doc_id").filter(i % 11 != 0)
    m = cases.select("lang", F.when(i % 13 != 0, c("quality") == 0).alias("no_match"), ranked.alias("ranked_ids"), right.alias("correct_ids"))
    return ag.match_metrics(m, ["lang"])


_RECO = """r AS (
  SELECT p_type, CASE p_partkey % 3 WHEN 0 THEN 'recommend' WHEN 1 THEN 'reject' END AS label, CASE WHEN p_type = 'PROMO' AND p_size = 7 THEN NULL WHEN p_size % 4 = 0 THEN 'needs_manual_review' WHEN p_size % 4 = 1 THEN 'reject' ELSE 'recommend' END AS status,
    p_size AS suppliers, CASE WHEN p_type = 'LARGE' AND p_size = 9 THEN p_size + 1 ELSE p_size // 3 END AS mocks, CASE WHEN p_type <> 'SMALL' OR p_size <> 5 THEN p_retailprice / 2000 END AS completeness, p_size % 3 AS retries,
    CASE WHEN p_type <> 'ECONOMY' OR p_size <> 11 THEN p_retailprice END AS cost, CASE WHEN p_type <> 'MEDIUM' OR p_size <> 13 THEN p_size > 10 END AS success FROM part)"""
_EVERY = lambda cond, value: f"CASE WHEN count(*) FILTER (WHERE NOT coalesce({cond}, false)) = 0 THEN {half_up(value, 6)} END"
_SUM = lambda x: f"sum({x}::DECIMAL(38,6))::DOUBLE"


@query(
    "recommendation_metrics",
    f"WITH {_RECO} SELECT p_type, count(*) AS n_cases, {_EVERY('completeness IS NOT NULL', _SUM('completeness') + ' / count(*)')} AS field_completeness, "
    + f"{_EVERY('mocks <= suppliers', '(sum(suppliers) - sum(mocks)) / sum(suppliers)::DOUBLE')} AS real_supplier_rate, {_EVERY('mocks <= suppliers', 'sum(mocks) / sum(suppliers)::DOUBLE')} AS mock_contamination_rate, "
    + half_up("count(*) FILTER (WHERE label = 'recommend' AND status = 'recommend') / nullif(count(*) FILTER (WHERE label IS NOT NULL AND status = 'recommend'), 0)::DOUBLE", 6) + " AS recommendation_precision, "
    + _EVERY("status IS NOT NULL", "count(*) FILTER (WHERE status = 'needs_manual_review') / count(*)::DOUBLE") + " AS manual_review_rate, "
    + _EVERY("status IS NOT NULL AND cost IS NOT NULL", _SUM("cost") + " / nullif(count(*) FILTER (WHERE label IS NOT NULL AND status = 'recommend'), 0)::DOUBLE") + " AS cost_per_approved_candidate, "
    + f"{_EVERY('true', 'sum(retries) / count(*)::DOUBLE')} AS average_retries, {_EVERY('success IS NOT NULL', 'count(*) FILTER (WHERE success) / count(*)::DOUBLE')} AS pipeline_success_rate FROM r GROUP BY p_type",
)
def recommendation_metrics(spark, d):
    """Parts as reviewed cases; for each type another field is missing once."""
    c, s, t = F.col, F.col("p_size"), F.col("p_type")
    lacks = lambda kind, size: (t == kind) & (s == size)
    cases = fx.read(spark, d, "part").select(
        "p_type", F.when(c("p_partkey") % 3 == 0, "recommend").when(c("p_partkey") % 3 == 1, "reject").alias("recommendation_label"),
        F.when(~lacks("PROMO", 7), F.when(s % 4 == 0, "needs_manual_review").when(s % 4 == 1, "reject").otherwise("recommend")).alias("recommendation_status"),
        s.alias("supplier_count"), F.when(lacks("LARGE", 9), s + 1).otherwise(F.floor(s / 3)).alias("mock_count"), F.when(~lacks("SMALL", 5), c("p_retailprice") / 2000).alias("field_completeness"), (s % 3).alias("retries"),
        F.when(~lacks("ECONOMY", 11), c("p_retailprice")).alias("cost"), F.when(~lacks("MEDIUM", 13), s > 10).alias("pipeline_success"),
    )
    return ag.recommendation_metrics(cases, ["p_type"])


@query(
    "contract_metrics",
    "SELECT category_id, count(*) AS n_cases, " + half_up("avg((d = e)::INT)", 6) + " AS decision_accuracy, " + half_up("count(*) FILTER (WHERE d = 'keep' AND e = 'keep') / count(*) FILTER (WHERE d = 'keep')::DOUBLE", 6) + " AS keep_precision, " + half_up("count(*) FILTER (WHERE d = 'reject' AND e = 'reject') / count(*) FILTER (WHERE e = 'reject')::DOUBLE", 6) + " AS reject_recall, "
    + half_up("count(*) FILTER (WHERE r <> '' AND list_contains(m, r)) / nullif(count(*) FILTER (WHERE r <> ''), 0)::DOUBLE", 6) + " AS reason_accuracy "
    + "FROM (SELECT p_type AS category_id, CASE WHEN p_partkey % 3 = 0 THEN 'keep' ELSE 'reject' END AS d, CASE WHEN p_partkey % 2 = 0 THEN 'keep' ELSE 'reject' END AS e, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'capacity' ELSE 'material' END AS r, CASE WHEN p_size % 5 = 0 THEN NULL ELSE ['material', p_brand] END AS m FROM part) GROUP BY GROUPING SETS ((category_id), ())",
)
def contract_metrics(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    c = fx.read(spark, d, "part").select(
        F.col("p_type").alias("category_id"), F.when(k % 3 == 0, "keep").otherwise("reject").alias("decision"), F.when(k % 2 == 0, "keep").otherwise("reject").alias("expected_decision"),
        F.when(s % 3 == 0, "").when(s % 3 == 1, "capacity").otherwise("material").alias("expected_reason"), F.when(s % 5 != 0, F.array(F.lit("material"), "p_brand")).alias("mismatch_reasons"),
    )
    return ag.contract_metrics(c)


@query("query_hit_rates", "SELECT user_id, count(*) AS n_offers, count(*) FILTER (WHERE value > 100) AS n_relevant, " + half_up("count(*) FILTER (WHERE value > 100) / count(*)::DOUBLE", 6) + " AS hit_rate, CASE WHEN " + half_up("count(*) FILTER (WHERE value > 100) / count(*)::DOUBLE", 6) + " < 0.2 THEN 'LOW_RELEVANCE' END AS flag FROM events GROUP BY user_id")
def query_hit_rates(spark, d):
    h = events(spark, d).select("user_id", (F.col("value") > 100).alias("relevant"), F.lit("completed").alias("status"))
    return ag.query_hit_rates(h, ["user_id"]).select("user_id", "n_offers", "n_relevant", "hit_rate", "flag")


@query("manual_queue_summary", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (WHERE o_orderstatus = 'F') AS \"n_F\", count(*) AS total FROM orders GROUP BY o_orderpriority")
def manual_queue_summary(spark, d):
    return ag.status_counts(fx.read(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), ["O", "F"], ["o_orderpriority"])


@query(
    "run_status_rollup",
    "WITH n AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'running' WHEN o_orderstatus = 'F' AND o_orderkey % 29 = 0 THEN 'timed_out' WHEN o_orderkey % 37 = 0 THEN 'pending' ELSE 'succeeded' END AS s, o_orderpriority IN ('1-URGENT', '2-HIGH') AS x FROM orders) "
    + "SELECT o_custkey, count(*) AS n_nodes, CASE WHEN bool_or(s = 'running') THEN CASE WHEN bool_or(o_orderkey % 8 = 0) THEN 'cancel_requested' ELSE 'running' END WHEN bool_or(s = 'pending') THEN 'retry_wait' WHEN bool_or(s = 'timed_out') THEN 'failed' WHEN NOT bool_or(x) THEN 'retry_wait' ELSE 'success' END AS status FROM n GROUP BY o_custkey",
)
def run_status_rollup(spark, d):
    """Orders as nodes of their customer's run; urgent ones are its exports."""
    k = F.col("o_orderkey")
    s = F.when((F.col("o_orderstatus") == "P") & (k % 4 == 0), "running").when((F.col("o_orderstatus") == "F") & (k % 29 == 0), "timed_out").when(k % 37 == 0, "pending").otherwise("succeeded")
    stage = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "export").otherwise("score")
    return ag.run_status_rollup(fx.read(spark, d, "orders").select("o_custkey", k.alias("node_id"), s.alias("status"), stage.alias("stage"), (k % 8 == 0).alias("asked")), ["o_custkey"], cancelling="asked")


@query("review_summary", fx.with_ctes(fx.OFFER) + "SELECT asin, count(*) FILTER (WHERE source_pos % 3 = 0) AS n_accepted, count(*) FILTER (WHERE source_pos % 3 = 1) AS n_rejected, count(*) FILTER (WHERE source_pos % 3 = 2) AS n_pending, count(*) AS total FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY source_pos) AS nth FROM offer) WHERE nth <= 5 GROUP BY asin")
def review_summary(spark, d):
    k = F.col("source_pos") % 3
    o = windows.top_per_key(fx.offers(spark, d), ["asin"], [F.asc("source_pos")], 5)
    return ag.status_counts(o.withColumn("status", F.when(k == 0, "accepted").when(k == 1, "rejected").otherwise("pending")), ["accepted", "rejected", "pending"], ["asin"])


@query("field_completeness", fx.with_ctes(fx.PRODUCT) + "SELECT field, n, filled, filled / n AS share FROM (SELECT unnest(['title', 'category', 'weight_kg']) AS field, count(*) AS n, unnest([count(title), count(category), count(weight_kg)]) AS filled FROM product)")
def field_completeness(spark, d):
    return ag.field_completeness(fx.products(spark, d), ["title", "category", "weight_kg"]).select("field", "n", "filled", "share")


@query("run_counters", fx.with_ctes(*PIPELINE) + "SELECT category, count(*) AS crawled, count(*) FILTER (WHERE n_offers > 0) AS matched, count(net_profit) AS calculated, 0::BIGINT AS duplicates_removed FROM scored GROUP BY category")
def run_counters(spark, d):
    return ag.run_counters(scored(spark, d), ["category"])


# --- sets, matching, decisions -------------------------------------------------------------------


@query("union_queue", fx.with_ctes(*PIPELINE) + "SELECT asin, CASE WHEN passed THEN 'accepted' WHEN total_score IS NULL THEN 'review' ELSE 'rejected' END AS route FROM scored")
def union_queue(spark, d):
    s = scored(spark, d).select("asin", "passed", "total_score")
    u = setops.union_queue(s.filter("passed"), s.filter("not passed and total_score is null"), s.filter("not passed and total_score is not null"))
    return u.select("asin", "route")


@query("match_quality", fx.with_ctes(fx.OFFER) + "SELECT asin, offer_id, " + half_up("(0.55::DOUBLE * (0.40::DOUBLE * match_quality_score + 0.60::DOUBLE * 0.45::DOUBLE) + 0.30::DOUBLE * (delivery_days / 60) + 0.15::DOUBLE * 0.45::DOUBLE) * greatest(0.45::DOUBLE, 1.0::DOUBLE - 0.15::DOUBLE * (source_pos % 3))", 4) + " AS score FROM offer")
def match_quality(spark, d):
    n = F.lit(None).cast("double")
    m = matching.match_quality(F.col("match_quality_score"), n, F.col("delivery_days") / 60, n, F.col("source_pos") % 3, F.lit(False))
    return fx.offers(spark, d).select("asin", "offer_id", m["score"].alias("score"))


_STATES = """st AS (
  SELECT asin, offer_id, match_quality_score AS spec, CASE source_pos % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE 1.0 END AS f, CASE source_pos % 7 WHEN 0 THEN 0.0 ELSE 1.0 END AS t, CASE WHEN base_price_cny > 20 THEN 1.0 END AS p, CASE WHEN moq <= 300 THEN 1.0 END AS m,
    CASE WHEN delivery_days > 40 THEN NULL WHEN delivery_days > 30 THEN 0.0 ELSE 1.0 END AS q, delivery_days % 2 = 0 AS wants, source = 'mock' AS seen_bad, fba_ready AS seen_good, is_factory IS NULL AS malformed, monthly_sales > 2000 AS hard FROM offer),
ev AS (SELECT *, list_filter([CASE WHEN t = 0 THEN 'accessory_full_product_conflict' END, CASE WHEN wants AND q = 0 THEN 'package_quantity_conflict' END, CASE WHEN f = 0 THEN 'core_function_conflict' END, CASE WHEN hard THEN 'specification_conflict:material' END, CASE WHEN seen_bad THEN 'visual_mismatch' END], lambda x: x IS NOT NULL) AS mis,
  list_sort(list_filter([CASE WHEN f IS NULL THEN 'function' END, CASE WHEN p IS NULL THEN 'price' END, CASE WHEN m IS NULL THEN 'moq' END, CASE WHEN wants AND q IS NULL THEN 'package_quantity' END, CASE WHEN malformed AND NOT seen_bad AND NOT seen_good THEN 'visual' END], lambda x: x IS NOT NULL)) AS lacks,
  (coalesce(f, 0) + t + coalesce(p, 0) + coalesce(m, 0) + CASE WHEN wants THEN coalesce(q, 0) ELSE 0 END + spec)::DOUBLE / (2 + (f IS NOT NULL)::INT + (p IS NOT NULL)::INT + (m IS NOT NULL)::INT + (wants AND q IS NOT NULL)::INT) AS mean FROM st),
de AS (SELECT *, CASE WHEN len(mis) > 0 THEN 'reject' WHEN list_contains(lacks, 'visual') THEN 'manual_review' WHEN len(lacks) > 0 THEN 'retry' WHEN mean >= 0.70 THEN 'keep' ELSE 'manual_review' END AS decision FROM ev)"""


@query(
    "match_evidence_decision",
    fx.with_ctes(fx.OFFER, _STATES) + "SELECT asin, offer_id, decision, " + half_up("greatest(0.0, least(1.0, CASE WHEN len(mis) = 0 AND len(lacks) > 0 THEN least(mean, 0.49::DOUBLE) ELSE mean END))", 4) + " AS confidence, array_to_string(mis, ',') AS mismatch, array_to_string(lacks, ',') AS missing FROM de",
)
def match_evidence_decision(spark, d):
    c, n = F.col, F.lit(None).cast("double")
    states = {
        "function": F.when(c("source_pos") % 5 == 0, n).when(c("source_pos") % 5 == 1, 0.0).otherwise(1.0), "product_type": F.when(c("source_pos") % 7 == 0, 0.0).otherwise(1.0), "price": F.when(c("base_price_cny") > 20, 1.0), "moq": F.when(c("moq") <= 300, 1.0),
        "package_quantity": F.when(c("delivery_days") > 40, n).when(c("delivery_days") > 30, 0.0).otherwise(1.0),
    }
    spec = F.struct(c("match_quality_score").alias("score"), F.when(c("monthly_sales") > 2000, F.array(F.lit("material"), F.lit("color"))).otherwise(none()).alias("conflicts"))
    seen = F.when(c("source") == "mock", F.lit(False)).when(c("fba_ready"), F.lit(True))
    m = matching.match_evidence(states, spec, visual_match=seen, malformed_visual=c("is_factory").isNull(), wants_quantity=c("delivery_days") % 2 == 0)
    return fx.offers(spark, d).select("asin", "offer_id", m.alias("m")).select("asin", "offer_id", "m.decision", "m.confidence", F.array_join("m.mismatch", ",").alias("mismatch"), F.array_join("m.missing", ",").alias("missing"))


@query("decision_brief", fx.with_ctes(*PIPELINE) + "SELECT asin, CASE WHEN passed THEN 'ready_to_sample' WHEN rejection <> '' THEN 'manual_verify' ELSE 'score_review' END AS action, CASE WHEN passed THEN 'high' ELSE 'medium' END AS confidence FROM scored")
def decision_brief(spark, d):
    c, true = F.col, F.lit(True)
    b = decisions.decision_brief({"passed": c("passed"), "reasons": c("rejection_reasons"), "margin": c("profit_margin"), "match": c("top_match"), "spec": F.lit(None).cast("double"), "missing": none(), "conflicts": none(), "has_supplier": true, "has_supplier_evidence": true, "has_market": true, "has_rich_market": true})
    return scored(spark, d).select("asin", b.alias("b")).select("asin", "b.action", "b.confidence")


@query("review_status", fx.with_ctes(*PIPELINE) + "SELECT asin, CASE WHEN top_match >= 0.8 AND passed THEN 'ready' ELSE 'needs_review' END AS status FROM scored")
def review_status(spark, d):
    return scored(spark, d).select("asin", decisions.review_status(F.lit(True), none(), none(), F.col("top_match"), F.col("passed")).alias("status"))


@query("recommendation", fx.with_ctes(*PIPELINE) + "SELECT asin, CASE WHEN total_score IS NULL THEN 'needs_manual_review' WHEN NOT passed THEN 'reject' ELSE 'recommend' END AS status FROM scored")
def recommendation(spark, d):
    c, true = F.col, F.lit(True)
    f = decisions.finalize(F.lit("needs_manual_review"), F.lit(1), c("total_score").isNotNull(), c("passed"), true, true, none(), c("rejection_reasons"), F.array(F.lit("calculate_profit")))
    return scored(spark, d).select("asin", f["status"].alias("status"))


@query("report_conclusion", fx.with_ctes(*PIPELINE) + "SELECT asin, CASE WHEN weight_kg IS NULL THEN 'manual_review' WHEN passed AND total_score >= 80 AND profit_margin >= 0.30 THEN 'recommend' WHEN NOT passed AND rejection <> '' THEN 'eliminate' ELSE 'hold' END AS conclusion, CASE WHEN weight_kg IS NULL THEN 'measure_and_recost' ELSE 'quote_and_sample' END AS steps FROM scored")
def report_conclusion(spark, d):
    c = F.col
    s = scored(spark, d).withColumn("gaps", decisions.data_gaps({"invalid": F.lit(False), "supplier": c("best_offer_id"), "url": c("best_offer_id"), "moq": c("best_moq"), "sales": c("est_monthly_sales"), "searches": c("search_volume_monthly"), "dimensions": c("weight_kg"), "risk_flags": F.array(F.lit("none"))}))
    return s.select("asin", decisions.conclusion(F.lit(False), c("gaps"), c("passed"), c("total_score"), c("profit_margin"), c("rejection_reasons")).alias("conclusion"), F.array_join(decisions.next_steps(c("gaps")), ",").alias("steps"))


@query("sourcing_quality", f"WITH {EXPORT_SQL} SELECT export_id, CASE WHEN count(*) FILTER (WHERE source = 'mock') > 0 THEN 'mock_review' WHEN count(*) FILTER (WHERE status = 'ready') / count(*)::DOUBLE >= 0.7 THEN 'ready' ELSE 'needs_review' END AS label FROM ex GROUP BY export_id")
def sourcing_quality(spark, d):
    a = exports(spark, d).groupBy("export_id").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "mock").alias("mock"), F.count_if(F.col("status") == "ready").alias("ready"))
    return a.select("export_id", decisions.sourcing_quality(F.col("n"), F.col("mock"), F.lit(0), F.lit(0), F.col("ready")).alias("label"))


# --- run events ----------------------------------------------------------------------------------


@query("event_timeline", "SELECT user_id, event_id, seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq <= 100")
def event_timeline(spark, d):
    return ev.timeline(events(spark, d), ["user_id"], 100).select("user_id", "event_id", F.col("seq").cast("long").alias("seq"))


@query("stage_progress", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, count(*) AS n_events FROM events GROUP BY user_id")
def stage_progress(spark, d):
    return ev.stage_progress(events(spark, d), ["user_id"]).select("user_id", "stage", "n_events")


@query("events_per_window", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL")
def events_per_window(spark, d):
    return ev.per_window(events(spark, d), "1 hour").select(F.unix_timestamp("start").alias("start"), "event_type", "n", "total")


@query("run_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) // 1000 AS start, count(*) AS n_events FROM s GROUP BY user_id, k")
def run_sessions(spark, d):
    return ev.sessions(events(spark, d), ["user_id"], "30 minutes").select("user_id", F.unix_millis("start").alias("start"), "n_events")


@query("stale_detection", "WITH g AS (SELECT *, epoch_us(lead(ts) OVER w) // 1000 - epoch_us(ts) // 1000 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3 THEN 'retry_wait' ELSE 'failed' END AS status FROM g WHERE gap > 43200000")
def stale_detection(spark, d):
    return ev.stale_batch(events(spark, d), ["user_id"], 43200).select("user_id", "event_id", F.col("attempt").cast("long").alias("attempt"), "status")


@query("dedupe_events", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def dedupe_events(spark, d):
    return ev.dedupe_batch(events(spark, d), ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("ttl_state", "SELECT user_id, event_type FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id) WHERE floor(epoch(TIMESTAMP '2024-01-30 00:00:00'))::BIGINT - floor(epoch(ts))::BIGINT BETWEEN 0 AND 86400")
def ttl_state(spark, d):
    return ev.ttl_state(events(spark, d), ["user_id"], 86400, "2024-01-30 00:00:00").select("user_id", "event_type")


_legal = " OR ".join(f"(before = '{b}' AND event_type IN ({', '.join(repr(a) for a in after)}))" for b, after in ev.TRANSITIONS.items())


