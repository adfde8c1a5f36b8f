"""Queries over normalisation, predicates, sources, sinks and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nm
from ..functions import predicates as pr
from ..functions import supplier
from ..operators import containment, joins, keywords, matching, setops, specs, text
from ..sources import writers
from . import fixtures as fx
from .queries import half_up, query

AS_OF = "2024-02-01 00:00:00"


def events(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("normalize_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def normalize_date(spark, d):
    k = F.col("o_orderkey") % 4
    cell = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy/M/d")).when(k == 2, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.lit("soon"))
    return fx.read(spark, d, "orders").select("o_orderkey", nm.date(cell).cast("string").alias("day"))


@query("positive_number", "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_discount END AS v FROM lineitem")
def positive_number(spark, d):
    from ..functions.cost import positive

    return fx.read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", positive(F.col("l_discount")).alias("v"))


@query("validate_asin", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN 'B0' || lpad(p_partkey::VARCHAR, 8, '0') END AS asin FROM part")
def validate_asin(spark, d):
    raw = F.concat(F.lit(" b0"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.when(F.col("p_partkey") % 4 == 0, F.lit("-x")).otherwise(F.lit("")))
    return fx.read(spark, d, "part").select("p_partkey", nm.asin(raw).alias("asin"))


@query("attach_source_metadata", "SELECT p_partkey, 'bestsellers' AS source_mode, p_type AS source_query, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1 ELSE p_partkey END AS source_rank FROM part")
def attach_source_metadata(spark, d):
    p = fx.read(spark, d, "part").withColumn("bsr_rank", F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") + 1)).withColumn("source_pos", F.col("p_partkey"))
    return nm.source_metadata(p, "bestsellers", F.col("p_type")).select("p_partkey", "source_mode", "source_query", "source_rank")


@query("canonical_category", fx.with_ctes(fx.PRODUCT) + "SELECT asin, category AS canonical, category IS NULL AS is_error FROM product")
def canonical_category(spark, d):
    rows = F.array(*[F.struct(F.lit(k.lower()).alias("alias"), F.lit(v).alias("canonical")) for k, v in fx.CATEGORIES.items()])
    aliases = spark.range(1).select(F.inline(rows))
    p = fx.read(spark, d, "part").select(F.concat(F.lit("B0"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("asin"), F.lower("p_type").alias("alias"))
    return p.join(aliases, "alias", "left").select("asin", "canonical", F.col("canonical").isNull().alias("is_error"))


@query("public_keyword_rows", "SELECT user_id, nth, '{\"event_type\":\"' || event_type || '\"' || CASE WHEN value > 50 THEN ',\"value\":' || value::VARCHAR ELSE '' END || '}' AS row FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events) WHERE nth <= 20")
def public_keyword_rows(spark, d):
    e = events(spark, d).withColumn("value", F.when(F.col("value") > 50, F.col("value"))).withColumn("source_pos", F.col("event_id"))
    return nm.public_rows(e, ["event_type", "value"], ["user_id"]).select("user_id", F.col("nth").cast("long").alias("nth"), "row")


LEGACY_SQL = "legacy AS (SELECT event_id, (event_id % 13) / 10 AS confidence, event_id % 4 AS result_count, CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS status FROM events)"


def legacy(spark, d):
    i = F.col("event_id")
    return events(spark, d).select("event_id", ((i % 13) / 10).alias("confidence"), (i % 4).alias("result_count"), F.when(i % 2 == 0, "completed").otherwise("failed").alias("status"))


@query("repair_evidence", f"WITH {LEGACY_SQL} SELECT event_id, CASE WHEN confidence > 0 AND confidence <= 1 THEN confidence END AS confidence, CASE WHEN result_count > 0 THEN result_count END AS result_count, CASE WHEN result_count <= 0 AND status = 'completed' THEN 'partial' ELSE status END AS status FROM legacy")
def repair_evidence(spark, d):
    return nm.repair_evidence(legacy(spark, d), "event_id")[0].select("event_id", "confidence", "result_count", "status")


@query("repair_evidence_audit", f"WITH {LEGACY_SQL} SELECT field, count(*) AS n FROM (SELECT 'confidence' AS field FROM legacy WHERE NOT (confidence > 0 AND confidence <= 1) UNION ALL SELECT 'result_count' FROM legacy WHERE result_count <= 0 UNION ALL SELECT 'status' FROM legacy WHERE result_count <= 0 AND status = 'completed') GROUP BY field")
def repair_evidence_audit(spark, d):
    return nm.repair_evidence(legacy(spark, d), "event_id")[1].groupBy("field").agg(F.count("*").alias("n"))


# --- predicates ----------------------------------------------------------------------------------

EVIDENCE_SQL = """ev AS (SELECT doc_id, source, text, quality, toxic, CASE WHEN quality = 1 THEN 'extracted' ELSE 'missing' END AS status, (doc_id % 11) / 10 AS confidence,
  TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 40)::INT) AS observed_at, CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' END AS expires_at FROM labels JOIN documents USING (doc_id))"""


def evidence(spark, d):
    i = F.col("doc_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    docs = fx.read(spark, d, "documents").select("doc_id", "source")
    return fx.read(spark, d, "labels").join(docs, "doc_id").select(
        "doc_id", "source", "quality", "toxic", F.when(F.col("quality") == 1, "extracted").otherwise("missing").alias("status"), F.lit("x").alias("value"), F.col("source").alias("source_type"), F.col("source").alias("source_ref"),
        F.lit(None).cast("string").alias("artifact_hash"), ((i % 11) / 10).alias("confidence"), F.timestamp_seconds(F.unix_timestamp(start) + (i % 40) * 86400).alias("observed_at"),
        F.when(i % 5 == 0, F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("expires_at"),
    )


@query("trusted_evidence", f"WITH {EVIDENCE_SQL} SELECT doc_id, status = 'extracted' AND confidence >= 0.5 AND observed_at <= TIMESTAMP '{AS_OF}' + INTERVAL 5 MINUTE AND observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}') AS trusted, CASE WHEN expires_at <= TIMESTAMP '{AS_OF}' THEN 'stale' ELSE status END AS status FROM ev")
def trusted_evidence(spark, d):
    at = F.lit(AS_OF).cast("timestamp")
    return evidence(spark, d).select("doc_id", pr.trusted_evidence(at).alias("trusted"), pr.effective_status(F.col("status"), F.col("expires_at"), at).alias("status"))


@query("critical_evidence_gaps", f"WITH {EVIDENCE_SQL} SELECT doc_id, concat_ws(',', CASE WHEN status <> 'extracted' THEN 'quality:' || status WHEN confidence < 0.5 THEN 'quality:untrusted' END, 'toxicity:missing') AS gaps FROM ev")
def critical_evidence_gaps(spark, d):
    e = evidence(spark, d).select("doc_id", F.lit("quality").alias("field_name"), "status", (F.col("confidence") >= 0.5).alias("trusted"))
    return setops.evidence_gaps(e.select("doc_id"), e, "doc_id", ["quality", "toxicity"]).select("doc_id", F.array_join("gaps", ",").alias("gaps"))


@query("ttl_fresh", f"SELECT event_id, epoch(TIMESTAMP '{AS_OF}')::BIGINT - floor(epoch(ts))::BIGINT <= 864000 AND user_id % 4 <> 0 AND event_type <> 'error' AS fresh FROM events")
def ttl_fresh(spark, d):
    f = pr.ttl_fresh(F.col("ts"), 864000, F.lit(AS_OF).cast("timestamp"), F.when(F.col("user_id") % 4 == 0, "v1").otherwise("v2"), "v2", F.col("event_type") == "error")
    return events(spark, d).select("event_id", f.alias("fresh"))


@query("title_anchor_match", "SELECT p_partkey, len(list_filter(['red', 'bolt'], lambda w: list_contains(string_split(p_name, ' '), w))) >= 2 AS hit FROM part")
def title_anchor_match(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", pr.title_anchor_match(F.lit("the red bolt"), F.col("p_name")).alias("hit"))


@query("offer_relevant", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 2 = 0 WHEN p_partkey % 7 = 1 THEN p_size / 50 >= 0.5 ELSE p_name LIKE '%red%' AND p_name LIKE '%bolt%' END AS relevant FROM part")
def offer_relevant(spark, d):
    k = F.col("p_partkey") % 7
    none = F.lit(None).cast("double")
    rel = pr.offer_relevant(F.when(k == 0, F.col("p_partkey") % 2 == 0), F.when(k == 1, F.col("p_size") / 50), none, none, F.lit(False), F.lit("red bolt"), F.col("p_name"))
    return fx.read(spark, d, "part").select("p_partkey", rel.alias("relevant"))


@query("mock_predicates", fx.with_ctes(fx.OFFER) + "SELECT asin, offer_id, source = 'mock' AS by_source, source = 'mock' OR source_pos % 13 = 0 AS by_method, source_pos % 6 = 0 AS by_id, source = 'mock' OR source_pos % 13 = 0 OR source_pos % 6 = 0 AS invalid, NOT (source_pos % 6 = 0) AND match_quality_score > 0.40 AS reusable FROM offer")
def mock_predicates(spark, d):
    o = fx.offers(spark, d).withColumn("raw_id", F.when(F.col("source_pos") % 6 == 0, F.concat(F.lit("x"), "offer_id")).otherwise(F.col("offer_id"))).withColumn("method", F.when(F.col("source_pos") % 13 == 0, "mock").otherwise("text"))
    c = F.col
    return o.select("asin", "offer_id", pr.mock_by_source(c("source")).alias("by_source"), pr.mock_by_method(c("source"), c("method")).alias("by_method"), pr.mock_by_id(c("raw_id")).alias("by_id"), pr.invalid_for_decision(c("source"), c("method"), c("raw_id")).alias("invalid"), supplier.reusable_offer(c("raw_id"), F.lit(False), c("match_quality_score")).alias("reusable"))


@query("needs_detail_enrichment", fx.with_ctes(fx.OFFER) + "SELECT asin, offer_id FROM (SELECT *, row_number() OVER (PARTITION BY asin ORDER BY source_pos) AS nth FROM offer WHERE source <> 'mock' AND is_factory IS NULL) WHERE nth <= 3")
def needs_detail_enrichment(spark, d):
    from ..operators.windows import top_per_key

    o = fx.offers(spark, d).filter(pr.needs_detail(F.col("source") == "mock", F.lit(True), F.col("moq"), F.col("delivery_days"), F.col("is_factory")))
    return top_per_key(o, ["asin"], [F.asc("source_pos")], 3).select("asin", "offer_id")


@query("visual_check_eligible", fx.with_ctes(fx.OFFER) + "SELECT asin, offer_id FROM offer WHERE fba_ready AND match_quality_score >= 0.55 AND delivery_days / 60 >= 0.5 AND source <> 'mock'")
def visual_check_eligible(spark, d):
    conflicts = F.when(F.col("source") == "mock", F.array(F.lit("material"))).otherwise(F.array().cast("array<string>"))
    return fx.offers(spark, d).filter(pr.visual_check_eligible(F.col("fba_ready"), F.col("match_quality_score"), F.col("delivery_days") / 60, conflicts)).select("asin", "offer_id")


_KIND = "CASE WHEN regexp_matches(lower(html), 'captcha|robot check|enter the characters') THEN 'captcha' WHEN regexp_matches(lower(html), 'no results for|did not match any') THEN 'no_results' WHEN lower(html) LIKE '%<article%' OR lower(html) LIKE '%data-asin=%' THEN 'results_detected' ELSE 'unexpected' END"
_BLOCKED = "CASE " + " ".join(f"WHEN regexp_matches(lower(html), '{'|'.join(words)}') THEN '{code}'" for code, words in pr.BLOCK_WORDS.items()) + " END"


@query("search_page_kind", f"SELECT page_id, {_KIND} AS kind, {_BLOCKED} AS block_code FROM (SELECT page_id, html || CASE page_id % 7 WHEN 0 THEN ' Sign In' WHEN 1 THEN ' 滑块' WHEN 2 THEN ' Rate Limit' ELSE '' END AS html FROM pages)")
def search_page_kind(spark, d):
    k = F.col("page_id") % 7
    html = F.concat("html", F.when(k == 0, " Sign In").when(k == 1, " 滑块").when(k == 2, " Rate Limit").otherwise(""))
    return fx.read(spark, d, "pages").select("page_id", pr.search_page_kind(html).alias("kind"), pr.page_block_code(html).alias("block_code"))


# --- sources and sinks ---------------------------------------------------------------------------


@query("read_event_props", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def read_event_props(spark, d):
    return events(spark, d).select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("extract_links", "SELECT page_id, (generate_subscripts(l, 1) - 1)::INT AS rank, unnest(l) AS link FROM (SELECT page_id, list_distinct(x) AS u, list_filter(x, lambda e, i: list_position(x, e) = i) AS l FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"/([^\"]*)\"', 1) AS x FROM pages))")
def extract_links(spark, d):
    return text.extract_links(fx.read(spark, d, "pages"), ["page_id"], "html", '<a href="/([^"]*)"')


@query("append_snapshot", "SELECT o_orderkey AS result_key FROM orders WHERE o_orderstatus <> 'F'")
def append_snapshot(spark, d):
    o = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("result_key"), "o_orderstatus")
    return writers.new_rows(o, o.filter("o_orderstatus = 'F'")).select("result_key")


@query("upsert_products", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN upper(p_name) ELSE p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS price FROM part")
def upsert_products(spark, d):
    p = fx.read(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    new = p.filter("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.upper("title")).alias("title"), (F.col("price") * 2).alias("price"))
    return writers.upsert(p, new, ["p_partkey"], ("title",))


@query("replace_scope", "SELECT p_brand, p_partkey, CASE WHEN p_brand = 'Brand#2' THEN 'new' ELSE 'old' END AS state FROM part WHERE p_brand <> 'Brand#2' OR p_partkey % 2 = 0")
def replace_scope(spark, d):
    p = fx.read(spark, d, "part").select("p_brand", "p_partkey")
    return writers.replace_scope(p.withColumn("state", F.lit("old")), p.filter("p_brand = 'Brand#2' and p_partkey % 2 = 0").withColumn("state", F.lit("new")), ["p_brand"])


@query("manifest_verify", "SELECT lang AS set_id, NOT bool_or(doc_id % 97 = 0) AS committed, count(*) AS n_files, count(*) FILTER (WHERE doc_id % 97 = 0) AS n_bad FROM documents GROUP BY lang")
def manifest_verify(spark, d):
    docs = fx.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), "lang", "doc_id")
    m = docs.select("path", F.col("lang").alias("set_id"), F.octet_length("content").cast("long").alias("size"), F.sha2(F.when(F.col("doc_id") % 97 == 0, F.lit(b"x")).otherwise(F.col("content")), 256).alias("sha256"))
    return writers.manifest_verify(m, docs.select("path", "content"))


@query("import_manifest", "SELECT event_type AS source_file, count(*) AS n_rows, sha256(string_agg(DISTINCT h, '' ORDER BY h)) AS sha256 FROM (SELECT event_type, sha256('{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}') AS h FROM events) GROUP BY event_type")
def import_manifest(spark, d):
    return writers.import_manifest(events(spark, d).select("event_id", "user_id", F.col("event_type").alias("source_file"))).select("source_file", "n_rows", "sha256")


# --- text to features ----------------------------------------------------------------------------


_GOODS = {"STANDARD": ("water bottle", "保温杯", "capacity_ml"), "SMALL": ("ant bait", "灭蚁用品", None), "ECONOMY": ("yoga mat", "瑜伽垫", None), "MEDIUM": ("deck box", "户外储物", None)}
_pick = lambda i: "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in _GOODS.items()) + " END"


@query(
    "extract_specs",
    f"SELECT p_partkey, {_pick(1)} AS category, CASE p_size % 3 WHEN 0 THEN '不锈钢' WHEN 1 THEN '塑料' ELSE '木' END AS material, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN '红色' WHEN 'blue' THEN '蓝色' WHEN 'green' THEN '绿色' END AS color, "
    + half_up("CASE p_size % 2 WHEN 0 THEN p_size * 29.5735::DOUBLE ELSE p_size * 1000::DOUBLE END", 1)
    + " AS capacity_ml, CASE p_size % 4 WHEN 0 THEN 3 ELSE p_size END AS pack_count, "
    + half_up("CASE p_size % 2 WHEN 0 THEN p_size * 28.3495::DOUBLE END", 1)
    + " AS weight_g, "
    + half_up("p_size * 2.54::DOUBLE", 2)
    + " AS first_side, CASE WHEN p_size > 25 THEN '防水,可上锁' ELSE '' END AS features FROM part",
)
def extract_specs(spark, d):
    c, s = F.col, F.col("p_size").cast("string")
    goods = F.coalesce(*[F.when(c("p_type") == k, F.lit(v[0])) for k, v in _GOODS.items()], F.lit("thing"))
    made = F.when(c("p_size") % 3 == 0, "304").when(c("p_size") % 3 == 1, "PP").otherwise("teak")
    held = F.when(c("p_size") % 2 == 0, F.concat(s, F.lit("oz"))).otherwise(F.concat(s, F.lit(" L")))
    pack = F.when(c("p_size") % 4 == 0, F.lit("三支装")).otherwise(F.concat(F.lit("pack of "), s))
    p = fx.read(spark, d, "part").withColumn("t", F.concat_ws(", ", "p_name", goods, made, held, pack, F.concat(s, F.lit(" x 4 x 5 inches")), F.when(c("p_size") > 25, F.lit("Waterproof lockable"))))
    return specs.extract_specs(p, "t").select("p_partkey", *[f"spec.{n}" for n in ("category", "material", "color", "capacity_ml", "pack_count", "weight_g")], F.get("spec.dimensions_cm", F.lit(0)).alias("first_side"), F.array_join("spec.features", ",").alias("features"))


@query("remove_brand_terms", "SELECT p_partkey, p_name || ' kit' AS clean, true AS had_brand FROM part")
def remove_brand_terms(spark, d):
    t, b = F.concat("p_name", F.lit(" by "), "p_brand", F.lit(" kit")), text.brand_tokens(F.concat(F.lit("by "), "p_brand"))
    return fx.read(spark, d, "part").select("p_partkey", text.remove_brand_terms(t, b).alias("clean"), text.contains_brand(t, b).alias("had_brand"))


_WANTED = {"STANDARD": ("Stainless Steel Insulated Water Bottle", "不锈钢水杯,水杯,不锈钢"), "SMALL": ("Plastic Yoga Mat", "塑料瑜伽垫,瑜伽垫,塑料"), "ECONOMY": ("Deck Box waterproof", "户外储物箱,防水"), "MEDIUM": ("Ant Bait Station", "灭蚁饵剂")}
_of = lambda i, other: "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in _WANTED.items()) + f" ELSE {other} END"


@query(
    "search_keywords",
    f"WITH t AS (SELECT *, {_of(0, 'p_name')} AS goods, {_of(1, repr(''))} AS rules FROM part), u AS (SELECT *, goods || ' ' || p_size || 'oz, pack of ' || p_size AS title, CASE p_type WHEN 'STANDARD' THEN '不锈钢保温杯,保温杯,水杯,不锈钢' ELSE rules END AS named FROM t), "
    + "w AS (SELECT *, list_filter(list_transform(string_split(title, ' '), lambda x: trim(x, ' ,;:/()[]')), lambda x: x <> '') AS ws FROM u) "
    + "SELECT p_partkey, array_to_string(list_filter(list_concat(CASE WHEN named = '' THEN []::VARCHAR[] ELSE string_split(named, ',') END, CASE WHEN array_to_string(ws[:8], ' ') = array_to_string(ws[:3], ' ') THEN [array_to_string(ws[:3], ' ')] "
    + "WHEN array_to_string(ws[:8], ' ') = array_to_string(ws[:7], ' ') THEN [array_to_string(ws[:8], ' '), array_to_string(ws[:3], ' ')] ELSE [array_to_string(ws[:8], ' '), array_to_string(ws[:7], ' '), array_to_string(ws[:3], ' ')] END), lambda x: x <> ''), '|') AS words, "
    + "CASE WHEN p_size * 29.5735 < 50 THEN '' WHEN p_size * 29.5735 >= 1000 THEN printf('%.1fL', p_size * 29.5735 / 1000) || '|大容量' ELSE printf('%.0fml', p_size * 29.5735) || CASE WHEN p_size * 29.5735 >= 500 THEN '|大容量' WHEN p_size * 29.5735 <= 200 THEN '|小容量' ELSE '' END END AS capacity, "
    + "p_size || CASE p_type WHEN 'MEDIUM' THEN '盒装' ELSE '个装' END AS pack FROM w",
)
def search_keywords(spark, d):
    goods = F.coalesce(*[F.when(F.col("p_type") == k, F.lit(v[0])) for k, v in _WANTED.items()], F.col("p_name"))
    s = F.col("p_size").cast("string")
    title = F.concat(goods, F.lit(" "), s, F.lit("oz, pack of "), s)
    p = fx.read(spark, d, "part").withColumn("words", keywords.title_keywords(title)).withColumn("sizes", keywords.dimension_keywords(title))
    return p.select("p_partkey", F.array_join("words", "|").alias("words"), F.array_join(F.slice("sizes", 1, F.size("sizes") - 1), "|").alias("capacity"), F.element_at("sizes", -1).alias("pack"))


@query("core_keywords", "SELECT p_partkey, CASE WHEN p_name LIKE '%bolt%' THEN CASE WHEN p_name LIKE '%red%' THEN 'bolt,red bolt' ELSE 'bolt' END WHEN p_name LIKE '%gear%' THEN CASE WHEN p_name LIKE '%red%' THEN 'gear,red gear' ELSE 'gear' END ELSE '' END AS words FROM part")
def core_keywords(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", F.array_join(text.search_keywords(F.col("p_name"), ("bolt", "gear"), ("red",)), ",").alias("words"))


@query("title_match_score", "SELECT p_partkey, CASE WHEN p_name LIKE '%bolt%' THEN 1.0 ELSE (CASE WHEN h >= 2 THEN h / 3 ELSE 0 END) END::DOUBLE AS score FROM (SELECT *, len(list_filter(['bo', 'ol', 'lt'], lambda g: contains(p_name, g))) AS h FROM part)")
def title_match_score(spark, d):
    return fx.read(spark, d, "part").select("p_partkey", text.title_match_score(F.col("p_name"), F.array(F.lit("bolt"))).alias("score"))


@query("colour_match", "SELECT p_partkey, CASE WHEN p_name LIKE 'red %' THEN true ELSE false END AS same FROM part")
def colour_match(spark, d):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    return fx.read(spark, d, "part").select("p_partkey", matching.same(matching.alias_group(first, matching.COLOURS), matching.alias_group(F.lit("红色"), matching.COLOURS)).alias("same"))


@query("extract_reasons", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '[\"r' || turn::VARCHAR || ' }\"]' END AS reasons FROM conversations")
def extract_reasons(spark, d):
    """Reasons behind another object and beside values that are nested as deep as the turn says."""
    n = F.col("turn").cast("int") + 2
    deep = F.concat(F.repeat(F.lit('{"x": '), n), F.lit('"{"'), F.repeat(F.lit("}"), n))
    body = F.concat(F.lit('note {"a": 1} then '), F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"deep": '), deep, F.lit(', "reasons": ["r'), F.col("turn").cast("string"), F.lit(' }"]} end'))).otherwise(F.lit("nothing {")))
    return fx.read(spark, d, "conversations").select("conv_id", "turn", text.extract_reasons(body).alias("reasons"))


@query("flatten_attributes", "SELECT p_partkey, 'brand: ' || p_brand || chr(10) || 'type: ' || p_type AS lines FROM part")
def flatten_attributes(spark, d):
    body = F.to_json(F.array(F.struct(F.lit("brand").alias("name"), F.col("p_brand").alias("value")), F.struct(F.lit("type").alias("name"), F.col("p_type").alias("value"))))
    return fx.read(spark, d, "part").select("p_partkey", text.flatten_attributes(body).alias("lines"))


_GROUPS = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, group in enumerate(containment.ALIASES) for t in group) + ") AS a(g, term)"


@query(
    "imported_offer_match",
    "WITH kw AS (SELECT p_brand || ' ' || p_type AS key, unnest(list_concat(string_split(min(p_name), ' '), ['the', CASE p_type WHEN 'SMALL' THEN '保温杯' WHEN 'LARGE' THEN '铝' WHEN 'MEDIUM' THEN 'Bottle' ELSE 'Que' END])) AS w FROM part GROUP BY p_brand, p_type), "
    + f"al AS (SELECT * FROM {_GROUPS}), grp AS (SELECT DISTINCT key, g FROM kw, al WHERE contains(lower(w), lower(term)) OR contains(lower(term), lower(w))), "
    + "ex AS (SELECT DISTINCT key, w FROM kw UNION SELECT key, term FROM grp JOIN al USING (g)), "
    + "doc AS (SELECT doc_id, lower(text || ' ' || lang || CASE doc_id % 9 WHEN 0 THEN ' 不锈钢保温杯' WHEN 1 THEN ' 铝' WHEN 2 THEN ' Vacuum Bottle' ELSE '' END) AS t FROM documents), "
    + "sc AS (SELECT key, doc_id, count(*) AS score FROM ex JOIN doc ON contains(t, lower(w)) GROUP BY ALL) "
    + "SELECT key, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id % 100 DESC, doc_id) AS rank FROM sc) WHERE rank <= 20",
)
def imported_offer_match(spark, d):
    """Documents as offers and the goods of each brand and type as keys; one word is in nearly every text."""
    c = F.col
    extra = F.when(c("p_type") == "SMALL", "保温杯").when(c("p_type") == "LARGE", "铝").when(c("p_type") == "MEDIUM", "Bottle").otherwise("Que")
    keys = fx.read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_name").alias("name")).select(F.concat_ws(" ", "p_brand", "p_type").alias("key"), F.concat(F.split("name", " "), F.array(F.lit("the"), extra)).alias("words"))
    k = c("doc_id") % 9
    tail = F.when(k == 0, " 不锈钢保温杯").when(k == 1, " 铝").when(k == 2, " Vacuum Bottle").otherwise("")
    docs = fx.read(spark, d, "documents").select("doc_id", "text", F.concat("lang", tail).alias("more"), (c("doc_id") % 100).alias("at"))
    m = containment.imported_offer_match(docs, keys, "doc_id", ("text", "more"), "at")
    return m.withColumn("rank", c("rank").cast("long"))


@query("similar_offers", "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS sim FROM q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s WHERE sim >= 0.2) SELECT query_id, id, round(sim, 9) AS similarity, rank FROM r WHERE rank <= 20")
def similar_offers(spark, d):
    v = fx.read(spark, d, "embeddings")
    s = joins.similar_vectors(v, v.filter("vec_id % 50 = 0"), least=0.2)
    return s.select("query_id", "id", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("long").alias("rank"))
