"""Writers: nested and flat candidates, shortlists, idempotent appends, upserts, scoped replacement, manifests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import BUCKETS, append_new, replace_scopes


def nested_candidates(products: DataFrame, offers: DataFrame, most: int = 10) -> DataFrame:
    """One record per candidate with its first offers by rank."""
    fields = [c for c in offers.columns if c not in ("asin", "offer_rank")]
    lists = offers.filter(F.col("offer_rank") <= most).groupBy("asin").agg(F.array_sort(F.collect_list(F.struct("offer_rank", *fields))).alias("suppliers"))
    out = products.join(lists, "asin", "left")
    return out.withColumns({c: F.round(c, 4) for c in ("net_profit", "profit_margin") if c in out.columns})


def write_candidates_json(products: DataFrame, offers: DataFrame, path: str) -> None:
    nested_candidates(products, offers).write.mode("overwrite").json(path)


def flat_candidates(nested: DataFrame) -> DataFrame:
    """One flat row per candidate: its own columns, the top offer's, and nested lists as JSON."""
    top = F.get("suppliers", 0)
    own = [c for c in nested.columns if c != "suppliers"]
    element = nested.schema["suppliers"].dataType.elementType.names
    return nested.select(*own, *[top[n].alias(f"top_{n}") for n in element], F.coalesce(F.size("suppliers"), F.lit(0)).alias("n_suppliers"), F.to_json("suppliers").alias("suppliers_json"))


#: Headers of the flat export and the column or expression under each, in order (fixed values). ``top.`` is the first offer.
EXPORT_COLUMNS = (
    ("ASIN", "asin"), ("标题", "title"), ("品牌", "brand"), ("类目", "category"), ("售价($)", "price"), ("BSR排名", "bsr_rank"), ("评分", "rating"), ("评论数", "review_count"),
    ("综合评分", "round(total_score, 1)"), ("利润率", "CASE WHEN profit_margin IS NOT NULL THEN format_string('%.1f%%', profit_margin * 100) END"), ("净利润($)", "round(net_profit, 2)"),
    ("利润得分", "round(profit_score, 3)"), ("需求得分", "round(demand_score, 3)"), ("竞争得分", "round(competition_score, 3)"), ("供应得分", "round(supply_score, 3)"), ("物流得分", "round(logistics_score, 3)"), ("风险得分", "round(risk_score, 3)"),
    ("采购成本($)", "round(purchase_cost, 2)"), ("头程($)", "round(shipping_cost, 2)"), ("FBA费($)", "round(fba_fee, 2)"), ("佣金($)", "round(commission, 2)"), ("广告费($)", "round(ad_cost, 2)"), ("退货损耗($)", "round(return_loss, 2)"),
    ("供应商数", "coalesce(size(suppliers), 0)"), ("Top1供应商", "top.supplier"), ("Top1货源链接", "top.offer_url"), ("Top1采购价(CNY)", "top.base_price_cny"), ("Top1 MOQ", "top.moq"),
    ("Top1来源", "top.source"), ("Top1视觉相似", "round(top.image_similarity, 3)"), ("Top1匹配分", "round(top.match_quality_score, 3)"), ("Top1候选分", "top.candidate_score"), ("Top1供应商质量分", "top.quality_score"), ("Top1业务条件分", "top.business_score"),
    ("通过筛选", "CASE WHEN passed THEN '✓' ELSE '✗' END"), ("审核状态", "review_status"), ("拒绝原因", "array_join(rejection_reasons, ', ')"),
    ("Schema版本", "schema_version"), ("Run Ref", "run_ref"), ("查询计划与命中率", "to_json(query_plan)"), ("匹配证据", "to_json(match_evidence)"), ("推荐状态", "recommendation_status"),
    ("推荐原因", "to_json(recommendation_reasons)"), ("证据拒绝原因", "to_json(evidence_rejection_reasons)"), ("人工核验任务", "to_json(manual_verification_tasks)"),
)
_NAME = re.compile(r"\b(?:top\.)?(?!round|format_string|coalesce|size|array_join|to_json|CASE|WHEN|THEN|ELSE|END)[a-z][a-z_0-9]*")


def export_rows(candidates: DataFrame) -> DataFrame:
    """The 45 columns of the flat export, one row per candidate; cells whose column the table does not have are null."""
    offers = candidates.schema["suppliers"].dataType.elementType.names if "suppliers" in candidates.columns else []
    known = {c.lower() for c in candidates.columns} | {f"top.{n}".lower() for n in offers}
    staged = candidates.withColumn("top", F.get("suppliers", F.lit(0))) if offers else candidates
    bare = lambda e: re.sub(r"'[^']*'", "", e)
    there = lambda e: all(n.lower() in known for n in _NAME.findall(bare(e)))
    return staged.select(*[(F.expr(e) if there(e) else F.lit(None).cast("string")).alias(header) for header, e in EXPORT_COLUMNS])


def write_candidates_flat(nested: DataFrame, path: str, fmt: str = "parquet") -> None:
    flat_candidates(nested).write.mode("overwrite").format(fmt).save(path)


def write_seller_shortlist(shortlist: DataFrame, path: str) -> None:
    """Eligible and excluded sellers as partitions of one table, and the counts beside it."""
    shortlist.write.mode("overwrite").partitionBy("excluded").parquet(f"{path}/sellers")
    shortlist.groupBy("fit_category").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/summary")


def new_rows(rows: DataFrame, existing: DataFrame, key: str = "result_key") -> DataFrame:
    """Rows whose key is not in the table yet, one per key."""
    return rows.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def append_snapshot(rows: DataFrame, path: str, key: str = "result_key", buckets: int = BUCKETS) -> DataFrame:
    """Append that can be repeated: rows already there are skipped. The table lies in hash buckets of the key, and only those that the rows fall into are read. Gives back the plan of the rows appended."""
    return append_new(rows, path, key, buckets)


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str], keep_old_when_empty: tuple[str, ...] = ()) -> DataFrame:
    """Merged rows: updates win, except that named text columns keep the old value where the new one is empty."""
    old, new = existing.alias("o"), updates.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = old.join(new, on, "full_outer")
    hit = F.col(f"n.{keys[0]}").isNotNull()
    out = []
    for c in existing.columns:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            out.append(F.coalesce(n, o).alias(c))
        elif c in keep_old_when_empty:
            out.append(F.coalesce(F.when(n != "", n), o).alias(c))
        else:
            out.append(F.when(hit, n).otherwise(o).alias(c))
    return joined.select(*out)


def offer_key(offer_id: str = "offer_id", url: str = "offer_url"):
    """Offer id, else its URL, else 'unknown'."""
    return F.coalesce(F.nullif(F.trim(F.col(offer_id)), F.lit("")), F.nullif(F.trim(F.col(url)), F.lit("")), F.lit("unknown"))


def replace_scope(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with all rows of the given scopes replaced."""
    return existing.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def write_scope(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``replace_scope`` on a table in hash buckets of the scope: only the touched buckets are read and overwritten."""
    return replace_scopes(rows, path, keys, buckets)


def manifest_verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per set, whether every listed file is there with its size and hash. files: path, content."""
    have = files.select("path", F.length("content").cast("long").alias("have_size"), F.sha2(F.col("content").cast("binary"), 256).alias("have_sha256"))
    ok = F.coalesce((F.col("size") == F.col("have_size")) & (F.col("sha256") == F.col("have_sha256")), F.lit(False))
    return manifest.join(have, "path", "left").groupBy("set_id").agg(F.bool_and(ok).alias("committed"), F.count("*").alias("n_files"), F.count_if(~ok).alias("n_bad"))


def import_manifest(rows: DataFrame, file: str = "source_file") -> DataFrame:
    """One row per imported file: rows and a hash over its rows that does not depend on their order."""
    line = F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c not in (file, "source_pos")])), 256)
    return rows.withColumn("_line", line).groupBy(file).agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(F.array_sort(F.collect_set("_line")), ""), 256).alias("sha256"))
