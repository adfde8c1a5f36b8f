"""Joins by relational kind: lookups, as-of, band, latest row, anti, containment and similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import first_per_key, top_per_key


def product_offers(products: DataFrame, offers: DataFrame, keys: list[str] | None = None, how: str = "left") -> DataFrame:
    """Each product with its offers; products without offers stay unless how is inner."""
    return products.join(offers, keys or ["asin"], how)


def tier_price_long(tiers: DataFrame, keys: list[str], qty: float, base: DataFrame | None = None) -> DataFrame:
    """As-of price from one row per tier (min_qty, price_cny, pos): greatest min_qty up to qty, else the lowest tier, else base."""
    good = tiers.filter((F.col("min_qty") > 0) & (F.col("price_cny") > 0))
    pick = good.groupBy(*keys).agg(
        F.max_by("price_cny", F.when(F.col("min_qty") <= qty, F.struct("min_qty", -F.col("pos")))).alias("reached"),
        F.min_by("price_cny", F.struct("min_qty", "pos")).alias("lowest"),
    )
    pick = pick.select(*keys, F.coalesce("reached", "lowest").alias("tier_price"))
    if base is None:
        return pick
    return base.join(pick, keys, "left").withColumn("tier_price", F.coalesce("tier_price", "base_price_cny"))


def first_band(measures: list[Column], bands: list[tuple[tuple[float, ...], float]]) -> Column:
    """Value of the first band all of whose limits hold the measures, else the last band's; null if a measure is missing."""
    out, known = F.lit(bands[-1][1]), F.lit(True)
    for limits, value in reversed(bands):
        fits = F.lit(True)
        for m, limit in zip(measures, limits):
            fits = fits & (m <= F.lit(limit))
        out = F.when(fits, F.lit(value)).otherwise(out)
    for m in measures:
        known = known & m.isNotNull()
    return F.when(known, out)


def keyed_rate(df: DataFrame, rates: DataFrame, key: str, rate: str, default: float) -> DataFrame:
    """Left lookup of a rate by key; keys without a rate get the default."""
    return df.join(rates, key, "left").withColumn(rate, F.coalesce(rate, F.lit(default)))


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str = "id") -> DataFrame:
    """Current row per key of an append-only table: greatest time, then greatest id."""
    return first_per_key(df, keys, [F.col(ts).desc_nulls_last(), F.col(tie).desc_nulls_last()])


def candidate_view(products: DataFrame, latest: dict[str, DataFrame], key: str = "asin") -> DataFrame:
    """Products with the latest rows of each side table; side columns are prefixed with the table's name."""
    out = products
    for name, side in latest.items():
        out = out.join(side.select(key, *[F.col(c).alias(f"{name}_{c}") for c in side.columns if c != key]), key, "left")
    return out


def reviewed_results(results: DataFrame, decisions: DataFrame, saved: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """Visible results with their decision (pending if none) and whether they are saved."""
    marked = saved.select(key).distinct().withColumn("is_saved", F.lit(True))
    out = results.join(hidden.select(key).distinct(), key, "left_anti").join(decisions, key, "left").join(marked, key, "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("pending")), "is_saved": F.coalesce("is_saved", F.lit(False))})


def accepted_offers(offers: DataFrame, decisions: DataFrame, key: str = "review_key", rank: str = "offer_rank", k: int = 5) -> DataFrame:
    """Offers among the first k of their product whose review was accepted."""
    return offers.filter(F.col(rank) <= k).join(decisions.filter(F.col("status") == "accepted").select(key).distinct(), key, "left_semi")


def review_key(product_key: Column, offer_id: Column, url: Column, raw_id: Column, rank: Column) -> Column:
    """product:offer, the offer named by its id, URL, raw id or rank, whichever comes first."""
    blank = lambda c: F.when(F.trim(c.cast("string")) != "", F.trim(c.cast("string")))
    return F.concat(product_key, F.lit(":"), F.coalesce(blank(offer_id), blank(url), blank(raw_id), rank.cast("string")))


def labels_predictions(labels: DataFrame, predictions: DataFrame, key: str = "case_id") -> DataFrame:
    return labels.filter("reviewed").join(predictions, key, "inner")


#: Attempts of one text are dealt to so many tasks, and its offers to so many lists.
DEALS, LISTS = 64, 64


def query_hits(attempts: DataFrame, executions: DataFrame, offers: DataFrame) -> DataFrame:
    """Attempts with their execution and the offers that name the query's text among their search queries.

    There are as many hits as attempts times offers of each text, so the attempts of one
    text are dealt to many tasks before they meet its offers, which come as lists of a
    64th of them: a task makes its hits one after another from a list.
    """
    spark = attempts.sparkSession
    named = offers.select("offer_id", F.explode("search_queries").alias("query_text"))
    without_id = F.array_repeat(F.lit(None).cast(offers.schema["offer_id"].dataType), F.count_if(F.col("offer_id").isNull()).cast("int"))
    lists = named.groupBy("query_text", F.pmod(F.xxhash64("offer_id"), F.lit(LISTS)).alias("_list")).agg(F.concat(F.collect_list("offer_id"), without_id).alias("_ids"))
    lists = lists.select("query_text", "_ids", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("_deal"))
    tried = attempts.join(executions, "query_text", "left")
    columns = tried.columns
    n = max(DEALS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = tried.withColumn("_deal", F.pmod(F.xxhash64(*columns), F.lit(DEALS)).cast("int")).repartition(n, "query_text", "_deal")
    return dealt.join(lists, ["query_text", "_deal"], "left").select(*columns, F.explode_outer("_ids").alias("offer_id"))


def _near(top_k: int, least: float):
    """Top neighbours of each query of a batch among the vectors of a chunk, by one product of matrices."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and vectors.num_rows:
            unit = lambda t: (x := np.stack(t["v"].to_numpy()).astype(np.float64)) / np.maximum(1e-300, np.sqrt((x * x).sum(axis=1, keepdims=True)))
            ids, names = vectors["id"].to_numpy(), queries["id"].to_numpy()
            cosine = unit(queries) @ unit(vectors).T
            for i, row in enumerate(cosine):
                ok = np.flatnonzero((row >= least) & (ids != names[i]))
                ok = ok[np.lexsort((ids[ok], -row[ok]))[:top_k]]
                found.append((np.full(len(ok), names[i]), ids[ok], row[ok]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "similarity": pa.array(cols[2], pa.float64())})

    return run


def similar_vectors(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", block: str | None = "label", top_k: int = 20, least: float = 0.7, chunk: int = 20_000, batch: int = 1_000) -> DataFrame:
    """(query_id, id, similarity, rank): exact cosine top-k of each query among the vectors of its block.

    Vectors of a block are dealt to chunks and its queries to batches, so that a
    block of any size is many tasks; every batch meets every chunk of its block once.
    Null and empty vectors are left out, and only vectors of one length meet.
    """
    own = lambda df: df.filter(F.size(vec_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.struct(*([F.col(block).alias("label")] if block else []), F.size(vec_col).alias("size")).alias("block"))
    v, q = own(vectors), own(queries)
    counts = v.groupBy("block").agg(F.ceil(F.count("*") / chunk).cast("int").alias("n_chunks")).join(q.groupBy("block").agg(F.ceil(F.count("*") / batch).cast("int").alias("n_batches")), "block")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    v = v.join(counts, "block").select("id", "v", "block", dealt("n_chunks").alias("chunk"), every("n_batches").alias("batch"))
    q = q.join(counts, "block").select("id", "v", "block", every("n_chunks").alias("chunk"), dealt("n_batches").alias("batch"))
    keys = ["block", "chunk", "batch"]
    near = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(_near(top_k, least), "query_id long, id long, similarity double")
    return top_per_key(near, ["query_id"], [F.desc("similarity"), F.asc("id")], top_k).select("query_id", "id", "similarity", "rank")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as one JSON object in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def resume_delta(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs whose (key, stage, fingerprint) was not done yet."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def dependency_fingerprints(nodes: DataFrame, outputs: DataFrame, on: list[str]) -> DataFrame:
    """Nodes with the hash of what they depend on; a missing output counts as an empty one."""
    joined = nodes.join(outputs, on, "left").withColumn("_out", F.coalesce("output_hash", F.lit("")))
    keys = [c for c in nodes.columns if c not in on or c in nodes.columns]
    parts = joined.groupBy(*keys).agg(F.array_sort(F.collect_list("_out")).alias("_outs"))
    return parts.withColumn("dependency_fingerprint", F.sha2(F.array_join("_outs", "|"), 256)).drop("_outs")
