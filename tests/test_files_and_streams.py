"""Files written and read again, and streams against their batch twins."""

import json
import os

import pytest
from pyspark.sql import functions as F

from catalog_engine.sources import readers, writers
from catalog_engine.streaming import events as ev

SF = "/root/testdata/sf0.001/events.parquet"


def test_keyword_export(spark, tmp_path):
    (tmp_path / "k.csv").write_bytes("﻿Keyword,Search Volume,Purchase Rate,Duration,Extra\n Patio  Heater ,10K+,5%,1h 30m,x\nN/A,,,,\n".encode())
    rows = readers.keyword_rows(readers.read_export(spark, str(tmp_path))).orderBy("source_pos").collect()
    assert [r["keyword"] for r in rows] == ["patio heater", None]
    assert (rows[0]["search_volume"], rows[0]["search_volume_lower_bound"], rows[0]["purchase_rate"], rows[0]["duration_seconds"]) == (None, 10000.0, 5.0, 5400.0)
    assert rows[1]["search_volume"] is None and "Extra" in rows[0].asDict() and rows[0]["source_file"].endswith("k.csv")


def test_competitor_export_falls_back_to_brand(spark, tmp_path):
    (tmp_path / "c.csv").write_text("品牌,Price,月销量,上架时间\nAcme,$9.5,1.2k,2024/3/5\n")
    r = readers.competitor_rows(readers.read_export(spark, str(tmp_path))).first()
    assert (r["seller"], r["price"], r["monthly_sales"], str(r["launch_date"])) == ("Acme", 9.5, 1200.0, "2024-03-05")


def test_ragged_export_is_rejected(spark, tmp_path):
    (tmp_path / "k.csv").write_text("Keyword,Search Volume\na,1,2,3\n")
    with pytest.raises(Exception):
        readers.read_export(spark, str(tmp_path)).collect()


def test_candidates_round_trip(spark, tmp_path):
    products = spark.createDataFrame([("a", 1.23456), ("b", 2.0)], "asin string, net_profit double")
    offers = spark.createDataFrame([("a", i, f"o{i}") for i in range(1, 15)], "asin string, offer_rank int, offer_id string")
    writers.write_candidates_json(products, offers, str(tmp_path / "j"))
    back = {r["asin"]: r for r in spark.read.json(str(tmp_path / "j")).collect()}
    assert len(back["a"]["suppliers"]) == 10 and back["a"]["suppliers"][0]["offer_id"] == "o1" and back["a"]["net_profit"] == 1.2346
    flat = writers.flat_candidates(writers.nested_candidates(products, offers)).filter("asin = 'b'").first()
    assert flat["n_suppliers"] == 0 and flat["top_offer_id"] is None


def test_flat_export_has_all_columns(spark, tmp_path):
    offers = spark.createDataFrame([("a", 1, "Acme", 2.5, 7, 0.12345), ("a", 2, "Other", 2.0, 9, None)], "asin string, offer_rank int, supplier string, base_price_cny double, moq int, match_quality_score double")
    products = spark.createDataFrame([("a", "t", 0.3123, 12.345, True, ["x", "y"]), ("b", "u", None, None, False, [])], "asin string, title string, profit_margin double, net_profit double, passed boolean, rejection_reasons array<string>")
    out = writers.export_rows(writers.nested_candidates(products, offers))
    assert len(out.columns) == 45 == len(set(out.columns))
    a, b = out.orderBy("ASIN").collect()
    assert (a["利润率"], a["净利润($)"], a["供应商数"], a["Top1供应商"], a["Top1匹配分"], a["通过筛选"], a["拒绝原因"], a["品牌"]) == ("31.2%", 12.35, 2, "Acme", 0.123, "✓", "x, y", None)
    assert (b["利润率"], b["供应商数"], b["Top1供应商"], b["通过筛选"], b["拒绝原因"]) == (None, 0, None, "✗", "")
    writers.write_candidates_flat(writers.nested_candidates(products, offers), str(tmp_path / "flat"))
    assert spark.read.parquet(str(tmp_path / "flat")).count() == 2


def test_candidate_exports_skip_broken_files(spark, tmp_path):
    (tmp_path / "candidates_1.json").write_text(json.dumps([{"asin": "a"}, {"asin": "b"}]))
    (tmp_path / "candidates_2.json").write_text("{broken")
    rows = readers.candidate_exports(spark, str(tmp_path)).select("asin", "export_id").collect()
    assert sorted(map(tuple, rows)) == [("a", "candidates_1"), ("b", "candidates_1")]


def test_append_twice_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([("k1", 1), ("k2", 2)], "result_key string, v int")
    for _ in range(2):
        writers.append_snapshot(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_upsert_keeps_old_title(spark):
    old = spark.createDataFrame([(1, "t", 5.0), (2, "u", 6.0)], "id int, title string, price double")
    new = spark.createDataFrame([(1, "", None), (3, "w", 7.0)], "id int, title string, price double")
    assert sorted(map(tuple, writers.upsert(old, new, ["id"], ("title",)).collect())) == [(1, "t", None), (2, "u", 6.0), (3, "w", 7.0)]


def test_shortlist_writes_both_parts(spark, tmp_path):
    df = spark.createDataFrame([("s", False, "stable_niche"), ("x", True, "excluded")], "seller string, excluded boolean, fit_category string")
    writers.write_seller_shortlist(df, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/sellers").count() == 2 and spark.read.parquet(f"{tmp_path}/summary").count() == 2


pytestmark_stream = pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")


def drained(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture
def event_dir(spark, tmp_path):
    spark.read.parquet(SF).withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").repartition(1).write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


@pytestmark_stream
def test_progress_stream_equals_batch(spark, event_dir):
    got = drained(spark, ev.stage_progress(ev.read_events(spark, event_dir), ["user_id"]), "progress", "complete")
    want = ev.stage_progress(spark.read.parquet(event_dir), ["user_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytestmark_stream
def test_window_stream_equals_batch(spark, event_dir):
    got = drained(spark, ev.per_window(ev.read_events(spark, event_dir), "1 day"), "windows", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ev.per_window(spark.read.parquet(event_dir), "1 day").collect()))


@pytestmark_stream
def test_dedupe_stream_has_one_row_per_key(spark, event_dir):
    got = drained(spark, ev.dedupe_stream(ev.read_events(spark, event_dir), ["event_id"], "40 days"), "dedupe", "append")
    assert got.count() == spark.read.parquet(event_dir).count()


@pytestmark_stream
def test_continuous_hands_over_every_row(spark, event_dir, tmp_path):
    out = str(tmp_path / "out")
    q = ev.continuous(ev.read_events(spark, event_dir), str(tmp_path / "ck"), lambda df, i: writers.append_snapshot(df.withColumn("result_key", F.col("event_id").cast("string")), out))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == spark.read.parquet(event_dir).count()


@pytestmark_stream
def test_stale_runs_are_reported_by_timer(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "beats")
    rows = [(1, "2024-01-01 00:00:00", 1), (2, "2024-01-01 00:00:30", 2)]
    later = [(3, "2024-01-01 06:00:00", 2)]
    for part in (rows, later, [(4, "2024-01-01 12:00:00", 3)]):
        spark.createDataFrame(part, "event_id long, t string, user_id long").selectExpr("event_id", "cast(t as timestamp) ts", "user_id", "'beat' event_type", "0D value", "'' props").coalesce(1).write.mode("append").parquet(src)
    got = drained(spark, ev.stale_stream(ev.read_events(spark, src), 600, "1 minute"), "stale", "append")
    found = {(r["user_id"], r["attempt"], r["status"]) for r in got.collect()}
    assert (1, 1, "retry_wait") in found and (2, 1, "retry_wait") in found


def beats(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, t string, user_id long, value double").selectExpr("event_id", "cast(t as timestamp) ts", "user_id", "concat('type', event_id) event_type", "value", "'' props").coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def without_empty_batches(spark):
    """A query with time-to-live state asks for another batch for ever; without empty ones it ends with its input."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


@pytestmark_stream
def test_ttl_stream_keeps_newest_rows_until_they_end(spark, tmp_path, without_empty_batches):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")

    def run(ttl):
        seen = []
        ev.ttl_stream(ev.read_events(spark, src, 9), ["user_id"], ttl).writeStream.foreachBatch(lambda df, i: seen.extend((r["user_id"], r["event_id"]) for r in df.collect())).outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(seen)

    beats(spark, src, [(1, "2024-01-01 00:00:00", 1, 1.0), (5, "2024-01-05 00:00:00", 1, 2.0), (2, "2024-01-02 00:00:00", 2, None)])
    assert run(3600) == [(1, 5), (2, 2)]
    beats(spark, src, [(3, "2024-01-03 00:00:00", 1, 3.0), (4, "2024-01-04 00:00:00", 2, 4.0), (9, "2023-01-01 00:00:00", 3, 4.0)])
    beats(spark, src, [(3, "2024-01-03 00:00:00", 1, 3.0)])  # late and again: the newer row stays
    assert run(3600) == [(2, 4), (3, 9)]
    live = ev.live_rows(spark, ck).collect()
    want = spark.read.parquet(src).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value", "ts"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")
    key = lambda rows: sorted((r["user_id"], r["event_id"], r["event_type"], r["value"], r["ts"]) for r in rows)
    assert key(live) == key(want.collect()) and all(r["expires_at"] is not None for r in live)


@pytestmark_stream
def test_ttl_stream_forgets_what_has_ended(spark, tmp_path, without_empty_batches):
    import time

    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    beats(spark, src, [(5, "2024-01-05 00:00:00", 1, 2.0)])
    start = lambda: ev.ttl_stream(ev.read_events(spark, src), ["user_id"], 2).writeStream.foreachBatch(lambda df, i: seen.extend(r["event_id"] for r in df.collect())).outputMode("update").option("checkpointLocation", ck).trigger(availableNow=True).start()
    seen = []
    start().awaitTermination(120)
    time.sleep(3)
    assert ev.live_rows(spark, ck).count() == 0
    beats(spark, src, [(3, "2024-01-03 00:00:00", 1, 3.0)])  # older, but what was kept has ended
    start().awaitTermination(120)
    assert seen == [5, 3]


@pytestmark_stream
def test_queue_is_merged_by_bucket_and_batch(spark, event_dir, tmp_path):
    out = str(tmp_path / "queue")
    for name in ("a", "b"):  # a second query with a new checkpoint brings the same batches again
        ev.upsert_queue(ev.read_events(spark, event_dir), out, ["user_id"], str(tmp_path / f"ck-{name}"), buckets=8).awaitTermination(120)
        got = ev.read_queue(spark, out, ["user_id"])
        want = ev.manual_queue(spark.read.parquet(event_dir), ["user_id"]).select(*got.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_queue_rows_merge_in_any_parts(spark):
    rows = [(i % 7, f"2024-01-01 00:00:{i % 60:02d}", i, f"w{i * 7 % 11}") for i in range(200)]
    df = spark.createDataFrame(rows, "user_id long, t string, event_id long, event_type string").withColumn("ts", F.col("t").cast("timestamp"))
    parts = [ev.queue_parts(df.filter(F.col("event_id") % 3 == k), ["user_id"], 4) for k in range(3)]
    got = ev.queue_rows(ev.join_queues(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["user_id"], 4), ["user_id"])
    for r in got.collect():
        mine = sorted((t, e, w) for u, t, e, w in rows if u == r["user_id"])
        words = list(dict.fromkeys(w for *_, w in reversed(mine)))
        assert (r["attempts"], r["reason"], r["keywords"]) == (len(mine), mine[-1][2], words[:4])


def test_append_reads_only_the_buckets_it_hits(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).selectExpr("cast(id AS string) AS result_key", "id AS v")
    writers.append_snapshot(rows, path, buckets=16)
    one = rows.filter("v IN (7, 8)").unionByName(spark.createDataFrame([("new", 1), ("new", 1)], rows.schema))
    plan = writers.append_snapshot(one, path, buckets=16)._jdf.queryExecution().executedPlan().toString()
    table = spark.read.parquet(path)
    assert table.count() == 2001 and table.select("result_key").distinct().count() == 2001
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "PartitionFilters: [" in plan and " IN (" in plan


def test_replaced_scopes_leave_the_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(300).selectExpr("id % 30 AS run", "id % 3 AS asin", "id AS v")
    writers.write_scope(rows, path, ["run", "asin"], buckets=8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    new = spark.createDataFrame([(0, 0, -1), (0, 0, -2)], rows.schema)
    for _ in range(2):
        writers.write_scope(new, path, ["run", "asin"], buckets=8)
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("run", "asin", "v").collect())
    assert got == sorted([(i % 30, i % 3, i) for i in range(300) if (i % 30, i % 3) != (0, 0)] + [(0, 0, -1), (0, 0, -2)])
    kept = [p for p in before if p.exists()]
    assert len({p.parent for p in before} - {p.parent for p in kept}) == 1


@pytestmark_stream
def test_scores_follow_the_streams(spark, tmp_path):
    from catalog_engine.plans import fixtures as fx
    from catalog_engine.plans.pipeline import score_products
    from catalog_engine.streaming import scoring

    d = os.path.dirname(SF)
    products, offers = fx.products(spark, d), fx.offers(spark, d)
    market = fx.market(spark, d).withColumn("asin", F.concat(F.lit("B0"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))).drop("p_partkey")
    first = products.withColumn("price", F.when(F.col("p_partkey") % 3 == 0, F.col("price") * 2).otherwise(F.col("price"))).withColumn("source_pos", F.lit(0).cast("long"))
    for name, parts in (("p", [first, products.filter("p_partkey % 3 = 0")]), ("o", [offers.filter("source_pos % 2 = 0"), offers.filter("source_pos % 2 = 1")])):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    out = str(tmp_path / "scores")
    start = lambda ck: scoring.continuous_scoring(stream("p", products.schema), stream("o", offers.schema), market, out, str(tmp_path / ck), buckets=8).awaitTermination(300)
    start("ck")
    show = lambda df: sorted((r["asin"], r["best_offer_id"], f"{r['total_score'] or 0:.9g}", r["passed"]) for r in df.collect())
    want = show(score_products(products, offers, market))
    assert show(scoring.current_scores(spark, out)) == want
    rows = spark.read.parquet(f"{out}/results").count()
    start("ck2")  # all batches come again
    again = spark.read.parquet(f"{out}/results")
    assert again.count() == rows and again.select("result_key").distinct().count() == rows and show(scoring.current_scores(spark, out)) == want


def test_sketches_merge_within_their_error(spark):
    import random

    rnd = random.Random(1)
    rows = [("a", k, "F" if k % 5 == 0 else "S", rnd.lognormvariate(0, 2)) for k in range(30_000)] + [("b", 1, "S", None)]
    df = spark.createDataFrame(rows, "stage string, k long, status string, seconds double").repartition(6)
    parts = ev.attempt_sketches(df.withColumn("window", F.col("k") % 10), ["stage", "window"])
    got = {r["stage"]: r for r in ev.attempt_stats(ev.merge_attempts(parts, ["stage"]), ["stage"]).collect()}
    values = sorted(r[3] for r in rows if r[0] == "a")
    assert (got["a"]["n_attempts"], got["a"]["n_failed"], got["a"]["longest"]) == (30_000, 6_000, values[-1]) and got["b"]["p50"] is None
    for q, name in ((0.5, "p50"), (0.95, "p95")):
        assert abs(sum(v <= got["a"][name] for v in values) / len(values) - q) <= 3 * ev.RANK_ERROR


def test_attempt_percentiles_are_exact(spark, tmp_path):
    import duckdb

    from catalog_engine.plans import queries, queries_inputs  # noqa: F401

    duck = duckdb.connect()
    # even and odd sizes, runs of equal prices, one row, a group without prices, and rows without a group
    duck.execute("""CREATE TABLE orders AS SELECT i AS o_orderkey, i AS o_custkey, CASE WHEN i % 3 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus,
        CASE WHEN i % 7 = 0 THEN NULL WHEN i % 5 < 2 THEN 777.77 ELSE (i * 7919 % 10007)::DOUBLE * i / 13 END AS o_totalprice, TIMESTAMP '1995-01-01' + INTERVAL (i % 400) DAY AS o_orderdate,
        CASE WHEN i = 1 THEN 'one' WHEN i < 50 AND i % 7 = 0 THEN 'none' WHEN i % 4 > 0 THEN 'p' || i % 4 END AS o_orderpriority FROM range(1, 9000) t(i)""")
    duck.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    want = "SELECT o_orderpriority, round(quantile_cont(o_totalprice / 100, 0.5), 2), round(quantile_cont(o_totalprice / 100, 0.95), 2) FROM orders GROUP BY ALL"
    order = lambda rows: sorted(rows, key=str)
    got = queries.QUERIES["attempt_stats"](spark, str(tmp_path)).collect()
    assert order((r["o_orderpriority"], r["p50"], r["p95"]) for r in got) == order(duck.execute(want).fetchall())
    got = order(tuple(r) for r in got)
    assert got == order(duck.execute(queries.ORACLE_SQL["attempt_stats"]).fetchall()) and len(got) == 6
    # a sketch of other durations only makes the bins larger
    o = spark.read.parquet(f"{tmp_path}/orders.parquet").select(F.lit("all").alias("stage"), (F.col("o_totalprice") / 100).alias("seconds"), F.lit("S").alias("status"))
    off = ev.attempt_sketches(o.withColumn("seconds", -F.col("seconds")), ["stage"])
    r = ev.attempt_percentiles(o, off, ["stage"]).first()
    p50, p95 = duck.execute("SELECT quantile_cont(o_totalprice / 100, 0.5), quantile_cont(o_totalprice / 100, 0.95) FROM orders").fetchone()
    assert abs(r["p50"] - p50) < 1e-9 * p50 and abs(r["p95"] - p95) < 1e-9 * p95


def test_positions_follow_the_file_however_it_is_split(spark, tmp_path):
    with open(tmp_path / "long.csv", "w") as f:
        f.write("keyword,searches\n" + "".join(f"word {i},{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = readers.keyword_rows(readers.read_export(spark, str(tmp_path)))
        assert rows.rdd.getNumPartitions() > 3
        assert [r["search_volume"] for r in rows.orderBy("source_pos").select("search_volume").collect()] == list(range(20_000))
        assert rows.select("source_pos").distinct().count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_error_classes(spark):
    from catalog_engine.functions import predicates as pr

    rows = [("", "ValueError", "unknown author", "permanent"), ("", "ValueError", "generated file", "permanent"), ("login_required", "X", "", "human_required"), ("", "TimeoutError", "", "timed_out"), ("http_429", "X", "", "retryable"), ("", "ConnectionResetError", "", "retryable")]
    rows += [("", "CancellationRequested", "captcha", "cancelled"), ("", "FileNotFoundError", "", "permanent"), (None, None, "Rate limit hit", "retryable"), ("", "OSError", "captcha shown", "human_required"), (None, None, None, "permanent")]
    df = spark.createDataFrame(rows, "c string, k string, m string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", pr.error_class(F.col("c"), F.col("k"), F.col("m")).alias("got")).collect())
