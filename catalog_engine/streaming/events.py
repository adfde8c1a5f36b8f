"""Run events as streams, each with the batch query that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.buckets import BUCKETS, merge

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: Legal status changes of an execution node; a status never follows itself (fixed values).
TRANSITIONS = {
    "pending": ("running", "cancelled", "skipped"),
    "running": ("succeeded", "failed", "retry_wait", "human_required", "cancelled", "timed_out"),
    "retry_wait": ("pending", "cancelled"),
    "human_required": ("pending", "cancelled"),
    "failed": ("pending", "cancelled"),
    "succeeded": (),
    "cancelled": (),
    "skipped": (),
    "timed_out": ("pending", "cancelled"),
}


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timeline(events: DataFrame, run: list[str], limit: int | None = None) -> DataFrame:
    """Events of each run in order; the limit is the length of the shown list."""
    w = Window.partitionBy(*run).orderBy("ts", "event_id")
    out = events.withColumn("seq", F.row_number().over(w))
    return out.filter(F.col("seq") <= limit) if limit else out


def stage_progress(events: DataFrame, run: list[str]) -> DataFrame:
    """Latest stage, time and event count of each run; runs on a stream in update mode as well."""
    return events.groupBy(*run).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"))


def per_window(events: DataFrame, length: str, slide: str | None = None, lateness: str | None = None) -> DataFrame:
    """Events by type and window; with lateness, a watermark closes windows and drops what comes later."""
    source = events.withWatermark("ts", lateness) if lateness else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = source.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sessions(events: DataFrame, run: list[str], gap: str, lateness: str | None = None) -> DataFrame:
    """Stretches of activity of each run that are never idle for the gap."""
    source = events.withWatermark("ts", lateness) if lateness else events
    out = source.groupBy(*run, F.session_window("ts", gap)).agg(F.count("*").alias("n_events"))
    return out.select(*run, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def stale_batch(events: DataFrame, run: list[str], lease_seconds: int, most: int = 3) -> DataFrame:
    """Gaps longer than the lease: retry_wait for the first ones of a run, failed from the ``most``-th on."""
    w = Window.partitionBy(*run).orderBy("ts", "event_id")
    gaps = events.withColumn("next_ts", F.lead("ts").over(w)).withColumn("gap", F.unix_millis("next_ts") - F.unix_millis("ts"))
    late = gaps.filter(F.col("gap") > lease_seconds * 1000)
    n = F.row_number().over(w)
    return late.select(*run, "ts", "event_id", n.alias("attempt")).withColumn("status", F.when(F.col("attempt") < most, "retry_wait").otherwise("failed"))


class StaleProcessor(StatefulProcessor):
    """Keeps the last heartbeat and attempts of a run; an event-time timer at heartbeat + lease emits its status."""

    def __init__(self, lease_ms: int, most: int = 3, run: str = "user_id"):
        self.lease_ms, self.most, self.run = lease_ms, most, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "last_ms long, attempts int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, attempts = self.state.get() if self.state.exists() else (0, 0)
        for f in rows:
            last = max(last, int(f["ms"].max()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.lease_ms)
        self.state.update((last, attempts))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, attempts = self.state.get()
        attempts += 1
        self.state.update((last, attempts))
        yield pd.DataFrame({self.run: [key[0]], "last_ms": [last], "attempt": [attempts], "status": pd.Series(["retry_wait" if attempts < self.most else "failed"], dtype=object)})

    def close(self) -> None:
        pass


def stale_stream(events: DataFrame, lease_seconds: int, lateness: str = "10 minutes", run: str = "user_id") -> DataFrame:
    """Runs whose heartbeat is older than the lease in event time."""
    source = events.withWatermark("ts", lateness).withColumn("ms", F.unix_millis("ts"))
    schema = f"{run} {events.schema[run].dataType.simpleString()}, last_ms long, attempt int, status string"
    return source.groupBy(run).transformWithStateInPandas(StaleProcessor(lease_seconds * 1000, run=run), schema, "append", "eventTime")


def dedupe_batch(events: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each key."""
    return events.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))).filter("_nth = 1").drop("_nth")


def dedupe_stream(events: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """First row of each key inside the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def ttl_state(events: DataFrame, keys: list[str], ttl_seconds: int, as_of: str) -> DataFrame:
    """Newest row of each key, as long as it is fresh at the given time."""
    latest = events.groupBy(*keys).agg(F.max_by(F.struct("event_type", "value", "ts"), F.struct("ts", "event_id")).alias("row"))
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("row.ts")
    return latest.filter(age.between(0, ttl_seconds)).select(*keys, "row.*")


class NewestProcessor(StatefulProcessor):
    """Keeps the newest row of a key in state that expires a time after its last write, and gives out each new newest row. A row that is older than the kept one changes nothing while that one lives."""

    def __init__(self, keys: list[str], ttl_ms: int):
        self.keys, self.ttl_ms = keys, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us long, event_id long, event_type string, value double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.newest.get() if self.newest.exists() else None
        best = kept
        for f in rows:
            r = f.sort_values(["us", "event_id"]).iloc[-1]
            row = (int(r["us"]), int(r["event_id"]), r["event_type"], None if pd.isna(r["value"]) else float(r["value"]))
            if best is None or row[:2] > tuple(best[:2]):
                best = row
        if best is not kept:
            self.newest.update(best)
            yield pd.DataFrame([(*key, *best)], columns=[*self.keys, "us", "event_id", "event_type", "value"]).astype({"event_type": object, "value": float})

    def close(self) -> None:
        pass


def ttl_stream(events: DataFrame, keys: list[str], ttl_seconds: int) -> DataFrame:
    """Newest row of each key as it changes, in update mode. Spark drops a key's state once the time to live has passed since its last write; ``live_rows`` reads what is alive. Such a query asks for empty batches to drop state in; with spark.sql.streaming.noDataMicroBatches.enabled off it can end with its input."""
    types = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    source = events.select(*keys, "event_id", "event_type", "value", F.unix_micros("ts").alias("us"))
    out = source.groupBy(*keys).transformWithStateInPandas(NewestProcessor(keys, ttl_seconds * 1000), f"{types}, us long, event_id long, event_type string, value double", "update", "processingTime")
    return out.withColumn("ts", F.timestamp_micros("us")).drop("us")


def live_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a ``ttl_stream`` holds: the newest row of each key with the time at which it ends, those that have ended left out."""
    state = spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint)
    row, ends = F.col("value.value"), F.timestamp_millis("value.ttlExpirationMs")
    return state.select("key.*", F.timestamp_micros(row["us"]).alias("ts"), row["event_id"].alias("event_id"), row["event_type"].alias("event_type"), row["value"].alias("value"), ends.alias("expires_at")).filter(F.col("expires_at") > F.current_timestamp())


#: Compactors of a quantile sketch hold this many values each; the rank error of KLL at this size is below 1.4 % with 99 % confidence.
SKETCH_K, RANK_ERROR = 200, 0.014
PERCENTILES = {"p50": 0.5, "p95": 0.95}


def attempt_sketches(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Attempts, failures, longest and a quantile sketch of the durations of each group: columns status and seconds. Rows of parts or windows merge by ``merge_attempts``."""
    return attempts.groupBy(*by).agg(
        F.count("*").alias("n_attempts"), F.count_if(F.col("status") == "F").alias("n_failed"), F.max("seconds").alias("longest"), F.kll_sketch_agg_double(F.col("seconds").cast("double"), SKETCH_K).alias("sketch")
    )


def merge_attempts(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of fewer, larger groups."""
    return sketches.groupBy(*by).agg(F.sum("n_attempts").alias("n_attempts"), F.sum("n_failed").alias("n_failed"), F.max("longest").alias("longest"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))


def attempt_stats(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Counts and duration percentiles out of sketches; a group without durations has none."""
    filled = F.kll_sketch_get_n_double("sketch") > 0
    at = lambda q: F.when(filled, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return sketches.select(*by, "n_attempts", "n_failed", at(0.5).alias("p50"), at(0.95).alias("p95"), "longest")


def _same(by: list[str], left: str, right: str) -> Column:
    """Equal keys of two aliased tables; null equals null, as in grouping."""
    out = F.lit(True)
    for k in by:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def attempt_percentiles(attempts: DataFrame, sketches: DataFrame, by: list[str], at: dict[str, float] = PERCENTILES) -> DataFrame:
    """Exact duration percentiles of each group, interpolated between the two nearest ranks; a group without durations has no row.

    The group's sketch only says where to split it into bins, of about RANK_ERROR of it
    around each percentile. Every duration is counted into its bin; the counts give the
    bins that hold a sought rank, and only these are shuffled, each ranked by itself.
    However far off a sketch is, the result stays exact. A few numbers per group are
    broadcast.
    """
    ranks = sorted({min(1.0, max(0.0, q + RANK_ERROR * i)) for q in at.values() for i in range(-3, 4)})
    splits = F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ranks))))
    durations = attempts.select(*by, F.col("seconds").cast("double").alias("seconds")).filter("seconds is not null")
    bins = durations.alias("c").join(F.broadcast(sketches.select(*by, splits.alias("splits")).alias("s")), _same(by, "c", "s"))
    place = sum((F.coalesce(F.col("seconds") > F.col("splits")[i], F.lit(False)).cast("int") for i in range(len(ranks))), F.lit(0))
    bins = bins.select("c.*", place.alias("bin"))
    group = Window.partitionBy(*by)
    sizes = bins.groupBy(*by, "bin").agg(F.count("*").alias("held")).withColumns({"upto": F.sum("held").over(group.orderBy("bin")), "whole": F.sum("held").over(group)})
    pos = {name: F.lit(q) * (F.col("whole") - 1) for name, q in at.items()}
    sought = [r for p in pos.values() for r in (F.floor(p), F.ceil(p))]
    wanted = F.lit(False)
    for r in sought:
        wanted = wanted | ((r >= F.col("upto") - F.col("held")) & (r < F.col("upto")))
    found = bins.alias("c").join(F.broadcast(sizes.filter(wanted).alias("s")), _same([*by, "bin"], "c", "s")).select("c.*", "s.whole", (F.col("s.upto") - F.col("s.held")).alias("before"))
    found = found.groupBy(*by, "bin", "whole", "before", "seconds").agg(F.count("*").alias("n"))
    end = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "bin").orderBy("seconds"))
    found = found.withColumn("end", end)
    value = lambda r: F.max(F.when((r < F.col("end")) & (r >= F.col("end") - F.col("n")), F.col("seconds")))
    near = found.groupBy(*by, "whole").agg(*[value(f(p)).alias(f"{name}_{side}") for name, p in pos.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    part = {name: p - F.floor(p) for name, p in pos.items()}
    return near.select(*by, *[(F.col(f"{name}_lo") * (1 - d) + F.col(f"{name}_hi") * d).alias(name) for name, d in part.items()])


def illegal_transitions(events: DataFrame, run: list[str], status: str = "status", allowed: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """Consecutive statuses of a run that may not follow each other; an unknown status may follow or precede none."""
    w = Window.partitionBy(*run).orderBy("ts", "event_id")
    pairs = events.withColumn("before", F.lag(status).over(w)).filter("before is not null")
    legal = F.lit(False)
    for before, after in allowed.items():
        if after:
            legal = legal | ((F.col("before") == before) & F.col(status).isin(*after))
    return pairs.filter(~F.coalesce(legal, F.lit(False))).select(*run, "event_id", "before", F.col(status).alias("after"))


_ORDER = "struct<ts: timestamp, event_id: long>"


def queue_parts(requests: DataFrame, key: list[str], most_keywords: int = 8) -> DataFrame:
    """One mergeable row per key: first time, latest reason and its place, attempts, and the keywords with the place of their last mention.

    Requests are counted by key and keyword first, and only the latest keywords of a
    key are collected, so a key of any number of requests is a few rows.
    """
    place = F.struct("ts", "event_id")
    said = requests.groupBy(*key, "event_type").agg(F.min("ts").alias("created_at"), F.max(place).cast(_ORDER).alias("last"), F.count("*").alias("attempts"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("last")))
    words = said.withColumn("nth", nth).filter(F.col("nth") <= most_keywords).groupBy(*key).agg(F.collect_list(F.struct("last", "event_type")).alias("words"))
    whole = said.groupBy(*key).agg(F.min("created_at").alias("created_at"), F.max_by("event_type", "last").alias("reason"), F.max("last").alias("last"), F.sum("attempts").alias("attempts"))
    return whole.join(words, key)


def join_queues(parts: DataFrame, key: list[str], most_keywords: int = 8, *more: Column) -> DataFrame:
    """Mergeable rows of the same keys into one each."""
    latest = F.transform(F.array_sort(F.flatten(F.collect_list("words"))), lambda w: F.struct(w["last"].alias("last"), w["event_type"].alias("event_type")))
    merged = parts.groupBy(*key).agg(F.min("created_at").alias("created_at"), F.max_by("reason", "last").alias("reason"), F.max("last").alias("last"), F.sum("attempts").alias("attempts"), F.reverse(latest).alias("words"), *more)
    first = F.filter("words", lambda w, i: ~F.exists(F.slice(F.col("words"), 1, F.greatest(i, F.lit(0))), lambda v: v["event_type"].eqNullSafe(w["event_type"])))
    return merged.withColumn("words", F.slice(first, 1, most_keywords))


def queue_rows(parts: DataFrame, key: list[str]) -> DataFrame:
    newest_first = F.reverse(F.array_sort("words"))
    return parts.select(*key, "created_at", "reason", "attempts", F.transform(newest_first, lambda w: w["event_type"]).alias("keywords"))


def manual_queue(requests: DataFrame, key: list[str], most_keywords: int = 8) -> DataFrame:
    """One row per key: first time, latest reason, attempts, and the latest keywords."""
    return queue_rows(queue_parts(requests, key, most_keywords), key)


def upsert_queue(requests: DataFrame, path: str, key: list[str], checkpoint: str, most_keywords: int = 8, buckets: int = BUCKETS):
    """A stream of requests kept as a table of mergeable rows at ``path``: each batch is merged into the buckets it touches, and a row remembers the last batch it holds, so a batch that comes again changes nothing. ``read_queue`` shows the queue."""

    def handle(df: DataFrame, batch: int) -> None:
        new = queue_parts(df, key, most_keywords).withColumn("batch", F.lit(batch).cast("long"))

        def combine(old: DataFrame, now: DataFrame) -> DataFrame:
            applied = old.filter(F.col("batch") >= batch).select(*key)
            both = old.unionByName(now.join(applied, key, "left_anti"))
            return join_queues(both, [*key, "bucket"], most_keywords, F.max("batch").alias("batch"))

        merge(new, path, key, combine, new.schema, buckets)

    return continuous(requests, checkpoint, handle)


def read_queue(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    return queue_rows(spark.read.parquet(path), key)


def append_once(path: str, make):
    """A batch handler that writes ``make(df)`` under the batch's number, so that a batch that comes again replaces its own rows only."""

    def handle(df: DataFrame, batch: int) -> None:
        make(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return handle


def continuous(events: DataFrame, checkpoint: str, handle, trigger: dict | None = None):
    """Starts a query that hands each micro-batch to ``handle(df, batch_id)``; by default it takes all that is there and ends."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
