"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows are dealt over logical partitions, the number of rows that each partition
sends to each shard is drawn from the multivariate hypergeometric distribution,
rows are permuted inside their partition and cut by those numbers, exchanged, and
permuted again inside their shard. Every assignment of rows to shards with the
given sizes is equally likely, and sizes differ by one row at most (law ``rows``;
equal texts are not kept together).

Only the counts of the logical partitions reach the driver, where the matrix is
drawn: at most ``MOST_PARTITIONS`` x shards whole numbers, which also bounds what
is broadcast. Windows run inside one logical partition, or inside one run of a
shard's second key, never over a whole shard. What moves is (id, size, crc), not
the text.

Defined results: null text has size 8 and crc32 0 of the empty text; null ids and
equal rows are rows like others (equal rows get ordinals first, so that a third of
all rows may be equal); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import written

SHARDS = 24
ROWS_A_PARTITION = 1_000_000
LEAST_PARTITIONS, MOST_PARTITIONS = 64, 4096
ORDINALS = 65_536


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones among n drawn without return from good + bad."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n and good else 0
    low, high = max(0, n - bad), min(n, good)
    lg = math.lgamma
    log_p = lambda k: (
        lg(good + 1) - lg(k + 1) - lg(good - k + 1) + lg(bad + 1) - lg(n - k + 1) - lg(bad - n + k + 1) - lg(good + bad + 1) + lg(n + 1) + lg(good + bad - n + 1)
    )
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    u, down, up = rng.random(), mode, mode + 1
    p_down = p = math.exp(log_p(mode))
    p_up = p * (good - mode) * (n - mode) / ((mode + 1) * (bad - n + mode + 1)) if mode < high else 0.0
    while down >= low or up <= high:
        if down >= low:
            u -= p_down
            if u <= 0:
                return down
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
        if up <= high:
            u -= p_up
            if u <= 0:
                return up
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows from each partition to each shard: row sums are counts, column sums differ by one at most."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        left, sent = n, []
        rest = sum(room)
        for s in range(shards):
            rest -= room[s]
            k = left if s == shards - 1 else hypergeometric(rng, room[s], rest, left)
            room[s] -= k
            left -= k
            sent.append(k)
        matrix.append(sent)
    return matrix


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 inside a shard) of every row."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # equal rows get ordinals, in two steps so that no array is long
    equal = rows.groupBy("doc_id", "size", "text_crc32").count()
    equal = equal.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / ORDINALS))))
    inside = F.least(F.lit(ORDINALS).cast("long"), F.col("count") - F.col("block") * ORDINALS)
    equal = equal.withColumn("ordinal", F.explode(F.sequence(F.lit(1).cast("long"), inside)))
    key = ["doc_id", "size", "text_crc32", "block", "ordinal"]
    dealt = written(equal.select(*key), "shard-rows")
    total = dealt.count()
    parts = max(LEAST_PARTITIONS, min(MOST_PARTITIONS, -(-total // ROWS_A_PARTITION)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(parts)).cast("int"))
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().toLocalIterator()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    # first permutation, inside the partition, cut by the matrix
    ends = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps([np.cumsum(m).tolist() for m in matrix])), "array<array<bigint>>")).alias("part", "ends"))
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), *key), *key)
    ranked = dealt.withColumn("rank", F.row_number().over(local) - 1)
    sent = ranked.join(F.broadcast(ends), "part").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    sent = written(sent.select(*key, "shard"), "shard-sent")
    # second permutation, inside the shard, run by run of its key
    runs = max(1, parts // 8)
    sent = sent.withColumn("order", F.xxhash64(F.lit(seed + 2), *key))
    sent = sent.withColumn("run", F.pmod(F.shiftright("order", 40), F.lit(runs)).cast("int"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "run").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    again = Window.partitionBy("shard", "run").orderBy("order", *key)
    slots = sent.withColumn("at", F.row_number().over(again) - 1).join(F.broadcast(starts), ["shard", "run"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
