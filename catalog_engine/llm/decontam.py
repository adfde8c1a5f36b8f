"""Benchmark decontamination by spaced-seed hashing.

A seed is a hash of the words at the positions of a fixed mask; positions between
are ignored, so a substituted word spoils only the seeds that read it. Seeds of
the benchmark and of every document meet in an equi-join. A filter of fixed size
(two probes in ``FILTER_BITS`` bits) lets tasks drop most document seeds before
the join; however large the benchmark, it only decides how many rows reach the
join, never the result. Around each hit the passage and the item are compared
word by word along the hit's diagonal.

A document leaks an item if some ``WINDOW`` neighbouring words of the item (all,
if it has fewer) stand in the document with at most a fifth of them substituted;
items under ``LEAST_WORDS`` words must stand there word for word. Items too short
for the masks have masks by their length, one for each choice of blocks to leave
out, so that every allowed substitution spares a seed.

Defined results: words are lower-cased runs of letters and digits; null
and empty texts and texts without words are never found; equal items are
reported under their least id; repeated rows give one pair; clashing extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import filter_bits, free_name, row_key, written
from .textlib import ALNUM, U, mix, sub_batches

#: Word positions that each seed reads.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 1, 3, 5, 6, 8), (0, 2, 3, 6, 7, 9), (0, 1, 4, 6, 9, 10))
LEAST_WORDS = 8
WINDOW = 13
MARGIN = 16
FILTER_BITS = 1 << 23
REACH = max(m[-1] for m in MASKS)


def _short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of n words: all of it, or all but as many blocks as words may be substituted."""
    if n < LEAST_WORDS:
        return [tuple(range(n))]
    free = n // 5
    blocks = np.array_split(np.arange(n), 3 + free)
    kept = [[int(i) for j, b in enumerate(blocks) if j not in out for i in b] for out in combinations(range(len(blocks)), free)]
    return sorted({tuple(i - k[0] for i in k) for k in kept})


#: (item length, mask) for each length that MASKS alone do not cover.
SHORT = [(n, m) for n in range(1, REACH + 2) for m in _short_masks(n)]
ALL_MASKS = MASKS + tuple(m for _, m in SHORT)


def _seeds(words, mask_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the mask at every place where it fits inside a row."""
    mask, h = ALL_MASKS[mask_id], words.hashes
    span, n = mask[-1] + 1, len(h)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, U)
    size = n - span + 1
    x = np.full(size, mask_id + 1, U)
    for o in mask:
        x = (x + h[o : o + size]) * U(0x9E3779B97F4A7C15 + 2 * o)
        x ^= x >> U(31)
    left = (words.first[1:][words.rows()] - np.arange(n))[:size]
    fits = np.flatnonzero(left >= span)
    return fits, mix(x[fits])


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & U(FILTER_BITS - 1)).astype(np.int64), (h >> U(41)).astype(np.int64) & (FILTER_BITS - 1)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["item_id", "item_key", "tokens", "seeds"]
    for batch in batches:
        ids = batch.column("item_id").to_pylist()
        for words in sub_batches(batch.column("text"), kind=ALNUM):
            rows = []
            found = []
            for m in range(len(ALL_MASKS)):
                at, h = _seeds(words, m)
                found.append((at, h, words.rows()[at]))
            for r in range(words.hi - words.lo):
                n = int(words.counts[r])
                if not n:
                    continue
                h = words.hashes[words.first[r] : words.first[r + 1]]
                seeds = []
                for m, (at, x, row) in enumerate(found):
                    if m < len(MASKS) or n == SHORT[m - len(MASKS)][0]:
                        mine = row == r
                        seeds += [{"mask": m, "hash": int(v), "at": int(a - words.first[r])} for a, v in zip(at[mine], x[mine].view(np.int64))]
                key = int(mix(np.array([np.bitwise_xor.reduce(mix(h + U(0x9E37) * np.arange(1, n + 1, dtype=U)))], U)).view(np.int64)[0])
                rows.append((ids[words.lo + r], key, h.view(np.int64).tolist(), seeds))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("mask", pa.int32()), ("hash", pa.int64()), ("at", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)


def _passages(wanted, masks: list[int]):
    """Stretches of documents around seeds that pass the filter, with those seeds."""
    seed_type = pa.struct([("mask", pa.int32()), ("hash", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            for words in sub_batches(batch.column("text"), kind=ALNUM):
                hits = []
                for m in masks:
                    at, h = _seeds(words, m)
                    one, two = _probes(h)
                    in_one = np.flatnonzero((bits[one >> 3] >> (one & 7).astype(np.uint8)) & 1)
                    two = two[in_one]
                    ok = in_one[((bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)]
                    if len(ok):
                        hits.append((at[ok], np.full(len(ok), m), h[ok]))
                if not hits:
                    continue
                at, mask, h = (np.concatenate(x) for x in zip(*hits))
                order = np.argsort(at, kind="stable")
                at, mask, h = at[order], mask[order], h[order].view(np.int64)
                row = words.rows()[at]
                lo = np.maximum(words.first[row], at - MARGIN)
                hi = np.minimum(words.first[row + 1], at + REACH + MARGIN)
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1])
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(at))
                tokens = words.hashes.view(np.int64)
                out = {"row": [], "start": [], "tokens": [], "seeds": []}
                for a, b in zip(begin, end):
                    s, e = int(lo[a]), int(hi[a:b].max())
                    out["row"].append(int(row[a]) + words.lo)
                    out["start"].append(s - int(words.first[row[a]]))
                    out["tokens"].append(tokens[s:e])
                    out["seeds"].append([{"mask": int(mask[i]), "hash": int(h[i]), "at": int(at[i]) - s} for i in range(a, b)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(out["row"])), pa.array(out["start"], pa.int64()), pa.array(out["tokens"], pa.list_(pa.int64())), pa.array(out["seeds"], pa.list_(seed_type))],
                    ["doc_id", "start", "tokens", "seeds"],
                )

    return run


def _best_window(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """(matches, item position) of the best window on the diagonal doc = item + shift."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = np.zeros(len(item), np.int64)
    if hi > lo:
        same[lo:hi] = doc[lo + shift : hi + shift] == item[lo:hi]
    w = min(WINDOW, len(item))
    sums = np.concatenate([[0], np.cumsum(same)])
    runs = sums[w:] - sums[:-w]
    k = int(np.argmax(runs))
    return int(runs[k]), k


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for doc_id, start, tokens, key, item, shifts in zip(f["doc_id"], f["start"], f["tokens"], f["item_key"], f["item_tokens"], f["shifts"]):
            w = min(WINDOW, len(item))
            matched, k, shift = max((*_best_window(np.asarray(tokens), np.asarray(item), int(s)), int(s)) for s in shifts)
            if 5 * matched >= 4 * w:
                rows.append((doc_id, key, matched, w, start + k + shift))
        yield pd.DataFrame(rows, columns=["doc_id", "item_key", "matched", "window", "at"]).astype({"doc_id": "Int64"})


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id) of every leak, with the best window's matched_words, window_words and first word."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    seed = "array<struct<mask int, hash long, at int>>"
    items = bench.mapInArrow(_item_seeds, f"item_id long, item_key long, tokens array<long>, seeds {seed}")
    items = written(items.groupBy("item_key").agg(F.min("item_id").alias("item_id"), F.first("tokens").alias("item_tokens"), F.first("seeds").alias("seeds")), "leak-items")
    seeds = items.select("item_key", F.inline("seeds")).withColumnRenamed("at", "item_at")
    bits = filter_bits(seeds.select("hash"), FILTER_BITS, _probes)
    masks = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())  # of the fixed list of masks
    wanted = spark.sparkContext.broadcast(bits.tobytes())
    found = docs.mapInArrow(_passages(wanted, masks), f"doc_id long, start long, tokens array<long>, seeds {seed}")
    found = written(found.withColumn("passage", F.monotonically_increasing_id()), "leak-passages")
    hits = found.select("passage", F.inline("seeds")).join(seeds, ["hash", "mask"])
    hits = hits.groupBy("passage", "item_key").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))
    pairs = hits.join(found.select("passage", "doc_id", "start", "tokens"), "passage").join(items.select("item_key", "item_tokens"), "item_key")
    checked = pairs.select("doc_id", "start", "tokens", "item_key", "item_tokens", "shifts").mapInPandas(_verified, "doc_id long, item_key long, matched long, window long, at long")
    best = checked.groupBy("doc_id", "item_key").agg(F.max(F.struct("matched", F.negative("at").alias("at"), "window")).alias("best"))
    named = best.join(items.select("item_key", "item_id"), "item_key")
    return named.select("doc_id", "item_id", F.col("best.matched").alias("matched_words"), F.col("best.window").alias("window_words"), (-F.col("best.at")).alias("first_word"))


def drop_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the documents that leak; rows are told apart by a hash of the whole row, whatever their id.

    A clean row goes with a leaking one only if their 64-bit hashes are the same: at
    10^10 rows of which one in a hundred leaks, one is lost in twenty runs.
    """
    name = free_name(df, "row")
    keyed = df.withColumn(name, row_key(df))
    bad = leaks(keyed, benchmark, name, text_col).select(F.col("doc_id").alias(name)).distinct()
    return keyed.join(bad, name, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
