"""Near-duplicates: SuperMinHash signatures, banding, exact verification, union-find groups.

Texts with equal shingle sets form a class, so copies are never expanded. A class
has one SuperMinHash signature: each element walks a pseudo-random permutation of
the signature's slots and leaves rank + step there, so that values of one element
are correlated, and steps end as soon as no slot can still change. Bands of the
signature make candidates: first each class with one class of its bucket; then, in
buckets whose classes are not in one component yet, each class outside the
bucket's largest component with all others of the bucket. That second comparison
runs on full sets in blocks of at most ``BLOCK`` classes a side, inside tasks, and
returns links only, so no list of pairs is made and no pair is left out. Every
link is confirmed on full shingle sets. Components come from union-find inside
tasks and star contraction between them.

First candidates whose 8-bit signature sketches agree on under ``SKETCH_LEAST`` of
the slots are left to the second comparison: at a true similarity of 0.8 that is
over six standard deviations away. With 32 bands of 5 a link at exactly 0.8 is missed by its own
bands with probability 3e-6, and then usually held by other members of its group.

Defined results: a null or empty text, or one of white space only, has an empty
set and is linked with nothing; a text with fewer than k words is one shingle;
null ids are allowed and never become a component's id while another id is in it;
repeated rows are in one class; other columns are not read. Elements are 52-bit
hashes of shingles, and a class is named by a 64-bit digest of its set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpoint, filter_bits, free_name, row_key, written
from .textlib import U, mix, shingle_hashes, sub_batches

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
SKETCH_LEAST = 0.55
ELEMENT = U((1 << 52) - 1)
#: Bits of the filter that tells tasks which classes need their full sets; at most 4 MB, whatever the input.
FILTER_BITS = 1 << 25
#: Classes on each side of a block of comparisons, and keys over which the classes of a component are spread.
BLOCK, SALT = 1000, 16
#: Nodes that a task's union-find holds before it gives out its forest and begins another.
FOREST = 500_000


def superminhash(rows: np.ndarray, elements: np.ndarray, n_rows: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_rows x slots, uint64) of the sets given as (row, element), rows ascending.

    A value holds the step in its top 8 bits and the rank below.
    """
    out = np.full(n_rows * slots, np.iinfo(np.uint64).max, U)

    def draw(e: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(e * U(0x9E3779B97F4A7C15) + U(step * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        k = U(step) + ((x & U(0xFFFFFFFF)) * U(slots - step) >> U(32))
        return k.astype(np.int64), (x >> U(8)) | (U(step) << U(56)) if step else x >> U(8)

    k, value = draw(elements, 0)
    np.minimum.at(out, rows * slots + k, value)
    table = out.reshape(n_rows, slots)
    active = (table.max(axis=1) >= U(1 << 56)) if n_rows else np.zeros(0, bool)
    sizes = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(sizes)
    todo = np.flatnonzero(active & (sizes > 0))
    while len(todo):
        # as many open rows as keep the permutations small
        take = max(1, int(np.searchsorted(np.cumsum(sizes[todo]), 60_000, side="right")))
        now, todo = todo[:take], todo[take:]
        index = np.concatenate([np.arange(ends[r] - sizes[r], ends[r]) for r in now])
        e, at = elements[index], rows[index]
        perm = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(e), slots)).copy()
        who = np.arange(len(e))
        k, _ = draw(e, 0)
        perm[who, k] = 0
        perm[:, 0] = k
        for step in range(1, slots):
            k, value = draw(e, step)
            hit = perm[who, k].copy()
            perm[who, k] = perm[who, step]
            perm[who, step] = hit
            np.minimum.at(out, at * slots + hit, value)
            still = table[now].max(axis=1) >= U((step + 1) << 56)
            if not still.any():
                break
            if still.mean() < 0.7:
                now = now[still]
                mask = np.isin(at, now)
                e, at, perm = e[mask], at[mask], perm[mask]
                who = np.arange(len(e))
    return table


def _sets(words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element) pairs without repeats in order, and the digest of each row's set."""
    rows, hashes = shingle_hashes(words, k)
    keys = np.unique((rows.astype(U) << U(52)) | (hashes & ELEMENT))
    rows, elements = (keys >> U(52)).astype(np.int64), keys & ELEMENT
    n = words.hi - words.lo
    digest = np.zeros(n, U)
    np.add.at(digest, rows, mix(elements + U(0x632BE59BD9B4E019)))
    return rows, elements, mix(digest + np.bincount(rows, minlength=n).astype(U) * U(0x9E3779B97F4A7C15))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in sub_batches(batch.column("text")):
                rows, elements, digest = _sets(words, k)
                n = words.hi - words.lo
                sig = mix(superminhash(rows, elements, n) + U(1))
                band = np.zeros((n, BANDS), U)
                for i in range(ROWS):
                    band = mix(band * U(0x2545F4914F6CDD1D) + sig[:, i::ROWS])
                band = mix(band + np.arange(1, BANDS + 1, dtype=U) * U(0xD6E8FEB86659FD93))
                sketch = np.ascontiguousarray((sig >> U(56)).astype(np.uint8))
                flat = pa.array(band.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(words.lo, n),
                        pa.array(np.bincount(rows, minlength=n).astype(np.int64)),
                        pa.array(digest.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), flat),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "cls", "bands", "sketch"],
                )

    return run


def _full_sets(k: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            for words in sub_batches(batch.column("text")):
                rows, elements, digest = _sets(words, k)
                at = (digest & U(FILTER_BITS - 1)).astype(np.int64)
                mine = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                _, once = np.unique(digest[mine], return_index=True)
                mine = mine[np.sort(once)]
                if len(mine):
                    ends = np.searchsorted(rows, mine, side="right")
                    starts = np.searchsorted(rows, mine)
                    flat = np.concatenate([elements[a:b] for a, b in zip(starts, ends)])
                    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(digest[mine].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], ["cls", "elements"])

    return run


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of a partition: each node with its root, which is the least node; a new forest after every FOREST nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def rows() -> pd.DataFrame:
        return pd.DataFrame([(x, r) for x in list(parent) if (r := find(x)) != x], columns=["a", "b"]).astype("int64")

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > FOREST:
            yield rows()
            parent.clear()
    yield rows()


def _stars(edges: DataFrame) -> bool:
    """Whether every node of the edges (a, b) is a root or has one root, and none is both."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter(F.col("below") + F.col("above") > 1).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root being the least node it reaches; a root has no row.

    Union-find shrinks each partition to a forest, and once more after a shuffle, which
    joins small partitions; then large and small stars, each a grouped minimum and a
    join, until the edges are stars. Few edges are stars at once, so that they take no
    rounds.
    """
    forest = lambda e: e.mapInPandas(_forest, "a long, b long")
    edges = checkpoint(forest(forest(edges.select("a", "b").filter("a <> b")).repartition("a")).distinct())
    while not _stars(edges):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = checkpoint(down.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(small.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _agree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        if len(f):
            x = np.frombuffer(b"".join(f["sa"]), np.uint8).reshape(-1, SLOTS)
            y = np.frombuffer(b"".join(f["sb"]), np.uint8).reshape(-1, SLOTS)
            f = f[(x == y).sum(axis=1) >= SKETCH_LEAST * SLOTS]
        yield f[["a", "b"]]


def full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(cls, elements) of the given classes, in one more scan of the documents."""
    bits = filter_bits(nodes.select("cls"), FILTER_BITS, lambda h: [(h & U(FILTER_BITS - 1)).astype(np.int64)])
    wanted = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    sets = docs.mapInArrow(_full_sets(k, wanted), "cls long, elements array<long>").join(nodes, "cls", "left_semi").dropDuplicates(["cls"])
    return written(sets, "near-sets")


def links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The candidate pairs (a, b) of classes whose full sets are similar enough."""
    sketch = classes.select("cls", "sketch")
    sketched = pairs.join(sketch.withColumnsRenamed({"cls": "a", "sketch": "sa"}), "a").join(sketch.withColumnsRenamed({"cls": "b", "sketch": "sb"}), "b")
    pairs = checkpoint(sketched.select("a", "b", "sa", "sb").mapInPandas(_agree, "a long, b long"))
    sets = full_sets(docs, pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct(), k)
    full = pairs.join(sets.withColumnsRenamed({"cls": "a", "elements": "x"}), "a").join(sets.withColumnsRenamed({"cls": "b", "elements": "y"}), "b")
    both = F.size(F.array_intersect("x", "y"))
    ok = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    return checkpoint(full.filter(ok).select("a", "b"))


def _block_links(percent: int):
    """Links between the asking classes of a block and all classes of it that are in other components; one per pair of components."""

    def run(rows: pa.Table) -> pa.Table:
        cls, root, asks = rows["cls"].to_numpy(), rows["root"].to_numpy(), rows["asks"].to_numpy(zero_copy_only=False)
        lists = rows["elements"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sizes = np.diff(offsets)
        others = np.flatnonzero(~asks)
        place = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in others]) if len(others) else np.zeros(0, np.int64)
        values, who = flat[place], np.repeat(np.arange(len(others)), sizes[others])
        order = np.argsort(values, kind="stable")
        values, who = values[order], who[order]
        found: list[tuple[int, int]] = []
        for q in np.flatnonzero(asks):
            mine = flat[offsets[q] : offsets[q + 1]]
            lo, hi = np.searchsorted(values, mine), np.searchsorted(values, mine, side="right")
            n = hi - lo
            total = int(n.sum())
            at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            both = np.bincount(who[at], minlength=len(others))
            ok = (100 * both >= percent * (len(mine) + sizes[others] - both)) & (root[others] != root[q])
            hit = others[np.flatnonzero(ok)]
            _, once = np.unique(root[hit], return_index=True)
            found += [(int(cls[q]), int(cls[r])) for r in hit[once]]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def missing_links(members: DataFrame, roots: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links inside buckets between classes that are in different components so far."""
    placed = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", F.coalesce("root", "cls").alias("root"))
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    open_buckets = sizes.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    open_buckets = open_buckets.select("bucket", F.col("top.root").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("n_ask"), F.ceil(F.col("all") / BLOCK).cast("int").alias("n_all"))
    rows = checkpoint(placed.join(open_buckets, "bucket"))
    sets = full_sets(docs, rows.select("cls").distinct(), k)
    block = lambda n: F.pmod(F.xxhash64("cls"), n).cast("int")
    told = rows.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("n_ask") - 1)), "j": block(F.col("n_all")), "asks": F.lit(False)})
    asking = rows.filter("root <> top").withColumns({"i": block(F.col("n_ask")), "j": F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)), "asks": F.lit(True)})
    names = ["bucket", "i", "j", "cls", "root", "asks"]
    blocks = told.select(*names).union(asking.select(*names)).join(sets, "cls")
    return checkpoint(blocks.groupBy("bucket", "i", "j").applyInArrow(_block_links(percent), "a long, b long"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, cls (its set; null if empty), component_id and kept."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(docs.mapInArrow(_signatures(k), "doc_id long, n_shingles long, cls long, bands array<long>, sketch binary"), "near-signatures")
    full = signed.filter("n_shingles > 0")
    classes = written(full.groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "near-classes")
    buckets = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cls").alias("b")).filter("n > 1")
    members = written(buckets.join(shared.select("bucket", "b"), "bucket"), "near-buckets")
    first = members.filter("cls <> b").select(F.col("cls").alias("a"), "b").distinct()
    found = links(first, classes, docs, k, percent)
    roots = components(found)
    more = missing_links(members, roots, docs, k, percent)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    # only classes with links need a component; a component's classes are spread over SALT keys
    linked = roots.select(F.col("node").alias("cls"), "root").union(roots.select(F.col("root").alias("cls"), "root").distinct())
    linked = linked.join(classes.select("cls", "least_id"), "cls").withColumn("salt", F.pmod("cls", F.lit(SALT)))
    best = linked.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    named = linked.join(best, ["root", "salt"]).select("cls", "component_id")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cls")).alias("cls"))
    out = out.join(classes.select("cls", "least_id"), "cls", "left").join(named, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "least_id"))
    return out.select("doc_id", "n_shingles", "cls", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows and columns with one document of each group: that of the least id, null ids last.

    Rows are told apart by a hash of the whole row, so that null ids and ids that
    several texts share are judged like others. Two rows whose hashes collide differ in
    a second hash: both stay if one of them does, so a collision deletes nothing that
    would have stayed. Rows without words stay, all of them.
    """
    name = free_name(df, "row")
    keyed = df.withColumn(name, row_key(df))
    groups = near_duplicates(keyed, name, text_col, k, percent).select(F.col("doc_id").alias(name), "component_id", "n_shingles").distinct()
    ids = groups.join(keyed.select(name, F.col(id_col).alias("id")).distinct(), name)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(name).alias("own"))).alias("best")
    alone = groups.filter("n_shingles = 0").select(F.col(name).alias("own"))
    kept = written(ids.filter("n_shingles > 0").groupBy("component_id").agg(best).select("best.own").withColumn("once", F.lit(True)).union(alone.withColumn("once", F.lit(False))), "near-kept")
    of = lambda some: keyed.join(kept.filter(some).select(F.col("own").alias(name)), name, "left_semi")
    second = free_name(keyed, "again")
    one = of("once").withColumn(second, row_key(df, 1)).dropDuplicates([name, second])
    own = [F.col(f"`{c}`") for c in df.columns]
    return one.select(*own).unionByName(of("not once").select(*own))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents
), s AS (
  SELECT DISTINCT rid, g FROM (
    SELECT rid, ws[p] || ' ' || ws[p + 1] AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 1)) AS p FROM w WHERE len(ws) > 1)
    UNION ALL SELECT rid, ws[1] FROM w WHERE len(ws) = 1)
), n AS (
  SELECT rid, count(*) AS n FROM s GROUP BY rid
), l AS (
  SELECT a.rid AS a, b.rid AS b FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid
  JOIN n x ON x.rid = a.rid JOIN n y ON y.rid = b.rid
  GROUP BY a.rid, b.rid, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), r(a, b) AS (
  SELECT rid, rid FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT r.a AS rid, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.b GROUP BY r.a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM w JOIN c USING (rid) LEFT JOIN n USING (rid)"""
