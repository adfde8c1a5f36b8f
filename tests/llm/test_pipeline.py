"""The pipeline against a brute-force version on planted rows, and its stages' promises."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline

rng = np.random.default_rng(3)
VOCAB = ["the", "of", "and", "to"] * 15 + ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


@pytest.fixture
def sf(spark, tmp_path):
    clean = [(i, prose(60, i), f"s{i % 4}") for i in range(80)]
    leak = prose(30, 999)
    planted = [(100, "###" * 40, "s0"), (101, clean[0][1], "s1"), (102, clean[1][1] + " tail", "s2"), (103, f"{prose(30, 500)} {leak} {prose(20, 501)}", "s3"), (104, None, None), (105, "short text", "s0"), (None, f"{prose(25, 510)} {leak}", "s1"), (None, clean[2][1], "s2"), (3, prose(70, 7000), "s3")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in clean + planted], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_keep_clean_documents_and_drop_planted_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        steps.append(sorted(((r["doc_id"], len(r["text"])) for r in docs.select("doc_id", "text").collect()), key=str))
    clean = [(i, len(prose(60, i))) for i in range(80)] + [(3, len(prose(70, 7000)))]  # two texts of one id, both clean
    leaks = [(103, len(prose(30, 500)) + len(prose(30, 999)) + len(prose(20, 501)) + 2), (None, len(prose(25, 510)) + len(prose(30, 999)) + 1)]
    copies = [(101, len(prose(60, 0))), (102, len(prose(60, 1)) + 5), (None, len(prose(60, 2)))]
    assert steps[0] == sorted(clean + leaks + copies, key=str)
    assert steps[1] == sorted(clean + leaks, key=str)
    assert steps[2] == sorted(clean, key=str)


def test_run_equals_plain_python(spark, sf):
    """Rows of the run against the mix and the shard sizes worked out by hand from the clean documents."""
    got = corpus_pipeline.run(spark, sf).collect()
    docs = [(i, prose(60, i), f"s{i % 4}") for i in range(80)] + [(3, prose(70, 7000), "s3")]
    size = Counter()
    for _, t, s in docs:
        size[s] += len(t.split())
    total, weight = 1.5 * sum(size.values()), dict(zip(sorted(size), (5, 2, 1, 5)))
    free, level = set(size), 0.0
    while True:
        level = (total - sum(2 * size[s] for s in size if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        free -= over
    target = {s: int(level * weight[s]) if s in free else 2 * size[s] for s in size}
    rows = Counter()
    for s in size:  # documents in order of their keys: whole passes, then as many as the rest reaches into
        own = sorted((d for d in docs if d[2] == s), key=lambda d: hashlib.md5(f"{d[0]}:{hashlib.md5(d[1].encode()).hexdigest()}".encode()).hexdigest())
        passes, rest = divmod(target[s], size[s])
        for i, t, _ in own:
            rows[i, zlib.crc32(t.encode()), len(t.encode()) + 8] += passes + (rest > 0)
            rest -= len(t.split())
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in got) == +rows
    shards = Counter(r["shard"] for r in got)
    assert set(shards) == set(range(24)) and max(shards.values()) - min(shards.values()) <= 1
    for shard, n in shards.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))


def test_a_run_leaves_only_what_its_result_reads(spark, sf):
    import os

    from catalog_engine.llm.session import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, sf).count()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert rows and {n for n in left if n.startswith(("near-", "leak-", "mix-", "stage-"))} == {"stage-mixing"}
