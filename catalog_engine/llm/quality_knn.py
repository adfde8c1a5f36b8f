"""Quality by nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled training rows (``SAMPLE``, chosen by hash of the id)
gives a latent space: square-rooted shares of byte-class bigrams and of repeated
words, centred, and projected on their leading singular directions. The sample's
vectors and labels are broadcast (their number is the bound; a row's features have
a fixed size, so the bound holds in bytes too). Every document's
vector is compared with all of them in exact blocked cosine products, and its
nearest neighbours vote with their similarity.

No shuffle takes place: one scan scores all documents. Defined results: a null or
empty text has no direction and gets the sample's share of label 1; with no
labelled rows at all every score is 0.5; labels other than 0 and 1 are ignored;
repeated rows score alike; a null id is held out of nothing and scores like any
other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textlib import buffers, sub_batches

SAMPLE = 4000
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 6
THRESHOLD = 0.3

#: Classes of bytes: letters by themselves, capitals, digits and signs by kind.
SIGNS = {" ": 28, "\n": 29, ".": 30, ",": 31, "!": 32, "|": 33, "#": 34, "*": 35, "$": 36, "%": 37, "&": 38, "<": 39, ">": 39, '"': 40, "'": 40, "(": 41, ")": 41, ":": 42, ";": 42, "=": 43, "+": 43, "-": 43, "_": 43}
CLASSES, EXTRAS = 64, 2


def _classes() -> np.ndarray:
    out = np.full(256, 63, np.int64)
    out[33:127] = 44
    out[97:123] = np.arange(26)
    out[65:91] = 26
    out[48:58] = 27
    for sign, c in SIGNS.items():
        out[ord(sign)] = c
    out[0x80:0xC0] = 46 + (np.arange(0x80, 0xC0) & 15)
    out[0xC0:] = 62
    out[0xC3] = 45
    return out


_class = _classes()
WIDTH = CLASSES * CLASSES + EXTRAS


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, rows x WIDTH) of each sub-batch: square roots of shares, zero for empty texts."""
    offsets, data = buffers(column)
    for words in sub_batches(column, 512):
        n = words.hi - words.lo
        raw = _class[data[offsets[words.lo] : offsets[words.hi]]]
        row = np.repeat(np.arange(n), np.diff(words.offsets))
        x = np.zeros((n, WIDTH), np.float32)
        if len(raw) > 1:
            same = row[1:] == row[:-1]
            codes = (row[1:] * CLASSES + raw[:-1]) * CLASSES + raw[1:]
            x[:, : CLASSES * CLASSES] = np.bincount(codes[same], minlength=n * CLASSES * CLASSES).reshape(n, -1)
        x[:, : CLASSES * CLASSES] /= np.maximum(1, x.sum(axis=1, keepdims=True))
        h, of = words.hashes, words.rows()
        if len(h):
            counts = np.maximum(1, words.counts)
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
            x[:, -1] = np.bincount(of[again], minlength=n) / counts
            order = np.lexsort((h, of))
            twin = np.zeros(len(h), bool)
            twin[1:] = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
            x[:, -2] = np.bincount(of[order][twin], minlength=n) / counts
        yield words.lo, words.hi, np.sqrt(x)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled rows as half-precision bytes: a fixed size each, however long the text."""
    for batch in batches:
        for lo, hi, x in features(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])


def fit(x: np.ndarray, labels: list[int], dimensions: int = DIMENSIONS, seed: int = 6) -> dict | None:
    """Centre, directions, unit vectors and labels of the feature rows of a labelled sample."""
    if not len(x):
        return None
    centre = x.mean(axis=0)
    x = x - centre
    k = min(dimensions, len(x), WIDTH)
    q = np.linalg.qr(x @ np.random.default_rng(seed).standard_normal((WIDTH, k + 16)).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    directions = np.linalg.svd(q.T @ x, full_matrices=False)[2][:k].T
    vectors = _unit(x @ directions)
    return {"centre": centre, "directions": directions, "vectors": vectors, "labels": np.asarray(labels, np.float32)}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))


def vote(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of feature rows."""
    prior = float(model["labels"].mean())
    out = np.full(len(x), prior)
    full = np.flatnonzero(x.any(axis=1))
    for i in range(0, len(full), 256):
        rows = full[i : i + 256]
        cosine = _unit((x[rows] - model["centre"]) @ model["directions"]) @ model["vectors"].T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(0, np.take_along_axis(cosine, near, axis=1)).astype(float) ** SHARPNESS + 1e-6
        out[rows] = (weight * model["labels"][near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0, 1)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if model.value is not None:
                for lo, hi, x in features(batch.column("text")):
                    scores[lo:hi] = vote(model.value, x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores)], ["doc_id", "held_out", "score"])

    return run


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of rows in fold 0 are never read."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False)))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    marks = marks.filter(fold != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    found = docs.filter("not held_out").join(F.broadcast(marks), "doc_id").select("doc_id", "text", "label")
    rows = found.mapInArrow(_sample, "doc_id long, label int, x binary").orderBy("doc_id", "label", "x").limit(sample).collect()  # 8 KB each
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, WIDTH), np.float32)
    model = fit(x, [r["label"] for r in rows])
    shared = df.sparkSession.sparkContext.broadcast(model)
    out = docs.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
