"""Embedding whitening by pivoted Cholesky of the centred scatter and one-sided Jacobi on its triangular factor.

Entries become whole numbers x = floor(256 c), so all sums are exact and do not
depend on how rows are dealt. Over the fit list (each distinct vector once) one pass
counts and sums, a second one multiplies vectors that are centred by the whole number
nearest to the mean; the rest of the mean, at most a half, is taken off exactly
afterwards. Blocks of a batch are multiplied in doubles where every partial sum stays
below 2^53 and in Python integers otherwise. Only the scatter, dimensions squared
numbers, reaches the driver. There Cholesky with diagonal pivots gives V = L L', plane
rotations make the columns of L orthogonal, the squared column norms are the
eigenvalues and the normalised columns the components. All rows are then projected
where they lie.

Defined results: a vector that is null, holds a null, NaN or infinity, or an entry
whose x is 2^62 or more in size, is dropped; so are vectors of another length than the
most frequent one (of equally frequent lengths the greatest). Repeated rows and null
ids are rows like others; constant dimensions get no component, so there may be fewer
than asked, and none when all vectors are equal; an empty table gives an empty
result; a deviation beyond a long is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written

SCALE, COMPONENTS = 256, 4
#: Entries stay below this in size after scaling, so that differences of two fit a long.
LARGEST = 2.0**62
#: Sums travel in two halves, so that no decimal runs over.
HALF = 10**18
BATCH_VALUES = 1 << 20
SWEEPS = 60
EPS = np.finfo(float).eps


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that stay, entries as longs."""
    entries = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < LARGEST)
    good = entries.filter(F.col("c").isNotNull() & F.forall("c", fits))
    x = good.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE)).alias("x"))
    size = x.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return x.filter(F.size("x") == (size["size"] if size else 0)).filter(F.size("x") > 0)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a batch as long matrices of at most BATCH_VALUES numbers, with the row where each begins."""
    column = batch.column("x")
    rows = len(column)
    if not rows:
        return
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(rows, -1)
    step = max(1, BATCH_VALUES // x.shape[1])
    for i in range(0, rows, step):
        yield i, x[i : i + step]


def _product(y: np.ndarray) -> np.ndarray:
    """y'y, exact, as Python integers."""
    most = int(np.abs(y).max(initial=0))
    if most >= 1 << 26:
        y = y.astype(object)
        return y.T @ y
    rows = max(1, (1 << 53) // max(1, most * most))
    out = 0
    for i in range(0, len(y), rows):
        part = y[i : i + rows].astype(float)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def _summed(x: DataFrame, block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of block(matrix), an array of Python integers whose size follows the dimension: added in each task, then by place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            for _, m in _matrices(b):
                total = total + block(m)
        if not isinstance(total, int):
            flat = total.ravel()
            text = lambda values: pa.array([str(v) for v in values], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), text(flat // HALF), text(flat % HALF)], names=["place", "high", "low"])

    parts = x.mapInArrow(add, "place int, high string, low string")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = parts.groupBy("place").agg(whole("high"), whole("low")).collect()
    out = np.zeros(len(sums), object)
    for r in sums:
        out[r["place"]] = int(r["high"]) * HALF + int(r["low"])
    return out


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L L'; as many columns as the rank."""
    a, d = v.copy(), len(v)
    order, lower = np.arange(d), np.zeros_like(v)
    least = d * EPS * max(np.diag(a).max(initial=0), 0)
    for k in range(d):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if a[p, p] <= least:
            return lower[:, :k], order
        for m in (a, lower):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        lower[k, k] = np.sqrt(a[k, k])
        lower[k + 1 :, k] = a[k + 1 :, k] / lower[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(lower[k + 1 :, k], lower[k + 1 :, k])
    return lower, order


def orthogonal_columns(g: np.ndarray) -> np.ndarray:
    """g times a rotation, with orthogonal columns: one-sided Jacobi, disjoint pairs of columns at a time."""
    g = np.concatenate([g, np.zeros((len(g), g.shape[1] % 2))], axis=1)
    n = g.shape[1]
    order = np.arange(n)
    for _ in range(SWEEPS):
        off = 0.0
        for _ in range(n - 1):
            p, q = order[: n // 2], order[n // 2 :][::-1]
            gp, gq = g[:, p], g[:, q]
            a, b, c = (gp * gp).sum(0), (gq * gq).sum(0), (gp * gq).sum(0)
            scale = np.sqrt(a * b)
            far = np.divide(np.abs(c), scale, out=np.zeros_like(c), where=scale > 0)
            off = max(off, far.max(initial=0))
            turn = far > EPS
            zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            g[:, p], g[:, q] = cos * gp - cos * t * gq, cos * t * gp + cos * gq
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if off <= 4 * EPS * np.sqrt(len(g)):
            break
    return g


@dataclass
class Whitening:
    n: int
    centre: np.ndarray  # the whole number nearest to the mean of each dimension
    rest: np.ndarray  # Python integers: sums over the fit list of x - centre
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimensions x components
    trace: float
    identity_error: float = 0.0

    def centred(self, m: np.ndarray) -> np.ndarray:
        return (m - self.centre).astype(float) - (self.rest / self.n).astype(float)

    def whiten(self, m: np.ndarray) -> np.ndarray:
        return self.centred(m) @ (self.vectors / np.sqrt(self.values))


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From whole vectors; None where there are none or all are equal."""
    once = written(x.select("x").distinct(), "fit-list")
    sums = _summed(once, lambda m: np.append(m.astype(object).sum(axis=0), len(m)))
    if not len(sums):
        return None
    n, total = int(sums[-1]), sums[:-1]
    nearest = (2 * total + n) // (2 * n)
    centre = nearest.astype(np.int64)
    rest = total - n * nearest
    scatter = _summed(once, lambda m: _product(m - centre)).reshape(len(rest), -1)
    v = ((n * scatter - np.outer(rest, rest)) / (n * n)).astype(float)
    lower, order = pivoted_cholesky(v)
    if not lower.shape[1]:
        return None
    turned = orthogonal_columns(lower)
    values = (turned * turned).sum(0)
    first = np.argsort(-values, kind="stable")[: min(components, lower.shape[1])]
    vectors = np.zeros((len(v), len(first)))
    vectors[order] = turned[:, first] / np.sqrt(values[first])
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(first))])
    fitted = Whitening(n, centre, rest, values[first], vectors, float(np.trace(v)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(first)
        total = np.zeros((k, k))
        for b in batches:
            for _, m in _matrices(b):
                w = fitted.whiten(m)
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["place", "value"])

    found = once.mapInArrow(products, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    covariance = np.zeros(len(first) ** 2)
    for r in found:
        covariance[r["place"]] = r["value"] / n
    fitted.identity_error = float(np.abs(covariance.reshape(len(first), -1) - np.eye(len(first))).max())
    return fitted


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per remaining vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    x = whole_vectors(df, id_col, vector_col)
    schema = f"vec_id {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(x, components)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted.values)
        rest = np.array([int(r) for r in fitted.rest], np.int64)  # below n / 2 in size
        for b in batches:
            for at, m in _matrices(b):
                y = m - fitted.centre
                off = fitted.n * y - rest  # exact modulo 2^64, and so is the sum: right wherever it fits a long
                about = ((fitted.n * y.astype(float) - rest.astype(float)) ** 2).sum(axis=1)
                deviation = pa.array((off * off).sum(axis=1), mask=about >= 2.0**63)
                rows = len(m)
                ids = b.column("vec_id").slice(at, rows).take(pa.array(np.repeat(np.arange(rows), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, fitted.n)), deviation.take(pa.array(np.repeat(np.arange(rows), k)))]
                columns += [pa.array(fitted.whiten(m).ravel()), pa.array(np.tile(fitted.values / fitted.trace, rows)), pa.array(np.full(rows * k, fitted.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(project, schema)
