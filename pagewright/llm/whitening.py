"""Embedding whitening: distributed centred scatter, cyclic Jacobi on the driver, broadcast whitening matrix.

Entries become whole numbers first (floor(scale * c) + shift), so that sums and deviations are exact.  One pass gives count and
sums, one the scatter of the centred vectors (a matrix a task, its rows added up by key), one the covariance of the whitened
vectors, which measures what the whitening attains, and the last one whitens.  Vectors are centred before anything is
multiplied: by the rounded mean in whole numbers, then by the rest of the mean, so that no digits cancel.

The driver gets the d x d covariance and turns it by Jacobi rotations, sweep after sweep over all pairs, until every
off-diagonal entry vanishes beside the two diagonal ones.  That relative criterion keeps small eigenvalues accurate.  The
pairs of a sweep go in rounds of disjoint pairs, each applied in one step.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out; vectors of each dimension are
fitted by themselves; a component without variance (also: all of a single vector or of equal ones) has a null `whitened` and
no part in identity_error; there are as many components as dimensions at most, so an empty vector gives no row; rows with a null
or repeated id all count; labels and extra columns are ignored, whatever their names; equal eigenvalues keep the order of the
rotations; an empty table gives an empty result; entries of 2^40 / scale or more in size, and deviations beyond 64 bits, raise an error.
The input is read four times: hand over a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import added, dense, lengths, whole

MOST = 1 << 40
EPS = np.finfo(float).eps


@dataclass
class Fit:
    """Of the vectors of one dimension: count, sums, whole and remaining mean, whitening matrix, shares of variance."""

    n: int
    sums: list[int]
    mean: np.ndarray
    rest: np.ndarray
    matrix: np.ndarray | None = None
    centre: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) - self.rest

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n * x - sum) ** 2, exact."""
        rest = np.array([s - self.n * int(m) for s, m in zip(self.sums, self.mean)], object)
        off = x - self.mean
        most = self.n * int(np.abs(off).max(initial=0)) + max(map(abs, rest), default=0)
        if most * most * x.shape[1] < 1 << 63:
            off = self.n * off - rest.astype(np.int64)
            return np.einsum("ij,ij->i", off, off)
        off = self.n * off.astype(object) - rest
        total = (off * off).sum(1)
        if max(total) >= 1 << 63:
            raise OverflowError("a deviation does not fit 64 bits")
        return total.astype(np.int64)


def jacobi(a: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors (columns, largest entry positive) of a symmetric matrix."""
    a = np.array(a, float)
    d = len(a)
    v = np.eye(d)
    around = np.arange(d + d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(around) - 1):
            p, q = around[: len(around) // 2], around[::-1][: len(around) // 2]
            there = (p < d) & (q < d)
            p, q = p[there], q[there]
            pq, pp, qq = a[p, q], a[p, p], a[q, q]
            on = np.abs(pq) > EPS * np.sqrt(np.abs(pp * qq))
            on &= np.abs(pq) > 1e-290
            if on.any():
                turned = True
                p, q, pq, pp, qq = p[on], q[on], pq[on], pp[on], qq[on]
                tau = (qq - pp) / (2 * pq)
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1, tau))
                c = 1 / np.hypot(1, t)
                s = t * c
                row, other = a[p], a[q]
                a[p], a[q] = c[:, None] * row - s[:, None] * other, s[:, None] * row + c[:, None] * other
                for m in (a, v):
                    column, other = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * column - s * other, s * column + c * other
                a[p, p], a[q, q], a[p, q], a[q, p] = pp - t * pq, qq + t * pq, 0, 0
            around = np.r_[around[:1], around[-1:], around[1:-1]]
        if not turned:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    e, v = e[order], v[:, order]
    return e, v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0) if d else v


def _by_dimension(batches, scale: int, shift: int):
    """(ids, integers) of the valid vectors, a dimension and batch at a time."""
    for batch in batches:
        for d in np.unique(lengths(batch.column(1))).tolist():
            if d > 0:
                at, x = dense(batch.column(1), d)
                if len(at):
                    yield batch.column(0).take(pa.array(at)), whole(x, scale, MOST) + shift


def _sums(scale: int, shift: int):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for _, x in _by_dimension(batches, scale, shift):
            d = x.shape[1]
            total[d] = total.get(d, 0) + x.sum(0)
            count[d] = count.get(d, 0) + len(x)
        for d, s in total.items():
            columns = [np.full(d, d, np.int32), np.arange(d, dtype=np.int32), s, np.full(d, count[d])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d", "i", "s", "n"])

    return run


def _scatter(fits, scale: int, shift: int, whitened: bool):
    """Rows of the scatter matrix of the centred (or whitened) vectors; in a last row their sums."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for _, x in _by_dimension(batches, scale, shift):
            fit = fits.value[x.shape[1]]
            z = fit.centred(x)
            if whitened:
                z = z @ fit.matrix - fit.centre
            part = np.concatenate([z.T @ z, z.sum(0)[None]])
            total[x.shape[1]] = total.get(x.shape[1], 0) + part
        for d, m in total.items():
            columns = [pa.array(np.full(len(m), d, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)), pa.array(m.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["d", "i", "v"])

    return run


def _matrices(rows: DataFrame) -> dict[int, np.ndarray]:
    found: dict[int, dict[int, list]] = {}
    for r in added(rows).collect():  # a matrix for each dimension
        found.setdefault(r.d, {})[r.i] = r.v
    return {d: np.array([m[i] for i in range(len(m))]) for d, m in found.items()}


def _whitened(fits, scale: int, shift: int):
    def run(batches):
        for ids, x in _by_dimension(batches, scale, shift):
            fit = fits.value[x.shape[1]]
            w, k = fit.centred(x) @ fit.matrix, len(fit.explained)
            w = np.pad(w, ((0, 0), (0, k - w.shape[1])))
            missing = np.tile(np.arange(k) >= fit.matrix.shape[1], len(x))
            each = np.repeat(np.arange(len(x)), k)
            columns = [
                ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), fit.n)),
                pa.array(fit.deviation(x)[each]), pa.array(w.ravel(), mask=missing), pa.array(np.tile(fit.explained, len(x))), pa.array(np.full(len(each), fit.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def fit(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, vec_id: str = "vec_id", embedding: str = "embedding") -> dict[int, Fit]:
    """The whitening of the vectors of each dimension."""
    spark, rows = vectors.sparkSession, _rows(vectors, vec_id, embedding)
    fits: dict[int, Fit] = {}
    sums = rows.mapInArrow(_sums(scale, shift), "d int, i int, s long, n long").groupBy("d", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    for r in sums.orderBy("d", "i").collect():  # a number for each dimension
        fits.setdefault(r.d, Fit(r.n, [], None, None)).sums.append(r.s)
    for f in fits.values():
        f.mean = np.array([(2 * s + f.n) // (2 * f.n) for s in f.sums], np.int64)
        f.rest = np.array([(s - f.n * int(m)) / f.n for s, m in zip(f.sums, f.mean)])
    shared = spark.sparkContext.broadcast(fits)
    for d, m in _matrices(rows.mapInArrow(_scatter(shared, scale, shift, False), "d int, i int, v array<double>")).items():
        f = fits[d]
        v = m[:-1] / f.n
        e, axes = jacobi((v + v.T) / 2)
        e, axes = e[:components], axes[:, :components]
        some = e > np.trace(v) * d * EPS
        f.explained = np.where(some, e, 0) / np.trace(v) if np.trace(v) > 0 else np.zeros(len(e))
        f.matrix = axes[:, some] / np.sqrt(e[some])
        f.centre = (m[-1] / f.n) @ f.matrix
    shared = spark.sparkContext.broadcast(fits)
    for d, m in _matrices(rows.mapInArrow(_scatter(shared, scale, shift, True), "d int, i int, v array<double>")).items():
        c = m[:-1] / fits[d].n
        fits[d].identity_error = float(np.abs(c - np.eye(len(c))).max(initial=0))
    return fits


def _rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    return vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"))


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    fits = vectors.sparkSession.sparkContext.broadcast(fit(vectors, components, scale, shift, vec_id, embedding))
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return _rows(vectors, vec_id, embedding).mapInArrow(_whitened(fits, scale, shift), schema)
