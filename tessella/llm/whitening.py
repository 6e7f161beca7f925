"""Whitening by polarisation: every covariance from sums of squares alone.

The different vectors of whole numbers are the fit list. With their number n and the sums S,
each centred value n x - S is a whole number. Summed over the fit list are its squares, one
sum for each dimension, and the squares of the sums of two dimensions, one for each pair:
the variance of a sum less the two variances is twice the covariance. All sums are exact,
and each covariance is one exact quotient, rounded once. The matrix goes to ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written

#: Whole numbers of more than this are cut to it: doubles hold all smaller ones.
LARGEST = 2**53
#: Rows whose squares are summed at once, and bits of the parts that large numbers are split into.
ROWS, PART = 4096, 21
WHOLE = pa.decimal128(38, 0)


def whole_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """``id, dim, x array<long>``: floor(scale * c) + offset of the vectors that are neither null
    nor empty and hold only finite values."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    cut = lambda x: F.floor(F.least(F.greatest(F.lit(float(scale)) * x, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("long") + offset
    return rows.select("id", F.size("v").alias("dim"), F.transform("v", cut).alias("x"))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dim, rows, x)`` of a batch with columns ``dim`` and ``x``, in blocks of ``ROWS``."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        for i in range(0, len(at), ROWS):
            part = at[i : i + ROWS]
            lists = batch.column("x").take(pa.array(part))
            yield int(d), part, lists.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, as whole numbers that can't overflow even in pairs."""
    safe = 4 * n * int(np.abs(x).max(initial=0)) < 2**63 and max(map(abs, sums.tolist()), default=0) < 2**61
    return n * x - sums.astype(np.int64) if safe else n * x.astype(object) - sums


def square_sums(z: np.ndarray) -> np.ndarray:
    """Exact sums of the squares of each column, as Python's whole numbers."""
    if z.dtype == object:
        return (z * z).sum(0)
    largest = int(np.abs(z).max(initial=0))
    if largest * largest * max(1, len(z)) < 2**63:
        return (z * z).sum(0).astype(object)
    mask, parts = (1 << PART) - 1, (z & ((1 << PART) - 1), (z >> PART) & ((1 << PART) - 1), z >> 2 * PART)
    total = np.zeros(z.shape[1], object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts[i:], i):
            total += (a * b).sum(0).astype(object) * ((1 if i == j else 2) << PART * (i + j))
    return total


def pair_squares(y: np.ndarray) -> np.ndarray:
    """Sums of (y_i + y_j)^2 over the rows for i < j, and of y_i^2, as rows i, columns j >= i."""
    d = y.shape[1]
    out = np.zeros((d, d), object)
    for i in range(d):
        out[i, i] = square_sums(y[:, i : i + 1])[0]
        out[i, i + 1 :] = square_sums(y[:, i : i + 1] + y[:, i + 1 :])
    return out


def _sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each length the number of vectors and the sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = {}, {}
        for batch in batches:
            for d, _, x in by_length(batch):
                high, low = x >> 32, x & 0xFFFFFFFF
                count[d] = count.get(d, 0) + len(x)
                total[d] = total.get(d, 0) + high.sum(0).astype(object) * 2**32 + low.sum(0).astype(object)
        out = [(d, i, count[d], s) for d in count for i, s in enumerate(total[d])]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64()), pa.array([int(o[3]) for o in out], WHOLE)], ["dim", "i", "n", "s"])

    rows = fit.mapInArrow(add, "dim int, i int, n long, s decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    found: dict[int, dict[int, tuple]] = {}
    for r in rows:
        found.setdefault(r.dim, {})[r.i] = (int(r.n), int(r.s))
    return {d: (own[0][0], np.array([own[i][1] for i in range(d)], object)) for d, own in found.items()}


def _fits(fit: DataFrame, sums: dict, components: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length ``(w, explained)``: what a centred row is multiplied with (one column a
    component, nan where it has no variance) and each component's share of the variance."""

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                total[d] = total.get(d, 0) + pair_squares(centred(x, *sums[d]))
        for d, q in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(list(map(int, q[i, j])), WHOLE)], ["dim", "i", "j", "q"])

    def decompose(rows: pd.DataFrame) -> pd.DataFrame:
        d = int(rows["dim"].iloc[0])
        n = sums[d][0]
        q = np.zeros((d, d), object)
        q[rows["i"], rows["j"]] = [int(v) for v in rows["q"]]
        v = np.zeros((d, d))
        for i in range(d):
            v[i, i] = q[i, i] / n**3
            for j in range(i + 1, d):
                v[i, j] = v[j, i] = (q[i, j] - q[i, i] - q[j, j]) / (2 * n**3)
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        u = u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
        trace = sum(q.diagonal()) / n**3
        real = e > max(e[0], 0) * d * np.finfo(float).eps
        w = np.where(real, u / np.sqrt(np.where(real, e, 1)), np.nan)
        explained = np.maximum(e, 0) / trace if trace else np.full(len(e), np.nan)
        return pd.DataFrame({"dim": [d], "w": [w.ravel()], "explained": [explained]})

    squares = fit.mapInArrow(square, "dim int, i int, j int, q decimal(38,0)").groupBy("dim", "i", "j").agg(F.sum("q").cast("decimal(38,0)").alias("q"))
    rows = squares.groupBy("dim").applyInPandas(decompose, "dim int, w array<double>, explained array<double>").collect()
    return {r.dim: (np.array(r.w, float).reshape(r.dim, -1), np.array(r.explained, float)) for r in rows}


def _identity_error(fit: DataFrame, sums: dict, fits: dict) -> dict[int, float]:
    """For each length the largest entry by which the covariance of its whitened fit list, over
    the components that have variance, differs from the identity."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch):
                w = _project(centred(x, *sums[d]), sums[d][0], fits[d][0])
                w = np.concatenate([np.ones((len(w), 1)), w], 1)
                total[d] = total.get(d, 0) + w.T @ w
        for d, g in total.items():
            i, j = np.indices(g.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g.ravel())], ["dim", "i", "j", "g"])

    out = {}
    for r in fit.mapInArrow(multiply, "dim int, i int, j int, g double").groupBy("dim", "i", "j").agg(F.sum("g").alias("g")).collect():
        n, c = sums[r.dim][0], fits[r.dim][0].shape[1]
        out.setdefault(r.dim, np.zeros((c + 1, c + 1)))[r.i, r.j] = r.g / n
    errors = {}
    for d, g in out.items():
        cov = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:])
        real = np.isfinite(np.diag(cov))
        errors[d] = float(np.abs(cov[np.ix_(real, real)] - np.eye(real.sum())).max(initial=0)) if real.any() else float("nan")
    return errors


def _project(y: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    return (y / n).astype(float) @ w


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, for each row with
    a usable vector and each of the first components.

    Entries become x = floor(scale * c) + offset (beyond 2**53: that); the fit list holds each
    different x once, n of them with sums S; V is their covariance with divisor n. ``deviation``
    is the exact sum of (n x - S)^2 (null beyond a long), ``whitened`` x - S / n projected on the
    component's unit eigenvector over the root of its eigenvalue (the eigenvector's largest entry
    is positive), ``explained`` the eigenvalue over the trace.

    Null and empty vectors, and those that hold null or non-finite entries, are left out.
    Vectors are fitted with those of their own length; a vector of d < ``components`` entries has
    d components. A component without variance (all eigenvalues of equal rows) has ``whitened``
    null; without any variance ``explained`` and ``identity_error`` are null too. Rows of null or
    repeated ids stay; other columns are ignored; no rows give no rows. What comes to the driver
    and goes to tasks is n, S and d x ``components`` numbers for each length, however many rows.
    """
    rows = written(whole_rows(vectors, id_col, vector_col, scale, offset), "whiten-rows")
    fit = written(rows.select("dim", "x").distinct(), "whiten-fit")
    sums = _sums(fit)
    fits = _fits(fit, sums, components)
    errors = _identity_error(fit, sums, fits)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, x in by_length(batch):
                (n, s), (w, explained) = sums[d], fits[d]
                y = centred(x, n, s)
                ids, whole, c = batch.column("id").take(pa.array(part)), _deviation(y), w.shape[1]
                each = pa.array(np.repeat(np.arange(len(part)), c))
                number = lambda v: pa.array(v, pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(each), pa.array(np.tile(np.arange(1, c + 1), len(part)), pa.int32()), pa.array(np.full(len(part) * c, n), pa.int64()), whole.take(each),
                     number(_project(y, n, w).ravel()), number(np.tile(explained, len(part))), number(np.full(len(part) * c, errors[d]))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _deviation(y: np.ndarray) -> pa.Array:
    most = max(map(abs, (int(y.max(initial=0)), int(y.min(initial=0)))))
    if y.dtype != object and most * most * y.shape[1] < 2**63:
        return pa.array((y * y).sum(1), pa.int64())
    wide = y.astype(object)
    return pa.array([v if v < 2**63 else None for v in (wide * wide).sum(1)], pa.int64())
