"""Embedding whitening: principal directions by spectral divide-and-conquer, then a broadcast projection.

Every vector entry ``c`` becomes the integer ``floor(scale * c)``. Each distinct integer vector counts
once in the fit: their number ``n`` and sums ``S`` are exact integers, their covariance is centred on
``S / n`` before multiplying and summed as partial matrices, one per task. The eigenvectors of that
``d x d`` matrix come from **QDWH spectral divide-and-conquer**: the polar factor of the covariance less a
shift is +1 above the shift and -1 below it, so ``(U + I) / 2`` projects on one invariant subspace and
``(I - U) / 2`` on the other, and each half is split in turn until components stand alone. Only the mean
and the chosen directions (``d`` numbers each) go to the tasks that whiten the rows.

Defined cases: null vectors and those with a null or non-finite entry are dropped, and so are those whose
length is not that of most distinct vectors (the longer on a tie). Repeated vectors and ids are rows like
any other; ids may be null. Equal eigenvalues give some orthonormal basis of their space, the same for all
rows. A direction without variance (up to rounding) whitens to 0. A squared deviation beyond 64 bits is
null. An empty table gives no rows. Memory on the driver and in a task is a few ``d x d`` matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexalia.llm import rows as R

EPS = np.finfo(float).eps


# Spectral divide-and-conquer -----------------------------------------------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iterations (QDWH)."""
    m = len(a)
    x = a / np.linalg.norm(a)
    low = max(1 / np.linalg.norm(np.linalg.inv(x)) if np.linalg.cond(x) < 1 / EPS else 0.0, EPS)
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:  # by an orthogonal factor, as the normal matrix would be too ill-conditioned
            factor, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(m)]))
            y = q / r * x + (p - q / r) / np.sqrt(r) * factor[:m] @ factor[m:].T
        else:
            y = q / r * x + (p - q / r) * np.linalg.solve(np.eye(m) + r * x.T @ x, x.T).T
        y = (y + y.T) / 2
        moved = np.linalg.norm(y - x)
        x, low = y, min(low * (p + q * square) / (1 + r * square), 1.0)
        if moved <= np.cbrt(EPS) and 1 - low <= 4 * EPS:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int, float]:
    """An orthonormal basis whose first ``k`` columns belong to eigenvalues above ``shift``, and its error."""
    m = len(a)
    projector = (polar_factor(a - shift * np.eye(m)) + np.eye(m)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < m:
        return np.eye(m), k, np.inf
    start = np.random.default_rng(m).normal(size=(m, m))
    basis, _ = np.linalg.qr(np.hstack([projector @ start[:, :k], start[:, k:] - projector @ start[:, k:]]))
    basis, _ = np.linalg.qr(np.hstack([projector @ basis[:, :k], basis[:, k:]]))
    return basis, k, float(np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]))


def _divide(a: np.ndarray, tiny: float) -> np.ndarray:
    """Eigenvectors of a symmetric matrix as columns."""
    m = len(a)
    a = (a + a.T) / 2
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m))
    if m == 1 or spread <= tiny:
        return np.eye(m)
    best = None
    # The mean lies strictly between the extreme eigenvalues; a shift on an eigenvalue has no clean sign.
    for shift in (float(np.median(np.diag(a))), mean, *(mean + spread / m * f for f in (0.37, -0.41, 0.11, -0.13, 0.03))):
        found = _split(a, shift)
        if best is None or found[2] < best[2]:
            best = found
        if best[2] <= tiny:
            break
    basis, k, error = best
    if not np.isfinite(error):
        raise ArithmeticError("no shift separates the spectrum")
    upper, lower = basis[:, :k], basis[:, k:]
    return np.hstack([upper @ _divide(upper.T @ a @ upper, tiny), lower @ _divide(lower.T @ a @ lower, tiny)])


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    if not len(a) or not a.any():
        return np.zeros(len(a)), np.eye(len(a))
    scale = np.abs(a).max()
    b = a / scale
    vectors = _divide(b, 4 * len(a) * EPS * np.linalg.norm(b))
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ik,kj->j", vectors, b, vectors, optimize=True) * scale
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# Fit and projection --------------------------------------------------------------------------------

def _integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(scale)).cast("long"))


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _exact(x: np.ndarray, factor: int) -> np.ndarray:
    """``x``, as unbounded integers where ``factor`` times its largest entry could leave 62 bits."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return x if top * factor < 1 << 62 else x.astype(object)


def _sums(points: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column("_x"), d)
            n += len(x)
            total = total + _exact(x, len(x) + 1).sum(axis=0).astype(object)
        # Halves of 32 bits, so that sums of partial sums stay exact.
        cells = [n, *total.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d + 1), pa.int32()), pa.array([c >> 32 for c in cells], pa.int64()),
             pa.array([c & 0xFFFFFFFF for c in cells], pa.int64())], ["_i", "_high", "_low"])

    parts = points.mapInArrow(run, "_i int, _high long, _low long")
    cells = parts.groupBy("_i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("_high", "_low")])
    found = {r["_i"]: (int(r["_high"]) << 32) + int(r["_low"]) for r in cells.collect()}  # d + 1 rows
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(d)]


def _scatter(points: DataFrame, mean: np.ndarray, directions: np.ndarray | None = None) -> np.ndarray:
    """Sum of outer products of centred vectors, projected on ``directions`` where given."""
    d = len(mean)
    k = d if directions is None else directions.shape[1]
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = _matrix(batch.column("_x"), d) - mean
            if directions is not None:
                x = x @ directions
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["_i", "_j", "_v"])

    cells = points.mapInArrow(run, "_i int, _j int, _v double").groupBy("_i", "_j").agg(F.sum("_v").alias("_v"))
    out = np.zeros((k, k))
    for row in cells.collect():  # k * (k + 1) / 2 rows
        out[row["_i"], row["_j"]] = out[row["_j"], row["_i"]] = row["_v"]
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int | None = 4, scale: int = 256) -> DataFrame:
    """One row per usable vector: the id, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``whitened`` holds the first ``components`` (None: all) principal coordinates over their standard
    deviation, ``explained`` their shares of the variance. ``identity_error`` is the largest absolute
    entry of the whitened fit list's covariance minus the identity, measured on the list.
    """
    usable = R.bounded(vectors).where(_usable(F.col(vector_col))).select(
        F.col(id_col).alias("_id"), _integers(F.col(vector_col), scale).alias("_x"))
    distinct = R.stage(usable.select("_x").distinct(), "points")
    sizes = distinct.groupBy(F.size("_x").alias("_d")).count().orderBy(F.desc("count"), F.desc("_d")).limit(1).collect()
    d = sizes[0]["_d"] if sizes else 0
    points = distinct.where(F.size("_x") == d)
    n, sums = _sums(points, d) if d else (0, [])
    mean = np.array([s / n for s in sums])
    values, directions = eigen(_scatter(points, mean) / n) if n else (np.zeros(0), np.zeros((0, 0)))
    k = len(values) if components is None else min(components, len(values))
    total = float(values.sum())
    full = values[:k] > max(len(values), 1) * EPS * max(values.max(initial=0.0), 0.0) * 4
    scaled = directions[:, :k] * np.where(full, 1 / np.sqrt(np.where(full, values[:k], 1.0)), 0.0)
    explained = (values[:k] / total if total > 0 else np.zeros(k)).clip(0).tolist()
    error = float(np.abs(_scatter(points, mean, scaled[:, full]) / n - np.eye(full.sum())).max()) if full.any() else 0.0
    kind = usable.schema["_id"].dataType

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(sums, object)
        reach = max(map(abs, sums), default=0)
        for batch in batches:
            m = batch.num_rows
            x = _matrix(batch.column("_x"), d)
            top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
            if d * (n * top + reach) ** 2 < 1 << 62:
                deviation = ((x * n - s.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [v if v < 1 << 63 else None for v in ((x.astype(object) * n - s) ** 2).sum(axis=1)]
            places = pa.array(np.arange(m + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(np.full(m, n), pa.int64()), pa.array(deviation, pa.int64()),
                 pa.ListArray.from_arrays(places, pa.array(((x - mean) @ scaled).ravel())),
                 pa.ListArray.from_arrays(places, pa.array(np.tile(explained, m).astype(float))),
                 pa.array(np.full(m, error))], names)

    names = [id_col, "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [kind, T.LongType(), T.LongType(), T.ArrayType(T.DoubleType()), T.ArrayType(T.DoubleType()), T.DoubleType()]
    return usable.where((F.size("_x") == d) & F.lit(d > 0)).mapInArrow(
        project, T.StructType([T.StructField(name, t) for name, t in zip(names, kinds)]))
