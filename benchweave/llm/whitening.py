"""Embedding whitening by the principal components of all vectors.

Method: QDWH spectral divide-and-conquer. Vectors become integers, whose sums are exact; a second pass adds up the
products of centred vectors task by task. On the d x d covariance, the polar factor of the matrix minus a shift is the
sign of every eigenvalue about that shift; half of it plus the identity projects on the upper invariant subspace. The
covariance is restricted to both subspaces and split again until every part is one component. The components, at most
``components`` x d numbers, go to the tasks that whiten the rows.

Vectors that are null, empty, or hold null or non-finite entries are dropped; so are vectors whose length is not the
commonest one (the shortest of several). Repeated rows and repeated or null ids count as separate rows. Directions in
which the vectors do not vary (an eigenvalue at rounding level) have no whitened value and no rows; fewer components than
asked for remain then. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EXACT = 1 << 53
_TINY = np.finfo(np.float64).eps


def polar_sign(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps through QR factors.

    Each step maps a singular value x to x(a+bx²)/(1+cx²) with the weights that are best for the lower bound kept in
    ``least``; about six steps suffice for any condition that doubles can hold.
    """
    d = len(a)
    size = np.linalg.norm(a, 2)
    if size == 0:
        return np.eye(d)
    x = a / size
    least = max(1 / (np.linalg.cond(x, 1) * math.sqrt(d)), _TINY)
    for _ in range(60):
        gap = max(0.0, 4 * (1 - least**2) / least**4) ** (1 / 3)
        root = math.sqrt(1 + gap)
        wa = root + 0.5 * math.sqrt(max(0.0, 8 - 4 * gap + 8 * (2 - least**2) / (least**2 * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _r = np.linalg.qr(np.vstack([math.sqrt(wc) * x, np.eye(d)]))
        new = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:d] @ q[d:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        least = min(1.0, least * (wa + wb * least**2) / (1 + wc * least**2))
        if moved <= 10 * _TINY * math.sqrt(d) or (least >= 1 - 10 * _TINY and moved <= _TINY ** (1 / 3)):
            break
    # One Newton-Schulz step removes what rounding left.
    return 1.5 * x - 0.5 * x @ (x @ x)


def _basis(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement: subspace iteration, which is exact in two steps."""
    start = projector[:, np.argsort(-np.diag(projector), kind="stable")[:rank]]
    rng = np.random.default_rng(len(projector) * 1009 + rank)
    start = start + 1e-3 * projector @ rng.standard_normal((len(projector), rank))
    q = np.linalg.qr(start)[0]
    q = np.linalg.qr(projector @ q)[0]
    whole = np.linalg.qr(np.hstack([q, np.eye(len(projector))]))[0]
    rest = whole[:, rank:]
    rest = np.linalg.qr(rest - q @ (q.T @ rest))[0]
    return q, rest


def spectral_split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by recursive spectral projectors."""
    a = (a + a.T) / 2
    d = len(a)
    if d <= 1:
        return np.diag(a).copy(), np.eye(d)
    scale = np.abs(a).max()
    off = np.abs(a - np.diag(np.diag(a))).max()
    if off <= 4 * _TINY * scale * _TINY or scale == 0:
        order = np.argsort(-np.diag(a), kind="stable")
        return np.diag(a)[order], np.eye(d)[:, order]
    for shift in _shifts(a):
        projector = (polar_sign(a - shift * np.eye(d)) + np.eye(d)) / 2
        rank = int(round(np.trace(projector)))
        if 0 < rank < d and np.abs(projector @ projector - projector).max() < 1e-6:
            break
    else:
        # No shift separates: all eigenvalues agree to rounding, and any basis serves.
        order = np.argsort(-np.diag(a), kind="stable")
        return np.diag(a)[order], np.eye(d)[:, order]
    upper, lower = _basis(projector, rank)
    values, vectors = [], []
    for part in (upper, lower):
        e, v = spectral_split(part.T @ a @ part)
        values.append(e)
        vectors.append(part @ v)
    return np.concatenate(values), np.hstack(vectors)


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Candidate cuts of the spectrum: the median and mean of the diagonal, then halves between the Gershgorin bounds."""
    diagonal = np.diag(a)
    yield float(np.median(diagonal))
    yield float(diagonal.mean())
    # The diagonal of a symmetric matrix majorises from within, so both of these lie strictly inside unless all agree.
    yield float((diagonal.max() + diagonal.min()) / 2)
    radius = np.abs(a).sum(axis=1) - np.abs(diagonal)
    low, high = float((diagonal - radius).min()), float((diagonal + radius).max())
    for depth in range(1, 8):
        for k in range(1, 1 << depth, 2):
            yield low + (high - low) * k / (1 << depth)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``spectral_split`` with one cleaning step: vectors orthonormal to rounding, values as Rayleigh quotients, falling."""
    _, v = spectral_split(a)
    v = np.linalg.qr(v)[0] if len(v) else v
    e = np.einsum("ij,ij->j", v, a @ v)
    # First-order correction by the remaining off-diagonal couplings of separated components.
    rest = v.T @ a @ v
    gap = e[None, :] - e[:, None]
    far = np.abs(gap) > 1e-8 * max(np.abs(e).max(initial=0.0), 1e-300)
    v = np.linalg.qr(v + v @ np.where(far, rest / np.where(far, gap, 1.0), 0.0))[0] if len(v) else v
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


@dataclass(frozen=True)
class Whitening:
    """The fitted transform: row count, exact sums, eigenvalues, unit components (rows), their share, and its check."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lifted(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n*x - S, exact: 64-bit integers, or Python integers where those could overflow."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n in doubles, rounded once at the end."""
    return (_lifted(x, n, sums) / n).astype(np.float64)


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``(id, x)`` of the rows that take part: x = floor(scale*c) + offset for every entry c, as longs."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(finite & (F.size("v") > 0), F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return rows.where(F.size("v") == d).select("id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + offset).alias("x"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            n += len(x)
            own = x.sum(axis=0, dtype=np.int64) if np.abs(x).max() < 1 << 40 else x.astype(object).sum(axis=0)
            total = own.astype(object) if total is None else total + own
    if n:
        columns = [pa.array(np.arange(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "n", "total"])


def _products(n: int, sums: tuple[int, ...], weights: np.ndarray | None):
    """Sums over rows of the products of (projected) centred vectors, one row per entry of the upper triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = centred(_matrix(batch.column("x")), n, sums)
                if weights is not None:
                    y = y @ weights
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "total"])

    return run


def _covariance(x: DataFrame, n: int, sums: tuple[int, ...], d: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Centred before multiplying, divisor n. Tasks send d(d+1)/2 sums each, which Spark adds up per entry."""
    parts = x.mapInArrow(_products(n, sums, weights), "i int, j int, total double")
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["total"] / n
    return out


def fit(x: DataFrame, components: int = 32) -> Whitening | None:
    """Fit on every row of ``quantised``'s result; ``None`` without rows."""
    x = x.select("x")
    totals = x.mapInArrow(_sums, "i int, n long, total decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("i").collect()
    if not totals:
        return None
    n, sums = totals[0]["n"], tuple(int(r["total"]) for r in totals)
    v = _covariance(x, n, sums, len(sums))
    e, vectors = eigen(v)
    kept = min(components, int((e > len(e) * _TINY * max(e[0], 0.0)).sum()))
    weights = vectors[:, :kept] / np.sqrt(e[:kept])
    check = _covariance(x, n, sums, kept, weights) - np.eye(kept) if kept else np.zeros((0, 0))
    return Whitening(n, sums, e[:kept], vectors[:, :kept].T, e[:kept] / np.trace(v) if kept else e[:0], float(np.abs(check).max(initial=0.0)))


def _apply(fitted: Whitening, key_type: pa.DataType):
    weights = fitted.components.T / np.sqrt(fitted.values)
    k = len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                lifted = _lifted(_matrix(batch.column("x")), fitted.n, fitted.sums)
                rows = batch.num_rows
                if lifted.dtype != object and int(np.abs(lifted).max()) ** 2 * lifted.shape[1] >= 1 << 62:
                    lifted = lifted.astype(object)
                deviation = [Decimal(int(t)) for t in (lifted * lifted).sum(axis=1)]
                whitened = (lifted / fitted.n).astype(np.float64) @ weights
                columns = [
                    batch.column("id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, fitted.n), pa.int64()),
                    pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(whitened.reshape(-1)),
                    pa.array(np.tile(fitted.explained, rows)),
                    pa.array(np.full(rows * k, fitted.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """``(key, component, n, deviation decimal(38,0), whitened, explained, identity_error)``, one row per row and component."""
    rows = quantised(vectors, key, vector)
    key_name = dict(rows.dtypes)["id"]
    schema = f"id {key_name}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fitted = fit(rows, components)
    if fitted is None or not len(fitted.values):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", key)
    key_type = rows.select("id").limit(0).toArrow().schema.field("id").type
    return rows.mapInArrow(_apply(fitted, key_type), schema).withColumnRenamed("id", key)
