"""Whitening of embeddings by their leading principal components, with a matrix-free block Lanczos method.

Each entry becomes the integer floor(256 * entry). The distinct vectors (the fit list) are written once. Their sums
give exact deviations n * x - S. The covariance V is never formed: a pass over the fit list sums XᵀXv of the centred
rows for a block of directions, in each task, then by Spark over the tasks; the driver holds blocks of as many rows as
a vector has entries. Each new block is orthogonalised against the whole basis, twice; where a block loses rank
(breakdown), random directions orthogonal to the basis take the place of what is lost; a full basis restarts from its
leading Ritz vectors. The passes end when the residuals of the wanted pairs are at rounding, or the basis spans the
whole space. The trace comes from the deviations, and gives each component's explained share. One more pass takes the
covariance of the whitened rows and holds it against the identity.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped, and, where vectors
differ in length, all but those of the most frequent length (the longer of equals); repeated rows and vectors count
once in the fit and each give their own rows; null ids pass; components of no variance (beyond rounding) are left out,
so that a list of equal vectors, or an empty table, gives no rows; entries beyond the range of a long take its ends; a
deviation beyond that range is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
_SAFE = 2.0**62


def integers(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The key and x, an array of long, of the rows that are kept."""
    v = F.col(vector)
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.filter(v.isNotNull() & (F.size(v) > 0) & fine).select(key, F.transform(v, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("x"))
    # one row for each length
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).take(2)
    return rows if len(lengths) < 2 else rows.filter(F.size("x") == lengths[0]["d"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Center:
    """n and S of a list of integer vectors, exact."""

    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray | None:
        """n * x - S in 64 bits, or nothing if that might overflow."""
        most = self.n * max(float(np.abs(x.astype(np.float64)).max(initial=0)), 1.0) + max(abs(float(s)) for s in self.sums)
        return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64) if most < _SAFE else None

    def centred(self, x: np.ndarray) -> np.ndarray:
        exact = self.deviations(x)
        return exact / self.n if exact is not None else x.astype(np.float64) - np.array([s / self.n for s in self.sums])

    def squares(self, x: np.ndarray) -> list[int | None]:
        """The sum of squared deviations of each row; none where it exceeds a long."""
        exact = self.deviations(x)
        if exact is not None and float(np.abs(exact).max(initial=0)) ** 2 * max(1, x.shape[1]) < _SAFE:
            return (exact * exact).sum(axis=1).tolist()
        rows = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in rows]


def center_of(fit: DataFrame) -> Center | None:
    """Sums by task, then by Spark; one row for each dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                part = [int(a) * 2**32 + int(b) for a, b in zip(high, low, strict=True)]
                n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        if sums is not None:
            values = [Decimal(v) for v in [n, *sums]]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["k", "v"])

    rows = dict(fit.select("x").mapInArrow(run, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v")).collect())
    return Center(int(rows[-1]), [int(rows[k]) for k in range(len(rows) - 1)]) if rows else None


def _summed(fit: DataFrame, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of a matrix over all slices of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

    out = np.zeros(shape[0] * shape[1])
    for k, v in fit.select("x").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out.reshape(shape)


def covariance_times(fit: DataFrame, center: Center, block: np.ndarray) -> np.ndarray:
    """V times a block of directions, in one pass."""

    def part(x: np.ndarray) -> np.ndarray:
        c = center.centred(x)
        return c.T @ (c @ block)

    return _summed(fit, block.shape, part) / center.n


def trace_of(fit: DataFrame, center: Center) -> float:
    return float(_summed(fit, (1, 1), lambda x: np.square(center.centred(x)).sum().reshape(1, 1))[0, 0]) / center.n


def _orthonormal(block: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """An orthonormal block of as many columns as fit, orthogonal to the basis; lost directions are replaced by random ones."""
    d = block.shape[0]
    columns: list[np.ndarray] = []
    for v in block.T[: d - basis.shape[1]]:
        for _ in range(20):
            whole = np.column_stack([basis, *columns]) if columns else basis
            before = np.linalg.norm(v)
            w = v - whole @ (whole.T @ v)
            w = w - whole @ (whole.T @ w)
            if before > 0 and np.linalg.norm(w) > 1e-10 * before:
                w /= np.linalg.norm(w)
                columns.append(w - whole @ (whole.T @ w))
                break
            v = random.standard_normal(d)
    return np.column_stack([c / np.linalg.norm(c) for c in columns]) if columns else np.empty((d, 0))


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, *, block: int = 8, basis_size: int = 256, tolerance: float = 1e-13, passes: int = 500, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    ``product`` gives the matrix times a block. ``tolerance`` is that of the residuals, against the largest eigenvalue.
    """
    random = np.random.default_rng(seed)
    k, basis_size = min(k, d), max(basis_size, 4 * block, 4 * k)
    basis = images = np.empty((d, 0))
    new = _orthonormal(random.standard_normal((d, max(block, k))), basis, random)
    for _ in range(passes):
        image = product(new)
        basis, images = np.column_stack([basis, new]), np.column_stack([images, image])
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        residual = np.linalg.norm(images @ inner[:, :k] - basis @ inner[:, :k] * values[:k], axis=0)
        if basis.shape[1] >= d or residual.max(initial=0) <= tolerance * max(values[0], 0):
            return values[:k], basis @ inner[:, :k]
        new = _orthonormal(image, basis, random)
        if basis.shape[1] + block > basis_size and d > basis_size:
            # restart: the leading Ritz vectors and their images stay, and what the last image adds goes on
            keep = basis_size // 2
            basis, images = basis @ inner[:, :keep], images @ inner[:, :keep]
    raise RuntimeError(f"residuals are {residual.tolist()} after {passes} passes")


def whiten(vectors: DataFrame, *, components: int = 4, vector: str = "embedding", key: str = "vec_id", block: int = 8) -> DataFrame:
    """The key, component, n, deviation, whitened, explained and identity_error for each row and component."""
    rows = integers(vectors, vector, key)
    fit = materialize(rows.select("x").distinct(), "fit")
    kind = dict(vectors.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    center = center_of(fit)
    if center is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = len(center.sums)
    values, axes = leading(lambda v: covariance_times(fit, center, v), d, components, block=block)
    good = values > max(values[0], 0) * d * np.finfo(float).eps * 16
    values, axes = values[good], axes[:, good]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    scaled, explained = axes / np.sqrt(values), values / trace_of(fit, center)
    k, n = len(values), center.n

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.column_stack([center.centred(x) @ scaled, np.ones(len(x))])
        return w.T @ w

    total = _summed(fit, (k + 1, k + 1), moments) / n
    mean = total[:k, k]
    identity_error = float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            row = np.repeat(np.arange(len(x)), k)
            tile = lambda values: np.tile(values, len(x))
            deviation = pa.array(center.squares(x), pa.int64()).take(pa.array(row))
            whitened = (center.centred(x) @ scaled).ravel()
            cols = [batch.column(0).take(pa.array(row)), pa.array(tile(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(row), n)), deviation, pa.array(whitened), pa.array(tile(explained)), pa.array(np.full(len(row), identity_error))]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
