"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries are put on an integer grid, so that equal vectors, their number and the sums per dimension are exact. Tasks add up
the scatter of centred vectors; what reaches the driver are sums of one number per dimension and of one matrix of
dimension squared, whatever the number of rows. There the scatter is factored as G Gᵀ with pivoting, and the columns
of the triangular G are rotated in pairs until all are orthogonal: their squared norms are the scatter's eigenvalues, the
normalised columns its eigenvectors. Nothing is squared on the way, which keeps small eigenvalues accurate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.tables import written

GROUPS = 16                 # partial matrices that reach the driver
ROWS = 8192                 # vectors handled at a time
LONG = 1 << 63


@dataclass(frozen=True)
class Whitener:
    """n distinct vectors with sums S (exact), components (dimensions x k), their eigenvalues, the trace of V."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def apply(self, grid: np.ndarray) -> np.ndarray:
        """Whitened coordinates of grid vectors (rows)."""
        mean = np.array([s / self.n for s in self.sums])
        return (grid - mean) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, grid: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - S) squared, exact; null beyond the range of long."""
        widest = self.n * int(np.abs(grid.astype(float)).max(initial=0)) + max(map(abs, self.sums), default=0)
        if len(self.sums) * (widest + 1) ** 2 < LONG:
            return pa.array(((self.n * grid - np.array(self.sums, np.int64)) ** 2).sum(axis=1), pa.int64())
        exact = ((self.n * grid.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return pa.array([v if v < LONG else None for v in exact], pa.int64())


def on_grid(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list array: which rows are usable, the length of each row, and floor(scale * entry) of the usable ones, flat.

    Usable: not null, and all entries are finite numbers.
    """
    sizes = pa.compute.fill_null(pa.compute.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pa.compute.list_flatten(vectors).cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)            # null entries are NaN here
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.bincount(row, ~np.isfinite(values), len(sizes)) == 0
    good &= vectors.is_valid().to_numpy(zero_copy_only=False)
    kept = np.floor(scale * values[good[row]])
    return good, sizes, np.clip(kept, -float(LONG), np.nextafter(float(LONG), 0)).astype(np.int64)


def grid_rows(df: DataFrame, vector: str, scale: float) -> DataFrame:
    """dim, grid (little-endian 64-bit integers) of every usable row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                good, sizes, flat = on_grid(batch.column(0).slice(start, ROWS), scale)
                ends = np.concatenate([[0], np.cumsum(sizes[good])])
                data = flat.astype("<i8").tobytes()
                packed = [data[8 * a:8 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(sizes[good].astype(np.int32)), pa.array(packed, pa.binary())],
                                                 ["dim", "grid"])
    return df.select(F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(run, "dim int, grid binary")


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.column("grid").slice(start, ROWS)
            if len(part):
                yield np.frombuffer(b"".join(part.to_pylist()), "<i8").reshape(-1, dim)


def exact_sums(distinct: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension; halves of 32 bits are summed apart, so that nothing overflows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for grid in _matrices(batches, dim):
            count += len(grid)
            high += (grid >> 32).sum(axis=0)
            low += (grid & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, count)), pa.array(high), pa.array(low)],
                                         ["d", "n", "high", "low"])
    parts = distinct.mapInArrow(run, "d bigint, n bigint, high bigint, low bigint")
    total = parts.groupBy("d").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")])
    rows = sorted(total.collect())                          # one row per dimension
    return (int(rows[0]["n"]) if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def summed_products(distinct: DataFrame, dim: int, width: int, view) -> np.ndarray:
    """Sum over all vectors of the outer product of view(grid), a row of `width` numbers per vector, with itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for grid in _matrices(batches, dim):
            rows = view(grid)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], ["part", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = np.zeros((width, width)), None
        for batch in batches:
            for part, m in zip(batch.column("part").to_pylist(), batch.column("m"), strict=True):
                total += np.frombuffer(m.as_py()).reshape(width, width)
                least = part if least is None else least
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "m"])

    schema = "part int, m binary"
    dealt = distinct.mapInArrow(run, schema).repartition(GROUPS, "part").sortWithinPartitions("part").mapInArrow(add, schema)
    rows = sorted(dealt.collect())                          # at most GROUPS rows
    return sum((np.frombuffer(r["m"]).reshape(width, width) for r in rows), np.zeros((width, width)))


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G of full column rank with G Gᵀ = a, for a symmetric a without negative eigenvalues; rows in the order of a."""
    rest, d = a.copy(), len(a)
    floor = np.finfo(float).eps * d * max(float(rest.diagonal().max(initial=0)), 0.0)
    columns = []
    for _ in range(d):
        p = int(rest.diagonal().argmax())
        if rest[p, p] <= floor:
            break
        columns.append(rest[:, p] / np.sqrt(rest[p, p]))
        rest -= np.outer(columns[-1], columns[-1])
        rest[p, :] = rest[:, p] = 0
    return np.stack(columns, axis=1) if columns else np.zeros((d, 0))


def rotated(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """One-sided Jacobi: the columns of g, rotated in pairs until all are orthogonal. A round turns disjoint pairs at once."""
    g, r = g.copy(), g.shape[1]
    order = list(range(r + r % 2))                          # an odd number plays against an empty seat
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(order) - 1):
            half = len(order) // 2
            pairs = [(i, j) for i, j in zip(order[:half], order[:half - 1:-1], strict=True) if i < r and j < r]
            order = [order[0], order[-1], *order[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            a, b = g[:, i], g[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            scale = np.sqrt(aa * bb)
            cosine = np.abs(ab) / np.where(scale > 0, scale, 1)
            worst = max(worst, float(cosine.max()))
            turn = cosine > 1e-16
            zeta = (bb - aa) / (2 * np.where(turn, ab, 1))
            t = np.where(turn, np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0)
            c = 1 / np.sqrt(1 + t * t)
            g[:, i], g[:, j] = c * a - c * t * b, c * t * a + c * b
        if worst < 1e-14:
            break
    return g


def fit(distinct: DataFrame, dim: int, k: int) -> Whitener | None:
    """Learn from the distinct grid vectors (dim, grid); None if there are none."""
    n, sums = exact_sums(distinct, dim) if dim else (0, [])
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    scatter = summed_products(distinct, dim, dim, lambda grid: grid - mean)
    turned = rotated(pivoted_cholesky(scatter))
    norms = np.sqrt((turned * turned).sum(axis=0))
    best = np.argsort(-norms, kind="stable")[:k]
    best = best[norms[best] > 0]
    return Whitener(n, sums, turned[:, best] / norms[best], norms[best] ** 2 / n, float(np.trace(scatter)) / n)


def whiten(df: DataFrame, k: int = 4, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable row of `df` and component 1..k: vec_id, component, n, deviation, whitened, explained, identity_error.

    A row takes part if its vector is not null, holds neither null nor non-finite entries, and has the length that most
    such rows have (ties: the greater length); an empty vector has no dimensions and takes no part. Entries become
    floor(scale * entry), at most the range of long. Means and components come from each distinct grid vector once;
    repeated rows and null ids are whitened like any other. Components with an eigenvalue of zero cannot be whitened and
    give no rows, so equal vectors alone, or an empty table, give none. `deviation` is null where it exceeds a long.
    Other columns are not read.
    """
    grids = grid_rows(df, vector, scale).filter("dim > 0")
    distinct = written(grids.groupBy("dim", "grid").agg(F.count(F.lit(1)).alias("copies")), "fit-list")
    common = distinct.groupBy("dim").agg(F.sum("copies").alias("c")).orderBy(F.desc("c"), F.desc("dim")).head()
    dim = common["dim"] if common else 0
    fitted = distinct.filter(F.col("dim") == dim).select("dim", "grid")
    model = fit(fitted, dim, k)
    kept = len(model.eigenvalues) if model else 0
    error = 0.0
    if kept:
        error = float(np.abs(summed_products(fitted, dim, kept, model.apply) / model.n - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows if kept else 0, ROWS):
                part = batch.slice(start, ROWS)
                good, sizes, flat = on_grid(part.column("v"), scale)
                right = sizes[good] == dim
                grid = flat[np.repeat(right, sizes[good])].reshape(-1, dim)
                rows = len(grid)
                each = np.repeat(np.arange(rows), kept)
                ids = part.column("id").take(pa.array(np.flatnonzero(good)[right])).take(pa.array(each))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows)), pa.array(np.full(rows * kept, model.n)),
                     model.deviations(grid).take(pa.array(each)), pa.array(model.apply(grid).reshape(-1)),
                     pa.array(np.tile(model.eigenvalues / model.trace, rows)), pa.array(np.full(rows * kept, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return df.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(
        run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
