"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into 1, 4, 16 and 32 segments; a segment is known by its mean and deviation. With m components in a segment,
the inner product of two segments is at most m (mean·mean + deviation·deviation), the counterpart of the lower bound on
their distance. A task holds one block of queries and reads one slice of the candidates, block by block; it keeps each
query's k best so far, and the last of them is the query's threshold. Bounds are taken coarse to fine; only pairs whose bound
reaches the threshold at every level are scored exactly. No pair that could be among the k best is lost, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  registers pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.tables import written

SEGMENTS = (1, 4, 16, 32)
CANDIDATES, QUERIES = 1024, 2048        # vectors in a block
SLICES = 16                             # parts of the candidates that a block of queries meets in parallel
SPARSE = 0.05                           # share of pairs left below which they are scored one by one
EXACT = float(1 << 52)
LOWEST = -float(1 << 62)


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Pack rows (vec_id bigint, v array<bigint>) into blocks as the tasks read them: block, rows, dims, ids, values."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                vecs = part.column("v")
                lengths = pa.compute.list_value_length(vecs).to_numpy()
                dims = int(lengths.max(initial=0))
                values = np.zeros((part.num_rows, dims), np.int64)
                values[np.arange(dims) < lengths[:, None]] = vecs.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([base + number]), pa.array([dims]), pa.array([part.column("vec_id").to_numpy().tobytes()]),
                     pa.array([_small(values).tobytes()]), pa.array([_small(values).itemsize])],
                    ["block", "dims", "ids", "values", "width"])
                number += 1
    return vectors.mapInArrow(pack, "block bigint, dims bigint, ids binary, values binary, width bigint")


def _small(values: np.ndarray) -> np.ndarray:
    most = int(np.abs(values).max(initial=0))
    return values.astype(next(t for t in ("i1", "i2", "i4", "i8") if most <= np.iinfo(t).max))


def _matrix(values: bytes, width: int, dims: int, rows: int) -> np.ndarray:
    return np.frombuffer(values, f"<i{width}").reshape(rows, dims).astype(np.int64)


def _levels(x: np.ndarray) -> list[np.ndarray]:
    """Per level, means and deviations scaled so that a plain inner product of two rows is the bound."""
    out = []
    for n in SEGMENTS:
        parts = x.reshape(len(x), n, -1)
        root = np.sqrt(parts.shape[2])
        out.append(np.hstack([parts.mean(axis=2) * root, parts.std(axis=2) * root]))
    return out


def survivors(fq: np.ndarray, fx: np.ndarray, tau: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns with pairs left, and which of their pairs are, after the bounds of all levels."""
    rows, cols = np.arange(len(fq)), np.arange(len(fx))
    slack = 1e-9 * np.linalg.norm(fq, axis=1).max(initial=0) * np.linalg.norm(fx, axis=1).max(initial=0) + 1e-6
    for a, b in zip(_levels(fq), _levels(fx), strict=True):
        alive = alive & (a[rows] @ b[cols].T >= tau[rows, None] - slack)
        r, c = alive.any(axis=1), alive.any(axis=0)
        rows, cols, alive = rows[r], cols[c], alive[np.ix_(r, c)]
        if not alive.size:
            break
    return rows, cols, alive


def scored(q: np.ndarray, q_ids: np.ndarray, tau: np.ndarray, x: np.ndarray, x_ids: np.ndarray,
           k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the pairs whose exact score reaches the query's threshold, and the k-th in the block."""
    none = np.zeros(0, np.int64)
    width = -(-max(q.shape[1], x.shape[1], 1) // SEGMENTS[-1]) * SEGMENTS[-1]
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    fq, fx = q.astype(float), x.astype(float)
    rows, cols, alive = survivors(fq, fx, tau, q_ids[:, None] != x_ids[None, :])
    if not alive.size:
        return none, none, none
    if alive.mean() < SPARSE:
        i, j = np.nonzero(alive)
        parts = [(q[rows[i[a:a + 65_536]]] * x[cols[j[a:a + 65_536]]]).sum(axis=1) for a in range(0, len(i), 65_536)]
        s = np.concatenate([none, *parts])
        reached = s >= tau[rows[i]]
        return rows[i[reached]], cols[j[reached]], s[reached]
    reach = float(np.abs(fq).max()) * float(np.abs(fx).max()) * width
    scores = (fq[rows] @ fx[cols].T).astype(np.int64) if reach < EXACT else q[rows] @ x[cols].T
    alive &= scores >= tau[rows, None]
    if alive.shape[1] > k:      # below the k-th score of this block nothing counts
        floor = np.where(alive, scores, np.iinfo(np.int64).min)
        alive &= scores >= np.partition(floor, -k, axis=1)[:, -k][:, None]
    i, j = np.nonzero(alive)
    return rows[i], cols[j], scores[i, j]


class Running:
    """The k best candidates so far of each query of a block."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, k: int) -> None:
        self.q, self.q_ids, self.k = q, q_ids, k
        self.row, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.tau = np.full(len(q), LOWEST)

    def meet(self, x: np.ndarray, x_ids: np.ndarray) -> None:
        """Take a block of candidates into account."""
        i, j, s = scored(self.q, self.q_ids, self.tau, x, x_ids, self.k)
        row, vec, score = np.concatenate([self.row, i]), np.concatenate([self.vec, x_ids[j]]), np.concatenate([self.score, s])
        order = np.lexsort((vec, -score, row))
        row, vec, score = row[order], vec[order], score[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        self.row, self.vec, self.score = row[first], vec[first], score[first]
        full = np.bincount(self.row, minlength=len(self.q)) == self.k
        last = np.searchsorted(self.row, np.flatnonzero(full), side="right") - 1
        self.tau[full] = self.score[last]

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.q_ids[self.row]), pa.array(self.vec), pa.array(self.score)],
                                          ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for every row whose id is divisible by `every`.

    Components become floor(scale * x); the score is their integer inner product, ties go to the smaller id. Vectors or
    ids that are null, and vectors with a null or non-finite component, take no part; missing trailing components count
    as 0. Rows that share the query's id are the query's own; of several such rows the greatest vector asks once, while
    each is a candidate for others. Fewer than k candidates give as many rows; an empty table none.
    """
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(scale))).cast("array<bigint>").alias("v"))
    candidates = written(blocks(rows, CANDIDATES), "candidate-blocks")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    asking = written(blocks(asked, QUERIES), "query-blocks")
    if candidates.isEmpty() or asking.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")

    # Every block of queries goes to all slices; the candidates of a slice follow it there, and no pair of blocks meets twice.
    slices = min(SLICES, candidates.count())
    packed = ["dims", "ids", "values", "width"]
    queries = asking.select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
                            F.lit(-1).cast("bigint").alias("c"), *packed)
    follow = candidates.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")).join(
        queries.select("q", "slice"), "slice").select("q", "slice", F.col("block").alias("c"), *packed)
    dealt = queries.unionByName(follow).repartition("q", "slice").sortWithinPartitions("q", "slice", "c")
    found = dealt.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(k: int):
    """Rows in the order of (q, slice, c), the queries' own first → each query's k best of the slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids = np.frombuffer(row["ids"], "<i8")
                values = _matrix(row["values"], row["width"], row["dims"], len(ids))
                if row["c"] < 0:
                    if running:
                        yield running.found()
                    running = Running(values, ids, k)
                else:
                    running.meet(values, ids)
        if running:
            yield running.found()
    return run
