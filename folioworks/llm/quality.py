"""Quality by random Fourier features over document statistics.

Each text is reduced to a few statistics (lengths, shares of kinds of characters, repetition, function words). Random
Fourier features turn them into a vector whose inner products approximate a Gaussian kernel; ridge regression on it is
solved from normal equations that every partition sums for its rows; isotonic regression on a separate fold maps the
raw score to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.samples import fold, labelled, one_per_id
from folioworks.llm.tables import runs, written

# Function words of English, German, French and Spanish.
COMMON = frozenset(w.encode() for w in (
    "the of and to in is that for it as was with are on by be this from at or an a not have you "
    "der die das und in zu den von mit ist des sich auf für im dem ein eine nicht es auch als "
    "le la les de des et un une en est que dans pour par sur au du qui pas avec ce il "
    "el los las y que del se por con para una su al lo como más no es").split())
_CLASS = np.zeros(256, np.int64)
for _i, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b",", b".", b"!?", b"|",
                             b"%&$*#@^~<>=+/\\_{}[]", b"\"'()-:;", range(128, 256)), start=1):
    _CLASS[list(_bytes)] = _i
KINDS = 13
STATISTICS = KINDS + 9


@dataclass(frozen=True)
class Settings:
    """train_rows bounds the labelled rows that are fitted; features sizes the model."""

    train_rows: int = 50_000
    features: int = 256
    ridge: float = 1e-3
    threshold: float = 0.3
    solve_tasks: int = 16


def statistics(text: bytes) -> list[float]:
    """Fixed-length description of one whole text."""
    n = len(text)
    if not n:
        return [0.0] * STATISTICS
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), KINDS)
    words = text.lower().split()
    lines = text.split(b"\n")
    w, sentences = max(len(words), 1), max(text.count(b". ") + text.count(b".\n") + 1, 1)
    letters = max(kinds[1] + kinds[2] + kinds[12], 1)
    return [*(kinds / n).tolist(), float(np.log1p(w)), n / w, len(set(words)) / w, float(np.log(w / sentences)),
            sum(map(eq, words, words[1:])) / w, sum(map(COMMON.__contains__, words)) / w, float(kinds[2] / letters),
            len(set(lines)) / len(lines), float(np.log1p(n / len(lines)))]


@dataclass(frozen=True)
class Model:
    """Scaling, random projection, ridge weights and the steps of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(scaled @ self.projection + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([np.ones((len(stats), 1)), scaled, waves])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def _measure(rows: DataFrame, extra: str) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, "text"):
                texts = run.column("text").cast(pa.binary()).to_pylist()
                flat = np.array([statistics(t or b"") for t in texts]).reshape(-1)
                stats = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * STATISTICS), flat)
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), run.column("y"), stats], ["doc_id", "y", "stats"])
    return rows.mapInArrow(measure, f"doc_id bigint, {extra}, stats array<double>")


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit (pool adjacent violators): knots and their values."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    means: list[float] = []
    sizes: list[int] = []
    for value in y.tolist():
        means.append(value)
        sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            total = sizes[-2] + sizes[-1]
            means[-2] = (means[-2] * sizes[-2] + means[-1] * sizes[-1]) / total
            sizes[-2] = total
            means.pop()
            sizes.pop()
    ends = np.cumsum(sizes) - 1
    starts = ends - np.array(sizes) + 1
    knots = np.ravel(np.stack([x[starts], x[ends]], axis=1))
    # Equal knots get a hair's breadth between them so that interpolation stays a function.
    return np.maximum.accumulate(knots + np.arange(len(knots)) * 1e-12), np.repeat(means, 2)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on the labelled sample: statistics in tasks, normal equations summed per partition, calibration on a fold."""
    sample = labelled(docs, labels, "quality", 5, 0, settings.train_rows)
    measured = written(one_per_id(_measure(sample, "y int"), "y", "stats"), "quality-sample")
    moments = measured.select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).orderBy("at").collect()
    mean = np.array([m["mean"] for m in moments] or [0.0] * STATISTICS)
    scale = np.array([m["sd"] for m in moments] or [1.0] * STATISTICS)
    scale[scale < 1e-9] = 1
    random, k = np.random.default_rng(11), STATISTICS
    projection = random.normal(0, 1 / np.sqrt(k), (k, settings.features))
    phase, size = random.uniform(0, 2 * np.pi, settings.features), 1 + k + settings.features
    blank = Model(mean, scale, projection, phase, np.zeros(size), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    solving = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(4)) != 0

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            stats = np.array(batch.column("stats").to_pylist(), float).reshape(-1, k)
            z = blank.features(stats)
            gram += z.T @ z
            target += z.T @ batch.column("y").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([target.tobytes()])], ["gram", "target"])

    # The sample is bounded and so is the number of its partitions, hence of these rows.
    parts = measured.filter(solving).coalesce(settings.solve_tasks).mapInArrow(equations, "gram binary, target binary").collect()
    gram = sum((np.frombuffer(p["gram"]).reshape(size, size) for p in parts), np.zeros((size, size)))
    target = sum((np.frombuffer(p["target"]) for p in parts), np.zeros(size))
    weights = np.linalg.solve(gram + settings.ridge * (1 + np.trace(gram) / size) * np.eye(size), target)
    solved = Model(mean, scale, projection, phase, weights, blank.knots, blank.values)
    check = measured.filter(~solving).select("y", "stats").collect()
    if not check:
        return solved
    raw = solved.raw(np.array([r["stats"] for r in check]))
    knots, values = isotonic(raw, np.array([r["y"] for r in check], float))
    return Model(mean, scale, projection, phase, weights, knots, values)


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out (fold 0 of 5, never learned from), score (0 to 1), predicted.

    A null text counts as empty, whose statistics are all zero. Null ids and repeated rows are scored like any other;
    an empty table gives no rows; without labels every score comes from the uncalibrated model. Other columns are not
    read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, settings))    # size fixed by the settings

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, "text"):
                texts = run.column("text").cast(pa.binary()).to_pylist()
                scores = model.value.score(np.array([statistics(t or b"") for t in texts]))
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = rows.mapInArrow(judge, "doc_id bigint, score double")
    return scored.select("doc_id", (F.coalesce(fold("doc_id", 5), F.lit(-1)) == 0).alias("held_out"), "score",
                         (F.col("score") >= settings.threshold).cast("int").alias("predicted"))
