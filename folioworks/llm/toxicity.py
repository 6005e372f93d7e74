"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: words and their first letters, so that inflected forms share one. Features are
the terms whose document frequency differs most between the classes, and the terms of pairs whose joint frequency does
although neither term's own does. The machine adds a weight per feature and, through low-rank factors, one per pair of
features, so that words harmless alone can count together. It is fitted on a bounded labelled sample and applied to
every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.samples import fold, labelled, one_per_id
from folioworks.llm.tables import runs

WORDS = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 200_000
GROUP = 500             # sets counted at a time
STEMS = (4, 5, 6)       # letters of a word that also count as terms


@dataclass(frozen=True)
class Settings:
    """train_rows bounds the labelled rows that are fitted; everything else sizes the model."""

    train_rows: int = 16_000
    hash_bits: int = 20
    features: int = 2048
    least_docs: int = 5
    common: int = 512       # most common terms, of which all pairs are counted
    paired: int = 64        # terms that may become features for a pair
    factors: int = 4
    steps: int = 300
    rate: float = 0.05
    shrink: float = 2e-5
    threshold: float = 0.3


@dataclass(frozen=True)
class Machine:
    """Feature number by hashed term (-1: none), bias, weights and factors."""

    feature: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    bits: int

    def score(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability for rows given as concatenated feature numbers and row sizes."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        return 1 / (1 + np.exp(-np.clip(self.bias + _margin(row, flat, len(sizes), self.weights, self.factors)[0], -30, 30)))


def _margin(row, col, n, weights, factors):
    """Linear part plus half of (square of sums minus sum of squares), and the sums of factors; one factor at a time."""
    each = [factors[:, f] for f in range(factors.shape[1])]
    sums = np.stack([np.bincount(row, v[col], n) for v in each], axis=1)
    squares = np.stack([np.bincount(row, (v ** 2)[col], n) for v in each], axis=1)
    return np.bincount(row, weights[col], n) + 0.5 * (sums ** 2 - squares).sum(axis=1), sums


class Terms:
    """Distinct hashed terms, or feature numbers, of texts; each distinct word is hashed once per task."""

    def __init__(self, bits: int, feature: np.ndarray | None = None) -> None:
        self.mask, self.feature, self.known = (1 << bits) - 1, feature, {}

    def of(self, texts: list[str | None]) -> list[set[int]]:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        words = [WORDS.findall(t.lower()) if t else [] for t in texts]
        for word in set().union(*words).difference(self.known):
            terms = [word, *(word[:n] + "-" for n in STEMS if len(word) >= n)]
            buckets = [zlib.crc32(t.encode()) & self.mask for t in terms]
            if self.feature is not None:
                buckets = [int(f) for f in self.feature[buckets] if f >= 0]
            self.known[word] = tuple(buckets)
        return [set(chain.from_iterable(map(self.known.__getitem__, w))) for w in words]


def flat_sets(sets: list[set[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated sorted members, and the size of each set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.array([x for s in sets for x in sorted(s)], np.int64), sizes


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Machine:
    """Fit on the labelled sample (at most about `train_rows` rows reach the driver, as sets of hashed terms)."""
    bits = settings.hash_bits

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Terms(bits)
        for batch in batches:
            for run in runs(batch, "text"):
                sets = (np.array(sorted(s), "<u4") for s in reader.of(run.column("text").to_pylist()))
                packed = [zlib.compress(np.diff(s, prepend=np.uint32(0)).tobytes(), 1) for s in sets]   # steps take half the room
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), run.column("y"), pa.array(packed, pa.binary())],
                                                 ["doc_id", "y", "terms"])

    sample = labelled(docs, labels, "toxic", 4, 2, settings.train_rows)
    rows = sorted(one_per_id(sample.mapInArrow(terms, "doc_id bigint, y int, terms binary"), "y", "terms").collect())
    y = np.array([r["y"] for r in rows], float)
    sets = [np.cumsum(np.frombuffer(zlib.decompress(r["terms"]), "<u4"), dtype=np.uint32) for r in rows]
    del rows
    hits, seen = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for start in range(0, len(sets), GROUP):            # all terms at once would take many times the memory of the sets
        for counts, chosen in ((seen, range(start, min(start + GROUP, len(sets)))),
                               (hits, [i for i in range(start, min(start + GROUP, len(sets))) if y[i] > 0])):
            counts += np.bincount(np.concatenate([np.zeros(0, np.uint32), *[sets[i] for i in chosen]]), minlength=1 << bits)
    if not 0 < y.sum() < len(y):                        # one class only: nothing to tell apart
        seen[:] = 0
    weight = np.where(seen >= settings.least_docs, _deviations(hits, seen, y), 0)
    best = np.argsort(-weight, kind="stable")[:settings.features - settings.paired]
    best = best[weight[best] > 3]                       # differences beyond chance
    feature = np.full(1 << bits, -1, np.int32)
    feature[best] = np.arange(len(best))
    best = np.append(best, _of_pairs(sets, y, seen, feature, settings))
    feature[best] = np.arange(len(best))
    found = [f[f >= 0] for f in (feature[s] for s in sets)]
    del sets
    row = np.repeat(np.arange(len(y)), [len(f) for f in found])
    col = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.intp)
    bias, weights, factors = _descend(row, col, y, len(best), settings)
    return Machine(feature, bias, weights, factors, bits)


def _deviations(hits: np.ndarray, seen: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how many standard deviations the share of documents with something differs between the classes, given in how many
    documents, and in how many positive ones, it was seen."""
    ones, zeros = max(y.sum(), 1.0), max(len(y) - y.sum(), 1.0)
    return np.abs(hits / ones - (seen - hits) / zeros) / np.sqrt(np.maximum(seen, 1) / max(len(y), 1) * (1 / ones + 1 / zeros))


def _of_pairs(sets: list[np.ndarray], y: np.ndarray, seen: np.ndarray, feature: np.ndarray, s: Settings) -> np.ndarray:
    """Common terms, none a feature yet, whose pairs differ between the classes: all pairs of `common` terms are counted,
    and six deviations are beyond chance among so many."""
    balance = np.where((feature < 0) & (seen >= s.least_docs), np.minimum(seen, len(y) - seen), 0)
    common = np.argsort(-balance, kind="stable")[:s.common]
    common = common[balance[common] > 0]
    place = np.full(len(seen), -1, np.int32)
    place[common] = np.arange(len(common))
    both, hits = np.zeros((2, len(common), len(common)))
    for start in range(0, len(sets), GROUP):
        inside = np.zeros((min(GROUP, len(sets) - start), len(common)), np.float32)
        for i, terms in enumerate(sets[start:start + GROUP]):
            own = place[terms]
            inside[i, own[own >= 0]] = 1
        positive = inside[y[start:start + GROUP] > 0]
        both += inside.T @ inside
        hits += positive.T @ positive
    apart = np.where(both >= s.least_docs, _deviations(hits, both, y), 0)
    np.fill_diagonal(apart, 0)
    strongest = apart.max(axis=1, initial=0)
    best = np.argsort(-strongest, kind="stable")[:s.paired]
    return common[best[strongest[best] > 6]]


def _descend(row, col, y, features, s: Settings):
    """Full-batch Adam on logistic loss. The base rate leans on nine clean documents besides the labelled ones, so that few
    labels, or one class alone, condemn nothing."""
    n = max(len(y), 1)
    base = (y.sum() + 1) / (len(y) + 10) if y.sum() < len(y) else 0.1
    state = [np.array([np.log(base / (1 - base))]), np.zeros(features),
             np.random.default_rng(7).normal(0, 0.02, (features, s.factors))]
    first, second = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    if not len(y) or not features:
        return float(state[0][0]), state[1], state[2]
    for step in range(1, s.steps + 1):
        margin, sums = _margin(row, col, len(y), state[1], state[2])
        error = (1 / (1 + np.exp(-np.clip(state[0][0] + margin, -30, 30))) - y) / n
        e = error[row]
        grads = [np.array([error.sum()]), np.bincount(col, e, features) + s.shrink * state[1],
                 np.stack([np.bincount(col, e * (sums[row, f] - state[2][col, f]), features) for f in range(s.factors)], axis=1)
                 + s.shrink * state[2]]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            state[i] = state[i] - s.rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return float(state[0][0]), state[1], state[2]


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """All columns of `docs` (a string column `text` among them, none named score or predicted), and score (0 to 1) and
    predicted (1 where score >= threshold).

    A null or empty text has no features and gets the base rate. Repeated rows and null ids are scored like any other;
    an empty table gives no rows. Works on whole texts of any length; only the texts go to Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)   # size fixed by the settings, not by the data

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        reader = Terms(model.bits, model.feature)
        for batch in batches:
            scores = [np.zeros(0)]
            for run in runs(pa.RecordBatch.from_arrays([batch], ["text"]), "text"):
                scores.append(model.score(*flat_sets(reader.of(run.column(0).to_pylist()))))
            yield pa.array(np.concatenate(scores))

    return docs.withColumn("score", F.arrow_udf(judge, "double")("text")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit and score: doc_id, held_out (fold 2 of 4, never learned from), score, predicted.

    One row per row of `docs`, as `score` says: null and empty texts get the base rate, repeated rows and null ids are
    scored like any other, an empty table gives no rows. Where no labels, or labels of one class only, are left to learn from,
    every score is 0.1, below the threshold. Of the rows of a labelled id one is learned from. Other columns are not read.
    """
    machine = fit(docs, labels, settings)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = score(rows, machine, settings.threshold)
    return scored.select("doc_id", (F.coalesce(fold("doc_id", 4), F.lit(-1)) == 2).alias("held_out"), "score", "predicted")
