"""Best-two-fit packing of token sequences into rows of a fixed length.

Lengths are small integers, so the plan is made on their histogram (at most one count per length, whatever the corpus):
the longest waiting length opens a sequence, which is filled greedily with the longest that fits; then its smallest
document is swapped for two waiting ones that fit the widened gap more tightly. The pattern found is applied as often as
its lengths allow at once, so the plan has a bounded number of patterns. Pieces find their place by their rank among
the pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.tables import runs, written
from folioworks.llm.token_ids import encoder

RUN = 1 << 20               # bytes of text encoded at once: what a task needs for them is small beside the encoder's cache


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """Cut every encoded document into pieces of at most `size` ids.

    `part` and `local_rank` number the pieces of each length within the task that read them.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for run in runs(batch, "text", RUN):
                ids, n = reader.encode(run.column("text"))
                closed = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                parts = -(-n // size)
                doc = np.repeat(np.arange(len(n)), parts)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = number * size
                length = np.minimum(size, n[doc] - start)
                first = np.repeat(np.cumsum(n) - n, parts) + start
                raw = closed.tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                fresh = np.r_[True, np.diff(ordered) != 0]
                rank = np.empty(len(doc), np.int64)
                rank[order] = (np.arange(len(doc)) - np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))
                               + seen[ordered])
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)),
                     pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, "
                                "local_rank bigint")


def plan(counts: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns of a packing of `counts` (length → how many): ([(length, times), …], number of sequences)."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    while left.any():
        waiting = left.copy()
        pattern: list[int] = []
        gap = size
        while True:
            fits = np.flatnonzero(waiting[:gap + 1])
            if not len(fits):
                break
            longest = int(fits[-1])
            times = min(int(waiting[longest]), gap // longest)
            pattern += [longest] * times
            waiting[longest] -= times
            gap -= times * longest
        if gap and len(pattern) > 1:
            pattern = _swap(pattern, waiting, gap)
        used = np.bincount(pattern, minlength=size + 1)
        kinds = np.flatnonzero(used)
        times = int((left[kinds] // used[kinds]).min())
        left[kinds] -= times * used[kinds]
        patterns.append(([(int(k), int(used[k])) for k in kinds[::-1]], times))
    return patterns


def _swap(pattern: list[int], waiting: np.ndarray, gap: int) -> list[int]:
    """Replace the smallest document by two waiting ones whose sum fills the widened gap best, if that is tighter."""
    smallest = pattern[-1]
    room = gap + smallest
    have = np.flatnonzero(waiting[:room])
    if not len(have):
        return pattern
    at = np.searchsorted(have, room - have, side="right") - 1      # the longest partner for each
    partner = have[np.maximum(at, 0)]
    twice = (partner == have) & (waiting[have] < 2)
    partner = np.where(twice, have[np.maximum(at - 1, 0)], partner)
    valid = (at >= twice) & ((partner != have) | (waiting[have] >= 2))
    total = np.where(valid & (have + partner <= room), have + partner, 0)
    best = int(total.argmax())
    if total[best] <= smallest:
        return pattern
    return sorted([*pattern[:-1], int(have[best]), int(partner[best])], reverse=True)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 2048, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, its end id. Null and repeated ids keep their own pieces. Only documents longer
    than `size` are cut, at multiples of it. An empty table gives no rows; other columns are not read. The driver sees
    the histogram of lengths (at most `size` counts) and nothing else.
    """
    cut = written(pieces(docs, tokenizer_path, end_id, size, doc_id, text), "pieces")
    per_part = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}

    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    sequences = 0
    for kinds, times in plan(counts, size):
        offset = 0
        for length, copies in kinds:
            by_length.setdefault(length, []).append((copies * times, times, sequences, offset))
            offset += copies * length
        sequences += times
    slots = {length: np.array(rows, np.int64) for length, rows in by_length.items()}

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(lengths), 2), np.int64)
        for value in np.unique(lengths):
            rows, own = slots[int(value)], np.flatnonzero(lengths == value)
            ends = np.cumsum(rows[:, 0])
            k = np.searchsorted(ends, ranks[own], side="right")
            slot = ranks[own] - (ends[k] - rows[k, 0])
            out[own, 0] = rows[k, 2] + slot % rows[k, 1]
            out[own, 1] = rows[k, 3] + slot // rows[k, 1] * value
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    ranked = cut.join(carried, ["part", "length"]).withColumn("_at", place("length", F.col("local_rank") + F.col("earlier")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
