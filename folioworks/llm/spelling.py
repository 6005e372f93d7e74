"""Spelling variants: words within one edit of each other, found by dynamic programming over sorted vocabularies.

Two words that differ by one edit share their beginning or their end up to half of the shorter one's length. So every word
goes to groups of equal beginnings and of equal ends (there spelled backwards), a group too large for a task is divided by a further
half of what is left, and only within groups words are compared. Tasks hold a group's words in sorted order. An edit
matrix has one row per code point of the listed word and three columns around the diagonal; adjacent words share the rows
of their longest common prefix. The scan goes prefix length by prefix length, for all of a task's words as queries at once:
each range of words with the same prefix has one row per query, and a range whose row is above one edit everywhere is skipped
with all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm.tables import written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUP_WORDS = 50_000        # a larger group is divided further
CELLS = 2_000_000           # code points handled at a time
QUERIES = 20_000
PAIRS = "word string, n bigint, near string, near_n bigint"
FAR = np.int8(3)


def occurrences(docs: DataFrame, doc_id: str, text: str, every: int) -> DataFrame:
    """word, n: the lower-cased runs of letters of each document, some with a letter lost, by document and then overall."""
    runs = F.expr(f"regexp_extract_all(`{text}`, '{RUN}', 0)")
    name = F.coalesce(F.col(f"`{doc_id}`").cast("bigint").cast("string"), F.lit(""))
    each = docs.select(name.alias("name"), F.explode(runs).alias("run")).select("name", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.encode(F.concat("name", F.lit(":"), "run"), "UTF-8"))
    size = F.char_length("run")
    at = F.pmod(F.col("h"), size).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    words = each.filter(size >= 7).select("run", h.alias("h")).select(
        F.when(F.col("h") % every == 0, lost).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def half(rest: Column) -> Column:
    """Code points of which one edit must leave either the first or the last alone, where `rest` are left to compare."""
    return F.greatest(F.lit(0), F.ceil((rest - 1) / 2)).cast("int")


def _grouped(members: DataFrame) -> DataFrame:
    return members.withColumns({"head": F.substring("word", F.lit(1), F.col("a")),
                                "tail": F.expr("right(word, b)")})


def _halves(members: DataFrame) -> DataFrame:
    """Every member once under a longer beginning and once under a longer end."""
    h = half(F.col("m") - F.col("a") - F.col("b"))
    longer = F.array(F.struct((F.col("a") + h).alias("a"), F.col("b").alias("b"), F.lit(False).alias("back")),
                     F.struct(F.col("a").alias("a"), (F.col("b") + h).alias("b"), F.lit(True).alias("back")))
    return members.select("word", "n", "m", F.explode(longer).alias("g")).select("word", "n", "m", "g.*")


def groups(vocabulary: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """Members (word, n, m, a, b, head, tail, back) of groups: words of m or m + 1 code points with the same first `a` and
    last `b`. Any two words within one edit, the shorter of m, meet in one at least. A group above `limit` words is divided
    again until one edit's worth of code points is left, so that its size is bounded by the alphabet."""
    key = ["m", "a", "b", "head", "tail", "back"]
    size = F.char_length("word")
    start = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).select(
        "word", "n", "m", F.lit(0).alias("a"), F.lit(0).alias("b"))
    found, ready = _grouped(_halves(start)), None
    while True:
        open_ = F.col("m") - F.col("a") - F.col("b") >= 2
        heavy = written(found.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).filter((F.col("c") > limit) & open_).select(*key), "large-groups")
        if heavy.isEmpty():
            return found if ready is None else ready.unionByName(found)
        done = found.join(heavy, key, "left_anti")
        ready = done if ready is None else ready.unionByName(done)
        found = _grouped(_halves(found.join(heavy, key, "left_semi").select("word", "n", "m", "a", "b")))


class SortedList:
    """Code points of words in sorted order, and for each prefix length the ranges of words that share a prefix."""

    def __init__(self, words: list[str], group: np.ndarray) -> None:
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.points = np.zeros((len(words), int(self.sizes.max(initial=0)) + 2), np.uint32)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        row = np.repeat(np.arange(len(words)), self.sizes)
        self.points[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)] = flat
        self.first = np.concatenate([[True], group[1:] != group[:-1]])[:len(words)]

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, other) of places one edit apart, within the query's group."""
        new = self.first.copy()
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(new))
        own = np.searchsorted(starts, queries, side="right") - 1
        query, low, high = queries, starts[own], ends[own]
        # Row 0 of the matrix around the diagonal: columns -1, 0, 1.
        rows = np.tile(np.array([FAR, 0, 1], np.int8), (len(query), 1))
        left, right = [], []
        for d in range(self.points.shape[1]):
            ended = self.sizes[low] == d                    # the prefix itself is a word, the first of its range
            apart = self.sizes[query] - d
            hit = ended & (np.abs(apart) <= 1)
            hit[hit] = rows[np.flatnonzero(hit), apart[hit] + 1] == 1
            left.append(query[hit])
            right.append(low[hit])
            low = low + ended
            some = low < high
            query, low, high, rows = query[some], low[some], high[some], rows[some]
            if not len(query):
                break
            if d:
                new[1:] |= self.points[1:, d] != self.points[:-1, d]
            else:
                new[1:] |= self.points[1:, 0] != self.points[:-1, 0]
            number, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            ends = np.append(starts[1:], len(new))
            first, count = number[low], number[high - 1] - number[low] + 1
            parent = np.repeat(np.arange(len(query)), count)
            child = first[parent] + np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
            query, above, low, high = query[parent], rows[parent], starts[child], ends[child]
            point = self.points[low, d]
            rows = np.full((len(query), 3), FAR, np.int8)
            for c in range(3):                              # column d + c of the query, one row further down
                at = d + c - 1
                inside = (at >= 0) & (at < self.sizes[query]) if at >= 0 else np.zeros(len(query), bool)
                same = inside & (self.points[query, max(at, 0)] == point)
                best = np.where(inside, above[:, c] + ~same, FAR)
                if c < 2:
                    best = np.minimum(best, above[:, c + 1] + 1)
                if c:
                    best = np.minimum(best, np.where(inside, rows[:, c - 1] + 1, FAR))
                rows[:, c] = np.minimum(best, FAR)
            alive = rows.min(axis=1) <= 1
            query, low, high, rows = query[alive], low[alive], high[alive], rows[alive]
        return np.concatenate(left), np.concatenate(right)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, spelled), (word, n, m, key, spelled) → PAIRS in both directions."""
    held: list[tuple] = []
    cells = 0

    def found() -> Iterator[pa.RecordBatch]:
        words, ns, ms, keys, spelled = zip(*held, strict=True)
        number = np.cumsum([1, *(a != b for a, b in zip(keys[1:], keys[:-1], strict=True))])
        listed = SortedList(list(spelled), number)
        shorter = np.flatnonzero(listed.sizes == np.array(ms))
        word, n = np.array(words, object), np.array(ns, np.int64)
        for start in range(0, len(shorter), QUERIES):
            a, b = listed.near(shorter[start:start + QUERIES])
            longer = listed.sizes[b] > listed.sizes[a]      # words of equal length are queries both
            a, b = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
            yield pa.RecordBatch.from_arrays([pa.array(word[a], pa.string()), pa.array(n[a]), pa.array(word[b], pa.string()),
                                              pa.array(n[b])], ["word", "n", "near", "near_n"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "m", "key", "spelled")), strict=True):
            if held and row[3] != held[-1][3] and cells > CELLS:
                yield from found()
                held, cells = [], 0
            held.append(row)
            cells += len(row[0])
    if held:
        yield from found()


def near_words(vocabulary: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """PAIRS of all words (word, n) exactly one edit apart, in both directions."""
    key = F.concat_ws("|", F.lpad(F.col("m").cast("string"), 12, "0"), "a", "b", "back", "head", "tail")
    members = groups(vocabulary, limit).select(
        "word", "n", "m", key.alias("key"), F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("spelled"))
    several = members.repartition("key").sortWithinPartitions("key", "spelled")
    return several.mapInArrow(_compare, PAIRS).dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root for rows (word, form): forms followed to the last one, in doubling steps. A form is at least ten times as frequent
    as its word, so chains are short and end."""
    links = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")), "roots")
        moved = not links.filter("moved").isEmpty()
        links = links.select("word", "root")
        if not moved:
            return links


def variants(docs: DataFrame, least_chars: int = 7, least_n: int = 2, ratio: int = 10, every: int = 31, doc_id: str = "doc_id",
             text: str = "text", limit: int = GROUP_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z in lower case, of at least `least_chars` code points
    and `least_n` occurrences; where crc32 of "<doc_id>:<run>" is divisible by `every`, the run first loses the code point
    at that hash modulo its length. Words are near if one insertion, deletion or replacement turns one into the other. `form` is the near
    word of largest n (ties: smallest in code-point order) if that is at least `ratio` times the word's, else null; `root`
    is where forms lead. A null id counts as an empty string, null and empty texts have no words, repeated rows count
    again, an empty table gives no rows. Texts are taken whole; other columns are not read.
    """
    counted = occurrences(docs, doc_id, text, every)
    vocabulary = written(counted.filter((F.char_length("word") >= least_chars) & (F.col("n") >= least_n)), "vocabulary")
    pairs = near_words(vocabulary, limit)
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("near"))).alias("best")
    found = written(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "near-words")
    joined = vocabulary.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.rank")).alias("near_n"))
    is_form = F.col("near_n") >= F.col("n") * ratio
    formed = written(joined.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"),
                                   F.when(is_form, F.col("near_n")).alias("form_n")), "word-forms")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
