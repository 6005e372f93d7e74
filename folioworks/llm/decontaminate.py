"""Benchmark decontamination as a prefix-filtered set join.

Every window of consecutive item words is a record whose elements are its shingles with their places. To contain a
window, a document must contain all its shingles, so one is a sufficient prefix; the rarest in the corpus makes the
fewest candidates. Shingles of the benchmark are counted over all documents, each window is entered under its rarest
one, and document positions join it by equality. The shingle's place in the window fixes where the window would start:
it must lie inside the document (length and positional bounds), and the words there must equal the window's.

The benchmark side is broadcast in blocks of a fixed number of windows; a larger benchmark takes more passes over the
documents, never a larger broadcast. Documents are neither collected nor shuffled: the words stay where they were read
and only verified hits move.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm.tables import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_WINDOWS = 100_000     # windows broadcast at once, some 100 bytes each
EVERY = 0                   # the key under which every document meets the benchmark once


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, then runs of ASCII letters, digits and anything beyond ASCII."""
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lower, BETWEEN), ""), F.array().cast("array<string>"))


def _key(of: Column, at: Column, size: int) -> Column:
    """Hash of the `size` words of array `of` from 0-based place `at`."""
    return F.xxhash64(F.lit(size), *[F.get(of, at + i) for i in range(size)])


def windows(benchmark: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """window_id, window (its words), length and item (its id as a string) of every window of every item."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(
        (F.size("w") > 0) & F.col("item").isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(size)).alias("window"))
    return each.distinct().select(F.sha2(F.concat_ws(" ", "window"), 256).alias("window_id"), "window", F.size("window").alias("length"), "item")


def _shingles(found: DataFrame, size: int) -> DataFrame:
    """window_id, place and key of every shingle of the windows: `size` words, or the one word of a shorter window's."""
    def of(part: DataFrame, n: int) -> DataFrame:
        return (part.select("window_id", "window", F.explode(F.sequence(F.lit(0), F.col("length") - n)).alias("place"))
                .select("window_id", "place", _key(F.col("window"), F.col("place"), n).alias("key")))
    return of(found.filter(F.col("length") >= size), size).unionByName(of(found.filter(F.col("length") < size), 1))


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Every place of every document under the key of the shingle that starts there; one more place, past the end,
    under EVERY."""
    past = F.col("pos") == F.col("n_words")
    keys = [F.when(past, F.lit(EVERY) if i == 0 else None).otherwise(_key(F.col("words"), F.col("pos"), n))
            for i, n in enumerate(sizes)]
    places = docs.select("*", F.posexplode(F.array_append("words", F.lit(None).cast("string"))).alias("pos", "_word")).drop("_word")
    if len(keys) == 1:
        return places.withColumn("key", keys[0])
    return places.withColumn("key", F.explode(F.array(*keys)))


def hits(docs: DataFrame, found: DataFrame, size: int = 10, shingle: int = 3) -> DataFrame:
    """Verified occurrences of the windows `found` (window_id, window, length, distinct) over `docs` (columns words, n_words
    and any others): those others, n_words, start (0-based), length, window_id. Each document also has one row of length 0, so that
    none is missing. Which items a window stands for does not travel with it: it may be any number."""
    places = written(_shingles(found, shingle), "shingles")
    facts = found.agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("least"), F.max("length").alias("most")).first()
    blocks = max(1, math.ceil(facts["n"] / BLOCK_WINDOWS))
    sizes = ([shingle] if (facts["most"] or shingle) >= shingle else []) + ([1] if (facts["least"] or shingle) < shingle else [])

    def block(df: DataFrame, column: str, i: int) -> DataFrame:
        return df.filter(F.pmod(F.xxhash64(column), F.lit(blocks)) == i)

    wanted = places.select("key").distinct()
    seen = _positions(docs.select("words", "n_words"), sizes).select("key")
    counted = [seen.join(F.broadcast(block(wanted, "key", i)), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
               for i in range(blocks)]
    rarity = reduce(DataFrame.unionByName, counted)
    # A shingle that no document has counts 0: its windows occur nowhere.
    rarest = (places.join(rarity, "key", "left")
              .groupBy("window_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "key")).alias("p"))
              .filter("p.n > 0").select("window_id", "p.place", "p.key"))
    entered = written(found.join(rarest, "window_id").select("window_id", "key", "place", "window", "length"), "entries")
    every = docs.sparkSession.range(1).select(
        F.lit("").alias("window_id"), F.lit(EVERY).cast("bigint").alias("key"), F.lit(0).alias("place"),
        F.array().cast("array<string>").alias("window"), F.lit(0).alias("length"))

    def verified(i: int) -> DataFrame:
        side = block(entered, "window_id", i)
        side = side.unionByName(every) if i == 0 else side
        start = F.col("pos") - F.col("place")
        near = _positions(docs, sizes).join(F.broadcast(side), "key").filter(
            (start >= 0) & (start + F.col("length") <= F.col("n_words")))
        same = near.filter(F.slice("words", start + 1, F.col("length")) == F.col("window"))
        return same.select(*[c for c in docs.columns if c != "words"], start.alias("start"), "length", "window_id")

    return reduce(DataFrame.unionByName, [verified(i) for i in range(blocks)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text_key, n_words, n_hit (words inside any occurring window), n_items,
    items_sha256 (of the sorted ids, comma-joined), contaminated, spans (sorted places hit: start, stop; windows
    may overlap).

    An item shorter than `size` words is one window; items without words or id take no part. A null or empty text has no
    words and no hits. Null ids stay; rows that share id and text are counted and come out as often as they went in;
    rows that share an id only are told apart by `text_key`, a hash of the text. Texts are examined whole. Empty tables
    give no rows or no hits; other columns are not read.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), words(F.col(text)).alias("words"))
    of_items = written(windows(benchmark, size), "windows")
    distinct = written(of_items.select("window_id", "window", "length").distinct(), "distinct-windows")
    found = hits(base.withColumn("n_words", F.size("words")), distinct, size)
    spans = F.array_sort(F.collect_set(F.when(F.col("length") > 0, F.struct("start", (F.col("start") + F.col("length")).alias("stop")))))
    grouped = written(found.groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if(F.col("length") == 0).alias("_rows"), spans.alias("_spans"),
        F.collect_set(F.when(F.col("length") > 0, F.col("window_id"))).alias("_windows")), "documents-with-hits")
    # Only documents with hits, and each of their windows once, meet the items.
    own = grouped.select("doc_id", "text_key", F.explode("_windows").alias("window_id")).join(of_items.select("window_id", "item"), "window_id")
    listed = own.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))
    grouped = grouped.join(listed, same, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    covered = F.aggregate("_spans", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("hit")), lambda s, x: F.struct(
        F.greatest(s["upto"], x["stop"]).alias("upto"),
        (s["hit"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["upto"], x["start"]))).alias("hit")), lambda s: s["hit"])
    out = grouped.select("doc_id", "text_key", F.col("n_words").cast("bigint").alias("n_words"),
                         covered.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated"),
                         F.col("_spans").alias("spans"),
                         F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_row"))
    return out.drop("_row")
