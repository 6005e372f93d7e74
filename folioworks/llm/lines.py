"""Boilerplate lines by their frequency within a site.

For every host the pages that contain a line are counted; a line on more than a given share of the host's pages is
boilerplate and goes from every page of that host. Two passes over the table: the first counts hashed lines (each page
ships a distinct line once, and map tasks add up before the shuffle) and writes the hosts' short lists; the second
filters each page against its host's list. A list is bounded: with L lines a page on average, at most L / ratio lines
can exceed the ratio. The lists' size is known when the second pass is planned, so that they go to the pages, which stay
where they were read, as long as the optimizer's limit for broadcasts allows; beyond it both sides are shuffled by host
and adaptive execution splits a host with many pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm.tables import written


@dataclass(frozen=True)
class Seldom:
    """Lower bars for lines that are a small part of their page.

    A line of `long_words` words or more (between spaces) goes where more than `long_ratio` of the host's pages contain
    it, a shorter one at more than `ratio`, and at `least_pages` at least. A page of which such lines make up more than
    `share` of the characters keeps them: it is a copy of another page, and removing what the copies have in common
    would leave none of them.
    """

    ratio: float
    long_ratio: float
    long_words: int
    least_pages: int
    share: float = 0.5


def text_lines(text: Column) -> Column:
    """Lines of plain text, unchanged."""
    return F.split(text, "\n", -1)


def html_lines(html: Column) -> Column:
    """Visible text of a page, one line per run between tags; scripts, styles and comments go."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "\n")
    return F.filter(F.transform(F.split(F.regexp_replace(bare, "<[^>]*>", "\n"), "\n", -1), lambda x: F.trim(x)),
                    lambda x: x != "")


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL, without port; '' where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def line_key(line: Column) -> Column:
    """Identity of a line without its outer spaces; null for an empty one. 64 bits: a stray match with one of a host's
    few boilerplate lines has a chance below 1e-7 even over ten billion lines."""
    return F.when(F.trim(line) != "", F.xxhash64(F.trim(line)))


def boilerplate(pages: DataFrame, host: str, lines: str, ratio: float, least_pages: int,
                seldom: Seldom | None = None) -> DataFrame:
    """One row per host with boilerplate: the host, the keys of its lines (_drop), and of those that only `seldom` finds."""
    def each(line: Column) -> Column:
        long = F.size(F.split(F.trim(line), " +")) >= seldom.long_words if seldom else F.lit(False)
        return F.struct(line_key(line).alias("key"), long.alias("long"))
    keys = F.array_distinct(F.transform(lines, each if seldom else line_key))
    found = pages.select(F.col(host).alias("_host"), F.explode(keys).alias("_key"))
    by = ["_host", "_key"]
    if seldom:
        found, by = found.select("_host", F.col("_key.key").alias("_key"), F.col("_key.long").alias("_long")), [*by, "_long"]
    least = min(least_pages, seldom.least_pages) if seldom else least_pages
    counts = found.filter("_key is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    totals = pages.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("_pages"))
    both = counts.join(totals, "_host")
    often = (F.col("_n") > F.col("_pages") * ratio) & (F.col("_n") >= least_pages)
    if not seldom:
        return both.filter(often).groupBy("_host").agg(F.collect_set("_key").alias("_drop"))
    bar = F.when(F.col("_long"), seldom.long_ratio).otherwise(seldom.ratio)
    rest = ~often & (F.col("_n") > F.col("_pages") * bar) & (F.col("_n") >= seldom.least_pages)
    return both.filter(often | rest).groupBy("_host").agg(F.collect_set(F.when(often, F.col("_key"))).alias("_drop"),
                                                          F.collect_set(F.when(rest, F.col("_key"))).alias("_seldom"))


def drop_boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float = 0.1,
                     least_pages: int = 3, seldom: Seldom | None = None) -> DataFrame:
    """All columns of `pages`, plus `host`, `n_lines`, `n_dropped` and `kept` (the remaining lines as one text).

    A line counts once per page, compared without outer spaces; empty lines are neither counted nor dropped. It goes
    where more than `ratio` of the host's pages, and at least `least_pages`, contain it, and by `seldom`. A null host is the site ''. A
    null text has no lines and stays null; a page whose lines all go keeps an empty text. Repeated rows count as pages
    of their own. Input columns of the names added here are replaced. An empty table gives no rows.
    """
    added = ("host", "n_lines", "n_dropped", "kept")
    # A hint keeps the two uses of the split apart from the scan's columns; underscored names don't clash with the input's.
    ready = pages.withColumns({"_site": F.coalesce(host, F.lit("")), "_lines": lines})
    drops = written(boilerplate(ready, "_site", "_lines", ratio, least_pages, seldom), "boilerplate")
    marked = ready.join(drops, ready["_site"] == drops["_host"], "left")

    def without(keys: Column) -> Column:
        return F.filter("_lines", lambda x: ~F.coalesce(F.array_contains(keys, line_key(x)), F.lit(False)))

    def chars(of: Column) -> Column:
        return F.aggregate(of, F.lit(0), lambda n, x: n + F.char_length(F.trim(x)))

    often = without(F.col("_drop"))
    if seldom:
        rest = chars(without(F.col("_seldom")))
        copy = (chars(F.col("_lines")) - rest) > chars(F.col("_lines")) * seldom.share
        often = F.when(F.size("_seldom") == 0, often).when(copy, often).otherwise(without(F.concat("_drop", "_seldom")))
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(often)
    out = marked.withColumn("_kept", kept)
    return out.select(*[F.col(f"`{c}`") for c in pages.columns if c not in added],
                      F.col("_site").alias("host"), F.coalesce(F.size("_lines"), F.lit(0)).cast("bigint").alias("n_lines"),
                      F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("bigint").alias("n_dropped"),
                      F.array_join("_kept", "\n").alias("kept"))
