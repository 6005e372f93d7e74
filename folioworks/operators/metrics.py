"""Analytics over log lines and lifecycle intervals.

Per-file answers are grouped minima chained by equi joins, never a gathered history. Order statistics count values in
ranges that narrow, and peaks combine sums of time buckets: neither puts all rows of a group in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.session import durable

BUCKETS = 1024              # ranges counted at each level of a selection


def _once(rows: DataFrame) -> DataFrame:
    """Rows that several steps read: parsed or joined once, kept narrow."""
    return durable(rows)


def merge_snapshots(*snapshots: DataFrame) -> DataFrame:
    """Union of log snapshots, one line per (ts, event, pid) and file."""
    merged = snapshots[0]
    for other in snapshots[1:]:
        merged = merged.unionByName(other)
    return merged.dropDuplicates(["file_id", "ts_us", "event", "pid"])


def confirm_to_claim(lines: DataFrame) -> DataFrame:
    """Per file: first `enqueued`, first `claim_ok` at or after it, and the delay."""
    lines = _once(lines.filter("event IN ('enqueued', 'claim_ok')").select("event", "file_id", "ts_us"))
    sent = lines.filter("event = 'enqueued'").groupBy("file_id").agg(F.min("ts_us").alias("confirmed_us"))
    claims = lines.filter("event = 'claim_ok'").select("file_id", "ts_us")
    first = claims.join(sent, "file_id").filter("ts_us >= confirmed_us").groupBy("file_id").agg(
        F.min("confirmed_us").alias("confirmed_us"), F.min("ts_us").alias("claimed_us"))
    return first.withColumn("delay_us", F.col("claimed_us") - F.col("confirmed_us"))


def select_ranks(values: DataFrame, value: str, wanted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The value at each wanted rank of its group, found by counting; nothing is sorted.

    `values`: k (the group, a struct) and an integer column. `wanted`: k, w (names the rank within the group), rank (from
    1, in the order of values) and lo, hi (smallest and largest value). Each level counts the values between lo and hi in
    `buckets` ranges of equal width and narrows lo and hi to the range that holds the rank: one pass over the values and
    at most `buckets` rows per rank are shuffled, and a 64-bit range takes seven levels at most.
    """
    bounds = durable(wanted.select("k", "w", "rank", "lo", "hi"))
    within = Window.partitionBy("k", "w").orderBy("bucket")
    while True:
        open_ = bounds.filter("lo < hi")
        if open_.isEmpty():
            return bounds.select("k", "w", F.col("lo").alias("found"))
        ranges = open_.withColumn("step", F.expr(f"(hi - lo) div {buckets} + 1"))
        counted = (values.select("k", F.col(value).alias("v")).join(ranges, "k").filter(F.col("v").between(F.col("lo"), F.col("hi")))
                   .groupBy("k", "w", F.expr("(v - lo) div step").alias("bucket")).agg(F.count(F.lit(1)).alias("c")))
        placed = counted.join(ranges, ["k", "w"]).withColumn("upto", F.sum("c").over(within))
        holds = placed.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        low = F.col("lo") + F.col("bucket") * F.col("step")
        bounds = durable(bounds.filter("lo >= hi").unionByName(holds.select(
            "k", "w", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), low.alias("lo"),
            F.least("hi", low + F.col("step") - 1).alias("hi"))))


def _grouped(values: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(values with their group k, groups with n, lo, hi). The values are computed once."""
    rows = _once(values.select(F.struct(*keys, F.lit(0).alias("_")).alias("k"), value).filter(F.col(value).isNotNull()))
    return rows, rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def nearest_rank(values: DataFrame, keys: list[str], value: str, percent: float) -> DataFrame:
    """Exact nearest-rank percentile per group of an integer column: position round_half_even(p/100·n + 0.5), at least 1."""
    rows, sizes = _grouped(values, keys, value)
    rank = F.bround(F.lit(percent) / 100 * F.col("n") + 0.5, 0).cast("bigint")
    sizes = durable(sizes.withColumns({"w": F.lit(0), "rank": F.least(F.col("n"), F.greatest(F.lit(1), rank))}))
    found = select_ranks(rows, value, sizes)
    return sizes.select("k", "n").join(found, "k").select(*[F.col(f"k.{key}").alias(key) for key in keys], "n", F.col("found").alias("percentile"))


def spread(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median (mean of the two middle values), minimum and maximum per group of an integer column."""
    rows, sizes = _grouped(values, keys, value)
    sizes = durable(sizes)
    middle = F.array(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1"))
    found = select_ranks(rows, value, sizes.select("k", "lo", "hi", F.posexplode(middle).alias("w", "rank")))
    medians = found.groupBy("k").agg(F.avg("found").alias("median"))
    return sizes.join(medians, "k").select(*[F.col(f"k.{key}").alias(key) for key in keys], "median", F.col("lo").alias("lowest"),
                                           F.col("hi").alias("highest"))


def sweep_totals(lines: DataFrame) -> DataFrame:
    """Counts summed over the lines of each sweep, and how many distinct files they name."""
    sweeps = lines.filter(F.col("event").endswith("_sweep"))
    sums = sweeps.groupBy("event").agg(
        F.count(F.lit(1)).alias("sweeps"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("reset", "requeued", "errored", "enqueue_failed")])
    named = sweeps.select("event", F.explode("file_ids").alias("file_id")).distinct().groupBy("event").agg(
        F.count(F.lit(1)).alias("files"))
    return sums.join(named, "event", "left").fillna({"files": 0})


def sweep_coverage(lines: DataFrame) -> DataFrame:
    """Enqueued files that no sweep line ever named."""
    named = lines.filter(F.col("event").endswith("_sweep")).select(F.explode("file_ids").alias("file_id"))
    return lines.filter("event = 'enqueued'").select("file_id").distinct().join(named, "file_id", "left_anti")


def peak_concurrency(intervals: DataFrame, keys: list[str], marks_per_bucket: int = 1000) -> DataFrame:
    """Most intervals open at once per group. `intervals`: keys, from_us, to_us (NULL: still open).

    Ends come before starts at the same instant. Marks are first added up by instant, then each bucket of time is summed up as
    (change, highest level within), which combine from left to right like the marks themselves; so only marks of one
    bucket, and then buckets of one group, are ever put in order.
    """
    edges = F.array(F.struct(F.col("from_us").alias("at"), F.lit(1).alias("delta")),
                    F.struct(F.col("to_us").alias("at"), F.lit(-1).alias("delta")))
    group = F.struct(*keys, F.lit(0).alias("_")).alias("k")
    marks = intervals.select(group, F.explode(edges).alias("m")).filter("m.at IS NOT NULL").groupBy("k", F.col("m.at").alias("at")).agg(
        F.sum("m.delta").alias("change"), F.min("m.delta").alias("first"))
    # Highest level reached within an instant: after its first end, or at its end.
    marks = _once(marks.select("k", "at", "change", F.when(F.col("first") < 0, F.greatest(F.lit(-1), "change")).otherwise(F.col("change")).alias("top")))
    spans = marks.groupBy("k").agg(F.min("at").alias("lo"), F.expr(
        f"(max(at) - min(at)) div greatest(count(1) div {marks_per_bucket}, 1) + 1").alias("step"))
    bucketed = marks.join(spans, "k").withColumn("bucket", F.expr("(at - lo) div step"))

    def summed(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        before = F.coalesce(F.sum("change").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.withColumn("level", before + F.col("top")).groupBy(*by).agg(F.sum("change").alias("change"), F.max("level").alias("top"))

    whole = summed(summed(bucketed, ["k", "bucket"], "at"), ["k"], "bucket")
    return whole.select(*[F.col(f"k.{key}").alias(key) for key in keys], F.col("top").cast("bigint").alias("peak"))


def claim_counts(lines: DataFrame) -> DataFrame:
    """Per file: claims won and lost, and distinct tasks that tried."""
    tries = lines.filter(F.col("event").isin("claim_ok", "claim_lost"))
    return tries.groupBy("file_id").agg(
        F.count_if(F.col("event") == "claim_ok").alias("won"), F.count_if(F.col("event") == "claim_lost").alias("lost"),
        F.countDistinct("task_id").alias("tasks"))


def retry_check(lines: DataFrame) -> DataFrame:
    """Per file: claims, retries, whether retries = claims − 1, and backoffs that differ from 2^attempt · 5."""
    used = lines.filter(F.col("event").isin("claim_ok", "retrying"))
    expected = (F.pow(F.lit(2), F.col("attempt")) * 5).cast("bigint")
    sums = used.groupBy("file_id").agg(
        F.count_if(F.col("event") == "claim_ok").alias("claims"), F.count_if(F.col("event") == "retrying").alias("retries"),
        F.count_if((F.col("event") == "retrying") & (F.col("countdown") != expected)).alias("wrong_backoffs"))
    return sums.withColumn("as_expected", F.col("retries") == F.col("claims") - 1)


def resume_point(lines: DataFrame, attempt: int = 2) -> DataFrame:
    """First entry handled by the given attempt, per file."""
    handled = lines.filter((F.col("attempt") == attempt) & F.col("event").isin("entry_staged", "entry_rejected"))
    return handled.groupBy("file_id").agg(F.min("entry_index").alias("resumed_at"))


def check_resume(points: DataFrame, kills: DataFrame) -> DataFrame:
    """Did each file resume at the entry it was killed at (k), or the one before (k − 1)?"""
    return points.join(kills, "file_id").withColumn(
        "as_expected", F.col("resumed_at").isin(F.col("killed_at_entry"), F.col("killed_at_entry") - 1))


def recovery_timeline(lines: DataFrame) -> DataFrame:
    """Per file: first failure, first sweep naming the file after it, first claim after that.

    Sweep lines name many files, so they are exploded; each step is a grouped minimum behind an equi join.
    """
    lines = _once(lines.filter("event IN ('retrying', 'claim_ok') OR event LIKE '%_sweep'").select(
        "event", "file_id", "file_ids", "ts_us"))
    killed = lines.filter("event = 'retrying'").groupBy("file_id").agg(F.min("ts_us").alias("killed_us"))
    sweeps = lines.filter(F.col("event").endswith("_sweep")).select(F.explode("file_ids").alias("file_id"), "ts_us")
    reset = sweeps.join(killed, "file_id").filter("ts_us > killed_us").groupBy("file_id").agg(
        F.min("killed_us").alias("killed_us"), F.min("ts_us").alias("reset_us"))
    claims = lines.filter("event = 'claim_ok'").select("file_id", "ts_us")
    again = claims.join(reset, "file_id").filter("ts_us >= reset_us").groupBy("file_id").agg(
        F.min("ts_us").alias("claimed_us"))
    return killed.join(reset.drop("killed_us"), "file_id", "left").join(again, "file_id", "left").orderBy("killed_us",
                                                                                                       "file_id")


def heartbeat_sessions(beats: DataFrame, gap_seconds: int) -> DataFrame:
    """Contiguous processing periods per file: heartbeats closer than the gap belong together."""
    return beats.groupBy("file_id", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("beats")).select(
        "file_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "beats")


def sweep_windows(lines: DataFrame, seconds: int = 15) -> DataFrame:
    """Sweep lines per tick: tumbling windows of the sweep interval."""
    sweeps = lines.filter(F.col("event").endswith("_sweep"))
    return sweeps.groupBy("event", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("sweeps")).select("event", F.unix_micros("w.start").alias("start_us"), "sweeps")


def event_counts(lines: DataFrame) -> DataFrame:
    """Lines per level and event."""
    return lines.groupBy("level", "event").agg(F.count(F.lit(1)).alias("lines"))
