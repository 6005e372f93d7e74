"""Sliced scans equal plain windows, whatever counts as hot."""

import random

import pytest
from pyspark.sql import functions as F

from folioworks.operators.metrics import nearest_rank, peak_concurrency, select_ranks, spread
from folioworks.operators.ranking import ordered_scan


def brute(rows):
    groups = {}
    for key, order, value, mark in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        groups.setdefault(key, []).append((order, value, mark))
    out = []
    for key, items in groups.items():
        total, last = 0, None
        for n, (order, value, mark) in enumerate(items, 1):
            total += value
            out.append((key, order, n, total, last, len(items)))
            last = mark if mark is not None else last
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def test_ordered_scan(spark):
    rng = random.Random(40)
    keys = ["hot"] * 300 + ["warm"] * 60 + [f"k{i}" for i in range(40)] + [None] * 50
    rows = [(k, i, rng.randint(-5, 5), rng.choice([None, None, i])) for i, k in enumerate(rng.sample(keys, len(keys)))]
    df = spark.createDataFrame(rows, "k string, o int, v int, m int").repartition(5)
    got = ordered_scan(df, ["k"], ["o"], {"n": ("number", None), "s": ("sum", F.col("v")), "b": ("before", F.col("m")),
                                          "z": ("size", None)})
    assert sorted([(r.k, r.o, r.n, r.s, r.b, r.z) for r in got.collect()], key=lambda r: (str(r[0]), r[1])) == brute(rows)


def test_scan_without_keys(spark):
    df = spark.range(500).withColumn("v", F.lit(1))
    got = ordered_scan(df, [], ["id"], {"n": ("number", None), "s": ("sum", F.col("v"))})
    assert sorted((r.id, r.n, r.s) for r in got.collect()) == [(i, i + 1, i + 1) for i in range(500)]


def test_percentile_and_spread(spark):
    import statistics
    rng = random.Random(3)
    data = {g: [rng.randint(0, 1000) for _ in range(n)] for g, n in {"a": 1, "b": 2, "c": 20, "d": 137}.items()}
    rows = [(g, v, i) for g, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    for p in (50, 95, 99):
        got = {r.g: r.percentile for r in nearest_rank(df, ["g"], "v", p).collect()}
        assert got == {g: sorted(vs)[max(0, int(round(p / 100 * len(vs) + 0.5)) - 1)] for g, vs in data.items()
                       if int(round(p / 100 * len(vs) + 0.5)) <= len(vs)}
    got = {r.g: (r.median, r.lowest, r.highest) for r in spread(df, ["g"], "v").collect()}
    assert got == {g: (statistics.median(vs), min(vs), max(vs)) for g, vs in data.items()}


def test_peak_concurrency(spark):
    rng = random.Random(5)
    spans = [(g, f"{g}{i}", a := rng.randint(0, 200), rng.choice([None, a + rng.randint(1, 40)]))
             for g, n in (("x", 80), ("y", 5)) for i in range(n)]
    df = spark.createDataFrame(spans, "g string, id string, from_us bigint, to_us bigint")
    got = {r.g: r.peak for r in peak_concurrency(df, ["g"]).collect()}
    want = {}
    for g in ("x", "y"):
        mine = [(a, b) for k, _, a, b in spans if k == g]
        want[g] = max(sum(a <= t and (b is None or t < b) for a, b in mine) for t in range(260))
    assert got == want


def test_selection_of_wide_values_and_null_groups(spark):
    """Values over the whole range of a long, ties, null groups and values, no keys at all; small ranges force many levels."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", None]), rng.choice([-2 ** 60, 2 ** 60, 7, 7, 7, rng.randint(-10 ** 12, 10 ** 12), None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v bigint").repartition(4)
    for g, r in ((g, nearest_rank(df, ["g"], "v", 37)) for g in ("a", None)):
        own = sorted(v for k, v in rows if k == g and v is not None)
        got = {row.g: (row.n, row.percentile) for row in r.collect()}
        assert got[g] == (len(own), own[round(0.37 * len(own) + 0.5) - 1])
    every = sorted(v for _, v in rows if v is not None)
    assert nearest_rank(df, [], "v", 50).first().percentile == every[round(0.5 * len(every) + 0.5) - 1]
    wanted = df.filter("v is not null").groupBy(F.struct(F.lit(0).alias("x")).alias("k")).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi")).withColumns({"w": F.lit(0), "rank": F.lit(1000)})
    found = select_ranks(df.withColumn("k", F.struct(F.lit(0).alias("x"))), "v", wanted, buckets=3)
    assert found.first().found == every[999]
    assert nearest_rank(df.limit(0), ["g"], "v", 50).count() == 0 == spread(df.limit(0), ["g"], "v").count()


def test_selection_sorts_nothing(spark, monkeypatch):
    plans = []
    from folioworks.operators import metrics
    kept = metrics.durable
    monkeypatch.setattr(metrics, "durable", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 10007).alias("v"))
    nearest_rank(df, ["g"], "v", 95).collect()
    assert plans and not any("rangepartitioning" in p for p in plans)


def test_peak_with_ties_at_bucket_edges(spark):
    rng = random.Random(6)
    spans = [("x", a := rng.randint(0, 40) * 10, a + rng.choice([10, 20, 30])) for _ in range(600)] + [("y", 5, None), ("z", 3, 3), ("z", 3, 9)]
    df = spark.createDataFrame(spans, "g string, from_us bigint, to_us bigint")
    for per_bucket in (1, 7, 1000):
        got = {r.g: r.peak for r in peak_concurrency(df, ["g"], per_bucket).collect()}
        want = {}
        for g in "xyz":
            marks = sorted(m for k, a, b in spans if k == g for m in ((a, 1), (b, -1)) if m[0] is not None)
            level = best = None
            for _, d in marks:
                level = (level or 0) + d
                best = level if best is None else max(best, level)
            want[g] = best
        assert got == want
