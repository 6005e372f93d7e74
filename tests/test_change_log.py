"""Streamed states as a log of changes: several triggers, merges, repeated triggers, hot files, alerts told while the stream runs."""

import os

from pyspark.sql import functions as F

from folioworks.operators import lifecycle as L
from folioworks.operators import sweeps
from folioworks.streaming import jobs
from folioworks.streaming.changes import ChangeLog
from tests.test_lifecycle import AGES, SCHEMA, as_dict, by_loop, histories


def streamed(spark, tmp_path, parts, **options):
    """Run the rows of each part as one trigger."""
    schema = spark.createDataFrame([], SCHEMA).schema
    for k, rows in enumerate(parts):
        folder = tmp_path / "in"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):                                     # in the order of the parts, whatever the clock's grain
            path = folder / name
            if name.endswith(".parquet") and os.path.getmtime(path) > 2_000:
                os.utime(path, (1_000 + k, 1_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return jobs.run_lifecycle(stream, spark, AGES, str(tmp_path / "table"), **options)


def cut(rows, parts):
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    return [order[k * len(order) // parts:(k + 1) * len(order) // parts] for k in range(parts)]


def test_every_trigger_writes_what_it_changed(spark, tmp_path):
    rows = histories(3, files=40, longest=12)
    parts = cut(rows, 6)
    table = streamed(spark, tmp_path, parts, rebase=100)
    assert as_dict(jobs.read_states(spark, table)) == by_loop(rows)[0]
    changed = spark.read.parquet(f"{table}/changes").groupBy("trigger").agg(F.collect_set("file_id").alias("f")).collect()
    assert {r.trigger: set(r.f) for r in changed} == {k: {r[0] for r in part} for k, part in enumerate(parts)}


def test_merges_bound_the_folders_and_change_nothing(spark, tmp_path):
    rows = histories(5, files=20, longest=20)
    table = streamed(spark, tmp_path, cut(rows, 9), rebase=2)
    assert as_dict(jobs.read_states(spark, table)) == by_loop(rows)[0]
    for part in ("", "/alerts", "/marks"):
        assert [n for n in sorted(os.listdir(f"{table}{part}/base")) if "=" in n] == ["trigger=5", "trigger=7"]
        assert [n for n in sorted(os.listdir(f"{table}{part}/changes")) if "=" in n] == ["trigger=6", "trigger=7", "trigger=8"]


def test_a_hot_file_is_not_gathered(spark, tmp_path, monkeypatch):
    rows = histories(7, files=4, longest=60)
    longest = []
    folded = L.advance

    def noted(events, *rest):
        longest.append(events.groupBy("file_id").count().agg(F.max("count")).first()[0] or 0)
        return folded(events, *rest)
    monkeypatch.setattr(L, "advance", noted)
    table = streamed(spark, tmp_path, cut(rows, 3), hot_rows=8, rebase=2)
    assert as_dict(jobs.read_states(spark, table)) == by_loop(rows)[0] and max(longest) <= 8
    assert jobs.read_states(spark, table).agg(F.sum("events")).first()[0] == len(rows)


def test_readers_see_whole_folders_only(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"), "k int, v int")
    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "k int, v int")
    def seen(before=None):
        return sorted((r.k, r.v, r.trigger) for r in log.read(before).collect())
    assert seen() == []
    log.append(rows((1, 1), (2, 1)), 0)
    log.append(rows((1, 2)), 1)
    log.rebase(rows((1, 2), (2, 1)), 1)
    log.append(rows((3, 1)), 2)
    assert seen() == [(1, 2, 1), (2, 1, 1), (3, 1, 2)] and seen(2) == [(1, 2, 1), (2, 1, 1)]
    os.remove(tmp_path / "log/base/trigger=1/_SUCCESS")                     # a merge that did not get to its end
    assert seen() == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (3, 1, 2)]
    os.remove(tmp_path / "log/changes/trigger=2/_SUCCESS")                  # a trigger that did not
    assert seen() == [(1, 1, 0), (1, 2, 1), (2, 1, 0)]
    log.append(rows((3, 1)), 2)
    log.append(rows((3, 1)), 2)                                             # repeated
    assert seen() == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (3, 1, 2)]


def event(file, second, seq, kind, token="w0", status=None):
    return (file, second * 1_000_000, seq, kind, token if kind not in ("confirm",) else None, status, None, None, None, None)


def test_alerts_come_while_the_stream_runs(spark, tmp_path):
    """a: silent for good. b: silent, then a late heartbeat. c: silent, then taken over and silent again. d: ends in time."""
    width = len(spark.createDataFrame([], SCHEMA).columns)
    start = [event(f, 0, k, "confirm") for k, f in enumerate("abcd")] + [event(f, 1, 10 + k, "claim") for k, f in enumerate("abcd")]
    parts = [start, [event("d", 20, 20, "heartbeat"), event("d", 30, 21, "finish", status="processed"), event("x", 40, 22, "confirm")],
             [event("b", 45, 30, "heartbeat"), event("c", 50, 31, "claim", "w1"), event("x", 60, 32, "claim")],
             [event("x", 200, 40, "heartbeat")]]
    parts = [[r[:width] for r in part] for part in parts]
    table = streamed(spark, tmp_path, parts, delay_us=0, rebase=3)
    told = sorted((r.file_id, r.heartbeat_us // 10 ** 6, r.attempt_count, r.mark_us // 10 ** 6) for r in jobs.read_alerts(spark, table).collect())
    assert told == [("a", 1, 1, 40), ("b", 1, 1, 40), ("b", 45, 1, 200), ("c", 1, 1, 40), ("c", 50, 2, 200)]
    states = jobs.read_states(spark, table)
    mark = max(r[1] for part in parts for r in part)
    swept = {r.file_id for r in sweeps.stale_sweep(states, mark, AGES).collect()}
    assert {r.file_id for r in jobs.stale_alerts(spark, table).collect()} == swept == {"a", "b", "c"}
