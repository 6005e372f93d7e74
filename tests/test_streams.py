"""Streams against batch answers; repeated triggers change nothing."""

import json

from pyspark.sql import functions as F

from folioworks.operators import candidates, metrics, lifecycle
from folioworks.sources import logs
from folioworks.streaming import jobs
from tests.test_tables import WRITE, write


def test_log_lines_from_files_and_stream(spark, tmp_path):
    lines = [json.dumps({"ts": f"2024-01-01T00:00:{i:02d}.000001Z", "level": "info", "event": e, "file_id": f"f{i}", "pid": i,
                         "file_ids": ["a", "b"] if e.endswith("sweep") else None, "other": {"x": 1}})
             for i, e in enumerate(["enqueued", "claim_ok", "stale_sweep", "enqueued"])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.log").write_text("\n".join(["worker: Warm shutdown", *lines[:2], "{broken", "[1]", ""]))
    (tmp_path / "in/2.log").write_text("\n".join(lines[2:]))
    rows = logs.read_log(spark, str(tmp_path / "in"))
    assert sorted((r.event, r.file_id, r.ts_us % 60_000_000) for r in rows.collect()) == [
        ("claim_ok", "f1", 1_000_001), ("enqueued", "f0", 1), ("enqueued", "f3", 3_000_001), ("stale_sweep", "f2", 2_000_001)]
    assert rows.filter("event = 'stale_sweep'").first().file_ids == ["a", "b"]
    live = logs.stream_log(spark, str(tmp_path / "in"), files_per_trigger=1)
    counts = jobs.run_counts(metrics.event_counts(live), ["level", "event"], spark)
    assert {r.event: r.lines for r in counts.collect()} == {"enqueued": 2, "claim_ok": 1, "stale_sweep": 1}


def test_candidate_table_survives_replays(spark, tmp_path):
    rows = [write(i, ["e", "g", None][i % 3], 0 if i % 3 != 2 else None, size=i) for i in range(12)] + [write(20, "e", 7, size=99)]
    df = spark.createDataFrame(rows, WRITE)
    always = [(f, [(0, 0, None, None, "t", 1)]) for f in {r.source_file_id for r in df.collect()}]
    claims = spark.createDataFrame(always, f"file_id string, wins array<{lifecycle.WIN}>")
    stamped = df.withColumn("token", F.when(F.col("seq") == 20, "late").otherwise("t")).withColumn("ts_us", F.col("seq") + 1)
    df = df.filter("seq <> 20")                                # its token has no claim
    for part in range(3):
        stamped.filter(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = str(tmp_path / "table")
    seen = []
    for per_trigger in (1, 1, 3):
        stream = spark.readStream.schema(stamped.schema).option("maxFilesPerTrigger", per_trigger).parquet(str(tmp_path / "in"))
        jobs.run_candidates(stream, claims, spark, table if per_trigger == 1 else None)
        seen.append(sorted(map(str, jobs.read_candidates(spark, table).select(*df.columns).collect())))
    assert seen[0] == seen[1] == seen[2] == sorted(map(str, candidates.upsert(df).select(*df.columns).collect()))


def test_intake_drops_repeated_deliveries(spark, tmp_path):
    df = spark.createDataFrame([("f", "confirm", "2024-01-01 00:00:00"), ("f", "confirm", "2024-01-01 00:00:09"),
                                ("g", "confirm", "2024-01-01 00:00:05"), ("h", "claim", "2024-01-01 00:00:05")],
                               "file_id string, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert sorted(r.file_id for r in jobs.read_back(jobs.intake(stream), spark).collect()) == ["f", "g"]


def test_sessions(spark):
    beats = spark.createDataFrame([("f", s) for s in (0, 5, 9, 30, 34)] + [("g", 3)], "file_id string, s int").withColumn(
        "ts", F.timestamp_seconds("s"))
    got = {(r.file_id, r.start_us // 10 ** 6, r.end_us // 10 ** 6, r.beats) for r in metrics.heartbeat_sessions(beats, 10).collect()}
    assert got == {("f", 0, 19, 3), ("f", 30, 44, 2), ("g", 3, 13, 1)}
