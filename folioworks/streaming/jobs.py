"""Structured Streaming jobs: intake, lifecycle states, silence alerts, log counts and the candidate table.

Each function takes a streaming DataFrame and returns one, or writes through foreachBatch with one folder per batch
id, which a replay overwrites: exactly once in effect. Checkpoints live in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioworks import messages as M
from folioworks.operators.candidates import accepted, fold_writes, merge_folds, resolve
from folioworks.plans import ingest
from folioworks.operators.lifecycle import FOLD_ROWS, STATE_FIELDS, advance_any
from folioworks.session import durable, exists, scratch
from folioworks.settings import AGES, ARCHIVE_LIMITS, Ages, ArchiveLimits
from folioworks.streaming.changes import BASE, CHANGES, ChangeLog


def intake(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Confirmed uploads, one per file: duplicate deliveries within the delay are dropped."""
    confirmed = events.filter("kind = 'confirm'").withWatermark("ts", delay)
    return confirmed.dropDuplicatesWithinWatermark(["file_id"]).select("file_id", "ts")


MANIFEST = "path string, modificationTime timestamp, length bigint, content binary"


def stream_manifest(spark: SparkSession, prefix: str, files_per_trigger: int = 1000) -> DataFrame:
    """Objects as they arrive under a prefix; only their names and sizes are read."""
    reader = spark.readStream.format("binaryFile").schema(MANIFEST).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", files_per_trigger).load(prefix).select(
        "path", "length", F.col("modificationTime").alias("modified"))


def run_ingest(objects: DataFrame, out: str, checkpoint: str, limits: ArchiveLimits = ARCHIVE_LIMITS,
               now: bool = True) -> None:
    """Type, guard and explode arriving objects. Each trigger writes its own folder of `files`, `candidates` and `attempts`,
    with ids and keys derived from names, so a repeated trigger leaves the same tables. Entries of archives are read once,
    also by a trigger that is repeated."""
    def write(batch: DataFrame, batch_id: int) -> None:
        done = ingest.process_attempts(ingest.uploads_of(batch), limits, progress=f"{out}/progress/trigger={batch_id}")
        for name, rows in done._asdict().items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/trigger={batch_id}")

    writer = objects.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    (writer.trigger(availableNow=True) if now else writer).start().awaitTermination()


SNAPSHOT = ("file_id string, events bigint, created_us bigint, last_us bigint, last_seq bigint, late bigint, state struct<"
            + ", ".join(f"{name}: {kind}" for name, kind in STATE_FIELDS.items()) + ">")
ALERT = "file_id string, heartbeat_us bigint, attempt_count int, mark_us bigint"
REBASE = 8                  # triggers between two merges


def _newest(rows: DataFrame) -> DataFrame:
    """The last state of each file in a log."""
    columns = [c for c in rows.columns if c not in ("file_id", "trigger")]
    return rows.groupBy("file_id").agg(F.max_by(F.struct(*columns), "trigger").alias("v")).select("file_id", "v.*")


def run_lifecycle(events: DataFrame, spark: SparkSession, ages: Ages = AGES, table: str | None = None,
                  keep_us: int | None = None, now: bool = True, delay_us: int = 60_000_000, rebase: int = REBASE,
                  hot_rows: int = FOLD_ROWS) -> str:
    """Stream lifecycle events into a log of states: every trigger folds its events onto the states of the files they belong to, with
    the batch transition, and writes those states only.

    Every trigger also writes alerts: files whose last heartbeat has become older than the limit at the mark, the newest
    event so far less `delay_us`. A silence is told once; a heartbeat or a takeover after it begins a new one. Files that
    ended more than `keep_us` before the mark's event are put aside as closed at each merge (None: never), so the base stays
    bounded. A repeated trigger starts from what it found the first time and leaves the same tables. A file with more than
    `hot_rows` events in a trigger is not gathered.
    """
    table = table or scratch(spark, "lifecycle")
    log, alerts = ChangeLog(spark, table, SNAPSHOT), ChangeLog(spark, f"{table}/alerts", ALERT)
    marks = ChangeLog(spark, f"{table}/marks", "mark_us bigint")

    def write(batch: DataFrame, trigger: int) -> None:
        batch = durable(batch)
        earlier = _newest(log.read(trigger))
        log.append(advance_any(batch, ages, earlier, hot_rows), trigger)
        newest = batch.agg(F.max("ts_us")).first()[0]
        before = marks.read(trigger).agg(F.max("mark_us")).first()[0]
        mark = max(v for v in (newest, before, -1) if v is not None)
        marks.append(spark.createDataFrame([(mark,)], "mark_us bigint"), trigger)
        states = _newest(log.read(trigger + 1))
        known = alerts.read(trigger).select("file_id", "heartbeat_us")
        silent = states.select("file_id", "state.*").filter(_silent(mark - delay_us, ages))
        alerts.append(silent.join(known, ["file_id", "heartbeat_us"], "left_anti").select(
            "file_id", "heartbeat_us", "attempt_count", F.lit(mark - delay_us).cast("bigint").alias("mark_us")), trigger)
        if trigger % rebase == rebase - 1:
            merged = durable(_newest(log.read(trigger + 1)))
            if keep_us is not None:
                done = F.col("state.status").isin(*M.TERMINAL) & (F.col("last_us") < mark - keep_us)
                merged.filter(done).write.mode("overwrite").parquet(f"{table}/closed/trigger={trigger}")
                merged = merged.filter(~done)
            log.rebase(merged, trigger)
            marks.rebase(spark.createDataFrame([(mark,)], "mark_us bigint"), trigger)
            alerts.rebase(durable(alerts.read(trigger + 1).drop("trigger")), trigger)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", f"{table}/stream-state")
    (writer.trigger(availableNow=True) if now else writer).start().awaitTermination()
    return table


def _silent(mark_us: int, ages: Ages) -> Column:
    return (F.col("status") == "processing") & (F.col("heartbeat_us") < mark_us - ages.stale_seconds * 1_000_000)


def read_states(spark: SparkSession, table: str) -> DataFrame:
    """Every file's state in a streamed table, also those put aside as closed, whose end is final."""
    found = _newest(ChangeLog(spark, table, SNAPSHOT).read())
    if exists(spark, f"{table}/closed"):
        closed = _newest(spark.read.schema(f"{SNAPSHOT}, trigger bigint").parquet(f"{table}/closed"))
        found = closed.unionByName(found.join(closed.select("file_id"), "file_id", "left_anti"))
    return found.select("file_id", "events", "created_us", "last_us", "late", "state.*")


def read_alerts(spark: SparkSession, table: str) -> DataFrame:
    """Every silence told so far: file_id, heartbeat_us, attempt_count, and the mark at which it was."""
    return ChangeLog(spark, f"{table}/alerts", ALERT).read().drop("trigger")


def stale_alerts(spark: SparkSession, table: str) -> DataFrame:
    """Alerts that still hold: no heartbeat, takeover or end has come since."""
    now = read_states(spark, table).filter("status = 'processing'").select("file_id", "heartbeat_us")
    return read_alerts(spark, table).join(now, ["file_id", "heartbeat_us"], "left_semi")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, now: bool = True):
    """Append a stream to a parquet table; `now` works off what is there and stops."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if now else writer).outputMode("append").start()


def read_back(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Work off a stream into a fresh table and read it."""
    path = scratch(spark, "stream-out")
    run_to_table(stream, path, scratch(spark, "stream-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_counts(counts: DataFrame, keys: list[str], spark: SparkSession) -> DataFrame:
    """Work off a running aggregate. Every trigger writes its changed groups; the newest row per key counts."""
    path = scratch(spark, "stream-counts")

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    (counts.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True)
     .option("checkpointLocation", scratch(spark, "stream-state")).start().awaitTermination())
    schema = StructType([*counts.schema.fields, StructField("batch_id", LongType())])
    rows = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    values = [c for c in counts.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


def run_candidates(writes: DataFrame, claims: DataFrame, spark: SparkSession, table: str | None = None,
                   now: bool = True, rebase: int = REBASE) -> str:
    """Stream candidate writes into a log of folded triggers, through the same checks as in batch. A repeated trigger overwrites
    its own folder, and folds merge in any order, so each write counts once; every `rebase` triggers they are merged."""
    table = table or scratch(spark, "candidates")

    def write(batch: DataFrame, trigger: int) -> None:
        folded = fold_writes(accepted(batch, claims))
        log = ChangeLog(spark, table, _ddl(folded))
        log.append(folded, trigger)
        if trigger % rebase == rebase - 1:
            log.rebase(durable(merge_folds(log.read(trigger + 1).drop("trigger"))), trigger)

    writer = writes.writeStream.foreachBatch(write).option("checkpointLocation", f"{table}/stream-state")
    (writer.trigger(availableNow=True) if now else writer).start().awaitTermination()
    return table


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def read_candidates(spark: SparkSession, table: str) -> DataFrame:
    """Current candidates of a streamed table."""
    places = [f"{table}/{part}" for part in (BASE, CHANGES) if exists(spark, f"{table}/{part}")]
    log = ChangeLog(spark, table, _ddl(spark.read.parquet(places[-1]).drop("trigger")))
    return resolve(merge_folds(log.read().drop("trigger")))
