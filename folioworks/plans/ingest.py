"""The write path end to end: uploaded files in, typed and hashed candidates and file outcomes out.

detect → (documents: compare with the declared type) / (archives: index → guard, numbering, reasons → extract what
is allowed → outcome). Bytes are read where they lie; only index rows and verdicts are shuffled. An object that cannot
be read ends, or delays, its own file: `attempts` says what follows, and `due` takes the delayed ones up again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.functions import names
from folioworks.functions.text import mismatch_reason, truncate_message
from folioworks.operators import archives as rules
from folioworks.operators.lifecycle import attempt_outcomes, classify_failures
from folioworks.session import durable
from folioworks.settings import AGES, ARCHIVE_LIMITS, Ages, ArchiveLimits
from folioworks.sources import archives as source
from folioworks.sources.objects import FAILURE, hash_objects

CANDIDATE = ["organization_id", "batch_id", "source_file_id", "source_entry_name", "entry_index", "file_name",
             "file_ext", "size_bytes", "content_hash", "s3_key", "status", "reject_reason"]


class Ingested(NamedTuple):
    """files: file_id, detected_type, status, status_message, entries_total, entries_done of every file that is settled.
    candidates: what settled files hold. attempts: file_id, attempt, the failure and what it leads to (failure_class,
    action, final_status, status_message, countdown), and how many entries are read, of every file that could not be read."""

    files: DataFrame
    candidates: DataFrame
    attempts: DataFrame


def process(uploads: DataFrame, limits: ArchiveLimits = ARCHIVE_LIMITS) -> tuple[DataFrame, DataFrame]:
    """(files, candidates) of `process_attempts`."""
    done = process_attempts(uploads, limits)
    return done.files, done.candidates


def process_attempts(uploads: DataFrame, limits: ArchiveLimits = ARCHIVE_LIMITS, ages: Ages = AGES,
                     progress: str | None = None) -> Ingested:
    """Work off `uploads`: file_id, organization_id, batch_id, file_name, file_ext, path and, where bytes are inline, content;
    `attempt` (1 where there is none) counts how often a file has been taken up.

    A missing object ends its file with an error, one that cannot be read for now is to be tried again until the attempts are
    spent, and one that is refused is left as it is; a file that is not settled leaves no candidates. With `progress`, a
    folder, entries read by an earlier run, or by an earlier attempt at the same objects, are not read again.
    """
    inline = "content" in uploads.columns
    meta = ["file_id", "organization_id", "batch_id", "file_name", "file_ext", "path", "attempt"]
    if "attempt" not in uploads.columns:
        uploads = uploads.withColumn("attempt", F.lit(1))
    if inline:
        typed = source.detect_content(uploads, "_d", limits).select(
            *meta, "_d", F.octet_length("content").cast("bigint").alias("size_bytes"),
            F.sha2("content", 256).alias("content_hash"))
        typed = typed.select(*meta, "size_bytes", "content_hash", F.col("_d.type").alias("detected_type"),
                             F.col("_d.reason").alias("_why"), F.lit(None).cast(FAILURE).alias("_failure"))
    else:
        kinds = source.detect_objects(uploads, limits).select(
            "path", F.col("detected").alias("detected_type"), F.col("detected_reason").alias("_why"), F.col("failure").alias("_seen"))
        hashes = hash_objects(uploads.filter("file_ext <> 'zip'")).select(
            "path", F.col("sha256").alias("content_hash"), F.col("bytes_read").alias("size_bytes"), F.col("failure").alias("_hashed"))
        typed = uploads.select(*meta).join(kinds, "path").join(hashes, "path", "left").withColumn(
            "_failure", F.coalesce("_seen", "_hashed")).drop("_seen", "_hashed")
    typed = durable(typed)                     # narrow: one row per upload, no bytes

    documents = typed.filter("file_ext <> 'zip' AND _failure IS NULL")
    status, reason = source.document_outcome(F.col("file_ext"), F.col("detected_type"), F.col("_why"))
    documents = documents.withColumn("status", status).withColumn("status_message", truncate_message(reason))

    boxes = typed.filter("file_ext = 'zip'")
    opened = boxes.filter("detected_type = 'zip'").select("path")
    if inline:
        opened = uploads.select("path", "content").join(opened, "path", "left_semi")
    index = durable(source.zip_index(opened))
    allowed = rules.archive_candidates(index.filter("error IS NULL"), ["entry_pos"], limits)
    wanted = durable(allowed)
    taken = wanted.filter("entry_reason IS NULL")
    read = (durable(source.zip_extract(taken, opened, limits)) if progress is None
            else source.extract_resumable(taken, opened, progress, limits)).select(
        "archive", "entry_pos", "sha256", "crc_error", F.col("error").alias("read_error"), "detected",
        "detected_reason", "failure")
    lost = (typed.select("path", F.col("_failure").alias("failure")).unionByName(index.select(F.col("archive").alias("path"), "failure"))
            .unionByName(read.select(F.col("archive").alias("path"), "failure")).filter("failure IS NOT NULL"))
    failed = durable(lost.groupBy("path").agg(F.min("failure").alias("failure")))
    attempts = _attempts(typed.join(failed, "path"), read, ages)
    read = read.drop("failure")
    boxes = boxes.join(failed, "path", "left_anti")
    seen = durable(wanted.join(read, ["archive", "entry_pos"], "left").fillna({"crc_error": False}))
    entries = rules.entry_outcomes(seen)

    totals = seen.groupBy("archive").agg(
        F.count(F.lit(1)).cast("int").alias("_total"),
        F.min(F.when(F.col("crc_error"), F.struct("entry_index", "read_error"))).alias("_cut"))
    rejected = entries.groupBy("archive").agg(F.count_if(F.col("status") == "rejected").alias("_rejected"))
    per_box = boxes.join(totals.join(rejected, "archive", "left").withColumnRenamed("archive", "path"), "path", "left")
    fits = F.col("detected_type") == "zip"
    why = (F.when(F.col("detected_type") == "corrupt", M.DAMAGED)
           .when(~fits, mismatch_reason(F.lit("zip"), F.col("detected_type"), F.col("_why")))
           .otherwise(F.col("_cut.read_error")))
    per_box = per_box.withColumn("status_message", truncate_message(why)).withColumn(
        "status", F.when(F.col("status_message").isNotNull(), "rejected").when(F.col("_rejected") > 0, "partial")
        .otherwise("processed"))
    files = documents.select(
        "file_id", "detected_type", "status", "status_message", F.lit(None).cast("int").alias("entries_total"),
        F.lit(0).alias("entries_done")).unionByName(per_box.select(
            "file_id", "detected_type", "status", "status_message",
            F.when(fits, F.coalesce("_total", F.lit(0))).alias("entries_total"),
            F.coalesce(F.col("_cut.entry_index"), "_total", F.lit(0)).alias("entries_done"))).unionByName(
        attempts.filter("action = 'finish'").select(
            "file_id", F.lit(None).cast("string").alias("detected_type"), F.col("final_status").alias("status"), "status_message",
            F.lit(None).cast("int").alias("entries_total"), F.lit(0).alias("entries_done")))

    singles = documents.filter("status = 'processed'").select(
        "organization_id", "batch_id", F.col("file_id").alias("source_file_id"),
        F.lit(None).cast("string").alias("source_entry_name"), F.lit(None).cast("int").alias("entry_index"), "file_name",
        "file_ext", "size_bytes", "content_hash",
        names.staging_key(F.col("organization_id"), F.col("batch_id"), F.col("file_id"), F.lit(0), F.col("file_name"))
        .alias("s3_key"), "status", F.lit(None).cast("string").alias("reject_reason"))
    owners = boxes.select(F.col("path").alias("archive"), "organization_id", "batch_id",
                          F.col("file_id").alias("source_file_id"))
    good = F.col("status") == "processed"
    inside = entries.join(owners, "archive").select(
        "organization_id", "batch_id", "source_file_id", F.col("name").alias("source_entry_name"), "entry_index",
        "file_name", "file_ext", F.when(good, F.col("size")).alias("size_bytes"),
        F.when(good, F.col("sha256")).alias("content_hash"),
        F.when(good, names.staging_key(F.col("organization_id"), F.col("batch_id"), F.col("source_file_id"),
                                       F.col("entry_index"), F.col("file_name"))).alias("s3_key"),
        "status", "reject_reason")
    found = singles.select(*CANDIDATE).unionByName(inside.select(*CANDIDATE))
    title = names.title_of(F.col("file_name"))
    return Ingested(files, found.select(
        names.staged_id(F.col("source_file_id"), F.col("source_entry_name")).alias("staged_id"), *CANDIDATE,
        title.alias("proposed_title"), names.title_norm(title).alias("title_norm")), attempts)


def _attempts(failed: DataFrame, read: DataFrame, ages: Ages) -> DataFrame:
    """What the failures of uploads lead to, and how many of their entries are read all the same."""
    judged = attempt_outcomes(classify_failures(failed.select("file_id", "path", "attempt", "failure.*")), ages)
    counted = read.filter("failure IS NULL").groupBy(F.col("archive").alias("path")).agg(F.count(F.lit(1)).alias("_read"))
    return durable(judged.join(counted, "path", "left").select(
        "file_id", "attempt", "origin", "code", "failure_class", "action", "final_status", "status_message", "countdown",
        F.coalesce("_read", F.lit(0)).alias("entries_read")))


def next_attempts(attempts: DataFrame, now_us: int) -> DataFrame:
    """Files to be taken up again: file_id, the number of that attempt, and when it is due."""
    return attempts.filter("action = 'release_and_retry'").select(
        "file_id", (F.col("attempt") + 1).cast("int").alias("attempt"), (F.lit(now_us) + F.col("countdown") * 1_000_000).alias("due_us"))


def due(uploads: DataFrame, files: DataFrame, retries: DataFrame, as_of_us: int) -> DataFrame:
    """Uploads to work on now, with their `attempt`: those neither settled nor tried before, and those whose next attempt is
    due. Of several rows in `retries` for a file the one of the latest attempt counts."""
    latest = retries.groupBy("file_id").agg(F.max(F.struct("attempt", "due_us")).alias("_next"))
    open_ = uploads.drop("attempt").join(files.select("file_id"), "file_id", "left_anti").join(latest, "file_id", "left")
    return open_.filter(F.col("_next").isNull() | (F.col("_next.due_us") <= as_of_us)).withColumn(
        "attempt", F.coalesce("_next.attempt", F.lit(1))).drop("_next")


def uploads_of(objects: DataFrame) -> DataFrame:
    """Uploads from objects under …/incoming/{org}/{batch}/{file_id}_{name} (`path`); other keys are left out.

    The file id ends at the first underscore, as ids contain none.
    """
    found = objects.withColumn("_k", F.regexp_extract("path", r"incoming/([^/]+)/([^/]+)/([^/_]+)_([^/]+)$", 0))
    part = [F.regexp_extract("path", r"incoming/([^/]+)/([^/]+)/([^/_]+)_([^/]+)$", i).alias(n) for i, n in
            ((1, "organization_id"), (2, "batch_id"), (3, "file_id"), (4, "file_name"))]
    return found.filter("_k <> ''").select("path", *part).withColumn("file_ext", names.file_ext(F.col("file_name")))
