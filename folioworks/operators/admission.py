"""Admission of uploads: server refusals, batch creation, seeding from a manifest, and the client's queue checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.functions import names
from folioworks.functions.text import duplicate_queue_message, duplicate_upload_message, format_bytes
from folioworks.operators.duplicates import by_name_and_size
from folioworks.settings import MIB, UPLOAD_LIMITS, UploadLimits


def admit(requests: DataFrame, library: DataFrame, batches: DataFrame,
          limits: UploadLimits = UPLOAD_LIMITS) -> DataFrame:
    """First refusal of each upload request: `http_status` and `detail` (NULL: accepted).

    Order: too big 413, type 400, duplicate by name and size 409, closed batch 409. `requests`: request_id,
    organization_id, batch_id, file_name, size_bytes.
    """
    named = requests.withColumn("file_name_norm", names.file_name_norm(F.col("file_name"))).withColumn(
        "file_ext", names.file_ext(F.col("file_name")))
    known = by_name_and_size(named, library).join(
        batches.select("batch_id", F.col("status").alias("_batch")), "batch_id", "left")
    big = F.col("size_bytes") > limits.max_bytes
    wrong = ~F.col("file_ext").isin(*limits.exts)
    twice = F.col("duplicate_of").isNotNull()
    closed = F.coalesce(F.col("_batch").isin("committed", "abandoned"), F.lit(False))
    return known.select(
        *requests.columns, "file_ext",
        F.when(big, 413).when(wrong, 400).when(twice | closed, 409).alias("http_status"),
        F.when(big, M.OVER_CLOUD_LIMIT.format(limits.max_bytes // MIB))
        .when(wrong, F.concat(F.lit(M.UNSUPPORTED), F.col("file_name")))
        .when(twice, duplicate_upload_message(F.col("file_name")))
        .when(closed, F.concat(F.lit(M.BATCH), F.col("batch_id"), F.lit(M.BATCH_CLOSED), F.col("_batch"),
                               F.lit("."))).alias("detail"))


def register(admitted: DataFrame) -> DataFrame:
    """New `staged` file rows of the accepted requests."""
    return admitted.filter("http_status IS NULL").select(
        F.col("request_id").alias("file_id"), "batch_id", "organization_id", "file_name", "file_ext", "size_bytes",
        (F.col("file_ext") == "zip").alias("is_archive"), F.lit("staged").alias("status"),
        names.incoming_key(F.col("organization_id"), F.col("batch_id"), F.col("request_id"),
                           F.col("file_name")).alias("s3_key"))


def ensure_batches(batches: DataFrame, wanted: DataFrame, created_by: int = 0) -> DataFrame:
    """Batches after first sight of the wanted ids: existing rows unchanged, unknown ones `in_progress`."""
    new = wanted.select("batch_id", "organization_id").distinct().join(batches, "batch_id", "left_anti").groupBy(
        "batch_id").agg(F.min("organization_id").alias("organization_id")).select(
        "batch_id", "organization_id", F.lit(created_by).cast("bigint").alias("created_by"),
        F.lit("in_progress").alias("status"))
    return batches.select(*new.columns).unionByName(new)


def unknown_ids(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Asked-for ids that do not exist."""
    return asked.select(key).distinct().join(known.select(key), key, "left_anti")


def seed_files(manifest: DataFrame, batch_id: str, organization_id: str,
               limits: UploadLimits = UPLOAD_LIMITS) -> DataFrame:
    """Rows for objects found under incoming/: extension and prefix checked, with the refusal in `error`."""
    name = names.base_name(F.col("key"))
    ext = names.file_ext(F.col("key"))
    allowed = ", ".join(limits.exts)
    return manifest.select(
        F.lit(batch_id).alias("batch_id"), F.lit(organization_id).alias("organization_id"),
        name.alias("file_name"), ext.alias("file_ext"), F.col("length").alias("size_bytes"),
        F.col("key").alias("s3_key"), (ext == "zip").alias("is_archive"), F.lit("staged").alias("status"),
        F.when(~ext.isin(*limits.exts), F.concat(F.lit("'"), name, F.lit(
            M.EXTENSION_NOT_ALLOWED.format(allowed))))
        .when(~F.startswith("key", F.lit("incoming/")), F.concat(
            F.lit("'"), F.col("key"), F.lit(M.KEY_OUTSIDE))).alias("error"))


def upload_lookup(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Find files by upload id AND key; both must match. `result`: 404 unknown, done (past uploading), or open."""
    known = files.select("upload_id", "s3_key", "file_id", F.col("status").alias("_status"))
    return asked.join(known, ["upload_id", "s3_key"], "left").select(
        *asked.columns, "file_id",
        F.when(F.col("file_id").isNull(), M.UPLOAD_NOT_FOUND)
        .when(F.col("_status").isin("staged", "uploading"), "open").otherwise("done").alias("result"))


def _is_earlier_copy(selection: DataFrame) -> DataFrame:
    """Position of the first file with the same lower-case name and size."""
    return selection.groupBy(F.lower("file_name").alias("_name"), "size_bytes").agg(F.min("position").alias("_first"))


def queue_validation(selection: DataFrame, queued: DataFrame, limits: UploadLimits = UPLOAD_LIMITS) -> DataFrame:
    """First error of each selected file (`position` is its place in the selection), and whether it can start.

    Order: format, empty, too large, duplicate of a queued file or of an earlier one in the selection.
    """
    ext = names.client_ext(F.col("file_name"))
    raw = F.lower(F.regexp_extract(names.trim(F.col("file_name")), r"(?i)\.([a-z0-9]+)$", 1))
    waiting = queued.select(F.lower("file_name").alias("_name"), "size_bytes").distinct().withColumn(
        "_queued", F.lit(True))
    keyed = selection.withColumn("_name", F.lower("file_name"))
    joined = keyed.join(_is_earlier_copy(selection), ["_name", "size_bytes"], "left").join(
        waiting, ["_name", "size_bytes"], "left")
    listed = ", ".join(e.upper() for e in limits.exts)
    error = (F.when(~ext.isin(*limits.exts) & (raw != ""), F.concat(F.lit("."), raw, F.lit(M.NOT_A_FORMAT)))
             .when(~ext.isin(*limits.exts), M.FORMATS.format(listed))
             .when(F.col("size_bytes") == 0, M.EMPTY_FILE)
             .when(F.col("size_bytes") > limits.max_bytes, F.concat(
                 F.lit(M.OVER_MAXIMUM), format_bytes(F.lit(limits.max_bytes).cast("bigint")),
                 F.lit(".")))
             .when(F.col("_queued") | (F.col("_first") < F.col("position")),
                   duplicate_queue_message(F.col("file_name"))))
    return joined.select("position", "file_name", "size_bytes", error.alias("error")).withColumn(
        "startable", F.col("error").isNull())


def can_start(status: Column, valid: Column, extension: Column, validated: Column, cloud: Column) -> Column:
    """May an upload start? Blocked items never; otherwise when it is idle, failed or was never started."""
    blocked = ((status == "validation-failed") | ~F.coalesce(valid, F.lit(True))
               | (F.coalesce(extension, F.lit("")) == "") | ~F.coalesce(validated, F.lit(False)))
    return ~blocked & F.coalesce(cloud.isin("idle", "failed"), F.lit(True))


def part_plan(files: DataFrame, limits: UploadLimits = UPLOAD_LIMITS) -> DataFrame:
    """Byte ranges [start, end) of each file's parts; at least one part. The row count per file is bounded by the
    upload limit over the part size."""
    size, step = F.col("size_bytes"), limits.part_bytes
    parts = F.greatest(F.lit(1).cast("bigint"), F.ceil(size / step))
    return files.select("file_id", "size_bytes", F.explode(F.sequence(F.lit(1).cast("bigint"), parts)).alias(
        "part_number")).select(
        "file_id", "part_number", ((F.col("part_number") - 1) * step).alias("start"),
        F.least(F.col("part_number") * step, size).alias("end"))


def upload_progress(parts: DataFrame) -> DataFrame:
    """Percent uploaded per file, rounded half up, at most 100; an empty file counts as done."""
    sums = parts.groupBy("file_id").agg(F.sum("uploaded").alias("uploaded_bytes"), F.sum("size").alias("total_bytes"))
    percent = F.floor(F.col("uploaded_bytes") / F.nullif(F.col("total_bytes"), F.lit(0)) * 100 + 0.5)
    return sums.withColumn("percent", F.when(F.col("total_bytes") > 0, F.least(F.lit(100).cast("bigint"), percent))
                           .otherwise(F.lit(100)))
