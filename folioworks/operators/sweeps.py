"""Periodic recovery as one projection over the file snapshot at an explicit `as_of` (epoch microseconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.settings import AGES, Ages


def _older(column: str, as_of_us: int, seconds: int) -> Column:
    return F.col(column) < F.lit(as_of_us - seconds * 1_000_000)


def stale_sweep(files: DataFrame, as_of_us: int, ages: Ages = AGES) -> DataFrame:
    """Processing files whose heartbeat fell silent: reset while attempts are left, else error."""
    hit = files.filter((F.col("status") == "processing") & _older("heartbeat_us", as_of_us, ages.stale_seconds))
    return _recover(hit, "reset", as_of_us, ages)


def reconcile_sweep(files: DataFrame, as_of_us: int, ages: Ages = AGES) -> DataFrame:
    """Uploaded files nobody claimed: enqueue again while attempts are left, else error."""
    hit = files.filter((F.col("status") == "uploaded") & _older("uploaded_us", as_of_us, ages.reconcile_seconds))
    return _recover(hit, "requeued", as_of_us, ages)


def _recover(hit: DataFrame, word: str, as_of_us: int, ages: Ages) -> DataFrame:
    left = F.col("attempt_count") < ages.max_attempts
    return hit.select(
        "file_id", F.when(left, word).otherwise("errored").alias("action"),
        F.when(left, "uploaded").otherwise("error").alias("new_status"),
        F.when(left, F.lit(as_of_us)).otherwise(F.col("uploaded_us")).alias("new_uploaded_us"),
        F.when(~left, M.ATTEMPTS_SPENT).otherwise(F.col("status_message")).alias("new_message"))


def abandoned_sweep(files: DataFrame, as_of_us: int, ages: Ages = AGES) -> DataFrame:
    """Uploads left staged or uploading too long, oldest first; their multipart upload is to be aborted."""
    hit = files.filter(F.col("status").isin("staged", "uploading")
                       & _older("created_us", as_of_us, ages.abandon_seconds))
    return hit.select("file_id", "created_us", F.lit("error").alias("new_status"),
                      F.lit(M.ABANDONED).alias("new_message")).orderBy("created_us", "file_id")


def apply_sweep(files: DataFrame, sweep: DataFrame) -> DataFrame:
    """The snapshot after a sweep: swept files take the new status, message and stamp and lose their token."""
    hits = sweep.select("file_id", *[c for c in sweep.columns if c.startswith("new_")])
    joined = files.join(hits, "file_id", "left")
    hit = F.col("new_status").isNotNull()
    changed = {"status": F.coalesce("new_status", "status"),
               "status_message": F.when(hit, F.col("new_message")).otherwise(F.col("status_message")),
               "claim_token": F.when(~hit, F.col("claim_token"))}
    if "new_uploaded_us" in sweep.columns:
        changed["uploaded_us"] = F.when(hit, F.col("new_uploaded_us")).otherwise(F.col("uploaded_us"))
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in files.columns])


def sweep_counts(sweep: DataFrame, column: str = "action") -> DataFrame:
    """Rows per outcome of a sweep."""
    return sweep.groupBy(column).agg(F.count(F.lit(1)).alias("files"))
