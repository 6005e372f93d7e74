"""Review and library reads, for every batch or organization at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.operators.commit import finished_candidates


def file_candidate_counts(candidates: DataFrame) -> DataFrame:
    """Candidates per source file: total, rejected, processed."""
    return candidates.groupBy("source_file_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.col("status") == "processed").alias("processed"))


def batch_status(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per batch: files, in_progress, pending_review, ready_to_add.

    Candidates are counted per file first (map-side partial sums), so the join with files carries one row per file
    and the batch totals need a single further aggregation.
    """
    per_file = candidates.groupBy("source_file_id").agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if((F.col("status") == "processed") & F.col("duplicate_of_document_id").isNull()).alias("_ready"))
    joined = files.join(per_file.withColumnRenamed("source_file_id", "file_id"), "file_id", "left")
    done = F.col("status").isin(*M.TERMINAL)
    return joined.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~done).alias("in_progress"),
        F.coalesce(F.sum(F.when(done, F.col("_all"))), F.lit(0)).alias("pending_review"),
        F.coalesce(F.sum(F.when(done, F.col("_ready"))), F.lit(0)).alias("ready_to_add"))


def batch_files(files: DataFrame) -> DataFrame:
    """Files of every batch with their progress, oldest first, then by name."""
    return files.select("batch_id", "file_id", "file_name", "status", "entries_total", "entries_done",
                        "status_message", "created_us").orderBy("batch_id", "created_us", "file_name", "file_id")


def batch_staged(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Review list: candidates with the title of the library document they duplicate; direct uploads come first."""
    titles = library.select(F.col("document_id").alias("duplicate_of_document_id"),
                            F.col("title").alias("duplicate_title"))
    return candidates.join(titles, "duplicate_of_document_id", "left").select(
        "batch_id", "staged_id", "source_file_id", "source_entry_name", "entry_index", "file_name", "status",
        "reject_reason", "content_hash", "duplicate_of_document_id", "duplicate_kind", "duplicate_title").orderBy(
        "batch_id", "source_file_id", F.asc_nulls_first("entry_index"), "source_entry_name")


def review_class() -> Column:
    """ready / rejected / duplicate."""
    return (F.when(F.col("status") == "rejected", "rejected")
            .when(F.col("duplicate_of_document_id").isNotNull(), "duplicate").otherwise("ready"))


def review_action(status: DataFrame) -> DataFrame:
    """The button a reviewer sees for each batch: ready beats pending beats in progress."""
    ready, pending, busy = F.col("ready_to_add"), F.col("pending_review"), F.col("in_progress")
    waiting = F.concat(F.lit("Waiting for "), busy.cast("string"), F.when(busy == 1, " file…").otherwise(" files…"))
    return status.select(
        "batch_id", F.when(ready > 0, F.concat(F.lit("Add "), ready.cast("string"), F.lit(" to library")))
        .when(pending > 0, "Done").when(busy > 0, waiting).otherwise("").alias("label"),
        ((ready > 0) | (pending > 0)).alias("enabled"),
        ((ready > 0) | (pending > 0) | (busy > 0)).alias("visible"))


def status_label(files: DataFrame, counts: DataFrame) -> DataFrame:
    """What a queue row shows for each file; NULL while bytes are still moving."""
    status, why = F.col("status"), F.col("status_message")
    joined = files.join(counts.select(F.col("source_file_id").alias("file_id"), "processed", "total"), "file_id",
                        "left")
    checking = F.when(F.coalesce("entries_total", F.lit(0)) != 0, F.concat(
        F.lit("Checking… — "), F.col("entries_done").cast("string"), F.lit(" of "),
        F.col("entries_total").cast("string"))).otherwise("Checking…")
    counted = F.col("total").isNotNull()
    label = (F.when(status.isin("staged", "uploading"), F.lit(None))
             .when(status.isin("uploaded", "processing"), checking)
             .when(status == "processed", "Ready")
             .when((status == "partial") & counted, F.concat(F.lit("Partly ready — "), F.col("processed").cast("string"),
                                                              F.lit(" of "), F.col("total").cast("string")))
             .when(status == "partial", "Partly ready")
             .when(status == "rejected", F.concat(F.lit("Rejected — "), F.coalesce(why, F.lit("not accepted"))))
             .when((status == "error") & (why == M.CANCELLED), "Cancelled")
             .when((status == "error") & (F.col("processed") > 0),
                   F.concat(F.lit("Failed part-way — "), F.col("processed").cast("string"), F.lit(" staged")))
             .when(status == "error", F.concat(F.lit("Failed — "),
                                               F.coalesce(why, F.lit("could not be processed"))))
             .otherwise(status))
    tone = (F.when(status.isin("staged", "uploading"), F.lit(None)).when(status.isin("uploaded", "processing"), "progress")
            .when(status == "processed", "success").when(status == "partial", "warning")
            .when(status == "rejected", "danger").when((status == "error") & (why == M.CANCELLED), "muted")
            .when(status == "error", "danger").otherwise("muted"))
    return joined.select("file_id", label.alias("label"), tone.alias("tone"))


def carry_counts(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """New per-file counts override old ones; files no longer listed keep theirs."""
    new = fresh.select("source_file_id", F.col("processed").alias("_p"), F.col("total").alias("_t"))
    return previous.join(new, "source_file_id", "full").select(
        "source_file_id", F.coalesce("_p", "processed").alias("processed"), F.coalesce("_t", "total").alias("total"))


def stopped_archives(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Files that ended in error (not cancelled) and still offer processed candidates."""
    failed = files.filter((F.col("status") == "error") & ~F.col("status_message").eqNullSafe(M.CANCELLED)).select(
        F.col("file_id").alias("source_file_id"))
    staged = candidates.filter(F.col("status") == "processed").groupBy("source_file_id").agg(
        F.count(F.lit(1)).alias("staged"))
    return failed.join(staged, "source_file_id")


def list_uploads(files: DataFrame) -> DataFrame:
    """Uploads past `uploading`, newest first; uploader, analysis and risk are not known yet."""
    return files.filter(~F.col("status").isin("staged", "uploading")).select(
        "organization_id", "file_id", "file_name", "size_bytes", "status", "created_us",
        F.lit(None).cast("string").alias("highest_risk")).orderBy(F.desc("created_us"), "file_id")


def list_library(library: DataFrame) -> DataFrame:
    """Library documents, newest first."""
    return library.select("organization_id", "document_id", "title", "title_norm", "file_name", "file_ext",
                          "size_bytes", "added_us").orderBy(F.desc("added_us"), "title_norm", "document_id")


def get_document(library: DataFrame, organization_id: str, document_id: str) -> DataFrame:
    """One document by organization and id; both filters reach the scan."""
    return library.filter((F.col("organization_id") == organization_id) & (F.col("document_id") == document_id))


def risk_distribution(library: DataFrame) -> DataFrame:
    """Documents per risk level, findings, and the share of all rated documents."""
    counts = library.filter(F.col("highest_risk").isNotNull()).groupBy("highest_risk").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("open_findings").alias("findings"))
    # At most one row per risk level here, so an unpartitioned window is one tiny task.
    total = F.sum("documents").over(Window.partitionBy())
    return counts.select("highest_risk", "documents", "findings",
                         F.round(F.col("documents") * 100 / total, 2).alias("percent"))


def finished_pending(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates awaiting review (those of finished files) with their class."""
    return finished_candidates(candidates, files).withColumn("review_class", review_class())


def active_batches(files: DataFrame) -> DataFrame:
    """Batches with at least one upload that reached the server completely."""
    return files.filter(~F.col("status").isin("staged", "uploading")).select("batch_id").distinct()


def item_count(results: DataFrame) -> DataFrame:
    """Documents to analyse per result: each valid entry counts its sections, at least one."""
    return results.groupBy("result_id").agg(
        F.coalesce(F.sum(F.when(F.col("valid"), F.greatest(F.lit(1), F.coalesce(F.size("sections"), F.lit(0))))),
                   F.lit(0)).cast("bigint").alias("items"))
