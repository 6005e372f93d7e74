"""Every query by name: table adapters wired to operators. Each callable takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.functions import names, text
from folioworks.operators import (admission, archives, candidates, commit, duplicates, lifecycle, metrics, objects,
                                  quality, review, sweeps)
from folioworks.plans import ingest
from folioworks.plans import views as V
from folioworks.session import configure, durable, scratch
from folioworks.settings import UploadLimits, MIB
from folioworks.sources import archives as archive_source
from folioworks.sources import logs
from folioworks.sources import objects as object_source
from folioworks.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its function's name."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return build(configure(spark), sf)
    QUERIES[build.__name__] = run
    return run


# ---- shared inputs

def _marked(docs):
    return duplicates.find_duplicate(V.candidates(docs), V.library(docs))


def _log(spark, sf):
    return logs.parse_lines(V.log_lines(V.events(spark, sf)))


def _states(spark, sf):
    return lifecycle.lifecycle_state(V.lifecycle(V.events(spark, sf)), V.LIFECYCLE_AGES)


def _streamed(spark, sf):
    return jobs.run_lifecycle(V.lifecycle(V.event_stream(spark, sf)), spark, V.LIFECYCLE_AGES, delay_us=V.HOUR_US, rebase=3)


def _accepted_writes(spark, sf):
    return candidates.accepted(V.candidate_writes(V.events(spark, sf)), _states(spark, sf))


def _outcome(docs):
    cands = V.candidates(docs)
    return commit.commit(cands, V.files(cands), V.library(docs), batch_order="block")


def _admitted(spark, sf):
    return admission.admit(V.uploads(spark, sf).filter("phase <> 'F'"), V.upload_library(spark, sf),
                           V.upload_batches(spark, sf))


def _delays(spark, sf):
    return metrics.confirm_to_claim(_log(spark, sf)).withColumn("period", F.split("file_id", "-")[1])


# ---- sources and sinks

@query
def src_manifest(spark, sf):
    found = object_source.list_objects(spark, sf, "*.parquet")
    return found.select(names.base_name(F.col("path")).alias("name"), "length")


@query
def src_file_hash(spark, sf):
    hashed = object_source.hash_objects(object_source.list_objects(spark, sf, "*.parquet"))
    return hashed.select(names.base_name(F.col("path")).alias("name"), "sha256", "bytes_read")


@query
def content_hash(spark, sf):
    raw = V.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return object_source.hash_content(raw).select("doc_id", "sha256",
                                                  F.octet_length("content").cast("bigint").alias("length"))


@query
def zip_index(spark, sf):
    rows = archive_source.zip_index(V.packed(spark, sf, "zip"))
    return rows.select("archive", "entry_pos", "name",
                       F.when(~F.col("name").endswith(".docx"), F.col("size")).alias("plain_size"))


@query
def zip_extract(spark, sf):
    return archive_source.zip_extract(None, V.packed(spark, sf, "zip")).select(
        "archive", "entry_pos", F.when(F.col("entry_pos") > 0, F.col("sha256")).alias("plain_sha256"), "detected",
        "crc_error")


@query
def ingest_files(spark, sf):
    files, _ = ingest.process(V.packed_uploads(spark, sf))
    return files.select("file_id", "detected_type", "status", "status_message", "entries_total", "entries_done")


@query
def ingest_candidates(spark, sf):
    _, found = ingest.process(V.packed_uploads(spark, sf))
    plain = F.col("file_ext") == "pdf"
    return found.select("source_file_id", "source_entry_name", "entry_index", "file_name", "file_ext", "status",
                        "reject_reason", "s3_key", F.when(plain, F.col("content_hash")).alias("pdf_hash"),
                        F.when(plain, F.col("size_bytes")).alias("pdf_bytes"))


@query
def log_parse(spark, sf):
    return _log(spark, sf).select("ts_us", "level", "event", "pid", "file_id", "task_id", "attempt", "entry_index",
                                  "countdown", F.array_join("file_ids", ",").alias("file_ids"))


@query
def commit_documents(spark, sf):
    docs = V.documents(spark, sf)
    return commit.new_documents(_outcome(docs), V.AS_OF_US).select(
        "document_id", "organization_id", "title", "title_norm", "file_name", "file_name_norm", "s3_key", "file_ext",
        "size_bytes", "content_hash", "source_file_id")


@query
def commit_audit(spark, sf):
    docs = V.documents(spark, sf)
    files = V.files(V.candidates(docs))
    return commit.commit_audit(_outcome(docs), files).drop("user_id", "entity_type")


@query
def commit_audit_items(spark, sf):
    return commit.commit_audit_items(_outcome(V.documents(spark, sf)))


@query
def commit_object_plan(spark, sf):
    docs = V.documents(spark, sf)
    return commit.object_plan(_outcome(docs))


@query
def purge_rejected(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    doomed = V.files(cands).filter("status = 'rejected' AND is_archive")
    return objects.purge_rejected(V.staged_objects(cands), doomed)


@query
def retention_expired(spark, sf):
    return objects.retention_expired(V.objects(spark, sf), 946_684_800_000_000)


@query
def seed_files(spark, sf):
    return admission.seed_files(V.objects(spark, sf), "b1", "org").select(
        "file_name", "file_ext", "size_bytes", "s3_key", "is_archive", "error")


# ---- predicates and projections

@query
def admission_(spark, sf):
    return _admitted(spark, sf).select("request_id", "http_status", "detail")


QUERIES["admission"] = QUERIES.pop("admission_")


@query
def register_uploads(spark, sf):
    return admission.register(_admitted(spark, sf)).select("file_id", "batch_id", "file_name", "file_ext",
                                                           "is_archive", "s3_key")


@query
def file_ext(spark, sf):
    return V.raw_names(spark, sf).select("id", names.file_ext(F.col("name")).alias("ext"))


@query
def client_ext(spark, sf):
    return V.raw_names(spark, sf).select("id", names.client_ext(F.col("name")).alias("ext"))


@query
def object_keys(spark, sf):
    doc, org = F.col("doc_id").cast("string"), F.col("lang")
    processed = names.processed_key(org, doc, F.col("file_name"))
    return V.described(spark, sf).select(
        "doc_id", names.incoming_key(org, F.col("source"), doc, F.col("file_name")).alias("incoming_key"),
        names.staging_key(org, F.col("source"), doc, F.col("doc_id") * 7, F.col("file_name")).alias("staging_key"),
        processed.alias("processed_key"), names.location("bucket", processed).alias("location"))


@query
def part_plan(spark, sf):
    files = V.uploads(spark, sf).withColumnRenamed("request_id", "file_id")
    return admission.part_plan(files, UploadLimits(part_bytes=512 * MIB))


@query
def upload_progress(spark, sf):
    size = F.floor("l_extendedprice").cast("bigint")
    done = F.when(F.col("l_returnflag") == "A", size).when(F.col("l_returnflag") == "R", text.quotient(size, 2)).otherwise(0)
    parts = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), size.alias("size"),
                                                  done.alias("uploaded"))
    return admission.upload_progress(parts)


@query
def detect_magic(spark, sf):
    return V.packed(spark, sf).select("path", archive_source.magic_type(F.col("content")).alias("magic"))


@query
def detect_full(spark, sf):
    return archive_source.detect_content(V.packed(spark, sf), "d").select("path", F.col("d.type").alias("detected"))


@query
def document_outcome(spark, sf):
    found = archive_source.detect_content(V.packed(spark, sf), "d").select("path", "d")
    status, reason = archive_source.document_outcome(F.lit("docx"), F.col("d.type"), F.col("d.reason"))
    return found.select("path", status.alias("status"), reason.alias("reason"))


@query
def mismatch_reason(spark, sf):
    rows = V.entries(spark, sf).select(F.regexp_extract("name", r"\.([a-z]+)$", 1).alias("declared"), "detected",
                                       "detected_reason")
    reason = text.mismatch_reason(F.col("declared"), F.col("detected"), F.col("detected_reason"))
    return rows.groupBy("declared", "detected", reason.alias("reason")).agg(F.count(F.lit(1)).alias("entries"))


@query
def folder_depth(spark, sf):
    from folioworks.operators.ranking import ordered_scan
    rows = ordered_scan(V.entries(spark, sf), ["archive"], V.ENTRY_ORDER, {"pos": ("number", None)})
    return rows.select("archive", (F.col("pos") - 1).cast("int").alias("entry_pos"),
                       names.folder_depth(F.col("name")).alias("depth"))


@query
def archive_guard(spark, sf):
    return archives.archive_guard(V.entries(spark, sf), V.ENTRY_ORDER, V.ENTRY_LIMITS)


@query
def archive_candidates(spark, sf):
    return archives.archive_candidates(V.entries(spark, sf), V.ENTRY_ORDER, V.ENTRY_LIMITS).select(
        "archive", "entry_index", "name", "file_name", "file_ext", "entry_reason")


@query
def truncate_msg(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", text.truncate_message(F.col("text")).alias("message"))


@query
def candidate_validity(spark, sf):
    return V.candidate_writes(V.events(spark, sf)).groupBy(candidates.validity_error().alias("error")).agg(
        F.count(F.lit(1)).alias("writes"))


@query
def list_uploads(spark, sf):
    return review.list_uploads(V.lifecycle_files(_states(spark, sf))).drop("highest_risk")


@query
def queue_validation(spark, sf):
    rows = V.uploads(spark, sf)
    return admission.queue_validation(rows.filter("phase <> 'F'"), rows.filter("phase = 'F'")).drop("size_bytes")


@query
def zip_precheck(spark, sf):
    rows = V.entries(spark, sf).withColumn("size", F.when(F.col("l_discount") == 0, 0).otherwise(F.col("size"))).withColumn(
        "signature_ok", F.col("l_tax") < 0.07)
    opened = rows.groupBy("archive").agg(F.lit(None).cast("string").alias("error"))
    return archives.zip_precheck_verdict(opened, archives.zip_precheck(rows, V.ENTRY_LIMITS), V.ENTRY_LIMITS)


@query
def zip_precheck_entries(spark, sf):
    rows = V.entries(spark, sf).withColumn("size", F.when(F.col("l_discount") == 0, 0).otherwise(F.col("size"))).withColumn(
        "signature_ok", F.col("l_tax") < 0.07)
    return archives.zip_precheck(rows, V.ENTRY_LIMITS).groupBy("name", "warning").agg(F.count(F.lit(1)).alias("entries"))


@query
def empty_docs(spark, sf):
    def part(name, label, column):
        return V.table(spark, sf, name).select(label.alias("id"), text.is_blank(F.col(column)).alias("empty"),
                                               text.empty_error(F.col(column), column).alias("error"))
    turn = F.concat(F.lit("turn-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return part("documents", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), "text").unionByName(
        part("pages", F.concat(F.lit("page-"), F.col("page_id").cast("string")), "html")).unionByName(
        part("conversations", turn, "text"))


@query
def status_label(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    return review.status_label(V.files(cands), review.file_candidate_counts(cands))


@query
def review_action(spark, sf):
    return review.review_action(QUERIES["batch_status"](spark, sf))


@query
def review_split(spark, sf):
    docs = V.documents(spark, sf)
    return review.finished_pending(_marked(docs), V.files(V.candidates(docs))).groupBy("batch_id", "review_class").agg(
        F.count(F.lit(1)).alias("candidates"))


@query
def dup_errors(spark, sf):
    return _admitted(spark, sf).select("request_id", text.any_duplicate_error(F.array("detail")).alias("duplicate"))


# ---- joins

@query
def dup_name_size(spark, sf):
    asked = V.uploads(spark, sf).filter("phase <> 'F'").withColumn("file_name_norm",
                                                                   names.file_name_norm(F.col("file_name")))
    return duplicates.by_name_and_size(asked, V.upload_library(spark, sf)).select("request_id", "duplicate_of")


@query
def find_duplicate(spark, sf):
    docs = V.documents(spark, sf)
    return _marked(docs).select("staged_id", "duplicate_of_document_id", "duplicate_kind")


@query
def find_duplicate_union(spark, sf):
    docs = V.documents(spark, sf)
    return duplicates.find_duplicate_union(V.candidates(docs), V.library(docs))


@query
def batch_staged(spark, sf):
    docs = V.documents(spark, sf)
    return review.batch_staged(_marked(docs), V.library(docs))


@query
def finished_candidates(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    return commit.finished_candidates(cands, V.files(cands)).select("staged_id", "source_file_id", "batch_id", "status",
                                                                   "file_created_us")


@query
def unknown_batches(spark, sf):
    return admission.unknown_ids(V.uploads(spark, sf), V.upload_batches(spark, sf), "batch_id")


@query
def fenced_writes(spark, sf):
    return lifecycle.fenced_writes(V.lifecycle(V.events(spark, sf)), _states(spark, sf))


@query
def upload_lookup(spark, sf):
    rows = V.uploads(spark, sf).withColumn("upload_id", F.concat(F.lit("u"), "request_id"))
    known = rows.select("upload_id", F.col("request_id").alias("file_id"), F.concat("upload_id", F.lit("/key")).alias(
        "s3_key"), F.when(F.col("phase") == "O", "uploading").otherwise("processed").alias("status"))
    asked = rows.select("request_id", "upload_id", F.concat("upload_id", F.when(
        F.col("file_name").endswith(".txt"), "/other").otherwise("/key")).alias("s3_key"))
    return admission.upload_lookup(asked, known).select("request_id", "file_id", "result")


@query
def carry_counts(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    fresh = review.file_candidate_counts(cands.filter("status = 'processed'"))
    return review.carry_counts(fresh, review.file_candidate_counts(cands))


@query
def confirm_to_claim(spark, sf):
    return metrics.confirm_to_claim(_log(spark, sf))


@query
def orphan_objects(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    return objects.orphan_objects(cands.filter("s3_key IS NOT NULL").select(F.col("s3_key").alias("key")),
                                  V.staged_objects(cands))


@query
def stopped_archives(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    return review.stopped_archives(V.files(cands), cands)


@query
def purge_batch(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    files, library = V.files(cands), V.library(docs)
    batches = files.select("batch_id", "organization_id").distinct()
    left = candidates.purge_batches(batches, files, cands, library, batches.filter("organization_id = 'es'"))
    parts = [rows.agg(F.count(F.lit(1)).alias("rows"), (F.count_if(F.col("source_file_id").isNull()) if name == "library"
                                                        else F.lit(0).cast("bigint")).alias("unlinked"))
             .select(F.lit(name).alias("table"), "rows", "unlinked") for name, rows in left.items()]
    return reduce(DataFrame.unionByName, parts)


# ---- aggregations

@query
def file_candidate_counts(spark, sf):
    docs = V.described(spark, sf)
    return review.file_candidate_counts(V.candidates(docs))


@query
def batch_status(spark, sf):
    docs = V.documents(spark, sf)
    return review.batch_status(V.files(V.candidates(docs)), _marked(docs))


@query
def batch_files(spark, sf):
    docs = V.described(spark, sf)
    return review.batch_files(V.files(V.candidates(docs)))


@query
def item_count(spark, sf):
    rows = V.sections(spark, sf).select("result_id", (F.col("p_type") != "LARGE").alias("valid"),
                                        text.video_sections(F.col("text")).alias("sections"))
    return review.item_count(rows)


@query
def dq_duplicate_candidates(spark, sf):
    return quality.repeated_keys(V.candidate_writes(V.events(spark, sf)), candidates.KEY).drop("video_script_seq")


@query
def dq_open_files(spark, sf):
    docs = V.described(spark, sf)
    return quality.open_files(V.files(V.candidates(docs)))


@query
def latency_p95(spark, sf):
    return metrics.nearest_rank(_delays(spark, sf), ["period"], "delay_us", 95)


@query
def latency_spread(spark, sf):
    return metrics.spread(_delays(spark, sf), ["period"], "delay_us")


@query
def sweep_totals(spark, sf):
    return metrics.sweep_totals(_log(spark, sf))


@query
def peak_concurrency(spark, sf):
    spans = V.lifecycle_files(_states(spark, sf)).select("organization_id", "file_id", F.explode("wins").alias("w"))
    return metrics.peak_concurrency(spans.select(
        "organization_id", F.col("w.from_us").alias("from_us"), F.col("w.to_us").alias("to_us")), ["organization_id"])


@query
def claim_counts(spark, sf):
    return metrics.claim_counts(_log(spark, sf))


@query
def risk_distribution(spark, sf):
    docs = V.described(spark, sf)
    return review.risk_distribution(V.library(docs))


@query
def commit_summary(spark, sf):
    docs = V.documents(spark, sf)
    return commit.commit_summary(_outcome(docs), V.files(V.candidates(docs)))


@query
def retry_check(spark, sf):
    return metrics.retry_check(_log(spark, sf))


# ---- ordered work

@query
def archive_outcome(spark, sf):
    return archives.archive_outcome(V.entries(spark, sf), V.ENTRY_ORDER, V.ENTRY_LIMITS)


@query
def ingest_attempts(spark, sf):
    """Objects read by path, some missing, unreadable or damaged: what becomes of every file, and its next attempt."""
    uploads = V.stored_uploads(spark, sf)
    done = ingest.process_attempts(uploads.drop("kind"))
    again = ingest.next_attempts(done.attempts, V.AS_OF_US).select("file_id", F.col("attempt").alias("next_attempt"), "due_us")
    tried = done.attempts.select("file_id", "failure_class", "action", "countdown")
    return uploads.select("file_id", "attempt").join(done.files, "file_id", "left").join(tried, "file_id", "left").join(
        again, "file_id", "left")


@query
def ingest_resumed(spark, sf):
    """Candidates of stored archives whose first reading was cut short; no entry is read twice."""
    uploads, progress = V.stored_uploads(spark, sf).filter("kind > 3"), scratch(spark, "progress")
    index = archive_source.zip_index(uploads.select("path"))
    wanted = archives.archive_candidates(durable(index), ["entry_pos"]).filter("entry_reason IS NULL")
    archive_source.extract_resumable(wanted, uploads.select("path"), progress, waves=8, stop_after=3)
    done = ingest.process_attempts(uploads, progress=progress)
    times = archive_source.read_progress(spark, progress).groupBy(F.col("archive").alias("path"), "entry_pos").agg(
        F.count(F.lit(1)).alias("times_read"))
    most = times.join(uploads, "path").groupBy(F.col("file_id").alias("source_file_id")).agg(F.max("times_read").alias("times_read"))
    return done.candidates.join(most, "source_file_id").select(
        "source_file_id", "source_entry_name", "entry_index", "status", "content_hash", "size_bytes", "times_read")


@query
def object_plan_results(spark, sf):
    """A plan over stored objects, some of them missing or unreadable, carried out twice: what each operation came to."""
    root = scratch(spark, "store")
    stored = V.stored_uploads(spark, sf, f"{root}/incoming")
    src = F.concat(F.lit("incoming/"), "file_name")
    steps = F.array(F.struct(F.lit("copy").alias("op"), src.alias("src"), F.concat(F.lit("processed/"), "organization_id", F.lit("/v1_"), "file_name").alias("dst")),
                    F.struct(F.lit("delete").alias("op"), src.alias("src"), F.lit(None).cast("string").alias("dst")))
    plan = durable(stored.select(F.explode(steps).alias("s")).select("s.*"))
    first, second = (object_source.execute_plan(plan, root).select("op", "src", F.col("outcome").alias(name), F.col("failure.code").alias(code))
                     for name, code in (("outcome", "code"), ("outcome_again", "code_again")))
    return plan.select("op", "src", "dst").join(first, ["op", "src"]).join(second, ["op", "src"])


@query
def entry_outcomes(spark, sf):
    found = archives.archive_candidates(V.entries(spark, sf), V.ENTRY_ORDER, V.ENTRY_LIMITS)
    return archives.entry_outcomes(found).select("archive", "entry_index", "name", "status", "reject_reason")


@query
def resume_entries(spark, sf):
    rows = V.entries(spark, sf)
    done = rows.groupBy("archive").agg(text.quotient(F.count(F.lit(1)), 3).alias("entries_done"))
    found = archives.archive_candidates(rows, V.ENTRY_ORDER, V.ENTRY_LIMITS)
    return archives.resume_entries(found, done).select("archive", "entry_index", "name")


@query
def candidate_upsert(spark, sf):
    return candidates.upsert(_accepted_writes(spark, sf)).select(
        "source_file_id", "source_entry_name", "entry_index", "file_name", "size_bytes", "status", "reject_reason",
        "content_hash", "seq")


@query
def candidate_quarantine(spark, sf):
    return candidates.quarantined(V.candidate_writes(V.events(spark, sf)), _states(spark, sf)).select(
        "seq", "source_file_id", "source_entry_name", "status", "error")


@query
def candidate_mismatch(spark, sf):
    return candidates.mismatches(_accepted_writes(spark, sf)).select(
        "source_file_id", "source_entry_name", "entry_index", "file_name", "writes")


@query
def resume_point(spark, sf):
    return metrics.resume_point(_log(spark, sf))


@query
def resume_check(spark, sf):
    lines = _log(spark, sf)
    kills = lines.filter("event = 'retrying'").groupBy("file_id").agg(
        F.max((F.unix_seconds("ts") % 7).cast("int")).alias("killed_at_entry"))
    return metrics.check_resume(metrics.resume_point(lines), kills).select(
        "file_id", "resumed_at", "killed_at_entry", "as_expected")


@query
def upload_eligibility(spark, sf):
    rows = V.uploads(spark, sf).withColumn("_k", F.col("position") % 7).withColumn(
        "file_ext", names.file_ext(F.col("file_name")))
    state = {"status": F.when(F.col("_k") == 0, "validation-failed").otherwise("ready"), "valid": F.when(F.col("_k") != 1, F.col("_k") != 2),
             "validated": F.when(F.col("_k") != 3, F.lit(True)),
             "cloud": F.when(F.col("_k") == 4, "idle").when(F.col("_k") == 5, "failed").when(F.col("_k") == 6, "uploading")}
    return rows.select("position", "file_ext", admission.can_start(
        state["status"], state["valid"], F.col("file_ext"), state["validated"], state["cloud"]).alias("can_start"))


@query
def rejected_candidates(spark, sf):
    cands = V.candidates(V.documents(spark, sf))
    refused = V.files(cands).filter("is_archive AND source IN ('src2', 'src9', 'src11')").select(
        "file_id", F.when(F.col("source") == "src9", F.repeat(F.lit("why "), 200)).when(
            F.col("source") == "src11", F.col("status_message")).alias("status_message"))
    return lifecycle.reject_candidates_of(cands, refused).select("staged_id", "status", "s3_key", "reject_reason")


@query
def recovery_timeline(spark, sf):
    return metrics.recovery_timeline(_log(spark, sf))


# ---- order, lookups and sets

@query
def list_library(spark, sf):
    docs = V.described(spark, sf)
    return review.list_library(V.library(docs))


@query
def get_document(spark, sf):
    # The first of a title is only known among all of an organization's documents, so its filter is what the scan gets.
    library = V.library(V.described(spark, sf).filter("lang = 'en'"))
    return review.get_document(library, "en", "lib-1").select("document_id", "title", "file_name", "size_bytes")


@query
def log_merge(spark, sf):
    lines = _log(spark, sf).filter("file_id IS NOT NULL")
    # Two snapshots that overlap, each with lines that the other lacks; together they hold every line.
    third = F.coalesce(F.col("ts_us") % 3, F.lit(0))
    merged = metrics.merge_snapshots(lines.filter(third != 1), lines.filter(third != 0))
    return merged.select("file_id", "ts_us", "event", "pid")


@query
def sweep_coverage(spark, sf):
    return metrics.sweep_coverage(_log(spark, sf))


@query
def active_batches(spark, sf):
    return review.active_batches(V.lifecycle_files(_states(spark, sf)))


# ---- scalars

@query
def title_norm(spark, sf):
    return V.described(spark, sf).select("doc_id", "title_norm")


@query
def file_name_norm(spark, sf):
    return V.described(spark, sf).select("doc_id", names.file_name_norm(F.col("file_name")).alias("file_name_norm"))


@query
def title_of(spark, sf):
    return V.raw_names(spark, sf).select("id", names.title_of(F.col("name")).alias("title"))


@query
def document_id(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", names.document_id(F.col("doc_id").cast("string"))
                                                  .alias("document_id"))


@query
def video_sections(spark, sf):
    rows = V.sections(spark, sf).select("section_doc", F.explode(text.video_sections(F.col("text"))).alias("s"))
    return rows.select("section_doc", F.col("s.id").alias("section_id"), F.col("s.index").alias("index"),
                       F.col("s.title").alias("title"))


@query
def format_bytes(spark, sf):
    shrink = F.expr("size_bytes div (1 + position % 4 * position % 4 * 40000)")
    return V.uploads(spark, sf).select("request_id", text.format_bytes(shrink).alias("text"))


# ---- lifecycle

@query
def ensure_batch(spark, sf):
    return admission.ensure_batches(V.upload_batches(spark, sf), V.uploads(spark, sf))


@query
def lifecycle_state(spark, sf):
    return _states(spark, sf).drop("wins")


@query
def confirm_result(spark, sf):
    return lifecycle.confirm_results(V.lifecycle(V.events(spark, sf)))


@query
def claims(spark, sf):
    return lifecycle.claim_results(V.lifecycle(V.events(spark, sf)), _states(spark, sf))


@query
def finish_outcome(spark, sf):
    cands = V.candidates(V.documents(spark, sf))
    status, source = F.col("status"), F.col("source")
    asked = (F.when(source == "src9", "stopped").when(status == "partial", "processed")
             .when(status.isin("uploaded", "processing"), "error").otherwise(status))
    requests = V.files(cands).select("file_id", "is_archive", (F.col("entries_total") + F.when(source == "src5", 1)
                                     .otherwise(0)).alias("entries_total"), asked.alias("status"), "status_message")
    counts = review.file_candidate_counts(cands).withColumnRenamed("source_file_id", "file_id")
    return lifecycle.finish_outcomes(requests, counts)


@query
def sweep_stale(spark, sf):
    return sweeps.stale_sweep(_states(spark, sf), V.AS_OF_US, V.LIFECYCLE_AGES)


@query
def sweep_reconcile(spark, sf):
    return sweeps.reconcile_sweep(_states(spark, sf), V.AS_OF_US, V.LIFECYCLE_AGES)


@query
def sweep_abandoned(spark, sf):
    return sweeps.abandoned_sweep(_states(spark, sf), V.AS_OF_US, V.LIFECYCLE_AGES)


@query
def classify_failures(spark, sf):
    return lifecycle.classify_failures(V.failures(V.events(spark, sf))).select("seq", "failure_class")


@query
def attempt_outcome(spark, sf):
    return lifecycle.attempt_outcomes(lifecycle.classify_failures(V.failures(V.events(spark, sf))), V.LIFECYCLE_AGES).select(
        "seq", "action", "final_status", "status_message", "countdown")


@query
def commit_skipped(spark, sf):
    docs = V.documents(spark, sf)
    return commit.skipped(_outcome(docs))


@query
def commit_resolutions(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    return commit.resolutions(cands, V.files(cands), _outcome(docs))


@query
def committed_batches(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    return commit.committed_batches(V.files(cands), cands)


@query
def remaining_candidates(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    return commit.remaining_candidates(cands, V.files(cands)).select("staged_id", "batch_id")


# ---- sessions, ticks and counts

@query
def heartbeat_sessions(spark, sf):
    beats = V.lifecycle(V.events(spark, sf)).filter("kind IN ('claim', 'heartbeat', 'progress')")
    return metrics.heartbeat_sessions(beats, 12 * 3600)


@query
def sweep_windows(spark, sf):
    return metrics.sweep_windows(_log(spark, sf))


@query
def log_event_counts(spark, sf):
    return metrics.event_counts(_log(spark, sf))


# ---- streams (each runs over all files there are, then its table is read back)

@query
def stream_intake(spark, sf):
    return jobs.read_back(jobs.intake(V.lifecycle(V.event_stream(spark, sf)), "40 days"), spark).select("file_id")


@query
def stream_ingest(spark, sf):
    """Objects that arrive under a prefix, a few triggers of them: typed, guarded and exploded as they come."""
    root, out = scratch(spark, "arrivals"), scratch(spark, "ingested")
    arrived = V.stored_uploads(spark, sf, root, keyed=True).filter("kind > 1").count()
    objects = jobs.stream_manifest(spark, f"{root}/incoming", max(1, -(-arrived // 3)))
    jobs.run_ingest(objects, out, scratch(spark, "stream-state"))
    return spark.read.parquet(f"{out}/files").drop("trigger")


@query
def stream_lifecycle(spark, sf):
    return jobs.read_states(spark, _streamed(spark, sf)).select(
        "file_id", "status", "status_message", "attempt_count", "claim_token", "heartbeat_us", "uploaded_us",
        "entries_total", "entries_done", "detected_type")


@query
def stream_stale(spark, sf):
    return jobs.stale_alerts(spark, _streamed(spark, sf)).select("file_id", "heartbeat_us", "attempt_count")


@query
def stream_log_counts(spark, sf):
    lines = logs.parse_lines(V.log_lines(V.event_stream(spark, sf)))
    return jobs.run_counts(metrics.event_counts(lines), ["level", "event"], spark)


@query
def stream_sweep_windows(spark, sf):
    lines = logs.parse_lines(V.log_lines(V.event_stream(spark, sf))).withWatermark("ts", "1 minute")
    return jobs.run_counts(metrics.sweep_windows(lines), ["event", "start_us"], spark)


@query
def stream_candidates(spark, sf):
    table = jobs.run_candidates(V.candidate_writes(V.event_stream(spark, sf)), durable(_states(spark, sf)), spark)
    return jobs.read_candidates(spark, table).select(
        "source_file_id", "source_entry_name", "entry_index", "file_name", "size_bytes", "status", "content_hash", "seq")


# ---- data quality

@query
def dq_unique_title(spark, sf):
    docs = V.documents(spark, sf)
    return quality.repeated_keys(V.candidates(docs), ["organization_id", "title_norm"])


@query
def dq_unique_upload(spark, sf):
    rows = V.uploads(spark, sf)
    refs = quality.repeated_keys(rows, ["batch_id", "file_name"]).select(
        F.lit("batch_client_ref").alias("rule"), F.concat_ws("|", "batch_id", "file_name").alias("value"), "copies")
    with_id = rows.withColumn("upload_id", F.when(~F.col("file_name").endswith(".txt"), F.concat_ws(
        "|", "file_name", F.col("size_bytes").cast("string"))))
    ids = quality.repeated_keys(with_id, ["upload_id"], nulls_equal=False).select(
        F.lit("upload_id").alias("rule"), F.col("upload_id").alias("value"), "copies")
    return refs.unionByName(ids)


@query
def dq_enums(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    files = V.files(cands).withColumn("status", F.when(F.col("source") == "src9", "stopped").otherwise(F.col("status")))
    library = V.library(docs).withColumn("highest_risk", F.coalesce("highest_risk", F.lit("UNRATED")))
    return quality.enum_violations({"file": files, "candidate": cands, "batch": V.upload_batches(spark, sf),
                                    "library": library})


@query
def dq_replace_target(spark, sf):
    rows = V.uploads(spark, sf).select(
        "request_id", F.when(F.col("phase") == "P", "replace").otherwise("new").alias("intent"),
        F.when(F.lower("file_name").endswith(".pdf"), F.lit("doc")).alias("replaces_document_id"),
        F.col("file_name").endswith(".zip").alias("is_archive"))
    return rows.filter(~quality.replace_target_ok()).select("request_id")


@query
def dq_orphans(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    files = V.files(cands)
    return quality.orphans(V.library(docs), "source_file_id", files, "file_id", "library.source_file_id").unionByName(
        quality.orphans(cands, "source_file_id", files, "file_id", "candidate.source_file_id")).unionByName(
        quality.orphans(V.uploads(spark, sf), "batch_id", V.upload_batches(spark, sf), "batch_id", "upload.batch_id"))


@query
def dq_fields(spark, sf):
    digest = F.sha2("text", 256)
    rows = V.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("file_name"), F.col("lang").alias("file_ext"),
        F.when(F.col("lang") == "es", F.upper(digest)).otherwise(digest).alias("content_hash"),
        F.lit(0).alias("entry_index"), F.col("n_chars").alias("size_bytes"))
    return quality.field_violations(rows, "doc_id")


@query
def dq_invariants(spark, sf):
    docs = V.documents(spark, sf)
    cands = V.candidates(docs)
    return quality.invariants(V.files(cands), cands)


@query
def dq_claims(spark, sf):
    return quality.claim_violations(lifecycle.claim_results(V.lifecycle(V.events(spark, sf)), _states(spark, sf)),
                                    V.LIFECYCLE_AGES.max_attempts)
