"""Document-ingest tables derived from the given parquet tables, whole tables and whole texts.

documents + labels → library (approved), candidates and files (the rest); lineitem → archive index; events →
lifecycle log and JSON lines; orders + customer → upload requests; pages + part → names, texts and sections.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from folioworks import messages as M
from folioworks.functions import names
from folioworks.session import durable, scratch
from folioworks.settings import Ages, ArchiveLimits
from folioworks.sources.objects import filesystem

EPOCH_US = 1_704_067_200_000_000          # 2024-01-01
HOUR_US = 3_600_000_000
BLOCK_DOCS = 200
ENTRY_LIMITS = ArchiveLimits(max_entries=10, max_total_bytes=400_000)
LIFECYCLE_AGES = Ages(stale_seconds=6 * 3600, reconcile_seconds=24 * 3600, abandon_seconds=24 * 3600, max_attempts=3)
AS_OF_US = EPOCH_US + 31 * 24 * HOUR_US
ENTRY_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def described(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with labels, titles and hashes. The title is built on the greatest word of the whole text. Columns that
    a query doesn't use are not computed, and its filters on given columns reach the scan."""
    ext = F.when(F.col("lang") == "de", "pdf").otherwise("docx")
    word = F.array_max(F.split("text", r"\s+"))
    # Everything derived from the text comes before the join, so that no text is shuffled.
    named = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.expr(f"doc_id div {BLOCK_DOCS}").alias("block"), ext.alias("file_ext"),
        F.concat(F.lit("Guide_"), word, F.lit(" ("), F.col("source"), F.lit(")."), ext).alias("file_name"),
        F.octet_length("text").cast("bigint").alias("size_bytes"), F.sha2("text", 256).alias("content_hash"))
    named = named.withColumn("title", names.title_of(F.col("file_name"))).withColumn(
        "title_norm", names.title_norm(F.col("title")))
    return named.join(table(spark, sf, "labels"), "doc_id", "left")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a narrow written table, for queries that use it more than once: texts are read and hashed once."""
    return durable(described(spark, sf))


def candidates(docs: DataFrame) -> DataFrame:
    """Documents not (yet) approved: labelled ones are direct uploads, the rest are archive entries."""
    docs = docs.filter("quality IS NULL OR quality = 0")
    entry = F.col("quality").isNull()
    rejected = (F.coalesce("toxic", F.lit(0)) == 1) | (F.col("source") == "src11")
    named = docs.withColumn(
        "batch_id", F.concat_ws("-", "lang", F.col("block").cast("string"))).withColumn(
        "source_file_id", F.concat_ws("-", "lang", "source", F.when(entry, F.col("block").cast("string")).otherwise(
            F.concat(F.lit("d"), F.col("doc_id").cast("string"))))).withColumn(
        "entry_index", F.when(entry, F.col("doc_id") - F.col("block") * BLOCK_DOCS).cast("int"))
    return named.select(
        F.col("doc_id").cast("string").alias("staged_id"), F.col("lang").alias("organization_id"), "batch_id", "block",
        "source", "source_file_id",
        F.when(entry, F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_"), F.col("file_name")))
        .alias("source_entry_name"), "entry_index", "file_name", "file_ext", "size_bytes", "content_hash",
        F.when(~rejected, names.staging_key(F.col("lang"), F.col("batch_id"), F.col("source_file_id"),
                                            F.coalesce("entry_index", F.lit(0)), F.col("file_name"))).alias("s3_key"),
        F.when(rejected, "rejected").otherwise("processed").alias("status"),
        F.when(F.col("source") == "src11", M.ARCHIVE_REJECTED).when(rejected, M.FILE_DAMAGED).alias("reject_reason"),
        F.col("title").alias("proposed_title"), "title_norm")


def files(cands: DataFrame) -> DataFrame:
    """One row per source file of `cands`; its source decides how far it got."""
    rows = cands.groupBy("source_file_id").agg(
        F.first("organization_id").alias("organization_id"), F.first("batch_id").alias("batch_id"),
        F.first("block").alias("block"), F.first("source").alias("source"),
        F.max(F.col("entry_index").isNotNull()).alias("is_archive"), F.min("file_name").alias("_name"),
        F.sum("size_bytes").alias("size_bytes"), F.count(F.lit(1)).cast("int").alias("entries_total"),
        F.count_if(F.col("status") == "rejected").alias("_rejected"))
    source = F.col("source")
    status = (F.when(source.isin("src3", "src13"), "processing").when(source == "src17", "uploaded")
              .when(source == "src7", "error").when(source == "src11", "rejected")
              .when(F.col("_rejected") > 0, "partial").otherwise("processed"))
    message = (F.when((source == "src7") & (F.col("organization_id") == "es"), M.CANCELLED)
               .when((source == "src7") & (F.col("organization_id") == "en"), M.ATTEMPTS_SPENT)
               .when(source == "src11", M.DAMAGED))
    return rows.select(
        F.col("source_file_id").alias("file_id"), "organization_id", "batch_id", "source", "is_archive",
        F.when(F.col("is_archive"), F.concat_ws("-", "source", F.concat(F.col("block").cast("string"), F.lit(".zip"))))
        .otherwise(F.col("_name")).alias("file_name"), "size_bytes", status.alias("status"),
        message.alias("status_message"), "entries_total",
        F.when(status == "processing", F.lit(1)).otherwise(F.col("entries_total")).alias("entries_done"),
        (F.lit(EPOCH_US) + F.col("block") * HOUR_US).alias("created_us"))


def library(docs: DataFrame) -> DataFrame:
    """Approved documents, the first of each title per organization."""
    docs = docs.filter("quality = 1")
    kept = docs.groupBy("lang", "title_norm").agg(F.min_by(F.struct(
        "doc_id", "title", "file_name", "file_ext", "size_bytes", "content_hash", "block", "source", "n_chars",
        "toxic"), "doc_id").alias("d"))
    risk = (F.when(F.col("d.toxic") == 1, "HIGH").when(F.col("d.n_chars") > 8000, "MEDIUM")
            .when(F.col("d.n_chars") > 2000, "LOW").when(F.col("d.n_chars") > 300, "CONFIRMATORY"))
    return kept.select(
        F.concat(F.lit("lib-"), F.col("d.doc_id").cast("string")).alias("document_id"),
        F.col("lang").alias("organization_id"), "d.title", "title_norm", "d.file_name",
        names.file_name_norm(F.col("d.file_name")).alias("file_name_norm"), "d.file_ext", "d.size_bytes",
        "d.content_hash", F.concat_ws("-", "lang", "d.source", F.col("d.block").cast("string")).alias("source_file_id"),
        F.when(F.col("d.toxic") == 1, "archived").otherwise("active").alias("status"), risk.alias("highest_risk"),
        F.expr("d.n_chars div 1000").alias("open_findings"),
        (F.lit(EPOCH_US - 720 * HOUR_US) + F.col("d.block") * HOUR_US).alias("added_us"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Archive index at scale: one archive per order, ordered within it by the full row (ENTRY_ORDER)."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    ext = (F.when(supp % 10 == 0, "txt").when(supp % 10 == 1, "").when(supp % 10 == 2, "pdf").otherwise("docx"))
    line = F.col("l_linenumber")
    folder = (F.when(part % 97 == 0, "../").when(line == 1, "a/").when(line == 2, "a/b/")
              .when((line == 3) & (supp % 2 == 0), "__MACOSX/").otherwise(""))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("archive"), *ENTRY_ORDER,
        F.concat(folder, F.when(part % 40 == 1, ".").otherwise(""), F.lit("p"), (part % 50).cast("string"),
                 F.when(ext == "", "").otherwise("."), ext).alias("name"),
        F.floor("l_extendedprice").cast("bigint").alias("size"),
        F.floor(F.col("l_extendedprice") / F.when(part % 89 == 0, 250).otherwise(4)).cast("bigint").alias("csize"),
        F.when((part + supp) % 83 == 0, 1).otherwise(0).alias("flags"), (part % 61 == 0).alias("crc_error"),
        F.when(F.col("l_quantity") == 7, "unknown").otherwise(ext).alias("detected"),
        F.lit(None).cast("string").alias("detected_reason"))


EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table."""
    return table(spark, sf, "events")


def event_stream(spark: SparkSession, sf: str, parts: int = 4, part_rows: int = 1_000_000) -> DataFrame:
    """The events table as a stream of files in the order of their time, a trigger for each: `parts`, or more of `part_rows`
    rows where the table is large."""
    events, path = table(spark, sf, "events"), scratch(spark, "events")
    parts = max(parts, -(-events.count() // part_rows))
    second = F.col("ts").cast("timestamp").cast("bigint")
    cuts = events.select(second.alias("s")).approxQuantile("s", [k / parts for k in range(1, parts)], 0.001)
    number = sum((F.when(second > cut, 1).otherwise(0) for cut in sorted(set(cuts))), F.lit(0))
    for part in range(len(set(cuts)) + 1):             # one after the other: the stream takes the oldest file first
        events.filter(number == part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def _events(raw: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    day = F.datediff(ts, F.lit("2024-01-01").cast("date"))
    return raw.select(
        ts.alias("ts"), F.unix_micros(ts).alias("ts_us"), F.col("event_id").alias("seq"), "user_id", "event_type",
        "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.floor(day / 3).cast("string")).alias("file_id"))


def lifecycle(raw: DataFrame) -> DataFrame:
    """Lifecycle events: a file per user and three days, two workers, each with its token."""
    k, kind = F.col("k"), F.col("event_type")
    progress = (kind == "click") & (k >= 50)
    return _events(raw).select(
        "file_id", "ts", "ts_us", "seq",
        F.when(kind == "signup", F.when(k < 5, "cancel").when(k < 15, "uploading").otherwise("confirm"))
        .when(kind == "view", "claim").when(progress, "progress").when(kind == "click", "heartbeat")
        .when(kind == "purchase", "finish").otherwise("release").alias("kind"),
        F.when(kind != "signup", F.concat(F.lit("w"), (k % 2).cast("string"))).alias("token"),
        F.when(kind == "purchase", F.when(k < 60, "processed").when(k < 70, "partial").when(k < 85, "rejected")
               .otherwise("error")).alias("status"),
        F.when((kind == "purchase") & (k >= 70), F.concat(F.lit("reason "), k.cast("string"))).alias("message"),
        F.when(progress, F.lit(500)).alias("entries_total"),
        F.when(progress, F.floor("value").cast("int")).alias("entries_done"),
        F.when(progress & (k >= 75), F.lit("zip")).alias("detected_type"))


def lifecycle_files(states: DataFrame) -> DataFrame:
    """Folded lifecycle rows dressed as upload files."""
    user = F.split("file_id", "-")[0].cast("bigint")
    return states.withColumn("organization_id", F.concat(F.lit("org-"), F.expr(
        "cast(split(file_id, '-')[0] as bigint) div 50").cast("string"))).withColumn(
        "batch_id", F.concat_ws("/", "organization_id", F.split("file_id", "-")[1])).withColumn(
        "file_name", F.concat(F.lit("scan "), user.cast("string"), F.lit(".docx"))).withColumn(
        "size_bytes", F.col("events") * 1000)


def log_lines(raw: DataFrame) -> DataFrame:
    """JSON log lines of the same events (column `value`); some lines are plain notices."""
    k, kind = F.col("k"), F.col("event_type")
    sweep = (kind == "error") & (k >= 50)
    event = (F.when(kind == "signup", "enqueued")
             .when(kind == "view", F.when(k < 60, "claim_ok").otherwise("claim_lost"))
             .when(kind == "click", F.when(k < 80, "entry_staged").otherwise("entry_rejected"))
             .when(kind == "purchase", "finished").when(k < 50, "retrying")
             .when(k < 75, "stale_sweep").otherwise("reconcile_sweep"))
    later = F.concat_ws("-", (F.col("user_id") + 1).cast("string"), F.split("file_id", "-")[1])
    attempt = F.when(~sweep & (kind != "signup"), k % 3 + 1)
    line = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
        F.when(kind == "error", "warning").otherwise("info").alias("level"), event.alias("event"),
        F.when(sweep, "workers.sweepers").otherwise("workers.tasks").alias("logger"), (k % 2).alias("pid"),
        F.when(~sweep, F.col("file_id")).alias("file_id"),
        F.when(kind == "view", F.concat(F.lit("t"), F.floor("value").cast("string"))).alias("task_id"),
        attempt.alias("attempt"), F.when(kind == "click", F.floor("value").cast("int")).alias("entry_index"),
        F.when((kind == "error") & ~sweep, F.when(k < 40, F.pow(F.lit(2), k % 3 + 1) * 5).otherwise(7).cast("int"))
        .alias("countdown"),
        F.when(sweep, F.array("file_id", later)).alias("file_ids"),
        F.when(sweep & (k < 75), k % 4).alias("reset"), F.when(sweep & (k >= 75), k % 5).alias("requeued"),
        F.when(sweep, k % 3).alias("errored"), F.when(sweep, k % 2).alias("enqueue_failed"))
    return _events(raw).select(F.when((k == 99) & (kind == "click"), "worker: Warm shutdown").otherwise(
        F.to_json(line)).alias("value"))


def candidate_writes(raw: DataFrame) -> DataFrame:
    """Candidate upserts in order: purchases write the direct upload, other events one of six entries."""
    k, direct = F.col("k"), F.col("event_type") == "purchase"
    name = F.concat(F.lit("entry-"), (k % 6).cast("string"), F.lit(".docx"))
    good = F.col("event_type") != "error"
    return _events(raw).select(
        F.col("file_id").alias("source_file_id"), F.when(~direct, name).alias("source_entry_name"),
        F.lit(None).cast("int").alias("video_script_seq"),
        F.when(~direct, k % 6 + F.when(k > 90, 1).otherwise(0)).cast("int").alias("entry_index"),
        F.when(direct, F.lit("scan.docx")).otherwise(name).alias("file_name"), F.lit("docx").alias("file_ext"),
        F.floor("value").cast("bigint").alias("size_bytes"),
        F.when(k != 13, F.sha2(F.col("seq").cast("string"), 256)).alias("content_hash"),
        F.when(good | (k == 14), F.concat(F.lit("staging/"), F.col("file_id"), F.lit("/"), k.cast("string")))
        .alias("s3_key"),
        F.when(good, "processed").otherwise("rejected").alias("status"),
        F.when(~good & (k != 15), F.when(k % 3 == 0, F.concat(F.lit(M.FILE_DAMAGED), F.repeat(F.lit(" x"), 300)))
               .otherwise(M.FILE_DAMAGED)).alias("reject_reason"),
        "seq", "ts_us", F.concat(F.lit("w"), (k % 2).cast("string")).alias("token"))


def failures(raw: DataFrame) -> DataFrame:
    """Failed attempts: one per event, with where it failed, the code and the HTTP status."""
    k = F.col("k")
    return _events(raw).select(
        "seq", "file_id", (k % 4 + 1).alias("attempt"),
        F.when(k < 50, "storage").when(k < 75, "api").when(k < 85, "transport").when(k < 95, "content")
        .otherwise("code").alias("origin"),
        F.when(k < 10, "NoSuchKey").when(k < 20, "AccessDenied").when(k < 30, "SlowDown").when(k < 40, "InternalError")
        .when(k < 50, "Malformed").when(k < 60, "claim_superseded").when(k < 75, "bad_request").alias("code"),
        F.when(k < 10, 404).when(k < 20, 403).when(k < 30, 400).when(k < 40, 500).when(k < 45, 503).when(k < 50, 400)
        .when(k < 60, 409).when(k < 65, 401).when(k < 70, 500).when(k < 75, 422).alias("http_status"),
        F.concat(F.lit("failure "), k.cast("string")).alias("detail"))


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as uploads: customer = batch and name, price = size, status F = already in the library."""
    ext = (F.when(F.col("o_orderpriority") == "1-URGENT", ".docx").when(F.col("o_orderpriority") == "2-HIGH", ".PDF")
           .when(F.col("o_orderpriority") == "3-MEDIUM", ".zip").when(F.col("o_orderpriority") == "5-LOW", ".txt")
           .otherwise(""))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_orderkey").alias("position"),
        F.lit("org").alias("organization_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("batch_id"),
        F.concat(F.lit("Order "), F.expr("o_custkey div 10").cast("string"), ext).alias("file_name"),
        (F.floor(F.col("o_totalprice") / 10000) * 120_000_000).cast("bigint").alias("size_bytes"),
        F.col("o_orderstatus").alias("phase"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("modified_us"))


def upload_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as batches seen so far (furniture ones are not); the market segment decides which are closed."""
    segment = F.col("c_mktsegment")
    return table(spark, sf, "customer").filter(segment != "FURNITURE").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("batch_id"), F.lit("org").alias("organization_id"),
        F.lit(0).cast("bigint").alias("created_by"),
        F.when(segment == "BUILDING", "committed").when(segment == "MACHINERY", "abandoned").otherwise("in_progress")
        .alias("status"))


def upload_library(spark: SparkSession, sf: str) -> DataFrame:
    """The uploads that are in the library already."""
    return uploads(spark, sf).filter("phase = 'F'").select(
        F.concat(F.lit("doc-"), F.col("request_id")).alias("document_id"), "organization_id",
        names.file_name_norm(F.col("file_name")).alias("file_name_norm"), "size_bytes")


def raw_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names as users type them: page addresses and part names with assorted endings."""
    ending = (F.when(F.col("p_type") == "ECONOMY", ".DOCX").when(F.col("p_type") == "SMALL", ".tar.gz")
              .when(F.col("p_type") == "PROMO", " .pdf ").when(F.col("p_type") == "LARGE", ".htm")
              .when(F.col("p_type") == "MEDIUM", ".").otherwise(""))
    start = F.when(F.col("p_type") == "STANDARD", ".").otherwise("")
    return table(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"),
                                            F.col("url").alias("name")).unionByName(
        table(spark, sf, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"),
                                        F.concat(start, "p_name", ending).alias("name")))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Part texts with video sections; promotional parts have two, small ones none."""
    one = F.concat(F.lit("Video "), F.col("p_size").cast("string"), F.lit(" - "), F.col("p_name"), F.lit(": body"))
    two = F.concat(one, F.lit("\nVIDEO "), (F.col("p_size") + 1).cast("string"), F.lit("-  part two : end"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("section_doc"), F.col("p_brand").alias("result_id"), "p_type",
        F.when(F.col("p_type") == "PROMO", two).when(F.col("p_type") == "SMALL", F.col("p_name")).otherwise(one)
        .alias("text"))


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """An object manifest with keys under incoming/ and staging/, from the uploads."""
    rows = uploads(spark, sf)
    prefix = F.when(F.col("phase") == "F", "staging").when(F.col("phase") == "O", "incoming").otherwise("other")
    return rows.select(
        F.concat_ws("/", prefix, "organization_id", "batch_id", F.concat_ws("_", "request_id", "file_name"))
        .alias("key"), F.col("size_bytes").alias("length"), "modified_us", (F.col("size_bytes") > 0).alias("complete"))


def staged_objects(cands: DataFrame) -> DataFrame:
    """Staging keys found in the store: every candidate's, but none under half-done sources, plus older copies."""
    key = names.staging_key(F.col("organization_id"), F.col("batch_id"), F.col("source_file_id"),
                            F.coalesce("entry_index", F.lit(0)), F.col("file_name"))
    return cands.filter("source <> 'src5'").select(key.alias("key"))


def _pack_docx(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        stamp = (1980, 1, 1, 0, 0, 0)
        body = text.replace("&", "&amp;").replace("<", "&lt;")
        box.writestr(zipfile.ZipInfo(M.CONTENT_TYPES_PART, stamp), f'<Types><Override ContentType="{M.WORDML_TYPE}"/></Types>')
        box.writestr(zipfile.ZipInfo(M.DOCUMENT_PART, stamp), f"<document>{body}</document>")
    return out.getvalue()


def _pack_zip(name: str, text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        box.writestr("docs/", b"")
        box.writestr(f"docs/{name}.docx", _pack_docx(text))
        box.writestr(f"docs/{name}.pdf", M.PDF_MAGIC + text.encode())
        box.writestr(f"{name}.txt", text.encode())
    return out.getvalue()


@F.pandas_udf(BinaryType())
def _pack(kind: pd.Series, name: pd.Series, text: pd.Series) -> pd.Series:
    forms = {"docx": lambda n, t: _pack_docx(t), "zip": _pack_zip,
             "corrupt": lambda n, t: _pack_zip(n, t)[:-30] + b"\0" * 8, "pdf": lambda n, t: M.PDF_MAGIC + t.encode(),
             "unknown": lambda n, t: t.encode()}
    return pd.Series([forms[k](n, t) for k, n, t in zip(kind, name, text)], dtype=object)


def packed(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    """Every document as file bytes (path, lang, kind, content), in a form that follows its language, or all in one."""
    docs = table(spark, sf, "documents")
    form = (F.when(F.col("toxic") == 1, "corrupt").when(F.col("lang") == "en", "docx").when(F.col("lang") == "fr", "pdf")
            .when(F.col("lang") == "de", "zip").otherwise("unknown"))
    if kind is None:
        docs = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    chosen = F.lit(kind) if kind else form
    # Packing costs far more than moving the text, so it is spread over all cores first.
    docs = docs.repartition("doc_id")
    return docs.select(name.alias("path"), "lang", chosen.alias("kind"), _pack(chosen, name, F.col("text")).alias("content"))


def packed_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """The packed documents as uploads: German and Spanish ones are named .zip, the rest .docx."""
    ext = F.when(F.col("lang").isin("de", "es"), "zip").otherwise("docx")
    return durable(packed(spark, sf).select(
        F.col("path").alias("file_id"), F.col("lang").alias("organization_id"), F.lit("b1").alias("batch_id"),
        F.concat("path", F.lit("."), ext).alias("file_name"), ext.alias("file_ext"), "path", "content"))


BUNDLE = 32                 # documents in one stored object
STORED = "file_id string, organization_id string, batch_id string, file_name string, file_ext string, path string, attempt int, kind int"


def _pack_bundle(documents: list[tuple[int, str]]) -> bytes:
    """An archive of documents as they are, one PDF each."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as box:
        for number, text in documents:
            box.writestr(zipfile.ZipInfo(f"docs/doc{number}.pdf", (1980, 1, 1, 0, 0, 0)), M.PDF_MAGIC + (text or "").encode())
    return out.getvalue()


def stored_uploads(spark: SparkSession, sf: str, root: str | None = None, keyed: bool = False) -> DataFrame:
    """The documents as objects under `root`, in the shared folder, written by tasks: uploads with the `path` of an archive of
    32 documents each, numbered b. By b modulo 8: 0 no object is there, 1 a folder stands in its place, 2 the archive is damaged,
    3 the object is one PDF and named so, else a sound archive. `attempt` goes from 1 to 3. `keyed`: under the key of an
    incoming file instead of its name."""
    root = root or scratch(spark, "objects")
    bundle = F.floor(F.col("doc_id") / BUNDLE)
    bundles = table(spark, sf, "documents").groupBy(bundle.alias("b")).agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("documents"))

    def write(batches):
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):           # one object's documents in Python at a time
                number, documents = batch.column("b")[at].as_py(), batch.column("documents")[at].as_py()
                kind, documents = number % 8, [(d["doc_id"], d["text"]) for d in documents]
                ext = "pdf" if kind == 3 else "zip"
                key = f"incoming/org{number % 7}/b1/box{number}_box{number}.{ext}" if keyed else f"box{number}.{ext}"
                store, path = filesystem(f"{root}/{key}")
                data = M.PDF_MAGIC + (documents[0][1] or "").encode() if kind == 3 else _pack_bundle(documents)
                store.create_dir(path if kind == 1 else path.rsplit("/", 1)[0], recursive=True)
                if kind > 1:
                    with store.open_output_stream(path) as out:
                        out.write(data[:-30] + b"\0" * 8 if kind == 2 else data)
                rows.append((f"box{number}", f"org{number % 7}", "b1", f"box{number}.{ext}", ext, f"{root}/{key}",
                             1 + number // 8 % 3, kind))
            if not rows:
                continue
            names_ = [part.split()[0] for part in STORED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(column), pa.int32() if name in ("attempt", "kind") else pa.string())
                                              for name, column in zip(names_, zip(*rows, strict=True), strict=True)], names_)

    return durable(bundles.mapInArrow(write, STORED))
