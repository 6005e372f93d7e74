"""Archives and file types: index rows, streamed extraction and detection by content.

Containers are opened inside tasks, by path or from an inline `content` column. Format errors are data, and so is an object
that is missing, refused or cannot be read for now (`failure`): it ends or delays one file, not the job. Errors of the
machine itself (a full disk, no memory) propagate, so the task is retried.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.functions.text import mismatch_reason
from folioworks.operators.archives import container_reason
from folioworks.settings import ARCHIVE_LIMITS, ArchiveLimits
from folioworks.session import durable, exists, scratch
from folioworks.sources.objects import BLOCK, FAILURE, FAILURE_TYPE, failure_of, open_object, spread

# The last one stands for a place before the beginning of a file too short to be an archive.
FORMAT_ERRORS = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, EOFError, NotImplementedError, pa.ArrowInvalid)
HEAD_OF_PART = 64 * 1024     # of the content-types part, where the document type is declared
RUN_LENGTH = 64
MOST_WAVES = 8
CHANGED = {"origin": "storage_transport", "code": "ObjectChanged", "http_status": None, "detail": "the object changed while it was read"}
INDEX_SCHEMA = f"archive string, entry_pos int, name string, size bigint, csize bigint, flags int, error string, failure {FAILURE}"
LOOK = ("struct<opens: boolean, damage: string, n_entries: bigint, total_bytes: bigint, "
        "entries: array<struct<name: string, size: bigint, csize: bigint, flags: int>>, declares_wordml: boolean>")
_ENTRY = pa.struct([("name", pa.string()), ("size", pa.int64()), ("csize", pa.int64()), ("flags", pa.int32())])
LOOK_TYPE = pa.struct([("opens", pa.bool_()), ("damage", pa.string()), ("n_entries", pa.int64()), ("total_bytes", pa.int64()),
                       ("entries", pa.list_(_ENTRY)), ("declares_wordml", pa.bool_())])

INDEX_FIELDS = pa.schema([("archive", pa.string()), ("entry_pos", pa.int32()), ("name", pa.string()),
                          ("size", pa.int64()), ("csize", pa.int64()), ("flags", pa.int32()), ("error", pa.string()), ("failure", FAILURE_TYPE)])
EXTRACT_FIELDS = pa.schema([("archive", pa.string()), ("entry_pos", pa.int32()), ("sha256", pa.string()),
                            ("bytes_read", pa.int64()), ("crc_error", pa.bool_()), ("error", pa.string()),
                            ("head", pa.binary()), ("look", LOOK_TYPE), ("failure", FAILURE_TYPE)])
EXTRACT_SCHEMA = ("archive string, entry_pos int, sha256 string, bytes_read bigint, crc_error boolean, error string, "
                  f"head binary, look {LOOK}, failure {FAILURE}")


def _record_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size, whatever the size of the archives they come from."""
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(list(values), type=field.type) for values, field in
                                          zip(zip(*part), schema)], schema=schema)


def _source(path: str, content: bytes | None):
    return io.BytesIO(content) if content is not None else open_object(path)


def _told(problem: Exception) -> str:
    """The text of a format error."""
    return "File is not a zip file" if isinstance(problem, pa.ArrowInvalid) else str(problem) or type(problem).__name__


def files_of(box: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Index entries that are files."""
    return [e for e in box.infolist() if not e.is_dir()]


def look_inside(source, limits: ArchiveLimits) -> dict:
    """What a zip's index says, as data; rules are applied to it in Spark.

    A container over the entry limit is refused on its count alone, so its entries are not listed.
    """
    try:
        box = zipfile.ZipFile(source)
    except FORMAT_ERRORS as problem:
        return {"opens": False, "damage": _told(problem)}
    with box:
        files, damage, wordml = files_of(box), None, False
        if {M.CONTENT_TYPES_PART, M.DOCUMENT_PART}.issubset(box.namelist()):
            try:
                with box.open(M.CONTENT_TYPES_PART) as part:
                    wordml = part.read(HEAD_OF_PART).find(M.WORDML_TYPE.encode()) >= 0
            except (*FORMAT_ERRORS, RuntimeError) as problem:
                damage = _told(problem)
    listed = files if len(files) <= limits.max_entries else []
    return {"opens": True, "damage": damage, "n_entries": len(files), "total_bytes": sum(e.file_size for e in files),
            "entries": [{"name": e.filename, "size": e.file_size, "csize": e.compress_size, "flags": e.flag_bits}
                        for e in listed], "declares_wordml": wordml}


def magic_type(content: Column) -> Column:
    """Type by leading bytes alone, natively; zips still need a look inside."""
    return (F.when(F.substring(content, 1, 5) == F.lit(bytearray(M.PDF_MAGIC)), "pdf")
            .when(F.substring(content, 1, 4) == F.lit(bytearray(M.ZIP_MAGIC)), "zip").otherwise("unknown"))


def judged(head: Column, look: Column, limits: ArchiveLimits = ARCHIVE_LIMITS) -> Column:
    """struct<type, reason> from leading bytes and, for zips, the look inside: docx, zip, pdf, unknown, unsafe, corrupt.

    The guard is the one that judges outer archives, applied to the listed entries.
    """
    magic, zipped = magic_type(head), magic_type(head) == "zip"
    refused = container_reason(look, limits)
    kind = (F.when(~zipped, magic).when(~look["opens"], "corrupt").when(refused.isNotNull(), "unsafe")
            .when(look["damage"].isNotNull(), "corrupt").when(look["declares_wordml"], "docx").otherwise("zip"))
    why = F.when(zipped, F.when(~look["opens"], look["damage"]).otherwise(F.coalesce(refused, look["damage"])))
    return F.struct(kind.alias("type"), why.cast("string").alias("reason"))


def detect_content(objects: DataFrame, into: str, limits: ArchiveLimits = ARCHIVE_LIMITS) -> DataFrame:
    """Add struct<type, reason> of the inline `content` column; only zip bytes cross to Python."""
    @F.arrow_udf(LOOK)
    def look(values: pa.Array) -> pa.Array:
        return pa.array([look_inside(io.BytesIO(v.as_py()), limits) if v.is_valid else None for v in values], LOOK_TYPE)

    zipped = F.when(magic_type(F.col("content")) == "zip", F.col("content"))
    return (objects.withColumn("_look", look(zipped))
            .withColumn(into, judged(F.substring("content", 1, 8), F.col("_look"), limits)).drop("_look"))


def detect_objects(objects: DataFrame, limits: ArchiveLimits = ARCHIVE_LIMITS) -> DataFrame:
    """(path, detected, detected_reason, failure) of objects opened by path; detected is null where there is a failure."""
    def look(path: str) -> tuple[bytes | None, dict | None, dict | None]:
        try:
            with open_object(path) as source:
                head = source.read(8)
                source.seek(0)
                return head, look_inside(source, limits) if head.startswith(M.ZIP_MAGIC) else None, None
        except OSError as problem:
            return None, None, failure_of(problem)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(map(look, batch.column("path").to_pylist()))
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate((pa.binary(), LOOK_TYPE, FAILURE_TYPE))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], ["path", "head", "look", "failure"])

    seen = objects.select("path").mapInArrow(run, f"path string, head binary, look {LOOK}, failure {FAILURE}")
    found = seen.select("path", F.when(F.col("failure").isNull(), judged(F.col("head"), F.col("look"), limits)).alias("d"), "failure")
    return found.select("path", F.col("d.type").alias("detected"), F.col("d.reason").alias("detected_reason"), "failure")


def document_outcome(declared: Column, detected: Column, reason: Column) -> tuple[Column, Column]:
    """(status, reason) of a single document: rejected when the bytes are not what the name says."""
    wrong = detected != declared
    return (F.when(wrong, "rejected").otherwise("processed"),
            F.when(wrong, mismatch_reason(declared, detected, reason)))


def zip_index(archives: DataFrame) -> DataFrame:
    """Index rows of each archive, in directory order, folders left out. A damaged archive yields one row with
    `error`, one that cannot be read a row with `failure`. `archives`: path and, where bytes are inline, content."""
    inline = "content" in archives.columns

    def index(row) -> Iterator[tuple]:
        try:
            with _source(row.path, row.content if inline else None) as source, zipfile.ZipFile(source) as box:
                files = files_of(box)
            for at, e in enumerate(files):
                yield row.path, at, e.filename, e.file_size, e.compress_size, e.flag_bits, None, None
        except FORMAT_ERRORS:
            yield row.path, None, None, None, None, None, M.DAMAGED, None
        except OSError as problem:
            yield row.path, None, None, None, None, None, None, failure_of(problem)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (entry for row in batch.to_pandas().itertuples(index=False) for entry in index(row))
            yield from _record_batches(rows, INDEX_FIELDS)

    if not inline:
        return spread(archives.select("path"), "path").mapInArrow(run, INDEX_SCHEMA)
    return archives.select("path", "content").mapInArrow(run, INDEX_SCHEMA)


def zip_extract(entries: DataFrame | None, archives: DataFrame, limits: ArchiveLimits = ARCHIVE_LIMITS,
                tasks: int | None = None) -> DataFrame:
    """Read each entry once, in blocks: hash, length, index agreement, and the type of what is inside.

    The unit of work is a run of up to 64 neighbouring entries, so a huge archive is shared out and still not
    reopened for every entry; nothing is copied to disk. `entries`: archive,
    entry_pos. `archives`: path and, where bytes are inline, content, which then travels once per run. Without
    `entries`, all entries of inline archives are read where the bytes lie; damaged archives yield nothing. A run whose
    object cannot be read, or no longer is what its index said, ends in a row without entry_pos and with `failure`.
    """
    inline = "content" in archives.columns
    if entries is None:
        runs = archives.select(F.col("path").alias("archive"), "content",
                               F.lit(None).cast("array<int>").alias("positions"))
    else:
        runs = entries.groupBy("archive", F.floor(F.col("entry_pos") / RUN_LENGTH).alias("_run")).agg(
            F.sort_array(F.collect_list("entry_pos")).alias("positions"))
        if inline:
            runs = runs.join(archives.select(F.col("path").alias("archive"), "content"), "archive")
        runs = spread(runs, "archive", "_run", tasks=tasks).drop("_run")

    def read(box: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple:
        """One pass for hash, length and agreement with the index; a zip inside is looked into through the archive."""
        digest, length, head = hashlib.sha256(), 0, b""
        try:
            with box.open(info) as part:
                for block in iter(partial(part.read, BLOCK), b""):
                    digest.update(block)
                    length, head = length + len(block), head or block[:8]
            if head.startswith(M.ZIP_MAGIC):
                with box.open(info) as part:            # seekable: only what the look needs is read again
                    return digest.hexdigest(), length, False, None, head, look_inside(part, limits), None
        except (*FORMAT_ERRORS, RuntimeError) as problem:
            # zipfile reports a password-protected entry as a bare RuntimeError.
            text = _told(problem)
            return None, length, True, f"'{info.filename}'{M.INDEX_DISAGREES}{text})", None, None, None
        return digest.hexdigest(), length, False, None, head, None, None

    def extract(run) -> Iterator[tuple]:
        failure = None
        try:
            with _source(run.archive, run.content if inline else None) as source, zipfile.ZipFile(source) as box:
                files = files_of(box)
                for at in range(len(files)) if run.positions is None else run.positions:
                    if at >= len(files):
                        failure = CHANGED
                        break
                    yield run.archive, int(at), *read(box, files[at])
        except FORMAT_ERRORS:
            failure = None if run.positions is None else CHANGED        # it was readable when it was indexed
        except OSError as problem:
            failure = failure_of(problem)
        if failure:
            yield run.archive, None, None, None, None, None, None, None, failure

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (row for run in batch.to_pandas().itertuples(index=False) for row in extract(run))
            yield from _record_batches(rows, EXTRACT_FIELDS)

    seen = runs.mapInArrow(work, EXTRACT_SCHEMA)
    kind = F.when(F.col("head").isNotNull(), judged(F.col("head"), F.col("look"), limits))
    return seen.withColumn("_d", kind).select(
        "archive", "entry_pos", "sha256", "bytes_read", "crc_error", "error", F.col("_d.type").alias("detected"),
        F.col("_d.reason").alias("detected_reason"), "failure")


PROGRESS = ("archive string, entry_pos int, sha256 string, bytes_read bigint, crc_error boolean, error string, detected string, "
            f"detected_reason string, failure {FAILURE}, run string, ok boolean")


def read_progress(spark: SparkSession, progress: str) -> DataFrame:
    """What earlier runs have read of archives' entries, and their failures (ok = false), by run."""
    return spark.read.schema(PROGRESS).parquet(progress) if exists(spark, progress) else spark.createDataFrame([], PROGRESS)


def extract_resumable(entries: DataFrame, archives: DataFrame, progress: str, limits: ArchiveLimits = ARCHIVE_LIMITS,
                      waves: int | None = None, stop_after: int | None = None) -> DataFrame:
    """`zip_extract` in waves, each of which commits what it has read under `progress`: a run that ends early, for whatever
    reason, has left its waves there, and the next one reads only the entries that are missing.

    A wave is a share of all runs of entries, so every wave works on all archives and keeps all tasks busy; there are up to
    `MOST_WAVES`, fewer where they would be too small for that. Only entries that were read count as done; failures
    belong to the run that met them. `stop_after` ends a run early on purpose. Returns the rows of the entries from all
    runs, and the failures of this one.
    """
    spark, run = entries.sparkSession, scratch(entries.sparkSession, "run").rsplit("-", 1)[1]
    done = read_progress(spark, progress).filter("ok").select("archive", "entry_pos")
    todo = durable(entries.select("archive", "entry_pos").join(done, ["archive", "entry_pos"], "left_anti"))
    number = F.floor(F.col("entry_pos") / RUN_LENGTH)
    if waves is None:
        runs = todo.select("archive", number).distinct().count()
        waves = max(1, min(MOST_WAVES, runs // (4 * spark.sparkContext.defaultParallelism)))
    wave = F.pmod(F.xxhash64("archive", number), F.lit(waves))
    for number in range(waves if stop_after is None else stop_after):
        found = zip_extract(todo.filter(wave == number), archives, limits)
        found.select("*", F.lit(run).alias("run"), F.col("failure").isNull().alias("ok")).write.partitionBy(
            "run", "ok").mode("append").parquet(progress)
    return read_progress(spark, progress).filter(F.col("ok") | (F.col("run") == run)).drop("run", "ok")
