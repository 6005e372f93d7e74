"""Objects: manifests, hashes and file access inside tasks."""

from __future__ import annotations

import errno
import fnmatch
import hashlib
import re
import shutil
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.session import durable

BLOCK = 64 * 1024
BUFFER = 8 * 1024 * 1024
# What went wrong with one object's reading or writing, as data: `classify_failures` takes it from here.
FAILURE = "struct<origin: string, code: string, http_status: int, detail: string>"
FAILURE_TYPE = pa.struct([("origin", pa.string()), ("code", pa.string()), ("http_status", pa.int32()), ("detail", pa.string())])
OWN_MACHINE = (errno.ENOSPC, errno.EMFILE, errno.ENFILE, errno.ENOMEM, errno.EDQUOT)


def manifest(spark: SparkSession, prefix: str, pattern: str | None = None) -> DataFrame:
    """Objects under a prefix: path, length, modified. `content` is pruned, so no byte is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(prefix).select("path", "length", F.col("modificationTime").alias("modified"))


LISTED = "path string, length bigint, modified timestamp, folder boolean"
PYTHON_STORES = ("file", "s3", "gs", "gcs", "hdfs")


def list_objects(spark: SparkSession, prefix: str, pattern: str | None = None) -> DataFrame:
    """The manifest again, listed by tasks: the folders of one level are rows, each is listed by a task, and the folders found are
    the next level. Nothing is held in the driver, whatever the number of objects; the result is a written table.

    `pattern` is matched against an object's name. A store that only Spark reaches is listed by Spark. A prefix that is one
    object gives that object; one that is not there is an error.
    """
    scheme = prefix.split(":", 1)[0] if ":" in prefix.split("/", 1)[0] else "file"
    if scheme not in PYTHON_STORES:
        return manifest(spark, prefix, pattern)
    store, start = filesystem(prefix)
    if store.get_file_info(start).type == fs.FileType.File:
        return manifest(spark, prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(prefix)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = store.get_file_info(fs.FileSelector(folder))
                for at in range(0, len(found), LOT):
                    part = found[at:at + LOT]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f.path for f in part], pa.string()), pa.array([f.size for f in part], pa.int64()),
                         pa.array([(f.mtime_ns or 0) // 1000 for f in part], pa.timestamp("us", "UTC")),
                         pa.array([f.type == fs.FileType.Directory for f in part])], ["path", "length", "modified", "folder"])

    level, files = spark.createDataFrame([(start,)], "path string"), []
    while True:
        found = durable(spread(level, "path").mapInArrow(run, LISTED))
        files.append(found.filter("NOT folder"))
        level = found.filter("folder").select("path")
        if level.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, files).withColumn("_name", F.element_at(F.split("path", "/"), -1))
    if pattern:
        rows = rows.filter(F.col("_name").rlike(fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$")))
    head = "file:" if scheme == "file" else prefix[:prefix.index(start)]
    return rows.select(F.concat(F.lit(head), "path").alias("path"), "length", "modified")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of an address; Spark writes local ones as file:/…"""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def open_object(path: str):
    """Seekable reader of an object, used by path inside a task (a BINARY value ends at 2 GiB)."""
    store, plain = filesystem(path)
    return store.open_input_file(plain)


def failure_of(problem: OSError) -> dict:
    """The failure that an object's OSError stands for. Trouble of the task's own machine is raised again instead, so that
    the task is repeated elsewhere.

    A store's answer carries its own code and status; a missing or refused file of a mounted system has the code a store
    would give; anything else (an interrupted connection, a folder in the object's place) is trouble on the way.
    """
    if problem.errno in OWN_MACHINE:
        raise problem
    named = re.search(r"AWS Error ([A-Z_]+)", str(problem))
    http = re.search(r"HTTP (?:status|response code)[ :]*(\d{3})", str(problem))
    status = int(http[1]) if http else None
    if isinstance(problem, FileNotFoundError):
        origin, code, status = "storage", "NoSuchKey", status or 404
    elif isinstance(problem, PermissionError):
        origin, code, status = "storage", "AccessDenied", status or 403
    elif named and named[1] != "NETWORK_CONNECTION":
        origin, code = "storage", "".join(part.title() for part in named[1].split("_"))
    elif http:
        origin, code = "storage", http[1]
    else:
        origin, code = "storage_transport", errno.errorcode.get(problem.errno, type(problem).__name__)
    return {"origin": origin, "code": code, "http_status": status, "detail": f"reading failed ({code})"}


def hash_objects(objects: DataFrame) -> DataFrame:
    """SHA-256 and byte count of each `path`, streamed through a buffer: any object size, constant memory, one ranged
    request of a store for many blocks. An object that cannot be read has a `failure` instead."""
    def digest(path: str) -> tuple[str | None, int | None, dict | None]:
        seen, total = hashlib.sha256(), 0
        try:
            store, plain = filesystem(path)
            with store.open_input_stream(plain, buffer_size=BUFFER) as source:
                while block := source.read(BLOCK):
                    seen.update(block)
                    total += len(block)
        except OSError as problem:
            return None, None, failure_of(problem)
        return seen.hexdigest(), total, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(map(digest, batch.column("path").to_pylist()))
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), FAILURE_TYPE))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], ["path", "sha256", "bytes_read", "failure"])

    return objects.select("path").mapInArrow(run, f"path string, sha256 string, bytes_read bigint, failure {FAILURE}")


def spread(rows: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Rows over a fixed number of tasks. Rows that only name objects are tiny, and adaptive coalescing would put
    the reading of all those objects into a few tasks."""
    spark = rows.sparkSession
    tasks = tasks or max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, *keys)


def hash_content(objects: DataFrame) -> DataFrame:
    """SHA-256 of an inline `content` column, natively."""
    return objects.withColumn("sha256", F.sha2("content", 256))


PLAN_RESULT = f"op string, src string, dst string, outcome string, failure {FAILURE}"
LOT = 1000                  # operations of one lot
DONE, ALREADY, FAILED, HELD = "done", "already done", "failed", "held back"


def _copy(store: fs.FileSystem, base: str, src: str, dst: str) -> str:
    """Copy an object, under another name until it is whole; a whole one that is there already stays."""
    source, target = f"{base}/{src}", f"{base}/{dst}"
    have, found = store.get_file_info([source, target])
    if found.type == fs.FileType.File and (have.type == fs.FileType.NotFound or have.size == found.size):
        return ALREADY
    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
    with store.open_input_stream(source) as data, store.open_output_stream(f"{target}.part") as out:
        shutil.copyfileobj(data, out, BLOCK)
    store.move(f"{target}.part", target)
    return DONE


def _delete(store: fs.FileSystem, base: str, src: str) -> str:
    if store.get_file_info(f"{base}/{src}").type == fs.FileType.NotFound:
        return ALREADY
    store.delete_file(f"{base}/{src}")
    return DONE


def carry_out(operations: DataFrame, root: str) -> DataFrame:
    """PLAN_RESULT rows of (op, src, dst) under `root`, in lots of neighbouring keys: one row for each operation, with what
    went wrong where it failed. An operation that was carried out before is none again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(root)
        for batch in batches:
            for start in range(0, batch.num_rows, LOT):
                lot, outcomes, failures = batch.slice(start, LOT), [], []
                for row in lot.to_pylist():
                    try:
                        outcomes.append(_copy(store, base, row["src"], row["dst"]) if row["op"] == "copy" else _delete(store, base, row["src"]))
                        failures.append(None)
                    except OSError as problem:
                        outcomes.append(FAILED)
                        failures.append(failure_of(problem))
                yield pa.RecordBatch.from_arrays([*(lot.column(c) for c in ("op", "src", "dst")), pa.array(outcomes, pa.string()),
                                                  pa.array(failures, FAILURE_TYPE)], ["op", "src", "dst", "outcome", "failure"])

    # Every operation once: a repeated row would race with itself.
    rows = operations.select("op", "src", "dst").distinct()
    return durable(rows.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").mapInArrow(run, PLAN_RESULT))


def execute_plan(plan: DataFrame, root: str) -> DataFrame:
    """Carry out copies, then deletes, of (op, src, dst) under `root`; PLAN_RESULT with one row per distinct operation.

    An object whose copy failed is not deleted: that is held back until the plan runs again. So the plan may stop anywhere and be run
    again; failures can be classified and retried like those of reads. Empty plans give no rows.
    """
    copies = carry_out(plan.filter("op = 'copy'"), root)
    broken = copies.filter(F.col("outcome") == FAILED).select("src").distinct()
    deletes = plan.filter("op = 'delete'").select("op", "src", "dst").distinct()
    held = deletes.join(broken, "src", "left_semi").select(
        "op", "src", "dst", F.lit(HELD).alias("outcome"), F.lit(None).cast(FAILURE).alias("failure"))
    return copies.unionByName(held).unionByName(carry_out(deletes.join(broken, "src", "left_anti"), root))


def run_object_plan(plan: DataFrame, root: str) -> None:
    """`execute_plan`, for callers that want all or an error."""
    failed = execute_plan(plan, root).filter(F.col("outcome") == FAILED).select("op", "src", "failure.code").head(5)
    if failed:
        raise OSError(f"operations failed, among them {[tuple(r) for r in failed]}")
