"""Session settings the jobs rely on, and the two ways to cut lineage that survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Adaptive execution splits skewed join partitions even where that costs an extra shuffle downstream; session
# windows merge inside map tasks first, so a file with a third of all heartbeats ships one row per session. Batches that
# go to Python hold texts or bytes, so they are small. Where few of many wide rows find a partner, a Bloom filter of bounded
# size keeps the others out of the shuffle.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16MB",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "64MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "64MB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; a shared folder for checkpoints is set only where the cluster names none."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    ship(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark application."""
    context, package = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_folioworks_shipped", False) or not os.path.isdir(package):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="folioworks-code-"), "folioworks.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._folioworks_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh local one only where the whole session is on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="folioworks-")


def application_dir(spark: SparkSession) -> str:
    """This application's own place under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new path under the shared folder, for stream checkpoints and written tables."""
    return f"{application_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder as Parquet and go on from there: pruned columns, statistics, no lost lineage."""
    spark = configure(df.sparkSession)
    path, kept = scratch(spark, "table"), [f for f in df.schema.fields if f.dataType.simpleString() != "void"]
    df.select(*[F.col(f"`{f.name}`") for f in kept]).write.parquet(path)
    back = spark.read.schema(StructType(kept)).parquet(path)
    names = {f.name for f in kept}
    return back.select(*[F.col(f"`{f.name}`") if f.name in names else F.lit(None).alias(f.name) for f in df.schema.fields])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark writes to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; none where there is no such folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [found.getPath().getName() for found in store.listStatus(place)] if store.exists(place) else []


def clean(spark: SparkSession) -> None:
    """Delete what this application wrote under the shared folder; call it when its results are stored elsewhere."""
    remove(spark, application_dir(spark))
