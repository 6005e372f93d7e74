"""Sinks that end in the same state however often they run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioworks.session import children, exists

MARKERS = "_commits"


def write_commit(rows: DataFrame, table: str, commit_id: str) -> None:
    """Write one commit's rows (library documents or audit rows) as their own folder of a parquet table.

    A repeated or resumed commit overwrites its folder, so nothing is added twice; earlier commits stay untouched.
    """
    rows.write.mode("overwrite").parquet(f"{table.rstrip('/')}/commit_id={commit_id}")


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """All commits of a table; `commit_id` is a partition column."""
    return spark.read.parquet(table)


def publish(tables: dict[str, DataFrame], root: str, commit_id: str) -> None:
    """Write one commit's rows to several tables under `root`, visible all at once: the marker, written last, is what readers
    of `published` go by. A commit that stops on the way is not seen, and running it again overwrites what it left."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        write_commit(rows, f"{root}/{name}", commit_id)
    names = [(name,) for name in sorted(tables)]
    write_commit(spark.createDataFrame(names, "table string").coalesce(1), f"{root}/{MARKERS}", commit_id)


def published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of all commits to `table` whose marker is complete, with their `commit_id`."""
    known = [name for name in children(spark, f"{root}/{table}") if name.startswith("commit_id=")]
    done = [f"{root}/{table}/{name}" for name in known if exists(spark, f"{root}/{MARKERS}/{name}/_SUCCESS")]
    if not done:
        return spark.read.parquet(*[f"{root}/{table}/{n}" for n in known[:1]]).limit(0) if known else spark.createDataFrame([], "commit_id string")
    return spark.read.option("basePath", f"{root}/{table}").parquet(*done)


def write_snapshot(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace a snapshot, e.g. files partitioned by status so that sweeps read one partition."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
