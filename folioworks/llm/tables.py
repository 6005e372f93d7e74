"""Reading the corpus tables and cutting lineage with a written table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  registers pa.compute
from pyspark.sql import DataFrame, SparkSession

from folioworks.session import configure, remove, scratch

# Text handed to one vectorised step, so that lists of words stay small whatever the Arrow batch holds.
RUN_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back: pruned, splittable, safe from lost executors."""
    path = scratch(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more, to have its room back."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        remove(df.sparkSession, folder)


def runs(batch: pa.RecordBatch, column: str, limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of `column` each, at least one row. What Arrow holds free after the last one
    goes back to the system: a reused Python worker would keep it for all later stages."""
    ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).cast("int64"))
    ends, start, base = ends.to_numpy(zero_copy_only=False), 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(ends.searchsorted(base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])
    pa.default_memory_pool().release_unused()
