"""JSON log lines as rows, batch or stream. Lines that are no JSON object are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.schemas import LOG_LINE


def parse_lines(raw: DataFrame, column: str = "value") -> DataFrame:
    """Parse one JSON object per line; `ts` becomes a timestamp, `ts_us` its epoch microseconds."""
    # As a generator, the parse runs once per line; a filter on a projected struct would be pushed down as a second.
    parsed = raw.select(F.inline(F.array(F.from_json(F.col(column), LOG_LINE, {"mode": "PERMISSIVE"}))))
    kept = parsed.filter("event IS NOT NULL")
    at = F.try_to_timestamp("ts")
    return kept.withColumn("ts", at).withColumn("ts_us", F.unix_micros(at))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files as rows."""
    return parse_lines(spark.read.text(path))


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Log files as a stream."""
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))
