"""Object manifests: expected against actual keys, purges and retention. All work is on manifest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.settings import RETENTION, Retention


def orphan_objects(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Keys on one side only: `orphan` objects nobody expects, `missing` ones that should exist."""
    have = actual.select("key").withColumn("_a", F.lit(True))
    want = expected.select("key").withColumn("_e", F.lit(True))
    return want.join(have, "key", "full").filter("_a IS NULL OR _e IS NULL").select(
        "key", F.when(F.col("_e").isNull(), "orphan").otherwise("missing").alias("problem"))


def purge_rejected(manifest: DataFrame, rejected_files: DataFrame) -> DataFrame:
    """Staged objects of rejected archives. A staging key's fourth folder is its file, so this is an equi join."""
    owner = F.split("key", "/")
    staged = manifest.filter(F.startswith("key", F.lit("staging/"))).withColumn("_batch", owner[2]).withColumn(
        "_file", owner[3])
    doomed = rejected_files.select(F.col("batch_id").alias("_batch"), F.col("file_id").alias("_file"))
    return staged.join(doomed, ["_batch", "_file"], "left_semi").select("key")


def retention_expired(manifest: DataFrame, as_of_us: int, rules: Retention = RETENTION) -> DataFrame:
    """Objects past their prefix's keep time, and uploads left incomplete for too long."""
    day = 86_400_000_000
    age = F.lit(as_of_us) - F.col("modified_us")
    rule = (F.when(~F.col("complete") & (age >= rules.incomplete_days * day), "abort-incomplete-multipart")
            .when(F.col("complete") & F.startswith("key", F.lit("incoming/")) & (age >= rules.incoming_days * day),
                  "expire-incoming")
            .when(F.col("complete") & F.startswith("key", F.lit("staging/")) & (age >= rules.staging_days * day),
                  "expire-staging"))
    return manifest.select("key", rule.alias("rule")).filter("rule IS NOT NULL")
