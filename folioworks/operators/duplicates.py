"""Duplicate checks against the library. Never an OR join (that falls to a nested loop): one equi join per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_name_and_size(requests: DataFrame, library: DataFrame) -> DataFrame:
    """Requests (organization_id, file_name_norm, size_bytes) with `duplicate_of`, the smallest matching id."""
    keys = ["organization_id", "file_name_norm", "size_bytes"]
    known = library.groupBy(*keys).agg(F.min("document_id").alias("duplicate_of"))
    return requests.join(known, keys, "left")


def find_duplicate(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Mark processed candidates: same content beats same title; documents of any status count.

    The library shrinks to one row per key before each join, so copies on that side never multiply rows.
    """
    by_hash = library.groupBy("organization_id", "content_hash").agg(F.min("document_id").alias("_content"))
    by_title = library.groupBy("organization_id", "title_norm").agg(F.min("document_id").alias("_title"))
    live = F.col("status") == "processed"
    return (candidates.drop("duplicate_of_document_id", "duplicate_kind")
            .join(by_hash, ["organization_id", "content_hash"], "left")
            .join(by_title, ["organization_id", "title_norm"], "left")
            .withColumn("duplicate_of_document_id", F.when(live, F.coalesce("_content", "_title")))
            .withColumn("duplicate_kind", F.when(live & F.col("_content").isNotNull(), "same_content")
                        .when(live & F.col("_title").isNotNull(), "same_title"))
            .drop("_content", "_title"))


def find_duplicate_union(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """The same marks as all matches of both kinds, best rank first; `min` over (rank, id) picks one per candidate."""
    live = candidates.filter(F.col("status") == "processed").select(
        "staged_id", "organization_id", "content_hash", "title_norm")

    def matches(key: str, rank: int):
        one = library.groupBy("organization_id", key).agg(F.min("document_id").alias("document_id"))
        return live.join(one, ["organization_id", key]).select("staged_id", F.lit(rank).alias("rank"), "document_id")

    best = (matches("content_hash", 0).unionByName(matches("title_norm", 1)).groupBy("staged_id")
            .agg(F.min(F.struct("rank", "document_id")).alias("best")))
    return candidates.select("staged_id").join(best, "staged_id", "left").select(
        "staged_id", F.col("best.document_id").alias("duplicate_of_document_id"),
        F.when(F.col("best.rank") == 0, "same_content").when(F.col("best.rank") == 1, "same_title")
        .alias("duplicate_kind"))
