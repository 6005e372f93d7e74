"""Labelled training rows of a bounded number, chosen by a hash of the id on both sides of the join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 32


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; 0-based, null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """doc_id, text, y (0/1) of labelled documents outside fold `held`, about `rows` of them at most.

    Where more are labelled, those whose hashed id falls below a threshold are taken: the same filter holds on both
    tables, and the labels, whose number is bounded by `rows`, go to the texts, which stay where they are. Null ids and labels are left out; of several labels of one id the
    greatest counts.
    """
    usable = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
              .filter("doc_id is not null and y is not null").filter(fold("doc_id", folds) != held))
    share = min(1.0, rows / max(1, usable.count()))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(SPAN)) < int(share * SPAN)
    truth = usable.filter(chosen).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.filter(chosen).join(F.broadcast(truth), "doc_id")     # as many rows as are learned from, at most


def one_per_id(measured: DataFrame, *columns: str) -> DataFrame:
    """One row per doc_id of what was measured of labelled texts, the smallest: an id that repeats, however often, counts once,
    so what is collected stays within the bound on labels."""
    least = measured.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("m"))
    return least.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in columns])
