"""Candidate rows: validity, the last-write-wins upsert with a fixed identity, and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.functions.text import truncate_message
from folioworks.operators.lifecycle import owns_claim

KEY = ["source_file_id", "source_entry_name", "video_script_seq"]
IDENTITY = ["entry_index", "file_name", "file_ext"]


def validity_error() -> Column:
    """First rule a candidate breaks, or NULL."""
    status, key, why = F.col("status"), F.col("s3_key"), F.col("reject_reason")
    has_key, has_why = F.coalesce(key != "", F.lit(False)), F.coalesce(why != "", F.lit(False))
    return (F.when(~F.coalesce(status.isin(*M.CANDIDATE_STATUSES), F.lit(False)), "unknown status")
            .when((status == "processed") & (~has_key | has_why), "processed needs a key and no reason")
            .when((status == "processed") & ~F.coalesce(F.col("content_hash") != "", F.lit(False)),
                  "processed needs a content hash")
            .when((status == "rejected") & (has_key | ~has_why), "rejected needs a reason and no key")
            .when(F.col("source_entry_name").isNull() != F.col("entry_index").isNull(),
                  "entry name and index go together"))


def judge(writes: DataFrame, claims: DataFrame) -> DataFrame:
    """Writes with `error`: the validity rule they break, else superseded where no claim of their token covers them.

    `writes` carry token, ts_us and seq; `claims`: file_id and wins, one row per file with its few claim intervals.
    """
    owners = claims.select(F.col("file_id").alias("source_file_id"), "wins")
    owned = owns_claim(F.col("wins"), F.col("token"), F.col("ts_us"), F.col("seq"))
    return writes.join(owners, "source_file_id", "left").withColumn(
        "error", F.coalesce(validity_error(), F.when(~owned, M.CLAIM_SUPERSEDED))).drop("wins")


def accepted(writes: DataFrame, claims: DataFrame) -> DataFrame:
    """What may be stored, with its reason cut to the message length; batch and stream write through this."""
    good = judge(writes, claims).filter("error IS NULL").drop("error", "token", "ts_us")
    return good.withColumn("reject_reason", truncate_message(F.col("reject_reason")))


def quarantined(writes: DataFrame, claims: DataFrame) -> DataFrame:
    """Refused writes with the rule they break."""
    return judge(writes, claims).filter("error IS NOT NULL")


def fold_writes(writes: DataFrame) -> DataFrame:
    """Writes folded to one row per (key, identity): who came first, how many, and the last payload.

    A partial aggregation and no join: however many replays one key has, its group shrinks before the shuffle.
    groupBy treats NULL entry names as equal, as the key requires.
    """
    rest = [c for c in writes.columns if c not in (*KEY, "seq")]
    return writes.groupBy(*KEY, *[F.col(c).alias(f"_id_{c}") for c in IDENTITY]).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("writes"),
        F.max_by(F.struct(*rest), "seq").alias("last"))


def merge_folds(folds: DataFrame) -> DataFrame:
    """Folds of several write batches as one; merging is associative, so batches may be folded in any grouping."""
    return folds.groupBy(*KEY, *[f"_id_{c}" for c in IDENTITY]).agg(
        F.min("first_seq").alias("first_seq"), F.sum("writes").alias("writes"), F.max_by("last", "last_seq").alias("last"),
        F.max("last_seq").alias("last_seq"))


def resolve(folds: DataFrame) -> DataFrame:
    """Latest accepted row per key. The first write fixes (index, name, ext); a write that differs changes nothing."""
    return folds.groupBy(*KEY).agg(F.min_by("last", "first_seq").alias("last"),
                                   F.min_by("last_seq", "first_seq").alias("seq")).select(*KEY, "last.*", "seq")


def upsert(writes: DataFrame) -> DataFrame:
    """Last write wins per (file, entry, sequence), within the identity its first write fixed."""
    return resolve(fold_writes(writes))


def mismatches(writes: DataFrame) -> DataFrame:
    """Refused identities per key, with how many writes carried each."""
    folded = fold_writes(writes).drop("last")
    owner = folded.groupBy(*KEY).agg(F.min("first_seq").alias("_owner"))
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(f"f.{k}").eqNullSafe(F.col(f"o.{k}"))
    return (folded.alias("f").join(owner.alias("o"), same).filter("first_seq <> _owner")
            .select(*[F.col(f"f.{k}") for k in KEY], *[F.col(f"_id_{c}").alias(c) for c in IDENTITY], "writes"))


def purge_batches(batches: DataFrame, files: DataFrame, candidates: DataFrame, library: DataFrame,
                  doomed: DataFrame) -> dict[str, DataFrame]:
    """Everything left after deleting the batches in `doomed` (batch_id): children go, library rows lose the link."""
    gone = files.join(doomed, "batch_id", "left_semi").select(F.col("file_id").alias("source_file_id"),
                                                              F.lit(True).alias("_gone"))
    linked = library.join(gone, "source_file_id", "left")
    return {
        "batches": batches.join(doomed, "batch_id", "left_anti"),
        "files": files.join(doomed, "batch_id", "left_anti"),
        "candidates": candidates.join(doomed, "batch_id", "left_anti"),
        "library": linked.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "source_file_id"
                                   else F.col(c) for c in library.columns]),
    }
