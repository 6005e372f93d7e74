"""Table constraints as data-quality jobs: every rule returns the rows (or counts) that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks import messages as M

DOMAINS = {
    "file.status": M.FILE_STATUSES, "file.intent": M.INTENTS, "candidate.status": M.CANDIDATE_STATUSES,
    "candidate.duplicate_kind": M.DUPLICATE_KINDS, "candidate.resolution": M.RESOLUTIONS,
    "batch.status": M.BATCH_STATUSES, "library.status": M.LIBRARY_STATUSES, "library.highest_risk": M.RISKS,
}
LENGTHS = {"source_entry_name": 1024, "file_name": 512, "file_ext": 10, "s3_key": 1024, "reject_reason": 512}


def repeated_keys(rows: DataFrame, keys: list[str], nulls_equal: bool = True) -> DataFrame:
    """Key values held by more than one row. With nulls_equal=False, rows with a NULL key are exempt."""
    if not nulls_equal:
        rows = rows.dropna(subset=keys)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def outside_domain(rows: DataFrame, rule: str) -> DataFrame:
    """Values of `table.column` outside its fixed domain, with counts. NULL passes."""
    column = rule.split(".")[1]
    return rows.filter(~F.col(column).isin(*DOMAINS[rule])).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("rows")).select(F.lit(rule).alias("rule"), "value", "rows")


def enum_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Domain violations of every enumerated column present in `tables` (file, candidate, batch, library)."""
    checks = [outside_domain(tables[rule.split(".")[0]], rule) for rule in DOMAINS
              if rule.split(".")[0] in tables and rule.split(".")[1] in tables[rule.split(".")[0]].columns]
    return reduce(DataFrame.unionByName, checks)


def replace_target_ok() -> Column:
    """A new file names no target; a replacement names one and is no archive. NULL results pass."""
    new = (F.col("intent") == "new") & F.col("replaces_document_id").isNull()
    replace = (F.col("intent") == "replace") & F.col("replaces_document_id").isNotNull() & ~F.col("is_archive")
    return F.coalesce(new | replace, F.lit(True))


def orphans(children: DataFrame, key: str, parents: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """Child keys without a parent; NULL keys are no reference."""
    have = parents.select(F.col(parent_key).alias(key))
    return children.filter(F.col(key).isNotNull()).join(have, key, "left_anti").groupBy(
        F.col(key).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(rule).alias("rule"), "value", "rows")


def field_violations(rows: DataFrame, key: str) -> DataFrame:
    """Over-long fields, bad hashes, negative numbers: one row per (row, rule)."""
    checks = [F.when(F.length(c) > n, f"{c} longer than {n}") for c, n in LENGTHS.items() if c in rows.columns]
    checks += [F.when(~F.col("content_hash").rlike("^[0-9a-f]{64}$"), "content_hash is no SHA-256"),
               F.when(F.col("entry_index") < 0, "entry_index negative"),
               F.when(F.col("size_bytes") < 0, "size_bytes negative")]
    return rows.select(key, F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("rule"))


def open_files(files: DataFrame) -> DataFrame:
    """Files per batch that are not terminal, where there are any."""
    return files.groupBy("batch_id").agg(
        F.count_if(~F.col("status").isin(*M.TERMINAL)).alias("open_files")).filter("open_files > 0")


def invariants(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """After a run: duplicate candidate keys and files left open, as one row per rule."""
    duplicates = repeated_keys(candidates, ["source_file_id", "source_entry_name"]).agg(
        F.count(F.lit(1)).alias("broken")).select(F.lit("duplicate_candidates").alias("rule"), "broken")
    unfinished = files.agg(F.count_if(~F.col("status").isin(*M.TERMINAL)).alias("broken")).select(
        F.lit("open_files").alias("rule"), "broken")
    return duplicates.unionByName(unfinished)


def claim_violations(claims: DataFrame, max_attempts: int) -> DataFrame:
    """Files with an attempt won more or less than once, or with more attempts than allowed."""
    won = claims.filter("won").groupBy("file_id").agg(
        F.count(F.lit(1)).alias("wins"), F.countDistinct("attempt").alias("attempts"), F.max("attempt").alias("last"))
    return won.withColumn("consistent", (F.col("wins") == F.col("attempts")) & (F.col("wins") == F.col("last"))
                          & (F.col("last") <= max_attempts))
