"""Archive rules over index rows: the guard, which entries count, their numbering and reasons, the final outcome.

Input rows: archive, an order within it, name, size, csize, flags. An archive with more entries than the limit is
refused on its count alone, so only archives of at most `max_entries` rows reach the windows below; an archive with
a third of all rows is a pair of partial sums and nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.functions.names import base_name, file_ext, folder_depth, path_parts, trim
from folioworks.functions.text import mismatch_reason, truncate_message
from folioworks.settings import ARCHIVE_LIMITS, ArchiveLimits


def unsafe_path(name: Column) -> Column:
    """Absolute, with a '..' component (either slash), or with a drive letter."""
    path = F.translate(name, "\\", "/")
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..") | name.rlike("^[A-Za-z]:")


def hidden(name: Column) -> Column:
    """Under a __MACOSX folder, or a dot file."""
    parts = path_parts(name)
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_contains(folders, "__MACOSX") | F.startswith(base_name(name), F.lit("."))


def archive_totals(entries: DataFrame) -> DataFrame:
    """Entry count and unpacked bytes per archive."""
    return entries.groupBy("archive").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("size").alias("total_bytes"))


def _entry_violation(limits: ArchiveLimits, name: Column, size: Column, csize: Column, flags: Column,
                     repeated: Column) -> Column:
    """First rule an index entry breaks, or NULL."""
    def says(text: str) -> Column:
        return F.concat(F.lit("'"), name, F.lit("'" + text))

    too_dense = (csize != 0) & (size / F.nullif(csize, F.lit(0)) > limits.max_ratio)
    return (F.when(too_dense, says(M.TOO_DENSE))
            .when(unsafe_path(name), says(M.UNSAFE_PATH))
            .when(flags.bitwiseAND(1) == 1, says(M.ENCRYPTED))
            .when(repeated, says(M.REPEATED))
            .when(F.octet_length(base_name(name)) > limits.max_name_bytes,
                  says(M.NAME_TOO_LONG.format(limits.max_name_bytes)))
            .when(F.length(name) > limits.max_path_chars,
                  F.concat(F.lit("'"), F.substring(name, 1, 80),
                           F.lit("…'" + M.PATH_TOO_LONG.format(limits.max_path_chars)))))


def container_reason(look: Column, limits: ArchiveLimits) -> Column:
    """The guard's verdict on one container whose index travels as a column (`entries`, empty over the count limit)."""
    def broken(e: Column, at: Column) -> Column:
        earlier = F.exists(F.slice(look["entries"], F.lit(1), at), lambda o: o["name"] == e["name"])
        return _entry_violation(limits, e["name"], e["size"], e["csize"], e["flags"], earlier)

    first = F.get(F.filter(F.transform(look["entries"], broken), lambda text: text.isNotNull()), F.lit(0))
    return _archive_reason(limits, look["n_entries"], look["total_bytes"], first)


def _fitting(entries: DataFrame, totals: DataFrame, limits: ArchiveLimits) -> DataFrame:
    """Entries of archives within both archive-level limits, now hashed by archive."""
    fits = totals.filter((F.col("n_entries") <= limits.max_entries)
                         & (F.col("total_bytes") <= limits.max_total_bytes)).select("archive")
    return entries.join(fits, "archive", "left_semi")


def _examined(entries: DataFrame, totals: DataFrame, order: list[str], limits: ArchiveLimits) -> DataFrame:
    """Entries of fitting archives with the archive's first violation (`_why`), visibility, `entry_index` among the
    visible ones, name parts and the reason an entry is refused before extraction.

    All windows cluster on the archive, as the semi join left the rows: one shuffle in all.
    """
    in_order = Window.partitionBy("archive").orderBy(*order)
    rows = _fitting(entries, totals, limits).withColumn("_visible", ~hidden(F.col("name")))
    # Visible entries are numbered in the same sort as all entries; an archive with a violation shows none anyway.
    rows = rows.withColumn("_pos", F.row_number().over(in_order) - 1).withColumn(
        "entry_index", (F.sum(F.col("_visible").cast("int")).over(
            in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).cast("int"))
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("archive", "name").orderBy("_pos")))
    bad = _entry_violation(limits, *[F.col(c) for c in ("name", "size", "csize", "flags")], F.col("_copy") > 1)
    rows = rows.withColumn("_bad", F.when(bad.isNotNull(), F.struct(F.col("_pos"), bad.alias("why"))))
    rows = rows.withColumn("_why", F.min("_bad").over(Window.partitionBy("archive"))["why"]).withColumn(
        "_ext", file_ext(F.col("name")))
    reason = (F.when(folder_depth(F.col("name")) > limits.max_depth, M.TOO_DEEP)
              .when(F.col("_ext") == "", M.NO_EXTENSION)
              .when(~F.col("_ext").isin(*limits.entry_exts), F.concat(F.lit("."), F.col("_ext"), F.lit(M.NOT_SUPPORTED))))
    return (rows.withColumn("_shown", F.col("_why").isNull() & F.col("_visible")).drop("_visible")
            .withColumn("file_name", base_name(F.col("name"))).withColumn("entry_reason", reason)
            .withColumn("file_ext", F.when(F.col("entry_reason").isNull(), F.col("_ext")).otherwise(
                F.substring("_ext", 1, 10))))


def _archive_reason(limits: ArchiveLimits, n: Column, total: Column, first: Column) -> Column:
    """The guard's verdict from the entry count, the unpacked bytes and the first violation."""
    return (F.when(n > limits.max_entries, F.concat(n.cast("string"), F.lit(M.TOO_MANY_FILES.format(limits.max_entries))))
            .when(total > limits.max_total_bytes, M.TOO_LARGE_UNPACKED).otherwise(first))


def archive_guard(entries: DataFrame, order: list[str], limits: ArchiveLimits = ARCHIVE_LIMITS) -> DataFrame:
    """Per archive: n_entries, total_bytes and the first violation (`reason`, NULL when it is safe)."""
    totals = archive_totals(entries)
    why = _examined(entries, totals, order, limits).groupBy("archive").agg(F.max("_why").alias("_why"))
    reason = _archive_reason(limits, F.col("n_entries"), F.col("total_bytes"), F.col("_why"))
    return totals.join(why, "archive", "left").select("archive", "n_entries", "total_bytes", reason.alias("reason"))


def archive_candidates(entries: DataFrame, order: list[str], limits: ArchiveLimits = ARCHIVE_LIMITS) -> DataFrame:
    """Visible entries of safe archives: entry_index over what is left after hiding, file_name, file_ext, and the
    reason an entry is refused before extraction (NULL: extract it)."""
    seen = _examined(entries, archive_totals(entries), order, limits)
    return seen.filter("_shown").drop("_pos", "_copy", "_bad", "_why", "_ext", "_shown")


def resume_entries(candidates: DataFrame, progress: DataFrame) -> DataFrame:
    """Entries still to do: those from each archive's `entries_done` on (0 where nothing is recorded)."""
    done = progress.select("archive", "entries_done")
    return candidates.join(done, "archive", "left").filter(
        F.col("entry_index") >= F.coalesce("entries_done", F.lit(0))).drop("entries_done")


def _decided(rows: DataFrame, shown: Column) -> DataFrame:
    """Add `_cut` (index and text of the first broken entry among those extracted), whether the row is kept, and
    its reject_reason."""
    broken = shown & F.col("entry_reason").isNull() & F.col("crc_error")
    told = (F.col("read_error") if "read_error" in rows.columns else F.concat(
        F.lit("'"), F.col("name"), F.lit(f"'{M.INDEX_DISAGREES}{M.BAD_CRC} for file '"), F.col("name"), F.lit("')")))
    cut = F.min(F.when(broken, F.struct("entry_index", told.alias("told")))).over(Window.partitionBy("archive"))
    own = F.coalesce("entry_reason", F.when(F.col("detected") != F.col("file_ext"), mismatch_reason(
        F.col("file_ext"), F.col("detected"), F.col("detected_reason"))))
    rows = rows.withColumn("_cut", cut)
    return rows.withColumn("_kept", shown & (F.col("_cut").isNull() | (F.col("entry_index") < F.col("_cut.entry_index")))
                           ).withColumn("reject_reason", truncate_message(F.coalesce(own, F.when(
                               F.col("_cut").isNotNull(), F.concat(F.lit(M.ARCHIVE_REJECTED + ": "), F.col("_cut.told"))))))


def entry_outcomes(candidates: DataFrame) -> DataFrame:
    """Candidate rows after extraction. Needs crc_error, detected, detected_reason on every row to be extracted, and
    takes the text of a failed reading from `read_error` where there is one.

    The first broken entry among those extracted ends its archive: entries before it are kept as rejected ("Archive
    rejected: …", unless they have a reason of their own), it and later ones never appear.
    """
    return _decided(candidates, F.lit(True)).filter("_kept").withColumn(
        "status", F.when(F.col("reject_reason").isNull(), "processed").otherwise("rejected")).drop(
        "_cut", "_kept", "entry_reason")


def archive_outcome(entries: DataFrame, order: list[str], limits: ArchiveLimits = ARCHIVE_LIMITS) -> DataFrame:
    """Final status per archive, with message, entries_total, entries_done and its candidate counts.

    Guard, numbering, reasons and counts come out of one pass over the rows of each archive.
    """
    totals = archive_totals(entries)
    kept = F.col("_kept")
    per_archive = _decided(_examined(entries, totals, order, limits), F.col("_shown")).groupBy("archive").agg(
        F.max("_why").alias("_why"), F.count_if("_shown").alias("_total"), F.max("_cut").alias("_cut"),
        F.count_if(kept & F.col("reject_reason").isNull()).alias("_processed"),
        F.count_if(kept & F.col("reject_reason").isNotNull()).alias("_rejected"))
    zero = F.lit(0)
    rows = totals.join(per_archive, "archive", "left").withColumn(
        "_guard", _archive_reason(limits, F.col("n_entries"), F.col("total_bytes"), F.col("_why")))
    return rows.select(
        "archive",
        F.when(F.col("_guard").isNotNull() | F.col("_cut").isNotNull(), "rejected")
        .when(F.col("_rejected") > 0, "partial").otherwise("processed").alias("status"),
        truncate_message(F.when(F.col("_guard").isNotNull(), F.concat(F.lit(M.UNSAFE_FILE), F.col("_guard")))
                         .otherwise(F.col("_cut.told"))).alias("status_message"),
        F.when(F.col("_guard").isNull(), F.col("_total")).cast("int").alias("entries_total"),
        F.coalesce(F.col("_cut.entry_index"), F.when(F.col("_guard").isNull(), F.col("_total")), zero).cast("int")
        .alias("entries_done"),
        F.coalesce("_processed", zero).alias("processed"), F.coalesce("_rejected", zero).alias("rejected"))


def zip_precheck(entries: DataFrame, limits: ArchiveLimits = ARCHIVE_LIMITS) -> DataFrame:
    """The browser's look at an archive: per visible entry NULL or a `problem` (its wording differs from the
    worker's) and the `warning` shown. `signature_ok` and `size` decide for PDFs."""
    name, segments = F.col("name"), F.filter(F.split("name", "/"), lambda part: part != "")
    ext = F.lower(F.regexp_extract(trim(F.try_element_at(segments, F.lit(-1))), r"(?i)\.([a-z0-9]+)$", 1))
    shown = entries.filter(~(F.contains(name, F.lit("__MACOSX/")) | F.startswith(
        F.try_element_at(F.split(name, "/"), F.lit(-1)), F.lit("."))))
    problem = (F.when(F.size(segments) - 1 > limits.max_depth, M.TOO_DEEP)
               .when(ext == "", M.NO_EXTENSION_INSIDE)
               .when(~ext.isin(*limits.entry_exts), F.concat(F.lit("."), ext, F.lit(M.NOT_SUPPORTED_INSIDE)))
               .when((ext == "pdf") & (F.col("size") == 0), M.EMPTY_FILE)
               .when((ext == "pdf") & ~F.col("signature_ok"), M.BAD_PDF))
    return shown.withColumn("problem", problem).withColumn(
        "warning", F.when(F.col("problem").isNotNull(), F.concat(name, F.lit(": "), F.col("problem"))))


def zip_precheck_verdict(archives: DataFrame, checked: DataFrame, limits: ArchiveLimits = ARCHIVE_LIMITS) -> DataFrame:
    """Per archive: usable entries, warnings and the `error` that blocks it: it cannot be opened (`archives.error`),
    or no entry at all is usable."""
    allowed = ", ".join(ext.upper() for ext in limits.entry_exts)
    counts = checked.groupBy("archive").agg(F.count_if(F.col("problem").isNull()).alias("usable"),
                                            F.count("problem").alias("warnings"))
    rows = archives.join(counts, "archive", "left").fillna({"usable": 0, "warnings": 0})
    return rows.select(
        "archive", "usable", "warnings",
        F.when(F.col("error").isNotNull(), M.BAD_ZIP)
        .when(F.col("usable") == 0, M.ZIP_HAS_NOTHING.format(allowed))
        .alias("error")).withColumn("archive_valid", F.col("error").isNull())
