"""Commit: add each title and each content once per organization, in order, over any number of batches at once.

A candidate that loses on content never occupies its title, so this is a greedy matching in rank order, not two
windows. It runs as rounds: every edge (content, title) that ranks first among the live edges of both its keys is
accepted, then all edges sharing a key with it leave. Each round is grouped minima plus equi joins; copies of the
same (content, title) collapse before the first round, so a content that makes up a third of all candidates is one
edge. The number of rounds is logarithmic in expectation (Blelloch, Fineman, Shun, SPAA 2012), but chains of conflicts in rank order
would need one for every two links. So once rounds stop halving what is left, the graph is divided into its components, and
each is finished in one sorted pass; of a component too large for that, the edges of the lowest ranks are finished first,
as what follows cannot change them. A remainder below the bound of one pass is finished at once. There is no cap: all
goes on until every edge is decided.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.functions import names
from folioworks.operators.ranking import ordered_scan
from folioworks.session import durable

ORG_HASH = ["organization_id", "content_hash"]
ORG_TITLE = ["organization_id", "title_norm"]
PASS_EDGES = 200_000        # three integers each: what one sorted pass may hold


def finished_candidates(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates of files in a terminal status, with the file's creation time."""
    done = files.filter(F.col("status").isin(*M.TERMINAL)).select(
        F.col("file_id").alias("source_file_id"), F.col("created_us").alias("file_created_us"))
    return candidates.join(done, "source_file_id")


def commit(candidates: DataFrame, files: DataFrame, library: DataFrame, batch_order: str = "batch_id") -> DataFrame:
    """Every processed candidate of a finished file with `outcome` (added / skipped), `reason` and `document_id`.

    Order: batches by `batch_order` (a column of `candidates`), then file creation, file, entry index (none first),
    entry name. A document accepted from an earlier batch counts as library for a later one.
    """
    # min() over a struct compares field by field; the position never needs a sort or a window.
    position = F.struct(
        F.col(batch_order).alias("batch_order"), F.col("batch_id").alias("batch"),
        F.col("file_created_us").alias("created"), F.col("source_file_id").alias("file"),
        F.coalesce("entry_index", F.lit(-1)).alias("entry"),
        F.coalesce("source_entry_name", F.lit("")).alias("name"), F.col("staged_id").alias("staged"))
    live = finished_candidates(candidates.filter(F.col("status") == "processed"), files).withColumn("pos", position)
    held_hash = library.select(*ORG_HASH).distinct().withColumn("_hash_held", F.lit(True))
    held_title = library.select(*ORG_TITLE).distinct().withColumn("_title_held", F.lit(True))
    live = durable(live.join(held_hash, ORG_HASH, "left").join(held_title, ORG_TITLE, "left"))
    whole = F.col("content_hash").isNotNull() & F.col("title_norm").isNotNull()
    edges = (live.filter(whole & F.col("_hash_held").isNull() & F.col("_title_held").isNull())
             .groupBy("organization_id", "content_hash", "title_norm").agg(F.min("pos").alias("pos")))
    accepted = greedy_matching(edges)

    by_hash = accepted.select(*ORG_HASH, F.col("pos").alias("_hash_pos"))
    by_title = accepted.select(*ORG_TITLE, F.col("pos").alias("_title_pos"))
    same_content = F.col("_hash_pos") < F.col("pos")
    added = F.coalesce(F.col("_hash_pos") == F.col("pos"), F.lit(False))
    reason = (F.when(added, F.lit(None)).when(~whole, M.INCOMPLETE_CANDIDATE)
              .when(F.col("_hash_held"), M.ALREADY_IN_LIBRARY)
              .when(same_content & (F.col("_hash_pos.batch") == F.col("batch_id")), M.SAME_FILE_IN_BATCH)
              .when(same_content, M.ALREADY_IN_LIBRARY)
              .when(F.col("_title_held") | (F.col("_title_pos") < F.col("pos")), M.TITLE_IN_LIBRARY))
    decided = live.join(by_hash, ORG_HASH, "left").join(by_title, ORG_TITLE, "left")
    return (decided.withColumn("outcome", F.when(added, "added").otherwise("skipped"))
            .withColumn("reason", reason)
            .withColumn("document_id", names.document_id(F.col("staged_id")))
            .withColumn("document_key", names.processed_key(F.col("organization_id"), F.col("document_id"),
                                                            F.col("file_name")))
            .drop("_hash_held", "_title_held", "_hash_pos", "_title_pos"))


def greedy_matching(edges: DataFrame, most: int = PASS_EDGES) -> DataFrame:
    """Edges the sequential pass would accept. `edges`: organization_id, content_hash, title_norm, unique `pos`.

    Every edge gets an increasing number once, and each content and title the smallest number among its edges as an id, so
    what follows works on three integers.
    """
    ranked = durable(edges.repartitionByRange("pos").sortWithinPartitions("pos").withColumn("rank", F.monotonically_increasing_id()))
    contents = ranked.groupBy(*ORG_HASH).agg(F.min("rank").alias("h"))
    titles = ranked.groupBy(*ORG_TITLE).agg(F.min("rank").alias("t"))
    alive = durable(ranked.join(contents, ORG_HASH).join(titles, ORG_TITLE).select("rank", "h", "t"))
    accepted, left = [], alive.count()
    while left:
        if left <= most:
            accepted.append(_in_order(alive.withColumn("c", F.lit(0))).select("rank"))
            break
        judged, before = durable(_round(alive)), left
        accepted.append(judged.filter("wins").select("rank"))
        alive = judged.filter("NOT wins AND NOT lost").select("rank", "h", "t")
        left = alive.count()
        if left > most and 2 * left > before:
            won, alive = _by_components(alive, most)
            accepted.append(won)
            left = alive.count()
    if not accepted:
        return edges.limit(0)
    return ranked.join(reduce(DataFrame.unionByName, accepted), "rank", "left_semi").select(*edges.columns)


def _in_order(edges: DataFrame) -> DataFrame:
    """The sequential pass over (c, rank, h, t), for each c: the accepted edges. It holds the keys taken in one c only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, contents, titles = None, set(), set()
        for batch in batches:
            kept = []
            for at, (c, h, t) in enumerate(zip(*(batch.column(name).to_pylist() for name in ("c", "h", "t")), strict=True)):
                if c != own:
                    own, contents, titles = c, set(), set()
                if h not in contents and t not in titles:
                    contents.add(h)
                    titles.add(t)
                    kept.append(at)
            yield batch.take(pa.array(kept, pa.int64()))

    rows = edges.select(F.col("c").cast("bigint").alias("c"), "rank", "h", "t")
    return durable(rows.repartition("c").sortWithinPartitions("c", "rank").mapInArrow(run, rows.schema))


def _by_components(alive: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Finish the components of up to `most` edges, and of larger ones about as many of the lowest ranks: the ranks
    accepted, and the edges left."""
    parts = durable(components(alive))
    large = parts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("c")
    rest = durable(parts.join(large, "c", "left_semi"))
    ready, total = parts.join(large, "c", "left_anti"), rest.count()
    if not total:
        return _in_order(ready).select("rank"), alive.limit(0)
    (cut,) = rest.approxQuantile("rank", [most / total], most / total / 4)
    first = F.col("rank") <= cut
    won = _in_order(ready.unionByName(rest.filter(first)))
    later = rest.filter(~first).join(won.select("h"), "h", "left_anti").join(won.select("t"), "t", "left_anti")
    return won.select("rank"), durable(later.select("rank", "h", "t"))


def components(edges: DataFrame) -> DataFrame:
    """`edges` (rank, h, t) with the component `c` of each, named by its smallest rank. Labels spread over contents and titles,
    and every label is replaced by the label of the edge it names, so that the rounds are logarithmic in a path's length."""
    labelled = durable(edges.withColumn("c", F.least("h", "t", "rank")))
    while True:
        by_h = labelled.groupBy("h").agg(F.min("c").alias("_h"))
        by_t = labelled.groupBy("t").agg(F.min("c").alias("_t"))
        spread = durable(labelled.join(by_h, "h").join(by_t, "t").select(
            "rank", "h", "t", F.least("_h", "_t").alias("n"), "c"))
        named = spread.select(F.col("rank").alias("n"), F.col("n").alias("_n"))
        after = durable(spread.join(named, "n", "left").select(
            "rank", "h", "t", F.least("n", F.coalesce("_n", "n")).alias("c"), (F.least("n", F.coalesce("_n", "n")) < F.col("c")).alias("moved")))
        labelled = after.drop("moved")
        if after.filter("moved").isEmpty():
            return labelled


def _round(alive: DataFrame) -> DataFrame:
    """One round: `wins` where an edge ranks first among the live ones of both its keys, `lost` where such an edge takes
    one of its keys. A key is taken exactly if its first edge is also the first of that edge's other key."""
    first_h = alive.groupBy("h").agg(F.min("rank").alias("first"), F.min_by("t", "rank").alias("t"))
    first_t = alive.groupBy("t").agg(F.min("rank").alias("first"))
    heads = first_h.join(first_t.withColumnRenamed("first", "other"), "t")
    won = heads.filter("first = other").select("h", "t", F.col("first").alias("rank"))
    by_h, by_t = won.select("h", F.col("rank").alias("_h")), won.select("t", F.col("rank").alias("_t"))
    marked = alive.join(by_h, "h", "left").join(by_t, "t", "left")
    wins = F.coalesce(F.col("_h") == F.col("rank"), F.lit(False))
    return marked.select("rank", "h", "t", wins.alias("wins"),
                         (~wins & (F.col("_h").isNotNull() | F.col("_t").isNotNull())).alias("lost"))


def new_documents(outcome: DataFrame, committed_us: int) -> DataFrame:
    """Version-1 library rows of the added candidates."""
    at = F.timestamp_micros(F.lit(committed_us))
    return outcome.filter(F.col("outcome") == "added").select(
        "document_id", "organization_id", F.col("proposed_title").alias("title"), "title_norm", "file_name",
        names.file_name_norm(F.col("file_name")).alias("file_name_norm"), F.lit(1).alias("current_version"),
        F.col("document_key").alias("s3_key"), "file_ext", "size_bytes", "content_hash", "source_file_id",
        F.lit("active").alias("status"), at.alias("added_at"), F.lit(0).alias("open_findings"))


def skipped(outcome: DataFrame) -> DataFrame:
    """Candidates the commit discarded, with the reason."""
    return outcome.filter(F.col("outcome") == "skipped").select("batch_id", "staged_id", "file_name", "reason")


def resolutions(candidates: DataFrame, files: DataFrame, outcome: DataFrame) -> DataFrame:
    """Candidates a commit consumed and how: create_new, discard, or NULL for rejected ones."""
    taken = finished_candidates(candidates, files).select("staged_id", "proposed_title", "status")
    decided = outcome.select("staged_id", "outcome")
    return taken.join(decided, "staged_id", "left").select(
        "staged_id", F.when(F.col("outcome") == "added", "create_new").when(F.col("outcome") == "skipped", "discard")
        .alias("resolution"), F.when(F.col("status") == "processed", F.col("proposed_title")).alias("confirmed_title"))


def remaining_candidates(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """What a commit leaves staged: the candidates of unfinished files."""
    done = files.filter(F.col("status").isin(*M.TERMINAL)).select(F.col("file_id").alias("source_file_id"))
    return candidates.join(done, "source_file_id", "left_anti")


def unfinished_counts(files: DataFrame) -> DataFrame:
    """Files per batch that are not terminal yet."""
    return files.groupBy("batch_id").agg(F.count_if(~F.col("status").isin(*M.TERMINAL)).alias("still_in_progress"))


def commit_summary(outcome: DataFrame, files: DataFrame) -> DataFrame:
    """Per batch: how many were added and skipped, by reason, and how many files are still in progress."""
    reasons = {"already_in_library": M.ALREADY_IN_LIBRARY, "same_file": M.SAME_FILE_IN_BATCH,
               "title_in_library": M.TITLE_IN_LIBRARY}
    per_batch = outcome.groupBy("batch_id").agg(
        F.count_if(F.col("outcome") == "added").alias("added"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        *[F.count_if(F.col("reason") == text).alias(name) for name, text in reasons.items()])
    return unfinished_counts(files).join(per_batch, "batch_id", "left").fillna(0)


def commit_audit(outcome: DataFrame, files: DataFrame, user_id: int = 0) -> DataFrame:
    """One audit row per batch: action, how many were added and skipped, files still in progress. What was decided for
    each candidate is a row of `commit_audit_items`, so no list grows with a batch."""
    counts = outcome.groupBy("batch_id", "organization_id").agg(
        F.count_if(F.col("outcome") == "added").alias("added"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))
    return counts.join(unfinished_counts(files), "batch_id", "left").select(
        "organization_id", F.lit(user_id).cast("bigint").alias("user_id"), F.lit("batch_committed").alias("action"),
        F.lit("upload_batch").alias("entity_type"), F.col("batch_id").alias("entity_id"), "added", "skipped",
        F.coalesce("still_in_progress", F.lit(0)).alias("still_in_progress"))


def commit_audit_items(outcome: DataFrame) -> DataFrame:
    """One row per decision of a commit: batch, place in its commit order, and the document added or the reason skipped."""
    added = F.col("outcome") == "added"
    rows = outcome.select("batch_id", "pos", "staged_id", "outcome", F.when(added, F.col("document_id")).alias("document_id"), "reason")
    placed = ordered_scan(rows, ["batch_id"], ["pos"], {"position": ("number", None)})
    return placed.select(F.col("batch_id").alias("entity_id"), "position", "staged_id", "outcome", "document_id", "reason")


def committed_batches(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Batches a commit closes: no unfinished file and no candidate left."""
    left = remaining_candidates(candidates, files).select("batch_id")
    return unfinished_counts(files).filter("still_in_progress = 0").select("batch_id").join(
        left, "batch_id", "left_anti")


def object_plan(outcome: DataFrame) -> DataFrame:
    """(op, src, dst): copies staging → processed to make before the rows are written, deletes for afterwards.

    Keys are deterministic, so running the plan twice ends in the same objects.
    """
    steps = F.array(
        F.when(F.col("outcome") == "added", F.struct(F.lit("copy").alias("op"), F.col("s3_key").alias("src"),
                                                     F.col("document_key").alias("dst"))),
        F.struct(F.lit("delete").alias("op"), F.col("s3_key").alias("src"), F.lit(None).cast("string").alias("dst")),
        F.when(F.col("outcome") == "skipped", F.struct(F.lit("delete").alias("op"), F.col("document_key").alias("src"),
                                                       F.lit(None).cast("string").alias("dst"))))
    return outcome.select(F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("s.*")
