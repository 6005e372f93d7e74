"""Chat formatting after collapsing cumulative snapshots.

Logging a conversation after every turn leaves many conversations that are only the beginning of longer ones. Each turn
gets the rolling hash of its conversation up to there; a conversation whose whole hash is another's prefix is dropped by
an anti join, of equal ones the smallest id stays. What remains is rendered turn by turn, each turn with its place in
the rendered conversation, so that no conversation has to fit one row. A conversation of any length is scanned in slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.operators.ranking import ordered_scan

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rolling(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with `position`, `n_turns`, the prefix hash `state` and `offset` of the rendered turn.

    The hash of a prefix is the sum of its turns' hashes (number, role, text), exact in decimals, so that slices of a
    long conversation are hashed in parallel and added up.
    """
    rendered = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    clean = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                         F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = clean.filter("conv_id is not null").select(
        "*", F.xxhash64("turn", "role", "text").cast("decimal(20,0)").alias("_hash"), rendered.alias("rendered"))
    scanned = ordered_scan(rows, ["conv_id"], ["turn", "role", "text"],
                           {"position": ("number", None), "n_turns": ("size", None), "state": ("sum", F.col("_hash")),
                            "_end": ("sum", F.length("rendered").cast("bigint"))})
    return scanned.withColumn("offset", F.col("_end") - F.length("rendered")).drop("_hash", "_end")


def maximal(scanned: DataFrame) -> DataFrame:
    """conv_id of the conversations that begin no other; of equal ones the smallest."""
    whole = (scanned.filter("position = n_turns").groupBy("n_turns", "state").agg(F.min("conv_id").alias("conv_id")))
    begun = (scanned.filter("position < n_turns").select(F.col("position").alias("n_turns"), "state").distinct())
    return whole.join(begun, ["n_turns", "state"], "left_anti").select("conv_id")


def format_chats(turns: DataFrame) -> DataFrame:
    """Turns of the maximal conversations: conv_id, position, n_turns, role, offset, rendered.

    Turns are ordered by (turn, role, text), a null turn first; turn numbers are part of what is compared, so a snapshot
    counts as a prefix only under the same numbering. Null role or text is empty. Rows without a conv_id belong to no
    conversation and are left out. Repeated rows are turns of their own. `offset` counts the characters rendered before
    the turn. An empty table gives no rows; other columns are not read.
    """
    scanned = rolling(turns)
    kept = scanned.join(maximal(scanned), "conv_id", "left_semi")
    return kept.select("conv_id", "position", "n_turns", "role", "offset", "rendered")
