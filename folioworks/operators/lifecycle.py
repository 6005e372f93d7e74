"""File lifecycle: one table of transition rules, applied natively by the batch fold and, trigger by trigger, by the stream.

staged → uploading → uploaded → processing → processed / partial / rejected / error. Writes after a claim are
fenced: they count only while the file is processing under the token they carry. Every clock is in the data or an
argument; nothing reads the wall clock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.functions.text import truncate_message
from folioworks.operators.ranking import ordered_scan
from folioworks.session import durable
from folioworks.settings import AGES, Ages


@dataclass(frozen=True)
class Rule:
    """When an event applies, and what it changes. `to=None` keeps the status, 'event' takes the event's."""

    sources: tuple[str, ...]
    to: str | None = None
    fenced: bool = False
    message: str | None = None
    stamps: str | None = None
    ends_claim: bool = False


RULES: dict[str, Rule] = {
    "uploading": Rule(("staged",), "uploading"),
    "confirm": Rule(("staged", "uploading"), "uploaded", stamps="uploaded_us"),
    "cancel": Rule(("staged", "uploading"), "error", message=M.CANCELLED),
    "heartbeat": Rule(("processing",), fenced=True, stamps="heartbeat_us"),
    "progress": Rule(("processing",), fenced=True, stamps="heartbeat_us"),
    "release": Rule(("processing",), "uploaded", fenced=True, stamps="uploaded_us", ends_claim=True),
    "finish": Rule(("processing",), "event", fenced=True, message="event", ends_claim=True),
}
FOLD_ROWS = 250_000          # longest history gathered for one fold
FENCED = tuple(kind for kind, rule in RULES.items() if rule.fenced)

WIN = "struct<from_us:bigint,from_seq:bigint,to_us:bigint,to_seq:bigint,token:string,attempt:int>"
STATE_FIELDS = {
    "status": "string", "status_message": "string", "attempt_count": "int", "claim_token": "string",
    "heartbeat_us": "bigint", "uploaded_us": "bigint", "entries_total": "int", "entries_done": "int",
    "detected_type": "string", "claim_us": "bigint", "claim_seq": "bigint", "wins": f"array<{WIN}>",
}
EVENT_FIELDS = ("ts_us", "seq", "kind", "token", "status", "message", "entries_total", "entries_done",
                "detected_type")


def initial_state() -> Column:
    """A file that has just been registered."""
    values = {"status": F.lit("staged"), "attempt_count": F.lit(0), "entries_done": F.lit(0), "wins": F.array()}
    return F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in STATE_FIELDS.items()])


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for flag in flags[1:]:
        out = out | flag
    return out


def step(state: Column, event: Column, ages: Ages) -> Column:
    """State after one event; an event that does not apply changes nothing."""
    stale = state["heartbeat_us"] < event["ts_us"] - ages.stale_seconds * 1_000_000
    claims = F.coalesce((event["kind"] == "claim") & (state["attempt_count"] < ages.max_attempts) & (
        (state["status"] == "uploaded") | ((state["status"] == "processing") & stale)), F.lit(False))
    owns = state["claim_token"] == event["token"]
    applies = {kind: F.coalesce((event["kind"] == kind) & state["status"].isin(*rule.sources)
                                & (owns if rule.fenced else F.lit(True)), F.lit(False))
               for kind, rule in RULES.items()}

    def pick(field: str, changes: list[tuple[Column, Column]]) -> Column:
        out = None
        for when, value in changes:
            out = F.when(when, value) if out is None else out.when(when, value)
        kept = state[field]
        return (kept if out is None else out.otherwise(kept)).cast(STATE_FIELDS[field]).alias(field)

    def stamped(field: str) -> list[tuple[Column, Column]]:
        return [(applies[kind], event["ts_us"]) for kind, rule in RULES.items() if rule.stamps == field]

    ends = _any([applies[kind] for kind, rule in RULES.items() if rule.ends_claim])
    takeover = claims & (state["status"] == "processing")
    closed = F.struct(state["claim_us"].alias("from_us"), state["claim_seq"].alias("from_seq"),
                      event["ts_us"].alias("to_us"), event["seq"].alias("to_seq"),
                      state["claim_token"].alias("token"), state["attempt_count"].alias("attempt")).cast(WIN)
    none, progress = F.lit(None), applies["progress"]
    return F.struct(
        pick("status", [(claims, F.lit("processing"))] + [
            (applies[kind], event["status"] if rule.to == "event" else F.lit(rule.to))
            for kind, rule in RULES.items() if rule.to]),
        pick("status_message", [(applies[kind], truncate_message(event["message"]) if rule.message == "event" else F.lit(rule.message))
                                for kind, rule in RULES.items() if rule.message]),
        pick("attempt_count", [(claims, state["attempt_count"] + 1)]),
        pick("claim_token", [(claims, event["token"]), (ends, none)]),
        pick("heartbeat_us", [(claims, event["ts_us"])] + stamped("heartbeat_us")),
        pick("uploaded_us", stamped("uploaded_us")),
        pick("entries_total", [(progress, F.coalesce(event["entries_total"], state["entries_total"]))]),
        pick("entries_done", [(progress, F.coalesce(event["entries_done"], state["entries_done"]))]),
        pick("detected_type", [(progress, F.coalesce(event["detected_type"], state["detected_type"]))]),
        pick("claim_us", [(claims, event["ts_us"]), (ends, none)]),
        pick("claim_seq", [(claims, event["seq"]), (ends, none)]),
        # One closed interval per claim, so never more than max_attempts.
        pick("wins", [(takeover | ends, F.concat(state["wins"], F.array(closed)))]))


def _judged(events: DataFrame) -> DataFrame:
    """Writes that make no sense become kind `invalid` and change nothing: a finish needs a terminal status, progress
    at least one field."""
    senseless = (F.col("kind") == "finish") & ~F.coalesce(F.col("status").isin(*M.TERMINAL), F.lit(False)) | (
        (F.col("kind") == "progress") & F.coalesce("entries_total", "entries_done").isNull() & F.col("detected_type").isNull())
    return events.withColumn("kind", F.when(senseless, "invalid").otherwise(F.col("kind")))


def lifecycle_state(events: DataFrame, ages: Ages = AGES, hot_rows: int = FOLD_ROWS) -> DataFrame:
    """Current state per file: (file_id, created_us, last_us, events, state…, wins).

    `events` has file_id, ts_us, seq and the other EVENT_FIELDS. A file's history is folded in one pass inside the
    JVM; a file with more than `hot_rows` events is never gathered, see `_by_phases`.
    """
    events = _judged(events)
    sizes = events.groupBy("file_id").agg(F.count(F.lit(1)).alias("events"), F.min("ts_us").alias("created_us"),
                                          F.max("ts_us").alias("last_us"))
    hot = sizes.filter(F.col("events") > hot_rows)
    if hot.isEmpty():
        return _open_claims(_fold(events, ages))
    hot = hot.select("file_id")
    slow = _by_phases(events.join(hot, "file_id", "left_semi"), ages)
    return _open_claims(_fold(events.join(hot, "file_id", "left_anti"), ages).unionByName(slow))


def advance(events: DataFrame, ages: Ages, previous: DataFrame | None = None) -> DataFrame:
    """Fold events onto `previous` (or onto new files): file_id, events, created_us, last_us, last_seq, late, state.

    Events at or before a file's last one came too late: they are counted in `late` and change nothing. The events given
    are gathered per file, so a stream calls this with what one trigger holds.
    """
    history = _judged(events).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("_events"), F.min("ts_us").alias("_created"),
        F.sort_array(F.collect_list(F.struct(*EVENT_FIELDS))).alias("history"))
    if previous is None:
        rows = history.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("events", "created_us", "last_us", "last_seq",
                                                                                  "late")], initial_state().alias("_start"))
    else:
        rows = previous.withColumnRenamed("state", "_start").join(history, "file_id", "full_outer").withColumn(
            "_start", F.coalesce("_start", initial_state())).withColumn(
            "history", F.coalesce("history", F.array().cast(history.schema["history"].dataType)))
    last = F.struct(F.col("last_us").alias("ts_us"), F.col("last_seq").alias("seq"))
    fresh = F.filter("history", lambda e: F.col("last_us").isNull() | (F.struct(e["ts_us"], e["seq"]) > last))
    rows = rows.withColumn("_fresh", fresh)
    newest = F.try_element_at("_fresh", F.lit(-1))
    return rows.select(
        "file_id", (F.coalesce("events", F.lit(0)) + F.coalesce("_events", F.lit(0))).alias("events"),
        F.least("created_us", "_created").alias("created_us"), F.coalesce(newest["ts_us"], "last_us").alias("last_us"),
        F.coalesce(newest["seq"], "last_seq").alias("last_seq"),
        (F.coalesce("late", F.lit(0)) + F.size("history") - F.size("_fresh")).cast("bigint").alias("late"),
        F.aggregate("_fresh", F.col("_start"), lambda s, e: step(s, e, ages)).alias("state"))


def advance_any(events: DataFrame, ages: Ages, previous: DataFrame, hot_rows: int = FOLD_ROWS) -> DataFrame:
    """`advance`, for triggers of any size: of a file with more than `hot_rows` events among `events` no history is gathered, its
    events are worked off in phases from where `previous` left it. Only files with events come back."""
    counts = events.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    hot = durable(counts.filter(F.col("n") > hot_rows).select("file_id"))
    known = previous.join(counts, "file_id", "left_semi")
    if hot.isEmpty():
        return advance(events, ages, known)
    few = advance(events.join(hot, "file_id", "left_anti"), ages, known.join(hot, "file_id", "left_anti"))
    many, before = _judged(events.join(hot, "file_id", "left_semi")), durable(known.join(hot, "file_id", "left_semi"))
    last = F.struct(F.col("last_us").alias("ts_us"), F.col("last_seq").alias("seq"))
    placed = many.join(before.select("file_id", last.alias("_last")), "file_id", "left")
    late = F.coalesce(F.struct("ts_us", "seq") <= F.col("_last"), F.lit(False))
    placed = durable(placed.withColumn("_late", late))
    fresh = placed.filter("NOT _late").drop("_last", "_late")
    ends = placed.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("_events"), F.min("ts_us").alias("_created"), F.count_if("_late").alias("_late"),
        F.max(F.when(~F.col("_late"), F.struct("ts_us", "seq"))).alias("_end"))
    states = _by_phases(fresh, ages, before.select("file_id", "state", last.alias("at"))).select("file_id", F.col("state").alias("_state"))
    rows = ends.join(before, "file_id", "left").join(states, "file_id", "left")
    return few.unionByName(rows.select(
        "file_id", (F.coalesce("events", F.lit(0)) + F.col("_events")).alias("events"), F.least("created_us", "_created").alias("created_us"),
        F.coalesce("_end.ts_us", "last_us").alias("last_us"), F.coalesce("_end.seq", "last_seq").alias("last_seq"),
        (F.coalesce("late", F.lit(0)) + F.col("_late")).alias("late"), F.coalesce("_state", "state", initial_state()).alias("state")))


def _fold(events: DataFrame, ages: Ages) -> DataFrame:
    return advance(events, ages).select("file_id", "events", "created_us", "last_us", "state")


def _open_claims(folded: DataFrame) -> DataFrame:
    state = F.col("state")
    still_open = F.struct(state["claim_us"].alias("from_us"), state["claim_seq"].alias("from_seq"),
                          F.lit(None).cast("bigint").alias("to_us"), F.lit(None).cast("bigint").alias("to_seq"),
                          state["claim_token"].alias("token"), state["attempt_count"].alias("attempt")).cast(WIN)
    wins = F.when(state["claim_us"].isNotNull(), F.concat(state["wins"], F.array(still_open))).otherwise(state["wins"])
    kept = [n for n in STATE_FIELDS if n not in ("wins", "claim_us", "claim_seq")]
    return folded.select("file_id", "events", "created_us", "last_us",
                         *[state[n].alias(n) for n in kept], wins.alias("wins"))


def _by_phases(events: DataFrame, ages: Ages, start: DataFrame | None = None) -> DataFrame:
    """The same result for files with huge histories, without gathering any of them. `start`: file_id, state and at (ts_us,
    seq of the last event before) of files that are not new.

    Only a few events change a file's status: the first confirm, at most max_attempts claims, and what ends each.
    Every round finds each file's next such event with partial aggregates and applies the shared `step` to it; the
    heartbeats in between only matter through the last one, which a sliced scan supplies.
    """
    event = F.struct(*EVENT_FIELDS)
    events = durable(events.select("file_id", event.alias("e"), F.struct("ts_us", "seq").alias("pos")))
    origin = F.struct(F.lit(-2 ** 62).cast("bigint").alias("ts_us"), F.lit(-1).cast("bigint").alias("seq"))
    states = durable(events.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("events"), F.min("e.ts_us").alias("created_us"), F.max("e.ts_us").alias("last_us"))
        .select("*", initial_state().alias("state"), origin.alias("at")) if start is None else events.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("events"), F.min("e.ts_us").alias("created_us"), F.max("e.ts_us").alias("last_us")).join(
        start, "file_id", "left").withColumns({"state": F.coalesce("state", initial_state()), "at": F.coalesce("at", origin)}))
    fields = ("entries_total", "entries_done", "detected_type")
    while True:
        ahead = events.join(states.select("file_id", "state", "at"), "file_id").filter("pos > at")
        mine = ahead["e.token"] == ahead["state.claim_token"]
        beat = (F.col("state.status") == "processing") & mine & F.col("e.kind").isin("heartbeat", "progress")
        leaves = {status: tuple(k for k, r in RULES.items() if status in r.sources and r.to) for status in
                  ("staged", "uploading")}
        can_claim = (F.col("e.kind") == "claim") & (F.col("state.attempt_count") < ages.max_attempts)
        moves = ((F.col("state.status") == "staged") & F.col("e.kind").isin(*leaves["staged"])
                 | (F.col("state.status") == "uploading") & F.col("e.kind").isin(*leaves["uploading"])
                 | (F.col("state.status") == "uploaded") & can_claim
                 | (F.col("state.status") == "processing") & mine & F.col("e.kind").isin("finish", "release"))
        takes = (F.col("state.status") == "processing") & can_claim
        rows = ahead.filter(F.coalesce(beat, F.lit(False)) | F.coalesce(moves | takes, F.lit(False))).select(
            "file_id", "e", "pos", F.col("pos.ts_us").alias("_us"), F.col("pos.seq").alias("_seq"),
            F.col("state.heartbeat_us").alias("_base"), F.coalesce(beat, F.lit(False)).alias("_beat"),
            F.coalesce(moves, F.lit(False)).alias("_moves"))
        rows = durable(ordered_scan(durable(rows), ["file_id"], ["_us", "_seq"],
                                    {"_last": ("before", F.when(F.col("_beat"), F.col("_us")))}))
        silent = F.coalesce(F.col("_last"), F.col("_base")) < F.col("_us") - ages.stale_seconds * 1_000_000
        rows = rows.filter(F.col("_beat") | F.col("_moves") | silent)
        following = rows.filter(~F.col("_beat")).groupBy("file_id").agg(F.min("pos").alias("to"),
                                                                       F.min_by("e", "pos").alias("next"))
        # Heartbeats and progress between here and the next change (or the end of the history).
        beats = rows.filter("_beat").join(following.select("file_id", "to"), "file_id", "left").filter(
            F.col("to").isNull() | (F.col("pos") < F.col("to")))
        passed = beats.groupBy("file_id").agg(
            F.max("_us").alias("beat_us"),
            *[F.max_by(F.col(f"e.{f}"), F.when((F.col("e.kind") == "progress") & F.col(f"e.{f}").isNotNull(),
                                               F.col("pos"))).alias(f"p_{f}") for f in fields])
        merged = states.join(passed, "file_id", "left").join(following, "file_id", "left")
        state = F.col("state")
        caught_up = F.struct(*[
            F.coalesce(F.col("beat_us"), state[n]).alias(n) if n == "heartbeat_us" else
            F.coalesce(F.col(f"p_{n}"), state[n]).alias(n) if n in fields else state[n].alias(n)
            for n in STATE_FIELDS])
        merged = merged.withColumn("state", caught_up)
        states = durable(merged.select(
            "file_id", "events", "created_us", "last_us",
            F.when(F.col("next").isNotNull(), step(F.col("state"), F.col("next"), ages)).otherwise(
                F.col("state")).alias("state"),
            F.coalesce("to", "at").alias("at"), F.col("next").isNotNull().alias("_moved")))
        if states.filter("_moved").isEmpty():
            return states.drop("at", "_moved")
        states = states.drop("_moved")


def claim_results(events: DataFrame, states: DataFrame) -> DataFrame:
    """Each claim request with its result: won (and as which attempt) or lost."""
    wins = states.select("file_id", "wins")
    claims = events.filter(F.col("kind") == "claim").select("file_id", "ts_us", "seq", "token")
    won = F.filter("wins", lambda w: (w["from_us"] == F.col("ts_us")) & (w["from_seq"] == F.col("seq")))
    return (claims.join(wins, "file_id").withColumn("win", F.get(won, F.lit(0)))
            .select("file_id", "seq", "token", F.col("win").isNotNull().alias("won"),
                    F.col("win.attempt").alias("attempt")))


def owns_claim(wins: Column, token: Column, ts_us: Column, seq: Column) -> Column:
    """Whether a write at (ts_us, seq) falls into a claim interval of the token it carries."""
    at = F.struct(ts_us.alias("ts_us"), seq.alias("seq"))
    return F.coalesce(F.exists(wins, lambda w: (w["token"] == token)
                               & (F.struct(w["from_us"].alias("ts_us"), w["from_seq"].alias("seq")) < at)
                               & (w["to_us"].isNull() | (at <= F.struct(w["to_us"].alias("ts_us"), w["to_seq"].alias("seq"))))),
                      F.lit(False))


def fenced_writes(events: DataFrame, states: DataFrame) -> DataFrame:
    """Each fenced write with `accepted`, `superseded` or `invalid`: accepted inside a claim interval of the token it
    carries.

    The intervals travel as an array of at most max_attempts on the file's state row, so this is one equi join.
    """
    judged = _judged(events.withColumn("_kind", F.col("kind"))).filter(F.col("_kind").isin(*FENCED))
    writes = judged.select("file_id", "ts_us", "seq", F.col("_kind").alias("kind"), "token",
                           (F.col("kind") == "invalid").alias("_invalid"))
    owned = owns_claim(F.col("wins"), F.col("token"), F.col("ts_us"), F.col("seq"))
    return writes.join(states.select("file_id", "wins"), "file_id").select(
        "file_id", "seq", "kind", "token",
        F.when(F.col("_invalid"), "invalid").when(owned, "accepted").otherwise("superseded")
        .alias("result"))


def confirm_results(events: DataFrame) -> DataFrame:
    """Each confirm request: did it make the transition, or find the file already past uploading or cancelled?

    The first confirm-or-cancel of a file decides; later ones change nothing.
    """
    deciding = events.filter(F.col("kind").isin("confirm", "cancel"))
    first = deciding.groupBy("file_id").agg(F.min(F.struct("ts_us", "seq")).alias("first"))
    return deciding.filter(F.col("kind") == "confirm").join(first, "file_id").select(
        "file_id", "seq",
        ((F.col("first.ts_us") == F.col("ts_us")) & (F.col("first.seq") == F.col("seq"))).alias("transitioned"))


def finish_outcomes(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """Decide finish requests from the candidate rows.

    `requests`: file_id, is_archive, entries_total, status, status_message; `counts`: file_id, total, rejected. An
    archive must have exactly entries_total candidates; `processed` turns `partial` when a candidate is rejected.
    """
    joined = requests.join(counts, "file_id", "left").fillna({"total": 0, "rejected": 0})
    good = F.col("status").isin("processed", "partial")
    uneven = good & F.col("is_archive") & ~F.col("total").eqNullSafe(F.col("entries_total").cast("bigint"))
    unknown = ~F.col("status").isin(*M.TERMINAL)
    return joined.select(
        "file_id", F.col("status").alias("requested"),
        F.when(unknown | uneven, F.lit(None)).when((F.col("status") == "processed") & (F.col("rejected") > 0), "partial")
        .otherwise(F.col("status")).alias("stored"),
        F.when(unknown, "not a terminal status").when(uneven, F.concat(
            F.lit("archive has "), F.col("total").cast("string"), F.lit(" candidates but entries_total is "),
            F.coalesce(F.col("entries_total").cast("string"), F.lit("None")))).alias("refused"),
        (F.col("is_archive") & (F.col("status") == "rejected")).alias("rejects_candidates"))


def reject_candidates_of(candidates: DataFrame, rejected_files: DataFrame) -> DataFrame:
    """Candidates after archives were rejected: processed ones lose their key and take the archive's reason."""
    files = rejected_files.select(F.col("file_id").alias("source_file_id"), F.col("status_message").alias("_why"),
                                  F.lit(True).alias("_hit"))
    joined = candidates.join(files, "source_file_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("status") == "processed")
    reason = F.when(F.col("_why").isNull(), M.ARCHIVE_REJECTED).otherwise(
        F.concat(F.lit(M.ARCHIVE_REJECTED + ": "), F.col("_why")))
    changed = {"status": F.when(hit, "rejected").otherwise(F.col("status")),
               "s3_key": F.when(~hit, F.col("s3_key")),
               "reject_reason": F.when(hit, truncate_message(reason)).otherwise(F.col("reject_reason"))}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in candidates.columns])


def classify_failures(failures: DataFrame) -> DataFrame:
    """Add `failure_class` from `origin`, `code` and `http_status`.

    storage: not_found / config / transient; api: transient / superseded / config / contract;
    transport and storage_transport: transient. Anything else is a bug.
    """
    code, status = F.col("code"), F.coalesce(F.col("http_status"), F.lit(0))
    storage = (F.when(code.isin(*M.NOT_FOUND_CODES), "not_found")
               .when(code.isin(*M.DENIED_CODES) | (status == 403), "config")
               .when((status >= 500) | code.isin(*M.THROTTLED_CODES), "transient").otherwise("config"))
    api = (F.when(status >= 500, "transient").when((status == 409) & (code == "claim_superseded"), "superseded")
           .when(status == 401, "config").otherwise("contract"))
    return failures.withColumn("failure_class", F.when(F.col("origin") == "storage", storage)
                               .when(F.col("origin") == "api", api)
                               .when(F.col("origin").isin("transport", "storage_transport"), "transient")
                               .when(F.col("origin") == "content", "rejected").otherwise("bug"))


def attempt_outcomes(failures: DataFrame, ages: Ages = AGES) -> DataFrame:
    """What a failed attempt leads to: (action, final_status, status_message, countdown)."""
    kind, attempt = F.col("failure_class"), F.col("attempt")
    last = attempt >= ages.max_attempts
    retry = (kind == "transient") & ~last
    return failures.select(
        "*",
        F.when(kind.isin("rejected", "not_found") | ((kind == "transient") & last), "finish")
        .when(retry, "release_and_retry").when(kind == "superseded", "stop").otherwise("leave").alias("action"),
        F.when(kind == "rejected", "rejected").when((kind == "not_found") | ((kind == "transient") & last), "error")
        .alias("final_status"),
        truncate_message(
            F.when(kind == "rejected", F.col("detail")).when(kind == "not_found", M.OBJECT_MISSING)
            .when((kind == "transient") & last, F.concat(F.lit("Could not be processed after "), attempt.cast("string"),
                                                          F.lit(" attempts: "), F.col("detail")))).alias("status_message"),
        F.when(retry, (F.pow(F.lit(2), attempt) * 5).cast("bigint")).alias("countdown"))
