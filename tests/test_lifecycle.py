"""One rule table, four readers: plain loop, batch fold, phases for huge histories, keyed stream."""

import random

import pytest
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.operators import lifecycle as L
from folioworks.operators import sweeps
from folioworks.settings import Ages
from folioworks.streaming import jobs

AGES = Ages(stale_seconds=30, max_attempts=3)
PROGRESS = ("entries_total", "entries_done", "detected_type")
FIELDS = ("status", "status_message", "attempt_count", "claim_token", "heartbeat_us", "uploaded_us", *PROGRESS)
NEW_FILE = {**dict.fromkeys(FIELDS), "status": "staged", "attempt_count": 0, "entries_done": 0}


def apply_event(state: dict, event: dict, ages: Ages) -> dict:
    """State after one event, one dict at a time."""
    kind, at, token = event["kind"], event["ts_us"], event["token"]
    if kind == "claim":
        silent = state["status"] == "processing" and state["heartbeat_us"] < at - ages.stale_seconds * 1_000_000
        if state["attempt_count"] < ages.max_attempts and (state["status"] == "uploaded" or silent):
            return {**state, "status": "processing", "attempt_count": state["attempt_count"] + 1,
                    "claim_token": token, "heartbeat_us": at}
        return state
    rule = L.RULES.get(kind)
    if rule is None or state["status"] not in rule.sources:
        return state
    if rule.fenced and (token is None or token != state["claim_token"]):
        return state
    if kind == "finish" and event["status"] not in M.TERMINAL:
        return state
    if kind == "progress" and all(event[name] is None for name in PROGRESS):
        return state
    after = dict(state)
    if rule.to:
        after["status"] = event["status"] if rule.to == "event" else rule.to
    if rule.message:
        after["status_message"] = event["message"] if rule.message == "event" else rule.message
    if rule.stamps:
        after[rule.stamps] = at
    if rule.ends_claim:
        after["claim_token"] = None
    if kind == "progress":
        for name in PROGRESS:
            if event[name] is not None:
                after[name] = event[name]
    return after


SCHEMA = ("file_id string, ts_us bigint, seq bigint, kind string, token string, status string, message string, "
          "entries_total int, entries_done int, detected_type string")


def histories(seed, files=40, longest=60):
    rng, rows, seq = random.Random(seed), [], 0
    for f in range(files):
        at = 0
        for _ in range(rng.randint(1, longest)):
            at += rng.choice([1, 5, 12, 40]) * 1_000_000
            seq += 1
            kind = rng.choices([*L.RULES, "claim"], [1, 4, 1, 9, 4, 2, 1, 8])[0]
            token = None if kind in ("uploading", "confirm", "cancel") else rng.choice("ab")
            status = rng.choice([*M.TERMINAL, "uploaded", None]) if kind == "finish" else None
            prog = kind == "progress"
            rows.append((f"f{f}", at, seq, kind, token, status, "done" if status else None,
                         rng.choice([None, 9]) if prog else None, rng.choice([None, 1, 2]) if prog else None,
                         rng.choice([None, "zip"]) if prog else None))
    return rows


def by_loop(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    states, results = {}, {}
    for row in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        event = dict(zip(names, row))
        before = states.get(event["file_id"], NEW_FILE)
        after = apply_event(before, event, AGES)
        results[event["seq"]] = after is not before
        states[event["file_id"]] = after
    return states, results


def as_dict(frame):
    return {r.file_id: {n: r[n] for n in FIELDS} for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("fold_rows", [100_000, 8])
def test_fold_and_phases_equal_the_loop(spark, seed, fold_rows):
    rows = histories(seed)
    events = spark.createDataFrame(rows, SCHEMA)
    states = L.lifecycle_state(events, AGES, fold_rows)
    want, results = by_loop(rows)
    assert as_dict(states) == want
    assert {r.seq: r.won for r in L.claim_results(events, states).collect()} == {
        r[2]: results[r[2]] for r in rows if r[3] == "claim"}
    assert {r.seq: r.result == "accepted" for r in L.fenced_writes(events, states).collect()} == {
        r[2]: results[r[2]] for r in rows if r[3] in L.FENCED}
    assert {r.seq: r.transitioned for r in L.confirm_results(events).collect()} == {
        r[2]: results[r[2]] for r in rows if r[3] == "confirm"}


def test_one_winner_among_simultaneous_claims(spark):
    rows = [("f", 1, 1, "confirm", None, None, None, None, None, None)] + [
        ("f", 2, 10 + i, "claim", f"w{i}", None, None, None, None, None) for i in range(10)]
    random.Random(1).shuffle(rows)
    events = spark.createDataFrame(rows, SCHEMA)
    won = L.claim_results(events, L.lifecycle_state(events, AGES)).filter("won").collect()
    assert [(r.seq, r.attempt) for r in won] == [(10, 1)]


def test_stale_claim_limit_is_strict(spark):
    base = [("confirm", 0), ("claim", 1)]
    for gap, wins in ((30_000_000, 1), (30_000_001, 2)):
        rows = [("f", at, i, k, "w", None, None, None, None, None) for i, (k, at) in enumerate(base + [("claim", 1 + gap)])]
        events = spark.createDataFrame(rows, SCHEMA)
        assert L.claim_results(events, L.lifecycle_state(events, AGES)).filter("won").count() == wins


def test_stream_equals_fold_over_several_files_of_events(spark, tmp_path):
    rows = histories(9, files=15, longest=30)
    order = sorted(rows, key=lambda r: r[1])
    schema = spark.createDataFrame(rows, SCHEMA).schema
    for part in range(3):                                   # three triggers, in order
        spark.createDataFrame(order[part::1][part * len(order) // 3 - part:(part + 1) * len(order) // 3 - part], SCHEMA
                              ).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/p={part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    table = jobs.run_lifecycle(stream, spark, AGES)
    assert as_dict(jobs.read_states(spark, table)) == by_loop(rows)[0]
    closed = jobs.run_lifecycle(stream, spark, AGES, str(tmp_path / "kept"), keep_us=1)
    assert as_dict(jobs.read_states(spark, closed)) == by_loop(rows)[0]


def test_late_events_are_counted_and_change_nothing(spark):
    rows = sorted(histories(4, files=6, longest=20), key=lambda r: r[1])
    half = len(rows) // 2
    first = L.advance(spark.createDataFrame(rows[:half], SCHEMA), AGES)
    again = L.advance(spark.createDataFrame(rows[half:] + rows[:5], SCHEMA), AGES, first)
    assert as_dict(again.select("file_id", "state.*")) == by_loop(rows)[0]
    assert again.agg(F.sum("late")).first()[0] == 5


def test_sweeps(spark):
    now = 1_000_000_000
    old, new = now - 31_000_000, now - 30_000_000
    rows = [("a", "processing", 1, old, None, 0), ("b", "processing", 3, old, None, 0), ("c", "processing", 1, new, None, 0),
            ("d", "processing", 1, None, None, 0), ("e", "uploaded", 0, None, old, 0), ("f", "uploaded", 3, None, old, 0),
            ("g", "uploaded", 0, None, new, 0), ("h", "staged", 0, None, None, now - 3_600_000_001),
            ("i", "uploading", 0, None, None, now - 3_600_000_000)]
    files = spark.createDataFrame([(*r, None, "t") for r in rows], "file_id string, status string, attempt_count int, "
                                  "heartbeat_us bigint, uploaded_us bigint, created_us bigint, status_message string, claim_token string")
    stale = sweeps.stale_sweep(files, now)
    assert {r.file_id: (r.action, r.new_status, r.new_uploaded_us, r.new_message) for r in stale.collect()} == {
        "a": ("reset", "uploaded", now, None), "b": ("errored", "error", None, M.ATTEMPTS_SPENT)}
    assert {r.file_id: r.action for r in sweeps.reconcile_sweep(files, now).collect()} == {"e": "requeued", "f": "errored"}
    assert [(r.file_id, r.new_message) for r in sweeps.abandoned_sweep(files, now).collect()] == [("h", M.ABANDONED)]
    after = {r.file_id: r for r in sweeps.apply_sweep(files, stale).collect()}
    assert (after["a"].status, after["a"].uploaded_us, after["a"].claim_token) == ("uploaded", now, None)
    assert (after["c"].status, after["c"].claim_token) == ("processing", "t")
    again = sweeps.stale_sweep(sweeps.apply_sweep(files, stale), now)
    assert again.count() == 0
    assert {r.action: r.files for r in sweeps.sweep_counts(stale).collect()} == {"reset": 1, "errored": 1}


def test_finish_rules(spark):
    requests = spark.createDataFrame([("ok", True, 2, "processed", None), ("some", True, 3, "processed", None),
                                      ("keep", True, 2, "partial", None), ("short", True, 4, "processed", None),
                                      ("single", False, None, "processed", None), ("bad", True, 1, "uploaded", None),
                                      ("rej", True, 9, "rejected", "x")],
                                     "file_id string, is_archive boolean, entries_total int, status string, status_message string")
    counts = spark.createDataFrame([("ok", 2, 0), ("some", 3, 1), ("keep", 2, 0), ("short", 3, 0), ("single", 1, 0)],
                                   "file_id string, total bigint, rejected bigint")
    got = {r.file_id: (r.stored, r.refused, r.rejects_candidates) for r in L.finish_outcomes(requests, counts).collect()}
    assert got == {"ok": ("processed", None, False), "some": ("partial", None, False), "keep": ("partial", None, False),
                   "short": (None, "archive has 3 candidates but entries_total is 4", False),
                   "single": ("processed", None, False), "bad": (None, "not a terminal status", False),
                   "rej": ("rejected", None, True)}
    cands = spark.createDataFrame([("rej", "processed", "k", None), ("rej", "rejected", None, "own"), ("ok", "processed", "k", None)],
                                  "source_file_id string, status string, s3_key string, reject_reason string")
    rejected = requests.filter("status = 'rejected'")
    assert sorted(tuple(r) for r in L.reject_candidates_of(cands, rejected).fillna("-").collect()) == [
        ("ok", "processed", "k", "-"), ("rej", "rejected", "-", "Archive rejected: x"), ("rej", "rejected", "-", "own")]


def test_failures(spark):
    rows = [("storage", "NoSuchKey", 404, 1), ("storage", "SlowDown", 400, 2), ("storage", "x", 503, 3), ("storage", "x", 403, 1),
            ("storage", "Other", 400, 1), ("api", "claim_superseded", 409, 1), ("api", None, 502, 1), ("api", None, 401, 1),
            ("api", "bad", 422, 1), ("transport", None, None, 1), ("content", None, None, 1), ("code", None, None, 1)]
    df = spark.createDataFrame([(*r, "why") for r in rows], "origin string, code string, http_status int, attempt int, detail string")
    got = L.attempt_outcomes(L.classify_failures(df), AGES)
    assert [(r.failure_class, r.action, r.countdown) for r in got.collect()] == [
        ("not_found", "finish", None), ("transient", "release_and_retry", 20), ("transient", "finish", None),
        ("config", "leave", None), ("config", "leave", None), ("superseded", "stop", None),
        ("transient", "release_and_retry", 10), ("config", "leave", None), ("contract", "leave", None),
        ("transient", "release_and_retry", 10), ("rejected", "finish", None), ("bug", "leave", None)]
    assert got.filter("attempt = 3").first().status_message == "Could not be processed after 3 attempts: why"
