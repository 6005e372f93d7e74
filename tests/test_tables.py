"""Candidate writes, admission, review, metrics and quality rules on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.operators import admission, candidates, metrics, objects, quality, review
from folioworks.settings import MIB, UploadLimits

WRITE = ("source_file_id string, source_entry_name string, video_script_seq int, entry_index int, file_name string, "
         "file_ext string, size_bytes bigint, content_hash string, s3_key string, status string, reject_reason string, seq bigint")


def write(seq, entry="e", index=0, name="a.docx", size=1, status="processed"):
    good = status == "processed"
    return ("f", entry, None, index, name, "docx", size, "h" if good else None, "k" if good else None, status, None if good else "why", seq)


def test_upsert_keeps_the_first_identity_and_the_last_payload(spark):
    rows = [write(1, size=1), write(2, size=2), write(3, index=5, size=3), write(4, size=4, status="rejected"),
            write(5, name="b.docx", size=5), write(6, None, None, size=6), write(7, None, None, size=7)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, WRITE)
    got = {r.source_entry_name: (r.entry_index, r.size_bytes, r.status, r.s3_key, r.seq) for r in candidates.upsert(df).collect()}
    assert got == {"e": (0, 4, "rejected", None, 4), None: (None, 7, "processed", "k", 7)}
    refused = {(r.entry_index, r.file_name): r.writes for r in candidates.mismatches(df).collect()}
    assert refused == {(5, "a.docx"): 1, (0, "b.docx"): 1}


def test_folds_merge_in_any_grouping(spark):
    rng = random.Random(2)
    rows = [write(i, rng.choice(["e", "g", None]), rng.choice([0, 0, 1]), size=i) for i in range(60)]
    whole = candidates.upsert(spark.createDataFrame(rows, WRITE))
    parts = [candidates.fold_writes(spark.createDataFrame(rows[i::3], WRITE)) for i in range(3)]
    merged = candidates.resolve(candidates.merge_folds(parts[2].unionByName(parts[0]).unionByName(parts[1])))
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


@pytest.mark.parametrize("change, error", [
    ({}, None), ({"s3_key": None}, "processed needs a key and no reason"), ({"reject_reason": "x"}, "processed needs a key and no reason"),
    ({"content_hash": None}, "processed needs a content hash"), ({"status": "new"}, "unknown status"),
    ({"status": "rejected"}, "rejected needs a reason and no key"), ({"entry_index": None}, "entry name and index go together"),
    ({"status": "rejected", "s3_key": None, "reject_reason": "x", "content_hash": None}, None)])
def test_validity(spark, change, error):
    base = dict(status="processed", s3_key="k", reject_reason=None, content_hash="h", source_entry_name="e", entry_index=1)
    df = spark.createDataFrame([tuple({**base, **change}.values())],
                               "status string, s3_key string, reject_reason string, content_hash string, source_entry_name string, entry_index int")
    marked = df.withColumn("error", candidates.validity_error())
    valid, quarantined = marked.filter("error IS NULL"), marked.filter("error IS NOT NULL")
    assert [r.error for r in quarantined.collect()] == ([error] if error else [])
    assert valid.count() == (0 if error else 1)


def test_admission_order(spark):
    limits = UploadLimits()
    big = limits.max_bytes + 1
    rows = [("1", "b", "x.exe", big), ("2", "b", "x.exe", 1), ("3", "b", "Known.docx", 7), ("4", "shut", "new.docx", 1),
            ("5", "b", "new.docx", limits.max_bytes), ("6", "fresh", ".docx", 1), ("7", "old", "a.ZIP", 1)]
    requests = spark.createDataFrame([(i, "o", b, n, s) for i, b, n, s in rows],
                                     "request_id string, organization_id string, batch_id string, file_name string, size_bytes bigint")
    library = spark.createDataFrame([("d", "o", "known.docx", 7)], "document_id string, organization_id string, file_name_norm string, size_bytes bigint")
    batches = spark.createDataFrame([("b", "o", 0, "in_progress"), ("shut", "o", 0, "committed"), ("old", "o", 0, "abandoned")],
                                    "batch_id string, organization_id string, created_by bigint, status string")
    out = admission.admit(requests, library, batches)
    assert {r.request_id: (r.http_status, r.detail) for r in out.collect()} == {
        "1": (413, "File exceeds the 5120 MB limit for cloud uploads."), "2": (400, "Unsupported file type: x.exe"),
        "3": (409, "Duplicate file — Known.docx has already been uploaded."), "4": (409, "Batch shut is already committed."),
        "5": (None, None), "6": (400, "Unsupported file type: .docx"), "7": (409, "Batch old is already abandoned.")}
    assert [(r.file_id, r.s3_key, r.status) for r in admission.register(out).collect()] == [("5", "incoming/o/b/5_new.docx", "staged")]
    after = admission.ensure_batches(batches, requests)
    assert {r.batch_id: r.status for r in after.collect()} == {"b": "in_progress", "shut": "committed", "old": "abandoned", "fresh": "in_progress"}
    assert sorted(map(str, admission.ensure_batches(after, requests).collect())) == sorted(map(str, after.collect()))
    assert [r.batch_id for r in admission.unknown_ids(requests, batches, "batch_id").collect()] == ["fresh"]


def test_queue(spark):
    rows = [(0, "a.docx", 5), (1, "A.DOCX", 5), (2, "a.docx", 6), (3, "q.pdf", 1), (4, "x", 1), (5, "x.exe", 1), (6, "e.zip", 0),
            (7, "b.zip", 6 * 1024 ** 3)]
    got = admission.queue_validation(spark.createDataFrame(rows, "position int, file_name string, size_bytes bigint"),
                                     spark.createDataFrame([("Q.pdf", 1)], "file_name string, size_bytes bigint"))
    assert [r.error for r in got.orderBy("position").collect()] == [
        None, "Duplicate file — A.DOCX is already in the upload queue.", None, "Duplicate file — q.pdf is already in the upload queue.",
        "Unsupported file type. Supported formats: DOCX, PDF, ZIP.", ".exe is not a supported format", "File is empty.",
        "File exceeds the maximum size of 5.0 GB."]
    items = spark.createDataFrame([("queued", True, "docx", True, None), ("queued", True, "docx", True, "failed"), ("queued", True, "docx", True, "uploading"),
                                   ("validation-failed", True, "docx", True, None), ("queued", False, "docx", True, None),
                                   ("queued", True, None, True, None), ("queued", None, "docx", False, None)],
                                  "s string, v boolean, e string, d boolean, c string")
    flags = items.select(admission.can_start(*[F.col(c) for c in "svedc"]))
    assert [r[0] for r in flags.collect()] == [True, True, False, False, False, False, False]


def test_parts_and_progress(spark):
    files = spark.createDataFrame([("z", 0), ("one", 8 * MIB), ("two", 8 * MIB + 1)], "file_id string, size_bytes bigint")
    got = [(r.file_id, r.part_number, r.start, r.end) for r in admission.part_plan(files).orderBy("file_id", "part_number").collect()]
    assert got == [("one", 1, 0, 8 * MIB), ("two", 1, 0, 8 * MIB), ("two", 2, 8 * MIB, 8 * MIB + 1), ("z", 1, 0, 0)]
    parts = spark.createDataFrame([("a", 1, 8), ("b", 300, 100), ("c", 0, 0)], "file_id string, uploaded bigint, size bigint")
    assert {r.file_id: r.percent for r in admission.upload_progress(parts).collect()} == {"a": 13, "b": 100, "c": 100}


def test_seeding_and_lookup(spark):
    objects_ = spark.createDataFrame([("incoming/o/a.zip", 1), ("incoming/o/a.exe", 1), ("other/a.pdf", 1)], "key string, length bigint")
    assert [(r.file_name, r.is_archive, r.error) for r in admission.seed_files(objects_, "b", "o").collect()] == [
        ("a.zip", True, None), ("a.exe", False, "'a.exe': extension not allowed (allowed: docx, pdf, zip)"),
        ("a.pdf", False, "'other/a.pdf': s3_key must be under incoming/")]
    files = spark.createDataFrame([("u1", "k1", "f1", "staged"), ("u2", "k2", "f2", "processed")], "upload_id string, s3_key string, file_id string, status string")
    asked = spark.createDataFrame([("u1", "k1"), ("u1", "k2"), ("u2", "k2")], "upload_id string, s3_key string")
    assert sorted(r.result for r in admission.upload_lookup(asked, files).collect()) == ["404 Upload not found.", "done", "open"]


def test_status_labels(spark):
    rows = [("staged", None, None, 0, None), ("processing", None, 5, 2, None), ("uploaded", None, None, 0, None), ("processed", None, 1, 1, None),
            ("partial", None, 5, 5, (3, 5)), ("partial", None, 5, 5, None), ("rejected", "why", 1, 0, None), ("rejected", None, 1, 0, None),
            ("error", M.CANCELLED, None, 0, (1, 1)), ("error", "boom", 5, 2, (2, 2)), ("error", "boom", 5, 2, None), ("error", None, None, 0, (0, 1))]
    files = spark.createDataFrame([(f"{i:02d}", s, m, t, d) for i, (s, m, t, d, _) in enumerate(rows)],
                                  "file_id string, status string, status_message string, entries_total int, entries_done int")
    counts = spark.createDataFrame([(f"{i:02d}", *c) for i, (*_, c) in enumerate(rows) if c], "source_file_id string, processed bigint, total bigint")
    got = [(r.label, r.tone) for r in review.status_label(files, counts).orderBy("file_id").collect()]
    assert got == [(None, None), ("Checking… — 2 of 5", "progress"), ("Checking…", "progress"), ("Ready", "success"),
                   ("Partly ready — 3 of 5", "warning"), ("Partly ready", "warning"), ("Rejected — why", "danger"),
                   ("Rejected — not accepted", "danger"), ("Cancelled", "muted"), ("Failed part-way — 2 staged", "danger"),
                   ("Failed — boom", "danger"), ("Failed — could not be processed", "danger")]


def test_batch_status_and_action(spark):
    files = spark.createDataFrame([("f1", "b", "partial"), ("f2", "b", "processing"), ("f3", "c", "staged"), ("f4", "d", "error"), ("f5", "e", "error")],
                                  "file_id string, batch_id string, status string")
    cands = spark.createDataFrame([("f1", "processed", None), ("f1", "processed", "d9"), ("f1", "rejected", None), ("f2", "processed", None),
                                   ("f4", "rejected", None)], "source_file_id string, status string, duplicate_of_document_id string")
    status = review.batch_status(files, cands)
    assert {r.batch_id: tuple(r)[1:] for r in status.collect()} == {"b": (2, 1, 3, 1), "c": (1, 1, 0, 0), "d": (1, 0, 1, 0), "e": (1, 0, 0, 0)}
    assert {r.batch_id: (r.label, r.enabled, r.visible) for r in review.review_action(status).collect()} == {
        "b": ("Add 1 to library", True, True), "c": ("Waiting for 1 file…", False, True), "d": ("Done", True, True), "e": ("", False, False)}
    classes = cands.select(review.review_class()).collect()
    assert [r[0] for r in classes] == ["ready", "duplicate", "rejected", "ready", "rejected"]
    old = spark.createDataFrame([("f1", 9, 9), ("gone", 2, 3)], "source_file_id string, processed bigint, total bigint")
    carried = review.carry_counts(review.file_candidate_counts(cands), old)
    assert {r.source_file_id: (r.processed, r.total) for r in carried.collect()} == {"f1": (2, 3), "f2": (1, 1), "f4": (0, 1), "gone": (2, 3)}


def test_log_metrics(spark):
    line = "event string, file_id string, ts_us bigint, task_id string, attempt int, countdown int, entry_index int, pid int, file_ids array<string>, reset int, requeued int, errored int, enqueue_failed int"
    def row(event, file_id, at, task=None, attempt=None, countdown=None, entry=None, ids=None, reset=None):
        return (event, file_id, at, task, attempt, countdown, entry, 1, ids, reset, None, None, None)
    rows = [row("enqueued", "f", 10), row("claim_ok", "f", 5, "t0"), row("claim_ok", "f", 12, "t1", 1), row("claim_lost", "f", 13, "t2"),
            row("claim_lost", "f", 14, "t2"), row("retrying", "f", 20, attempt=1, countdown=10), row("stale_sweep", None, 19, ids=["f"], reset=1),
            row("stale_sweep", None, 25, ids=["f", "g"], reset=2), row("claim_ok", "f", 24, "t3"), row("claim_ok", "f", 26, "t4", 2),
            row("entry_staged", "f", 27, attempt=2, entry=4), row("entry_rejected", "f", 28, attempt=2, entry=3), row("enqueued", "h", 1)]
    df = spark.createDataFrame(rows, line)
    assert [tuple(r) for r in metrics.confirm_to_claim(df).collect()] == [("f", 10, 12, 2)]
    assert [tuple(r) for r in metrics.recovery_timeline(df).collect()] == [("f", 20, 25, 26)]
    assert [tuple(r) for r in metrics.claim_counts(df).collect()] == [("f", 4, 2, 5)]
    assert [tuple(r)[:4] for r in metrics.retry_check(df).collect()] == [("f", 4, 1, 0)]
    points = metrics.resume_point(df)
    assert [tuple(r) for r in points.collect()] == [("f", 3)]
    for k, fine in ((3, True), (4, True), (5, False)):
        kills = spark.createDataFrame([("f", k)], "file_id string, killed_at_entry int")
        assert metrics.check_resume(points, kills).first().as_expected is fine
    totals = metrics.sweep_totals(df).first()
    assert (totals.sweeps, totals.reset, totals.requeued, totals.files) == (2, 3, 0, 2)
    assert [r.file_id for r in metrics.sweep_coverage(df).collect()] == ["h"]
    assert metrics.merge_snapshots(df, df.filter("ts_us > 12")).count() == len(rows)


def test_objects(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "key string")
    actual = spark.createDataFrame([("b",), ("c",)], "key string")
    assert {r.key: r.problem for r in objects.orphan_objects(expected, actual).collect()} == {"a": "missing", "c": "orphan"}
    day = 86_400_000_000
    keys = [("incoming/a", day, True), ("incoming/b", day - 1, True), ("staging/a", 7 * day, True), ("staging/b", 6 * day, True),
            ("processed/a", 99 * day, True), ("processed/part", day, False)]
    manifest = spark.createDataFrame([(k, 100 * day - age, c) for k, age, c in keys], "key string, modified_us bigint, complete boolean")
    assert {r.key: r.rule for r in objects.retention_expired(manifest, 100 * day).collect()} == {
        "incoming/a": "expire-incoming", "staging/a": "expire-staging", "processed/part": "abort-incomplete-multipart"}
    staged = spark.createDataFrame([("staging/o/b/f1/0000_a",), ("staging/o/b/f2/0000_a",), ("incoming/o/b/f1_a",)], "key string")
    files = spark.createDataFrame([("b", "f1")], "batch_id string, file_id string")
    assert [r.key for r in objects.purge_rejected(staged, files).collect()] == ["staging/o/b/f1/0000_a"]


def test_purge_batches(spark):
    batches = spark.createDataFrame([("b1",), ("b2",)], "batch_id string")
    files = spark.createDataFrame([("f1", "b1"), ("f2", "b2")], "file_id string, batch_id string")
    cands = spark.createDataFrame([("s1", "b1"), ("s2", "b2")], "staged_id string, batch_id string")
    library = spark.createDataFrame([("d1", "f1"), ("d2", "f2"), ("d3", None)], "document_id string, source_file_id string")
    left = candidates.purge_batches(batches, files, cands, library, batches.filter("batch_id = 'b1'"))
    assert {k: v.count() for k, v in left.items()} == {"batches": 1, "files": 1, "candidates": 1, "library": 3}
    assert {r.document_id: r.source_file_id for r in left["library"].collect()} == {"d1": None, "d2": "f2", "d3": None}


def test_quality_rules(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("b", "x"), ("c", "y")], "f string, e string")
    assert {tuple(r) for r in quality.repeated_keys(rows, ["f", "e"]).collect()} == {("a", None, 2), ("b", "x", 2)}
    assert {tuple(r) for r in quality.repeated_keys(rows, ["e"], nulls_equal=False).collect()} == {("x", 2)}
    targets = spark.createDataFrame([("new", None, True), ("new", "d", True), ("replace", "d", False), ("replace", "d", True), ("replace", None, False),
                                     (None, None, False)], "intent string, replaces_document_id string, is_archive boolean")
    assert [r[0] for r in targets.select(quality.replace_target_ok()).collect()] == [True, False, True, False, False, True]
    files = spark.createDataFrame([("f", "b", "processed"), ("g", "b", "odd"), ("h", "b", None)], "file_id string, batch_id string, status string")
    assert [tuple(r) for r in quality.enum_violations({"file": files}).collect()] == [("file.status", "odd", 1)]
    kids = spark.createDataFrame([("f",), ("x",), (None,)], "k string")
    assert [tuple(r) for r in quality.orphans(kids, "k", files, "file_id", "kid.k").collect()] == [("kid.k", "x", 1)]
    fields = spark.createDataFrame([("1", "n" * 513, "docx", "A" * 64, -1, -2), ("2", "n", "docx", "a" * 64, 0, 0)],
                                   "id string, file_name string, file_ext string, content_hash string, entry_index int, size_bytes bigint")
    assert {r.rule for r in quality.field_violations(fields, "id").collect()} == {
        "file_name longer than 512", "content_hash is no SHA-256", "entry_index negative", "size_bytes negative"}
    claims = spark.createDataFrame([("f", True, 1), ("f", True, 2), ("g", True, 1), ("g", True, 1), ("h", False, None)], "file_id string, won boolean, attempt int")
    assert {r.file_id: r.consistent for r in quality.claim_violations(claims, 3).collect()} == {"f": True, "g": False}
