"""Objects that cannot be read end or delay one file; interrupted extraction goes on where it stopped; object plans report."""

import errno
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from folioworks.plans import ingest
from folioworks.sources import archives as S
from folioworks.sources import objects as O

UPLOADS = "file_id string, organization_id string, batch_id string, file_name string, file_ext string, path string, attempt int"


def upload(spark, *rows):
    """rows: (file_id, path, attempt)"""
    return spark.createDataFrame([(i, "o", "b", os.path.basename(p), str(p).rsplit(".", 1)[-1], str(p), n) for i, p, n in rows], UPLOADS)


def archive(path, n, name="f"):
    with zipfile.ZipFile(path, "w") as box:
        for k in range(n):
            box.writestr(f"d/{name}{k}.pdf", f"%PDF-{name} {k}")
    return str(path)


@pytest.mark.parametrize("problem,origin,code,status", [
    (FileNotFoundError(2, "gone"), "storage", "NoSuchKey", 404),
    (PermissionError(13, "no"), "storage", "AccessDenied", 403),
    (OSError("When reading information for key 'a' in bucket 'b': AWS Error ACCESS_DENIED during HeadObject operation: No response body."),
     "storage", "AccessDenied", None),
    (OSError("AWS Error SLOW_DOWN (HTTP status 503) during GetObject operation"), "storage", "SlowDown", 503),
    (OSError("AWS Error NETWORK_CONNECTION during GetObject operation: curlCode: 28"), "storage_transport", "OSError", None),
    (TimeoutError(errno.ETIMEDOUT, "slow"), "storage_transport", "ETIMEDOUT", None),
    (OSError("path is a directory"), "storage_transport", "OSError", None)])
def test_failure_of(problem, origin, code, status):
    found = O.failure_of(problem)
    assert (found["origin"], found["code"], found["http_status"]) == (origin, code, status)


def test_own_machine_s_trouble_is_raised():
    with pytest.raises(OSError):
        O.failure_of(OSError(errno.ENOSPC, "full"))


def test_failures_end_or_delay_their_own_file(spark, tmp_path):
    good = archive(tmp_path / "good.zip", 3)
    (tmp_path / "one.pdf").write_bytes(b"%PDF-one")
    for name in ("dir.zip", "dir2.zip", "dir.pdf"):
        (tmp_path / name).mkdir()
    rows = [("good", good, 1), ("one", tmp_path / "one.pdf", 1), ("gone", tmp_path / "gone.zip", 1), ("gone2", tmp_path / "gone.pdf", 2),
            ("wait", tmp_path / "dir.zip", 2), ("spent", tmp_path / "dir2.zip", 3), ("wait2", tmp_path / "dir.pdf", 1)]
    uploads = upload(spark, *rows)
    done = ingest.process_attempts(uploads)
    files = {r.file_id: (r.status, r.status_message) for r in done.files.collect()}
    assert files == {"good": ("processed", None), "one": ("processed", None), "gone": ("error", "Uploaded object not found"),
                     "gone2": ("error", "Uploaded object not found"),
                     "spent": ("error", "Could not be processed after 3 attempts: reading failed (OSError)")}
    assert {r.source_file_id for r in done.candidates.collect()} == {"good", "one"} and done.candidates.count() == 4
    retries = ingest.next_attempts(done.attempts, 1_000_000)
    assert {tuple(r) for r in retries.collect()} == {("wait", 3, 21_000_000), ("wait2", 2, 11_000_000)}
    # Next time: what is settled stays out, what waits comes when it is due.
    later = {as_of: {(r.file_id, r.attempt) for r in ingest.due(uploads, done.files, retries, as_of).collect()}
             for as_of in (1_000_000, 11_000_000, 21_000_000)}
    assert later == {1_000_000: set(), 11_000_000: {("wait2", 2)}, 21_000_000: {("wait2", 2), ("wait", 3)}}
    (tmp_path / "dir.pdf").rmdir()
    (tmp_path / "dir.pdf").write_bytes(b"%PDF-now")
    again = ingest.process_attempts(ingest.due(uploads, done.files, retries, 11_000_000))
    assert [(r.file_id, r.status) for r in again.files.collect()] == [("wait2", "processed")]


def test_object_that_changes_under_the_reader(spark, tmp_path):
    path = archive(tmp_path / "a.zip", 5)
    paths = spark.createDataFrame([(path,)], "path string")
    wanted = spark.createDataFrame([(path, k) for k in range(5)], "archive string, entry_pos int")
    archive(tmp_path / "a.zip", 2)
    rows = S.zip_extract(wanted, paths).collect()
    assert [r.failure.code for r in rows if r.failure] == ["ObjectChanged"] and sum(r.failure is None for r in rows) == 2
    (tmp_path / "a.zip").write_bytes(b"no archive any more")
    (row,) = S.zip_extract(wanted, paths).collect()
    assert row.failure.code == "ObjectChanged" and row.entry_pos is None


def test_extraction_goes_on_where_it_stopped(spark, tmp_path):
    paths = [archive(tmp_path / f"{k}.zip", 150, f"n{k}-") for k in range(6)]
    uploads = upload(spark, *[(f"f{k}", p, 1) for k, p in enumerate(paths)])
    index = S.zip_index(uploads.select("path"))
    progress, whole = str(tmp_path / "progress"), ingest.process_attempts(uploads)
    S.extract_resumable(index.select("archive", "entry_pos"), uploads.select("path"), progress, waves=4, stop_after=2)
    before = {(r.archive, r.entry_pos) for r in S.read_progress(spark, progress).collect()}
    assert 0 < len(before) < 900
    resumed = ingest.process_attempts(uploads, progress=progress)
    assert sorted(map(tuple, resumed.candidates.collect()), key=str) == sorted(map(tuple, whole.candidates.collect()), key=str)
    assert sorted(map(tuple, resumed.files.collect()), key=str) == sorted(map(tuple, whole.files.collect()), key=str)
    rows = S.read_progress(spark, progress).collect()
    assert len(rows) == 900 == len({(r.archive, r.entry_pos) for r in rows})
    runs = {run: {(r.archive, r.entry_pos) for r in rows if r.run == run} for run in {r.run for r in rows}}
    assert sorted(map(len, runs.values())) == sorted([len(before), 900 - len(before)]) and before in runs.values()
    # Nothing is left: a third run opens no archive, so they may be gone.
    for p in paths:
        os.remove(p)
    left = S.extract_resumable(index.limit(0).select("archive", "entry_pos"), uploads.select("path"), progress)
    assert left.count() == 900


def test_interrupted_archive_keeps_what_it_read(spark, tmp_path):
    """The object vanishes after half of its waves: the file waits or ends, and its entries are not lost for the next attempt."""
    path = archive(tmp_path / "a.zip", 400)
    uploads, progress = upload(spark, ("f", path, 1)), str(tmp_path / "progress")
    wanted = S.zip_index(uploads.select("path")).select("archive", "entry_pos")
    S.extract_resumable(wanted, uploads.select("path"), progress, waves=3, stop_after=1)
    kept = S.read_progress(spark, progress).filter("ok").count()
    os.remove(path)
    found = S.extract_resumable(spark.createDataFrame([(path, k) for k in range(400)], "archive string, entry_pos int"),
                                uploads.select("path"), progress, waves=3)
    assert found.filter("failure is null").count() == kept
    assert {r.failure.code for r in found.filter("failure is not null").collect()} == {"NoSuchKey"}
    archive(tmp_path / "a.zip", 400)
    assert ingest.process_attempts(uploads, progress=progress).candidates.count() == 400


def test_plan_results(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(name.encode() * 3000)
    (tmp_path / "in/folder").mkdir()
    rows = [("copy", f"in/{n}", f"out/x/{n}") for n in ("a", "b", "gone", "folder")] + [("copy", "in/a", "out/x/a")]
    rows += [("delete", f"in/{n}", None) for n in ("a", "c", "gone", "folder", "never")]
    plan = spark.createDataFrame(rows, "op string, src string, dst string")
    first = {(r.op, r.src): (r.outcome, r.failure and r.failure.code) for r in O.execute_plan(plan, f"file:{tmp_path}").collect()}
    assert first == {("copy", "in/a"): ("done", None), ("copy", "in/b"): ("done", None), ("copy", "in/gone"): ("failed", "NoSuchKey"),
                     ("copy", "in/folder"): ("failed", "OSError"), ("delete", "in/a"): ("done", None), ("delete", "in/c"): ("done", None),
                     ("delete", "in/gone"): ("held back", None), ("delete", "in/folder"): ("held back", None),
                     ("delete", "in/never"): ("already done", None)}
    second = {(r.op, r.src): r.outcome for r in O.execute_plan(plan, f"file:{tmp_path}").collect()}
    assert second["copy", "in/a"] == second["copy", "in/b"] == second["delete", "in/c"] == "already done"
    assert sorted(os.listdir(tmp_path / "in")) == ["b", "folder"] and sorted(os.listdir(tmp_path / "out/x")) == ["a", "b"]
    with pytest.raises(OSError, match="NoSuchKey"):
        O.run_object_plan(plan, f"file:{tmp_path}")
    assert O.execute_plan(plan.limit(0), str(tmp_path)).count() == 0


def test_half_a_copy_is_made_again(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"whole")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/a").write_bytes(b"who")
    plan = spark.createDataFrame([("copy", "a", "out/a")], "op string, src string, dst string")
    assert O.execute_plan(plan, str(tmp_path)).first().outcome == "done" and (tmp_path / "out/a").read_bytes() == b"whole"


def test_manifest_of_failures_is_narrow(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"1")
    paths = spark.createDataFrame([(str(tmp_path / "x"),), (str(tmp_path / "y"),)], "path string")
    got = {os.path.basename(r.path): (r.sha256 is None, r.failure and r.failure.code) for r in O.hash_objects(paths).collect()}
    assert got == {"x": (False, None), "y": (True, "NoSuchKey")}
    assert S.detect_objects(paths).filter(F.col("failure.code") == "NoSuchKey").count() == 1
