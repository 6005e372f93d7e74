"""Archives on disk and as index rows: detection, guards at their limits, extraction, outcomes, the whole path."""

import hashlib
import io
import struct
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.operators import archives as A
from folioworks.plans import ingest
from folioworks.settings import ArchiveLimits
from folioworks.sources import archives as S
from folioworks.sources import objects as O

ENTRY = "archive string, entry_pos int, name string, size bigint, csize bigint, flags int"


def docx(text="hello"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, body in {"[Content_Types].xml": f'<Override ContentType="{M.WORDML_TYPE}"/>', "word/document.xml": text,
                           "_rels/.rels": "x"}.items():
            box.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def pack(items, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as box:
        for name, data in items:
            box.writestr(name, data)
    return out.getvalue()


def spoil(data, name):
    """Change a stored entry's checksum in both headers, so that reading it fails."""
    raw, key = bytearray(data), name.encode()
    at = 0
    while (at := raw.find(b"PK\x03\x04", at)) >= 0:
        n = struct.unpack_from("<H", raw, at + 26)[0]
        if raw[at + 30:at + 30 + n] == key:
            raw[at + 14] ^= 0xFF
        at += 4
    at = 0
    while (at := raw.find(b"PK\x01\x02", at)) >= 0:
        n = struct.unpack_from("<H", raw, at + 28)[0]
        if raw[at + 46:at + 46 + n] == key:
            raw[at + 16] ^= 0xFF
        at += 4
    return bytes(raw)


def lock(data):
    """Set the encryption bit of the first entry in both headers."""
    raw = bytearray(data)
    raw[raw.find(b"PK\x03\x04") + 6] |= 1
    raw[raw.find(b"PK\x01\x02") + 8] |= 1
    return bytes(raw)


BOMB = pack([("bomb.docx", b"\0" * 3_000_000)])
FILES = {
    "valid.docx": docx(), "valid.pdf": b"%PDF-1.4 body", "renamed_exe.docx": b"MZ\x90\0 binary", "renamed_exe.pdf": b"MZ\x90",
    "renamed_zip.docx": pack([("a.txt", "1"), ("b.txt", "2")]), "cut.zip": pack([("a.docx", docx())])[:-20],
    "mixed.zip": pack([("a.docx", docx("a")), ("b.docx", docx("b")), ("c.docx", docx("c")), ("d.pdf", b"%PDF-1"), ("readme.txt", "x")]),
    "bomb.zip": BOMB, "slip.zip": pack([("../../evil.docx", docx())]), "encrypted.zip": lock(pack([("a.docx", docx())])),
    "dupnames.zip": pack([("a.docx", docx("1")), ("a.docx", docx("2"))]),
    "lying3.zip": spoil(pack([("a.docx", docx("a")), ("b.docx", docx("b")), ("c.docx", docx("c"))], zipfile.ZIP_STORED), "c.docx"),
    "inner_bomb.zip": pack([("a.docx", docx("a")), ("bomb.docx", BOMB), ("z.docx", docx("z"))]),
    "mac_deep.zip": pack([("__MACOSX/._a.docx", "x"), (".DS_Store", "x"), ("a.docx", docx("a")), ("docs/b.docx", docx("b")),
                          ("one/two/c.docx", docx("c")), ("docs/", b"")]),
    "wrong.zip": docx(), "badtxt.zip": spoil(pack([("a.docx", docx()), ("b.txt", "text")], zipfile.ZIP_STORED), "b.txt"),
    "hidden.zip": pack([("__MACOSX/a.docx", docx()), (".b.docx", docx())]),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("uploads")
    for name, data in FILES.items():
        (root / name).write_bytes(data)
    return root


def test_manifest_hash_and_detection_by_path(spark, folder):
    found = O.manifest(spark, str(folder))
    assert {r.path.rsplit("/", 1)[1]: r.length for r in found.collect()} == {n: len(d) for n, d in FILES.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    hashes = {r.path.rsplit("/", 1)[1]: (r.sha256, r.bytes_read) for r in O.hash_objects(found).collect()}
    assert hashes == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in FILES.items()}
    got = {r.path.rsplit("/", 1)[1]: (r.detected, r.detected_reason) for r in S.detect_objects(found).collect()}
    assert {n: got[n][0] for n in FILES} == {
        "valid.docx": "docx", "valid.pdf": "pdf", "renamed_exe.docx": "unknown", "renamed_exe.pdf": "unknown",
        "renamed_zip.docx": "zip", "cut.zip": "corrupt", "mixed.zip": "zip", "bomb.zip": "unsafe", "slip.zip": "unsafe",
        "encrypted.zip": "unsafe", "dupnames.zip": "unsafe", "lying3.zip": "zip", "inner_bomb.zip": "zip", "mac_deep.zip": "zip",
        "wrong.zip": "docx", "badtxt.zip": "zip", "hidden.zip": "zip"}
    assert got["slip.zip"][1] == "'../../evil.docx' has an unsafe path"
    assert got["encrypted.zip"][1] == "'a.docx' is encrypted"
    assert got["dupnames.zip"][1] == "'a.docx' appears more than once"
    assert got["bomb.zip"][1] == "'bomb.docx' has an implausible compression ratio"


def test_inline_and_by_path_detection_agree(spark, folder):
    found = spark.read.format("binaryFile").load(str(folder))
    inline = {r.path: tuple(r.d) for r in S.detect_content(found, "d").select("path", "d").collect()}
    by_path = {r.path: (r.detected, r.detected_reason) for r in S.detect_objects(found.select("path")).collect()}
    assert inline == by_path


@pytest.mark.parametrize("inline", [False, True])
def test_the_whole_path(spark, folder, inline):
    found = spark.read.format("binaryFile").load(str(folder))
    name = F.element_at(F.split("path", "/"), -1)
    uploads = found.select(name.alias("file_id"), F.lit("o").alias("organization_id"), F.lit("b").alias("batch_id"),
                           name.alias("file_name"), F.element_at(F.split(name, r"\."), -1).alias("file_ext"), "path",
                           *(["content"] if inline else []))
    files, candidates = ingest.process(uploads)
    got = {r.file_id: (r.status, r.status_message, r.entries_total, r.entries_done) for r in files.collect()}
    unknown = "File content does not match .{} — it appears to be {}"
    lie = "'c.docx' does not match its index (Bad CRC-32 for file 'c.docx')"
    assert got == {
        "valid.docx": ("processed", None, None, 0), "valid.pdf": ("processed", None, None, 0),
        "renamed_exe.docx": ("rejected", unknown.format("docx", "unknown"), None, 0),
        "renamed_exe.pdf": ("rejected", unknown.format("pdf", "unknown"), None, 0),
        "renamed_zip.docx": ("rejected", unknown.format("docx", "zip"), None, 0),
        "cut.zip": ("rejected", M.DAMAGED, None, 0), "wrong.zip": ("rejected", unknown.format("zip", "docx"), None, 0),
        "mixed.zip": ("partial", None, 5, 5),
        "bomb.zip": ("rejected", "File is unsafe: 'bomb.docx' has an implausible compression ratio", None, 0),
        "slip.zip": ("rejected", "File is unsafe: '../../evil.docx' has an unsafe path", None, 0),
        "encrypted.zip": ("rejected", "File is unsafe: 'a.docx' is encrypted", None, 0),
        "dupnames.zip": ("rejected", "File is unsafe: 'a.docx' appears more than once", None, 0),
        "lying3.zip": ("rejected", lie, 3, 2), "inner_bomb.zip": ("partial", None, 3, 3),
        "mac_deep.zip": ("partial", None, 3, 3), "badtxt.zip": ("partial", None, 2, 2), "hidden.zip": ("processed", None, 0, 0)}
    rows = {(r.source_file_id, r.entry_index): r for r in candidates.collect()}
    assert rows["mixed.zip", 4].reject_reason == ".txt is not supported"
    assert [rows["lying3.zip", i].reject_reason for i in (0, 1)] == [f"{M.ARCHIVE_REJECTED}: {lie}"] * 2
    assert ("lying3.zip", 2) not in rows and not any(r.s3_key for (f, _), r in rows.items() if f == "lying3.zip")
    assert rows["inner_bomb.zip", 1].reject_reason == "File is unsafe: 'bomb.docx' has an implausible compression ratio"
    assert [rows["mac_deep.zip", i].s3_key for i in range(3)] == [
        "staging/o/b/mac_deep.zip/0000_a.docx", "staging/o/b/mac_deep.zip/0001_b.docx", None]
    assert rows["mac_deep.zip", 2].reject_reason == M.TOO_DEEP
    assert rows["valid.docx", None].content_hash == hashlib.sha256(FILES["valid.docx"]).hexdigest()
    assert rows["mixed.zip", 0].content_hash == hashlib.sha256(docx("a")).hexdigest()
    assert len(rows) == 2 + 5 + 2 + 3 + 3 + 2


def index(spark, rows):
    return spark.createDataFrame([("z", i, *row) for i, row in enumerate(rows)], ENTRY)


@pytest.mark.parametrize("row, reason", [
    (("a.docx", 200, 1, 0), None), (("a.docx", 201, 1, 0), "'a.docx' has an implausible compression ratio"),
    (("a.docx", 10 ** 6, 0, 0), None), (("x" * 250 + ".docx", 1, 1, 0), None),
    (("x" * 251 + ".docx", 1, 1, 0), f"'{'x' * 251}.docx' has a file name longer than 255 bytes"),
    (("é" * 126 + ".docx", 1, 1, 0), f"'{'é' * 126}.docx' has a file name longer than 255 bytes"),
    (("d/" * 509 + "a.docx", 1, 1, 0), None),
    (("d/" * 510 + "a.docx", 1, 1, 0), f"'{('d/' * 510)[:80]}…' has a path longer than 1024 characters"),
    (("a.docx", 1, 1, 1), "'a.docx' is encrypted"), (("a.docx", 1, 1, 8), None),
])
def test_guard_at_its_limits(spark, row, reason):
    assert A.archive_guard(index(spark, [row]), ["entry_pos"]).first().reason == reason


@pytest.mark.parametrize("name, unsafe", [
    ("/etc/passwd", True), ("../x", True), ("a/../b", True), ("a\\..\\b", True), ("\\\\host\\x", True), ("C:\\x", True),
    ("c:x", True), ("..", True), ("a/..", True), ("a/b.docx", False), ("..a/b", False), ("a..b", False), ("./a", False),
    ("ab:c", False), ("a/b../c", False)])
def test_unsafe_paths(spark, name, unsafe):
    assert spark.range(1).select(A.unsafe_path(F.lit(name))).first()[0] is unsafe
    look = spark.createDataFrame([((True, None, 1, 1, [(name, 1, 1, 0)], False),)], f"look {S.LOOK}")
    assert (look.select(A.container_reason(F.col("look"), ArchiveLimits())).first()[0] is not None) is unsafe


def test_guard_precedence_and_scope(spark):
    limits = ArchiveLimits(max_entries=3, max_total_bytes=1000)
    def verdict(rows):
        return A.archive_guard(index(spark, rows), ["entry_pos"], limits).first().reason
    ok = ("a.docx", 1, 1, 0)
    assert verdict([("../x", 1, 1, 1)] * 4) == "4 files; limit is 3"
    assert verdict([("../x", 1001, 1, 1)]) == M.TOO_LARGE_UNPACKED
    assert verdict([ok, ("b.docx", 1, 1, 1), ("../c", 900, 1, 1)]) == "'b.docx' is encrypted"
    assert verdict([("__MACOSX/.x", 900, 1, 0)]) == "'__MACOSX/.x' has an implausible compression ratio"
    assert verdict([ok, ok]) == "'a.docx' appears more than once"


def test_a_huge_archive_reaches_no_window(spark):
    """An archive far over the limit is judged by its totals; the other one is unaffected."""
    rows = [("big", i, f"{i}.docx", 1, 1, 0) for i in range(5000)] + [("ok", 0, "a.docx", 1, 1, 0)]
    df = spark.createDataFrame(rows, ENTRY)
    got = {r.archive: r.reason for r in A.archive_guard(df, ["entry_pos"]).collect()}
    assert got == {"big": "5000 files; limit is 500", "ok": None}
    assert A._fitting(df, A.archive_totals(df), ArchiveLimits()).count() == 1


def test_numbering_reasons_and_resume(spark):
    rows = [("__MACOSX/._a", 1, 1, 0), ("a.docx", 1, 1, 0), (".hid", 1, 1, 0), ("d/e/f.docx", 1, 1, 0), ("noext", 1, 1, 0),
            ("x.averylongextension", 1, 1, 0), ("d/__MACOSX", 1, 1, 0), ("b.PDF", 1, 1, 0)]
    found = A.archive_candidates(index(spark, rows), ["entry_pos"])
    got = [(r.entry_index, r.file_name, r.file_ext, r.entry_reason) for r in found.orderBy("entry_index").collect()]
    assert got == [(0, "a.docx", "docx", None), (1, "f.docx", "docx", M.TOO_DEEP), (2, "noext", "", M.NO_EXTENSION),
                   (3, "x.averylongextension", "averylonge", ".averylongextension is not supported"),
                   (4, "__MACOSX", "", M.NO_EXTENSION), (5, "b.PDF", "pdf", None)]
    progress = spark.createDataFrame([("z", 4)], "archive string, entries_done int")
    assert sorted(r.entry_index for r in A.resume_entries(found, progress).collect()) == [4, 5]


def test_object_plan_runs_twice(spark, tmp_path):
    (tmp_path / "staging").mkdir()
    (tmp_path / "staging/a").write_bytes(b"one")
    plan = spark.createDataFrame([("copy", "staging/a", "processed/d/v1_a"), ("delete", "staging/a", None)],
                                 "op string, src string, dst string")
    for _ in range(2):
        O.run_object_plan(plan, f"file:{tmp_path}")
        assert (tmp_path / "processed/d/v1_a").read_bytes() == b"one" and not (tmp_path / "staging/a").exists()


def test_browser_precheck(spark):
    rows = [("z", 0, "a.docx", 1, True), ("z", 1, "d/e/b.docx", 1, True), ("z", 2, "x.exe", 1, True), ("z", 3, "noext", 1, True),
            ("z", 4, "p.pdf", 1, False), ("z", 5, "q.pdf", 0, True), ("z", 6, "r.PDF", 1, True), ("z", 7, "__MACOSX/s.docx", 1, True),
            ("z", 8, ".t.docx", 1, True), ("none", 0, "a.txt", 1, True)]
    df = spark.createDataFrame(rows, "archive string, entry_pos int, name string, size bigint, signature_ok boolean")
    checked = A.zip_precheck(df)
    assert [r.problem for r in checked.filter("archive = 'z'").orderBy("entry_pos").collect()] == [
        None, M.TOO_DEEP, ".exe is not supported inside a ZIP.", "Files without an extension are not supported.",
        "The PDF file is corrupted or invalid.", "File is empty.", None]
    archives = spark.createDataFrame([("z", None), ("none", None), ("bad", "x")], "archive string, error string")
    got = {r.archive: (r.usable, r.warnings, r.error, r.archive_valid) for r in A.zip_precheck_verdict(archives, checked).collect()}
    assert got == {"z": (2, 5, None, True), "bad": (0, 0, "The ZIP file is corrupted or cannot be read.", False),
                   "none": (0, 1, "The ZIP file does not contain any DOCX, PDF files that can be added.", False)}


def test_batches_of_wide_rows_are_bounded(spark):
    """rows with bytes come to a task in batches of 16 MB, not of 2000 rows or of Spark's 64 MB."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(3000).coalesce(1).select(F.repeat(F.lit("abcdefgh"), 3000).alias("t"))
    found = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) > 70_000_000 and max(found) < 18_000_000
