"""Names, texts and ids against known vectors and against Python's own Unicode tables."""

import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioworks.functions import names, text
from folioworks.messages import DOCUMENT_NAMESPACE


def values(spark, items, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_file_name_norm_vectors(spark):
    given_names = ["Report.DOCX", "  report.docx  ", "Pre-op  Guide.docx", "Straße.docx", "ﬁle.docx", "É\x1cx", "ΣΑΣ"]
    assert values(spark, given_names, names.file_name_norm) == [
        "report.docx", "report.docx", "pre-op guide.docx", "strasse.docx", "file.docx", "é x", "σασ"]


def test_title_norm_vectors(spark):
    given_titles = ["Pre-op_Guide (v2)", "Überblick – Herz", "Überblick – Herz", "¿Qué?", "a$b+c", "ＡＢＣ！"]
    assert values(spark, given_titles, names.title_norm) == [
        "pre op guide v2", "überblick herz", "überblick herz", "qué", "a$b+c", "abc"]


def test_native_and_vectorised_branches_agree(spark):
    """Every character of the plain range, alone and in context, normalises as Python does."""
    plain = [chr(c) for c in [*range(0x20, 0x7F), 9, 10, 11, 12, 13, *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    rng = random.Random(7)
    samples = plain + ["".join(rng.choices(plain, k=rng.randint(1, 12))) for _ in range(400)]
    for punctuation in (True, False):
        got = values(spark, samples, lambda c: names.normalize(c, punctuation))
        assert got == [names.fold_text(s, punctuation) for s in samples]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_fold_text_is_idempotent(sample):
    once = names.fold_text(sample, True)
    assert once == " ".join(once.split())
    assert names.fold_text(once, True) == names.fold_text(names.fold_text(once, True), True)


def test_title_of_vectors(spark):
    given_names = ["archive.tar.gz", ".docx", " spaced .docx", "a/b/Guide.pdf", "noext", "trailing.", "  "]
    assert values(spark, given_names, names.title_of) == [
        "archive.tar", ".docx", "spaced", "Guide", "noext", "trailing.", ""]


def test_extensions_differ_between_server_and_client(spark):
    given_names = ["a.DOCX", ".docx", "a.tar.gz", "x.htm", "dir.d/file", "a.b c", "a.", "a.pdf "]
    assert values(spark, given_names, names.file_ext) == ["docx", "", "gz", "htm", "", "b c", "", "pdf "]
    assert values(spark, given_names, names.client_ext) == ["docx", "docx", "gz", "html", "", "", "", "pdf"]


def test_document_id_is_uuid5(spark):
    ids = [str(uuid.UUID(int=i * 7919)) for i in range(50)] + ["x", "ß"]
    namespace = uuid.UUID(DOCUMENT_NAMESPACE)
    assert values(spark, ids, names.document_id) == [str(uuid.uuid5(namespace, i)) for i in ids]


def test_keys(spark):
    row = spark.range(1).select(
        names.incoming_key(F.lit("o"), F.lit("b"), F.lit("f"), F.lit("dir/a.docx")).alias("a"),
        names.incoming_key(F.lit("o"), F.lit("b"), F.lit("f"), F.lit("")).alias("b"),
        names.staging_key(F.lit("o"), F.lit("b"), F.lit("f"), F.lit(7), F.lit("x.pdf")).alias("c"),
        names.staging_key(F.lit("o"), F.lit("b"), F.lit("f"), F.lit(123456), F.lit("x.pdf")).alias("d"),
        names.processed_key(F.lit("o"), F.lit("d"), F.lit("x.pdf")).alias("e")).first()
    assert tuple(row) == ("incoming/o/b/f_a.docx", "incoming/o/b/f_upload.bin", "staging/o/b/f/0007_x.pdf",
                          "staging/o/b/f/123456_x.pdf", "processed/o/d/v1_x.pdf")


@pytest.mark.parametrize("length, cut", [(512, False), (513, True), (2000, True)])
def test_truncate_message(spark, length, cut):
    out = values(spark, ["é" * length], text.truncate_message)[0]
    assert len(out) == min(length, 512) and out.endswith("…") == cut


def test_format_bytes(spark):
    sizes = [-1, 0, 1, 1023, 1024, 1280, 1536, 1048575, 1048576, 5 * 1024 ** 3, 1100 * 1024 ** 3, 1331]
    assert values(spark, sizes, text.format_bytes, "bigint") == [
        "0 B", "0 B", "1 B", "1023 B", "1.0 KB", "1.3 KB", "1.5 KB", "1024.0 KB", "1.0 MB", "5.0 GB", "1100.0 GB",
        "1.3 KB"]


def test_video_sections(spark):
    body = "Video 1 - Intro: hello\nvideo 22-  Deep dive : more\nVideo x - no: text\nVIDEO 3 - Last:"
    got = [tuple(s) for s in values(spark, [body], text.video_sections)[0]]
    assert got == [("video-1-0", 1, "Intro"), ("video-22-1", 22, "Deep dive"), ("video-3-2", 3, "Last")]
    assert values(spark, ["nothing"], text.video_sections)[0] == []


def test_mismatch_and_duplicate_texts(spark):
    rows = spark.createDataFrame([("docx", "unknown", None), ("zip", "unsafe", "'x' is encrypted"), ("pdf", "corrupt", "?")],
                                 "d string, t string, r string")
    assert [r[0] for r in rows.select(text.mismatch_reason(F.col("d"), F.col("t"), F.col("r"))).collect()] == [
        "File content does not match .docx — it appears to be unknown", "File is unsafe: 'x' is encrypted",
        "File is damaged and cannot be read"]
    flags = spark.createDataFrame([(["A DUPLICATE file"],), (["other"],), ([],), (None,)], "e array<string>")
    assert [r[0] for r in flags.select(text.any_duplicate_error(F.col("e"))).collect()] == [True, False, False, False]
