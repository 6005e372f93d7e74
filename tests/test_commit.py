"""Commit rounds against the sequential pass, one candidate at a time."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioworks import messages as M
from folioworks.functions import names
from folioworks.operators import commit as C
from folioworks.operators import duplicates as D
from folioworks.sources.sinks import read_table, write_commit

CAND = ("staged_id string, organization_id string, batch_id string, source_file_id string, source_entry_name string, "
        "entry_index int, file_name string, file_ext string, size_bytes bigint, content_hash string, s3_key string, "
        "status string, proposed_title string, title_norm string")
FILES = "file_id string, batch_id string, status string, created_us bigint"
LIB = "document_id string, organization_id string, content_hash string, title_norm string"


def world(seed, n=400, keys=60, hot=False):
    rng = random.Random(seed)
    files = [(f"f{b}-{i}", f"b{b}", rng.choice(["processed"] * 4 + ["partial", "error", "processing"]), rng.randint(0, 3))
             for b in range(6) for i in range(5)]
    cands = []
    for s in range(n):
        file_id, batch, _, _ = rng.choice(files)
        h = "h0" if hot and rng.random() < 0.4 else f"h{rng.randint(0, keys)}"
        t = f"t{rng.randint(0, keys)}"
        index = rng.choice([None, rng.randint(0, 50)])
        cands.append((f"s{s:04d}", f"o{int(batch[1]) % 2 + 1}", batch, file_id, None if index is None else f"e{s}", index, f"{t}.docx",
                      "docx", 1, h, f"k{s}", rng.choice(["processed"] * 9 + ["rejected"]), t, t))
    lib = [(f"d{i}", rng.choice(["o1", "o2"]), f"h{rng.randint(0, keys)}", f"t{rng.randint(0, keys)}") for i in range(8)]
    return cands, files, lib


def sequential(cands, files, lib):
    finished = {f: (c, b) for f, b, s, c in files if s in M.TERMINAL}
    rows = [c for c in cands if c[3] in finished and c[11] == "processed"]
    rows.sort(key=lambda c: (c[2], finished[c[3]][0], c[3], -1 if c[5] is None else c[5], c[4] or "", c[0]))
    hashes, titles, out = {}, set(), {}
    for _, org, h, t in lib:
        hashes.setdefault((org, h), None)
        titles.add((org, t))
    for c in rows:
        org, batch, h, t = c[1], c[2], c[9], c[13]
        if (org, h) in hashes:
            out[c[0]] = M.SAME_FILE_IN_BATCH if hashes[org, h] == batch else M.ALREADY_IN_LIBRARY
        elif (org, t) in titles:
            out[c[0]] = M.TITLE_IN_LIBRARY
        else:
            out[c[0]] = None
            hashes[org, h] = batch
            titles.add((org, t))
    return out


def frames(spark, cands, files, lib):
    return spark.createDataFrame(cands, CAND), spark.createDataFrame(files, FILES), spark.createDataFrame(lib, LIB)


def one(staged, h, t, batch="b", index=0):
    return (staged, "o", batch, "f" + batch, f"e{index}", index, f"{t}.docx", "docx", 1, h, f"k{staged}", "processed", t, t)


def test_a_loser_on_content_does_not_occupy_its_title(spark):
    cands = [one("A", "h1", "t1", index=0), one("B", "h1", "t2", index=1), one("C", "h2", "t2", index=2)]
    out = C.commit(*frames(spark, cands, [("fb", "b", "processed", 0)], [("x", "other", "h1", "t1")]))
    assert {r.staged_id: r.reason for r in out.collect()} == {"A": None, "B": M.SAME_FILE_IN_BATCH, "C": None}


def test_an_alternating_chain(spark):
    """Each edge conflicts with the next: every second one is added, whatever the number of rounds."""
    cands = [one(f"s{i:02d}", f"h{(i + 1) // 2}", f"t{i // 2}", index=i) for i in range(12)]
    out = C.commit(*frames(spark, cands, [("fb", "b", "processed", 0)], [("x", "other", "h1", "t1")]))
    assert {r.staged_id: r.reason for r in out.collect()} == sequential(cands, [("fb", "b", "processed", 0)], [])


def test_a_long_chain_ends_exactly(spark):
    """With and without the ordered pass over a small rest."""
    rng = random.Random(8)
    rows = [("o", f"h{(i + 1) // 2}", f"t{i // 2}", i) for i in range(26)] + [
        ("o", f"x{rng.randint(0, 9)}", f"y{rng.randint(0, 9)}", 100 + i) for i in range(60)]
    rows = list({r[:3]: r for r in reversed(rows)}.values())
    edges = spark.createDataFrame(rows, "organization_id string, content_hash string, title_norm string, pos int")
    hashes, titles, want = set(), set(), set()
    for _, h, t, pos in sorted(rows, key=lambda r: r[3]):
        if h not in hashes and t not in titles:
            hashes.add(h), titles.add(t), want.add(pos)
    assert {r.pos for r in C.greedy_matching(edges).collect()} == want


@pytest.mark.parametrize("seed, hot", [(1, False), (2, False), (3, True)])
def test_rounds_equal_the_sequential_pass(spark, seed, hot):
    cands, files, lib = world(seed, hot=hot)
    out = C.commit(*frames(spark, cands, files, lib))
    assert {r.staged_id: r.reason for r in out.collect()} == sequential(cands, files, lib)


def test_everything_after_a_commit(spark, tmp_path):
    cands, files, lib = world(4, n=120)
    dc, df, dl = frames(spark, cands, files, lib)
    out = C.commit(dc, df, dl).cache()
    want = sequential(cands, files, lib)
    docs = C.new_documents(out, 5_000_000)
    assert docs.count() == sum(r is None for r in want.values())
    assert docs.groupBy("organization_id", "title_norm").count().filter("count > 1").count() == 0
    for _ in range(2):                                        # a commit run twice adds nothing twice
        write_commit(docs, str(tmp_path / "library"), "c1")
    assert read_table(spark, str(tmp_path / "library")).count() == docs.count()
    merged = dl.unionByName(docs.select(dl.columns))
    again = C.commit(dc, df, merged)
    assert again.filter("outcome = 'added'").count() == 0

    finished = {f for f, _, s, _ in files if s in M.TERMINAL}
    left = {r.staged_id for r in C.remaining_candidates(dc, df).collect()}
    assert left == {c[0] for c in cands if c[3] not in finished}
    resolved = {r.staged_id: (r.resolution, r.confirmed_title) for r in C.resolutions(dc, df, out).collect()}
    assert resolved == {c[0]: (None, None) if c[11] == "rejected" else ("discard" if want[c[0]] else "create_new", c[12])
                        for c in cands if c[3] in finished}

    summary = {r.batch_id: r for r in C.commit_summary(out, df).collect()}
    audit = {r.entity_id: r for r in C.commit_audit(out, df).collect()}
    assert set(audit) == {b for b in {c[2] for c in cands if c[0] in want}}
    items = C.commit_audit_items(out).collect()
    for batch, row in audit.items():
        mine = [c for c in cands if c[2] == batch and c[0] in want]
        own = sorted((r for r in items if r.entity_id == batch), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(mine) + 1))
        assert row.added == summary[batch].added == sum(want[c[0]] is None for c in mine) == sum(r.document_id is not None for r in own)
        assert {r.staged_id: r.reason for r in own} == {c[0]: want[c[0]] for c in mine} and row.skipped == len(mine) - row.added
        assert row.still_in_progress == summary[batch].still_in_progress

    busy = {b for _, b, s, _ in files if s not in M.TERMINAL}
    assert {r.batch_id for r in C.committed_batches(df, dc).collect()} == {b for _, b, _, _ in files} - busy
    plan = C.object_plan(out)
    assert plan.filter("op = 'copy'").count() == docs.count()
    assert plan.filter("op = 'delete'").count() == len(want) + sum(r is not None for r in want.values())
    assert C.skipped(out).count() == sum(r is not None for r in want.values())


def test_duplicates_prefer_content_and_agree_with_the_union_plan(spark):
    cands, _, lib = world(6, n=300, keys=12)
    lib = lib + [("d99", "o1", lib[0][2], "tx"), ("d01", "o2", "hx", lib[1][3])]
    dc, dl = spark.createDataFrame(cands, CAND), spark.createDataFrame(lib, LIB)

    def best(c):
        content = [d for d, o, h, _ in lib if (o, h) == (c[1], c[9])]
        title = [d for d, o, _, t in lib if (o, t) == (c[1], c[13])]
        if c[11] != "processed" or not (content or title):
            return None, None
        return (min(content), "same_content") if content else (min(title), "same_title")

    want = {c[0]: best(c) for c in cands}
    for found in (D.find_duplicate(dc, dl), D.find_duplicate_union(dc, dl)):
        assert {r.staged_id: (r.duplicate_of_document_id, r.duplicate_kind) for r in found.collect()} == want


def test_name_and_size_lookup_ignores_case(spark):
    lib = spark.createDataFrame([("d2", "o", "report.docx", 5), ("d1", "o", "report.docx", 5), ("d3", "p", "report.docx", 5)],
                                "document_id string, organization_id string, file_name_norm string, size_bytes bigint")
    asked = spark.createDataFrame([("a", "o", "Report.DOCX ", 5), ("b", "o", "report.docx", 6)],
                                  "id string, organization_id string, file_name string, size_bytes bigint")
    got = D.by_name_and_size(asked.withColumn("file_name_norm", names.file_name_norm(F.col("file_name"))), lib)
    assert {r.id: r.duplicate_of for r in got.collect()} == {"a": "d1", "b": None}


def edges_of(spark, pairs):
    """(content, title) in order of rank."""
    rows = [("o", f"h{h}", f"t{t}", i) for i, (h, t) in enumerate(pairs)]
    return spark.createDataFrame(rows, "organization_id string, content_hash string, title_norm string, n bigint").select(
        "organization_id", "content_hash", "title_norm", F.struct("n").alias("pos"))


def taken(pairs):
    contents, titles, out = set(), set(), []
    for i, (h, t) in enumerate(pairs):
        if h not in contents and t not in titles:
            contents.add(h)
            titles.add(t)
            out.append(i)
    return out


def chain(n, first=0):
    return [(first + (i + 1) // 2, first + i // 2) for i in range(n)]


@pytest.mark.parametrize("pairs,most,writes", [
    (chain(10_000), C.PASS_EDGES, 4),                                   # below the bound of one pass: no rounds at all
    ([p for k in range(40) for p in chain(12, 100 * k)], 50, 30),       # many chains, each finished in one pass
    (chain(120), 50, 60)])                                              # one chain beyond the bound: lowest ranks first
def test_chains_need_few_rounds(spark, monkeypatch, pairs, most, writes):
    written = []
    kept = C.durable
    monkeypatch.setattr(C, "durable", lambda df: (written.append(1), kept(df))[1])
    got = C.greedy_matching(edges_of(spark, pairs), most)
    assert sorted(r.pos.n for r in got.collect()) == taken(pairs) and len(written) <= writes


@pytest.mark.parametrize("seed", range(2))
def test_components_equal_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    pairs = list(dict.fromkeys((rng.randint(0, 150), rng.randint(0, 150)) for _ in range(260)))
    assert sorted(r.pos.n for r in C.greedy_matching(edges_of(spark, pairs), 20).collect()) == taken(pairs)
    assert C.greedy_matching(edges_of(spark, []), 20).count() == 0
