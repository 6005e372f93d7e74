"""Chat snapshots, site lines, the two classifiers and the pipeline."""

import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import chat, lines, quality, toxicity
from folioworks.llm.samples import fold
from tests.llm.tables import awkward, docs

SF = "/root/testdata/sf0.01"


def test_snapshots_collapse(spark):
    full = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", None)]
    logs = {1: full[:1], 2: full[:2], 3: full, 4: full, 5: [("user", "hi"), ("assistant", "other")], 6: [(None, "")],
            7: full[:3], 8: [("user", "hi"), ("user", "hello")]}
    rows = [(c, t, r, x, 9) for c, turns in logs.items() for t, (r, x) in enumerate(turns)]
    rows += [(None, 0, "user", "lost", 9), (9, 0, "user", "twice", 9), (9, 0, "user", "twice", 9), (10, None, "user", "hi", 9)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, position int")
    got = chat.format_chats(table).orderBy("conv_id", "position").collect()
    assert {r.conv_id for r in got} == {3, 5, 6, 8, 9, 10}
    three = [r for r in got if r.conv_id == 3]
    whole = "".join(r.rendered for r in three)
    assert whole.startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n")
    assert [r.offset for r in three] == [whole.index(r.rendered) for r in three] and [r.n_turns for r in three] == [4] * 4
    assert chat.format_chats(table.limit(0)).count() == 0


def test_one_long_conversation(spark):
    table = spark.range(3000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                     F.concat(F.lit("t"), "id").alias("text"))
    begun = table.filter("turn < 1234").withColumn("conv_id", F.lit(2).cast("bigint"))
    got = chat.format_chats(table.unionByName(begun))
    assert got.agg(F.count("*"), F.max("position"), F.max("n_turns"), F.countDistinct("offset"), F.min("conv_id"), F.max("conv_id")).first() == (3000, 3000, 3000, 3000, 1, 1)


def test_lines_against_brute_force(spark):
    rows = [(i, f"h{i % 3}", "\n".join(["menu", f"own {i}", " menu ", "often" if i % 4 == 0 else f"seldom {i}", "", f"own {i}"])) for i in range(60)]
    rows += [(100, None, "menu\nx"), (101, "h0", None), (102, "h0", ""), (103, "tiny", "menu"), (5, "h2", rows[5][2]), (None, "h1", "menu")]
    table = spark.createDataFrame([(i, h, t, 1, "k") for i, h, t in rows], "page_id bigint, site string, body string, n_lines int, kept string")
    got = lines.drop_boilerplate(table, F.col("site"), lines.text_lines(F.col("body")), 0.2, 4).collect()
    pages, counts = {}, {}
    for _, h, t in rows:
        pages[h or ""] = pages.get(h or "", 0) + 1
        for line in {x.strip(" ") for x in t.split("\n")} - {""} if t is not None else ():
            counts[h or "", line] = counts.get((h or "", line), 0) + 1
    want = []
    for i, h, t in rows:
        own = t.split("\n") if t is not None else []
        kept = [x for x in own if not (x.strip(" ") and counts[h or "", x.strip(" ")] >= 4 and counts[h or "", x.strip(" ")] > 0.2 * pages[h or ""])]
        want.append((i, h or "", len(own), len(own) - len(kept), None if t is None else "\n".join(kept)))
    assert sorted([(r.page_id, r.host, r.n_lines, r.n_dropped, r.kept) for r in got], key=str) == sorted(want, key=str)
    assert sum(w[3] for w in want) > 60
    assert lines.drop_boilerplate(table.limit(0), F.col("site"), lines.text_lines(F.col("body"))).count() == 0


def test_pipeline_drops_repeated_passages(spark):
    """A long passage on a few documents of a large source goes; single lines, pairs and what copies share stay."""
    pipeline = importlib.import_module("corpus_pipeline")
    own = {i: [" ".join(f"own{i}x{k}w{n}" for n in range(25)) for k in range(3)] for i in range(2000)}
    passage, short, pair = (" ".join(f"{w}{n}" for n in range(30)) for w in ("passage", "short", "pair"))
    short = " ".join(short.split()[:6])
    for i in range(0, 1000, 250):
        own[i].append(passage)                      # 4 of 2,000: 0.2%
    for i in range(0, 2000, 50):
        own[i].insert(1, short)                     # 40 of 2,000: 2%
    for i in (1, 2):
        own[i].append(pair)
    texts = {i: "\n".join(x) for i, x in own.items()}
    copied = " ".join(f"copied{n}" for n in range(200))
    texts |= {2000 + i: f"{copied}\nlast {i}" for i in range(6)}
    rows = [(i, t, "en", "big", len(t)) for i, t in texts.items()] + [(9000, passage, "en", "other", len(passage)), (9001, None, "en", "big", 0)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in pipeline.repeated_lines(spark, table, SF).collect()}
    assert len(got) == len(rows)
    for i, t, _, source, _ in rows:
        want = t if t is None or source != "big" else "\n".join(x for x in t.split("\n") if x not in (passage, short))
        assert (got[i].text, got[i].n_chars) == (want, len(want or ""))


def test_one_row_stays_of_near_duplicates(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    a, b, c, d = (" ".join(f"{x}{n}" for n in range(60)) for x in "abcd")
    near = {x: x[:-3] + "end" for x in (a, b, c, d)}
    rows = [(1, a), (1, a), (2, near[a]), (None, a), (None, near[a]),       # one row of id 1 stays
            (2, b), (3, near[b]),                                           # a second text under id 2, which loses above
            (None, c), (None, c), (None, near[c]),                          # no id anywhere: one row stays
            (4, d), (4, "all other words than those of d"), (5, None), (5, None), (6, ""), (None, "")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, table, SF).collect()]
    (free,) = [r for r in got if r[0] is None and r[1]]
    assert free[1] in (c, near[c])
    want = [(1, a), (2, b), free, (4, d), (4, rows[11][1]), (5, None), (5, None), (6, ""), (None, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_short_items_remove_what_they_cover(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    ten = " ".join(f"q{n}" for n in range(12))
    spark.createDataFrame([(1, "yes"), (2, "the answer"), (3, ten)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "yes that is a long and clean document"), (2, "Yes, yes!"), (3, "so the answer yes"), (4, f"before it {ten} " + "and more " * 40),
            (5, "yes " + " ".join(ten.split()[:9]) + " no"), (6, None), (7, "the answer to some other thing")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in pipeline.benchmark_leaks(spark, table, str(tmp_path)).collect()} == {1, 5, 6, 7}


def test_html_lines_and_hosts(spark):
    html = "<p>one<b> two</b></p><SCRIPT>\nvar x</script><!-- no\n --><style>p{}</style><li> three </li>"
    row = spark.createDataFrame([(html, "https://A.Example.com:80/x?y"), (None, None), ("", "x")], "h string, u string").select(
        lines.html_lines(F.col("h")).alias("l"), lines.url_host(F.col("u")).alias("u")).collect()
    assert [tuple(r) for r in row] == [(["one", "two", "three"], "a.example.com"), (None, None), ([], "")]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_machine_learns_pairs(spark):
    """Neither word alone marks a document, both together do: no additive weights can tell."""
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(1200):
        a, b = rng.integers(0, 2, 2)
        rows.append((i, " ".join(["grumble"] * a + ["neighbours"] * b + [f"word{rng.integers(0, 50)}" for _ in range(5)])))
        marks.append((i, 1, int(a and b)))
    got = toxicity.toxicity(docs(spark, rows), labels(spark, marks)).toPandas().merge(
        labels(spark, marks).toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 200 and (held.predicted == held.toxic).mean() > 0.98


def test_machine_learns_exclusive_or(spark):
    """One of two words marks a document, both or none do not: each word alone is as frequent in either class."""
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append((i, " ".join(["grumble"] * a + ["neighbours"] * b + [f"word{rng.integers(0, 50)}" for _ in range(5)])))
        marks.append((i, 1, int(a != b)))
    got = toxicity.toxicity(docs(spark, rows), labels(spark, marks)).toPandas().merge(
        labels(spark, marks).toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 300 and (held.predicted == held.toxic).mean() > 0.95


@pytest.mark.parametrize("marks", [[], [(0, 1, 0)], [(i, 1, 0) for i in range(40)], [(i, 1, 1) for i in range(40)], [(0, 1, 1), (1, 1, 0)]])
def test_few_labels_condemn_nothing(spark, marks):
    pipeline = importlib.import_module("corpus_pipeline")
    rows = awkward()
    assert toxicity.toxicity(docs(spark, rows), labels(spark, marks)).filter("predicted = 1").count() == 0
    settings = toxicity.Settings()
    machine = toxicity.fit(docs(spark, rows), labels(spark, marks), settings)
    assert pipeline.toxicity.score(docs(spark, rows), machine, settings.threshold).filter("predicted = 0").count() == len(rows)


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_a_repeated_id_is_learned_from_once(spark, operator):
    """One labelled id on many rows, with many texts, does not outweigh the rest, nor does a very long text stop anything."""
    rng = np.random.default_rng(3)
    rows = [(i, ("vile words " if i % 3 == 0 else "kind words ") + " ".join(f"w{rng.integers(0, 60)}" for _ in range(30))) for i in range(300)]
    rows += [(1, "vile words " + " ".join(f"w{k % 60}" for k in range(30))) for _ in range(2000)] + [(9999, "kind words of any length " * 200_000)]
    marks = [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(300)]
    got = operator(docs(spark, rows), labels(spark, marks)).toPandas().drop_duplicates("doc_id").merge(labels(spark, marks).toPandas(), on="doc_id")
    held = got[got.held_out & (got.doc_id != 1)]
    assert len(held) > 40 and (operator is quality.quality or (held.predicted == held.toxic).mean() > 0.95)


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers_take_awkward_rows(spark, operator):
    rows = awkward()
    marks = [(i, i % 2, int(i % 3 == 0)) for i, _ in rows if i is not None] + [(None, 1, 1), (4, None, None), (4, 1, 0)]
    got = operator(docs(spark, rows), labels(spark, marks)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out is False for r in got if r.doc_id is None)
    assert operator(docs(spark, []), labels(spark, [])).count() == 0
    assert len(operator(docs(spark, rows), labels(spark, [])).collect()) == len(rows)


def test_held_out_accuracy(spark):
    table, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for operator, label, least in ((toxicity.toxicity, "toxic", 0.9), (quality.quality, "quality", 0.97)):
        held = operator(table, marks).filter("held_out").join(marks, "doc_id")
        assert held.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least


def test_toxic_documents_are_recalled(spark):
    """Recall and precision on the held-out fold of a table with some three thousand labels to learn from."""
    table, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.toxicity(table, marks).filter("held_out").join(marks, "doc_id")
    both, found, toxic = held.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert toxic > 80 and both >= 0.85 * toxic and both >= 0.95 * found


def test_folds(spark):
    import zlib
    got = spark.range(50).select("id", fold("id", 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1])
    knots, values = quality.isotonic(x, y)
    assert np.allclose(np.interp(x, knots, values), [0, 0.5, 0.5, 1, 1]) and (np.diff(values) >= 0).all()


def test_stages_keep_clashing_columns(spark):
    """Columns named like the operators' own, and one with a dot, come back with their values."""
    pipeline = importlib.import_module("corpus_pipeline")
    names = ["row_id", "text_key", "a.b", "_row", "host", "score", "_site", "keep"]
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    for k, name in enumerate(names):
        table = table.withColumn(name, F.lit(700 + k))
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, table, SF)
        assert got.columns == table.columns, name
        assert [tuple(r) for r in got.select(*[f"`{n}`" for n in names]).distinct().collect()] == [tuple(700 + k for k in range(len(names)))]


def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {0: {r.doc_id for r in table.select("doc_id").collect()}}
    kept, clash = table.withColumn("host", F.lit("h")).withColumn("score", F.lit(1)), None
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1], start=1):
        after = stage(spark, kept, SF).cache()
        assert after.columns == kept.columns and after.select("host", "score").distinct().collect() == [("h", 1)]
        ids[k] = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids[k] <= ids[k - 1] and len(ids[k]) > 0.6 * len(ids[k - 1])
        kept = after
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = [marks[i] for i in ids[0] - ids[1] if i in marks]
    assert sum(gone) >= 0.9 * len(gone) and clash is None
    assert ids[2] == ids[1] and ids[3] < ids[2] and ids[4] < ids[3]
    packed = pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[4]
    empty = table.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
