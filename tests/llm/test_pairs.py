"""Jaccard forest, components, exact top-k and decontamination against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioworks.llm import components, decontaminate, jaccard, topk
from tests.llm.tables import awkward, docs

WHITE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, width):
    words = [w for w in "".join(" " if c in WHITE else c for c in lower(text)).split(" ") if w]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)}


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute_components(rows, width, num, den):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1:]
             if x and y and den * len(x & y) >= num * len(x | y)]
    roots = roots_of({i for i, _ in rows}, links)
    return sorted((i, len(s), roots[i]) for i, s in sets)


def families(seed=1, texts=14, copies=14):
    """Texts with copies that differ by a few words, so that many pairs lie about the threshold."""
    rng = random.Random(seed)
    rows = []
    for _ in range(texts):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 12, 20, 60, 150, 400]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                at = rng.randrange(len(own))
                own[at:at + 1] = rng.choice([[], [f"n{rng.randint(0, 10 ** 6)}"], [own[at], "more"]])
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 4, 5)])
@pytest.mark.parametrize("limits", [(8 << 20, 1_000_000), (20_000, 0)])
def test_forest_finds_every_component(spark, monkeypatch, request, width, num, den, limits):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", limits[0])          # small: trees are split into blocks
    monkeypatch.setattr(jaccard, "CLUSTER_BYTES", min(limits[0], 1 << 18))
    if not limits[1]:                                               # both sides of every join are shuffled
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    rows = families() + [(i + 10_000 if i is not None else 99_999, t) for i, t in awkward() if (i, t) != (3, None)]
    seen = Counter(i for i, _ in rows)
    rows = [r for r in rows if seen[r[0]] == 1]
    got = jaccard.near_duplicates(docs(spark, rows), width, num, den)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, width, num, den)


def test_repeated_ids_null_ids_and_empty_tables(spark):
    rows = [(5, "a b c d"), (5, "e f g h"), (7, "A  b c D"), (9, "e f g h"), (None, "a b c d"), (None, "x y z"), (8, None), (6, "")]
    got = jaccard.near_duplicates(docs(spark, rows), 3, 9, 10).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [(5, 2, 5), (5, 2, 5), (7, 2, 5), (9, 2, 5), (None, 2, 5), (None, 1, None), (8, 0, 8), (6, 0, 6)], key=str)
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for num, den in ((9, 10), (4, 5)):
        for n in [*range(1, 60), 100, 333, 2000]:
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            change = rng.integers(0, max(1, (den - num) * n // (den + num)) + 1)
            y = np.unique(np.concatenate([x[change:], rng.integers(0, 1 << 63, change).astype(np.uint64)]))
            common = len(np.intersect1d(x, y))
            if common * den >= num * (len(x) + len(y) - common) and jaccard.set_keys(x) != jaccard.set_keys(y):
                assert set(jaccard.signatures(x, num, den).tolist()) & set(jaccard.signatures(y, num, den).tolist())


def test_linked_sets_share_as_many_parts_as_are_asked_for():
    rng = np.random.default_rng(7)
    assert len(jaccard.size_ranges()) <= jaccard.RANGE + 1
    asked = Counter()
    for num, den in ((9, 10), (4, 5)):
        for n in [*range(1, 90), *([*range(100, 160), 200, 249, 250, 333, 2000] * 3)]:
            x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            gone, new = (int(rng.integers(0, (den - num) * n // num + 1)) for _ in range(2))
            y = np.unique(np.concatenate([x[rng.permutation(n)[gone:]], rng.integers(0, 1 << 64, new, dtype=np.uint64)]))
            common = len(np.intersect1d(x, y))
            if not len(y) or common * den < num * (len(x) + len(y) - common) or common == len(x) == len(y):
                continue
            c = int(np.searchsorted(jaccard.size_ranges(), min(len(x), len(y)), side="right")) - 1
            (own, least), (other, least_other) = (jaccard.signed_parts(s, num, den) for s in (x, y))
            shared, rare = set(own.tolist()) & set(other.tolist()), int(jaccard.catch_all(c)[0])
            met = sum(s & jaccard.RANGE == c for s in shared - {rare})
            for counts in (least, least_other):
                asked[num] += 1
                assert rare in shared or met >= {k & jaccard.RANGE: k >> 8 for k in counts}[c] >= 1
    assert min(asked.values()) > 100


def test_sets_that_meet_by_chance_stand_in_no_tree(spark, monkeypatch):
    """A phrase of many texts is a part of its own in some: these share a signature, more of them the larger the table, and no link."""
    rng, tables, write = random.Random(6), {}, jaccard.written

    def recorded(df, purpose):
        tables[purpose] = write(df, purpose)
        return tables[purpose]
    monkeypatch.setattr(jaccard, "written", recorded)
    rows = [(k, " ".join([f"a{rng.random()}" for _ in range(30)] + ["one", "phrase", "of", "five", "words"]
                         + [f"b{rng.random()}" for _ in range(30)])) for k in range(200)]
    rows += [(1000, rows[7][1] + " more"), (1001, "less " + rows[9][1]), (1002, rows[3][1])]
    got = jaccard.near_duplicates(docs(spark, rows), 5, 4, 5)
    assert [tuple(r) for r in got.filter("component_id <> doc_id").select("doc_id", "component_id").orderBy("doc_id").collect()] == [
        (1000, 7), (1001, 9), (1002, 3)]
    assert tables["members"].select("node").distinct().count() > 15
    assert sorted(r.doc_id for r in tables["tree-nodes"].collect()) == [7, 9, 1000, 1001]


def test_few_sets_need_a_catch_all():
    """Sets of any size are dealt by their parts; those with too many empty ones would all meet in one tree."""
    rng = np.random.default_rng(5)
    for num, den in ((9, 10), (4, 5)):
        for n in (100, 300, 800, 3000):
            with np.errstate(over="ignore"):
                spare = {int(jaccard.mix(np.full(1, c, np.uint64) * jaccard._B + jaccard._C)[0]) for c in range(60)}
            sets = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in range(40)]
            assert sum(bool(spare & set(jaccard.signatures(s, num, den).tolist())) for s in sets) <= 2


def test_tree_bounds_lose_no_link():
    rng = random.Random(4)
    sets = [np.unique(np.array([hash((rng.randint(0, 3), k)) & (1 << 62) - 1 for k in range(rng.randint(5, 90))], np.uint64)) for _ in range(90)]
    nodes = np.arange(90)
    found = jaccard.tree_links(nodes, sets, nodes.copy(), 4, 5)
    links = [(a, b) for a in range(90) for b in range(a) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    assert roots_of(nodes.tolist(), found) == roots_of(nodes.tolist(), links)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    want = {n: r for n, r in roots_of({n for e in links for n in e}, links).items() if n != r}
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_top(vectors, k, every):
    clean = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in vectors
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in clean:
        if q % every == 0:
            scores = sorted((-int(v @ x), i) for i, x in clean if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(2048, 1024, 0.05), (16, 4, 2.0), (16, 4, 0.0)])
def test_top_k_is_exact(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "CANDIDATES", sizes[0])
    monkeypatch.setattr(topk, "QUERIES", sizes[1])
    monkeypatch.setattr(topk, "SPARSE", sizes[2])           # 2: survivors one by one; 0: by the dense product
    rng = np.random.default_rng(9)
    vectors = [(i, rng.normal(0, 1, 10).astype(float).tolist()) for i in range(150)]
    vectors += [(200 + i, vectors[0][1]) for i in range(40)] + [(300, None), (None, vectors[1][1]), (305, [float("nan")] * 10),
                (310, [None] * 10), (315, [float("inf")] * 10), (320, [0.0] * 10), (325, [-1e6] * 10)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id bigint, embedding array<double>, rank int, block int")
    assert sorted(map(tuple, topk.top_k(table, 7, 5).collect())) == brute_top(vectors, 7, 5)
    few = [v for v in vectors if v[0] in (0, 1, 2)]
    assert sorted(map(tuple, topk.top_k(table.filter("vec_id < 3"), 7, 5).collect())) == brute_top(few, 7, 5)
    assert topk.top_k(table.limit(0)).count() == 0


def brute_hits(rows, items, size):
    def words(text):
        return [w for w in "".join(c if ord(c) > 127 or c.isalnum() else " " for c in lower(text)).split(" ") if w]
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - size + 1)) if w and item is not None else ():
            windows[tuple(w[s:s + size])].add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [100_000, 3])
def test_decontamination_is_exact(spark, monkeypatch, block):
    import hashlib
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    rng = random.Random(8)
    vocabulary = ["the", "of", "Äpfel", "cat", "DOG", "x9", "rare1", "rare2", "naïve"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 7, 9, 30])]
    items += [(20, None), (21, ""), (22, "..."), (None, "the of"), (23, items[4][1]), (24, "unseen words only here"), (7, items[7][1])]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "Prefix " + items[7][1].upper().replace("Ä", "ä") + ", suffix"), (None, items[5][1]),
             (103, items[5][1] * 3), (5, rows[5][1]), (6, "other text of the same id"), (104, "ÄPFEL äpfel Äpfel")]
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id bigint, text string, window string")
    found = decontaminate.decontaminate(docs(spark, rows), bench, size=5).collect()
    got = sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found], key=str)
    want = sorted([(i, n, h, k, hashlib.sha256(ids.encode()).hexdigest(), h > 0) for i, n, h, k, ids in brute_hits(rows, items, 5)], key=str)
    assert got == want
    for r in found:
        assert len({p for s in r.spans for p in range(s.start, s.stop)}) == r.n_hit


def test_a_window_of_very_many_items(spark):
    """Thousands of items share a window: they are counted where it occurs, and do not travel with the window."""
    bench = spark.range(3000).selectExpr("id AS item_id", "'one two three four five ' || id AS text")
    found = decontaminate.decontaminate(docs(spark, [(1, "zero one two three four five six"), (2, "nothing here")]), bench, size=5)
    assert {r.doc_id: (r.n_hit, r.n_items) for r in found.collect()} == {1: (5, 3000), 2: (0, 0)}


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate.decontaminate(docs(spark, [(1, "a b")]), bench).collect()] == [(2, 0)]
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0


def test_bitmaps_drop_no_possible_partner():
    """Sets of several sizes: whoever has a linked set in the tree stays, and most of those that have none leave."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 47, 3000).astype(np.uint64))
    sets = []
    for size in (300, 700, 1500, 2900):
        for _ in range(6):
            own = rng.choice(base[:size * 2] if size < 1500 else base, size, replace=False)
            sets.append(np.unique(own))
            changed = own.copy()
            changed[:size // 12] = rng.integers(0, 1 << 47, size // 12)
            sets.append(np.unique(changed))
        sets.append(np.unique(rng.integers(0, 1 << 47, size).astype(np.uint64)))
    sets = [jaccard.unpacked(jaccard.packed(s << np.uint64(16))) for s in sets]
    n = np.array([len(s) for s in sets])
    maps = [np.packbits(jaccard.bitmap(s, max(512, 1 << (2 * len(s) - 1).bit_length()))).tobytes() for s in sets]
    folded = jaccard.folded(maps)
    assert folded.shape == (len(sets), min(map(len, maps)) // 8)
    for i, s in enumerate(sets):
        assert (folded[i] == np.packbits(jaccard.bitmap(s, min(map(len, maps)) * 8)).view(np.uint64)).all()
    same = [k for k in range(len(sets)) if 2 * 700 <= 2 * n[k] <= 2 * 1500]
    for group in (list(range(len(sets))), same):
        tree = jaccard.folded([maps[k] for k in group])
        may = jaccard.with_partner(tree, n[group], 4, 5)
        for a, k in enumerate(group):
            linked = any(5 * len(np.intersect1d(sets[k], sets[j])) >= 4 * len(np.union1d(sets[k], sets[j])) for j in group if j != k)
            assert may[a] or not linked
    alone = jaccard.with_partner(jaccard.folded([maps[12], maps[25]]), n[[12, 25]], 4, 5)
    assert not alone.any()
