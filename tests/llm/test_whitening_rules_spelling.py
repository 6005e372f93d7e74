"""Operators 11 to 13 against brute force on tables with awkward rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from folioworks.llm import repetition, spelling, whitening
from tests.llm.tables import awkward, docs

VECTORS = "vec_id bigint, embedding array<float>, n bigint, id int, v string, component int"


def vectors(spark, rows):
    """(vec_id, embedding); the other columns clash with names used inside."""
    return spark.createDataFrame([(i, v, 1, 2, "v", 3) for i, v in rows], VECTORS)


def awkward_vectors(dim=7, n=300):
    rng = np.random.default_rng(3)
    mixing = rng.normal(0, 0.3, (dim, dim)) * np.linspace(3, 0.2, dim)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 1, dim) @ mixing)]) for i in range(n)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]                    # a third are copies
    rows += [(2000, None), (2001, [None] * dim), (2002, [math.nan] + [0.0] * (dim - 1)), (2003, [math.inf] + [0.0] * (dim - 1)),
             (2004, []), (2005, [1.0, 2.0]), (None, rows[7][1]), (7, rows[7][1]), (2006, [-0.0] * dim), (2007, [0.001] * dim)]
    return rows


def expected_whitening(rows, dim):
    usable = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    grid = np.array([[math.floor(256 * float(np.float32(x))) for x in v] for _, v in usable])
    fit = np.unique(grid, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return usable, grid, n, s, values[order], axes[:, order]


def test_whitening_equals_dense_eigenvectors(spark):
    rows, dim = awkward_vectors(), 7
    usable, grid, n, s, values, axes = expected_whitening(rows, dim)
    got = whitening.whiten(vectors(spark, rows).repartition(5)).collect()
    assert len(got) == 4 * len(usable)
    deviation = collections.Counter((i, int(d)) for (i, _), d in zip(usable, ((n * grid - s) ** 2).sum(axis=1)))
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert 0 <= got[0]["identity_error"] < 1e-9
    for c in range(1, 5):
        own = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c}
        right = {i: (x - s / n) @ axes[:, c - 1] / math.sqrt(values[c - 1]) for (i, _), x in zip(usable, grid)}
        sign = np.sign(own[0] * right[0])
        assert own.keys() == right.keys() and all(abs(own[i] - sign * right[i]) < 1e-8 for i in own)
        assert all(abs(r["explained"] - values[c - 1] / values.sum()) < 1e-9 for r in got if r["component"] == c)


@pytest.mark.parametrize("rows,expected", [([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0])] * 3, 0),
                                           ([(1, [1.0, 2.0]), (2, [3.0, 2.0])], 2), ([(1, [0.5]), (2, [0.7]), (3, [0.9])], 3)])
def test_whitening_of_few_rows(spark, rows, expected):
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == expected and all(r["identity_error"] < 1e-9 for r in got)


def test_whitening_beyond_long(spark):
    rows = [(1, [1e30, 1.0]), (2, [-3e20, 2.0]), (3, [5.0, 3.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3} and any(r["deviation"] is None for r in got)


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    values = 10.0 ** -np.arange(9)
    turned = whitening.rotated(whitening.pivoted_cholesky(q * values @ q.T))
    norms = np.sort((turned ** 2).sum(axis=0))[::-1]
    assert np.allclose(norms, values, rtol=1e-6)


def repetition_of(text, rules=repetition.Rules()):
    """Plain version: strings, no hashes."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    def starts(n):
        times = collections.Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
        return {i for i in range(len(words) - n + 1) if times[tuple(words[i:i + n])] > 1}, times
    def covered(n):
        return {i + k for i in starts(n)[0] for k in range(n)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times = collections.Counter(lines)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
           "n_dup_lines": len(lines) - len(times), "n_repeat_words": len(covered(3)),
           "line_chars": sum(len("".join(re.findall(r"[^\x20\x09-\x0D]+", x))) for x in lines if times[x] > 1)}
    for n, _ in rules.top:
        out[f"top_{n}"] = max((c * len("".join(w)) for w, c in starts(n)[1].items() if c > 1), default=0)
    for n, _ in rules.covered:
        out[f"covered_{n}"] = sum(len(words[i]) for i in covered(n))
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    over = 100 * out["line_chars"] > rules.lines * out["word_chars"]
    over = over or any(100 * out[f"{name}_{n}"] > p * out["word_chars"]
                       for name, bars in (("top", rules.top), ("covered", rules.covered)) for n, p in bars)
    out["kept"] = not (out["base_failed"] or over)
    return out


def test_repetition_equals_plain_counts(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]                 # noqa: E731
    passage = " ".join(prose(30))
    rows = awkward() + [(100, " ".join(prose(300))), (101, "\n".join([" ".join(prose(9)) for _ in range(30)] * 2)),
                        (102, " ".join(prose(100)) + " " + passage + "\n" + " ".join(prose(50)) + " " + passage),
                        (103, " ".join(["a b"] * 200)), (104, "#1 *2\v$3 " + " ".join(prose(70))),
                        (105, "\n".join([passage] * 3 + [" ".join(prose(80))])), (106, " ".join(prose(60_000)))]
    got = repetition.quality_rules(docs(spark, rows).repartition(3)).collect()
    def key(r):
        return str(sorted(r.items(), key=str))
    expected = sorted(({"doc_id": i} | repetition_of(t) for i, t in rows), key=key)
    assert sorted((r.asDict() for r in got), key=key) == expected
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[100] and kept[106] and not kept[101] and not kept[103] and not kept[51] and not kept[105]


def test_pieces_keep_words_whole():
    text = b"one two\tthree " + b"x" * 50 + b"\nfour  five"
    for limit in range(1, 80):
        parts = list(repetition.pieces(text, limit))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def test_repetition_of_no_rows(spark):
    assert repetition.quality_rules(docs(spark, [])).count() == 0


def edits(a, b):
    """Whether two words differ by exactly one edit."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected_variants(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and edits(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelled(seed=4):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abeéÿXt") for _ in range(rng.randint(6, 11))) for _ in range(60)]
    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abñ") + w[i:], w[:i] + rng.choice("abñ") + w[i + 1:]])
    rows = []
    for doc in range(120):
        own = [rng.choice(stems) for _ in range(60)] + [typo(rng.choice(stems)) for _ in range(6)]
        own += [typo(typo(stems[k])) for k in range(3)] + ["seven×seven", "a" * rng.choice([7, 8, 9, 400])] * 2
        rows.append((doc, " ".join(own)))
    rows += [(200, " ".join(["heavily"] * 300)), (201, " ".join(["heavil"] * 3 + ["heavilyy"] * 20 + ["heavilyyz"] * 2))]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (300, None), (301, ""), (302, "x" * 6)]
    return rows


@pytest.mark.parametrize("limit", [spelling.GROUP_WORDS, 5])
def test_variants_equal_plain_comparison(spark, limit):
    rows = spelled()
    got = spelling.variants(docs(spark, rows).repartition(3), limit=limit).collect()
    expected = expected_variants(rows)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == expected
    assert len(got) == len(expected) and any(f for f, *_ in expected.values())
    assert any(r["form"] and r["root"] != r["form"] for r in got)


def test_large_group_is_divided(spark):
    words = [("prefixed" + a + b + c + d, 2) for a in "abcdef" for b in "abcdef" for c in "abcd" for d in "abcd"]
    table = spark.createDataFrame(words, "word string, n bigint")
    sizes = spelling.groups(table, 40).groupBy("m", "a", "b", "head", "tail", "back").count()
    assert sizes.filter("count > 40").count() == 0
    got = {(r["word"], r["near"]) for r in spelling.near_words(table, 40).collect()}
    assert got == {(v, w) for v, _ in words for w, _ in words if edits(v, w)}


def test_variants_of_no_rows(spark):
    assert spelling.variants(docs(spark, [])).count() == 0
