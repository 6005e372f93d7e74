"""The pipeline as a whole against plain Python, stage after stage, on a planted corpus."""

import collections
import importlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def planted(seed=11):
    """(documents, labels, benchmark); toxic documents are told by their words alone."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki") for b in ("lan", "mer", "nis", "por", "tul", "vex", "zon")]
    words = vocabulary + [f"{w}{k}" for w in vocabulary for k in range(30)]
    vile = ["scumbag", "idiots", "loathsome"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))
    rows, marks = [], []
    for i in range(400):
        toxic = i % 8 == 0
        lines = [prose(rng.randint(8, 40)) for _ in range(rng.randint(2, 6))]
        if toxic:
            lines[0] = " ".join(vile) + " " + lines[0]
        rows.append([i, "\n".join(lines), f"s{i % 2}" if i < 350 else "tiny"])
        if i % 3 or toxic:
            marks.append((i, 1, int(toxic)))
    passage = prose(30)
    for i in (1, 3, 5, 7, 9):                                   # a long passage on five documents of one source
        rows[i][1] += "\n" + passage
    for i in range(11, 71, 2):                                  # a footer on many
        rows[i][1] += "\nall rights reserved"
    bench = [(100 + k, prose(14)) for k in range(3)] + [(200, None), (201, ""), (202, "yes")]
    rows[20 + 1][1] += " and " + bench[0][1]
    rows[30 + 1][1] = bench[1][1] + " " + rows[31][1]
    rows[45][1] += " yes"
    for k, i in enumerate((51, 52, 53, 54)):                    # exact and near copies; ids above, so the originals stay
        rows.append([500 + k, rows[i][1], rows[i][2]])
        changed = rows[i][1].split(" ")
        changed[-1] = "changed"
        rows.append([600 + k, " ".join(changed), rows[i][2]])
    rows += [[700, None, "s0"], [701, "", "s1"], [702, prose(3000), "s1"], [703, " \n ", None]]
    return [(i, t, "en", s, len(t or "")) for i, t, s in rows], marks, bench


def without_lines(docs, often=(0.1, 10), seldom=(0.01, 0.001, 20, 3, 0.5)):
    pages, counts = collections.Counter(), collections.Counter()
    for _, text, source in docs:
        pages[source] += 1
        counts.update({(source, x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ")})
    out = []
    for i, text, source in docs:
        def dropped(line, bar):
            line = line.strip(" ")
            n, all_ = counts[source, line], pages[source]
            if not line:
                return False
            if bar == "often":
                return n > all_ * often[0] and n >= often[1]
            long = len(re.split(" +", line)) >= seldom[2]
            return not dropped(line, "often") and n > all_ * (seldom[1] if long else seldom[0]) and n >= seldom[3]
        if text is not None:
            lines = text.split("\n")
            kept = [x for x in lines if not dropped(x, "often")]
            size = sum(len(x.strip(" ")) for x in lines)
            gone = sum(len(x.strip(" ")) for x in lines if dropped(x, "seldom"))
            if gone <= size * seldom[4]:
                kept = [x for x in kept if not dropped(x, "seldom")]
            text = "\n".join(kept)
        out.append((i, text, source))
    return out


def without_copies(docs):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    sets, root = {i: shingles(t) for i, t, _ in docs}, {i: i for i, _, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1:]:
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [d for d in docs if find(d[0]) == d[0]]


def without_leaks(docs, bench):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    windows = {tuple(w[s:s + 10]) for _, t in bench for w in [words(t)] if w for s in range(max(len(w) - 9, 1))}
    out = []
    for doc in docs:
        w = words(doc[1])
        hit, long = set(), False
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s:s + size]) in windows:
                    hit |= set(range(s, s + size))
                    long |= size >= 10
        if not (hit and (long or 2 * len(hit) >= len(w))):
            out.append(doc)
    return out


def pieces_of(docs):
    out = {}
    for i, text, _ in docs:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start:start + 2048]
            out[i, k] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    return out


def test_all_stages_equal_plain_python(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rows, marks, bench = planted()
    for name, data, schema in (("documents", rows, DOCS), ("labels", marks, "doc_id bigint, quality int, toxic int"),
                               ("benchmark", bench, "item_id bigint, text string")):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    clean = [(i, t, s) for i, t, _, s, _ in rows if "scumbag" not in (t or "")]
    lines = without_lines(clean)
    assert sum(a[1] != b[1] for a, b in zip(clean, lines, strict=True)) >= 10
    single = without_copies(lines)
    kept = without_leaks(single, bench)
    assert len(rows) > len(clean) > len(single) > len(kept) > 300
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces_of(kept) and len(got) == len(pieces_of(kept))
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    fewest = -(-sum(r.length for r in got) // 2048)
    assert fewest <= len(sequences) <= fewest + 2
