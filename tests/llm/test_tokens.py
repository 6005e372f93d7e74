"""Token counts, the grammar store and packing against the library and brute force."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioworks.llm import grammar_store, packing, token_counts
from folioworks.llm.token_ids import TextEncoder
from tests.llm.tables import awkward, docs

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("abAB'st.,<|endoftext|> \n\tÉéßΣσİ中9", max_size=60)), max_size=8)
COUNTER, ENCODER = token_counts.MergeCounter(PATH), TextEncoder(PATH)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_counts_and_ids_are_the_library_s(texts):
    want = [ids(t) for t in texts]
    assert COUNTER.count(texts) == [len(w) for w in want]
    flat, sizes = ENCODER.encode(texts)
    assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("cache", ["CACHE_WORDS", "CACHE_IDS"])
def test_caches_that_start_anew_change_nothing(monkeypatch, cache):
    monkeypatch.setattr(f"folioworks.llm.token_ids.{cache}", 5)
    monkeypatch.setattr("folioworks.llm.token_counts.CACHE_WORDS", 5)
    encoder, counter = TextEncoder(PATH), token_counts.MergeCounter(PATH)
    for _, text in awkward():
        assert encoder.encode([text])[0].tolist() == ids(text) and counter.count([text]) == [len(ids(text))]


def test_counts_of_awkward_rows(spark):
    rows = awkward()
    got = token_counts.token_counts(docs(spark, rows), PATH, limit=100)
    want = [(i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 100) for i, t in rows]
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs(spark, rows).limit(0), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=60), min_size=1, max_size=6), st.data())
def test_grammar_round_trip_and_spans(documents, data):
    flat = np.array([i for d in documents for i in d], np.int32)
    symbols, rules, lengths, ends = grammar_store.compress(flat, np.cumsum([len(d) for d in documents]) - 1, least=2)
    assert grammar_store.expand(symbols, rules, lengths).tolist() == flat.tolist()
    assert len(ends) == len(documents)
    row = {"low": (symbols & 0xFFFF).astype("<u2").tobytes(), "high": (symbols >> 16).astype(np.uint8).tobytes(),
           "rules": rules.astype("<i4").tobytes(), "expansions": lengths.astype("<i8").tobytes(),
           "symbol_starts": [0, *(ends[:-1] + 1).tolist()]}
    doc = data.draw(st.integers(0, len(documents) - 1))
    start = data.draw(st.integers(0, 70))
    stop = data.draw(st.integers(0, 70))
    assert grammar_store.decode_span(row, doc, start, stop).tolist() == documents[doc][start:max(start, stop)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=80), min_size=1, max_size=4), st.integers(2, 4))
def test_no_pair_is_left(documents, least):
    flat = np.array([i for d in documents for i in d], np.int32)
    symbols, _, _, ends = grammar_store.compress(flat, np.cumsum([len(d) for d in documents]) - 1, least=least)
    counts, start = defaultdict(int), 0
    for end in ends.tolist():
        held = {}                                       # where the pair was last counted: overlapping ones count once
        for i in range(start, end):
            pair = (int(symbols[i]), int(symbols[i + 1]))
            if held.get(pair) != i - 1:
                counts[pair] += 1
                held[pair] = i
        start = end + 1
    assert max(counts.values(), default=0) < least


def test_repetition_becomes_rules():
    flat = np.array([7, 8, 9, 10] * 500, np.int32)
    symbols, rules, _, _ = grammar_store.compress(flat, np.array([len(flat) - 1]))
    assert len(symbols) < len(flat) / 8 and len(rules) >= 2


@pytest.mark.parametrize("block_tokens", [1 << 20, 300])
def test_store_returns_every_document(spark, block_tokens):
    rows = [r for r in awkward() if r[0] is not None]
    blocks = grammar_store.write_blocks(docs(spark, rows), PATH, 2, block_tokens)
    got = sorted(map(tuple, grammar_store.read_documents(blocks).collect()))
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        own = [*ids(t), 2]
        want.append((i, start, len(own), crc(own)))
        start += len(own)
    assert got == sorted(want)


def test_store_takes_null_ids_and_empty_tables(spark):
    blocks = grammar_store.write_blocks(docs(spark, [(None, "b"), (1, None), (None, "a")]), PATH)
    got = sorted(map(tuple, grammar_store.read_documents(blocks).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1] and got[-1][2] == 1
    assert grammar_store.read_documents(grammar_store.write_blocks(docs(spark, []), PATH)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 2000), max_size=30))
def test_plan_places_every_piece_once(counts):
    used, sequences = defaultdict(int), 0
    for kinds, times in packing.plan(counts, 64):
        assert sum(length * n for length, n in kinds) <= 64 and times > 0
        sequences += times
        for length, n in kinds:
            used[length] += n * times
    assert dict(used) == counts
    least = max(-(-sum(k * n for k, n in counts.items()) // 64), sum(n for k, n in counts.items() if k > 32))
    assert least <= sequences <= 1.7 * least + 1


def test_two_fit_beats_greedy():
    # Greedy leaves 10+5+… with a gap; two documents that fit together take the smallest one's place.
    kinds, _ = packing.plan({60: 1, 30: 1, 7: 1, 5: 2, 4: 1}, 100)[0]
    assert sum(length * n for length, n in kinds) == 100


def test_packing_awkward_rows(spark):
    rows = [r for r in awkward() if r != (3, dict(awkward())[3])]
    got = packing.pack(docs(spark, rows), PATH, end_id=0, size=64).collect()
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    for i, t in rows:
        own = [*ids(t), 0]
        want = [(k, 64 * k, len(own[64 * k:64 * k + 64]), crc(own[64 * k:64 * k + 64])) for k in range(-(-len(own) // 64))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == want
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 64) * 1.05 + 1
    assert packing.pack(docs(spark, []), PATH).count() == 0


def test_packing_encodes_in_little_memory():
    """Four megabytes of text take a task a bounded share of them at a time."""
    import tracemalloc

    import pyarrow as pa

    from folioworks.llm.tables import runs
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}, " for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(["".join(words[k:] + words[:k]) for k in [*range(600)] * 2])], ["text"])
    encoder = TextEncoder(PATH)
    encoder.encode(words)
    tracemalloc.start()
    for run in runs(batch, "text", packing.RUN):
        encoder.encode(run.column("text"))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert batch.nbytes > 4 << 20 and peak < 32 << 20, peak
