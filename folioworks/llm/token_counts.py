"""Token counts by rank-synchronous merging: byte-level pair encoding over ragged arrays of pre-tokens.

All unseen pre-tokens of a batch lie in one flat array of symbols. A round finds each sequence's lowest-ranked adjacent
pair and merges all its occurrences in every sequence at the same time; sequences without a known pair leave. What
survives is counted. Counts of chunks and pre-tokens are kept per worker process, so each distinct word is merged about once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.tables import runs
from folioworks.llm.token_ids import LETTERS, MARKS, byte_letters

CACHE_WORDS = 400_000
NONE = np.int64(1) << 40
LATIN = re.compile(f"({LETTERS}+)({MARKS}*)")


class MergeCounter:
    """Counts tokens as the vocabulary file at `path` defines them, special strings included as single tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab, letters, end = model["vocab"], byte_letters(), model["end_of_word_suffix"]
        self.bytes = {letter: b for b, letter in letters.items()}
        self.size = len(self.vocab) + 1
        unknown = self.size - 1
        self.inner = np.array([self.vocab.get(letters[b], unknown) for b in range(256)], np.int64)
        self.final = np.array([self.vocab.get(letters[b] + end, unknown) for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pre_tokens = regex.compile(pattern)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.chunks: dict[str, int] = {"": 0}
        self.words: dict[str, int] = {}

    def _ranks(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rank of the pair that starts at each symbol; NONE where there is none or the sequence ends."""
        pair = symbols * self.size
        pair[:-1] += symbols[1:]
        at = np.searchsorted(self.keys, pair)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == pair) & ~last, self.ranks[at], NONE)

    def merge(self, words: list[str]) -> np.ndarray:
        """Number of symbols of each non-empty pre-token after all merges."""
        encoded = [w.encode() for w in words]
        sizes = np.array([len(b) for b in encoded], np.int64)
        raw = np.frombuffer(b"".join(encoded), np.uint8)
        symbols, ends = self.inner[raw], np.cumsum(sizes) - 1
        symbols[ends] = self.final[raw[ends]]
        counts, alive = sizes.copy(), np.arange(len(words))
        while len(alive):
            ends = np.cumsum(sizes) - 1
            starts = ends - sizes + 1
            last = np.zeros(len(symbols), bool)
            last[ends] = True
            ranks = self._ranks(symbols, last)
            lowest = np.minimum.reduceat(ranks, starts)
            hit = (ranks == np.repeat(lowest, sizes)) & (ranks < NONE)
            where = np.flatnonzero(hit)
            # Of hits that touch (a pair of equal symbols in a run), every second one merges.
            fresh = np.r_[True, np.diff(where) != 1] if len(where) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            symbols[where] = self.made[ranks[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            sizes = np.add.reduceat(keep, starts, dtype=np.int64)
            counts[alive] = sizes
            going = lowest < NONE
            keep &= np.repeat(going, ends - starts + 1)
            symbols, sizes, alive = symbols[keep], sizes[going], alive[going]
        return counts

    def _pieces(self, chunk: str) -> tuple[int, list[str]]:
        """Special strings in a chunk, and its pre-tokens."""
        parts = self.special.split(chunk)
        out: list[str] = []
        for part in parts[::2]:
            if part:
                if part.isascii() or LATIN.fullmatch(part):
                    out += self.pre_tokens.findall(part.lower())
                else:   # the library's own Unicode tables decide what a letter is
                    split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                    out += [bytes(map(self.bytes.__getitem__, word)).decode() for word, _ in split]
        return len(parts) // 2, out

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. A null text has none."""
        if len(self.chunks) > CACHE_WORDS or len(self.words) > CACHE_WORDS:
            self.chunks, self.words = {"": 0}, {}
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        unknown = set().union(*split).difference(self.chunks)
        pieces = {chunk: self._pieces(chunk) for chunk in unknown}
        new = list({word for _, words in pieces.values() for word in words}.difference(self.words))
        if new:
            self.words.update(zip(new, self.merge(new).tolist(), strict=True))
        known = self.words.__getitem__
        self.chunks.update((chunk, extra + sum(map(known, words))) for chunk, (extra, words) in pieces.items())
        return [sum(map(self.chunks.__getitem__, chunks)) for chunks in split]


@lru_cache(maxsize=1)
def counter(path: str) -> MergeCounter:
    """The worker process's counter: tasks that follow one another in it share what it knows."""
    return MergeCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens. A null id stays null, repeated rows stay repeated, an empty table
    gives no rows, other columns are not read. Texts of any length are counted whole.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(tokenizer_path)
        for batch in batches:
            for run in runs(batch, "text"):
                counts = known.count(run.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), run.column("n_bytes"),
                                                  pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    counted = rows.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
