"""Token ids of whole texts by the tokenizers library, each distinct word encoded about once per worker process.

The vocabulary drops white space and never merges across it, so the ids of a text are those of its space-separated
chunks in order. A chunk of Latin letters with trailing punctuation is one word and one mark; any other chunk goes through the
library's whole pipeline. Chunks are split, numbered and taken apart in Arrow; Python sees each distinct part of a run of
texts once, and the library each new one. Memory is bounded: the cache starts anew when full, which changes nothing in the ids.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]", r"[!-/:-@\[-`{-~]"
ODD = "\0"                  # begins the name of a part that is a whole chunk
CACHE_WORDS, CACHE_IDS = 250_000, 2_500_000
RUN = 4 << 20               # bytes of text worth encoding at once


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte, as byte-level vocabularies define it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Numbered(dict):
    """Numbers its keys in the order in which they are first looked up; `new` lists those not dealt with yet."""

    def __init__(self) -> None:
        super().__init__({"": 0})
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number

    def taken(self) -> list[str]:
        """The new keys; the list starts anew."""
        new, self.new = self.new, []
        return new


class TextEncoder:
    """Ids of many texts at once, as flat arrays."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.letters = self.library.model, byte_letters()
        self._reset()

    def _reset(self) -> None:
        """Part → place in `starts` and `lengths`; place 0 is the empty part."""
        self.words = Numbered()
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int32)

    def _store(self, first: int, encoded: list[list[int]]) -> None:
        """Append the ids of new parts, numbered from `first`."""
        sizes = np.fromiter(map(len, encoded), np.int32, len(encoded))
        last, more = first + len(encoded), int(sizes.sum())
        self.flat = _room(self.flat, self.used + more)
        self.starts, self.lengths = _room(self.starts, last), _room(self.lengths, last)
        self.flat[self.used:self.used + more] = np.fromiter(chain.from_iterable(encoded), np.int32, more)
        self.lengths[first:last] = sizes
        self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
        self.used += more

    def _tokenize(self, word: str) -> list[int]:
        inner = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [token.id for token in self.model.tokenize(inner)]

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """The number of each part; new ones are noted."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        return np.fromiter(map(self.words.__getitem__, distinct), np.int32, len(distinct))[coded.indices.to_numpy()]

    def _parts(self, chunks: pa.Array) -> np.ndarray:
        """Two parts of each chunk: a word and a mark, or one of its own from the library's pipeline and the empty one."""
        known, found = len(self.words), pc.extract_regex(chunks, f"^(?P<word>{LETTERS}+)(?P<mark>{MARKS}*)$")
        word = pc.if_else(found.is_valid(), pc.utf8_lower(pc.struct_field(found, "word")), pc.binary_join_element_wise(ODD, chunks, ""))
        both = np.stack([self._numbers(word), self._numbers(pc.fill_null(pc.struct_field(found, "mark"), ""))], axis=1)
        new = self.words.taken()
        odd = [part[1:] for part in new if part[0] == ODD]
        whole = iter(self.library.encode_batch_fast(odd, add_special_tokens=False) if odd else ())
        self._store(known, [next(whole).ids if part[0] == ODD else self._tokenize(part) for part in new])
        return both

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids of each. A null text is an empty one."""
        if len(self.words) > CACHE_WORDS or self.used > CACHE_IDS:
            self._reset()
        filled = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        split = pc.split_pattern(pc.replace_substring(filled, "\n", " "), " ")
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        chunks = pc.list_flatten(split).dictionary_encode()
        both = self._parts(chunks.dictionary)[chunks.indices.to_numpy()].reshape(-1)    # a word, its mark, the next word, …
        ids, sizes = gather(self.flat, self.starts[both], self.lengths[both])
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        bounds = np.concatenate([[0], np.cumsum(per_text, dtype=np.int64)])
        return ids, np.diff(ends[2 * bounds])


@lru_cache(maxsize=1)
def encoder(path: str) -> TextEncoder:
    """The worker process's encoder: tasks that follow one another in it share what it knows."""
    return TextEncoder(path)


def _room(values: np.ndarray, rows: int) -> np.ndarray:
    """`values`, grown so that it has at least `rows` rows."""
    while len(values) < rows:
        values = np.concatenate([values, np.zeros_like(values)])
    return values


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[s:s+n] for every start and size, concatenated."""
    total = int(sizes.sum())
    place = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    before = np.cumsum(sizes, dtype=np.int64) - sizes
    at = np.repeat((starts - before).astype(place), sizes)
    at += np.arange(total, dtype=place)
    return flat[at], sizes
