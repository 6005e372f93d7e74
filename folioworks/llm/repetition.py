"""Quality rules from what a text repeats: characters inside duplicated word n-grams and lines.

Every distinct word of a run of texts gets a number; n-gram hashes roll on from one length to the next, and only places whose
shorter n-gram is duplicated go on to the longer one, so that long lengths cost next to nothing in ordinary prose. All
texts of a run are worked on at once; an n-gram never spans two texts, and equal n-grams of different texts are different.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.tables import RUN_BYTES, runs

CACHE_WORDS = 400_000
SPACES = b" \t\n\r\x0b\x0c"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Rules:
    """Bars in percent of the characters in words; a text over one of them is not kept.

    `top`: characters of the most frequent n-gram times its number, by n. `covered`: characters of words inside any n-gram
    found twice or more, first one included, by n. `lines`: characters of words in lines equal to another line, first one
    included. `base_width` and `base_percent` bound the words in repeated windows, `least_words` the length.
    """

    least_words: int = 50
    base_width: int = 3
    base_percent: int = 50
    top: tuple[tuple[int, int], ...] = ((2, 20), (3, 18), (4, 16))
    covered: tuple[tuple[int, int], ...] = ((5, 30), (6, 28), (7, 26), (8, 24), (9, 22), (10, 20))
    lines: int = 40
    symbols: bytes = b"#*$%&|<>"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def pieces(text: bytes, limit: int = RUN_BYTES) -> Iterator[bytes]:
    """A text in pieces of about `limit` bytes, cut at white space, so that a list of words stays small."""
    start = 0
    while len(text) - start > limit:
        cut = max(text.rfind(c, start, start + limit) for c in (SPACES[i:i + 1] for i in range(len(SPACES)))) + 1
        if cut <= start:                # one word fills the piece
            found = [p for p in (text.find(SPACES[i:i + 1], start + limit) for i in range(len(SPACES))) if p >= 0]
            cut = min(found, default=len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


class Words:
    """Word numbers of texts, and the code points of each word."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.chars = np.zeros(1 << 16, np.int64)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words one after the other, and the number of words of each text."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        parts, sizes = [np.zeros(0, np.int64)], []
        for text in texts:
            sizes.append(0)
            for piece in pieces(text):
                words = piece.split()
                for word in set(words).difference(self.known):
                    self._learn(word)
                parts.append(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
                sizes[-1] += len(words)
        return np.concatenate(parts), np.array(sizes, np.int64)

    def _learn(self, word: bytes) -> None:
        number = self.known[word] = len(self.known)
        if number >= len(self.chars):
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.chars[number] = len(word.decode("utf-8", "replace"))


def duplicated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs twice or more, and how often."""
    order = np.argsort(keys)
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])[:len(keys)]
    counts = np.diff(np.append(np.flatnonzero(new), len(keys)))
    times = np.empty(len(keys), np.int64)
    times[order] = np.repeat(counts, counts)
    return times > 1, times


def inside(places: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of `total` words lie in windows of `width` words that start at the places."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + width, -1)
    return np.cumsum(steps[:-1]) > 0


class Measured:
    """What is counted of a run of texts, one number per text each."""

    def __init__(self, texts: list[bytes], words: Words, rules: Rules) -> None:
        ids, sizes = words.of(texts)
        chars, ends = words.chars[ids], np.cumsum(sizes)
        self.owner, self.n_words = np.repeat(np.arange(len(sizes)), sizes), sizes
        self.word_chars = self._per_text(chars)
        self.n_symbols = np.array([sum(t.count(s) for s in rules.symbols) for t in texts], np.int64)
        self.top: dict[int, np.ndarray] = {}
        self.covered: dict[int, np.ndarray] = {}
        self.n_repeat_words = np.zeros(len(sizes), np.int64)
        before = np.concatenate([[0], np.cumsum(chars)])
        places, last = np.arange(len(ids)), ends[self.owner]
        single = mix(ids.astype(np.uint64) + _A)
        rolled = mix(single + self.owner.astype(np.uint64) * _B)
        top, covered = dict(rules.top), dict(rules.covered)
        for width in range(2, max(*top, *covered, rules.base_width) + 1):
            fits = places + width <= last[places]
            places, rolled = places[fits], rolled[fits]
            rolled = mix(rolled * _A + single[places + width - 1])
            twice, times = duplicated(rolled)
            places, rolled, times = places[twice], rolled[twice], times[twice]
            if width in top:
                most = np.zeros(len(sizes), np.int64)
                np.maximum.at(most, self.owner[places], times * (before[places + width] - before[places]))
                self.top[width] = most
            if width in covered:
                self.covered[width] = self._per_text(chars * inside(places, width, len(ids)))
            if width == rules.base_width:
                self.n_repeat_words = self._per_text(inside(places, width, len(ids)))
        self._lines(texts)

    def _per_text(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return np.diff(sums[np.concatenate([[0], np.cumsum(self.n_words)])])

    def _lines(self, texts: list[bytes]) -> None:
        """Of the lines with a word: those equal to an earlier one, and the characters in words of lines that have an equal."""
        self.n_dup_lines, self.line_chars = (np.zeros(len(texts), np.int64) for _ in range(2))
        for i, text in enumerate(texts):
            times: dict[bytes, int] = {}
            for line in text.split(b"\n"):
                if line.strip(SPACES):
                    times[line] = times.get(line, 0) + 1
            self.n_dup_lines[i] = sum(times.values()) - len(times)
            if self.n_dup_lines[i]:
                self.line_chars[i] = sum(n * sum(len(w.decode("utf-8", "replace")) for w in line.split())
                                         for line, n in times.items() if n > 1)

    def failed(self, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
        """Texts that fail the base rules, and those over a bar of the method."""
        base = (self.n_words < rules.least_words) | (100 * self.n_repeat_words > rules.base_percent * self.n_words)
        over = 100 * self.line_chars > rules.lines * self.word_chars
        for bars, found in ((rules.top, self.top), (rules.covered, self.covered)):
            for width, percent in bars:
                over |= 100 * found[width] > percent * self.word_chars
        return base, over


def quality_rules(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and for the method top_n and covered_n (characters by n-gram length) and line_chars.

    Words are runs of anything but ASCII white space. A null or empty text has none of anything, so it fails the base
    rules. Repeated rows and null ids are judged like any other; an empty table gives no rows. Texts are taken whole, of
    any length; other columns are not read. Equal n-grams are found by 64-bit hashes within a text: in one of ten million
    words the chance of any stray match is below 1e-5.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    extra = [f"top_{n}" for n, _ in rules.top] + [f"covered_{n}" for n, _ in rules.covered] + ["line_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in runs(batch, "text"):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                found = Measured(texts, words, rules)
                base, over = found.failed(rules)
                columns = ([getattr(found, name) for name in counts] + [base, ~(base | over)]
                           + [found.top[n] for n, _ in rules.top] + [found.covered[n] for n, _ in rules.covered]
                           + [found.line_chars])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)],
                                                 ["doc_id", *counts, "base_failed", "kept", *extra])

    schema = ", ".join(["doc_id bigint", *[f"{c} bigint" for c in counts], "base_failed boolean", "kept boolean",
                        *[f"{c} bigint" for c in extra]])
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
