"""Token ids on disk under Re-Pair grammars: blocks of documents, each with its own rules.

A block holds consecutive documents in id order. Its ids are one sequence in which frequent adjacent pairs were replaced
by nonterminals, pass after pass, until no pair can be replaced eight times; no pair spans two documents. Stored with it
are the rules (left, right), every nonterminal's expansion length, and where each document starts in symbols and in ids,
so that any span of ids is decoded from the symbols that cover it and nothing else. A pass takes all frequent pairs at
once instead of one: the grammar is the same kind, and later passes look only at places next to new symbols. Ranges of
documents are dealt to tasks by id; a task's memory is bounded by one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.tables import runs, written
from folioworks.llm.token_ids import RUN, encoder, gather

FIRST_RULE = 1 << 17        # nonterminals are numbered from here
LARGEST = 1 << 24           # symbols are stored in three bytes
LEAST = 8                   # occurrences that are worth a rule
BLOCK_SCHEMA = ("part int, block int, first_doc bigint, doc_ids array<bigint>, n_tokens array<bigint>, "
                "symbol_starts array<bigint>, tokens bigint, rules binary, expansions binary, low binary, high binary")


def frequent(keys: np.ndarray, least: int) -> np.ndarray:
    """The pairs that occur `least` times or more, the most frequent first; exact, by sorting."""
    keys = np.sort(keys)
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    counts = np.diff(ends, prepend=0)
    often = np.flatnonzero(counts >= least) if len(keys) else ends[:0]
    return keys[ends[often[np.argsort(-counts[often], kind="stable")]] - 1]


def slot(keys: np.ndarray) -> np.ndarray:
    """Place of a pair in a table of 2^21."""
    return (keys * np.int64(-7046029254386353131)).view(np.uint64) >> np.uint64(43)


def compress(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Replace pairs until none can be replaced `least` times. `ends`: index of each document's last id. Returns symbols,
    rules, lengths, ends.

    A pass takes all frequent pairs at once; where they overlap, every other one. What it leaves behind can only have become
    frequent next to a new symbol, so the next pass counts there, and where pairs were chosen and yet not replaced. When
    all chosen pairs stand in each other's way, they are taken one by one.
    """
    symbols, last = ids.astype(np.int32), np.zeros(len(ids), bool)
    last[ends] = True
    rules, lengths, made = [np.zeros((0, 2), np.int64)], np.zeros(0, np.int64), 0
    at, turn = np.flatnonzero(~last[:-1]), None         # a pair over a document's end is none
    table = np.full(1 << 21, -1, np.int32)
    while len(at):
        keys = (symbols[at].astype(np.int64) << 32) | symbols[at + 1]
        chosen = frequent(keys, least)[:LARGEST - FIRST_RULE - made]
        if turn is not None:
            chosen = chosen[turn:turn + 1]
        slots = slot(chosen)
        table[slots[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]      # of pairs that share a slot the first
        rank = table[slot(keys)]
        table[slots] = -1
        again = at[rank >= 0]
        exact = (rank >= 0) & (chosen[rank] == keys) if len(chosen) else rank >= 0
        where, rank = at[exact], rank[exact]
        fresh = np.diff(where, prepend=-2) != 1         # a run of overlapping pairs: every other one of it
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
        every = (np.arange(len(where)) - run) % 2 == 0
        where, rank = where[every], rank[every]
        used = np.bincount(rank, minlength=len(chosen)) >= least
        where, rank = where[used[rank]], rank[used[rank]]
        if not len(where):
            if not len(chosen):
                break
            turn = 0 if turn is None else turn + 1
            continue
        turn = None
        rule = np.stack([chosen[used] >> 32, chosen[used] & 0xFFFFFFFF], axis=1)
        rules.append(rule)
        lengths = np.concatenate([lengths, expansion(rule[:, 0], lengths) + expansion(rule[:, 1], lengths)])
        symbols[where] = FIRST_RULE + made + (np.cumsum(used) - 1)[rank]
        last[where] |= last[where + 1]
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        open_ = np.zeros(len(symbols), bool)
        open_[again] = open_[where] = True
        open_[where[where > 0] - 1] = True              # …, or two before, where a symbol between was swallowed
        open_[where[where > 1] - 2] |= ~keep[where[where > 1] - 1]
        symbols, last, open_ = symbols[keep], last[keep], open_[keep]
        made += len(rule)
        at = np.flatnonzero(open_[:-1] & ~last[:-1])
    return symbols, np.concatenate(rules), lengths, np.flatnonzero(last)


def expansion(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of ids each symbol stands for."""
    rule = symbols - FIRST_RULE
    known = np.append(lengths, 1)
    return np.where(rule >= 0, known[np.clip(rule, -1, len(lengths) - 1)], 1)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids behind a sequence of symbols: every rule's expansion is laid out once, the shorter ones first, then gathered."""
    needed, new = np.zeros(len(rules), bool), np.unique(symbols[symbols >= FIRST_RULE]) - FIRST_RULE
    while len(new):
        needed[new] = True
        below = np.unique(rules[new])
        below = below[below >= FIRST_RULE] - FIRST_RULE
        new = below[~needed[below]]
    own = np.flatnonzero(needed)
    own = own[np.argsort(lengths[own], kind="stable")]          # a rule is longer than those it is made of
    sizes, child = lengths[own], rules[own].reshape(-1)
    starts = np.zeros(len(rules) + 1, np.int64)
    starts[own] = len(child) + np.cumsum(sizes) - sizes
    laid = np.concatenate([child, np.zeros(int(sizes.sum()), np.int64), symbols])

    def source(of: np.ndarray, first: int) -> np.ndarray:
        return np.where(of >= FIRST_RULE, starts[np.maximum(of - FIRST_RULE, -1)], first + np.arange(len(of)))

    begin, part = source(child, 0), expansion(child, lengths)
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(own)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            data, _ = gather(laid, begin[2 * a:2 * b], part[2 * a:2 * b])
            laid[starts[own[a]]:starts[own[a]] + len(data)] = data
    return gather(laid, source(symbols, len(laid) - len(symbols)), expansion(symbols, lengths))[0]


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules and expansion lengths of a stored block."""
    low, high = np.frombuffer(row["low"], "<u2"), np.frombuffer(row["high"], np.uint8)
    rules = np.frombuffer(row["rules"], "<i4").reshape(-1, 2).astype(np.int64)
    return low.astype(np.int64) | high.astype(np.int64) << 16, rules, np.frombuffer(row["expansions"], "<i8")


def decode_span(row: dict, doc: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop-1 of the block's document at place `doc`, expanding only the symbols that cover them."""
    symbols, rules, lengths = unpack(row)
    first = row["symbol_starts"][doc]
    end = row["symbol_starts"][doc + 1] if doc + 1 < len(row["symbol_starts"]) else len(symbols)
    own = symbols[first:end]
    ends = np.cumsum(expansion(own, lengths))
    start, stop = max(0, start), min(stop, int(ends[-1]) if len(ends) else 0)
    if start >= stop:
        return np.zeros(0, np.int64)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(own[a:b], rules, lengths)[start - skipped:stop - skipped]


def write_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = 2, block_tokens: int = 1 << 20,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and store them as grammar-compressed blocks in ascending id order; returns the stored table.

    Every document is closed by `end_id`; a null or empty text is that id alone. Null ids come first; rows that share an
    id keep their own entries side by side, in an order that depends on their texts alone; however many, they are dealt to
    several tasks. A block closes once it holds `block_tokens` ids, so only a
    single longer document makes a longer block. Other columns are not read. An empty table gives no blocks.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part, block = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal block, held
            sequence, n = np.concatenate(ids), np.concatenate(sizes)
            symbols, rules, lengths, ends = compress(sequence, np.cumsum(n) - 1)
            row = {"part": part, "block": block, "first_doc": names[0], "doc_ids": list(names), "n_tokens": n.tolist(),
                   "symbol_starts": [0, *(ends[:-1] + 1).tolist()], "tokens": int(n.sum()),
                   "rules": rules.astype("<i4").tobytes(), "expansions": lengths.astype("<i8").tobytes(),
                   "low": (symbols & 0xFFFF).astype("<u2").tobytes(), "high": (symbols >> 16).astype(np.uint8).tobytes()}
            block, held = block + 1, 0
            for kept in (ids, names, sizes):
                kept.clear()
            return pa.RecordBatch.from_pylist([row], BLOCK_ARROW)

        for batch in batches:
            for run in runs(batch, "text", RUN):
                flat, n = reader.encode(run.column("text"))
                closed = np.insert(flat, np.cumsum(n), end_id)
                ids.append(closed)
                sizes.append(n + 1)
                names += run.column("doc_id").to_pylist()
                held += len(closed)
                if held >= block_tokens:
                    yield close()
        if names:
            yield close()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(encode, BLOCK_SCHEMA), "token-blocks")


_LONGS = pa.list_(pa.int64())
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("doc_ids", _LONGS),
                         ("n_tokens", _LONGS), ("symbol_starts", _LONGS), ("tokens", pa.int64()), ("rules", pa.binary()),
                         ("expansions", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def read_documents(blocks: DataFrame) -> DataFrame:
    """Every stored document from its block: doc_id, start (ids before it over all blocks), n_tokens, ids_crc32.

    Blocks are numbered within parts, and parts cover ascending id ranges: running totals over the parts, then over a
    part's blocks, give each block its start.
    """
    totals = blocks.groupBy("part").agg(F.sum("tokens").alias("_n"), F.min(F.struct("first_doc", "part")).alias("_o"))
    before = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = (blocks.select("part", "block", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("_inside"))
              .join(parts, "part").select("part", "block", (F.col("_part_start") + F.col("_inside")).alias("base")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids = expand(*unpack(row)).astype("<u4").tobytes()
                n = np.array(row["n_tokens"], np.int64)
                starts = np.cumsum(n) - n
                crcs = [zlib.crc32(ids[4 * s:4 * (s + k)]) for s, k in zip(starts.tolist(), n.tolist(), strict=True)]
                same = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * same, pa.int32()), pa.array([row["block"]] * same, pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(n), pa.array(crcs, pa.int64())],
                    ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    decoded = blocks.drop("first_doc", "symbol_starts", "tokens").mapInArrow(
        decode, "part int, block int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return (decoded.join(places, ["part", "block"])
            .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))
