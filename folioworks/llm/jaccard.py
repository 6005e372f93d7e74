"""Exact n-gram Jaccard join with a forest of signature trees.

A document is its set of word shingles. Documents with equal sets form one class. Classes are dealt to trees so that no
link can be missed: for a range of set sizes, at most d shingles differ between linked sets; cut the shingle space into
more than d parts, and at least one part holds the same shingles in both. Sets with an equal part stand in one tree.
(Parts that are empty don't count; a set with d filled ones or fewer also stands in its range's tree for such sets.)
Of a set's filled parts all but d are equal in a linked one: a set that meets others in fewer parts of a range met them by
chance, and stands in none of the range's trees.

In a tree, documents are leaves in order of size; a node holds the OR of the token bitmaps below it and their range of
sizes. Two nodes are traversed together only if their sizes are compatible and their bitmaps leave room for enough
common shingles, and only while their documents are not all linked already; pairs of leaves that remain are compared
exactly. Trees that share members are one tree, so that each set is sent to one task. Only where that would be too
large for a task, a tree stays with one signature (trees of the same members still are one) and is split into blocks:
each block is traversed with the tree's first member; then, should links still be missing, members outside the largest
component meet all blocks. So copies of one text, however many, never meet in all pairs, and no pair of different texts goes unseen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.components import components
from folioworks.llm.tables import dropped, runs, written

CACHE_WORDS = 200_000
GROWTH = 1.25               # ratio of neighbouring size ranges
BITS = 4096                 # of a token bitmap
FANOUT = 8
PRUNED_SETS = 8192          # of a tree whose bitmaps one task compares; larger ones are split into blocks below
BLOCK_BYTES = 8 << 20       # shingles of one block of a tree
CLUSTER_BYTES = 1 << 18     # shingles of a cluster that is compared as it is
RANGE = 255                 # bits of a signature that name its size range
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        words = [t.lower().split() if t else [] for t in texts]     # bytes: only A-Z change, only ASCII space divides
        flat = [w for own in words for w in own]
        for word in set(flat).difference(self.known):
            self.known[word] = xxhash.xxh64_intdigest(word)
        hashes = np.fromiter(map(self.known.__getitem__, flat), np.uint64, len(flat))
        size = self.width
        rolled = np.zeros(max(len(flat) - size + 1, 0), np.uint64)
        for i in range(size):
            rolled = mix(rolled * _A + hashes[i:i + len(rolled)])
        out, start = [], 0
        for own in words:
            n = len(own)
            if n >= size:
                out.append(np.unique(rolled[start:start + n - size + 1]))
            elif n:
                one = np.full(1, n, np.uint64)
                for h in hashes[start:start + n]:
                    one = mix(one * _B + h)
                out.append(one)
            else:
                out.append(rolled[:0])
            start += n
        return out


@lru_cache(maxsize=1)
def size_ranges() -> np.ndarray:
    """First size of each range."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, int(starts[-1] * GROWTH)))
    return np.array(starts)


@lru_cache(maxsize=4096)
def parts_of(c: int, num: int, den: int) -> np.ndarray:
    """For pairs whose smaller set lies in range c: upper ends of the parts."""
    differing = most_differing(int(size_ranges()[c + 1]) - 1, c, num, den)
    if not differing:
        return np.zeros(0, np.uint64)           # only equal sets can be linked
    # Parts to spare, as many as the smallest sets are likely to leave empty.
    spare, least = 1, int(size_ranges()[c])
    for _ in range(4):
        k = differing + 1 + spare
        mean = k * math.exp(-least / k)
        spare = 1 + int(mean + 3 * math.sqrt(mean))
    k = differing + 1 + spare
    return np.array([((i + 1) << 64) // k - 1 for i in range(k)], np.uint64)


def most_differing(n: int, c: int, num: int, den: int) -> int:
    """How many shingles a set of n may have apart from a linked one, if the smaller of the two lies in range c."""
    most = int(size_ranges()[c + 1]) - 1
    return (n + (n * den // num if n <= most else most)) * (den - num) // (den + num)


def catch_all(c: int) -> np.ndarray:
    """The signature of sets with few filled parts in range c."""
    return mix(np.full(1, c, np.uint64) * _B + _C)


def signatures(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the set's parts, for every size range in which it may have a partner."""
    return signed_parts(tokens, num, den)[0]


def signed_parts(tokens: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """The set's signatures, and for every size range how many of them a linked set has at least (above the bits of RANGE)."""
    n, starts, out, least = len(tokens), size_ranges(), [], []
    if not n:
        return np.zeros(0, np.uint64), []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ _C), dtype=np.uint64)])
    c = int(np.searchsorted(starts, n, side="right")) - 1
    while c >= 0 and (int(starts[c + 1]) - 1) * den >= num * n:
        ends = parts_of(c, num, den)
        if len(ends):
            at = np.concatenate([[0], np.searchsorted(tokens, ends, side="right")])
            full = at[1:] > at[:-1]
            number = np.arange(len(ends), dtype=np.uint64) + np.uint64(c << 32)
            parts = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(number * _A + _B))[full]
            out.append(parts & ~np.uint64(RANGE) | np.uint64(c))
            # Every filled part that a linked set has not got holds a shingle in which the two differ.
            equal = len(parts) - most_differing(n, c, num, den)
            if equal <= 0:
                out.append(catch_all(c))
            least.append(max(equal, 1) * (RANGE + 1) + c)
        c -= 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64), least


def set_keys(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that identify a set."""
    with np.errstate(over="ignore"):
        return (int(mix(tokens * _A + _B).sum(dtype=np.uint64).view(np.int64)),
                int(mix(tokens * _C + _A).sum(dtype=np.uint64).view(np.int64)))


def packed(tokens: np.ndarray) -> bytes:
    """Sorted shingle hashes in the six bytes that are kept of each once sets are compared: two of a pair's shingles meet by chance
    with a probability below 1e-8 for sets of a thousand."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """Sorted numbers of 48 bits."""
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1)


def sketch(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, text_key, n (set size), k1, k2 (set identity), sigs, least of every row (doc_id, text_key, text). Of the copies
    that a task meets the first carries the signatures, and how many of them a linked set shares."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, met = Shingles(width), set()
        for batch in batches:
            for part in runs(batch, "text"):
                sets = shingles.of(part.column("text").cast(pa.binary()).to_pylist())
                keys = np.array([set_keys(s) for s in sets], np.int64).reshape(-1, 2)
                if len(met) > CACHE_WORDS:
                    met = set()
                sigs, least = [], []
                for s, key in zip(sets, map(tuple, keys.tolist()), strict=True):
                    own, counts = signed_parts(s[:0] if key in met else s, num, den)
                    sigs.append(own)
                    least.append(counts)
                    met.add(key)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *sigs]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(least, pa.list_(pa.int64()))],
                    ["doc_id", "text_key", "n", "k1", "k2", "sigs", "least"])
    return docs.mapInArrow(run, "doc_id bigint, text_key bigint, n bigint, k1 bigint, k2 bigint, sigs array<bigint>, least array<bigint>")


def token_sets(texts: DataFrame, width: int) -> DataFrame:
    """node, n, tokens of rows (node, text) whose set is the node's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in batches:
            for part in runs(batch, "text"):
                sets = shingles.of(part.column("text").cast(pa.binary()).to_pylist())
                nodes = part.column("node").to_pylist()
                own = [(k, s) for k, s in zip(nodes, sets, strict=True) if set_keys(s)[0] == k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in own], pa.int64()), pa.array([len(s) for _, s in own], pa.int64()),
                     pa.array([packed(s) for _, s in own], pa.binary())], ["node", "n", "tokens"])
    return texts.mapInArrow(run, "node bigint, n bigint, tokens binary")


def bitmap(tokens: np.ndarray, width: int = BITS) -> np.ndarray:
    """Which of `width` places hold a token."""
    bits = np.zeros(width, bool)
    bits[(tokens % np.uint64(width)).astype(np.int64)] = True
    return bits


def bitmaps(sets: DataFrame) -> DataFrame:
    """node, n, map (packed bits) of rows (node, n, tokens); a map has the least power of two of places that is at least
    twice the size, and 512 at least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_pylist()
            maps = [np.packbits(bitmap(unpacked(t.as_py()), max(512, 1 << (2 * n - 1).bit_length())))
                    for n, t in zip(sizes, batch.column("tokens"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array([m.tobytes() for m in maps], pa.binary())],
                                             ["node", "n", "map"])
    return sets.select("node", "n", "tokens").mapInArrow(run, "node bigint, n bigint, map binary")


def folded(maps: list[bytes]) -> np.ndarray:
    """Maps of one width, that of the narrowest: the halves of a wider one laid over each other make the narrower one."""
    narrow, out = min(map(len, maps)), []
    for m in maps:
        bits = np.frombuffer(m, np.uint64)
        out.append(np.bitwise_or.reduce(bits.reshape(-1, narrow // 8), axis=0))
    return np.stack(out)


def with_partner(maps: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets of a tree may be linked to another one of it, by their bitmaps and sizes."""
    out, slack = np.zeros(len(n), bool), n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    step = max(1, (4 << 20) // max(1, maps.size * 8))
    for start in range(0, len(n), step):
        own = slice(start, start + step)
        common = np.bitwise_count(maps[own, None, :] & maps[None, :, :]).sum(axis=2, dtype=np.int64)
        most = np.minimum(common + np.minimum(slack[own, None], slack[None, :]), np.minimum(n[own, None], n[None, :]))
        may = most * (num + den) >= num * (n[own, None] + n[None, :])
        may[np.arange(len(may)), np.arange(start, start + len(may))] = False
        out[own] = may.any(axis=1)
    return out


def _prune(num: int, den: int):
    """Trees of rows sorted by tree: node, n, map → members that may have a partner there (tree, node)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def kept() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            nodes, n, maps = zip(*held, strict=True)
            may = with_partner(folded(maps), np.array(n), num, den)
            return [(key, node) for node, m in zip(nodes, may.tolist(), strict=True) if m]

        def rows(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([m for _, m in found], pa.int64())],
                                              ["tree", "node"])

        for batch in batches:
            out = []
            for tree, *row in zip(*(batch.column(c).to_pylist() for c in ("tree", "node", "n", "map")), strict=True):
                if tree != key:
                    out += kept()
                    key, held = tree, []
                held.append(row)
            yield rows(out)
        yield rows(kept())
    return run


class SignatureTree:
    """Nodes over documents in order of size: OR of bitmaps, smallest and largest size, largest number of tokens that
    share a bit with another of the same document."""

    def __init__(self, tokens: list[np.ndarray]) -> None:
        bits = np.stack([bitmap(t) for t in tokens])
        sizes = np.array([len(t) for t in tokens], np.int64)
        self.levels = [(np.packbits(bits, axis=1).view(np.uint64), sizes, sizes, sizes - bits.sum(axis=1))]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, slack = self.levels[-1]
            cuts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, cuts, axis=0), np.minimum.reduceat(low, cuts),
                                np.maximum.reduceat(high, cuts), np.maximum.reduceat(slack, cuts)))

    def may_link(self, level: int, i: int, j: int, num: int, den: int) -> bool:
        """Whether documents below both nodes can share enough tokens."""
        maps, low, high, slack = self.levels[level]
        if high[i] * den < num * low[j] or high[j] * den < num * low[i]:
            return False
        common = int(np.bitwise_count(maps[i] & maps[j]).sum()) + min(slack[i], slack[j])
        return min(common, high[i], high[j]) * (num + den) >= num * (low[i] + low[j])


def tree_links(nodes: np.ndarray, tokens: list[np.ndarray], labels: np.ndarray, num: int,
               den: int) -> list[tuple[int, int]]:
    """Links that join all documents reachable from one another: dual traversal of a tree with itself.

    `labels` are components known already; pairs within one are not looked at.
    """
    order = np.lexsort((nodes, [len(t) for t in tokens]))
    nodes, tokens, labels = nodes[order], [tokens[i] for i in order], labels[order].copy()
    found: list[tuple[int, int]] = []
    tree = SignatureTree(tokens) if len(nodes) > 2 else None
    stack = [(len(tree.levels) - 1 if tree else 0, 0, 0)] if tree else [(0, 0, 1)][:len(nodes) - 1]
    while stack:
        level, i, j = stack.pop()
        if level == 0:
            if i == j or labels[i] == labels[j] or (tree and not tree.may_link(0, i, j, num, den)):
                continue
            common = len(np.intersect1d(tokens[i], tokens[j], assume_unique=True))
            if common * den >= num * (len(tokens[i]) + len(tokens[j]) - common):
                found.append((int(nodes[i]), int(nodes[j])))
                labels[labels == labels[j]] = labels[i]
            continue
        width = FANOUT ** level
        a, b = labels[i * width:(i + 1) * width], labels[j * width:(j + 1) * width]
        if (a == b[0]).all() and (b == b[0]).all() or not tree.may_link(level, i, j, num, den):
            continue
        last = len(tree.levels[level - 1][1])
        below_i, below_j = (range(x * FANOUT, min((x + 1) * FANOUT, last)) for x in (i, j))
        pairs = [(level - 1, x, y) for x in below_i for y in below_j if i != j or x <= y]
        # Nodes with themselves come off the stack first: links within them make later pairs needless.
        stack += sorted(pairs, key=lambda p: (p[1] == p[2], -abs(p[1] - p[2])))
    return found


def _traverse(num: int, den: int):
    """Trees of rows sorted by (tree, block): node, tokens, label → links (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def links() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            nodes = np.fromiter(held, np.int64, len(held))
            sets = [unpacked(t) for t, _ in held.values()]
            labels = np.array([label for _, label in held.values()], np.int64)
            return tree_links(nodes, sets, labels, num, den)

        def packed(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()),
                                               pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            trees, blocks = batch.column("tree").to_pylist(), batch.column("block").to_pylist()
            nodes, labels = batch.column("node").to_pylist(), batch.column("label").to_pylist()
            out = []
            for row, own in enumerate(zip(trees, blocks, strict=True)):
                if own != key:
                    out += links()
                    key, held = own, {}
                held[nodes[row]] = (batch.column("tokens")[row].as_py(), labels[row])
            yield packed(out)
        yield packed(links())
    return run


def _met(signed: DataFrame) -> DataFrame:
    """sig, node, first: the sets (k1) that share a signature with another, and the smallest set that has it.

    Nearly all signatures are of one set only. They are dealt once; what they have in common is looked for where they arrive.
    """
    each, own = signed.select(F.explode("sigs").alias("sig"), F.col("k1").alias("node")), Window.partitionBy("sig")
    met = each.withColumns({"first": F.min("node").over(own), "last": F.max("node").over(own)}).filter("first <> last")
    return written(met.dropDuplicates(["sig", "node"]).select("sig", "node", "first"), "members")


def _enough(shared: DataFrame, least: DataFrame) -> DataFrame:
    """What `_met` gives without the sets that share fewer signatures of a size range with others than they would with one linked
    set (node, c, least)."""
    everywhere = F.col("sig").isin(np.concatenate([catch_all(c) for c in range(len(size_ranges()) - 1)]).view(np.int64).tolist())
    counted = shared.filter(~everywhere).select("sig", "node", F.col("sig").bitwiseAND(RANGE).alias("c")).withColumn(
        "met", F.count(F.lit(1)).over(Window.partitionBy("node", "c")))
    enough = counted.join(least, ["node", "c"]).filter("met >= least").select("sig", "node")
    own = Window.partitionBy("sig")
    left = enough.unionByName(shared.filter(everywhere).select("sig", "node")).withColumns(
        {"first": F.min("node").over(own), "last": F.max("node").over(own)})
    return written(left.filter("first <> last").select("sig", "node", "first"), "members-left")


def _merged(trees: DataFrame) -> DataFrame:
    """Of trees (tree, node) with the same members one; their number, two sums of hashes and the smallest tell."""
    alike = trees.groupBy("tree").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                      F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.min("node").alias("first"))
    chosen = alike.filter("c > 1").groupBy("c", "x", "y", "first").agg(F.min("tree").alias("tree")).select("tree")
    return trees.join(chosen, "tree", "left_semi")


def forest(docs: DataFrame, signed: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between set identities that connect everything linked through different sets."""
    shared = _met(signed)
    least = signed.select(F.col("k1").alias("node"), F.explode("least").alias("l")).select(
        "node", F.col("l").bitwiseAND(RANGE).alias("c"), F.shiftright("l", RANGE.bit_length()).alias("least"))
    least = written(least.groupBy("node", "c").agg(F.min("least").alias("least")), "least-shared")
    dropped(signed)             # the largest table, and of no more use
    shared = _enough(shared, least)
    members = shared.select("sig", "node")
    # Sets joined by shared signatures form a cluster; all of a cluster stand in one tree, each once.
    roots = components(shared.select(F.col("node").alias("a"), F.col("first").alias("b")))
    nodes = members.select("node").distinct()
    clusters = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("tree"))
    reps = classes.groupBy(F.col("k1").alias("node")).agg(F.min("rep").alias("doc_id"), F.max("n").alias("n"))
    placed = written(clusters.join(reps, "node"), "tree-nodes")
    # The condition on n holds for all; it lets the optimizer keep texts that nothing asks for out of the shuffle.
    sets = written(token_sets(docs.join(placed.filter("n > 0"), "doc_id").select("node", "text"), width), "token-sets").dropDuplicates(["node"])

    heavy = placed.groupBy("tree").agg(F.sum("n").alias("n")).filter(F.col("n") * 8 > CLUSTER_BYTES).select("tree")
    # A larger cluster stands in a tree per signature instead, trees of the same members in one. There sets have met by
    # chance, too: only those whose bitmap leaves room for a partner in the tree stay in it.
    inside = members.join(placed.join(heavy, "tree", "left_semi").select("node"), "node", "left_semi")
    each_tree = written(_merged(inside.select(F.col("sig").alias("tree"), "node")), "signature-trees")
    sizes = each_tree.groupBy("tree").agg(F.count(F.lit(1)).alias("c"))
    small = each_tree.join(sizes.filter(F.col("c") <= PRUNED_SETS).select("tree"), "tree", "left_semi")
    large = each_tree.join(sizes.filter(F.col("c") > PRUNED_SETS).select("tree"), "tree", "left_semi")
    maps = written(bitmaps(sets.join(each_tree.select("node").distinct(), "node", "left_semi")), "bitmaps")
    pruned = small.join(maps, "node").select("tree", "node", "n", "map").repartition("tree").sortWithinPartitions(
        "tree").mapInArrow(_prune(num, den), "tree bigint, node bigint")
    together = _merged(written(pruned, "pruned-trees")).unionByName(large)
    # What is left joins fewer sets: clusters again, each in one tree where a task can hold it.
    firsts = together.groupBy("tree").agg(F.min("node").alias("first"))
    left = written(together.join(firsts, "tree").select("tree", "node", "first"), "trees-left")
    again = components(left.select(F.col("node").alias("a"), F.col("first").alias("b")))
    smaller = written(left.select("node").distinct().join(again, "node", "left").select("node", F.coalesce("root", "node").alias("tree"))
                      .join(placed.select("node", "n"), "node"), "clusters-left")
    still = smaller.groupBy("tree").agg(F.sum("n").alias("n")).filter(F.col("n") * 8 > BLOCK_BYTES).select("tree")
    single = (placed.join(heavy, "tree", "left_anti").select("tree", "node")
              .unionByName(smaller.join(still, "tree", "left_anti").select("tree", "node")))
    apart = left.join(smaller.join(still, "tree", "left_semi").select("node"), "node", "left_semi")
    in_trees = written(single.select("tree", "node", F.col("tree").alias("first")).unionByName(apart.select("tree", "node", "first")),
                       "tree-members")

    split = (in_trees.join(placed.select("node", "n"), "node").groupBy("tree")
             .agg(F.greatest(F.lit(1), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def traversed(members: DataFrame, places) -> DataFrame:
        """Tokens come last: what is dealt to blocks before is narrow."""
        dealt = members.select("tree", "node", "label", F.explode(places).alias("block")).join(sets, "node")
        return dealt.select("tree", "block", "node", "tokens", "label").repartition("tree", "block").sortWithinPartitions(
            "tree", "block").mapInArrow(_traverse(num, den), "a bigint, b bigint")

    first = written(traversed(in_trees.join(split, "tree").withColumn("label", F.col("node")),
                              F.when(F.col("node") == F.col("first"), every).otherwise(F.array(own))), "tree-links")
    wide = written(in_trees.join(split.filter("blocks > 1"), "tree"), "split-trees")
    if wide.isEmpty():
        return first
    # Members of a split tree outside its largest component meet all its blocks.
    labelled = wide.join(components(first), "node", "left").withColumn("label", F.coalesce("root", "node"))
    sizes = labelled.groupBy("tree", "label").agg(F.count(F.lit(1)).alias("c"))
    main = (sizes.groupBy("tree").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label")).alias("most"))
            .filter("labels > 1").select("tree", F.col("most.label").alias("main")))
    outside = labelled.join(main, "tree")
    second = traversed(outside, F.when(F.col("label") == F.col("main"), F.array(own)).otherwise(every))
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest id reachable by links, its own included).

    Two texts link when den * |intersection| >= num * |union| of their sets of `width`-word shingles; a text of fewer
    words is one shingle. Words are runs of anything but ASCII white space, A-Z in lower case. A null or empty text has
    no shingles and no links. Rows that share an id are one document with several texts; a row without id links as a
    copy only, and has the smallest id of its component or null. An empty table gives no rows; other columns are not
    read; texts are taken whole.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       F.col(text).alias("text"))
    sketches, rooted = _rooted(rows, width, num, den, True)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("n", "k1", "k2", "component_id")
    linked = sketches.select("doc_id", "n", "k1", "k2").join(named, ["n", "k1", "k2"], "left")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _rooted(rows: DataFrame, width: int, num: int, den: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows (doc_id, text_key, text), and n, k1, k2, rep (smallest id), root (component) of every set;
    `by_id`: texts of one id are linked."""
    signed = written(sketch(rows, width, num, den), "signatures")
    sketches = written(signed.drop("sigs", "least"), "sketches")
    filled = sketches.filter("n > 0")
    classes = written(filled.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    links = forest(rows, signed, classes, width, num, den)
    if by_id:
        texts = filled.filter("doc_id is not null").select("doc_id", "k1")
        several = texts.groupBy("doc_id").agg(F.min("k1").alias("a"), F.max("k1").alias("hi")).filter("a <> hi").select("doc_id", "a")
        links = links.unionByName(texts.join(several, "doc_id").select("a", F.col("k1").alias("b")))
    roots = components(links)
    return sketches, classes.join(roots, classes["k1"] == roots["node"], "left").select(
        "n", "k1", "k2", "rep", F.coalesce("root", "k1").alias("root"))


def surplus(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """row_id, text_key, keep: of the rows of `docs` with both, `keep` (0 or 1) are to stay; rows not named here all stay.

    Of each component of texts one row stays: the one of the smallest id, then of the smallest text_key (xxhash64 of the
    text). row_id is the id, or the text_key of a row without one; such rows link like any other, and stay only where
    their component has no id. Different texts of one id are different documents. Texts without words are not named.
    """
    rows = with_keys(docs).select(F.col("row_id").alias("doc_id"), "text_key", "text")
    sketches, rooted = _rooted(rows, width, num, den, False)
    linked = written(sketches.filter("n > 0").select("doc_id", "text_key", "n", "k1", "k2").join(
        rooted.select("n", "k1", "k2", "root"), ["n", "k1", "k2"]).select(F.col("doc_id").alias("row_id"), "text_key", "root"),
        "linked-rows")
    first = F.min(F.struct((F.col("row_id") == F.col("text_key")).alias("no_id"), "row_id", "text_key")).alias("f")
    best = linked.groupBy("root").agg(first).select("f.row_id", "f.text_key", F.lit(1).alias("keep"))
    counted = linked.groupBy("row_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    return (counted.join(best, ["row_id", "text_key"], "left").filter("keep is null or n > 1")
            .select("row_id", "text_key", F.coalesce("keep", F.lit(0)).alias("keep")))


def with_keys(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text and any others) and the row_id and text_key of every row."""
    key = F.xxhash64("text")
    return docs.withColumns({"row_id": F.coalesce(F.col("doc_id").cast("bigint"), key), "text_key": key})
