"""N-gram Jaccard join by signature trees.

A document's set holds its distinct word shingles (64-bit hashes). Two documents are linked when
``100 * intersection >= percent * union``; copies of a set are one node.

Subtrees. A linked pair of sets with sizes n <= n' differs in at most ``n * (100 - percent) / percent``
shingles. The range of hashes is cut in parts, as many as fit the size; of the parts that aren't empty
each set takes one more than it may differ in, in order. One of them must be equal in both sets, so the
hash of a part's content is the key of a subtree, and every link lies inside a subtree. Part counts go in
steps of the square root of two; a set whose partner may be a step above takes part in that step too. A
set with too few non-empty parts adds its smallest shingles by the prefix principle.

Sketches. Subtrees of one smallest key (the pivot) form one tree: a set that shares many of them is sent
once. The more sets there are, the more of them share a frequent passage and little else, so trees see
sketches before they see sets: a bitmap of two to four bits for each shingle bounds the intersection of two
sets from above. Sets that it can't part stay together, under the smallest key among them; all others leave
the tree, and most trees end.

Trees. What stays forms trees anew; a tree that is part of another one is left out. The leaves are token
bitmaps in order of size, inner nodes hold the OR of the bitmaps and the range of sizes, and a dual traversal
drops node pairs whose maximum possible overlap is too small or whose sizes are too far apart. Pairs of leaves
that remain are compared shingle by shingle unless they are one component by now, so a tree of m sets returns
at most m - 1 links. Sets travel with 40 bits of each hash first: chance equals can only add to an
intersection, so a pair that fails is no link, and one that passes by more than chance can give is a link.
Where a pair between two components passes by less, its block is compared again on whole hashes.

Trees of over ``GROUP`` sets (or as many shingles as ``GROUP`` sets of 512) are split in salted blocks that
meet pairwise. No pair of copies is ever listed. A filter of fixed size is all that reaches the driver.

Null texts and texts without words have an empty set and are linked with nothing: their component is
their own id. Fewer words than a shingle are one shingle. Rows with equal ids or null ids are kept, each
with the smallest id reached (null only if there is none). Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm import words as W
from tickloom.llm.filters import key_filter, passes
from tickloom.llm.graph import components
from tickloom.llm.release import release
from tickloom.session import checkpoint

GROUP = 1024
NARROW = 5  # bytes of each hash that the first comparison sees
FANOUT = 8
SIG_BITS = 44  # of a subtree's key: subtrees that meet by chance add sets to a tree, sketches part them again
PAIRS = 1 << 17  # pairs of sketches held at a time
WORDS = 1 << 21  # 64-bit words of sketches compared at a time


def differing(n: np.ndarray | int, percent: int):
    """Most shingles in which a set of n and a linked set differ."""
    return n * (100 - percent) // percent


def required(total: np.ndarray | int, percent: int):
    """Least intersection of linked sets with ``total`` shingles together."""
    return -(-percent * total // (100 + percent))


def densest(percent: int) -> float:
    """Most shingles per part so that enough parts aren't empty, with a tenth to spare."""
    need, load = 1.08 * (100 - percent) / percent, 16.0
    while load > 1 and (1 - math.exp(-load)) / load < need:
        load -= 0.05
    return load


def set_key(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def signatures(s: np.ndarray, percent: int, load: float) -> np.ndarray:
    """Keys of the subtrees of a sorted set."""
    n = len(s)
    most = int(differing(n, percent))
    if n == 0 or most == 0:  # linked with copies only
        return np.empty(0, np.uint64)
    step = lambda size: max(0, math.ceil(2 * math.log2(size / load) - 1e-9))
    keys = []
    for level in range(step(n), step(max(n, n * 100 // percent)) + 1):
        parts = max(1, round(2 ** (level / 2)))
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        content = np.add.reduceat(W.mix(s), first)
        keys.append(W.mix(content + W.mix(part[first] * np.uint64(128) + np.uint64(level)))[: most + 1])
        if len(first) <= most:
            prefix = s[: n - int(required(n + -(-n * percent // 100), percent)) + 1]
            keys.append(W.mix(prefix ^ np.uint64(0x5851F42D4C957F2D)))
    return np.unique(np.concatenate(keys))


def packed(s: np.ndarray, width: int) -> bytes:
    """The upper ``width`` bytes of each hash."""
    return (s >> np.uint64(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(x: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


@lru_cache(1 << 16)
def by_chance(total: int, width: int) -> int:
    """Equal hashes that two sets with ``total`` shingles together have by chance; more in one of 2^40 pairs at most."""
    if width == 8:
        return 0
    expected, k = max(total, 1) ** 2 / 2 ** (8 * width + 1), 1
    while k <= expected or k * (1 + math.log(expected / k)) - expected > -40 * math.log(2):
        k += 1
    return k - 1


def _sets(cut: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    ends, codes, distinct = W.split(cut.column("_text"), lower=True)
    return W.shingle_sets(ends, W.hashed(distinct)[codes], shingle)


def set_keys(docs: DataFrame, *keep: str | Column, text: str = "text", shingle: int = 4) -> DataFrame:
    """The columns ``keep`` with the set's key (null if empty), sketch and size."""
    narrow = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = [f for f in narrow.schema.fields if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["_set long, _sketch binary, n_shingles long"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in W.cuts(batches, "_text"):
            sets = _sets(cut, shingle)
            yield pa.RecordBatch.from_arrays(
                [
                    *cut.columns[:-1],
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                ],
                [*cut.schema.names[:-1], "_set", "_sketch", "n_shingles"],
            )

    return narrow.mapInArrow(run, schema)


def subtrees(docs: DataFrame, text: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """(sig, set) of every set; copies inside a task are listed once."""
    load = densest(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for cut in W.cuts(batches, "_text"):
            sigs, sets = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for s in _sets(cut, shingle):
                if len(s) and (key := set_key(s)) not in seen:
                    seen.add(key)
                    sigs.append(signatures(s, percent, load))
                    sets.append(np.full(len(sigs[-1]), key))
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(sigs) >> np.uint64(64 - SIG_BITS)).view(np.int64)), pa.array(np.concatenate(sets))], ["sig", "set"])

    return docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "sig long, set long")


def contents(docs: DataFrame, wanted: DataFrame, text: str = "text", shingle: int = 4, width: int = NARROW) -> DataFrame:
    """(set, shingles) of the sets in ``wanted`` and of some others, once per task."""
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, "set"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = bits.value, set()
        for cut in W.cuts(batches, "_text"):
            keys, sets = [], []
            for s in _sets(cut, shingle):
                if len(s) and (key := set_key(s)) not in seen:
                    if passes(held, np.array([key]))[0]:
                        seen.add(key)
                        keys.append(key)
                        sets.append(packed(s, width))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["set", "shingles"])

    return docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "set long, shingles binary")


def bitmap(s: np.ndarray, times: int = 8, least: int = 256) -> bytes:
    """A bit for each shingle in a power of two of bits, ``times`` to twice ``times`` the size."""
    size = max(least, 1 << int(times * len(s) - 1).bit_length())
    out = np.zeros(size, bool)
    out[(W.mix(s) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def sketch(s: np.ndarray) -> bytes:
    return bitmap(s, 2, 64)


def _folded(bits: bytes, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint64).reshape(-1, size), axis=0)


class Tree:
    """Nodes level by level; a node has OR bitmap, range of sizes and most shingles beyond its bits."""

    def __init__(self, bits: np.ndarray, n: np.ndarray):
        level = (bits, n, n, n - np.bitwise_count(bits).sum(axis=1).astype(np.int64))
        self.levels = [level]
        while len(level[1]) > FANOUT:
            at = np.arange(0, len(level[1]), FANOUT)
            b, low, high, extra = level
            level = (np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at))
            self.levels.append(level)

    def raised(self, height: int) -> None:
        """More levels of one root, up to as many as the other tree has."""
        while len(self.levels) < height:
            b, low, high, extra = self.levels[-1]
            self.levels.append((np.bitwise_or.reduce(b, axis=0, keepdims=True), low.min(keepdims=True), high.max(keepdims=True), extra.max(keepdims=True)))


def _grid(n: int, m: int) -> np.ndarray:
    return np.stack(np.meshgrid(np.arange(n), np.arange(m), indexing="ij"), -1).reshape(-1, 2)


def traverse(left: Tree, right: Tree, percent: int) -> np.ndarray:
    """Pairs of leaves (i, j) that may be linked."""
    left.raised(len(right.levels))
    right.raised(len(left.levels))
    depth = len(left.levels) - 1
    pairs, step = _grid(len(left.levels[depth][1]), len(right.levels[depth][1])), _grid(FANOUT, FANOUT)
    while True:
        kept = []
        for part in np.array_split(pairs, max(1, len(pairs) // 4096)):
            (b1, l1, h1, e1), (b2, l2, h2, e2) = ([x[part[:, k]] for x in tree.levels[depth]] for k, tree in enumerate((left, right)))
            near = (100 * h1 >= percent * l2) & (100 * h2 >= percent * l1)
            most = np.bitwise_count(b1 & b2).sum(axis=1).astype(np.int64) + np.minimum(e1, e2)
            kept.append(part[near & (np.minimum(most, np.minimum(h1, h2)) >= required(l1 + l2, percent))])
        pairs = np.concatenate(kept)
        if depth == 0 or not len(pairs):
            return pairs
        depth -= 1
        pairs = (pairs[:, None, :] * FANOUT + step[None]).reshape(-1, 2)
        pairs = pairs[(pairs[:, 0] < len(left.levels[depth][1])) & (pairs[:, 1] < len(right.levels[depth][1]))]


def spanning(sets: list[np.ndarray], pairs: np.ndarray, percent: int, width: int = 8) -> tuple[list[tuple[int, int]], bool]:
    """Links among the pairs (i, j) that join all that the pairs' links join, and whether that is certain of hashes so wide."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links, doubts = [], []
    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            total = len(sets[i]) + len(sets[j])
            spare = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) - int(required(total, percent))
            if spare >= by_chance(total, width):
                root[b] = a
                links.append((i, j))
            elif spare >= 0:
                doubts.append((i, j))
    return links, all(find(i) == find(j) for i, j in doubts)


def alike(n: np.ndarray, sketches: list[bytes], block: np.ndarray, side: np.ndarray, two: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block that may be linked; rows come by block, then size. ``two``: the row's block compares its sides."""
    place = block.astype(np.int64) << 40
    last = np.searchsorted(place + n, place + n * 100 // percent, "right")  # larger sets in reach of the row's size
    many = last - np.arange(len(n)) - 1
    words = np.array([len(x) // 8 for x in sketches])
    at = np.empty(len(n), np.int64)
    whole, folded = {}, {}
    for w in np.unique(words).tolist():
        rows = np.flatnonzero(words == w)
        at[rows] = np.arange(len(rows))
        whole[w] = np.frombuffer(b"".join(sketches[k] for k in rows), np.uint64).reshape(-1, w)

    def of(w: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sketches of w words folded to fewer, and the shingles beyond their bits."""
        if (w, size) not in folded:
            bits = np.bitwise_or.reduce(whole[w].reshape(-1, w // size, size), axis=1)
            folded[w, size] = bits, n[words == w] - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        return folded[w, size]

    sums = np.concatenate([[0], np.cumsum(many)])
    start = 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(sums, sums[start] + PAIRS, "right")) - 1)
        a = np.repeat(np.arange(start, end), many[start:end])
        b = a + 1 + np.arange(len(a)) - (sums[a] - sums[start])
        start = end
        meet = ~two[a] | (side[a] != side[b])
        a, b = a[meet], b[meet]
        kinds = words[a] << 32 | words[b]
        for kind in np.unique(kinds).tolist():
            (bits1, extra1), (bits2, extra2) = of(size := kind >> 32, size), of(kind & 0xFFFFFFFF, size)
            some = np.flatnonzero(kinds == kind)
            for part in np.array_split(some, -(-len(some) * size // WORDS)):
                i, j = a[part], b[part]
                most = np.bitwise_count(bits1[at[i]] & bits2[at[j]]).sum(axis=1).astype(np.int64) + np.minimum(extra1[at[i]], extra2[at[j]])
                near = np.minimum(most, n[i]) >= required(n[i] + n[j], percent)
                yield i[near], j[near]


def _groups(batches: Iterable[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """Tables of whole groups, of rows that come sorted by the columns ``by``."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch])
        keys = [held[c].to_numpy() for c in by]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if len(new):
            yield held.slice(0, int(new[-1])).combine_chunks()
            held = held.slice(int(new[-1]))
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _parted(percent: int):
    """(smallest key, key) of the sets of each block that sketches join."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups((b for b in batches if b.num_rows), "pivot", "i", "j"):
            pivot, i, j, side, keys, n = (table[c].to_numpy() for c in ("pivot", "i", "j", "side", "set", "n"))
            block = np.concatenate([[0], np.cumsum((pivot[1:] != pivot[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))])
            order = np.lexsort((keys, n, block))
            sketches = table["sketch"].to_pylist()
            keys, root, joined = keys[order], np.arange(len(order)), np.zeros(len(order), bool)
            for a, b in alike(n[order], [sketches[k] for k in order], block[order], side[order], (i != j)[order], percent):
                joined[a] = joined[b] = True
                while len(a):  # both ends hang from the lower of their roots until all pairs have one
                    low = np.minimum(root[a], root[b])
                    np.minimum.at(root, root[a], low)
                    np.minimum.at(root, root[b], low)
                    while not np.array_equal(root, up := root[root]):
                        root = up
                    apart = root[a] != root[b]
                    a, b = a[apart], b[apart]
            smallest = keys.copy()
            np.minimum.at(smallest, root, keys)
            yield pa.RecordBatch.from_arrays([pa.array(smallest[root][joined]), pa.array(keys[joined])], ["pivot", "set"])

    return run


FOUND = "pivot long, i int, j int, a long, b long, certain boolean"


def _search(percent: int, width: int):
    """Links of a block; in doubt, one row that says so."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["set", "side"])
        block = group.iloc[0][["pivot", "i", "j"]].astype(np.int64)
        sets = [unpacked(x, width) for x in group["shingles"]]
        order = np.argsort([len(s) for s in sets], kind="stable")
        sets, keys, side = [sets[i] for i in order], group["set"].to_numpy()[order], group["side"].to_numpy()[order]
        maps = [bitmap(s) for s in sets]
        words = min(len(m) // 8 for m in maps)
        bits, n = np.stack([_folded(m, words) for m in maps]), np.array([len(s) for s in sets])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if side.any():
            pairs = np.empty((0, 2), np.int64)
            if len(left) and len(right):
                pairs = traverse(Tree(bits[left], n[left]), Tree(bits[right], n[right]), percent)
                pairs = np.stack([left[pairs[:, 0]], right[pairs[:, 1]]], axis=1)
        else:
            tree = Tree(bits, n)
            pairs = traverse(tree, tree, percent)
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        links, certain = spanning(sets, pairs, percent, width)
        links = links if certain else [(0, 0)]
        out = pd.DataFrame({"a": keys[[i for i, _ in links]], "b": keys[[j for _, j in links]]}, dtype=np.int64)
        return out.assign(pivot=block["pivot"], i=block["i"], j=block["j"], certain=certain)[["pivot", "i", "j", "a", "b", "certain"]]

    return search


def largest_trees(members: DataFrame) -> DataFrame:
    """(pivot, set) without the pivots all of whose sets stand under another pivot as well.

    Such another pivot has the smaller one among its own sets, so only those are compared; of trees that
    hold one another the smaller keys lead to the largest tree, which stays.
    """
    size = members.groupBy("pivot").agg(F.count("*").alias("n"))
    above = members.where("pivot < set").select(F.col("set").alias("pivot"), F.col("pivot").alias("other")).join(size, "pivot")
    common = members.join(above, "pivot").join(members.select(F.col("pivot").alias("other"), "set"), ["other", "set"])
    held = common.groupBy("pivot", "other", "n").agg(F.count("*").alias("k")).where("k = n").select("pivot").distinct()
    return members.join(held, "pivot", "left_anti")


def deal(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pivot, i, j, side, set): block i of a tree meets block j once, i <= j; a block that meets itself is all on side 0."""
    blocks = members.join(sizes.select("set", "n").distinct(), "set").groupBy("pivot").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / (512 * GROUP))).cast("int").alias("r"))
    own, every = F.pmod(F.xxhash64("set"), F.col("r")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("r") - 1))
    dealt = members.join(blocks, "pivot").withColumn("own", own).withColumn("other", every)
    return dealt.select("pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "set")


def parted(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(pivot, set) of the sets that sketches can't part, under the smallest key of those together."""
    full = deal(members, sizes).join(sizes.distinct(), "set").select("pivot", "i", "j", "side", "set", "n", "sketch")
    return full.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").mapInArrow(_parted(percent), "pivot long, set long").distinct()


def links(docs: DataFrame, sizes: DataFrame, text: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """Links (a, b) between sets, enough to join every component; ``sizes`` has (set, n, sketch)."""
    by_sig = Window.partitionBy("sig")
    found = subtrees(docs, text, shingle, percent).withColumn("pivot", F.min("set").over(by_sig)).withColumn("last", F.max("set").over(by_sig))
    members = checkpoint(found.where("pivot < last").select("pivot", "set").distinct())
    del found
    release(docs.sparkSession)
    members = checkpoint(parted(members, sizes, percent))
    release(docs.sparkSession)
    members = checkpoint(largest_trees(members))
    dealt = deal(members, sizes)

    def compared(dealt: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
        full = dealt.join(contents(docs, wanted.distinct(), text, shingle, width), "set")
        return full.groupBy("pivot", "i", "j").applyInPandas(_search(percent, width), FOUND)

    found = checkpoint(compared(dealt, members.select("set"), NARROW))
    release(docs.sparkSession)
    certain, doubt = found.where("certain").select("a", "b"), found.where("NOT certain").select("pivot", "i", "j")
    if doubt.isEmpty():
        return certain
    again = checkpoint(dealt.join(doubt, ["pivot", "i", "j"]))
    return certain.union(compared(again, again.select("set"), 8).select("a", "b"))


def join(docs: DataFrame, *keep: str | Column, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """The columns ``keep`` of each row with n_shingles and component_id."""
    rows = checkpoint(set_keys(docs, *keep, F.col(doc_id).alias("_id"), text=text, shingle=shingle))
    sizes = rows.where("_set IS NOT NULL").select(F.col("_set").alias("set"), F.col("n_shingles").alias("n"), F.col("_sketch").alias("sketch"))
    labels = components(links(docs, sizes, text, shingle, percent))
    per_set = rows.where("_set IS NOT NULL").groupBy("_set").agg(F.min("_id").alias("_least"))
    named = per_set.join(labels.withColumnRenamed("node", "_set"), "_set", "left").withColumn("label", F.coalesce("label", "_set"))
    smallest = named.groupBy("label").agg(F.min("_least").alias("_component"))
    component = checkpoint(named.join(smallest, "label").select("_set", "_component"))
    out = rows.join(component, "_set", "left")
    names = [c for c in rows.columns if c not in ("_set", "_sketch", "_id", "n_shingles")]
    return out.select(*names, "n_shingles", F.when(F.col("_set").isNull(), F.col("_id")).otherwise(F.col("_component")).alias("component_id"))
