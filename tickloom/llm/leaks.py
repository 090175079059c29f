"""Benchmark decontamination: pair seeds counted in a window, then Smith-Waterman alignment.

Words are lower-cased and stripped of all but letters and digits. A seed is an ordered pair of words that
stand next to each other or have one word between them. Take an alignment that scores ``least`` of an item
of L words: with m matches and e edits, 2m - e >= 2 least L, so at most (2m - 2 least L) / 2 of the m - 1
steps between matches hold two edits or more. At least ceil(least L) - 1 steps hold one at most, and each of
them is a seed that item and passage share; the whole spans (3 - 2 least) L words of the passage at most.
So every place with that many shared seeds in that span is aligned, and no other place can reach ``least``:
the result is that of aligning every document with every item, while ceil(least L) is 2 or more. No seed is
dropped for being common.

The items' seeds go to the executors in parts of bounded size, one pass over the documents for each, and
each document is worked on by itself: nothing is dealt by seed, so no seed is hot.

Null or empty texts and items have no seeds. Half of an item of one or two words is a single word, which tells
nothing, so such items are found as a whole only. Null ids stay null in the result; repeated rows give equal rows once; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm import words as W
from tickloom.session import checkpoint

SEED_WORDS = 3  # shorter items are found as a whole only
STEPS = (1, 2)  # from the first word of a pair to its second
BITS = 1 << 24  # of the bitmap over the seeds: 2 MB
ITEM_WORDS = 1 << 18  # of the items that are looked for in one pass: about 10 MB of index
EXPANDED = 1 << 22  # (place, item) pairs in memory at once
COMMON = 1000  # kept for callers: no seed is treated otherwise for being common
LEAST_SCORE = 0.5


def _plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Like ``split``, of normalised words that aren't empty."""
    ends, codes, distinct = W.split(texts)
    plain = pc.replace_substring_regex(pc.utf8_lower(distinct), r"[^\p{L}\p{N}]+", "")
    full = pc.not_equal(plain, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(full)])
    return before[ends], codes[full], plain


def _pairs(h: np.ndarray, step: int) -> np.ndarray:
    return W.mix(h[:-step] * W._ODD + h[step:])


def _whole(h: np.ndarray, n: int) -> np.ndarray:
    return W.grams(h, n) ^ np.uint64(n)


def item_words(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, hashes of its words) of each item that has words."""
    narrow = items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in W.cuts(batches, "_text"):
            ends, codes, plain = _plain(cut.column("_text"))
            h = W.hashed(plain)[codes].view(np.int64)
            yield pa.RecordBatch.from_arrays([cut.column(0), pa.array([h[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.list_(pa.int64()))], ["item", "hashes"])

    kind = narrow.schema["item"].dataType.simpleString()
    return narrow.mapInArrow(run, f"item {kind}, hashes array<bigint>").where(F.size("hashes") > 0)


class _Index:
    """Seeds of some items: sorted keys, the items of each key, and what a place must have to be aligned."""

    def __init__(self, items: pa.Table, least: float, n: int) -> None:
        self.ids, lists = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in items.columns)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(size)])
        self.h = h = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        owner, long = np.repeat(np.arange(len(size)), size), size >= n
        self.need = np.where(long, np.maximum(np.ceil(size * least - 1e-9).astype(np.int64) - 1, 1), 1)
        self.reach = np.where(long, np.ceil(size * (3 - 2 * least)).astype(np.int64), size)
        self.widths = np.unique(size[~long]).tolist()
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for step in STEPS:
            at = np.flatnonzero((owner[:-step] == owner[step:]) & long[owner[:-step]])
            keys.append(_pairs(h, step)[at])
            owners.append(owner[at])
        for i in np.flatnonzero(~long):
            keys.append(_whole(h[self.ends[i] : self.ends[i + 1]], int(size[i])))
            owners.append(np.array([i]))
        key, own = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])[: len(key)]
        key, self.items = key[new], own[new]
        self.keys, first = np.unique(key, return_index=True)
        self.first = np.concatenate([first, [len(key)]])
        self.bits = np.zeros(BITS // 8, np.uint8)
        b = self.keys & np.uint64(BITS - 1)
        np.bitwise_or.at(self.bits, b >> np.uint64(3), np.uint8(1) << (b & np.uint64(7)).astype(np.uint8))

    def _hits(self, g: np.ndarray, width: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of seeds of ``width`` words, and which keys stand there."""
        b = g & np.uint64(BITS - 1)
        at = np.flatnonzero(self.bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1)
        at = at[owner[at] == owner[at + width - 1]]
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        same = self.keys[k] == g[at]
        return at[same], k[same]

    def places(self, ends: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, first word, end, places of seeds) of all that must be aligned."""
        if not len(h) or not len(self.keys):
            return
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        looked = [self._hits(_pairs(h, s), s + 1, owner) for s in STEPS] + [self._hits(_whole(h, w), w, owner) for w in self.widths if len(h) >= w]
        at, k = (np.concatenate(x) for x in zip(*looked))
        total = int((self.first[k + 1] - self.first[k]).sum())
        parts = min(-(-total // EXPANDED), len(self.ids))  # by items, so that all places of one item meet
        for p in range(parts):
            held = (self.items >= p * len(self.ids) // parts) & (self.items < (p + 1) * len(self.ids) // parts)
            first, items = np.concatenate([[0], np.cumsum(held)])[self.first], self.items[held]
            many = first[k + 1] - first[k]
            item = items[np.repeat(first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            both = np.unique(item * len(h) + np.repeat(at, many))
            item, place = np.divmod(both, len(h))
            last = np.arange(len(both)) + self.need[item] - 1
            inside = np.minimum(last, len(both) - 1)
            ok = np.flatnonzero((last < len(both)) & (item[inside] == item) & (owner[place[inside]] == owner[place]) & (place[inside] - place < self.reach[item]))
            if not len(ok):
                continue
            item, low, high, text = item[ok], place[ok], place[inside[ok]], owner[place[ok]]
            low = np.maximum(low - self.reach[item], ends[text])
            high = np.minimum(high + self.reach[item] + STEPS[-1] + 1, ends[text + 1])
            new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (low[1:] > high[:-1])]))
            item, text, low, high = item[new], text[new], low[new], high[np.concatenate([new[1:], [len(high)]]) - 1]
            yield text, item, low, high, np.searchsorted(both, item * len(h) + high) - np.searchsorted(both, item * len(h) + low)


def align(item: np.ndarray, passage: np.ndarray, match: int = 2, mismatch: int = 1, gap: int = 1) -> float:
    """Best local alignment of two runs of word codes, as a share of the item aligned with itself."""
    if not len(item) or not len(passage):
        return 0.0
    slope = gap * np.arange(len(passage) + 1)
    above, best = np.zeros(len(passage) + 1, np.int64), 0
    for word in item:
        row = np.maximum(above - gap, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(passage == word, match, -mismatch))
        above = np.maximum.accumulate(row + slope) - slope
        best = max(best, int(above.max()))
    return best / (match * len(item))


def leaks(docs: DataFrame, items: DataFrame, *keep: str | Column, text: str = "text", item: str = "item_id", least: float = LEAST_SCORE, n: int = SEED_WORDS, common: int = COMMON) -> DataFrame:
    """(``keep``, item, score, n_seeds) of documents that hold an item, exactly, edited or in parts.

    ``n_seeds``: the places where a seed of the item stands, around the best of its alignments that has most.
    ``common`` has no effect: no seed is dropped.
    """
    known = checkpoint(item_words(items, item))
    narrow = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = [f for f in narrow.schema.fields if f.name != "_text"]
    kind = known.schema["item"].dataType.simpleString()
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"_item {kind}, _score double, _n_seeds long"])

    def one_pass(part: DataFrame) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(_Index(part.toArrow(), least, n))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, scores = held.value, {}
            for cut in W.cuts(batches, "_text"):
                ends, codes, plain = _plain(cut.column("_text"))
                h = W.hashed(plain)[codes]
                for found in index.places(ends, h):
                    rows = []
                    for doc, i, low, high, seeds in zip(*(x.tolist() for x in found)):
                        key = (i, h[low:high].tobytes()) if high - low <= 1000 else None  # copies are aligned once
                        score = scores.get(key)
                        if score is None:
                            score = align(index.h[index.ends[i] : index.ends[i + 1]], h[low:high])
                            if key:
                                if len(scores) >= 2000:
                                    scores.clear()
                                scores[key] = score
                        if score >= least:
                            rows.append((doc, i, score, seeds))
                    if rows:
                        doc, i, score, seeds = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [*[c.take(pa.array(doc)) for c in cut.columns[:-1]], index.ids.take(pa.array(i)), pa.array(score, pa.float64()), pa.array(seeds, pa.int64())],
                            [*cut.schema.names[:-1], "_item", "_score", "_n_seeds"],
                        )

        return narrow.mapInArrow(run, schema)

    n_words = known.agg(F.sum(F.size("hashes"))).first()[0] or 0
    parts = max(-(-n_words // ITEM_WORDS), 1)
    found = reduce(DataFrame.union, [one_pass(known.where(F.expr(f"pmod(xxhash64(hashes), {parts}) = {p}"))) for p in range(parts)])
    return found.groupBy(*[f"`{f.name}`" for f in kept], "_item").agg(F.max("_score").alias("score"), F.max("_n_seeds").alias("n_seeds")).withColumnRenamed("_item", item)
