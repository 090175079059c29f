"""Spelling variants of a corpus' words, found in a bit-sliced position index.

Words that differ by one inserted, deleted or replaced code point agree in all of the shorter word but one of its thirds.
So each word goes to the groups of the words that share the rest of it, and a group of over ``MOST`` words is cut again
by halves of its third, down to single letters, where an alphabet of 63 letters leaves no more (63 + 63 * 63 words).

Groups are packed into blocks. A block holds one bitset over its words for each (position, letter). All words of the block
run through it as queries at once: the set of words without an error so far, and three sets with one error, whose positions
are shifted by none (replaced), one ahead (inserted) or one back (deleted), are and-ed with the bitsets letter by letter.

Null texts have no words; texts may be empty or very long and rows repeated (each counts), the table may be empty. Columns
other than the text and the slip key are not read. Ties of a form go to the smallest word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm import words as W
from tickloom.session import checkpoint

LETTERS = "a-zÀ-ÿ"  # after lower-casing A-Z
MOST = 4096  # words of a group
BLOCK = 2048  # words of a block, unless one group is larger
KEPT = 200_000  # words counted in a task before they are handed on
_ONE = np.uint64(1)


def count_words(docs: DataFrame, text: str | Column = "text", least_letters: int = 7, slips: str | Column | None = None) -> DataFrame:
    """(word, n): the maximal runs of letters of all texts, A-Z lower-cased, of at least ``least_letters``.

    With a key column ``slips``, a word of which 31 divides the crc32 of ``key:word`` loses one letter before it is counted,
    the same way in all its places under that key; null keys lose none. Such damage is for tests and evaluation.
    """
    text = F.col(text) if isinstance(text, str) else text
    key = F.lit(None) if slips is None else F.col(slips) if isinstance(slips, str) else slips
    narrow = docs.select(key.cast("string").alias("_key"), text.cast("string").alias("_text"))
    find = re.compile(f"[{LETTERS}]{{{least_letters},}}").findall

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for cut in W.cuts(batches, "_text", 1 << 20):
            lowered = pc.ascii_lower(pc.fill_null(cut.column("_text"), "")).to_pylist()
            for key, text in zip(cut.column("_key").to_pylist(), lowered):
                counts = Counter(find(text))
                if key is not None:
                    start = zlib.crc32(f"{key}:".encode())
                    for word in list(counts):
                        h = zlib.crc32(word.encode(), start)
                        if h % 31 == 0:
                            n, at = counts.pop(word), h % len(word)
                            if len(word) > least_letters:
                                held[word[:at] + word[at + 1 :]] += n
                for word, n in counts.items():
                    held[word] += n
                if len(held) > KEPT:
                    yield made()
        if held:
            yield made()

    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def index_block(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, found) of all pairs of the words, both ways, at one edit; from one bit-sliced index."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(-sizes, kind="stable")  # the longest queries first: those still running are the first rows
    sizes = sizes[order]
    size, longest, wide = len(words), int(sizes.max(initial=0)), -(-len(words) // 64)
    flat = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le"), np.uint32)
    letters, codes = np.unique(flat, return_inverse=True)
    text = np.full((size, longest), len(letters), np.int64)
    text[np.arange(longest) < sizes[:, None]] = codes
    bit = _ONE << (np.arange(size) % 64).astype(np.uint64)
    # position 0 and those past the longest word hold nobody
    index = np.zeros((longest + 3, len(letters) + 1, wide), np.uint64)
    for p in range(longest):
        np.bitwise_or.at(index[p + 1], (text[:, p], np.arange(size) // 64), bit)
    of_length = np.zeros((longest + 3, wide), np.uint64)
    np.bitwise_or.at(of_length, (sizes, np.arange(size) // 64), bit)
    exact = np.full((size, wide), ~np.uint64(0))
    replaced, inserted, deleted = np.zeros_like(exact), exact.copy(), np.zeros_like(exact)
    near = np.zeros_like(exact)
    for k in range(1, longest + 1):
        on = int(np.searchsorted(-sizes, -k, "right"))  # queries of at least k letters
        letter = text[:on, k - 1]
        here, ahead, back = index[k][letter], index[k + 1][letter], index[k - 1][letter]
        before = exact[:on].copy()
        exact[:on] &= here
        replaced[:on] = (replaced[:on] & here) | (before & ~here)
        inserted[:on] = (inserted[:on] & ahead) | exact[:on]
        deleted[:on] = (deleted[:on] & back) | before
        done = slice(int(np.searchsorted(-sizes, -k, "left")), on)  # queries that end here
        near[done] = (replaced[done] & of_length[k]) | (inserted[done] & of_length[k + 1]) | (deleted[done] & of_length[k - 1])
    row, cell = np.nonzero(near)
    bits = np.unpackbits(near[row, cell].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, shift = np.nonzero(bits)
    return order[row[which]], order[cell[which] * 64 + shift]


def _keyed(rows: DataFrame, regions: Column) -> DataFrame:
    """A row per region (a, s, e) of the word: the key is all but the letters from s to e of a word of a letters."""
    out = rows.select("word", "n", F.inline(regions))
    rest = "length(word) - a + e"  # letters before the shared end
    return out.withColumn("key", F.expr(f"xxhash64(a, s, e, substring(word, 1, s), substring(word, {rest} + 1))"))


def links(vocabulary: DataFrame, least_letters: int = 1, most: int = MOST) -> DataFrame:
    """(word, n, other, other_n): all pairs of different words of (word, n) at one edit, both ways, each once."""

    def third(short: str, i: int) -> str:
        return f"named_struct('a', {short}, 's', cast({short} * {i} div 3 AS int), 'e', cast({short} * {i + 1} div 3 AS int))"

    regions = ", ".join(third(short, i) for short in ("length(word)", "(length(word) - 1)") for i in range(3))
    words = vocabulary.where(F.length("word") >= least_letters)
    rows, done = _keyed(words, F.expr(f"filter(array({regions}), r -> r.a >= {max(least_letters, 1)} AND r.e > r.s)")), []
    while True:
        hot = checkpoint(rows.groupBy("key", "s", "e").count().where(f"count > {most} AND e - s > 1").select("key"))
        if hot.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(hot, "key", "left_anti"))
        halves = "array(named_struct('a', a, 's', s, 'e', cast((s + e) div 2 AS int)), named_struct('a', a, 's', cast((s + e) div 2 AS int), 'e', e))"
        again = rows.join(hot, "key", "left_semi").withColumn("halves", F.expr(halves)).select("word", "n", "halves")
        rows = _keyed(again, F.col("halves"))
    schema = "word string, n long, other string, other_n long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts in _blocks(batches):
            query, found = index_block(words)
            named, n = pa.array(words, pa.string()), np.asarray(counts, np.int64)
            pairs = [named.take(pa.array(query)), pa.array(n[query]), named.take(pa.array(found)), pa.array(n[found])]
            yield pa.RecordBatch.from_arrays(pairs, ["word", "n", "other", "other_n"])

    out = None
    for part in done:
        alike = part.select("key", "word", "n").repartition("key").sortWithinPartitions("key")
        found = alike.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out.dropDuplicates(["word", "other"])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int]]]:
    """Whole groups of equal keys, which come in order, packed to about ``BLOCK`` words; single words are left out."""
    words, counts, group, now = [], [], [], None

    def closed() -> bool:
        if len(group) > 1:
            words.extend(w for w, _ in group)
            counts.extend(n for _, n in group)
        group.clear()
        return len(words) >= BLOCK

    for batch in batches:
        for key, word, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if key != now:
                if closed():
                    yield words, counts
                    words, counts = [], []
                now = key
            group.append((word, n))
    closed()
    if words:
        yield words, counts


def group_variants(vocabulary: DataFrame, least_letters: int = 7, ratio: int = 10) -> DataFrame:
    """Each word of (word, n) with its number of near words, the ``form`` it varies and the ``root`` of that chain.

    A word's form is its near word of largest n (ties: the smallest word) if that n is at least ``ratio`` times its own,
    which must be over 1 for chains to end. Words are distinct and not null; their n is at least 1.
    """
    vocabulary = checkpoint(vocabulary)
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other")))
    near = links(vocabulary, least_letters).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.minus")).alias("other_n"))
    varies = F.col("other_n") >= ratio * F.col("n")
    rows = checkpoint(
        vocabulary.join(near, "word", "left").select(
            "word", F.when(varies, F.col("other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(varies, F.col("other_n")).alias("form_n")
        )
    )
    # every step is ten times as frequent, so chains are short; doubling makes a round of each power of two
    chain = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        chain = checkpoint(chain.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("went")))
        if chain.where("went").isEmpty():
            break
        chain = chain.drop("went")
    return rows.join(chain.drop("went"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
