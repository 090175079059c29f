"""Language-model scores of whole texts from trigrams in Elias-Fano tries.

The model interpolates: ``p(w | u v) = d3 + g3 (d2 + g2 p1(w))``. The d are discounted shares of seen grams, the g what
the discount leaves in a context (``discount`` times its different words over its count), p1 the add-one share of the word.
Probabilities of all words and one unknown word add up to 1. d and g are stored as 12-bit codes of their logarithm,
256 to a decade.

Texts are cut into blocks of a few megabytes of words, and blocks ask for what they need in packed messages:

1. each block sends its different words to the shards of the words and gets back their numbers and counts;
2. each block sends its different trigrams, with how often its training texts hold them, to the shards of their first
   word. A shard adds up what all blocks sent, builds the trie of its part, maps it into memory, looks every trigram up by
   successor search below its context, and answers each block;
3. each block puts the answers together into scores.

The number of shards follows the number of words, so a shard's load is bounded. A first word with more places than a shard
has room for is dealt out by its second word too, and a pair of that kind by its third; there are fewer of these than
shards, their counts are collected, and the numbers of their different followers are summed over shards.

64-bit hashes stand for words. Null texts are empty; texts may be empty or very long, rows repeated, the table empty or
without training rows (all words are then unknown); a null training flag is false. Extra columns pass unseen; kept ones must not be
named like the result's own.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm import words as W
from tickloom.llm.eliasfano import Trie
from tickloom.llm.release import release
from tickloom.session import checkpoint, shared_dir

ROOM = 1_200_000  # trigram places of a shard
DISCOUNT = 0.9
STEPS = 256  # codes to a decade
NOTHING = 4095  # the code of 0
# numbers of what is no word: before a text (twice), after it, and not in the model
FIRST, BEGIN, AFTER, UNKNOWN = range(4)
END = xxhash.xxh3_64_intdigest(b" end")  # no word holds a space
RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# ------------------------------------------------------------------ messages


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers >= 0, in as few bytes each as the largest needs, like bytes side by side."""
    parts = []
    for a in arrays:
        most = int(a.max(initial=0))
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * int(k[2]))
        narrow = np.ascontiguousarray(a.astype(kind))
        parts.append(np.array([len(a), int(kind[2])], "<i8").tobytes())
        parts.append(narrow.view(np.uint8).reshape(-1, int(kind[2])).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(body: bytes) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8), 0, []
    while at < len(raw):
        size, wide = (int(x) for x in raw[at : at + 16].view("<i8"))
        held = raw[at + 16 : at + 16 + size * wide].reshape(wide, size)
        out.append(np.ascontiguousarray(held.T).reshape(-1).view(f"<u{wide}").astype(np.uint64 if wide == 8 else np.int64))
        at += 16 + size * wide
    return out


def encode(p: np.ndarray) -> np.ndarray:
    """12-bit codes of probabilities, half a step off at most."""
    with np.errstate(divide="ignore"):
        code = np.rint(-STEPS * np.log10(p))
    return np.where(np.isfinite(code), np.clip(code, 0, NOTHING - 1), NOTHING).astype(np.uint16)


_VALUES = np.concatenate([10.0 ** (-np.arange(NOTHING) / STEPS), [0.0]])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """First place of each run of equal rows."""
    size = len(columns[0])
    new = np.ones(size, bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ends(starts: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([starts, [size]])


# ------------------------------------------------------------------ blocks


class Block(NamedTuple):
    """The texts of a block: hashes of its different words, and the words of all texts by their place there."""

    ends: np.ndarray  # first word of each text and the end
    codes: np.ndarray
    hashes: np.ndarray
    train: np.ndarray  # for each text

    @classmethod
    def of(cls, texts: pa.Array, train: np.ndarray) -> "Block":
        ends, codes, distinct = W.split(texts, lower=True)
        # frequent words get the small places, which pack better
        order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(ends.astype(np.int64), place[codes], W.hashed(distinct)[order], train)

    def to_bytes(self) -> bytes:
        return pack(self.ends, self.codes, self.hashes, self.train)

    @classmethod
    def from_bytes(cls, body: bytes) -> "Block":
        ends, codes, hashes, train = unpack(body)
        return cls(ends.astype(np.int64), codes.astype(np.int64), hashes.astype(np.uint64), train.astype(bool))

    def word_counts(self) -> np.ndarray:
        """Places in training texts of each word, and of the end as the last one."""
        trained = np.repeat(self.train, np.diff(self.ends))
        counts = np.bincount(self.codes[trained], minlength=len(self.hashes))
        return np.concatenate([counts, [self.train.sum()]])

    def keys(self) -> np.ndarray:
        return np.concatenate([self.hashes, [np.uint64(END)]])


def blocks(docs: DataFrame, keep: Iterable[str | Column], text: str | Column, train: Column) -> DataFrame:
    """(block, n_train, rows: the kept columns and the flag of each text, body)."""
    text = F.col(text) if isinstance(text, str) else text
    flagged = docs.select(F.struct(*keep, (~F.coalesce(train, F.lit(False))).alias("held_out")).alias("row"), text.cast("string").alias("text"))
    schema = f"block long, n_train long, rows array<{flagged.schema['row'].dataType.simpleString()}>, body binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for cut in W.cuts(batches, "text"):
            rows = cut.column("row")
            train = ~np.array(rows.field("held_out").to_pylist(), bool)
            block = Block.of(cut.column("text"), train)
            listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            n_train = int(np.diff(block.ends)[train].sum() + train.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([n_train], pa.int64()), listed, pa.array([block.to_bytes()], pa.binary())], ["block", "n_train", "rows", "body"]
            )
            number += 1

    return flagged.mapInArrow(run, schema)


def stored(table: DataFrame) -> DataFrame:
    """The blocks as a table in the shared folder, in buckets, so that answers come to them and they are not shuffled."""
    spark = table.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    # no bucket holds more than an input partition does on average
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table.rdd.getNumPartitions())
    table.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return out


# ------------------------------------------------------------------ words


def word_requests(table: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block.from_bytes(body.as_buffer().to_pybytes())
                keys, counts = block.keys(), block.word_counts()
                shard = (keys % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                there = np.flatnonzero(np.diff(cut))
                bodies = [pack(keys[part], counts[part]) for part in (order[cut[s] : cut[s + 1]] for s in there)]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array([number] * len(there), pa.int64()), pa.array(bodies, pa.binary())], ["shard", "block", "body"])

    return table.select("block", "body").mapInArrow(run, "shard long, block long, body binary")


def word_answers(requests: DataFrame, shards: int, room: int) -> DataFrame:
    """(block, shard, body: numbers and counts of the words asked for); a row without block says how many words of the shard
    are known and which have more places than ``room``."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        asked = [unpack(b) for b in table.column("body").to_pylist()]
        keys, inverse = np.unique(np.concatenate([a[0].astype(np.uint64) for a in asked]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([a[1].astype(np.int64) for a in asked]), len(keys)).astype(np.int64)
        known = counts > 0
        # frequent words get the small numbers
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(keys))
        numbers = np.where(known, 4 + rank * shards + shard, UNKNOWN)
        ends = np.cumsum([0, *(len(a[0]) for a in asked)])
        bodies = [pack(numbers[inverse[a:b]], counts[inverse[a:b]]) for a, b in zip(ends[:-1], ends[1:])]
        hot = counts > room
        return pa.table(
            {
                "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()),
                "shard": pa.array([shard] * (len(bodies) + 1), pa.int64()),
                "body": pa.array([*bodies, pack(numbers[hot], counts[hot], keys[hot])], pa.binary()),
                "known": pa.array([None] * len(bodies) + [int(known.sum())], pa.int64()),
            }
        )

    return requests.groupBy("shard").applyInArrow(run, "block long, shard long, body binary, known long")


# ------------------------------------------------------------------ trigrams


class Split(NamedTuple):
    """Contexts whose trigrams are spread over shards: fewer than two for each shard."""

    words: np.ndarray  # sorted
    word_counts: np.ndarray
    pairs: np.ndarray  # sorted by first and second word, two columns
    pair_counts: np.ndarray

    def word(self, w: np.ndarray) -> np.ndarray:
        """Place of each word in ``words``, else -1."""
        if not len(self.words):
            return np.full(len(w), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, at, -1)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        maybe = np.flatnonzero((self.word(a) >= 0) & (self.word(b) >= 0)) if len(self.pairs) else np.zeros(0, np.int64)
        if len(maybe):
            size = len(self.words)
            held = self.word(self.pairs[:, 0]) * size + self.word(self.pairs[:, 1])
            key = self.word(a[maybe]) * size + self.word(b[maybe])
            order = np.argsort(held)
            at = np.minimum(np.searchsorted(held[order], key), len(held) - 1)
            out[maybe] = np.where(held[order][at] == key, order[at], -1)
        return out

    def shard(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, shards: int) -> np.ndarray:
        mixed = W.mix(a.astype(np.uint64))
        word = self.word(a) >= 0
        mixed[word] = W.mix(mixed[word] ^ b[word].astype(np.uint64))
        pair = self.pair(a, b) >= 0
        mixed[pair] = W.mix(mixed[pair] ^ c[pair].astype(np.uint64))
        return (mixed % np.uint64(shards)).astype(np.int64)


class Trigrams:
    """The different trigrams of a block, by places of its words (then FIRST, BEGIN, AFTER), and where its texts have them.

    A text of n words has n + 2: FIRST BEGIN w1, BEGIN w1 w2, ... wn END AFTER.
    """

    def __init__(self, block: Block):
        n = np.diff(block.ends) + 2
        self.ends = np.concatenate([[0], np.cumsum(n)])
        words = len(block.hashes)
        end, first, begin, after = words, words + 1, words + 2, words + 3
        seq = np.full(int(self.ends[-1]) + 2, after, np.int64)
        # place k of a text is the third word of its k-th trigram: its words, END, AFTER
        place = np.arange(len(block.codes)) + 2 * np.repeat(np.arange(len(n)), n - 2)
        third = seq[:-2]
        third[place] = block.codes
        third[self.ends[1:] - 2] = end
        second = np.concatenate([[begin], third[:-1]]) if len(third) else third
        head = np.concatenate([[first], second[:-1]]) if len(third) else third
        second[self.ends[:-1]] = begin
        head[self.ends[:-1]] = first
        head[self.ends[:-1] + 1] = begin
        most = words + 4
        pair = head * most + second
        if most**3 < 1 << 62:
            keys, self.inverse = np.unique(pair * most + third, return_inverse=True)
            pairs, self.c = keys // most, keys % most
        else:
            held, rank = np.unique(pair, return_inverse=True)
            keys, self.inverse = np.unique(rank * most + third, return_inverse=True)
            pairs, self.c = held[keys // most], keys % most
        self.a, self.b = pairs // most, pairs % most
        self.third = third
        trained = np.repeat(block.train, n)
        self.counts = np.bincount(self.inverse[trained], minlength=len(keys))


def word_table(block: Block, answers: list[tuple[int, bytes]], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the block's words, END, FIRST, BEGIN, AFTER; and counts of its words and END."""
    shard = (block.keys() % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    numbers, counts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for s, body in answers:
        numbers[order[cut[s] : cut[s + 1]]], counts[order[cut[s] : cut[s + 1]]] = (x.astype(np.int64) for x in unpack(body))
    return np.concatenate([numbers, [FIRST, BEGIN, AFTER]]), counts


def _routes(t: Trigrams, numbers: np.ndarray, split: Split, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, the block's different trigrams it gets, in order); those after an unknown word go nowhere."""
    a, b, c = numbers[t.a], numbers[t.b], numbers[t.c]
    asked = np.flatnonzero(a != UNKNOWN)
    shard = split.shard(a[asked], b[asked], c[asked], shards)
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(int(s), asked[order[cut[s] : cut[s + 1]]]) for s in np.flatnonzero(np.diff(cut))]


def _cogrouped(table: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """``run(block row, answers of the block)`` for each block."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, sorted(zip(right.column("shard").to_pylist(), right.column("body").to_pylist())))

    return table.groupBy("block").cogroup(answers.select("block", "shard", "body").groupBy("block")).applyInArrow(one, schema)


def hot_pairs(table: DataFrame, split: Split, keys: np.ndarray, room: int) -> list:
    """Pairs of split words (``keys``: their hashes) with more than ``room`` places in training texts."""
    size = len(split.words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys)
        for batch in batches:
            for body in batch.column(0):
                block = Block.from_bytes(body.as_buffer().to_pybytes())
                t = Trigrams(block)
                own = block.keys()
                at = order[np.minimum(np.searchsorted(keys[order], own), len(keys) - 1)]
                place = np.where(keys[at] == own, at, -1)
                place = np.concatenate([place, [split.word(np.array([w]))[0] for w in (FIRST, BEGIN)], [-1]])
                a, b = place[t.a], place[t.b]
                there = np.flatnonzero((a >= 0) & (b >= 0) & (t.counts > 0))
                key, inverse = np.unique(a[there] * size + b[there], return_inverse=True)
                n = np.bincount(inverse, t.counts[there], len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(split.words[key // size]), pa.array(split.words[key % size]), pa.array(n)], ["a", "b", "n"])

    pairs = table.select("body").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return pairs.where(F.col("n") > room).orderBy("a", "b").collect()


def trigram_requests(table: DataFrame, answers: DataFrame, shards: int, split: Split) -> DataFrame:
    def run(left: pa.Table, found: list) -> pa.Table:
        block = Block.from_bytes(left.column("body")[0].as_py())
        numbers, _ = word_table(block, found, shards)
        t = Trigrams(block)
        to, bodies = [], []
        for shard, at in _routes(t, numbers, split, shards):
            heads, pairs = _starts(t.a[at]), _starts(t.a[at], t.b[at])
            per_head = np.diff(np.searchsorted(pairs, _ends(heads, len(at))))
            to.append(shard)
            bodies.append(pack(numbers[t.a[at[heads]]], per_head, numbers[t.b[at[pairs]]], np.diff(_ends(pairs, len(at))), numbers[t.c[at]], t.counts[at]))
        return pa.table({"shard": pa.array(to, pa.int64()), "block": pa.array([left.column("block")[0].as_py()] * len(to), pa.int64()), "body": pa.array(bodies, pa.binary())})

    return _cogrouped(table, answers, run, "shard long, block long, body binary")


class Shard:
    """A part of the model from the trigrams that blocks sent, each with its training count."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, split: Split, discount: float):
        kept = n > 0
        a, b, c, n = a[kept], b[kept], c[kept], n[kept].astype(np.float64)
        heads, pairs = _starts(a), _starts(a, b)
        in_pair = np.diff(_ends(pairs, len(a)))
        n3 = np.add.reduceat(n, pairs) if len(pairs) else np.zeros(0)
        split_pair = split.pair(a[pairs], b[pairs])
        n3 = np.where(split_pair >= 0, split.pair_counts[split_pair] if len(split.pairs) else 0, n3)
        first_pair = np.searchsorted(pairs, _ends(heads, len(a)))
        in_head = np.diff(first_pair)
        n2 = np.add.reduceat(n3, first_pair[:-1]) if len(heads) else np.zeros(0)
        split_word = split.word(a[heads])
        n2 = np.where(split_word >= 0, split.word_counts[split_word] if len(split.words) else 0, n2)
        self.trie = Trie.of(
            [
                (a[heads], None, {"left": encode(discount * in_head / n2)}),
                (b[pairs], first_pair, {"left": encode(discount * in_pair / n3), "share": encode((n3 - discount) / np.repeat(n2, in_head))}),
                (c, _ends(pairs, len(a)), {"share": encode((n - discount) / np.repeat(n3, in_pair))}),
            ]
        )
        # different followers of split contexts here; a split pair's own word is counted once, with the pair
        alone = np.add.reduceat((split_pair < 0).astype(np.int64), first_pair[:-1]) if len(heads) else np.zeros(0, np.int64)
        at, hot = np.flatnonzero(split_word >= 0), np.flatnonzero(split_pair >= 0)
        self.followers = np.concatenate([a[heads][at], a[pairs][hot]]), np.concatenate([np.full(len(at), -1), b[pairs][hot]]), np.concatenate([alone[at], in_pair[hot]])


def trigram_answers(requests: DataFrame, split: Split, discount: float) -> DataFrame:
    """(block, shard, body: codes for each trigram, pair and first word asked for); rows without block hold the number of
    different followers of a split context in this shard."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        shapes, a, b, c, n = [], [], [], [], []
        for body in table.column("body"):
            heads, per_head, pairs, per_pair, thirds, counts = (x.astype(np.int64) for x in unpack(body.as_buffer().to_pybytes()))
            a.append(np.repeat(np.repeat(heads, per_head), per_pair))
            b.append(np.repeat(pairs, per_pair))
            c.append(thirds)
            n.append(counts)
            shapes.append((per_head, per_pair, len(thirds)))
        a, b, c, n = (np.concatenate(x) for x in (a, b, c, n))
        heads, rank = np.unique(a, return_inverse=True)
        most = int(max(b.max(initial=0), c.max(initial=0))) + 1
        if len(heads) * most * most < 1 << 62:
            keys, inverse = np.unique((rank * most + b) * most + c, return_inverse=True)
            pairs, c = keys // most, keys % most
        else:
            held, pair_rank = np.unique(rank * most + b, return_inverse=True)
            keys, inverse = np.unique(pair_rank * most + c, return_inverse=True)
            pairs, c = held[keys // most], keys % most
        n = np.bincount(inverse, n, len(keys))
        a, b = heads[pairs // most], pairs % most
        inverse = inverse.astype(np.int32)
        del rank, keys, pairs
        part = Shard(a, b, c, n, split, discount)
        trie = part.trie.mapped()
        first, pair = _starts(a), _starts(a, b)
        node = trie.find(0, np.zeros(len(first), np.int64), a[first])
        left2 = trie.column(0, "left", node, 0)
        of_pair = np.searchsorted(first, pair, "right") - 1
        node = trie.find(1, node[of_pair], b[pair])
        left3, share2 = trie.column(1, "left", node, 0), trie.column(1, "share", node, NOTHING)
        of_gram = np.repeat(np.arange(len(pair)), np.diff(_ends(pair, len(a))))
        share3 = trie.column(2, "share", trie.find(2, node[of_gram], c), NOTHING)
        bodies, at = [], 0
        for per_head, per_pair, size in shapes:
            grams = inverse[at : at + size]
            at += size
            in_pair = of_gram[grams[np.cumsum(per_pair) - per_pair]]
            in_head = of_pair[in_pair[np.cumsum(per_head) - per_head]]
            bodies.append(pack(share3[grams], left3[in_pair], share2[in_pair], left2[in_head]))
        words, seconds, followers = part.followers
        none, extra = [None] * len(words), [None] * len(bodies)
        return pa.table(
            {
                "block": pa.array([*table.column("block").to_pylist(), *none], pa.int64()),
                "shard": pa.array([shard] * (len(bodies) + len(words)), pa.int64()),
                "body": pa.array([*bodies, *none], pa.binary()),
                "a": pa.array([*extra, *words.tolist()], pa.int64()),
                "b": pa.array([*extra, *seconds.tolist()], pa.int64()),
                "followers": pa.array([*extra, *followers.tolist()], pa.int64()),
            }
        )

    return requests.groupBy("shard").applyInArrow(run, "block long, shard long, body binary, a long, b long, followers long")


# ------------------------------------------------------------------ scores


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of finished stages removed. What held them is let go bit by bit, over a second or so."""
    for _ in range(3):
        release(spark)
        time.sleep(0.4)


def scored(table: DataFrame, words: DataFrame, grams: DataFrame, shards: int, split: Split, left2: np.ndarray, left3: np.ndarray, share2: np.ndarray, total: int, known: int) -> DataFrame:
    """Scores of all texts from the answers to their blocks; ``left2`` and ``left3`` are what split words and pairs leave to lower
    orders, ``share2`` the shares of split pairs."""
    rows = table.schema["rows"].dataType.elementType
    names = [f.name for f in rows.fields if f.name != "held_out"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.fields if f.name != "held_out"] + [RESULT])
    both = words.select("block", F.lit(0).alias("kind"), "shard", "body").union(grams.select("block", F.lit(1), "shard", "body"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block.from_bytes(left.column("body")[0].as_py())
        found = sorted(zip(right.column("kind").to_pylist(), right.column("shard").to_pylist(), right.column("body").to_pylist()))
        numbers, counts = word_table(block, [x[1:] for x in found if x[0] == 0], shards)
        t = Trigrams(block)
        size = len(t.a)
        d3, g3, d2, g2 = np.zeros(size), np.ones(size), np.zeros(size), np.ones(size)
        answers = {x[1]: x[2] for x in found if x[0] == 1}
        for shard, at in _routes(t, numbers, split, shards):
            of_gram, of_pair, of_pair_too, of_head = (x.astype(np.int64) for x in unpack(answers[shard]))
            heads, pairs = _starts(t.a[at]), _starts(t.a[at], t.b[at])
            d3[at] = _VALUES[of_gram]
            per_pair = np.diff(_ends(pairs, len(at)))
            g3[at], d2[at] = np.repeat(_VALUES[of_pair], per_pair), np.repeat(_VALUES[of_pair_too], per_pair)
            g2[at] = np.repeat(_VALUES[of_head], np.diff(_ends(heads, len(at))))
        a, b = numbers[t.a], numbers[t.b]
        word, pair = split.word(a), split.pair(a, b)
        g2 = np.where(word >= 0, left2[word], g2) if len(left2) else g2
        if len(left3):  # a shard may have been asked for a split pair of which it holds no trigram
            g3 = np.where(pair >= 0, left3[pair], g3)
            d2 = np.where(pair >= 0, share2[pair], d2)
        # p1 of every trigram's third word; AFTER is no token
        one = np.concatenate([(counts + 1) / (total + known + 1), np.ones(3)])[t.third]
        gram, next_gram = t.inverse, np.concatenate([t.inverse[1:], [0]]) if len(t.inverse) else t.inverse
        lower = d2[next_gram] + g2[next_gram] * one
        p = d3[gram] + g3[gram] * lower
        token = np.ones(len(gram), bool)
        token[t.ends[1:] - 1] = False
        owner = np.repeat(np.arange(len(t.ends) - 1), np.diff(t.ends))[token]
        per = lambda x: np.bincount(owner, x[token], len(t.ends) - 1)
        seen = np.concatenate([counts > 0, np.zeros(3, bool)])[t.third]
        listed = left.column("rows").combine_chunks().flatten()
        out = {n: listed.field(n) for n in names}
        n_tokens = np.diff(block.ends) + 1
        out |= {"held_out": listed.field("held_out"), "n_tokens": n_tokens, "n_known": per(seen.astype(float)).astype(np.int64)}
        out |= {"train_tokens": np.full(len(n_tokens), total), "base_score": per(np.log10(one)), "score": per(np.log10(p))}
        return pa.table(out)

    return table.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(run, schema)


def score(docs: DataFrame, *keep: str | Column, text: str | Column = "text", train: Column, room: int = ROOM, discount: float = DISCOUNT) -> DataFrame:
    """The columns ``keep`` of each row, and its text's scores by the model of the rows where ``train`` holds.

    Words are lower-cased (A-Z) runs of anything but white space; a text's end is one more token. ``base_score`` adds up the
    logarithms (base 10) of p1, ``score`` those of the model.
    """
    spark: SparkSession = docs.sparkSession
    table = stored(blocks(docs, keep, text, train))
    total = table.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    texts = table.agg(F.coalesce(F.sum(F.size(F.filter("rows", lambda r: ~r["held_out"]))), F.lit(0))).first()[0]
    shards = max(1, -(-total // room))
    words = checkpoint(word_answers(word_requests(table, shards), shards, room))
    let_go(spark)
    told = [(r.known, unpack(bytes(r.body))) for r in words.where("block IS NULL").select("known", "body").collect()]
    known = sum(k for k, _ in told)
    hot = sorted((int(w), int(n), int(key)) for _, (numbers, counts, keys) in told for w, n, key in zip(numbers, counts, keys))
    if texts > room:  # what stands before a text has no hash; these two match no word's
        hot = [(FIRST, texts, FIRST), (BEGIN, texts, BEGIN), *hot]
    split = Split(*(np.array([h[k] for h in hot], np.int64) for k in (0, 1)), np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    words = words.where("block IS NOT NULL")
    if hot:
        found = np.array([tuple(r) for r in hot_pairs(table, split, np.array([h[2] for h in hot], np.uint64), room)], np.int64).reshape(-1, 3)
        split = split._replace(pairs=found[:, :2].copy(), pair_counts=found[:, 2].copy())
    grams = checkpoint(trigram_answers(trigram_requests(table, words, shards, split), split, discount))
    let_go(spark)
    followers: dict[tuple[int, int], int] = {}
    if hot:
        sums = grams.where("block IS NULL").groupBy("a", "b").agg(F.sum("followers").alias("n"))
        followers = {(r.a, r.b): r.n for r in sums.collect()}
    pairs = [(int(a), int(b)) for a, b in split.pairs]
    left3 = np.array([discount * followers.get(p, 0) / n for p, n in zip(pairs, split.pair_counts)])
    share2 = (split.pair_counts - discount) / split.word_counts[split.word(split.pairs[:, 0])] if pairs else np.zeros(0)
    own = {int(a): 0 for a in split.words}
    for a, _ in pairs:
        own[a] += 1
    left2 = np.array([discount * (followers.get((int(a), -1), 0) + own[int(a)]) / n for a, n in zip(split.words, split.word_counts)])
    return scored(table, words, grams.where("block IS NOT NULL"), shards, split, left2, left3, share2, total, known)
