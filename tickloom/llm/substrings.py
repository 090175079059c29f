"""Substring dedup with a compressed FM-index per shard.

A window is ``window`` consecutive words. Every window has a seed, the least hash of its ``GRAM``-word runs;
equal windows have equal seeds. Consecutive windows of one seed form a segment of at most ``SPAN`` windows.
Only segments whose seed turns up again can hold a window that does. Each such segment, once per content
and weighed by how often it occurs, goes to the shard of its seed. A shard's task builds an FM-index over
its segments (wavelet matrix) and streams them through it: backward search gives the matching statistics,
and intervals of at least ``window`` words that occur twice or more are reported. They are joined back to
the texts by segment, and covered words are removed.

A seed of over ``HOT`` different segments is dealt out by window instead: equal windows still meet, and no
task gets all of a common passage's surroundings. Equal texts are searched once.

Windows are judged on the input. Null texts have no words; texts shorter than a window lose nothing; equal
rows lose every window they hold; ids may be null or repeated; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm import words as W
from tickloom.llm.filters import key_filter, passes
from tickloom.llm.fmindex import DEPTH, Index
from tickloom.llm.release import release
from tickloom.session import checkpoint

WINDOW = 35
GRAM = 8
SPAN = DEPTH - WINDOW - 1  # windows of a segment: its words stay below the index's depth
HOT = 1000
SHARD_WORDS = 400_000

_B = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_B), -1, 1 << 64))


def _sliding_min(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``n`` values side by side, and whether it is there twice."""

    def joined(a: tuple, b: tuple) -> tuple:
        size = min(len(a[0]), len(b[0]))
        (p, d), (q, e) = (a[0][:size], a[1][:size]), (b[0][:size], b[1][:size])
        return np.minimum(p, q), np.where(p == q, True, np.where(p < q, d, e))

    power, width, out, covered = (x, np.zeros(len(x), bool)), 1, None, 0
    while width <= n:
        if n & width:
            moved = (power[0][covered:], power[1][covered:])
            out = moved if out is None else joined(out, moved)
            covered += width
        power, width = joined(power, (power[0][width:], power[1][width:])), 2 * width
    return out[0][: len(x) - n + 1], out[1][: len(x) - n + 1]


def _ranges(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words [start, end) of each range."""
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), _B)]))
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), _BACK)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(h) * up[:-1])])
    return W.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def segments(ends: np.ndarray, h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, first word in all, windows, seed, content, inner) of the segments of texts side by side; inner
    tells that the seed stands twice in a window, so that windows may be equal inside the segment."""
    size = len(h)
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if size < window:
        return none
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    seed, twice = _sliding_min(W.grams(h, GRAM), window - GRAM + 1)
    at = np.flatnonzero(owner[: size - window + 1] == owner[window - 1 :])
    if not len(at):
        return none
    new = np.concatenate([[True], (seed[at[1:]] != seed[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    run = np.cumsum(new) - 1
    place = np.arange(len(at)) - np.flatnonzero(new)[run]
    first = np.flatnonzero(place % SPAN == 0)
    count = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    inner = np.logical_or.reduceat(twice[at], first)
    return owner[start], start, count, seed[start], _ranges(h, start, start + count + window - 1), inner


def _cuts(batches: Iterable[pa.RecordBatch], most: int, limit: int = W.CUT) -> Iterator[pa.RecordBatch]:
    """Cuts of (_id, _text) in which a text comes at most ``most`` times in a task."""
    seen: dict[int, int] = {}
    for cut in W.cuts(batches, "_text", limit):
        keep = []
        for key in cut.column("_id").to_pylist():
            seen[key] = seen.get(key, 0) + 1
            keep.append(seen[key] <= most)
        yield cut.filter(pa.array(keep, pa.bool_()))


def occurrences(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(seed, seg, text, first, windows, inner) of all segments; the second copy of a text in a task is the last listed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in _cuts(batches, 2):
            ends, codes, distinct = W.split(cut.column("_text"))
            text, start, count, seed, content, inner = segments(ends, W.hashed(distinct)[codes], window)
            ids = cut.column("_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[text], pa.int64()), pa.array((start - ends[text]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(inner)],
                ["seed", "seg", "text", "first", "windows", "inner"],
            )

    return texts.mapInArrow(run, "seed long, seg long, text long, first int, windows int, inner boolean")


def units(texts: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """(shard key, seg, weight, shift, unit, content): segments with their words; those of hot seeds by window.

    A window that a task has met twice comes without its words after that. ``wanted`` has (text, parts of
    (first, windows, seed, seg, weight, hot)): one text that holds each segment.
    """
    held = texts.sparkSession.sparkContext.broadcast(key_filter(wanted, "text"))

    def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in _cuts(batches, 1):
            yield cut.filter(pa.array(passes(held.value, cut.column("_id").to_numpy(zero_copy_only=False)), pa.bool_()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, met = ["key", "seg", "weight", "shift", "unit", "content"], {}
        # every word of a hot text stands in 35 windows: small cuts keep their rows few
        for cut in _cuts(batches, 1, 1 << 18):
            ends, codes, distinct = W.split(cut.column("_text"))
            words, h = np.array(distinct.to_pylist(), object)[codes], W.hashed(distinct)[codes]
            rows: list[tuple] = []
            for i, parts in enumerate(cut.column("parts").to_pylist()):
                base = int(ends[i])
                for p in parts:
                    start, n = base + p["first"], p["windows"]
                    if not p["hot"]:
                        rows.append((p["seed"], p["seg"], p["weight"], 0, p["seg"], " ".join(words[start : start + n + window - 1])))
                        continue
                    at = np.arange(n)
                    for k, unit in enumerate(_ranges(h[start : start + n + window - 1], at, at + window).view(np.int64).tolist()):
                        met[unit] = met.get(unit, 0) + 1
                        rows.append((unit, p["seg"], p["weight"], k, unit, " ".join(words[start + k : start + k + window]) if met[unit] <= 2 else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], names
            )

    sifted = texts.mapInArrow(sift, "_id long, _text string")
    found = sifted.join(wanted, sifted["_id"] == wanted["text"]).select("_id", "_text", "parts")
    return found.mapInArrow(run, "key long, seg long, weight long, shift int, unit long, content string")


def _shard(window: int):
    def search(group: pd.DataFrame) -> pd.DataFrame:
        # a segment may come from several copies of its text; different segments of a window add up
        group = group.drop_duplicates(["unit", "seg", "shift"])
        by_unit = group.groupby("unit", sort=False).agg(weight=("weight", "sum"), content=("content", "first"))
        codes: dict[str, int] = {}
        runs = [np.array([codes.setdefault(w, len(codes) + 1) for w in c.split(" ")], np.int64) for c in by_unit["content"]]
        run, start, end = Index(runs, by_unit["weight"].to_numpy(np.int64)).repeats(window)
        return pd.DataFrame({"unit": by_unit.index.to_numpy()[run], "from": start, "to": end})

    return search


def repeats(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(text, spans of (from, to)): the words covered by windows that start twice or more, by text."""
    by_seed = Window.partitionBy("seed")
    again = occurrences(texts, window).withColumn("_n", F.count("*").over(by_seed)).where("_n > 1 OR inner").drop("_n", "inner")
    found = checkpoint(again)
    del again
    release(texts.sparkSession)
    segs = found.groupBy("seed", "seg").agg(F.count("*").alias("weight"), F.min(F.struct("text", "first", "windows")).alias("at"))
    many = segs.groupBy("seed").agg((F.count("*") > HOT).alias("hot"))
    wanted = segs.join(many, "seed").groupBy("at.text").agg(F.collect_list(F.struct(F.col("at.first").alias("first"), F.col("at.windows").alias("windows"), "seed", "seg", "weight", "hot")).alias("parts"))
    parts = checkpoint(units(texts, checkpoint(wanted), window))
    del segs, many, wanted
    release(texts.sparkSession)
    size = parts.agg(F.sum(F.length("content")).alias("chars")).first()["chars"] or 0
    shards = max(1, -(-size // (6 * SHARD_WORDS)))
    dealt = parts.where("content IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).drop("key")
    spans = checkpoint(dealt.groupBy("shard").applyInPandas(_shard(window), "unit long, `from` int, `to` int"))
    del dealt
    release(texts.sparkSession)
    # a segment that wasn't cut up is its own unit
    moved = parts.where("unit <> seg").select("seg", "shift", "unit").distinct().join(spans, "unit")
    covers = spans.select(F.col("unit").alias("seg"), "from", "to").union(moved.select("seg", (F.col("from") + F.col("shift")).alias("from"), (F.col("to") + F.col("shift")).alias("to")))
    per_seg = checkpoint(covers.groupBy("seg").agg(F.collect_set(F.struct("from", "to")).alias("spans")))
    placed = found.select("seg", "text", "first").join(per_seg, "seg")
    moved = F.transform("spans", lambda s: F.struct((s["from"] + F.col("first")).alias("from"), (s["to"] + F.col("first")).alias("to")))
    return checkpoint(placed.select("text", moved.alias("spans")).groupBy("text").agg(F.flatten(F.collect_set("spans")).alias("spans")))


def dedup(docs: DataFrame, *keep: str | Column, text: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """The columns ``keep`` of each row with n_words, n_removed and the digest of what is kept (and the kept text)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(whole).alias("_id"), whole.alias("_text"))
    found = repeats(texts, window)
    rows = docs.select(*keep, whole.alias("_text"), F.xxhash64(whole).alias("_id"))
    names = [c for c in rows.columns if c not in ("_id", "_text")]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    schema = ", ".join(filter(None, [kept, "n_words long, n_removed long, kept_sha256 string", "kept_text string" * with_text]))
    held = docs.sparkSession.sparkContext.broadcast(key_filter(found, "text"))

    def touched(wanted: bool):
        """Rows whose text may have spans, or the others, which need no join."""

        def sift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cut in W.cuts(batches, "_text"):
                hit = passes(held.value, cut.column("_id").to_numpy(zero_copy_only=False))
                yield cut.filter(pa.array(hit if wanted else ~hit, pa.bool_()))

        return sift

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in W.cuts(batches, "_text"):
            none = "spans" not in cut.schema.names
            total, removed, left = [], [], []
            for text, spans in zip(cut.column("_text").to_pylist(), [pa.scalar(None)] * cut.num_rows if none else cut.column("spans")):
                words = text.encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                if spans.is_valid and len(spans):
                    flat = spans.values
                    np.add.at(gone, flat.field("from").to_numpy(), 1)
                    np.add.at(gone, flat.field("to").to_numpy(), -1)
                covered = np.cumsum(gone[:-1]) > 0
                n = int(covered.sum())
                total.append(len(words))
                removed.append(n)
                left.append(b" ".join(w for w, c in zip(words, covered) if not c) if n else b" ".join(words))
            columns = [*cut.columns[: len(names)], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
            if with_text:
                columns.append(pa.array([x.decode() for x in left], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    whole_rows = rows.mapInArrow(lambda batches: run(touched(False)(batches)), schema)
    some = rows.mapInArrow(touched(True), rows.schema).join(found.withColumnRenamed("text", "_id"), "_id", "left")
    return some.select(*names, "_text", "spans").mapInArrow(run, schema).union(whole_rows)
