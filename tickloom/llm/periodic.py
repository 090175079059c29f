"""Periodic runs of words by an online sparse diagonal DP.

A word that occurred ``d`` words earlier lengthens the match on diagonal ``d``; a diagonal that ends after ``m``
matches is a stretch of ``m + d`` words of period ``d``, and is emitted at once if it is long enough. Three things
keep the table sparse, and none loses a run:

* diagonals 1 to 7 are compared as they are;
* a run on a longer diagonal has ``m >= d``. For lags from ``2 W`` to ``8 W`` (W = 4, 16, 64, ...) such a match holds a
  whole aligned block of ``W`` words, so the DP steps from block to block: the earlier occurrences of the block at these
  lags lengthen their diagonals by ``W``, and a diagonal that ends grows by less than a block on either side;
* a block and its occurrence inside one run of period ``q <= W`` leave the diagonal, as by the periodicity lemma ``d`` is
  then no smallest period. So ``n`` equal words cost ``n log n`` steps, not ``n * n``.

A null text or one without words has no runs and an empty collapsed text. Texts may be very long, rows repeated, the
table empty; extra columns pass unseen, and those kept may have any name but ``runs`` and ``collapsed``, which come last.
Ties: all runs are returned, by start and then period.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm import words as W

DENSE = 8  # lags below are compared as they are
PAIRS = 4 << 20  # block pairs held at a time
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _segments(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each stretch of true values."""
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _repeated(at: np.ndarray, ranks: np.ndarray, size: int) -> np.ndarray:
    """Ranks by place, -1 where a window occurs once."""
    out = np.full(size, -1, np.int64)
    if len(at):
        twice = np.bincount(ranks)[ranks] > 1
        out[at[twice]] = ranks[twice]
    return out


def _blocks(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Ranks of the four-word windows that a text holds more than once, by their first word; else -1."""
    size = len(codes)
    if size < 4:
        return np.full(size, -1, np.int64)
    c = codes.astype(np.uint64)
    key = W.grams(W.mix(c + np.uint64(1)), 4) ^ W.mix(owner[: size - 3].astype(np.uint64) << np.uint64(1))
    inside = owner[: size - 3] == owner[3:]
    ordered = np.sort(key[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.full(size, -1, np.int64)
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    at = np.flatnonzero(inside & (twice[place] == key))
    # hashes only chose the places: ranks are exact
    most = int(codes.max()) + 1
    pairs = [_ranked(codes[at + k].astype(np.int64) * most + codes[at + k + 1]) for k in (0, 2)]
    ranks = _ranked(_ranked(pairs[0] * (int(pairs[1].max()) + 1) + pairs[1]) * (int(owner[-1]) + 1) + owner[at])
    return _repeated(at, ranks, size)


def _wider(ranks: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Ranks of windows of four times the width."""
    size, last = len(ranks), len(ranks) - 4 * width + 1
    if last <= 0:
        return np.full(size, -1, np.int64)
    there = (ranks[:last] >= 0) & (owner[:last] == owner[4 * width - 1 :])
    for k in (1, 2, 3):
        there &= ranks[k * width : k * width + last] >= 0
    at = np.flatnonzero(there)
    if not len(at):
        return np.full(size, -1, np.int64)
    now = ranks[at]
    for k in (1, 2, 3):
        now = _ranked(now * (int(ranks.max()) + 1) + ranks[at + k * width])
    return _repeated(at, now, size)


def _grow(levels: list[tuple[int, np.ndarray]], at: np.ndarray, lag: np.ndarray, forward: bool) -> np.ndarray:
    """How far the matches go on from ``at``, less than a block: by windows of all smaller widths, widest first."""
    grown = np.zeros(len(at), np.int64)
    for width, ranks in reversed(levels):
        left = np.arange(len(at))
        for _ in range(3):
            here = at[left] + 1 + grown[left] if forward else at[left] - width - grown[left]
            ok = (here < len(ranks)) & (here - lag[left] >= 0)
            left, here = left[ok], here[ok]
            now = ranks[here]
            same = (now >= 0) & (now == ranks[here - lag[left]])
            left = left[same]
            grown[left] += width
            if not len(left):
                break
    return grown


class _Diagonals:
    """The runs of one batch of texts, laid end to end."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, least: int):
        self.codes, self.least = codes, least
        self.owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        self.longest = int(np.diff(ends).max(initial=0))
        # windows that can be told apart, by width; single words are told apart by text as well
        self.levels = [(1, codes * max(len(ends) - 1, 1) + self.owner)]
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # first and last word, lag

    def emit(self, first: np.ndarray, last: np.ndarray, lag: np.ndarray) -> None:
        """Diagonals that ended, by their first and last match."""
        matched = last - first + 1
        long = (matched >= lag) & (matched + lag >= self.least)
        if long.any():
            self.found.append(((first - lag)[long], last[long], lag[long]))

    def dense(self) -> None:
        for d in range(1, min(DENSE, len(self.codes))):
            first, last = _segments((self.codes[d:] == self.codes[:-d]) & (self.owner[d:] == self.owner[:-d]))
            self.emit(first + d, last + d, np.full(len(first), d))

    def inside(self, low: np.ndarray, high: np.ndarray, period: int) -> np.ndarray:
        """Whether [low, high] lies in one run found so far of at most that period."""
        runs = [(s[q <= period], e[q <= period]) for s, e, q in self.found]
        start, end = (np.concatenate([r[k] for r in runs]) if runs else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(start, kind="stable")
        reach = np.concatenate([[-1], np.maximum.accumulate(end[order])]) if len(start) else np.array([-1])
        return reach[np.searchsorted(start[order], low, "right")] >= high

    def blocks(self, ranks: np.ndarray, width: int, low: int, high: int) -> None:
        """Lags from ``low`` to below ``high`` by blocks of ``width`` words."""
        size = len(ranks)
        held = np.flatnonzero(ranks >= 0)
        keys = np.sort(ranks[held] * (size + 1) + held)
        anchors = held[held % width == 0]
        base = ranks[anchors] * (size + 1)
        todo = [(low, high)]
        while todo:
            a, b = todo.pop()
            i0 = np.searchsorted(keys, base + np.maximum(anchors - b + 1, 0))
            counts = np.maximum(np.searchsorted(keys, base + anchors - a, "right") - i0, 0)
            counts[anchors < a] = 0
            total = int(counts.sum())
            if total > PAIRS and b - a > 1:
                todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
                continue
            if not total:
                continue
            here = np.repeat(anchors, counts)
            skip = np.repeat(i0 - np.cumsum(counts) + counts, counts)
            lag = here - keys[skip + np.arange(total)] % (size + 1)
            order = np.argsort(lag * (size + 1) + here)
            here, lag = here[order], lag[order]
            fresh = np.concatenate([[True], (lag[1:] != lag[:-1]) | (here[1:] - here[:-1] != width)])
            head = np.flatnonzero(fresh)
            known = np.bitwise_or.reduceat(self.inside(here - lag, here + width - 1, width), head)
            first, last, d = here[head], here[np.concatenate([head[1:], [total]]) - 1] + width - 1, lag[head]
            # room for a match of the lag's length?
            open_ = ~known & (last - first + 2 * width - 1 >= d)
            first, last, d = first[open_], last[open_], d[open_]
            self.emit(first - _grow(self.levels, first, d, False), last + _grow(self.levels, last, d, True), d)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last word and smallest period of every run, by first word and period."""
        self.dense()
        ranks, width = _blocks(self.codes, self.owner), 4
        while (ranks >= 0).any() and 4 * width <= self.longest:
            self.blocks(ranks, width, 2 * width, min(8 * width, self.longest // 2 + 1))
            self.levels.append((width, ranks))
            ranks, width = _wider(ranks, self.owner, width), 4 * width
        if not self.found:
            return (np.zeros(0, np.int64),) * 3
        start, end, lag = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((lag, end, start))
        start, end, lag = start[order], end[order], lag[order]
        # a longer period of the same stretch is a multiple of its smallest one
        least = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
        start, end, lag = start[least], end[least], lag[least]
        order = np.lexsort((lag, start))
        return start[order], end[order], lag[order]


def find_runs(codes: np.ndarray, ends: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of several texts laid end to end (``ends``: first word of each and the end): the first and last word of
    each run, counted over all texts, and its smallest period. ``least`` is the fewest words of a run."""
    return _Diagonals(codes.astype(np.int64), ends, least).runs()


def collapse(docs: DataFrame, *keep: str | Column, text: str | Column = "text", least: int = 12) -> DataFrame:
    """The columns ``keep`` of each row, its text's ``runs`` of at least ``least`` words and twice their period, and
    ``collapsed``: the words that no run repeats (each run keeps its first period), joined by one space."""
    text = F.col(text) if isinstance(text, str) else text
    narrow = docs.select(*keep, text.cast("string").alias("_collapse_text"))
    kept = [f for f in narrow.schema.fields if f.name != "_collapse_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"runs {RUNS}", "collapsed string"])
    fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in W.cuts(batches, "_collapse_text"):
            ends, codes, distinct = W.split(cut.column(cut.num_columns - 1).cast(pa.string()))
            start, last, period = find_runs(codes, ends, least)
            cover = np.zeros(len(codes) + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, last + 1, -1)
            stays = np.cumsum(cover[:-1]) == 0
            kept_ends = np.concatenate([[0], np.cumsum(stays)])[ends]
            words = distinct.take(pa.array(codes[stays], pa.int32()))
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_ends, pa.int32()), words), " ")
            owner = np.searchsorted(ends, start, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(x) for x in (start - ends[owner], last - start + 1, period)], [f[0] for f in fields])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(ends))), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([*cut.columns[:-1], runs, text], [*cut.schema.names[:-1], "runs", "collapsed"])

    return narrow.mapInArrow(run, schema)


def digest(found: DataFrame, *keep: str) -> DataFrame:
    """Counts, the longest run and hashes of ``collapse``'s result; DataFrame functions only."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lined = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    b = found.withColumn("_best", best)
    return b.select(
        *keep,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.before")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(lined, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(text: str | Column, key: str | Column) -> Column:
    """The text, made periodic from a word on in a tenth of the keys; by crc32 of the key. Null keys change nothing."""
    text, key = (F.col(c) if isinstance(c, str) else c for c in (text, key))
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = F.when(n > 0, F.pmod(g, n))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        made = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int"))))
        return F.array_join(made, " ")

    # the one-element array lets the words be split once
    return F.when(F.pmod(h, F.lit(10)) == 0, F.get(F.transform(F.array(words), repeat), F.lit(0))).otherwise(text)
