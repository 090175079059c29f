"""Words of whole texts inside Arrow batches: splitting, hashing, shingles.

A word is ``[^\\x20\\x09-\\x0D]+``. A null text has no words. Batches are cut by bytes of text, so a task
holds a few megabytes at a time whatever the number of rows; one very long text is a cut of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CUT = 4 << 20
PATTERN = r"[^\x20\x09-\x0D]+"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def cuts(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CUT) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def split(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first word of each text and the end, code of each word, distinct words by code)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))])
    coded = parts.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:
        full = codes != empty
        before = np.concatenate([[0], np.cumsum(full)])
        ends, codes = before[ends], codes[full]
    return ends, codes, distinct


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words.to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words from the hashes of the words; no runs if there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _ODD
        out += h[k : k + len(out)]
    return mix(out)


def shingle_sets(ends: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingles; fewer than ``n`` words are one shingle, no words none."""
    runs, out = grams(h, n), []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= n:
            s = np.sort(runs[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(grams(h[a:b], b - a) ^ np.uint64(b - a) if b > a else np.empty(0, np.uint64))
    return out
