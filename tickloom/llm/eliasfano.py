"""Monotone sequences in Elias-Fano form, and an n-gram trie made of them.

A sequence of n values below u keeps log2(u / n) low bits of each value in a packed array and its high bits in a unary
bit vector with one count per 512 bits: about log2(u / n) + 2.1 bits per value. Arrays live in one file that is mapped
into memory; all queries are vectorised and read only the places they touch.
"""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np

_U = np.uint64
_ONE = _U(1)
BLOCK = 8  # 64-bit cells per count
CHUNK = 1 << 15  # queries at a time, for the caches
#: Place of the k-th set bit of a byte.
_IN_BYTE = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


def _chunked(query):
    """Run a method over slices of its argument arrays."""

    def run(self, *args):
        size = len(args[0])
        if size <= CHUNK:
            return query(self, *args)
        return np.concatenate([query(self, *(a[i : i + CHUNK] for a in args)) for i in range(0, size, CHUNK)])

    return run


class Monotone:
    """A non-decreasing sequence of whole numbers."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.size, self.low_bits, self.low, self.high, self.ones = size, low_bits, low, high, ones
        blocks = np.arange(len(ones), dtype=np.int64)
        self.zeros = blocks * (64 * BLOCK) - ones

    @classmethod
    def of(cls, values: np.ndarray) -> "Monotone":
        size = len(values)
        most = int(values[-1]) + 1 if size else 1
        low_bits = max(0, (most // max(size, 1)).bit_length() - 1)
        cells = -(-(size + (most >> low_bits) + 1) // (64 * BLOCK)) * BLOCK
        places = (values >> low_bits) + np.arange(size)
        bits = np.zeros(cells * 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view(_U)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))])
        low = np.zeros(-(-size * low_bits // 64) + 2, _U)
        if low_bits:
            at = np.arange(size) * low_bits
            v = values.astype(_U) & _U((1 << low_bits) - 1)
            cell, shift = at >> 6, (at & 63).astype(_U)
            # values of one cell lie side by side, so each cell is one or-reduction
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            low[cell[first]] |= np.bitwise_or.reduceat(v << shift, first)
            over = shift + _U(low_bits) > _U(64)
            low[cell[over] + 1] |= v[over] >> (_U(64) - shift[over])
        return cls(size, low_bits, low, high, ones)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of the unary part."""
        counts = self.ones if ones else self.zeros
        block = np.searchsorted(counts, k, "right") - 1
        cells = self.high.reshape(-1, BLOCK)[block]
        if not ones:
            cells = ~cells
        upto = np.cumsum(np.bitwise_count(cells), axis=1, dtype=np.int64)
        left = k - counts[block]
        which = (upto <= left[:, None]).sum(axis=1)
        row = np.arange(len(k))
        left = left - np.where(which > 0, upto[row, which - 1], 0)
        octets = cells[row, which].view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int64)
        octet = (upto <= left[:, None]).sum(axis=1)
        left = left - np.where(octet > 0, upto[row, octet - 1], 0)
        return ((block * BLOCK + which) << 6) + (octet << 3) + _IN_BYTE[octets[row, octet], left]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        cell, shift = at >> 6, (at & 63).astype(_U)
        v = self.low[cell] >> shift
        v |= (self.low[cell + 1] << (_U(63) - shift)) << _ONE
        return (v & _U((1 << self.low_bits) - 1)).astype(np.int64)

    @_chunked
    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        return ((self._select(i, True) - i) << self.low_bits) | self._lows(i)

    @_chunked
    def successor(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place in [start, end) whose value is at least x, or ``end``."""
        high, low = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        zeros = len(self.high) * 64 - self.size
        # values whose high part is below, and at most, that of x
        first = np.where(high > 0, self._select(np.clip(high - 1, 0, zeros - 1), False) - high + 1, 0)
        last = self._select(np.clip(high, 0, zeros - 1), False) - high
        far = high >= zeros
        first, last = np.where(far, self.size, first), np.where(far, self.size, last)
        a, b = np.maximum(first, start), np.minimum(last, end)
        on = np.flatnonzero(a < b)
        while len(on):
            mid = (a[on] + b[on]) >> 1
            less = self._lows(mid) < low[on]
            a[on] = np.where(less, mid + 1, a[on])
            b[on] = np.where(less, b[on], mid)
            on = on[a[on] < b[on]]
        return np.minimum(np.maximum(a, start), end)

    def parts(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones}


class Trie:
    """Levels of an n-gram trie. Level k holds, context by context, the last words of all k-grams as one monotone
    sequence: each context's words are raised by a base, one more than the last value before. ``pointers`` say
    where the words of each context start. Every level has columns of small codes, one per gram."""

    def __init__(self, levels: list[tuple[Monotone, Monotone | None, dict[str, np.ndarray]]]):
        self.levels = levels

    @classmethod
    def of(cls, levels: list[tuple[np.ndarray, np.ndarray | None, dict[str, np.ndarray]]]) -> "Trie":
        """From (words, first word of each context and the end, columns) of each level; the first has no contexts."""
        made = []
        for words, starts, columns in levels:
            pointers = None
            if starts is not None:
                ends = starts[1:]
                last = words[ends - 1]  # no context is empty
                base = np.concatenate([[0], np.cumsum(last[:-1] + 1)]) if len(last) else np.zeros(0, np.int64)
                words = words + np.repeat(base, np.diff(starts))
                pointers = Monotone.of(starts)
            made.append((Monotone.of(words), pointers, columns))
        return cls(made)

    def find(self, level: int, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Place of each word below its context (a place of the level above), -1 if it isn't there."""
        values, pointers, _ = self.levels[level]
        if not values.size:
            return np.full(len(words), -1, np.int64)
        if pointers is None:
            start, end, base = np.zeros(len(words), np.int64), np.full(len(words), values.size), np.zeros(len(words), np.int64)
        else:
            known = np.maximum(context, 0)
            start, end = pointers.access(known), pointers.access(known + 1)
            base = np.where(start > 0, values.access(np.maximum(start - 1, 0)) + 1, 0)
            end = np.where(context < 0, start, end)
        at = values.successor(base + words, start, end)
        there = at < end
        hit = there & (values.access(np.where(there, at, 0)) == base + words)
        return np.where(hit, at, -1)

    def column(self, level: int, name: str, at: np.ndarray, missing: int) -> np.ndarray:
        held = self.levels[level][2][name]
        return np.where(at >= 0, held[np.maximum(at, 0)], held.dtype.type(missing)) if len(held) else np.full(len(at), missing, held.dtype)

    def save(self, path: str) -> None:
        """One file: a line of JSON that names the arrays, then the arrays."""
        head, arrays = [], []
        for values, pointers, columns in self.levels:
            entry = {"columns": {}}
            for name, m in (("values", values), ("pointers", pointers)):
                entry[name] = None if m is None else {"size": m.size, "low_bits": m.low_bits, "parts": {}}
                for part, array in (m.parts() if m is not None else {}).items():
                    entry[name]["parts"][part] = len(arrays)
                    arrays.append(array)
            for name, array in columns.items():
                entry["columns"][name] = len(arrays)
                arrays.append(array)
            head.append(entry)
        places, at = [], 0
        for array in arrays:
            places.append((at, len(array), array.dtype.str))
            at += -(-array.nbytes // 8) * 8
        line = json.dumps({"levels": head, "places": places}).encode()
        line += b" " * (-(len(line) + 1) % 8) + b"\n"
        with open(path, "wb") as f:
            f.write(line)
            for array in arrays:
                f.write(np.ascontiguousarray(array).tobytes())
                f.write(b"\0" * (-array.nbytes % 8))

    @classmethod
    def map(cls, path: str) -> "Trie":
        """The trie of a file, mapped into memory."""
        with open(path, "rb") as f:
            line = f.readline()
        head = json.loads(line)
        raw = np.memmap(path, np.uint8, "r", len(line)) if os.path.getsize(path) > len(line) else np.zeros(0, np.uint8)

        def array(k: int) -> np.ndarray:
            at, size, kind = head["places"][k]
            return raw[at : at + size * np.dtype(kind).itemsize].view(kind)

        def monotone(entry: dict | None) -> Monotone | None:
            return None if entry is None else Monotone(entry["size"], entry["low_bits"], *(array(entry["parts"][p]) for p in ("low", "high", "ones")))

        return cls([(monotone(e["values"]), monotone(e["pointers"]), {n: array(k) for n, k in e["columns"].items()}) for e in head["levels"]])

    def mapped(self) -> "Trie":
        """The same trie in a file of its own that goes when nothing maps it any more."""
        fd, path = tempfile.mkstemp(prefix="trie-")
        os.close(fd)
        try:
            self.save(path)
            return Trie.map(path)
        finally:
            os.unlink(path)
