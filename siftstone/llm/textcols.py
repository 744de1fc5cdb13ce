"""Texts of an Arrow batch as one byte array: words, their hashes and hashes of word sequences, without a Python object per word.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits wide and stand for what they are
taken of; two different values agree with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Bytes that are worked on at a time: temporary arrays stay near the processor's caches. A longer text is a slice of its own.
SLICE = 1 << 19

_BYTE = U(0x9E3779B97F4A7C15)  # odd multipliers of the polynomials over bytes and over words
_WORD = U(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every output bit depends on every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * U(0xA0761D6478BD642F))


class _Powers:
    """Powers of an odd number modulo 2**64, and of its inverse, as far as they were asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[U(1), np.full(size, self.base)])
                self.down = np.cumprod(np.r_[U(1), np.full(size, self.inverse)])
        return self.up, self.down


_bytes, _words = _Powers(_BYTE), _Powers(_WORD)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: empty), and where each begins and the last ends."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the number of words before each text and in all. inside: bytes of words, by byte; else all but spaces."""
    ok = ~SPACE[data] if inside is None else inside[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = ok.copy(), ok.copy()
    first[1:] &= ~ok[:-1]
    last[:-1] &= ~ok[1:]
    begin, end = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]]
    first[begin] = ok[begin]
    last[end - 1] = ok[end - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_hashes(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that hashes any ranges of bytes, each from two differences."""
    up, down = _bytes.get(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])

    def of(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((sums[end] - sums[begin]) * down[begin])

    return of


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return byte_hashes(data)(starts, ends)


class Sequences:
    """Hashes of any ranges of words, each from two differences."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _words.get(len(hashes))
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.diff(np.r_[at, len(keys)])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several parts added up by key."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts, at)


class Lookup:
    """Positions of 64-bit keys in a fixed set of distinct keys: an open-addressed table with linear probing, built and read in whole arrays."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, dtype=np.uint64)
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.mask = (1 << self.bits) - 1
        self.at = np.full(self.mask + 1, -1, dtype=np.int32)
        self.keys = np.r_[keys, U(0)]
        todo = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        self.most = 0
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]
            lost = self.at[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & self.mask
            self.most += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 where it isn't in the set."""
        slot = self._slot(keys)
        found = self.at[slot]
        rest = np.flatnonzero((self.keys[found] != keys) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            found[rest] = self.at[slot[rest]]
            now = found[rest]
            rest = rest[(self.keys[now] != keys[rest]) & (now >= 0)]
        return found


def summed(values: np.ndarray, pointers: np.ndarray) -> np.ndarray:
    """Sums over values[pointers[i]:pointers[i+1]], 0 where the range is empty."""
    out = np.zeros(len(pointers) - 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(pointers[1:] > pointers[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, pointers[:-1][full])
    return out
