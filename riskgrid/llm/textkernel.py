"""Vectorised word and line hashing over the UTF-8 bytes of a batch of texts.

Texts stay in their Arrow buffer; words (``[^\\x20\\x09-\\x0D]+``), lines and word windows are
found and hashed with array operations for all texts of a chunk at once.  Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240607)
#: A random number for each byte value (byte values 0 to 255).
BYTE_CODES = _RNG.integers(1, MASK, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII but letters and digits: the separators of plain words.
IS_MARK = np.ones(256, bool)
IS_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        tables = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


class ByteHashes:
    """Hashes of any byte ranges of ``data``."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power_tables(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * power[:len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array without nulls."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """The words of all texts: ``start``, ``end`` (byte positions), ``doc``, ``hash``; ``first`` and
    ``count`` by text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False, apart: np.ndarray = IS_SPACE):
        n = len(data)
        if fold:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        inside = ~apart[data]
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edge = offsets[:-1][(offsets[:-1] < n) & (np.diff(offsets) > 0)]
        begin[edge] = inside[edge]
        edge = edge[edge > 0] - 1
        stop[edge] = inside[edge]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.bytes = ByteHashes(data)
        self.hash = self.bytes.of(self.start, self.end)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of ``k`` words that lies inside one text, and the index of its first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h *= np.uint64(BASE)
            h += self.hash[j:j + n]
        return mixed(h[at]), at

    def shingles(self, k: int) -> list[np.ndarray]:
        """By text: the sorted distinct ``k``-word shingles; with fewer words, the whole sequence as one."""
        h, at = self.windows(k)
        cuts = np.searchsorted(at, self.first)
        out = []
        for d in range(len(self.count)):
            own = h[cuts[d]:cuts[d + 1]]
            if 0 < self.count[d] < k:
                x = np.full(1, self.count[d], np.uint64)
                for w in self.hash[self.first[d]:self.first[d + 1]]:
                    x = x * np.uint64(BASE) + w
                own = mixed(x)
            out.append(np.unique(own))
        return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the values that occur at least twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
