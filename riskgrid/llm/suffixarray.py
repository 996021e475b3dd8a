"""Suffix arrays of byte shards by induced sorting, and their permuted common prefixes.

The bytes level induces one bucket at a time with array operations; the recursion on the names of
leftmost-smaller (LMS) substrings, whose alphabet is large, induces entry by entry.
"""

from __future__ import annotations

from array import array

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller (S) than the next one; the last symbol is the unique least one."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])            # a run of equal symbols has the type of its end
    at = np.searchsorted(differs, np.arange(n - 1))
    end = differs[np.minimum(at, len(differs) - 1)]
    smaller = np.ones(n, bool)
    smaller[:-1] = s[end] < s[end + 1]
    return smaller


def _place(sa: np.ndarray, fill: np.ndarray, symbols: np.ndarray, entries: np.ndarray, step: int) -> None:
    """Append ``entries`` in order to their symbols' buckets, forwards (step 1) or backwards (-1)."""
    order = np.argsort(symbols, kind="stable")
    t = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    size = np.diff(np.concatenate((first, [len(t)])))
    nth = np.arange(len(t)) - np.repeat(first, size)
    sa[fill[t] + step * nth] = entries[order]
    fill[t[first]] += step * size


def _induce(s: np.ndarray, smaller: np.ndarray, counts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes that the order of the LMS suffixes ``seeds`` induces."""
    n = len(s)
    ends = np.cumsum(counts)
    heads = ends - counts
    sa = np.full(n, -1, np.int32)
    fill = ends - 1
    _place(sa, fill, s[seeds[::-1]], seeds[::-1], -1)
    seeded = fill + 1                                      # where each bucket's LMS entries begin
    fill = heads.copy()
    used = np.flatnonzero(counts)
    for c in used:                                         # larger (L) suffixes, smallest bucket first
        at = heads[c]
        while at < fill[c]:
            wave, at = sa[at:fill[c]], fill[c]
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                _place(sa, fill, s[before], before, 1)
        wave = sa[seeded[c]:ends[c]]
        before = wave[wave > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            _place(sa, fill, s[before], before, 1)
    larger_end = fill
    fill = ends - 1
    for c in used[::-1]:                                   # smaller (S) suffixes, largest bucket first
        at = ends[c] - 1
        while at > fill[c]:
            wave, at = sa[fill[c] + 1:at + 1][::-1], fill[c]
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            if len(before):
                _place(sa, fill, s[before], before, -1)
        wave = sa[heads[c]:larger_end[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _place(sa, fill, s[before], before, -1)
    sa[0] = n - 1
    return sa


def _induce_names(s: array, smaller: bytes, ends: list, heads: list, seeds: list) -> array:
    """The same entry by entry."""
    n = len(s)
    sa = array("i", [-1]) * n
    fill = [e - 1 for e in ends]
    for i in reversed(seeds):
        c = s[i]
        sa[fill[c]] = i
        fill[c] -= 1
    fill = heads[:]
    for i in sa:
        if i > 0 and not smaller[i - 1]:
            c = s[i - 1]
            sa[fill[c]] = i - 1
            fill[c] += 1
    fill = [e - 1 for e in ends]
    for k in range(n - 1, -1, -1):
        i = sa[k]
        if i > 0 and smaller[i - 1]:
            c = s[i - 1]
            sa[fill[c]] = i - 1
            fill[c] -= 1
    sa[0] = n - 1
    return sa


def _named(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings (equal substrings get equal names) in text order, and their number;
    ``order`` has the LMS positions sorted by substring."""
    where = np.full(len(s), -1, np.int32)
    where[lms] = np.arange(len(lms))
    nxt = np.concatenate((lms[1:], [len(s) - 1]))
    length = (nxt - lms + 1)[where[order]]
    a, b = order[:-1], order[1:]
    same = length[:-1] == length[1:]
    live = np.flatnonzero(same)
    step = 0
    while len(live):                                       # compare substrings of one length symbol by symbol
        live = live[length[live] > step]
        equal = s[a[live] + step] == s[b[live] + step]
        same[live[~equal]] = False
        live = live[equal]
        step += 1
    names = np.empty(len(lms), np.int32)
    names[where[order]] = np.concatenate(([0], np.cumsum(~same)))
    return names, int(names.max()) + 1


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array of ``s``, integers below ``alphabet`` that end in a unique least one."""
    if len(s) < 3:
        return np.arange(len(s))[::-1].copy()
    smaller = _types(s)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    counts = np.bincount(s, minlength=alphabet)
    by_bucket = alphabet <= 1024
    if by_bucket:
        def induce(seeds):
            return _induce(s, smaller, counts, seeds)
    else:
        ends = np.cumsum(counts)
        args = array("i", s.astype(np.int32).tobytes()), smaller.tobytes(), ends.tolist(), (ends - counts).tolist()

        def induce(seeds):
            return np.frombuffer(_induce_names(*args, seeds.tolist()), np.int32)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    rough = induce(lms[np.argsort(s[lms], kind="stable")])
    order = rough[is_lms[rough]]
    names, distinct = _named(s, lms, order)
    if distinct < len(lms):
        order = lms[suffix_array(names, distinct)]
    return induce(order)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """``plcp, phi`` in text order: the common prefix (up to about ``limit``) of each suffix with its predecessor ``phi`` in
    ``sa`` (-1: none).  A suffix whose left neighbour equals its predecessor's has one less than the
    suffix to its left; only the others are compared."""
    n = len(s)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=np.int32)
    own = phi >= 0
    reducible = own.copy()
    reducible[0] = False
    k = np.flatnonzero(reducible)
    reducible[k] = (phi[k] > 0) & (s[k - 1] == s[phi[k] - 1])
    plcp = np.zeros(n, np.int32)
    padded = np.concatenate((s, np.zeros(4, s.dtype))).astype(np.uint64)
    word = padded[:n] | padded[1:n + 1] << np.uint64(16) | padded[2:n + 2] << np.uint64(32) | padded[3:n + 3] << np.uint64(48)
    word = np.concatenate((word, np.zeros(4, np.uint64)))
    live = np.flatnonzero(own & ~reducible)
    while len(live):
        x = word[np.minimum(live + plcp[live], n)] ^ word[np.minimum(phi[live] + plcp[live], n)]
        equal = np.where(x == 0, 4, np.where(x & np.uint64(0xFFFFFFFFFFFF) == 0, 3,
                         np.where(x & np.uint64(0xFFFFFFFF) == 0, 2, np.where(x & np.uint64(0xFFFF) == 0, 1, 0))))
        plcp[live] += equal
        live = live[(equal == 4) & (plcp[live] < limit + n)]
    # fall by one from the last compared suffix
    del word
    last = np.maximum.accumulate(np.where(~reducible, at, 0))
    plcp = np.where(reducible, plcp[last] - (at - last), plcp)
    return np.minimum(np.maximum(plcp, 0), n - at), phi


def repeats(pieces: list[bytes], span: int) -> list[np.ndarray]:
    """By piece: which of its starting positions have a string of ``span`` bytes that also starts
    elsewhere in any piece."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    s = raw.astype(np.uint16) + np.uint16(2)
    s[first[1:] - 1] = 1                                   # ends of pieces; then the least symbol
    s = np.concatenate((s, np.zeros(1, np.uint16)))
    sa = suffix_array(s, 258)
    plcp, phi = permuted_lcp(s, sa, span)
    del sa
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    rest = np.concatenate((first[1:][owner] - 1 - np.arange(len(owner)), [0]))
    hit = np.flatnonzero((plcp >= span) & (rest >= span))
    hit = hit[rest[phi[hit]] >= span]
    found = np.zeros(len(s), bool)
    found[hit] = True
    found[phi[hit]] = True
    return [found[a:a + n] for a, n in zip(first, sizes, strict=False)]
