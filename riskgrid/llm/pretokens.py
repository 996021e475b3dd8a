"""The byte-level tokenizer's split of texts into pretokens, for a whole chunk at once.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``; the special token's
text is a piece of its own.  Merges never cross pretokens.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

from riskgrid.llm.textkernel import ByteHashes

OTHER, LETTER, NUMBER, SPACE = range(4)
#: White_Space of the Unicode standard.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.int8)
    for c in range(0x110000):
        out[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    out[SPACES] = SPACE
    return out


class Pretokens:
    """``start``, ``end`` (bytes), ``doc``, ``hash`` and ``special`` of all pretokens of a chunk; ``first`` by
    text.  ``data`` is valid UTF-8."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, special: bytes = b""):
        raw = data.tobytes()
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        at = np.concatenate(([0], np.cumsum(width)))        # byte offset of each character
        n = len(chars)
        cut = np.zeros(n + 1, bool)                          # nothing reaches over these
        cut[np.searchsorted(at, offsets)] = True
        marks = []
        if special and special in raw:
            k = raw.find(special)
            while k >= 0:
                d = np.searchsorted(offsets, k, side="right") - 1
                if k + len(special) <= offsets[d + 1]:
                    marks.append((np.searchsorted(at, k), np.searchsorted(at, k + len(special))))
                    k = raw.find(special, k + len(special))
                else:                                        # over the end of a text
                    k = raw.find(special, k + 1)
            for a, b in marks:
                cut[a] = cut[b] = True
        kind = classes()[chars]
        begin = np.ones(n + 1, bool)
        begin[1:n] = kind[1:] != kind[:-1]
        begin |= cut
        # a blank before a word belongs to it, any other space before one stands alone
        i = np.flatnonzero(begin[1:n] & ~cut[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
        begin[i - 1] = True
        begin[i] = chars[i - 1] != 32
        # contractions
        i = np.flatnonzero(begin[:n] & (chars == 39))
        if len(i):
            one = np.where((i + 1 < n) & ~cut[np.minimum(i + 1, n)], chars[np.minimum(i + 1, n - 1)], 0)
            two = np.where((one > 0) & (i + 2 < n) & ~cut[np.minimum(i + 2, n)], chars[np.minimum(i + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(i), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            begin[i[short | long] + 1] = False
            begin[i[short] + 2] = True
            begin[i[long] + 3] = True
        for a, b in marks:
            begin[a + 1:b] = False
            begin[a] = begin[b] = True
        where = np.flatnonzero(begin[:n])
        self.data = raw
        self.start = at[where]
        self.end = np.concatenate((self.start[1:], [len(raw)])) if len(where) else self.start
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.hash = ByteHashes(data).of(self.start, self.end)
        self.special = np.isin(where, [a for a, _ in marks]) if marks else np.zeros(len(where), bool)
        self.hash[self.special] = 0

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes, a position of each, and the distinct index of every pretoken."""
        return np.unique(self.hash, return_index=True, return_inverse=True)


def flattened(distinct: list, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pretokens in order (``distinct`` ids by ``index``), and where each pretoken ends."""
    sizes = np.array([len(x) for x in distinct], np.int64)
    ids = np.fromiter((i for x in distinct for i in x), np.int32, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    ends = np.cumsum(sizes[index])
    step = np.repeat(first[index] - (ends - sizes[index]), sizes[index])
    return ids[step + np.arange(len(step))], np.concatenate(([0], ends))


def vocabulary(path: str) -> dict:
    """``model`` and added tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {"vocab": spec["model"]["vocab"], "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" "))
                                                         for m in spec["model"]["merges"]],
            "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


@functools.cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 characters for themselves, the
    others in order from code point 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def token_bytes(token: str) -> bytes:
    return bytes(byte_letters()[c] for c in token)
