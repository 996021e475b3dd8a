"""Context-mixing range coder for token ids.

Ids are coded in blocks; each starts with a fresh model, so blocks are independent, and many are
coded at once, one step of all of them at a time (a *lane* is a block).  At each step

* order 2 and order 1 (hashed tables of the last two ids, or the last) predict an id each, with a confidence;
* the probability that the foremost prediction is right mixes three adaptive counters (confidence of
  order 2, confidence and agreement of order 1, recent hits) in the logistic domain with weights that
  learn from each error;
* next come order 1 where it differs, and order 0: the ids seen in the block, by slot; an id that is
  none of these is written in 16 bits (32 where a block has larger ids).

One interval of a 48-bit range coder codes which of the four it is, a second one the slot or id.  All
arithmetic is on integers, so that decoding repeats it exactly.

A block: ``MAGIC``, count of ids (u32), bytes of an id (u8), length (u32) and CRC-32 (u32) of the payload,
CRC-32 of the ids as little-endian u32 (u32), payload.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RGI1"
HEADER = struct.Struct("<4sIBIII")
BLOCK = 4096
SLOTS2, SLOTS1, SLOT_BITS = 2048, 1024, 10
SLOTS0 = 1 << SLOT_BITS
TOTAL_BITS = 16
TOTAL = 1 << TOTAL_BITS
TOP_BITS, BOTTOM = 32, 1 << 24
WORD = (1 << 48) - 1
FIRST, SECOND, SLOT, RAW = range(4)

_x = np.arange(4096)
#: ln(p / (1 - p)) in 1/256, and back to 12 bits.
STRETCH = np.clip(np.round(np.log((_x + 0.5) / (4095.5 - _x)) * 256), -2047, 2047).astype(np.int64)
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-(_x - 2048) / 256))), 1, 4095).astype(np.int64)


class Model:
    """The predictions of ``lanes`` blocks; the first ``m`` of them take a step."""

    def __init__(self, lanes: int):
        self.lanes, lane = lanes, np.arange(lanes)
        self.lane, self.base2, self.base1, self.base0 = lane, lane * SLOTS2, lane * SLOTS1, lane * SLOTS0
        self.id2, self.n2 = np.full(lanes * SLOTS2, -1, np.int64), np.zeros(lanes * SLOTS2, np.int8)
        self.id1, self.n1 = np.full(lanes * SLOTS1, -1, np.int64), np.zeros(lanes * SLOTS1, np.int8)
        self.id0 = np.full(lanes * SLOTS0, -1, np.int64)
        self.counters = [np.full(16 * lanes, 1 << 14, np.int64) for _ in range(3)]
        self.weights = [np.full(lanes, 1 << 15, np.int64) for _ in range(3)]
        self.second, self.in_slot = np.full(8 * lanes, 1 << 13, np.int64), np.full(lanes, 1 << 14, np.int64)
        self.before, self.last, self.hits = (np.zeros(lanes, np.int64) for _ in range(3))

    def predict(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Upper ends of the intervals of FIRST, SECOND and SLOT (RAW ends at ``TOTAL``)."""
        self.m = m
        lane, last = self.lane[:m], self.last[:m]
        self.i2 = self.base2[:m] + ((last * 0x9E3779B1 + self.before[:m] * 0x85EBCA77 >> 11) & (SLOTS2 - 1))
        self.i1 = self.base1[:m] + ((last * 0x9E3779B1 >> 9) & (SLOTS1 - 1))
        self.p2, self.p1 = self.id2[self.i2], self.id1[self.i1]
        self.c2, self.c1 = self.n2[self.i2], self.n1[self.i1]
        has2 = self.p2 >= 0
        self.one = np.where(has2, self.p2, self.p1)
        self.two = np.where(self.p1 != self.one, self.p1, -1)
        kinds = (self.c2 + 8 * has2, self.c1 + 8 * (self.p1 == self.p2), self.hits[:m] + 8 * has2)
        self.at = [k * self.lanes + lane for k in kinds]
        self.stretched = [STRETCH[c[i] >> 4] for c, i in zip(self.counters, self.at, strict=True)]
        mixed = sum(w[:m] * s for w, s in zip(self.weights, self.stretched, strict=True)) >> 16
        self.p = SQUASH[np.minimum(np.maximum(mixed, -2047), 2047) + 2048]
        first = np.where(self.one >= 0, self.p << 4, 0)
        self.at_second = self.c1.astype(np.int64) * self.lanes + lane
        second = first + np.where(self.two >= 0, (TOTAL - first) * self.second[self.at_second] >> 16, 0)
        return first, second, second + ((TOTAL - second) * self.in_slot[:m] >> 16)

    def slot_of(self, ids: np.ndarray) -> np.ndarray:
        return (ids * 0x9E3779B1 >> 12) & (SLOTS0 - 1)

    def learn(self, ids: np.ndarray, kind: np.ndarray) -> None:
        m = self.m
        hit = kind == FIRST
        told = self.one >= 0
        error = np.where(told, (hit << 12) - self.p, 0)
        for c, i, w, s in zip(self.counters, self.at, self.weights, self.stretched, strict=True):
            old = c[i]
            c[i] = np.where(told, old + ((hit.astype(np.int64) << 16) - old >> 4), old)
            w[:m] += s * error + (1 << 9) >> 10
        missed = ~hit
        asked = missed & (self.two >= 0)
        old = self.second[self.at_second]
        self.second[self.at_second] = np.where(asked, old + (((kind == SECOND).astype(np.int64) << 16) - old >> 4), old)
        asked = kind >= SLOT
        old = self.in_slot[:m]
        old += np.where(asked, ((kind == SLOT).astype(np.int64) << 16) - old >> 5, 0)
        for table, n, i, p, c in ((self.id2, self.n2, self.i2, self.p2, self.c2), (self.id1, self.n1, self.i1, self.p1, self.c1)):
            right = p == ids
            table[i] = np.where(right | (c <= 1), ids, p)
            n[i] = np.where(right, np.minimum(c + 1, 7), c >> 1)
        self.id0[self.base0[:m] + self.slot_of(ids)] = ids
        self.before[:m], self.last[:m] = self.last[:m], ids
        self.hits[:m] = (self.hits[:m] << 1 | hit) & 7


def _matrix(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids by step and lane, longest lane first; the order and the lengths in that order."""
    sizes = np.array([len(b) for b in blocks])
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros((int(sizes.max(initial=0)), len(blocks)), np.int64)
    for k, i in enumerate(order):
        out[:sizes[i], k] = blocks[i]
    return out, order, sizes[order]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids as the bytes of the file format."""
    blocks = [np.asarray(b, np.int64) for b in blocks]
    wide = [len(b) > 0 and int(b.max()) >= 1 << 16 for b in blocks]
    out = [b""] * len(blocks)
    for width in (2, 4):
        of = [i for i, w in enumerate(wide) if w == (width == 4)]
        if of:
            for i, payload in zip(of, _encode([blocks[i] for i in of], width), strict=True):
                ids = blocks[i].astype("<u4").tobytes()
                out[i] = HEADER.pack(MAGIC, len(blocks[i]), width, len(payload), zlib.crc32(payload), zlib.crc32(ids)) + payload
    return out


def _encode(blocks: list[np.ndarray], width: int) -> list[bytes]:
    ids, order, sizes = _matrix(blocks)
    lanes = len(blocks)
    model = Model(lanes)
    low, size = np.zeros(lanes, np.int64), np.full(lanes, WORD, np.int64)
    # 16 bits of output at a time; no step writes more than three digits and the raw ones
    written = np.zeros((lanes, len(ids) * 2 * (width + 1) // 2 + 64), np.uint16)
    at = np.zeros(lanes, np.int64)

    def put(lane, start, share, bits):
        step = size[lane] >> bits
        low[lane] += step * start
        size[lane] = step * share
        while True:
            a, b = low[lane], size[lane]
            settled = (a ^ (a + b)) >> TOP_BITS == 0
            go = settled | (b < BOTTOM)
            if not go.any():
                return
            if not go.all():
                lane, a, b, settled = lane[go], a[go], b[go], settled[go]
            written[lane, at[lane]] = a >> TOP_BITS
            at[lane] += 1
            b = np.where(settled, b, -a & (BOTTOM - 1))
            low[lane], size[lane] = (a << 16) & WORD, b << 16

    for t in range(len(ids)):
        m = int(np.searchsorted(-sizes, -t, side="left"))
        x = ids[t, :m]
        first, second, slot_end = model.predict(m)
        slot = model.slot_of(x)
        cached = (model.id0[model.base0[:m] + slot] == x) & (slot_end > second)
        kind = np.where(x == model.one, FIRST, np.where((x == model.two) & (second > first), SECOND,
                                                        np.where(cached, SLOT, RAW)))
        ends = np.stack((first, second, slot_end, np.full(m, TOTAL)))
        upper = ends[kind, np.arange(m)]
        lower = np.where(kind > 0, ends[kind - 1, np.arange(m)], 0)
        put(model.lane[:m], lower, upper - lower, TOTAL_BITS)
        k = np.flatnonzero(kind == SLOT)
        if len(k):
            put(k, slot[k], 1, SLOT_BITS)
        k = np.flatnonzero(kind == RAW)
        if len(k):
            if width == 4:
                put(k, x[k] >> 16, 1, 16)
            put(k, x[k] & 0xFFFF, 1, 16)
        model.learn(x, kind)
    out = [b""] * lanes
    for k, i in enumerate(order):
        tail = np.array([low[k] >> 32, (low[k] >> 16) & 0xFFFF, low[k] & 0xFFFF], np.uint16)
        out[i] = np.concatenate((written[k, :at[k]], tail)).astype("<u2").tobytes() if sizes[k] else b""
    return out


def split(data: bytes) -> list[bytes]:
    """The blocks of a concatenation."""
    out, at = [], 0
    while at < len(data):
        magic, _, _, length, _, _ = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("no block of ids here")
        out.append(data[at:at + HEADER.size + length])
        at += HEADER.size + length
    return out


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises where a checksum doesn't hold."""
    heads = [HEADER.unpack_from(b) for b in blocks]
    out = [np.zeros(0, np.int64)] * len(blocks)
    for width in (2, 4):
        of = [i for i, h in enumerate(heads) if h[2] == width]
        for i in of:
            if heads[i][0] != MAGIC or zlib.crc32(blocks[i][HEADER.size:]) != heads[i][4]:
                raise ValueError("a block of ids is damaged")
        if of:
            found = _decode([blocks[i][HEADER.size:] for i in of], [heads[i][1] for i in of], width)
            for i, ids in zip(of, found, strict=True):
                if zlib.crc32(ids.astype("<u4").tobytes()) != heads[i][5]:
                    raise ValueError("a block of ids doesn't decode to what was written")
                out[i] = ids
    return out


def _decode(payloads: list[bytes], counts: list[int], width: int) -> list[np.ndarray]:
    lanes = len(payloads)
    sizes = np.array(counts, np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    most = max(len(p) for p in payloads) // 2 + 4
    read = np.zeros((lanes, most), np.int64)
    for k, i in enumerate(order):
        digits = np.frombuffer(payloads[i], "<u2")
        read[k, :len(digits)] = digits
    low, size = np.zeros(lanes, np.int64), np.full(lanes, WORD, np.int64)
    code = read[:, 0] << 32 | read[:, 1] << 16 | read[:, 2]
    at = np.full(lanes, 3, np.int64)
    model = Model(lanes)
    out = np.zeros((int(sizes.max(initial=0)), lanes), np.int64)

    def take(lane, start, share, step):
        low[lane] += step * start
        size[lane] = step * share
        while True:
            a, b = low[lane], size[lane]
            settled = (a ^ (a + b)) >> TOP_BITS == 0
            go = settled | (b < BOTTOM)
            if not go.any():
                return
            if not go.all():
                lane, a, b, settled = lane[go], a[go], b[go], settled[go]
            b = np.where(settled, b, -a & (BOTTOM - 1))
            low[lane], size[lane] = (a << 16) & WORD, b << 16
            code[lane] = (code[lane] << 16) & WORD | read[lane, np.minimum(at[lane], most - 1)]
            at[lane] += 1

    def value(lane, bits):
        step = size[lane] >> bits
        return step, np.minimum((code[lane] - low[lane]) // step, (1 << bits) - 1)

    for t in range(len(out)):
        m = int(np.searchsorted(-sizes, -t, side="left"))
        first, second, slot_end = model.predict(m)
        lane = model.lane[:m]
        step, v = value(lane, TOTAL_BITS)
        kind = (v >= first).astype(np.int64) + (v >= second) + (v >= slot_end)
        ends = np.stack((first, second, slot_end, np.full(m, TOTAL)))
        upper = ends[kind, np.arange(m)]
        lower = np.where(kind > 0, ends[kind - 1, np.arange(m)], 0)
        take(lane, lower, upper - lower, step)
        x = np.where(kind == FIRST, model.one, model.two)
        k = np.flatnonzero(kind == SLOT)
        if len(k):
            step, v = value(k, SLOT_BITS)
            take(k, v, 1, step)
            x[k] = model.id0[model.base0[k] + v]
        k = np.flatnonzero(kind == RAW)
        if len(k):
            x[k] = 0
            for _ in range(width // 2):
                step, v = value(k, 16)
                take(k, v, 1, step)
                x[k] = x[k] << 16 | v
        out[t, :m] = x
        model.learn(x, kind)
    ids = [np.zeros(0, np.int64)] * lanes
    for k, i in enumerate(order):
        ids[i] = out[:sizes[k], k].copy()
    return ids
