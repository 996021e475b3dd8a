"""Plain measures of one pair of geometries: brute force for the batch measures and the relational validity."""

import numpy as np


class Geom:
    __slots__ = ("rings", "ring_part", "ring_pos", "kind")

    def __init__(self, xs, ys, ring_sizes, ring_part, ring_pos, kind="POLYGON"):
        xs = np.asarray(xs, dtype=float)
        ys = np.asarray(ys, dtype=float)
        cuts = np.cumsum(np.asarray(ring_sizes, dtype=int))[:-1] if len(ring_sizes) else []
        self.rings = [np.column_stack((x, y)) for x, y in zip(np.split(xs, cuts), np.split(ys, cuts))] if len(ring_sizes) else []
        self.ring_part = np.asarray(ring_part, dtype=int)
        self.ring_pos = np.asarray(ring_pos, dtype=int)
        self.kind = kind

    @property
    def polygonal(self) -> bool:
        return self.kind in ("POLYGON", "MULTIPOLYGON")

    def edges(self) -> np.ndarray:
        """(m, 4) array x1 y1 x2 y2 of every ring edge; a lone point is one zero-length edge."""
        segs = []
        for r in self.rings:
            if len(r) == 1:
                segs.append(np.hstack((r, r)))
            elif len(r) > 1:
                segs.append(np.hstack((r[:-1], r[1:])))
        return np.vstack(segs) if segs else np.zeros((0, 4))

    def empty(self) -> bool:
        return not self.rings or sum(len(r) for r in self.rings) == 0


def _orient(ax, ay, bx, by, cx, cy):
    return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _on_segment(ax, ay, bx, by, px, py):
    return (np.minimum(ax, bx) <= px) & (px <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= py) & (py <= np.maximum(ay, by))


def segments_intersect(e1: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Pairwise closed-segment intersection, shape (len(e1), len(e2))."""
    a = e1[:, None, :]
    b = e2[None, :, :]
    ax, ay, bx, by = a[..., 0], a[..., 1], a[..., 2], a[..., 3]
    cx, cy, dx, dy = b[..., 0], b[..., 1], b[..., 2], b[..., 3]
    o1 = _orient(ax, ay, bx, by, cx, cy)
    o2 = _orient(ax, ay, bx, by, dx, dy)
    o3 = _orient(cx, cy, dx, dy, ax, ay)
    o4 = _orient(cx, cy, dx, dy, bx, by)
    hit = (o1 != o2) & (o3 != o4) & (o1 * o2 <= 0) & (o3 * o4 <= 0)
    hit |= (o1 == 0) & _on_segment(ax, ay, bx, by, cx, cy)
    hit |= (o2 == 0) & _on_segment(ax, ay, bx, by, dx, dy)
    hit |= (o3 == 0) & _on_segment(cx, cy, dx, dy, ax, ay)
    hit |= (o4 == 0) & _on_segment(cx, cy, dx, dy, bx, by)
    return hit


def points_in_polygon(px: np.ndarray, py: np.ndarray, g: Geom) -> np.ndarray:
    """Even-odd test per part (holes included), interior only; boundary handled by callers."""
    inside = np.zeros(len(px), dtype=bool)
    if not g.polygonal:
        return inside
    for part in np.unique(g.ring_part):
        cnt = np.zeros(len(px), dtype=int)
        for r, rp in zip(g.rings, g.ring_part):
            if rp != part or len(r) < 2:
                continue
            x1, y1, x2, y2 = r[:-1, 0], r[:-1, 1], r[1:, 0], r[1:, 1]
            straddle = (y1[None, :] > py[:, None]) != (y2[None, :] > py[:, None])
            with np.errstate(divide="ignore", invalid="ignore"):
                xc = (x2 - x1)[None, :] * (py[:, None] - y1[None, :]) / (y2 - y1)[None, :] + x1[None, :]
            cnt += np.sum(straddle & (px[:, None] < xc), axis=1)
        inside |= cnt % 2 == 1
    return inside


def intersects(a: Geom, b: Geom) -> bool:
    """GE8: any shared point, boundary contact included."""
    if a.empty() or b.empty():
        return False
    ea, eb = a.edges(), b.edges()
    if segments_intersect(ea, eb).any():
        return True
    fa = np.array([r[0] for r in a.rings])
    fb = np.array([r[0] for r in b.rings])
    return bool(points_in_polygon(fa[:, 0], fa[:, 1], b).any() or points_in_polygon(fb[:, 0], fb[:, 1], a).any())


def _point_seg(px, py, x1, y1, x2, y2):
    """Closest point on each segment to each point (broadcast) and squared distance."""
    dx, dy = x2 - x1, y2 - y1
    ll = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(ll > 0, ((px - x1) * dx + (py - y1) * dy) / ll, 0.0)
    t = np.clip(t, 0.0, 1.0)
    qx, qy = x1 + t * dx, y1 + t * dy
    return qx, qy, (px - qx) ** 2 + (py - qy) ** 2


def nearest_points(a: Geom, b: Geom):
    """GE9: closest pair (planar, coordinate units) between the boundaries of a and b.
    Ties (within 1e-12 relative) go to the lowest (a.y, a.x, b.y, b.x); returns (ax, ay, bx, by)."""
    ea, eb = a.edges(), b.edges()
    if len(ea) == 0 or len(eb) == 0:
        return None
    A = ea[:, None, :]
    B = eb[None, :, :]
    cands = []
    # endpoints of a onto segments of b
    for k in (0, 2):
        qx, qy, d = _point_seg(A[..., k], A[..., k + 1], B[..., 0], B[..., 1], B[..., 2], B[..., 3])
        cands.append((d, np.broadcast_to(A[..., k], d.shape), np.broadcast_to(A[..., k + 1], d.shape), qx, qy))
    # endpoints of b onto segments of a
    for k in (0, 2):
        qx, qy, d = _point_seg(B[..., k], B[..., k + 1], A[..., 0], A[..., 1], A[..., 2], A[..., 3])
        cands.append((d, qx, qy, np.broadcast_to(B[..., k], d.shape), np.broadcast_to(B[..., k + 1], d.shape)))
    d = np.stack([c[0] for c in cands], axis=-1).reshape(-1)
    pax = np.stack([np.broadcast_to(c[1], c[0].shape) for c in cands], axis=-1).reshape(-1)
    pay = np.stack([np.broadcast_to(c[2], c[0].shape) for c in cands], axis=-1).reshape(-1)
    pbx = np.stack([np.broadcast_to(c[3], c[0].shape) for c in cands], axis=-1).reshape(-1)
    pby = np.stack([np.broadcast_to(c[4], c[0].shape) for c in cands], axis=-1).reshape(-1)
    m = d.min()
    tie = np.nonzero(d <= m + m * 1e-12)[0]
    # equal distances: lowest (a.y, a.x, b.y, b.x) wins, a canonical pick along parallel edges
    k = tie[np.lexsort((pbx[tie], pby[tie], pax[tie], pay[tie]))[0]]
    return float(pax[k]), float(pay[k]), float(pbx[k]), float(pby[k])


def _ring_area2(r: np.ndarray) -> float:
    x, y = r[:, 0], r[:, 1]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]))


def area(g: Geom) -> float:
    """GE15: shells minus holes, summed over parts."""
    if not g.polygonal:
        return 0.0
    tot = 0.0
    for r, pos in zip(g.rings, g.ring_pos):
        a = abs(_ring_area2(r)) / 2.0
        tot += a if pos == 0 else -a
    return tot


#: Entries of the largest array of a step.
STEP = 1 << 20


def _crossing_xs(ea: np.ndarray, eb: np.ndarray) -> np.ndarray:
    """x of proper crossings between edges of a and edges of b, some edges of a at a time."""
    if len(ea) == 0 or len(eb) == 0:
        return np.zeros(0)
    rows = max(1, STEP // len(eb))
    return np.concatenate([_crossing_step(ea[i:i + rows], eb) for i in range(0, len(ea), rows)])


def _crossing_step(ea: np.ndarray, eb: np.ndarray) -> np.ndarray:
    a = ea[:, None, :]
    b = eb[None, :, :]
    x1, y1, x2, y2 = a[..., 0], a[..., 1], a[..., 2], a[..., 3]
    x3, y3, x4, y4 = b[..., 0], b[..., 1], b[..., 2], b[..., 3]
    den = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((x1 - x3) * (y3 - y4) - (y1 - y3) * (x3 - x4)) / den
        u = ((x1 - x3) * (y1 - y2) - (y1 - y3) * (x1 - x2)) / den
    ok = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    with np.errstate(invalid="ignore"):
        return (x1 + t * (x2 - x1))[ok]


def _intervals_at(e: np.ndarray, xm: np.ndarray):
    """y crossings of non-vertical edges with vertical lines x = xm, sorted per line (NaN padded)."""
    x1, y1, x2, y2 = e[:, 0], e[:, 1], e[:, 2], e[:, 3]
    lo, hi = np.minimum(x1, x2), np.maximum(x1, x2)
    m = (lo[None, :] < xm[:, None]) & (xm[:, None] < hi[None, :])
    with np.errstate(divide="ignore", invalid="ignore"):
        yc = y1[None, :] + (xm[:, None] - x1[None, :]) * (y2 - y1)[None, :] / (x2 - x1)[None, :]
    yc = np.where(m, yc, np.nan)
    return np.sort(yc, axis=1)[:, :int(m.sum(axis=1).max(initial=0))]  # NaN last: only columns with a crossing


def _interval_overlap(ya: np.ndarray, yb: np.ndarray) -> np.ndarray:
    """Per line: length of the intersection of the even-odd intervals of ya and yb."""
    a0, a1 = ya[:, 0::2], ya[:, 1::2]
    b0, b1 = yb[:, 0::2], yb[:, 1::2]
    n = min(a0.shape[1], a1.shape[1])
    m = min(b0.shape[1], b1.shape[1])
    a0, a1, b0, b1 = a0[:, :n], a1[:, :n], b0[:, :m], b1[:, :m]
    ov = np.minimum(a1[:, :, None], b1[:, None, :]) - np.maximum(a0[:, :, None], b0[:, None, :])
    ov = np.where(np.isnan(ov), 0.0, np.maximum(ov, 0.0))
    return ov.sum(axis=(1, 2))


def overlap_area(a: Geom, b: Geom) -> float:
    """GE14: area of a intersect b by vertical slabs.  Between consecutive vertex and
    crossing x's no edges cross, so the common length is linear in x and the
    midpoint rule is exact.  Holes and multi-parts follow the even-odd rule."""
    if a.empty() or b.empty() or not a.polygonal or not b.polygonal:
        return 0.0
    ea, eb = a.edges(), b.edges()
    lo = max(ea[:, [0, 2]].min(), eb[:, [0, 2]].min())
    hi = min(ea[:, [0, 2]].max(), eb[:, [0, 2]].max())
    if hi <= lo:
        return 0.0
    xs = np.concatenate((ea[:, 0], eb[:, 0], _crossing_xs(ea, eb)))
    xs = np.unique(xs[(xs >= lo) & (xs <= hi)])
    xs = np.unique(np.concatenate(([lo, hi], xs)))
    w = np.diff(xs)
    xm = (xs[:-1] + xs[1:]) / 2
    total = 0.0
    lines = max(1, STEP // max(len(ea), len(eb)))
    for s in range(0, len(xm), lines):
        sl = slice(s, s + lines)
        total += float(np.sum(w[sl] * _interval_overlap(_intervals_at(ea, xm[sl]), _intervals_at(eb, xm[sl]))))
    return total


