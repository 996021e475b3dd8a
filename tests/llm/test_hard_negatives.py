import random

import numpy as np
import pytest

from riskgrid.llm import hard_negatives as hn
from riskgrid.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q int, label2 int"


def made(n=700, dims=12, seed=4, grain=0.25):
    """Coarse components, so that many scores tie."""
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = centre[rng.randrange(4)]
        rows.append((i, [round((x + rng.gauss(0, 0.6)) / grain) * grain for x in c], rng.randrange(4), "x", 1, 2))
    rows += [(7000, None, 1, "x", 1, 2), (7100, [1.0, None], 1, "x", 1, 2), (7200, [float("nan")] * dims, 1, "x", 1, 2),
             (7300, [float("inf")] * dims, 1, "x", 1, 2), (7400, [1.0] * dims, None, "x", 1, 2), (7500, [], 1, "x", 1, 2),
             (7600, [1.0, 2.0], 1, "x", 1, 2), (None, [1.0] * dims, 1, "x", 1, 2), (-100, [2.0] * dims, 3, "x", 1, 2)]
    return rows + [rows[5], rows[5], rows[100]]


def brute(rows, every):
    keep = [(r[0], np.floor(np.array(r[1], float) * 256).astype(int).tolist(), r[2]) for r in rows
            if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for ai, aq, al in keep:
        if ai % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(aq, q, strict=False)), i, label) for i, q, label in keep if i != ai)
        for s, p, _ in [x for x in scored if x[2] == al][:5]:
            fit = [(-t, i) for t, i, label in scored if label != al and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(ai, p, k + 1, i, -s, t) for k, (t, i) in enumerate(fit[:10])]
    return sorted(out)


def mined(spark, rows, every):
    d = spark.createDataFrame(rows, SCHEMA)
    got = hn.mine(hn.usable(d, "vec_id", "embedding", "label", 256), every)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize(("block", "group"), [(4096, 32_768), (37, 2)])
def test_against_brute_force(spark, monkeypatch, block, group):
    prepare(spark)
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "GROUP", group)
    rows = made()
    want = brute(rows, 20)
    assert len(want) > 500
    assert mined(spark, rows, 20) == want


def test_negative_scores_have_no_window(spark):
    prepare(spark)
    # the only other row of the label lies opposite the anchor
    rows = [(0, [1.0, 0.0], 1, "x", 1, 2), (1, [-1.0, 0.0], 1, "x", 1, 2), (2, [-0.5, 0.0], 2, "x", 1, 2)]
    assert mined(spark, rows, 100) == brute(rows, 100) == []


def test_empty_and_too_large(spark):
    prepare(spark)
    assert mined(spark, [], 100) == []
    with pytest.raises(Exception, match="62 bits"):
        mined(spark, [(0, [3e15], 1, "x", 1, 2), (1, [3e15], 1, "x", 1, 2)], 100)


def test_scan_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    q = rng.integers(-300, 300, (500, 40))
    parts = [{"block": 1, "n": 500, "data": np.arange(500).tobytes()}, {"block": 1, "n": 500, "data": np.zeros(500, int).tobytes()}]
    parts += [{"block": 1, "n": 500, "data": hn._narrow(c, c.min(), c.max()), "low": c.min(), "high": c.max()} for c in q.T]
    block, seen = hn.Block(parts), []
    anchor = np.concatenate((rng.integers(-3000, 3000, 6), rng.integers(-3, 3, 34)))

    def rule(lo, hi):
        seen.append(len(lo))
        return hi >= hn._kth(lo, 5)

    rows, score = block.scan(anchor, np.ones(500, bool), rule)
    assert (score == (q[rows] @ anchor)).all()
    assert set(np.argsort(-(q @ anchor))[:5]) <= set(rows.tolist()) and seen[-1] < 50
