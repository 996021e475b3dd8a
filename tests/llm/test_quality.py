import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import docs, empty, texts

from riskgrid.llm import quality
from riskgrid.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    win = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = set()
    for i in range(len(w) - 4):
        if win[tuple(w[i:i + 5])] > 1:
            cover |= set(range(i, i + 5))
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_lines": len(lines),
            "n_distinct": len(set(w)), "n_exclaim": text.count("!")}


def test_features_equal_brute_force():
    for seed in range(4):
        t = texts(seed)
        got = quality.features(pa.array([x or "" for x in t]))
        for i, x in enumerate(t):
            for k, v in brute(x).items():
                assert got[k][i] == v, (k, x[:60] if x else x)


def test_em_finds_the_bad_group():
    rng = np.random.default_rng(1)
    bad = rng.random(4000) < 0.15
    votes = np.where(rng.random((4000, 5)) < 0.3, 0, np.where(rng.random((4000, 5)) < np.where(bad, 0.8, 0.05)[:, None], -1, 1))
    pat, n = np.unique(votes, axis=0, return_counts=True)
    share, drop = quality.estimate(pat, n.astype(float))
    assert share == pytest.approx(0.85, abs=0.03)
    assert np.allclose(drop[1], 0.8, atol=0.08) and np.allclose(drop[0], 0.05, atol=0.03)


def test_judge_on_awkward_rows(spark):
    prepare(spark)
    d = docs(spark)
    got = quality.judge(d)
    assert got.count() == d.count()
    for r in got.join(d.select("doc_id", "text"), "doc_id").collect():
        b = brute(r.text)
        assert r.base_failed == (b["n_words"] < 10 or 100 * b["n_repeat_words"] > 20 * b["n_words"])
        assert not (r.kept and r.base_failed)
    kept = quality.keep_good(d)
    assert kept.columns == d.columns and kept.count() == got.where("kept").count()
    assert quality.judge(empty(spark)).count() == 0 and quality.keep_good(empty(spark)).count() == 0
