import hashlib
import random
import re

import pytest
from cases import SCHEMA, docs, empty, rows

from riskgrid.llm import suffix_dedup
from riskgrid.llm.common import prepare

SPAN = suffix_dedup.CONTRACT.bytes


def brute(texts, SPAN=SPAN, least_words=0):
    """(n_bytes, n_removed, n_spans, kept) by text."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - SPAN + 1):
            seen[r[i:i + SPAN]] = seen.get(r[i:i + SPAN], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - SPAN + 1):
            if seen[r[i:i + SPAN]] > 1:
                gone[i:i + SPAN] = b"\1" * SPAN
        for run in list(re.finditer(b"\1+", bytes(gone))) if least_words else []:
            if len(r[run.start():run.end()].split()) < least_words:
                gone[run.start():run.end()] = bytes(run.end() - run.start())
        out.append((len(r), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]),
                    bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def planted(seed):
    """A passage in very many surroundings, copies, repeats inside a text, passages at the edge of the span."""
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abcdé ñ\n") for _ in range(n))

    passage, edge = noise(700), noise(SPAN).encode()[:SPAN].decode("utf-8", "ignore")
    out = [noise(rng.randrange(0, 500)) + passage[rng.randrange(100):700 - rng.randrange(100)] + noise(rng.randrange(0, 300))
           for _ in range(40)]
    inner = noise(450)
    out += [inner + noise(20) + inner, "x" * 1500, "xy" * 600, edge + "1", "2" + edge, edge[:-3], passage, passage]
    return out


@pytest.mark.parametrize("hot", [2000, 5])
def test_equals_brute_force(spark, monkeypatch, hot):
    prepare(spark)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = planted(hot)
    d = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    want = brute(texts)
    got = {r.doc_id: r for r in suffix_dedup.removed(d).collect()}
    for i, (n, gone, spans, kept) in enumerate(want):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_awkward_rows(spark):
    d = docs(spark)
    texts = [r[1] for r in rows()]
    want = sorted((r[0] if r[0] is not None else -1, *b[:3], hashlib.sha256(b[3]).hexdigest())
                  for r, b in zip(rows(), brute(texts), strict=True))
    got = suffix_dedup.removed(d).collect()
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got) == want
    kept = suffix_dedup.without_repeats(d)
    assert kept.schema == d.schema and kept.count() == d.count()
    by_text = {t: b[3].decode("utf-8", "ignore") for t, b in zip(texts, brute(texts), strict=True)}
    assert sorted(map(str, ((r.doc_id, r.text, r.lang) for r in kept.collect()))) == sorted(
        map(str, ((r[0], None if r[1] is None else by_text[r[1]], r[2]) for r in rows())))
    assert suffix_dedup.removed(empty(spark)).count() == 0


@pytest.mark.parametrize(("hot", "hot_bytes"), [(2000, 1 << 19), (5, 1 << 19), (2000, 3000)])
def test_shorter_spans(spark, monkeypatch, hot, hot_bytes):
    prepare(spark)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot_bytes)
    texts = planted(7)
    d = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    for least in (0, 60):
        got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(d, suffix_dedup.PASSAGE, least).collect()}
        assert got == {i: b[3].decode("utf-8", "ignore") for i, b in enumerate(brute(texts, suffix_dedup.PASSAGE.bytes, least))}
