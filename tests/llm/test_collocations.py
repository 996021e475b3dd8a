import random
import re
from collections import Counter

import pytest
from cases import docs, empty

from riskgrid.llm import collocations as co
from riskgrid.llm.common import prepare
from riskgrid.llm.queries import REGISTRY

SCHEMA = "text string, lang string, phrase string, a long, left string, n int"


def brute(rows, max_words, least, absorb, top):
    counts, n = {}, Counter()
    for text, lang in rows:
        f = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n["und" if lang is None else lang] += len(w)
            for m in range(1, max_words + 1):
                f.update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and 100 * b >= absorb * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in found.items())
            score, k = min((co.SCALE * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def text_rows(seed=1, n=150, hot=0.4):
    rng = random.Random(seed)
    words = ["the", "The", "a", "b", "new", "york", "city", "é", "中", "b c", " ", "x\x1cy"]
    rows = []
    for i in range(n):
        w = [("hot" if rng.random() < hot else rng.choice(words)) + rng.choice([" ", " ", "  ", "\t ", ", ", ".\n"]) for _ in range(rng.randrange(0, 60))]
        rows.append(("".join(w), rng.choice(["en", "de", None, ""])))
    rows += [(None, "en"), ("", None), ("   ", "en"), (".,;", "xx"), ("one", "yy"), ("long run " * 5000, "en")]
    return rows + rows[:5]


@pytest.mark.parametrize(("max_words", "least", "absorb", "top", "chunk", "bits"), [
    (3, 10, 50, 2000, 1 << 20, 27), (3, 2, 70, 15, 500, 27), (4, 3, 50, 2000, 1 << 20, 6), (2, 1, 50, 40, 2000, 10)])
def test_against_brute_force(spark, monkeypatch, max_words, least, absorb, top, chunk, bits):
    """Also in small chunks, and with a bitmap that is nearly full."""
    prepare(spark)
    monkeypatch.setattr(co, "CHUNK", chunk)
    monkeypatch.setattr(co._frequent, "__defaults__", (bits,))
    rows = text_rows()
    d = spark.createDataFrame([(t, lang, "x", 1, "y", 2) for t, lang in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, co.mine(d, max_words, least, absorb, top).collect()))
    want = brute(rows, max_words, least, absorb, top)
    assert len(want) > 10
    assert got == want


def test_open_phrases_over_many_partitions(spark):
    """With more partitions than phrases, nearly every part of a phrase lies in a partition before it."""
    prepare(spark)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "150")
        rows = text_rows(3, 40, 0.8)
        d = spark.createDataFrame([(t, lang, "x", 1, "y", 2) for t, lang in rows], SCHEMA)
        assert sorted(map(tuple, co.mine(d, 3, 2).collect())) == brute(rows, 3, 2, 50, 2000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_products_past_64_bits(spark):
    prepare(spark)
    a = 3_000_000_000
    none = "cast(null as array<long>)"
    counts = spark.sql(f"""select 'en' lang, p phrase, c a
                           from values ('u', {a}L), ('v', {a + 7}L), ('u v', {a - 5}L), ('', {2 * a + 7}L) t(p, c)""")
    stream = counts.where("phrase <> ''").selectExpr("lang", "phrase", "a", "0L ext", f"{none} left", f"{none} right")
    rows = {r["phrase"]: r for r in co._pass(co._pass(stream, "right", 3, 3), "left", 3, 3).collect()}
    assert (rows["u v"]["left"], rows["u v"]["right"]) == ([a], [a + 7]) and rows["u"]["ext"] == rows["v"]["ext"] == a - 5
    real, co.phrase_counts = co.phrase_counts, lambda docs, m, least: counts
    try:
        got = co.mine(counts).collect()
    finally:
        co.phrase_counts = real
    assert [tuple(r) for r in got] == [("en", 1, "u v", a - 5, a, a + 7, 2 * a + 7, 10**6 * (a - 5) ** 2 // (a * (a + 7)))]


def test_query_and_empty(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, REGISTRY["op13_collocations"][0](spark, str(tmp_path)).collect()))
    assert got == brute([(r["text"], r["lang"]) for r in docs(spark).collect()], 3, 10, 50, 2000) != []
    assert co.mine(empty(spark)).count() == 0
