import zlib

import pytest
from cases import SCHEMA, docs, empty, rows

from riskgrid.llm import mixing, sharding, url_filter
from riskgrid.llm.common import prepare

URLS = [None, "", "no scheme", "http://", "http://ORG/x", "https://a.example.org/es/1?q", "http://example.org/es",
        "http://example.org/en/12", "http://Example.ORG/en/2", "ftp://x.com/fr/", "http://x.com/de/a#b", "http://net/fr/",
        "http://a.b.c.d.e.f.example.org/en/1", "http://notexample.org/es/", "x://user@example.org/es/", "http://org./",
        "http://com/fr/?http://example.org/es/", "http://example.org:80/es/", "http://x.org?/es/", "://org/", "http://é.org/ß",
        "http://org/" + "x" * 5000, "a" * 3000 + "://" + "b." * 900 + "com/de/z"]


def judge_brute(url):
    head, sep, rest = (url or "").partition("://")
    host = ""
    path = ""
    if sep:
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, url_filter.DEFAULT_VERDICT))
    return host, path, best[1], best[2]


def test_urls_equal_brute_force(spark):
    prepare(spark)
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[4:6])], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect()}
    assert got == {i: judge_brute(u) for i, u in enumerate(URLS + URLS[4:6])}
    none = url_filter.judge(pages.limit(0), url_filter.rule_table(spark))
    assert none.count() == 0 and none.columns == ["page_id", "host", "path", "rule", "verdict"]
    no_rules = url_filter.judge(pages, url_filter.rule_table(spark).limit(0))
    assert no_rules.where("rule is not null or verdict <> 'allow'").count() == 0 and no_rules.count() == pages.count()


def test_plans_have_no_python(spark):
    prepare(spark)
    d = "/root/testdata/sf0.001"
    for query in (url_filter.query, sharding.query, mixing.query):
        plan = query(spark, d)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_shards_equal_brute_force(spark):
    d = docs(spark)
    got = sharding.shard_by_bytes(d).collect()
    own = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows()),
                 key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    total, before, want, slots = sum(r[1] for r in own), 0, [], {}
    for r in own:
        shard = before * 40 // total
        slots[shard] = slots.get(shard, -1) + 1
        want.append((*r, shard, slots[shard]))
        before += r[1]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sharding.shard_by_bytes(empty(spark)).count() == 0


def test_mixture(spark):
    d = docs(spark)
    tokens = {}
    for r in d.collect():
        tokens[r.source] = tokens.get(r.source, 0) + len(__import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    total = sum(tokens.values())
    for options, most in (({"max_repeats": 1.2}, 1.2), ({"max_repeats": 3.0, "budget": 2 * total}, 3.0),
                          ({"max_repeats": None, "target_entropy": 1.3}, 99)):
        got = mixing.mix(d, **options)
        assert got.columns[:len(d.columns)] == d.columns
        took = {}
        for r in got.collect():
            took[r.source] = took.get(r.source, 0) + r["__mix_tokens"]
        assert sum(took.values()) <= options.get("budget", total)
        assert all(took.get(s, 0) <= most * n for s, n in tokens.items())
    cover = mixing.mix(d, max_repeats=1.5, budget="cover")
    assert cover.select("doc_id", "text").distinct().exceptAll(d.select("doc_id", "text").distinct()).count() == 0
    assert d.select("doc_id", "text").exceptAll(cover.select("doc_id", "text")).count() == 0
    assert mixing.mix(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.find_exponent(None, 1.0, 1.0, False)


def test_exponent_reaches_its_target(spark):
    import math
    shares = spark.createDataFrame([(0.7,), (0.2,), (0.1,)], "share double")
    p = [0.7, 0.2, 0.1]

    def weights(a):
        z = sum(x ** a for x in p)
        return [x ** a / z for x in p]

    a = mixing.find_exponent(shares, 2.0, None, False)
    assert max(w / x for w, x in zip(weights(a), p, strict=True)) <= 2.0 < max(
        w / x for w, x in zip(weights(a - 2 ** -20), p, strict=True))
    a = mixing.find_exponent(shares, None, 1.0, False)
    entropy = [-sum(w * math.log(w) for w in weights(x)) for x in (a, a + 2 ** -20)]
    assert entropy[0] >= 1.0 > entropy[1]
    assert mixing.find_exponent(shares, 1e9, None, False) == 0.0
    assert mixing.find_exponent(spark.createDataFrame([], "share double"), 1.2, None, False) in (0.0, 1.0)


def test_tables_of_one_row(spark):
    one = spark.createDataFrame([(5, None, None, None, None, None, None)], SCHEMA)
    assert sharding.shard_by_bytes(one).first().shard == 0 and mixing.mix(one).count() == 1
