import hashlib

from cases import SCHEMA, docs, empty

from riskgrid.llm import common, fingerprint
from riskgrid.llm.fingerprint import Tree, edits, likeness


def test_tree_round_trip_and_equality():
    texts = ["", "a", "a\nb", "a\n\nb", "a\n\n\nb", "One. Two! Three?\nFour" * 30, "x" * 1000, "é🙂\n" * 5, "...!!!"]
    trees = [Tree.of(t) for t in texts]
    assert len({t.root for t in trees}) == len(texts)
    for t, tree in zip(texts, trees, strict=True):
        again = Tree.parse(str(tree))
        assert str(again) == str(tree) == str(Tree.of(t)) and again.pieces == tree.pieces
        assert tree.length == len(t.replace("\n", ""))


def test_likeness_and_edits():
    lines = [f"Line number {i} says something of its own." for i in range(20)]
    a = Tree.of("\n".join(lines))
    b = Tree.of("\n".join([*lines[:7], "Another line.", *lines[8:]]))
    assert edits(a, b) == [(0, 7)] and edits(a, a) == []
    assert 0.9 < likeness(a, b) < 1 and likeness(a, a) == 1
    assert likeness(a, Tree.of("Nothing in common here")) == 0
    assert likeness(Tree.of(""), Tree.of("")) == 1 and likeness(Tree.of(""), a) == 0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for i, r in enumerate(rows):
        t, nxt = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        e = t[:len(t) - k] + nxt[:k]
        out.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), str(Tree.of(t)), str(Tree.of(e)),
                    likeness(Tree.of(t), Tree.of(e)), likeness(Tree.of(t), Tree.of(nxt))))
    return sorted(out, key=str)


def test_successors_over_many_runs(spark, monkeypatch):
    common.prepare(spark)
    d = docs(spark)
    rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
    for size in (1 << 30, 5000, 500):
        monkeypatch.setattr(fingerprint, "RUN_BYTES", size)
        got = sorted((tuple(r) for r in fingerprint.fingerprints(d).collect()), key=str)
        assert got == brute(rows)
    whole = d.where("doc_id is not null")
    rows = [r for r in rows if r[0] is not None]
    assert sorted((tuple(r) for r in fingerprint.fingerprints(whole).collect()), key=str) == brute(rows)


def test_small_tables(spark):
    assert fingerprint.fingerprints(empty(spark)).count() == 0
    one = spark.createDataFrame([(5, "abcdefgh", None, None, 8, None, None)], SCHEMA)
    r = fingerprint.fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1
