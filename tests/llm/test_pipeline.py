import re
from collections import Counter

import corpus_pipeline
from cases import docs, empty
from test_quality import brute as quality_brute
from test_suffix_dedup import brute as suffix_brute
from tokenizers import Tokenizer

from riskgrid.llm import bpe, quality
from riskgrid.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_brute(rows, k, percent=80):
    """doc_id -> smallest doc_id reachable."""
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(fold))
        sets.append((i, frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k
                     else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in rows}


def test_stages_against_brute_force(spark):
    prepare(spark)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(
        docs(spark).where("doc_id is not null").selectExpr("doc_id + 100000", "text", "lang", "source", "n_chars").distinct())
    stages = dict(corpus_pipeline.STAGES)
    verdict = {r.doc_id: r.kept for r in quality.judge(d).collect()}
    for r in d.collect():
        b = quality_brute(r.text)
        failed = b["n_words"] < 10 or 100 * b["n_repeat_words"] > 20 * b["n_words"]
        assert not (failed and verdict[r.doc_id])
    one = stages["quality_rules"](spark, d, "").checkpoint()
    assert one.columns == d.columns and {r.doc_id for r in one.collect()} == {i for i, k in verdict.items() if k}

    two = stages["near_duplicates"](spark, one, "").checkpoint()
    want = near_brute([(r.doc_id, r.text) for r in one.collect()], 5)
    assert {r.doc_id for r in two.collect()} == {i for i, c in want.items() if i == c}

    three = stages["repeated_passages"](spark, two, "").checkpoint()
    given = two.collect()
    kept = {r.doc_id: b[3].decode("utf-8", "ignore") for r, b in zip(given, suffix_brute(
        [r.text for r in given], corpus_pipeline.SPAN.bytes, corpus_pipeline.PASSAGE_WORDS), strict=True)}
    got = three.collect()
    assert {r.doc_id: r.text for r in got} == kept and all(r.n_chars == len(r.text) for r in got)

    four = stages["source_mixture"](spark, three, "").checkpoint()
    copies = Counter(r.doc_id for r in four.collect())
    assert four.columns == d.columns and set(copies) == set(kept) and max(copies.values()) <= 2
    size, total = Counter(), Counter()
    for r in got:
        size[r.source] += len(WORD.findall(r.text))
        total[r.source] += copies[r.doc_id] * len(WORD.findall(r.text))
    assert all(total[s] <= corpus_pipeline.MAX_REPEATS * size[s] * 1.001 for s in size)

    five = stages["bpe_encoding"](spark, four, "")
    library = Tokenizer.from_file(bpe.vocabulary_path())
    rows = five.collect()
    assert Counter(r.doc_id for r in rows) == copies
    assert all(r.ids == library.encode(kept[r.doc_id], add_special_tokens=False).ids for r in rows)


def test_empty_table(spark):
    d = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, "")
    assert d.count() == 0


def test_copies_leave_one_whole_text(spark):
    """Repeated rows, copies without an id, near copies under one id: one whole text is left of each group."""
    prepare(spark)
    stages = dict(corpus_pipeline.STAGES)
    words = lambda name: " ".join(f"{name}{j}" for j in range(150))
    given = [(7, words("same"))] * 3 + [(9, words("again")), (None, words("again"))] + [(None, words("none"))] * 2
    given += [(11, words("near")), (11, words("near") + " end"), (13, words("one")), (13, words("two"))]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given],
                              "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages["near_duplicates"](spark, d, "").checkpoint()
    whole = stages["repeated_passages"](spark, kept, "").collect()
    got = Counter((r.doc_id, r.text.split("0")[0]) for r in whole)
    assert got == Counter([(7, "same"), (9, "again"), (None, "none"), (11, "near"), (13, "one"), (13, "two")])
    assert all(len(r.text) >= len(words(r.text.split("0")[0])) for r in whole)


def test_short_passages_go_and_short_runs_stay(spark):
    """A passage of 60 words and 300 bytes that two documents share goes; a shared line of 30 long words stays."""
    prepare(spark)
    own = lambda i: " ".join(f"{chr(97 + i)}{j}{chr(97 + i)}" for j in range(80))
    passage = " ".join(f"p{j % 7}{j:02d}" for j in range(60))
    line = " ".join(f"lineofalicense{j}" for j in range(30))
    assert len(passage) < 310 and len(line) > 400
    given = [f"{own(0)} {passage} {own(1)}", f"{own(2)} {passage}", f"{own(3)}\n{line}\n{own(4)}", f"{own(5)}\n{line}\n"]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(given)],
                              "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["repeated_passages"](spark, d, "").collect()}
    assert not any(w in got[i] for i in (0, 1) for w in passage.split(" ")[1:-1])
    assert own(0) in got[0] and own(1) in got[0] and own(2) in got[1]
    assert (got[2], got[3]) == (given[2], given[3])
