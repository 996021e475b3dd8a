import random
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, docs, empty
from test_pipeline import WORD, near_brute

from riskgrid.llm import near_dedup, quality
from riskgrid.llm.common import prepare
from riskgrid.llm.textkernel import Words, buffers


def family(seed):
    """An original with many copies of one to many edits, chains of copies of copies, shuffled parts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    out = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = rng.choice(words).upper()
        out.append(" ".join(w))
    chain = [rng.choice(words) for _ in range(100)]
    for _ in range(12):                                   # the ends of the chain share too little
        chain = list(chain)
        chain[rng.randrange(100)] = rng.choice(words)
        out.append("\t".join(chain))
    out += [" ".join(base[:n]) for n in range(80, 120, 3)] + [" ".join(base[60:] + base[:60])] * 2
    rng.shuffle(out)
    return out


def shingle_words(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len({tuple(w[i:i + k]) for i in range(len(w) - k + 1)}) if len(w) >= k else int(bool(w))


def test_shingle_sets():
    given = [t or "" for t in family(0)[:5]] + ["", "a", "A b", "a B c d", "x y z w x y z w x"]
    sets = Words(*buffers(pa.array(given)), fold=True).shingles(4)
    assert [len(s) for s in sets] == [shingle_words(t, 4) for t in given]


def test_signature_distance_follows_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        common = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
        a, b = (np.concatenate((common, rng.integers(0, 1 << 63, 100, dtype=np.uint64))) for _ in range(2))
        s = near_dedup.signature([a, b])
        errors.append((s[0] != s[1]).sum())
        bits = near_dedup.fine_bits([a, b]).view(np.uint8)
        assert np.unpackbits(bits[0] ^ bits[1]).sum() <= near_dedup.FAR
    assert np.mean(errors) == pytest.approx(near_dedup.SYMBOLS * 0.2, abs=1.5)


@pytest.mark.parametrize("seed,few_pairs", [(1, 4), (2, 0)])
def test_components_equal_brute_force(spark, monkeypatch, seed, few_pairs):
    prepare(spark)
    monkeypatch.setattr(near_dedup, "FEW_PAIRS", few_pairs)
    texts = family(seed)
    d = spark.createDataFrame([(i + 7, t, None, None, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    want = near_brute([(i + 7, t) for i, t in enumerate(texts)], 4)
    got = {r.doc_id: r for r in near_dedup.labelled(d).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == shingle_words(texts[i - 7], 4) for i, r in got.items())


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 2000)], "a long, b long")
    got = {r.v: r.label for r in near_dedup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 2000: 1000}


def test_awkward_rows(spark):
    d = docs(spark)
    got = near_dedup.labelled(d)
    assert got.count() == d.count()
    whole = d.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = near_brute([(r.doc_id, r.text) for r in whole.collect()], 4)
    assert {r.doc_id: r.component_id for r in got.where("doc_id is not null").collect()} == want
    assert got.where("doc_id is null and component_id is not null").count() == 0
    kept = near_dedup.keep_first(d, 4)
    assert kept.columns == d.columns and kept.where("doc_id is null").count() == 1
    assert near_dedup.labelled(empty(spark)).count() == 0


def test_fine_signature_loses_far_less_than_the_buckets():
    """A pair of similarity 0.8 differs in each bit with probability 0.1."""
    loss = sum(comb(near_dedup.BITS, i) * 0.1 ** i * 0.9 ** (near_dedup.BITS - i)
               for i in range(near_dedup.FAR + 1, near_dedup.BITS // 2))
    assert loss < 1.6e-6 / 1000


class Direct:
    """Stands for a table of one batch: gives what a task makes of it."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return list(run(iter([self.batch])))


def test_a_task_has_arrays_of_little_text_at_a_time(spark):
    rng = random.Random(4)
    text = ["".join(rng.choice("ab  c") for _ in range(20_000)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(text)], ["doc_id", "text"])
    for made in (near_dedup.signed(Direct(batch), 5), near_dedup.shingle_sets(Direct(batch), 5), quality.measured(Direct(batch), [])):
        assert sum(len(b) for b in made) == 100
        assert max(len(b) for b in made) * 20_000 <= 600_000
