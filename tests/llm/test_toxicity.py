import math
import random

import numpy as np
import pytest
from cases import docs, empty
from pyspark.sql import functions as F

from riskgrid.llm import toxicity
from riskgrid.llm.common import prepare
from riskgrid.llm.toxicity import BlockMaxIndex, weighted


def test_neighbours_equal_brute_force():
    rng = random.Random(7)
    n_terms = 60
    idf = np.array([math.log(1 + i) + 1 for i in range(n_terms)])
    examples = []
    for i in range(700):
        which = sorted(rng.sample(range(n_terms), rng.randrange(0, 6)))
        examples.append((which, [rng.randrange(1, 4) for _ in which], int(rng.random() < 0.3), i))
    index = BlockMaxIndex(examples, idf)
    dense = np.zeros((len(index.vectors), n_terms))
    for i, (which, counts) in enumerate(index.vectors):
        dense[i, list(which)] = weighted(np.array(which), np.array(counts), idf)
    for _ in range(200):
        which = np.array(sorted(rng.sample(range(n_terms), rng.randrange(1, 8))))
        q = weighted(which, np.ones(len(which)), idf)
        sims = dense[:, which] @ q
        order = [i for i in np.lexsort((np.arange(len(sims)), -sims)) if sims[i] > 0]
        have = np.cumsum(index.size[order])
        k = np.searchsorted(have, 25)
        want = [i for i in order if k >= len(order) or sims[i] >= sims[order[k]] - 1e-9]
        ids, got = index.nearest(which, q, 25)
        assert sorted(ids.tolist()) == sorted(int(i) for i in want)
        assert np.allclose(got, sims[ids])


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 2, 1, 4]), np.array([4.0, 4, 4, 4]))
    assert len(x) == 3 and x[1] == pytest.approx(0.25) and (np.diff(y) > 0).all()


def test_held_out_accuracy(spark):
    prepare(spark)
    d = "/root/testdata/sf0.1"
    rows = toxicity.query(spark, d).join(spark.read.parquet(d + "/labels.parquet"), "doc_id").where("held_out").collect()
    right = {y: np.mean([r.predicted == y for r in rows if r.toxic == y]) for y in (0, 1)}
    assert right[0] > 0.97 and right[1] > 0.88
    scores = sorted((r.score, r.toxic) for r in rows)
    ones = [i for i, (_, y) in enumerate(scores) if y]
    auc = (sum(ones) - len(ones) * (len(ones) - 1) / 2) / (len(ones) * (len(scores) - len(ones)))
    assert auc > 0.95


def test_awkward_rows(spark):
    d = docs(spark)
    labels = d.select("doc_id", (F.col("text").contains("word")).cast("int").alias("toxic"), F.lit(1).alias("score"))
    got = toxicity.scored(d, labels)
    assert got.count() == d.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    none = toxicity.scored(d, labels.where("false"))
    assert none.where("score <> 0.5").count() == 0
    assert toxicity.scored(empty(spark), labels).count() == 0


def test_only_learnt_rows_decide(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.scored(d, x).collect()) for x in (labels, flipped))
    assert a == b


def test_whole_vectors_of_all_examples(spark):
    """Examples without a telling term are found, neighbours equal brute force, terms without an example count."""
    prepare(spark)
    rng = random.Random(11)
    texts = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(60)}" for _ in range(rng.randrange(4, 30))) for _ in range(220)]
    rows = [(i, t + (f" only{i}" if i % 3 else "")) for i, t in enumerate(texts)]
    rare = [i for i in range(220) if i % 11 == 0]
    rows += [(1000 + i, rows[i][1]) for i in rare]                       # copies without a label
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in rare)) for i in range(220)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(d, labels).collect()}
    held = {i for i in range(220) if got[i].held_out}
    import pyarrow as pa
    doc, h, count = toxicity.counted(pa.array([t for _, t in rows]))
    voc, col = np.unique(h, return_inverse=True)
    dense = np.zeros((len(rows), len(voc)))
    dense[doc, col] = (1 + np.log(count)) * (np.log((1 + len(rows)) / (1 + np.bincount(col))) + 1)[col]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    examples = np.array([i for i in range(220) if i not in held])
    for n, (i, _) in enumerate(rows):
        sims = dense[examples] @ dense[n]
        best = sorted(zip(np.round(-sims, 9), examples), key=lambda x: (x[0], x[1]))[:3]
        assert got[i].evidence == [e for s, e in best if s < 0]
    for i in rare:
        if i not in held:
            assert got[1000 + i].evidence[0] == i and got[1000 + i].predicted == 1


def test_driver_unpacks_no_vector(spark):
    """The examples' vectors pass the driver packed, and it keeps none; a worker gets them back whole."""
    import pyarrow as pa
    prepare(spark)
    for numbers in ([], [0], [5, 0, 70_000, 2**31 - 1]):
        assert toxicity.unpacked(toxicity.packed(np.array(numbers, np.int64))).tolist() == numbers
    rows = [(i, f"word{i % 7} other{i % 5} other{i % 5} more{i}" if i % 9 else "") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(60)], "doc_id long, toxic int")
    model, shared, _, _ = toxicity.fitted(d, labels)
    assert model.whole.steps is None and model.whole.counts is None and not hasattr(model.whole, "col")
    sent = shared.value.whole
    sent.prepare()
    texts = dict(rows)
    for n, i in enumerate(sent.ids.tolist()):
        mine = slice(sent.cuts[n], sent.cuts[n + 1])
        _, h, count = toxicity.counted(pa.array([texts[i]]))
        order = np.argsort(h)
        assert model.vocabulary[sent.col[mine]].tolist() == h[order].tolist()
        assert sent.count[mine].tolist() == count[order].tolist()
