"""MinHash near-dedup (5): a multi-index Hamming join over b-bit signatures.

A text's set of word shingles gets ``SYMBOLS`` MinHash values of 16 bits.  The signature is split
into ``CHUNKS`` chunks of ``WIDTH`` symbols.  By the pigeonhole principle two signatures that differ in
at most ``2 * CHUNKS - 1`` symbols have a chunk with at most one error; the keys "chunk without its
i-th symbol" enumerate those errors, so every pair under the signature threshold meets in a
bucket (and a pair of similarity 0.8 fails to meet with probability 1.6e-6).

Work per bucket stays linear: equal shingle sets are first collapsed to one class.  Shingles that no
other class of any bucket has can't be shared, which bounds a class's similarity to all others; most edited
copies drop out by that bound.  The others are compared with a hub of their bucket (the class with the least
part of such shingles: an original rather than a copy), links are confirmed on the full sets, and linked
classes fall together.  Only buckets that still hold several components are looked at again, with another
hub; what is left when that brings little is compared pair by pair, between different components only, and
only where what both share with the bucket's first hub doesn't rule a link out.
Pairs inside a component can't change the result.

Defined results: a null or empty text has an empty set, links with nothing, and is its own
component; rows of one ``doc_id`` are one document, and each keeps its row; a null ``doc_id`` has a
null component and is kept; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
``keep_first`` carries all columns along and leaves one row of a group, whatever its ``doc_id``.  A text's arrays take about 40 times its bytes.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm.common import SLIM_BYTES, documents, sized_broadcast, text_chunks, tidy, written
from riskgrid.llm.textkernel import Words, buffers, mixed

SHINGLE_WORDS = 4
#: Percent of the union that two sets must share.
PERCENT = 80
CHUNKS, WIDTH = 10, 5
SYMBOLS = CHUNKS * WIDTH
#: Bits of the finer signature for what is left to compare pair by pair, and its largest distance: at
#: similarity 0.8 the distance (on average 102) is over it with probability 5.1e-10.
BITS, FAR = 1024, 165
#: Pairs by class at which the rest is compared pair by pair.
FEW_PAIRS = 4

_RNG = np.random.default_rng(977)
_FACTORS = _RNG.integers(1, 1 << 63, SYMBOLS + BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, SYMBOLS + BITS, dtype=np.uint64)

SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, signature array<short>"


def minima(sets: list[np.ndarray], which: range):
    """By hash function, the scrambled MinHash values of the (not empty) sets."""
    values = np.concatenate(sets)
    cuts = np.concatenate(([0], np.cumsum([len(s) for s in sets[:-1]]))).astype(np.int64)
    for j in which:
        yield mixed(np.minimum.reduceat(values * _FACTORS[j] + _OFFSETS[j], cuts))


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit symbols, a row by set."""
    return np.stack([x.astype(np.uint16) for x in minima(sets, range(SYMBOLS))], 1).view(np.int16)


def fine_bits(sets: list[np.ndarray]) -> np.ndarray:
    """One bit a hash function, packed in 64-bit words, a row by set."""
    bits = np.stack([x & np.uint64(1) for x in minima(sets, range(SYMBOLS, SYMBOLS + BITS))], 1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, shingles``: the set of each text as sorted 64-bit hashes in a binary."""
    def run(batches):
        for batch in batches:
            for first, last in text_chunks(batch, limit=SLIM_BYTES):
                part = batch.slice(first, last - first)
                sets = Words(*buffers(part.column("text").fill_null("")), fold=True).shingles(k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, shingles binary")


def signed(docs: DataFrame, k: int) -> DataFrame:
    """``SIGNED`` by row; d1 and d2 are a 128-bit digest of the set (null signature: empty set)."""
    def run(batches):
        for batch in batches:
            for first, last in text_chunks(batch, limit=SLIM_BYTES):
                part = batch.slice(first, last - first)
                sets = Words(*buffers(part.column("text").fill_null("")), fold=True).shingles(k)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                symbols = np.zeros((len(sets), SYMBOLS), np.int16)
                digest = np.zeros((len(sets), 2), np.uint64)
                if len(full):
                    symbols[full] = signature([sets[i] for i in full])
                for i in full:
                    s = sets[i]
                    digest[i] = s.sum(), mixed(s * np.uint64(0x9FB21C651E98DF25)).sum()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(digest[:, 0].view(np.int64)),
                     pa.array(digest[:, 1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SYMBOLS),
                                              pa.array(symbols.reshape(-1)))],
                    ["doc_id", "n_shingles", "d1", "d2", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), SIGNED)


def unshared(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """``rep, d1, alone``: how many shingles of each class no other one has (none: no row)."""
    def run(batches):
        for batch in batches:
            for first, last in text_chunks(batch, limit=SLIM_BYTES):
                part = batch.slice(first, last - first)
                sets = Words(*buffers(part.column("text").fill_null("")), fold=True).shingles(k)
                # a document can have other texts than that of the class
                ours = [i for i, (s, d1) in enumerate(zip(sets, part.column("d1").to_pylist(), strict=True))
                        if int(s.sum().view(np.int64)) == d1]
                row = pa.array(np.repeat(np.array(ours, np.int64), [len(sets[i]) for i in ours]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(row), part.column("d1").take(row),
                     pa.array(np.concatenate([sets[i] for i in ours] or [np.zeros(0, np.uint64)]).view(np.int64))],
                    ["rep", "d1", "shingle"])

    wanted = classes.select(F.col("rep").alias("doc_id"), "d1")
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .join(sized_broadcast(wanted, classes.count()), "doc_id"))
    once = (texts.mapInArrow(tidy(run), "rep long, d1 long, shingle long").groupBy("shingle")
            .agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("rep"), F.min("d1").alias("d1")).where("c = 1"))
    return once.groupBy("rep", "d1").agg(F.count(F.lit(1)).alias("alone"))


def bucketed(classes: DataFrame) -> DataFrame:
    """``key`` rows of each class: every chunk without each of its symbols in turn."""
    keys = []
    for c in range(CHUNKS):
        for skip in range(WIDTH):
            rest = [F.col("signature")[c * WIDTH + j] for j in range(WIDTH) if j != skip]
            keys.append(F.xxhash64(F.lit(c * WIDTH + skip), *rest))
    return classes.withColumn("key", F.explode(F.array(*keys)))


def compared(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The pairs ``a, b`` with the size of their full sets' intersection, ``common``, and whether that is ``PERCENT`` of the
    union, ``linked``; a document with several texts has a row for each pair of these."""
    pairs = written(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # eight bytes an id: beyond the bound the texts are shuffled instead
    wanted = docs.join(sized_broadcast(ids, ids.count()), "doc_id", "left_semi")
    sets = written(shingle_sets(wanted, k))
    both = (pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
            .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a"))

    def run(batches):
        for batch in batches:
            common, union = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common[i] = len(np.intersect1d(x, y, assume_unique=True))
                union[i] = len(x) + len(y) - common[i]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common), pa.array(
                common * 100 >= PERCENT * union)], ["a", "b", "common", "linked"])

    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long, common long, linked boolean")


def confirmed(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets share ``PERCENT`` of their union."""
    return compared(docs, pairs, k).where("linked").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``v, label``: each vertex with the smallest vertex it is linked to, by min-label propagation with
    pointer jumping until nothing changes."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label")).checkpoint()
    while True:
        near = (both.join(labels.withColumnsRenamed({"v": "b"}), "b").groupBy("a").agg(F.min("label").alias("near")))
        moved = labels.join(near.withColumnRenamed("a", "v"), "v").select(
            "v", "label", F.least("label", "near").alias("new"))
        jump = moved.alias("m").join(labels.select(F.col("v").alias("t"), F.col("label").alias("far")),
                                     F.col("m.new") == F.col("t")).select(
            "v", "label", F.least("new", "far").alias("new")).checkpoint()
        changed = jump.where("new <> label").limit(1).count()
        labels = jump.select("v", F.col("new").alias("label"))
        if not changed:
            return labels


def labelled(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` by row."""
    rows = written(signed(docs, k))
    real = rows.where("n_shingles > 0 and doc_id is not null")
    every = written(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
                                                 F.first("signature").alias("signature")))
    # classes that share a bucket with another one, and what they can share with it
    keys = bucketed(every).select("key", "rep", "d1")
    met = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key").join(keys, "key")
           .select("rep", "d1").distinct())
    pool = written(every.join(met, ["rep", "d1"]))
    classes = written(pool.join(unshared(docs, pool, k), ["rep", "d1"], "left")
                      .withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
                      .where(F.col("most") * 100 >= F.col("n") * PERCENT))
    member = bucketed(classes).select("key", "rep", "n", "most")
    n_classes = classes.count()

    # round 0: each class with the hub of its bucket
    rank = F.struct((1 - F.col("most") / F.col("n")).alias("alone"), "rep", "n", "most")
    hubs = (member.groupBy("key").agg(F.min(rank).alias("hub"), F.count(F.lit(1)).alias("c"))
            .where("c > 1").select("key", "hub"))
    with_hubs = written(compared(docs, _sized_pairs(member.join(hubs, "key")), k))
    edges = with_hubs.where("linked").select("a", "b").distinct()
    hubs0 = hubs.select("key", F.col("hub.rep").alias("hub"))
    # a document with several rows is one vertex
    rep_of = real.join(every.select("d1", "d2", "rep"), ["d1", "d2"]).select("doc_id", "rep").distinct()
    own = rep_of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1")
    edges = edges.union(own.join(rep_of, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b"))

    turn, left_before = 0, None
    while True:
        labels = components(edges)
        open_rows = _open(classes, labels)
        pairs_left = _cross_pairs(open_rows)
        if not pairs_left:
            break
        turn += 1
        if pairs_left <= FEW_PAIRS * n_classes or (left_before is not None and pairs_left > left_before * 0.8):
            found = confirmed(docs, _close_pairs(docs, _with_common(open_rows, hubs0, with_hubs), k), k)
            labels = components(edges.union(found).checkpoint())
            break
        left_before = pairs_left
        order = F.xxhash64(F.lit(turn), "rep")
        hubs = open_rows.groupBy("key").agg(F.min_by(F.struct("rep", "n", "most", "label"), order).alias("hub"))
        found = confirmed(docs, _sized_pairs(open_rows.join(hubs, "key").where("label <> hub.label")), k)
        edges = edges.union(found).checkpoint()

    named = (rows.join(every.select("d1", "d2", "rep"), ["d1", "d2"], "left")
             .join(labels.withColumnRenamed("v", "rep"), "rep", "left"))
    return named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "rep"))
                        .otherwise(F.col("doc_id")).alias("component_id"))


def _fits(n_a, most_a, n_b, most_b):
    """Whether the sets can share enough: at most ``most`` of each one's shingles."""
    common = F.least(most_a, most_b)
    return common * 100 >= (n_a + n_b - common) * PERCENT


def _with_common(open_rows: DataFrame, hubs: DataFrame, with_hubs: DataFrame) -> DataFrame:
    """``open_rows`` with ``common``, what a class shares with the first hub of the bucket (null: not compared with it, or
    one of both has several texts)."""
    known = with_hubs.groupBy("a", "b").agg(F.max("common").alias("common"), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    rows = open_rows.join(hubs, "key", "left").withColumns({"a": F.least("rep", "hub"), "b": F.greatest("rep", "hub")})
    return rows.join(known, ["a", "b"], "left").drop("a", "b", "hub")


def _fits_by_hub(a: str, b: str):
    """Whether two classes of a bucket can share enough, seen from its hub: of the hub's shingles they share at most what the
    lesser of both shares with it, of the others at most what the lesser could share with anyone."""
    (n_a, most_a, c_a), (n_b, most_b, c_b) = ([F.col(f"{x}.{c}") for c in ("n", "most", "common")] for x in (a, b))
    common = F.least(c_a, c_b) + F.least(most_a - c_a, most_b - c_b)
    return F.coalesce(common * 100 >= (n_a + n_b - common) * PERCENT, F.lit(True))


def _sized_pairs(with_hub: DataFrame) -> DataFrame:
    return (with_hub.where((F.col("rep") != F.col("hub.rep"))
                           & _fits(F.col("n"), F.col("most"), F.col("hub.n"), F.col("hub.most")))
            .select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct())


def _open(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """The bucket rows (with labels and signatures) of buckets that hold several components."""
    now = classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn(
        "label", F.coalesce("label", "rep"))
    rows = bucketed(now).select("key", "rep", "n", "most", "label")
    several = (rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
               .where("x <> y").select("key"))
    return written(rows.join(several, "key"))


def _cross_pairs(open_rows: DataFrame) -> int:
    by_label = open_rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    by_key = by_label.groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return by_key.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0


def _close_pairs(docs: DataFrame, open_rows: DataFrame, k: int) -> DataFrame:
    """Pairs of one bucket, of different components, with sizes and fine signatures close enough."""
    def run(batches):
        for batch in batches:
            for first, last in text_chunks(batch, limit=SLIM_BYTES):
                part = batch.slice(first, last - first)
                sets = Words(*buffers(part.column("text").fill_null("")), fold=True).shingles(k)
                full = [i for i, s in enumerate(sets) if len(s)]
                bits = fine_bits([sets[i] for i in full]) if full else np.zeros((0, BITS // 64), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(full, pa.int64())),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * (BITS // 64)),
                                              pa.array(bits.reshape(-1)))], ["rep", "bits"])

    reps = open_rows.select(F.col("rep").alias("doc_id")).distinct()
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .join(sized_broadcast(reps, reps.count()), "doc_id", "left_semi"))
    # at most SYMBOLS keys a class
    keys = open_rows.groupBy("rep").agg(F.collect_set("key").alias("keys"))
    signed_rows = written(open_rows.join(texts.mapInArrow(tidy(run), "rep long, bits array<long>").join(keys, "rep"), "rep"))
    a, b = signed_rows.alias("a"), signed_rows.alias("b")
    errors = functools.reduce(operator.add, [
        F.bit_count(F.col("a.bits")[j].bitwiseXOR(F.col("b.bits")[j])) for j in range(BITS // 64)])
    return (a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") < F.col("b.label"))
                   & _fits(F.col("a.n"), F.col("a.most"), F.col("b.n"), F.col("b.most")) & _fits_by_hub("a", "b") & (errors <= FAR)
                   # once: in the bucket of the least common key
                   & (F.col("a.key") == F.array_min(F.array_intersect("a.keys", "b.keys"))))
            .select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b")).distinct())


def keep_first(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row of ``docs`` of each component of texts, all columns: the one of the smallest ``doc_id`` (nulls last), then
    of the smallest hash of its text.  Rows are linked by their texts alone, so repeated rows and rows without a
    ``doc_id`` fall together as well; texts without words link with nothing and stay."""
    keyed = written(docs.withColumn("__row", F.monotonically_increasing_id()))
    rows = written(labelled(keyed.select(F.col("__row").alias("doc_id"), "text"), k)
                   .select(F.col("doc_id").alias("__row"), "component_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row")
    first = (keyed.select("__row", order.alias("order")).join(rows, "__row").groupBy("component_id")
             .agg(F.min("order").alias("order")).select(F.col("order.__row").alias("__row")))
    gone = written(rows.select("__row").join(first, "__row", "left_anti"))
    return keyed.join(sized_broadcast(gone, gone.count()), "__row", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: shingle count, component and verdict of every document."""
    return labelled(documents(spark, sf_dir)).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
