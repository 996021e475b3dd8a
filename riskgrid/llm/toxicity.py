"""Toxicity (9): votes of the nearest labelled examples by exact TF-IDF cosine.

Terms are plain words (letters and digits, A-Z folded) and their first 4 and 5 bytes.  A text becomes the
TF-IDF vector of all its terms, with document frequencies over all documents.  Two indexes of the labelled
examples vote, weighted by distance:

* ``WholeIndex`` holds the whole vectors of all examples.  A batch of texts meets all of them at once (the
  ``DENSE`` commonest terms as a matrix product, the others by their postings); what comes within the rounding error
  of the k-th best is scored again in double precision, so the neighbours are exact.
* ``BlockMaxIndex`` holds the examples over the telling terms only, those that mostly toxic examples have (share and
  G2 test, at most ``MAX_TERMS``): a few such words of a long text hardly move its whole vector.  Blocks are
  taken in order of a bound of their similarities, until it falls under the k-th best, so these are exact as well.

Isotonic regression of the examples' leave-one-out votes calibrates each vote; the larger one counts, calibrated
again.  The evidence are the nearest examples by the whole vectors.

The examples are at most ``MAX_EXAMPLES`` labelled rows (in pseudo-random order of ``doc_id``), so model and index
have a fixed number of rows, whatever the corpus.  Rows with crc32(doc_id as text) mod 5 = 0 are held out.

Defined results: a text that shares no term with an example has the prior rate as its whole vote, one without a telling term the
rate of such examples as the other; a null ``doc_id`` isn't held out and never an example; of several labels of
one document the largest counts; without any labelled row all scores are 0.5 (predicted 1); repeated rows get
equal scores; an empty table gives no rows.  Only ``doc_id`` and ``text`` of the documents are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm.common import documents, text_chunks, written
from riskgrid.llm.textkernel import IS_MARK, Words, buffers, mixed

MAX_EXAMPLES, MAX_TERMS = 20_000, 4096
#: Least examples with a term, least G2 (p = 0.0005) and least share of toxic ones among them.
MIN_EXAMPLES, MIN_G2, MIN_SHARE = 3, 12.1, 0.6
PREFIXES = (4, 5)
NEIGHBOURS, BLOCK = 25, 64
#: Columns of the dense part of the whole vectors, texts of a matrix product, and a bound of twice its rounding error.
DENSE, TOGETHER, ROUNDING = 2048, 128, 5e-4
#: Examples whose vectors are weighted at once, and postings that are added up at once.
EXAMPLES_TOGETHER, POSTINGS = 1000, 60_000
FOLDS = 5
#: Weight of the prior rate among the votes.
PRIOR_VOTES = 0.25


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and term hash of every occurrence."""
    w = Words(data, offsets, fold=True, apart=IS_MARK)
    docs, hashes = [w.doc], [w.hash]
    for n in PREFIXES:
        long = np.flatnonzero(w.end - w.start > n)
        docs.append(w.doc[long])
        hashes.append(mixed(w.bytes.of(w.start[long], w.start[long] + n) ^ np.uint64(n)))
    return np.concatenate(docs), np.concatenate(hashes)


def by_row(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term (a place in the last array) and number of occurrences, by row; and the sorted distinct hashes."""
    doc, h = terms(*buffers(texts))
    known, which = np.unique(h, return_inverse=True)
    key, n = np.unique(doc * len(known) + which, return_counts=True)
    doc = key // max(1, len(known))
    return doc, key - doc * len(known), n, known


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term hash and number of occurrences, by row."""
    doc, which, n, known = by_row(texts)
    return doc, known[which], n


def term_counts(texts: DataFrame) -> DataFrame:
    """``term, toxic, n``: in how many rows of ``texts`` (with ``toxic``) a term occurs."""
    def run(batches):
        for batch in batches:
            for first, last in text_chunks(batch):
                part = batch.slice(first, last - first)
                doc, which, _, known = by_row(part.column("text").fill_null(""))
                label = part.column("toxic").to_numpy(zero_copy_only=False)
                for y in (0, 1):
                    n = np.bincount(which[label[doc] == y], minlength=len(known))
                    t = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(known[t].view(np.int64)), pa.array(np.full(len(t), y, np.int32)), pa.array(n[t])],
                        ["term", "toxic", "n"])

    return texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "term long, toxic int, n long")


def choose_terms(counts: DataFrame, n_toxic: int, n_clean: int) -> np.ndarray:
    """Sorted hashes of the vocabulary: terms that mostly toxic examples have, by G2."""
    wide = counts.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
                                      F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    total, share = float(n_toxic + n_clean), n_toxic / max(1, n_toxic + n_clean)
    a, b = F.col("a"), F.col("b")
    c, d = F.lit(float(n_toxic)) - a, F.lit(float(n_clean)) - b

    def part(seen, row, rate):
        return F.when(seen > 0, seen * F.log(seen / (row * F.lit(rate)))).otherwise(0.0)

    g2 = 2 * (part(a, a + b, share) + part(b, a + b, 1 - share) + part(c, F.lit(total) - a - b, share)
              + part(d, F.lit(total) - a - b, 1 - share))
    rows = (wide.where((a + b >= MIN_EXAMPLES) & (a >= (a + b) * MIN_SHARE)).withColumn("g2", g2)
            .where(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "term").limit(MAX_TERMS).select("term").collect())
    return np.sort(np.array([r.term for r in rows], np.int64).view(np.uint64))


def places(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted vocabulary, -1 if it isn't there."""
    if not len(vocabulary):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, -1)


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as deflated byte planes."""
    return zlib.compress(np.ascontiguousarray(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.int32).reshape(-1)


VECTORS = "doc_id long, toxic int, size long, steps binary, counts binary, telling array<int>, telling_counts array<int>"


def example_vectors(texts: DataFrame, vocabulary, telling) -> DataFrame:
    """``VECTORS`` by row: places in the broadcast vocabulary (as ``packed`` steps) and ``packed`` counts, and those of the telling terms
    (``telling``: broadcast, by place) apart."""
    def run(batches):
        for batch in batches:
            for first, last in text_chunks(batch):
                part = batch.slice(first, last - first)
                doc, which, n, known = by_row(part.column("text").fill_null(""))
                at, n = places(vocabulary.value, known).astype(np.int32)[which], n.astype(np.int32)
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                rows = list(zip(cuts, cuts[1:]))
                own = telling.value[at]
                has = np.flatnonzero(own >= 0)
                ends = pa.array(np.searchsorted(doc[has], np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic"), pa.array(np.diff(cuts)),
                     pa.array([packed(np.diff(at[a:b], prepend=0)) for a, b in rows], pa.binary()),
                     pa.array([packed(n[a:b]) for a, b in rows], pa.binary()),
                     pa.ListArray.from_arrays(ends, pa.array(own[has])), pa.ListArray.from_arrays(ends, pa.array(n[has]))],
                    [f.split(" ")[0] for f in VECTORS.split(", ")])

    return texts.select("doc_id", F.col("toxic").cast("int"), "text").mapInArrow(run, VECTORS)


def weighted(which: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF weights of one vector."""
    w = (1 + np.log(counts)) * idf[which]
    return w / (np.sqrt((w * w).sum()) or 1.0)


class BlockMaxIndex:
    """Example vectors (equal ones once) in blocks, with the largest weight of each term in each block."""

    def __init__(self, examples: list[tuple[list[int], list[int], int, int]], idf: np.ndarray):
        """``examples``: terms, counts, label, doc_id."""
        groups: dict[tuple, list] = {}
        for which, counts, label, doc_id in examples:
            groups.setdefault((tuple(which), tuple(counts)), []).append((doc_id, label))
        # like vectors side by side, so that blocks have tight bounds
        self.vectors = sorted(k for k in groups if k[0])
        self.members = [sorted(groups[k]) for k in self.vectors]
        self.size = np.array([len(m) for m in self.members], np.int64)
        self.toxic = np.array([sum(y for _, y in m) for m in self.members], np.int64)
        bare = groups.get(((), ()), [])
        self.bare = (len(bare), sum(y for _, y in bare))
        self.prior = (sum(y for *_, y, _ in examples) + 0.5) / (len(examples) + 1)
        self.idf = idf
        rows, cols, weights = [], [], []
        for i, (which, counts) in enumerate(self.vectors):
            rows += [i] * len(which)
            cols += which
            weights.append(weighted(np.array(which), np.array(counts), idf))
        row, col = np.array(rows, np.int64), np.array(cols, np.int64)
        weight = np.concatenate(weights) if weights else np.zeros(0)
        order = np.lexsort((row, col))
        self.row, self.weight = row[order], weight[order]
        self.blocks = -(-len(self.vectors) // BLOCK)
        # postings of (term, block): a slice; and the largest weight there
        key = col[order] * self.blocks + self.row // BLOCK
        self.slices = np.searchsorted(key, np.arange(len(idf) * self.blocks + 1))
        self.most = np.zeros(len(idf) * self.blocks)
        np.maximum.at(self.most, key, self.weight)
        self.most = self.most.reshape(len(idf), self.blocks)

    def nearest(self, which: np.ndarray, q: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and similarities of the ``k`` nearest examples (more with equal ones), most similar first; one
        example of the vector ``leave`` is left out."""
        if not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = q @ self.most[which]
        ids, sims, floor = np.zeros(0, np.int64), np.zeros(0), 0.0
        for block in np.argsort(-bound, kind="stable"):
            if bound[block] <= 0 or bound[block] < floor - 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, w in zip(which, q, strict=True):
                a, b = self.slices[t * self.blocks + block], self.slices[t * self.blocks + block + 1]
                score[self.row[a:b] - block * BLOCK] += w * self.weight[a:b]
            hit = np.flatnonzero(score > 0)
            ids, sims = np.concatenate((ids, hit + block * BLOCK)), np.concatenate((sims, score[hit]))
            order = np.lexsort((ids, -sims))
            ids, sims = ids[order], sims[order]
            have = np.cumsum(self.size[ids] - (ids == leave))
            full = np.searchsorted(have, k)
            if full < len(ids):
                floor = sims[full]
                keep = int(np.searchsorted(-sims, -floor + 1e-12, side="right"))
                ids, sims = ids[:keep], sims[:keep]
        return ids, sims

    def vote(self, which: list[int], counts: list[int], leave: int = -1) -> tuple[float, list[int]]:
        """Weighted share of toxic votes, and the nearest examples as evidence; -1 without a known term."""
        if not len(which):
            return -1.0, []
        which = np.asarray(which)
        ids, sims = self.nearest(which, weighted(which, np.asarray(counts), self.idf), NEIGHBOURS, leave)
        out = (ids == leave).astype(np.int64)
        w = sims ** 2
        toxic = self.toxic[ids] - out * (self.toxic[ids] * 2 >= self.size[ids]) if leave >= 0 else self.toxic[ids]
        share = ((w * toxic).sum() + PRIOR_VOTES * self.prior) / ((w * (self.size[ids] - out)).sum() + PRIOR_VOTES)
        return float(share), [m[0][0] for m in (self.members[i] for i in ids[:3])]


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps (mean of x, mean of y) of weighted isotonic regression."""
    blocks: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        blocks.append([x[i] * n[i], y[i], n[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 0] / b[:, 2], (b[:, 1] + 0.05) / (b[:, 2] + 0.1)


def calibration(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic steps of labels by votes; equal votes are one point."""
    at, which, n = np.unique(np.round(x, 9), return_inverse=True, return_counts=True)
    return isotonic(at, np.bincount(which, y), n.astype(float))


class WholeIndex:
    """The whole vectors of all examples, by example: ``cuts`` of ``col`` (place in the vocabulary) and ``count``.  They stay
    ``packed`` as the tasks made them until a worker scores with them: the driver only hands them on."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, size: np.ndarray, steps: list[bytes], counts: list[bytes], idf: np.ndarray):
        self.ids, self.toxic, self.steps, self.counts, self.idf = ids, toxic, steps, counts, idf
        self.cuts = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        self.dense = None

    def drop_vectors(self) -> None:
        """Leaves ids, labels and sizes only."""
        self.steps = self.counts = None

    def prepare(self) -> None:
        """The vectors with their dense and posted part; made where they are used, as they are larger than what they are made
        from, and by slices of examples, as the numbers in between are larger still."""
        n, terms_of = len(self.ids), np.diff(self.cuts)
        self.col, self.count = (np.empty(self.cuts[-1], np.int32) for _ in range(2))
        for i in range(n):
            mine = slice(self.cuts[i], self.cuts[i + 1])
            np.cumsum(unpacked(self.steps[i]), out=self.col[mine])
            self.count[mine] = unpacked(self.counts[i])
        self.drop_vectors()
        seen = np.bincount(self.col, minlength=len(self.idf))
        self.column = np.full(len(self.idf), -1, np.int32)
        common = np.argsort(-seen, kind="stable")[:DENSE]
        self.column[common] = np.arange(len(common))
        self.norm, dense, rare = np.empty(n), np.zeros((n, len(common)), np.float32), []
        for first in range(0, n, EXAMPLES_TOGETHER):
            last = min(n, first + EXAMPLES_TOGETHER)
            mine = slice(self.cuts[first], self.cuts[last])
            col = self.col[mine]
            weight = (1 + np.log(self.count[mine])) * self.idf[col]
            row = np.repeat(np.arange(first, last, dtype=np.int32), terms_of[first:last])
            norm = np.sqrt(np.bincount(row - first, weight * weight, last - first))
            norm[norm == 0] = 1
            self.norm[first:last] = norm
            weight = (weight / norm[row - first]).astype(np.float32)
            at = self.column[col]
            hit, out = np.flatnonzero(at >= 0), at < 0
            dense[row[hit], at[hit]] = weight[hit]
            rare.append((col[out], row[out], weight[out]))
        col, self.row, self.weight = (np.concatenate(x) for x in zip(*rare, strict=True))
        del rare
        order = np.argsort(col, kind="stable")
        self.row, self.weight = self.row[order], self.weight[order]
        seen[common] = 0
        self.posts = np.concatenate(([0], np.cumsum(seen)))
        self.dense = dense

    def similar(self, doc: np.ndarray, col: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """Similarity of each of ``rows`` texts with each example, in single precision."""
        at, n = self.column[col], len(self.ids)
        q = np.zeros((rows, self.dense.shape[1]), np.float32)
        q[doc[at >= 0], at[at >= 0]] = weight[at >= 0]
        out = q @ self.dense.T
        rare = np.flatnonzero(at < 0)
        begin, size = self.posts[col[rare]], self.posts[col[rare] + 1] - self.posts[col[rare]]
        before = np.concatenate(([0], np.cumsum(size)))
        ends = np.searchsorted(doc[rare], np.arange(rows + 1))
        first = 0
        while first < rows:
            # as many texts as have POSTINGS postings, one at least
            last = max(first + 1, int(np.searchsorted(before[ends], before[ends[first]] + POSTINGS, side="right")) - 1)
            mine = slice(ends[first], ends[last])
            many, start = size[mine], before[ends[first]]
            post = np.arange(before[ends[last]] - start) + np.repeat(begin[mine] - before[mine] + start, many)
            if len(post):
                key = np.repeat((doc[rare[mine]] - first) * n, many) + self.row[post]
                out[first:last] += np.bincount(key, np.repeat(weight[rare[mine]], many) * self.weight[post],
                                               (last - first) * n).reshape(last - first, n)
            first = last
        return out

    def nearest(self, doc: np.ndarray, col: np.ndarray, weight: np.ndarray, rows: int, k: int, leave=None):
        """By text: the ``k`` nearest examples (more with equal ones) and their similarities, most similar first.  ``doc`` ascends;
        ``weight`` has unit length by text.  ``leave`` has the ids of examples to leave out, one a text."""
        if self.dense is None:
            self.prepare()
        n, scratch = len(self.ids), np.zeros(len(self.idf))
        for first in range(0, rows, TOGETHER):
            last = min(rows, first + TOGETHER)
            a, b = np.searchsorted(doc, (first, last))
            score = self.similar(doc[a:b] - first, col[a:b], weight[a:b], last - first)
            if leave is not None:
                score[leave[first:last, None] == self.ids[None, :]] = -1
            floor = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.zeros(last - first)
            cuts = np.searchsorted(doc[a:b], np.arange(first, last + 1)) + a
            for i in range(last - first):
                mine = slice(cuts[i], cuts[i + 1])
                near = np.flatnonzero(score[i] >= max(floor[i] - ROUNDING, 1e-30)) if cuts[i + 1] > cuts[i] else []
                if not len(near):
                    yield np.zeros(0, np.int64), np.zeros(0)
                    continue
                scratch[col[mine]] = weight[mine] * self.idf[col[mine]]
                size = self.cuts[near + 1] - self.cuts[near]
                starts = np.cumsum(size) - size
                at = np.arange(size.sum()) + np.repeat(self.cuts[near] - starts, size)
                sims = np.add.reduceat(scratch[self.col[at]] * (1 + np.log(self.count[at])), starts) / self.norm[near]
                scratch[col[mine]] = 0
                order = np.lexsort((self.ids[near], -sims))
                near, sims = near[order], sims[order]
                if len(near) > k:
                    keep = int(np.searchsorted(-sims, -sims[k - 1] + 1e-12, side="right"))
                    near, sims = near[:keep], sims[:keep]
                yield near, sims

    def votes(self, doc, col, count, rows: int, leave=None):
        """By text: toxic votes, all votes, squared length of the known part of its vector, evidence."""
        raw = (1 + np.log(count)) * self.idf[col]
        square = np.bincount(doc, raw * raw, rows)
        found = self.nearest(doc, col, raw / np.sqrt(square)[doc], rows, NEIGHBOURS, leave)
        for i, (near, sims) in enumerate(found):
            w = sims ** 2
            yield float((w * self.toxic[near]).sum()), float(w.sum()), float(square[i]), self.ids[near[:3]].tolist()


class Model:
    """Both indexes; ``telling`` has the place in ``vocabulary`` of each telling term, ``place`` the reverse, ``own`` the terms and counts of
    each example among the telling ones."""

    def __init__(self, vocabulary: np.ndarray, telling: np.ndarray, place: np.ndarray, own: list, whole: WholeIndex):
        self.vocabulary, self.whole, self.place, self.own = vocabulary, whole, place, own
        self.prior = (whole.toxic.sum() + 0.5) / (len(whole.ids) + 1)
        self.index = BlockMaxIndex([(w, c, int(y), int(i)) for (w, c), y, i in
                                    zip(self.own, whole.toxic, whole.ids, strict=True)], whole.idf[telling])
        i = self.index
        self.bare = (i.bare[1] + 0.5) / (i.bare[0] + 1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "own"}

    def telling_vectors(self, doc, col, count, rows: int):
        at = self.place[col]
        known = np.flatnonzero(at >= 0)
        cuts = np.searchsorted(doc[known], np.arange(rows + 1))
        at, count = at[known].tolist(), count[known].tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield at[a:b], count[a:b]

    def whole_vote(self, toxic, every, known=1.0):
        """Share of the toxic votes; ``known`` is the part of the text's squared length that examples' terms have."""
        return (toxic * known + PRIOR_VOTES * self.prior) / (every * known + PRIOR_VOTES)

    def calibrate(self, found: dict[int, tuple[float, float]]) -> None:
        """``found``: toxic and all votes of each example without itself."""
        y = self.whole.toxic.astype(float)
        a = self.whole_vote(*np.array([found[i] for i in self.whole.ids.tolist()]).T)
        left = {(tuple(w), tuple(c)): self.index.vote(w, c, leave=k)[0]
                for k, (w, c) in enumerate(self.index.vectors)}
        b = np.array([left.get((tuple(w), tuple(c)), -1.0) for w, c in self.own])
        self.by_whole, has = calibration(a, y), b >= 0
        self.by_telling = calibration(b[has], y[has]) if has.any() else (np.zeros(1), np.full(1, self.bare))
        self.steps = calibration(self.larger(a, b), y)

    def larger(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(np.interp(a, *self.by_whole), np.where(b < 0, self.bare, np.interp(b, *self.by_telling)))

    def score(self, toxic, every, known, telling) -> np.ndarray:
        return np.interp(self.larger(self.whole_vote(toxic, every, known), telling), *self.steps)


FOUND = ("row long, doc_id long, toxic double, every double, square double, telling double, evidence array<long>, "
         "others array<long>, counts array<int>")


def votes(docs: DataFrame, shared, leave: bool = False) -> DataFrame:
    """``FOUND`` by row of ``row, doc_id, text``: votes, and the terms (with counts) that no example has.  ``leave``: each text
    is an example and doesn't vote for itself."""
    def run(batches):
        model = shared.value
        for batch in batches:
            for first, last in text_chunks(batch):
                part = batch.slice(first, last - first)
                n = part.num_rows
                doc, which, count, hashes = by_row(part.column("text").fill_null(""))
                at = places(model.vocabulary, hashes)[which]
                k, o = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                own = part.column("doc_id").to_numpy(zero_copy_only=False) if leave else None
                out = list(model.whole.votes(doc[k], at[k], count[k], n, own))
                telling = [-1.0 if leave else model.index.vote(w, c)[0]
                           for w, c in model.telling_vectors(doc[k], at[k], count[k], n)]
                ends = pa.array(np.searchsorted(doc[o], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), *(pa.array([x[j] for x in out], pa.float64()) for j in range(3)),
                     pa.array(telling, pa.float64()), pa.array([x[3] for x in out], pa.list_(pa.int64())),
                     pa.ListArray.from_arrays(ends, pa.array(hashes[which[o]].view(np.int64))),
                     pa.ListArray.from_arrays(ends, pa.array(count[o].astype(np.int32)))],
                    [f.split(" ")[0] for f in FOUND.split(", ")])

    return docs.select("row", "doc_id", "text").mapInArrow(run, FOUND)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple:
    """The model (None without examples), its broadcast for ``votes``, ``term, df`` over all documents, and their number."""
    spark = docs.sparkSession
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    sample = written(known.orderBy(F.xxhash64(F.lit(31), "doc_id"), "doc_id").limit(MAX_EXAMPLES))
    # at most MAX_EXAMPLES rows; of several texts of one doc_id always the same
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                    .join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(
                        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic")))
    totals = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not totals:
        return None, None, None, 0
    counts = written(term_counts(texts))
    chosen = choose_terms(counts, totals.get(1, 0), totals.get(0, 0))
    frequency = written(term_counts(docs.select("text", F.lit(0).alias("toxic"))).groupBy("term")
                        .agg(F.sum("n").alias("df")))
    n = docs.count()
    seen = frequency.join(counts.select("term").distinct(), "term").toArrow()            # terms of the examples
    vocabulary, df = seen["term"].to_numpy().view(np.uint64), seen["df"].to_numpy()
    order = np.argsort(vocabulary)
    vocabulary, idf = vocabulary[order], np.log((1 + n) / (1 + df[order])) + 1
    del seen
    telling = places(vocabulary, chosen)
    place = np.full(len(vocabulary), -1, np.int32)
    place[telling] = np.arange(len(telling))
    rows = example_vectors(texts, spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(place)).toArrow().sort_by("doc_id")
    own = list(zip(rows["telling"].to_pylist(), rows["telling_counts"].to_pylist(), strict=True))
    whole = WholeIndex(rows["doc_id"].to_numpy(), rows["toxic"].to_numpy(), rows["size"].to_numpy(), rows["steps"].to_pylist(),
                       rows["counts"].to_pylist(), idf)
    del rows
    model = Model(vocabulary, telling, place, own, whole)
    shared = spark.sparkContext.broadcast(model)
    whole.drop_vectors()
    left = votes(texts.withColumn("row", F.col("doc_id")), shared, leave=True)
    model.calibrate({r.doc_id: (r.toxic, r.every) for r in left.select("doc_id", "toxic", "every").collect()})
    return model, shared, frequency, n


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` (ids of the nearest examples) by row."""
    model, shared, frequency, n = fitted(docs, labels)
    ids = F.col("doc_id").cast("long").alias("doc_id")
    if model is None:
        out = docs.select(ids, F.lit(0.5).alias("score"), F.array().cast("array<long>").alias("evidence"))
    else:
        found = written(votes(docs.select(F.monotonically_increasing_id().alias("row"), ids, "text"), shared))
        # terms that no example has only lengthen a text's vector
        weight = (1 + F.log("c")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)
        others = (found.select("row", F.explode(F.arrays_zip("others", "counts")).alias("x"))
                  .select("row", F.col("x.others").alias("term"), F.col("x.counts").alias("c"))
                  .join(frequency, "term").groupBy("row").agg(F.sum(weight * weight).alias("rest")))
        rows = found.drop("others", "counts").join(others, "row", "left").withColumn(
            "known", F.when(F.col("square") > 0, F.col("square") / (F.col("square") + F.coalesce("rest", F.lit(0.0))))
            .otherwise(0.0))
        final = docs.sparkSession.sparkContext.broadcast(
            (model.by_whole, model.by_telling, model.steps, model.bare, model.prior))

        def run(batches):
            m = Model.__new__(Model)
            m.by_whole, m.by_telling, m.steps, m.bare, m.prior = final.value
            for batch in batches:
                score = m.score(*(batch.column(c).to_numpy() for c in ("toxic", "every", "known", "telling")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()),
                                                  batch.column("evidence")], ["doc_id", "score", "evidence"])

        out = rows.select("doc_id", "toxic", "every", "known", "telling", "evidence").mapInArrow(
            run, "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: toxicity of every document."""
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
