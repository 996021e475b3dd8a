"""Hard-negative mining (11) by vertical scans with branch and bound over the dimensions (BOND).

Vectors of integers lie in blocks of up to ``BLOCK`` rows, column by column (a row for each dimension of a block, with its
least and greatest value; rows sorted by label, so that equal labels are a range).  For an anchor, a block's
columns are read in descending magnitude of the anchor's own components.  What the unread dimensions can still add lies between
the sums of their least and greatest contributions; with the partial scores these bound every candidate, and the
bitmap of candidates shrinks until the scores of what is left are exact.

1. *Positives*: the best rows of the anchor's label.  A candidate goes once it can't reach the last place found so far.
2. *Negatives*: each positive gives a window of scores.  A candidate goes once it misses every window, or can't reach the
   last place of those it may fall in; candidates that are certain to lie in a window raise that place.

Anchors (a stated share of the rows) meet all rows in cells of a grid: groups of at most ``GROUP`` anchors x slices of
the blocks.  A task streams the blocks of its cells past one group, so its memory is bounded by a group and a block; a cell
returns at most the asked number of rows for an anchor or window, and the cells' rows are merged by anchor.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; a shorter
vector has zeros for the missing dimensions (an empty one only zeros); the anchor's *other* rows have another id; repeated rows
are rows of their own (ties between them can't be told apart), a repeated anchor's lists are returned once for each
of its rows; an empty table gives no rows; extra columns are not read.  Scores past 62 bits raise an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.llm.common import partitions, written

#: Rows of a block, anchors of a group, and dimensions read between two looks at the bounds (the last for all others).
BLOCK, GROUP, STEPS = 4096, 32_768, (8, 8, 16, 16, 32)
#: Contract of the query: positives and negatives an anchor, and the window in hundredths of the positive's score.
POSITIVES, NEGATIVES, LEAST_PCT, MOST_PCT = 5, 10, 30, 90

PARTS = "block long, dim int, n int, data binary, low long, high long"
LOWEST = np.iinfo(np.int64).min + 1          # its negative is a number too
NO_ID = np.iinfo(np.int64).max


def usable(rows: DataFrame, vec_id: str, vector: str, label: Column | str, scale: int) -> DataFrame:
    """``id, label, q`` of the rows that take part; ``q`` holds ``floor(scale * x)``."""
    q = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    label = F.col(label) if isinstance(label, str) else label
    return (rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
            .select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), q.alias("q"))
            .where(F.col("label").isNotNull()))


def _narrow(column: np.ndarray, low: int, high: int) -> bytes:
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return column.astype(kind).tobytes()
    return column.tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // n])


def blocks(rows: DataFrame) -> DataFrame:
    """``PARTS`` of ``usable`` rows: a row for each dimension of a block; dims -2 and -1 are ids and labels."""
    names = [c.split()[0] for c in PARTS.split(", ")]

    def parts(block: int, ids, labels, flat, sizes) -> pa.RecordBatch:
        order = np.lexsort((ids, labels))
        q = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
        q[np.arange(q.shape[1]) < sizes[:, None]] = flat
        out = [(block, -2, len(ids), ids[order].tobytes(), 0, 0), (block, -1, len(ids), labels[order].tobytes(), 0, 0)]
        for d in range(q.shape[1]):
            column = q[order, d]
            low, high = int(column.min()), int(column.max())
            out.append((block, d, len(ids), _narrow(column, low, high), low, high))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
            zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names)

    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def packed():
            return parts(block, *(np.concatenate(c) for c in zip(*held, strict=True)))

        for batch in batches:
            for i in range(0, len(batch), BLOCK):
                part = batch.slice(i, BLOCK)
                q = part.column("q")
                sizes = np.diff(q.offsets.to_numpy()).astype(np.int64)
                if n + len(part) > BLOCK:
                    yield packed()
                    block, held, n = block + 1, [], 0
                held.append((part.column("id").to_numpy(), part.column("label").to_numpy(),
                             q.flatten().to_numpy(zero_copy_only=False), sizes))
                n += len(part)
        if n:
            yield packed()

    return rows.mapInArrow(run, PARTS)


class Block:
    """The columns of a block."""

    def __init__(self, parts: list[dict]):
        # the order of parts: ids, labels, then the dimensions
        self.key, n = parts[0]["block"], parts[0]["n"]
        self.ids, self.labels = (np.frombuffer(p["data"], np.int64) for p in parts[:2])
        self.columns = [_wide(p["data"], n) for p in parts[2:]]
        self.low = np.array([p["low"] for p in parts[2:]], np.int64)
        self.high = np.array([p["high"] for p in parts[2:]], np.int64)

    def range_of(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, side="right"))

    def scan(self, q: np.ndarray, candidates: np.ndarray, rule) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``candidates`` (a bitmap) that ``rule(least, most)`` never drops, and their scores."""
        d = min(len(q), len(self.columns))
        q, low, high = q[:d], self.low[:d], self.high[:d]
        if d and float(np.abs(q).max()) * float(max(np.abs(low).max(), np.abs(high).max())) * d >= 2.0 ** 62:
            raise OverflowError("scores pass 62 bits")
        order = np.argsort(-np.abs(q), kind="stable")
        a, b = q[order] * low[order], q[order] * high[order]
        # what the dimensions from a place on can add, at least and at most
        least = np.concatenate((np.cumsum(np.minimum(a, b)[::-1])[::-1], [0]))
        most = np.concatenate((np.cumsum(np.maximum(a, b)[::-1])[::-1], [0]))
        rows, at, step = np.flatnonzero(candidates), 0, 0
        score = np.zeros(len(rows), np.int64)
        while at < d and len(rows):
            upto = min(d, at + STEPS[min(step, len(STEPS) - 1)])
            for i in order[at:upto]:
                if q[i]:
                    score += q[i] * self.columns[i][rows].astype(np.int64)
            at, step = upto, step + 1
            if at < d:
                stay = rule(score + least[at], score + most[at])
                rows, score = rows[stay], score[stay]
        return rows, score


def _kth(values: np.ndarray, k: int) -> int:
    """The k-th greatest value; the lowest number if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else LOWEST


def _merged(scores: np.ndarray, ids: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
    """Puts new rows into the sorted best ones (in place): score descending, id ascending."""
    s, i = np.concatenate((scores, score)), np.concatenate((ids, vec_id))
    order = np.lexsort((i, -s))[:len(scores)]
    scores[:], ids[:] = s[order], i[order]


class Positives:
    """The best other rows of each anchor's label, as blocks stream by."""

    schema = "key long, score long, other long"

    def __init__(self, anchors: list[dict], k: int):
        self.anchors, self.k = anchors, k
        self.q = [np.array(a["q"], np.int64) for a in anchors]
        self.scores = np.full((len(anchors), k), LOWEST, np.int64)
        self.ids = np.full((len(anchors), k), NO_ID, np.int64)

    def meet(self, block: Block) -> None:
        for i, a in enumerate(self.anchors):
            first, last = block.range_of(a["label"])
            if first == last:
                continue
            own = np.zeros(len(block.ids), bool)
            own[first:last] = block.ids[first:last] != a["id"]
            found = int(self.scores[i, -1])
            rows, score = block.scan(self.q[i], own, lambda lo, hi, t=found: hi >= max(t, _kth(lo, self.k)))
            good = score >= found
            if good.any():
                _merged(self.scores[i], self.ids[i], score[good], block.ids[rows[good]])

    def rows(self) -> Iterator[tuple]:
        for i, a in enumerate(self.anchors):
            for score, other in zip(self.scores[i].tolist(), self.ids[i].tolist(), strict=True):
                if score != LOWEST:
                    yield a["key"], score, other


class Negatives:
    """The best rows of other labels inside each positive's window, as blocks stream by."""

    schema = "key long, place int, score long, other long"

    def __init__(self, anchors: list[dict], k: int):
        self.anchors, self.k = anchors, k
        self.q = [np.array(a["q"], np.int64) for a in anchors]
        self.windows = [np.array(a["windows"], np.int64).reshape(-1, 2) for a in anchors]
        self.scores = [np.full((len(w), k), LOWEST, np.int64) for w in self.windows]
        self.ids = [np.full((len(w), k), NO_ID, np.int64) for w in self.windows]

    def meet(self, block: Block) -> None:
        for i, a in enumerate(self.anchors):
            first, last = block.range_of(a["label"])
            bounds, scores = self.windows[i], self.scores[i]
            if last - first == len(block.ids) or not len(bounds):
                continue
            other = np.ones(len(block.ids), bool)
            other[first:last] = False

            def rule(lo, hi, bounds=bounds, scores=scores):
                stay = np.zeros(len(lo), bool)
                for (least, most), found in zip(bounds, scores[:, -1], strict=True):
                    sure = (lo >= least) & (hi <= most)
                    stay |= (hi >= max(least, found, _kth(lo[sure], self.k))) & (lo <= most)
                return stay

            rows, score = block.scan(self.q[i], other, rule)
            for w, (least, most) in enumerate(bounds.tolist()):
                good = (score >= max(least, int(scores[w, -1]))) & (score <= most)
                if good.any():
                    _merged(scores[w], self.ids[i][w], score[good], block.ids[rows[good]])

    def rows(self) -> Iterator[tuple]:
        for i, a in enumerate(self.anchors):
            for w in range(len(self.windows[i])):
                for score, other in zip(self.scores[i][w].tolist(), self.ids[i][w].tolist(), strict=True):
                    if score != LOWEST:
                        yield a["key"], w, score, other


def _met(anchors: DataFrame, parts: DataFrame, groups: int, kind: type, k: int) -> DataFrame:
    """``kind.schema`` rows of every cell.  ``anchors``: ``key, id, label, q, windows``."""
    slices = max(1, -(-2 * partitions(parts) // groups))
    cell = f"cast(grp * {slices} + slice as int) cell"
    left = (anchors.withColumn("grp", F.pmod(F.xxhash64("key"), F.lit(groups)))
            .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))))
    right = (parts.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)))
             .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    both = left.selectExpr(cell, "key", "id", "label", "q", "windows").unionByName(
        right.selectExpr(cell, "block", "dim", "n", "data", "low", "high"), allowMissingColumns=True)
    names = [c.split()[0] for c in kind.schema.split(", ")]

    def run(batches):
        at, anchors, state, part = None, [], None, []

        def out():
            rows = list(state.rows()) if state else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if n == "place" else pa.int64())
                                                  for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != at or (part and r["block"] != part[0]["block"]):
                    if part and state:
                        state.meet(Block(part))
                    part = []
                if r["cell"] != at:
                    yield from out()
                    at, anchors, state = r["cell"], [], None
                if r["block"] is None:
                    anchors.append(r)
                elif anchors:
                    state = state or kind(anchors, k)
                    part.append(r)
        if part and state:
            state.meet(Block(part))
        yield from out()

    return (both.repartition(groups * slices, "cell").sortWithinPartitions("cell", F.col("block").asc_nulls_first(), "dim")
            .mapInArrow(run, kind.schema))


def mine(rows: DataFrame, every: int, positives: int = POSITIVES, negatives: int = NEGATIVES,
         least_pct: int = LEAST_PCT, most_pct: int = MOST_PCT) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``usable`` whose id is
    divisible by ``every``: for each of an anchor's first ``positives`` rows of its label, the first ``negatives`` rows
    of other labels with a score from ``least_pct`` to ``most_pct`` hundredths of the positive's."""
    parts = written(blocks(rows))
    anchors = written(rows.where(F.col("id") % every == 0).withColumn("key", F.monotonically_increasing_id()))
    groups = max(1, -(-anchors.count() // GROUP))
    found = _met(anchors.withColumn("windows", F.lit(None).cast("array<array<bigint>>")), parts, groups, Positives, positives)
    best = Window.partitionBy("key").orderBy(F.desc("score"), "other")
    chosen = written(found.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives))
    # the window in whole numbers: its least score rounded up, its greatest down (Python's floor division isn't Spark's div)
    least = (F.lit(0) - F.floor(-F.col("score").cast("decimal(20,0)") * least_pct / 100)).cast("long")
    most = F.floor(F.col("score").cast("decimal(20,0)") * most_pct / 100).cast("long")
    windows = (chosen.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", least.alias("least"), most.alias("most")))).alias("w"))
               .select("key", F.transform("w", lambda w: F.array(w["least"], w["most"])).alias("windows")))
    ranked = _met(anchors.join(windows, "key"), parts, groups, Negatives, negatives)
    best = Window.partitionBy("key", "place").orderBy(F.desc("score"), "other")
    ranked = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return (ranked.withColumnsRenamed({"other": "negative_id", "score": "negative_score"})
            .join(chosen.withColumnsRenamed({"other": "positive_id", "score": "positive_score"}), ["key", "place"])
            .join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: hard negatives of every hundredth vector among all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(rows, "vec_id", "embedding", label, scale=256), every=100)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.k, a.vec_id AS anchor_id, b.k AS bk, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, other_id) AS place FROM s WHERE same
  QUALIFY place <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.k, p.place ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.k = s.k AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
"""
