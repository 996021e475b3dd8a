"""Suffix-array dedup (1): every byte covered by a repeated string of a ``Span``'s bytes is removed.

Suffix arrays are built by shard, so equal strings must meet in one shard.  Each window of ``span.bytes`` of a text
is owned by its *anchor*, the gram (``span.gram`` bytes) of least hash in it: equal windows have equal anchors at
equal offsets.  The windows of one anchor form a segment (its text is the span longer than the
count of windows, less one).  Then

1. equal segments are collapsed before anything else moves (copies, however many, leave one row, and
   all windows of a segment met twice are repeats);
2. an anchor with a single distinct segment is done;
3. the distinct segments of the other anchors are gathered by anchor into shards of about
   ``SHARD_BYTES``; a suffix array by induced sorting and its permuted common prefixes give the
   windows that occur elsewhere in the shard;
4. an anchor with over ``HOT`` distinct segments, or over ``HOT_BYTES`` of them (a passage that very many texts share, in different
   surroundings) isn't gathered: its segments are cut at a finer grid of offsets and keyed by
   the bytes common to all windows of a grid cell, and the procedure starts again with those, down to
   single windows, where equal means collapsed.

Texts are read where they lie; only anchors, the texts of step 3, and at the end the removed ranges and the texts
meet in shuffles.

Defined results: a null text is empty, texts shorter than the span keep everything; repeated rows are each
other's repeats; rows with a null ``doc_id`` or one ``doc_id`` for several texts are told apart by their text;
an empty table gives no rows.  Only ``doc_id`` and ``text`` are read (``without_repeats`` carries all columns
along and drops remains of characters that a cut went through; its null texts stay null).  A text's arrays take
about 60 times its bytes in a task.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from riskgrid.llm.common import documents, sized_broadcast, text_chunks, tidy, written
from riskgrid.llm.suffixarray import repeats
from riskgrid.llm.textkernel import ByteHashes, buffers, mixed


class Span(NamedTuple):
    """Bytes of a string that must not occur twice, of the grams that anchor it, and window offsets in a grid cell
    by level of step 4 (level 0 takes all windows of an anchor)."""

    bytes: int
    gram: int
    cells: tuple[int, ...]


#: Contract of op1, and the shorter passages (about 40 words) that a pipeline looks for.
CONTRACT, PASSAGE = Span(400, 128, (400, 18, 1)), Span(200, 64, (200, 14, 1))
SHARD_BYTES = 1 << 19
HOT, HOT_BYTES = 2000, 1 << 19

KEY = ["doc_id", "text_hash"]
#: ``start``: the first window's place in the text; ``windows``: how many; ``offset``: from it to the anchor;
#: ``n``: occurrences that the row stands for.
SEGMENTS = "anchor long, digest long, doc_id long, text_hash long, start long, windows int, offset int, n long"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values)
    pad = -n % width
    block = np.concatenate((values, np.full(pad, np.iinfo(values.dtype).max, values.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def segments(data: np.ndarray, offsets: np.ndarray, span: Span = CONTRACT) -> dict[str, np.ndarray]:
    """The segments of a chunk of texts: ``text`` (row), ``anchor, digest, start, windows, offset``."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < span.bytes:
        return dict.fromkeys(("text", "start", "windows", "offset", "anchor", "digest"), none)
    size, gram = span.bytes, span.gram
    hashes = ByteHashes(data)
    at = np.arange(n - gram + 1)
    grams = hashes.of(at, at + gram)
    # the least hash, and the leftmost of equal ones
    ranked = grams & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64)
    owner = (_sliding_min(ranked, size - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(owner)), side="right") - 1
    inside = np.arange(len(owner)) + size <= offsets[text + 1]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    hi = np.flatnonzero(stop)
    anchor = owner[lo]
    offset = anchor - lo
    digest = mixed(hashes.of(lo, hi + size) + offset.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return {"text": text[lo], "start": lo - offsets[text[lo]], "windows": hi - lo + 1, "offset": offset,
            "anchor": grams[anchor].view(np.int64), "digest": digest.view(np.int64)}


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def all_segments(docs: DataFrame, span: Span = CONTRACT) -> DataFrame:
    """``SEGMENTS`` of every text, one row an occurrence."""
    names = [c.split()[0] for c in SEGMENTS.split(", ")]

    def run(batches):
        for batch in batches:
            for first, last in text_chunks(batch):
                part = batch.slice(first, last - first)
                s = segments(*buffers(part.column("text").fill_null("")), span)
                row = pa.array(s["text"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s["anchor"]), pa.array(s["digest"]), part.column("doc_id").take(row),
                     part.column("text_hash").take(row), pa.array(s["start"]), pa.array(s["windows"].astype(np.int32)),
                     pa.array(s["offset"].astype(np.int32)), pa.array(np.ones(len(row), np.int64))], names)

    return keyed(docs).mapInArrow(tidy(run), SEGMENTS)


def _with_bytes(docs: DataFrame, wanted: DataFrame, span: Span) -> DataFrame:
    """``wanted`` (segments) with their ``bytes``, once for each row that a text has.  Only texts that have some
    are moved."""
    by_text = wanted.groupBy(*KEY).agg(F.collect_list(F.struct(
        "anchor", "digest", "start", "windows", "offset", "n")).alias("segments"))
    ids = wanted.select("doc_id").distinct()
    some = keyed(docs).join(sized_broadcast(ids, ids.count()).withColumnRenamed("doc_id", "id"),
                            F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    matched = some.alias("t").join(by_text.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id"))
                                  & (F.col("t.text_hash") == F.col("s.text_hash")))
    return (matched.select("t.doc_id", "t.text_hash", F.encode("t.text", "utf-8").alias("raw"),
                           F.explode("s.segments").alias("s"))
            .select("doc_id", "text_hash", "s.*",
                    F.expr(f"substring(raw, cast(s.start + 1 as int), s.windows + {span.bytes - 1})").alias("bytes")))


def _sharded(gathered: DataFrame, span: Span) -> DataFrame:
    """``doc_id, text_hash, first, last`` (bytes, last excluded): ranges of single segments with a repeat."""
    def run(batches):
        held, size = [], 0

        def shard():
            found = repeats([h[6] for h in held], span.bytes)
            out = []
            for (_, n, doc_id, text_hash, start, windows, *_), hit in zip(held, found, strict=True):
                if n > 1:
                    continue                               # known to be a repeat as a whole
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[:windows], [0])).astype(np.int8)))
                out += [(doc_id, text_hash, start + int(a), start + int(b) - 1 + span.bytes)
                        for a, b in zip(edge[::2], edge[1::2], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)],
                                              ["doc_id", "text_hash", "first", "last"])

        for batch in batches:
            cols = ("anchor", "n", "doc_id", "text_hash", "start", "windows", "bytes", "digest")
            for row in zip(*(batch.column(c).to_pylist() for c in cols), strict=True):
                if held and (row[0], row[7]) == (held[-1][0], held[-1][7]):
                    continue                               # of a repeated row
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield shard()
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield shard()

    return (gathered.select("anchor", "n", *KEY, "start", "windows", "bytes", "digest")
            .repartition("anchor").sortWithinPartitions("anchor", "digest")
            .mapInArrow(tidy(run), "doc_id long, text_hash long, first long, last long"))


def _finer(gathered: DataFrame, cell: int, span: Span) -> DataFrame:
    """Segments cut at a grid of window offsets: the key is what all windows of a cell have in common."""
    names = [c.split()[0] for c in SEGMENTS.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                raw = rows.column("bytes")
                data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
                base = np.concatenate(([0], np.cumsum([len(x.as_py()) for x in raw])))
                windows = rows.column("windows").to_numpy(zero_copy_only=False).astype(np.int64)
                offset = rows.column("offset").to_numpy(zero_copy_only=False).astype(np.int64)
                # a window's place on the grid: how far its start lies before the anchor
                high, low = offset, offset - windows + 1
                first, last = low // cell, high // cell
                row = np.repeat(np.arange(len(windows)), last - first + 1)
                c = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
                top, bottom = np.minimum(high[row], c * cell + cell - 1), np.maximum(low[row], c * cell)
                lo, hi = offset[row] - top, offset[row] - bottom          # first and last window in the segment
                hashes = ByteHashes(data)
                salt = mixed(rows.column("anchor").to_numpy(zero_copy_only=False).view(np.uint64)[row]
                             + c.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(cell))
                # from the cell's last window's start to its first window's end
                core_lo, core_hi = offset[row] - c * cell, offset[row] - (c * cell + cell - 1) + span.bytes
                key = mixed(hashes.of(base[row] + core_lo, base[row] + core_hi) ^ salt)
                digest = mixed(hashes.of(base[row] + lo, base[row] + hi + span.bytes)
                               + top.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                start = rows.column("start").to_numpy(zero_copy_only=False)[row] + lo
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), rows.column("doc_id").take(take),
                     rows.column("text_hash").take(take), pa.array(start), pa.array((hi - lo + 1).astype(np.int32)),
                     pa.array(top.astype(np.int32)), rows.column("n").take(take)], names)

    return gathered.dropDuplicates(["anchor", "digest"]).mapInArrow(tidy(run), SEGMENTS)


def _resolve(docs: DataFrame, found: DataFrame, span: Span, level: int = 0) -> list[DataFrame]:
    """Ranges to remove (``doc_id, text_hash, first, last``) of written segments."""
    first = [F.first(c).alias(c) for c in ("doc_id", "text_hash", "start", "windows", "offset")]
    distinct = found.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), *first)
    copies = found.where("n = 1").join(distinct.where("n > 1").select("anchor", "digest"), ["anchor", "digest"])
    out = [copies.select(*KEY, F.col("start").alias("first"),
                         (F.col("start") + F.col("windows") - 1 + span.bytes).alias("last"))]
    # at the last level all windows of a key are equal: nothing is open there
    sizes = F.count(F.lit(1)), F.sum(F.col("windows") + (span.bytes - 1))
    by_anchor = distinct.groupBy("anchor").agg(sizes[0].alias("segments"), ((sizes[0] > HOT) | (sizes[1] > HOT_BYTES)).alias("hot"))
    open_rows = written(distinct.join(by_anchor.where("segments > 1").drop("segments"), "anchor"))
    n_open, n_hot = open_rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("hot"), 1))).first()
    if n_open > n_hot:
        out.append(_sharded(_with_bytes(docs, open_rows.where(~F.col("hot")).drop("hot"), span), span))
    if n_hot:
        gathered = _with_bytes(docs, open_rows.where("hot").drop("hot"), span)
        out += _resolve(docs, written(_finer(gathered, span.cells[level + 1], span)), span, level + 1)
    return out


def repeated_ranges(docs: DataFrame, span: Span = CONTRACT) -> DataFrame:
    """``doc_id, text_hash, first, last``: byte ranges covered by repeated strings (they may overlap)."""
    parts = _resolve(docs, written(all_segments(docs, span)), span)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return written(out)


def _cut(docs: DataFrame, carry: list[str], columns: list[StructField], cut, span: Span) -> DataFrame:
    """``carry`` columns of ``docs`` and what ``cut(text bytes, keep mask)`` makes of each text."""
    ranges = (repeated_ranges(docs, span).distinct().groupBy(*KEY)
              .agg(F.collect_list(F.struct("first", "last")).alias("__ranges")))
    rows = docs.withColumn("__hash", F.xxhash64("text")).alias("d")
    joined = rows.join(ranges.alias("r"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id"))
                       & (F.col("d.__hash") == F.col("r.text_hash")), "left")
    schema = StructType([docs.schema[c] for c in carry] + columns)

    def run(batches):
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("__text"), batch.column("__ranges"), strict=True):
                raw = text.as_py().encode() if text.is_valid else b""
                edge = np.zeros(len(raw) + 1, np.int32)
                if ranges.is_valid:
                    r = ranges.values
                    np.add.at(edge, r.field("first").to_numpy(), 1)
                    np.add.at(edge, r.field("last").to_numpy(), -1)
                out.append(cut(text.as_py(), np.frombuffer(raw, np.uint8), np.cumsum(edge[:-1]) == 0))
            made = [pa.array([r[i] for r in out], k) for i, k in enumerate(
                [{"bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in columns])]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"__{i}") for i in range(len(carry))), *made], schema.names)

    return joined.select(*(F.col(f"d.{c}").alias(f"__{i}") for i, c in enumerate(carry)),
                         F.col("d.text").alias("__text"), "__ranges").mapInArrow(tidy(run), schema)


def removed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` by row."""
    def cut(_, raw, keep):
        spans = int(np.count_nonzero(~keep[1:] & keep[:-1])) + int(len(keep) > 0 and not keep[0])
        return len(raw), int(len(raw) - keep.sum()), spans, hashlib.sha256(raw[keep].tobytes()).hexdigest()

    columns = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [
        StructField("kept_sha256", StringType())]
    return _cut(docs.select("doc_id", "text"), ["doc_id"], columns, cut, CONTRACT)


def without_repeats(docs: DataFrame, span: Span = CONTRACT, least_words: int = 0) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``, all other columns as they are.  A run of repeated bytes (the union
    of all that overlap) with fewer than ``least_words`` words, whole or in part, stays."""
    def cut(text, raw, keep):
        if least_words and not keep.all():
            keep = keep.copy()
            edge = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if len(raw[a:b].tobytes().split()) < least_words:
                    keep[a:b] = True
        return (text if keep.all() else raw[keep].tobytes().decode("utf-8", "ignore"),)

    rest = [c for c in docs.columns if c != "text"]
    return _cut(docs, rest, [StructField("text", StringType())], cut, span).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: what is left of every document."""
    return removed(documents(spark, sf_dir))
