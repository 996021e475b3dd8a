"""Phrase collocation mining (13) over count streams in prefix and suffix order.

Phrases of one word up to ``max_words`` words are counted by language (first in chunks of many texts), and those of several words that are
too rare are dropped: every part of a frequent phrase is at least as frequent.  The counts then form two sorted streams:

* in *suffix order* (last word first) a phrase follows all phrases that it ends with.  One pass holds the open ones on a stack and
  hands each phrase the counts of its last words, and each open phrase the greatest count of its extensions to the left;
* in *prefix order* the same pass gives the counts of the first words and the extensions to the right.

The streams are range-partitioned and sorted (no hash of a key decides where it goes, so a word with very many phrases is spread
over as many partitions as it fills).  What a partition's first phrases need from partitions before it are their open
phrases at the end, at most ``max_words - 1`` a partition: these few rows, and the extensions that belong to them, are joined on.

Defined results: a null text is empty, a null language is ``und``; repeated rows count each time; words are never cut;
texts of any length are counted whole; an empty table gives no rows.  Only ``text`` and ``lang`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.llm.common import documents, partitions, text_chunks, written
from riskgrid.llm.textkernel import LOWER as FOLD
from riskgrid.llm.textkernel import BASE, ByteHashes, buffers, mixed

#: Contract of the query: words of a phrase, least count, share (hundredths) of an extension that absorbs, rows a language.
MAX_WORDS, LEAST, ABSORB_PCT, TOP = 3, 10, 50, 2000
SCALE = 1_000_000
#: Where pieces end, and the blanks between words.
ENDS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts that a language's phrases are ranked in before their best meet.
PARTS = 64

#: Kinds of bytes: 1 blank, 2 end of a piece, 0 part of a word.
KIND = np.zeros(256, np.int8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
#: Bytes of text that are counted at once in a task, and rows that go to Spark at once.
CHUNK, OUT_ROWS = 2 << 20, 1 << 15
#: Bits of the bitmap of frequent words and pairs (16 MB), and hashes that a task gathers before they move.
FILTER_BITS, HELD = 27, 3 << 20

COUNTS = "key string, a long"
STREAM = "lang string, phrase string, a long, ext long, left array<long>, right array<long>"
ROW, OPEN, BEFORE = 0, 1, 2


class Words:
    """The words of the texts of a chunk (no nulls in either array): ``start``, ``doc``, ``hash``, and ``more``, whether the next
    word follows in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = buffers(texts)
        data = FOLD[data]
        kind = KIND[data]
        inside = kind == 0
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edge = offsets[:-1][np.diff(offsets) > 0]           # a word never goes over from one text into the next
        begin[edge] = inside[edge]
        stop[edge[1:] - 1] = inside[edge[1:] - 1]
        self.data, self.inside = data, inside
        self.start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        # words of one piece have the same number of ends before them, and one text
        ends = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        self.more = np.zeros(len(self.start), bool)
        self.more[:-1] = (ends[1:] == ends[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.lang = langs.dictionary_encode()
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
                         for x in self.lang.dictionary.to_pylist()], np.uint64)
        self.hash = mixed(ByteHashes(data).of(self.start, end) ^ salt[self.lang.indices.to_numpy()[self.doc]]) if len(end) else np.zeros(0, np.uint64)

    def pairs(self) -> np.ndarray:
        """Hash of each word with the next one (only of use where ``more``)."""
        return mixed(self.hash * np.uint64(BASE) + np.roll(self.hash, -1))

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's place in the distinct words, and these."""
        at = np.concatenate((np.cumsum(self.inside, dtype=np.int32)[self.start] - 1, [np.count_nonzero(self.inside)])).astype(np.int32)
        found = pa.StringArray.from_buffers(len(self.start), pa.py_buffer(at), pa.py_buffer(self.data[self.inside])).dictionary_encode()
        # in the order of the words: phrases with the same beginning lie side by side, and take less space on their way
        order = pc.array_sort_indices(found.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank[found.indices.to_numpy()], found.dictionary.take(pa.array(order))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of about ``CHUNK`` bytes of text at a time."""
    held, size = [], 0

    def whole():
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return Words(rows.column("text"), rows.column("lang"))

    for batch in batches:
        for first, last in text_chunks(batch):
            held.append(batch.slice(first, last - first))
            size += pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0
            if size >= CHUNK:
                yield whole()
                held, size = [], 0
    if held:
        yield whole()


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    """Where in a bitmap a hash falls: by the lower 40 bits, scrambled by a factor."""
    return (h & np.uint64((1 << 40) - 1)) * np.uint64(BASE) >> np.uint64(64 - bits)


def _frequent(docs: DataFrame, least: int, bits: int = FILTER_BITS) -> Broadcast:
    """A bitmap of fixed size, set where the hash of a word or pair of words that occurs ``least`` times falls.  What isn't set is
    rarer for sure; what is set by chance is counted in vain."""
    buckets = 2 * partitions(docs)

    def packed(batches):
        # the hashes of a task, in sorted lists of five bytes each by bucket; more than least copies tell nothing new
        held, size = [], 0

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            h = np.repeat(h, np.minimum(n, least))
            bucket = (h >> np.uint64(40)).astype(np.int64) * buckets >> 24
            first = np.searchsorted(bucket, np.arange(buckets + 1))
            low = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :5]
            some = np.flatnonzero(np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(
                [low[first[i]:first[i + 1]].tobytes() for i in some], pa.binary())], ["bucket", "hashes"])

        for batch in batches:
            for words in _chunks([batch]):
                for h in (words.hash, words.pairs()[words.more]):
                    held.append(h)
                    size += len(h)
                if size >= HELD:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    def often(batches):
        # all lists of a bucket are consecutive
        at, held = None, []

        def out():
            raw = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 5)
            h = np.zeros((len(raw), 8), np.uint8)
            h[:, :5] = raw
            h, n = np.unique(h.view(np.uint64).ravel(), return_counts=True)
            place = _place(h[n >= least], bits)
            return pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(5)).astype(np.int32)), pa.array((place & np.uint64(31)).astype(np.int32))],
                                              ["cell", "bit"])

        for batch in batches:
            for bucket, hashes in zip(batch.column("bucket").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                if bucket != at:
                    if held:
                        yield out()
                    at, held = bucket, []
                held.append(hashes)
        if held:
            yield out()

    lists = _texts(docs).mapInArrow(packed, "bucket int, hashes binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    cells = (lists.mapInArrow(often, "cell int, bit int").groupBy("cell")
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("value")).toArrow())
    bitmap = np.zeros(1 << (bits - 5), np.uint32)           # at most so many cells come back
    bitmap[cells["cell"].to_numpy()] = cells["value"].to_numpy().astype(np.uint32)
    return docs.sparkSession.sparkContext.broadcast(bitmap)


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """``lang, phrase, a``: how often each phrase of up to ``max_words`` words occurs within pieces, for phrases of at least ``least``
    occurrences; an empty phrase has the number of all words of its language.

    Texts are read twice: once for a bitmap of the frequent words and pairs, once to count the phrases whose words and pairs
    are all in it.  The counts are exact."""
    often = _frequent(docs, least)
    bits = len(often.value).bit_length() + 4

    def run(batches):
        for words in _chunks(batches):
            for langs, phrases, n in counts(words):
                # one text as the key: a phrase has no tab
                batch = pa.RecordBatch.from_arrays([pc.binary_join_element_wise(phrases, langs, "\t"), n], ["key", "a"])
                yield from (batch.slice(i, OUT_ROWS) for i in range(0, len(batch), OUT_ROWS))

    def counts(words):
        def known(h):
            place = _place(h, bits)
            return (often.value[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & 1 == 1

        lang = words.lang.indices.to_numpy().astype(np.int64)[words.doc]
        langs = words.lang.dictionary
        n = np.bincount(lang, minlength=len(langs))
        yield langs, pa.array([""] * len(langs), pa.string()), pa.array(n)
        word, spelt = words.ids()
        where = np.flatnonzero(known(words.hash))           # first words of the phrases
        key = lang[where]
        pair = known(words.pairs()) & words.more
        for m in range(1, max_words + 1):
            if m > 1:                                       # one word longer
                longer = pair[where + m - 2]
                where, key = where[longer], key[longer]
            if not len(where):
                return
            _, first, key, n = np.unique(key * len(spelt) + word[where + m - 1], return_index=True, return_inverse=True, return_counts=True)
            at = where[first]
            phrase = pc.binary_join_element_wise(*(spelt.take(pa.array(word[at + i])) for i in range(m)), " ")
            yield langs.take(pa.array(lang[at])), phrase, pa.array(n)

    phrase = F.substring_index("key", "\t", 1)
    return (_texts(docs).mapInArrow(run, COUNTS).groupBy("key").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (phrase == ""))
            .select(F.expr("substring(key, locate('\t', key) + 1)").alias("lang"), phrase.alias("phrase"), "a"))


def _with_place(array: str, place: int, value: Column) -> Column:
    return F.transform(array, lambda x, i: F.when(i == place - 1, value).otherwise(x))


def _pass(stream: DataFrame, side: str, max_words: int, parts: int) -> DataFrame:
    """``STREAM`` with ``left`` (``right``) filled: the counts of the phrase's first (last) 1, 2, .. words, and ``ext`` raised to
    the greatest count of a phrase that continues it on the other side."""
    backwards = side == "right"
    w = F.split("phrase", " ")
    keys = [F.try_element_at(w, F.lit(-i if backwards else i)) for i in range(1, max_words)]
    keys = ["lang", *keys, F.try_element_at(w, F.lit(-max_words if backwards else max_words))]
    names = [c.split()[0] for c in STREAM.split(", ")] + ["kind"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int8()]

    def run(batches):
        # open phrases: [lang, words, row], each a beginning (end) of the next
        stack, out, before = [], [], {}

        def close():
            out.append(stack.pop()[2])

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
                zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in names[:-1]]
            for lang, phrase, a, ext, left, right in zip(*cols, strict=True):
                words = phrase.split(" ")
                if backwards:
                    words.reverse()
                while stack and (stack[-1][0] != lang or stack[-1][1] != words[:len(stack[-1][1])]):
                    close()
                counts = [None] * (len(words) - 1)
                for _, held, row in stack:
                    counts[len(held) - 1] = row[2]
                if len(words) > 1:
                    if stack and len(stack[-1][1]) == len(words) - 1:
                        stack[-1][2][3] = max(stack[-1][2][3], a)
                    else:                       # it opened in a partition before this one
                        part = (lang, " ".join(words[-2::-1] if backwards else words[:-1]))
                        before[part] = max(before.get(part, 0), a)
                row = [lang, phrase, a, ext, left, counts, ROW] if backwards else [lang, phrase, a, ext, counts, right, ROW]
                stack.append((lang, words, row))
            if out:
                yield made()
        for lang, _, row in stack:
            out.append([lang, row[1], row[2], 0, None, None, OPEN])
        while stack:
            close()
        out.extend([lang, part, 0, ext, None, None, BEFORE] for (lang, part), ext in before.items())
        yield made()

    passed = written(stream.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, STREAM + ", kind byte"))
    opened = passed.where(F.col("kind") == OPEN)
    more = passed.where(F.col("kind") == BEFORE).groupBy("lang", "phrase").agg(F.max("ext").alias("more"))
    # both have at most max_words - 1 rows for each of the stated number of partitions
    rows = passed.where(F.col("kind") == ROW).drop("kind").join(F.broadcast(more), ["lang", "phrase"], "left")
    rows = rows.withColumn("ext", F.greatest("ext", F.coalesce("more", F.lit(0)))).drop("more")
    for i in range(1, max_words):
        lacks = F.try_element_at(side, F.lit(i)).isNull() & (F.size(side) >= i)
        own = F.slice(w, F.size(w) - (i - 1), i) if backwards else F.slice(w, 1, i)
        rows = rows.withColumn("part", F.when(lacks, F.array_join(own, " ")))
        found = opened.select(F.col("lang").alias("l"), F.col("phrase").alias("part"), F.col("a").alias("found"))
        rows = (rows.join(F.broadcast(found), (F.col("lang") == F.col("l")) & (rows["part"] == found["part"]), "left")
                .withColumn(side, F.when(F.col("found").isNotNull(), _with_place(side, i, F.col("found"))).otherwise(F.col(side)))
                .select(*names[:-1]))
    return rows


def mine(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, absorb_pct: int = ABSORB_PCT,
         top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``max_words`` words that occur at least
    ``least`` times and in no longer such phrase with ``absorb_pct`` hundredths of their count.  ``score`` is the least
    over the cuts of ``floor(SCALE * a * a / (l * r))``, exact."""
    parts = partitions(docs)
    counts = written(phrase_counts(docs, max_words, least))
    n = counts.where("phrase = ''").select("lang", F.col("a").alias("n"))
    none = F.lit(None).cast("array<long>")
    stream = counts.where("phrase <> ''").select("lang", "phrase", "a", F.lit(0).cast("long").alias("ext"), none.alias("left"), none.alias("right"))
    rows = _pass(_pass(stream, "right", max_words, parts), "left", max_words, parts)
    m = F.size("left") + 1
    cuts = []
    for k in range(1, max_words):
        left, right = F.try_element_at("left", F.lit(k)), F.try_element_at("right", m - k)
        score = F.call_function("div", F.col("a").cast("decimal(19,0)") * F.col("a").cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(7,0)"),
                                left.cast("decimal(19,0)") * right.cast("decimal(19,0)"))
        cuts.append(F.when(k < m, F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))))
    longer = (F.col("ext") >= least) & (100 * F.col("ext") >= absorb_pct * F.col("a"))
    scored = (rows.where((m > 1) & ~longer).withColumn("cut", F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull())))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of a language by parts first: no task sorts a whole language
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: collocations of every language of ``documents``."""
    return mine(documents(spark, sf_dir))


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ENDS}')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '{BLANKS}'), lambda x: x <> '') AS w FROM pieces),
counts AS (
  SELECT lang, m, phrase, count(*) AS a FROM (
    SELECT lang, 1 AS m, unnest(w) AS phrase FROM words
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words)
  GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM counts WHERE m = 1 GROUP BY lang),
found AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, a FROM counts WHERE m > 1 AND a >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM found)),
scores AS (
  SELECT c.lang, c.phrase, c.a, f.a AS l, s.a AS r,
         (1000000::HUGEINT * c.a * c.a) // (f.a::HUGEINT * s.a) AS score
  FROM cuts c JOIN counts f ON f.lang = c.lang AND f.phrase = c.first JOIN counts s ON s.lang = c.lang AND s.phrase = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM scores s WHERE NOT EXISTS (
    SELECT 1 FROM found t WHERE t.m = 3 AND t.lang = s.lang AND 100 * t.a >= 50 * s.a
      AND (s.phrase = t.w[1] || ' ' || t.w[2] OR s.phrase = t.w[2] || ' ' || t.w[3])))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
