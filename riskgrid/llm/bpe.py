"""BPE encoding and decoding (3): a streaming transducer with bounded lookahead.

``sufficient_lookahead`` bounds, from the merge list alone, how far to the right a token boundary can
depend on the text.  The transducer reads bytes of a pretoken, merges a window, emits the tokens that
end before the lookahead and drops them, so it needs constant memory for any length.  Pretokens are
encoded once per chunk and worker (a bounded memo).  Decoding turns ids into bytes and bytes into text by an
incremental state machine that holds at most one unfinished character.

Defined results: a null text is empty and gives no ids; ids and text are those of the tokenizers library
with the same file (special tokens recognised in the text); repeated rows are encoded alike; an empty
table gives no rows.  Only ``doc_id`` and ``text`` are read (``encode_rows`` carries columns along).
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from riskgrid.llm.common import SLIM_BYTES, documents, give_back, text_chunks, worker_table
from riskgrid.llm.pretokens import Pretokens, byte_letters, flattened, token_bytes, vocabulary
from riskgrid.llm.textkernel import buffers

#: Bytes that a window holds besides the lookahead, and pretokens that a worker remembers.
WINDOW, MEMO = 4096, 400_000


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Merges:
    """The merge list of a tokenizer file as pairs of ids in order of rank."""

    def __init__(self, path: str):
        spec = vocabulary(path)
        ids = spec["vocab"]
        self.special = spec["special"]
        self.byte_ids = [0] * 256
        for letter, b in byte_letters().items():
            self.byte_ids[b] = ids[letter]
        #: rank and new id in one number
        self.packed = {(ids[a], ids[b]): r << 32 | ids[a + b] for r, (a, b) in enumerate(spec["merges"])}
        self.bytes = {i: token_bytes(t) for t, i in ids.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}

    @property
    def rules(self) -> list[tuple[bytes, bytes]]:
        """The merged strings, in order of rank."""
        return [(self.bytes[a], self.bytes[b]) for a, b in sorted(self.packed, key=self.packed.__getitem__)]

    def merge(self, data: bytes) -> list[int]:
        """The ids of a byte string: always the leftmost pair of the lowest rank first."""
        ids = [self.byte_ids[b] for b in data]
        return self._short(ids) if len(ids) <= 64 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get, none = self.packed.get, 1 << 62
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [best & 0xFFFFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        n, packed = len(ids), self.packed
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(packed[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in packed]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            new, j = best & 0xFFFFFFFF, after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := packed.get((new, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (p, i, new, ids[after[j]]))
            if (h := before[i]) >= 0 and (p := packed.get((ids[h], new))) is not None:
                heapq.heappush(heap, (p, h, ids[h], new))
        return [x for x in ids if x >= 0]


@worker_table
def merges(path: str) -> Merges:
    return Merges(path)


def sufficient_lookahead(rules: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a boundary that can still move it.

    Cutting a text changes a merge only if an earlier (lower-ranked) changed merge overlaps it.  ``reach`` of a rule
    bounds the distance from the start of a changed merge by it to the cut: its own length, or that
    of an earlier rule whose product overlaps its own, shifted by where that product starts.
    """
    starts: dict[bytes, int] = defaultdict(int)     # reach of rules whose product starts so
    whole: dict[bytes, int] = {}                    # ... is that
    inside: dict[bytes, int] = defaultdict(int)     # ... has that inside or at its end, less its offset
    most = 1
    for a, b in rules:
        x = a + b
        reach = max(len(x), inside.get(x, 0), starts.get(x, 0))
        for j in range(1, len(x)):
            reach = max(reach, j + starts.get(x[j:], 0), inside.get(x[:j], 0) if j else 0)
            for k in range(j + 1, len(x)):
                reach = max(reach, j + whole.get(x[j:k], 0))
        for k in range(1, len(x)):
            reach = max(reach, whole.get(x[:k], 0))
        most = max(most, reach)
        whole[x] = max(whole.get(x, 0), reach)
        for k in range(1, len(x) + 1):
            starts[x[:k]] = max(starts[x[:k]], reach)
        for j in range(1, len(x)):
            for k in range(j + 1, len(x) + 1) if len(x) <= 32 else (len(x),):
                inside[x[j:k]] = max(inside[x[j:k]], reach - j)
    return most


class Transducer:
    """Bytes of one pretoken in, ids out; holds at most a window and the lookahead."""

    def __init__(self, rules: Merges, lookahead: int, window: int = WINDOW):
        self.rules, self.lookahead, self.window, self.held = rules, lookahead, window, b""

    def feed(self, data: bytes) -> Iterator[int]:
        step = self.window
        for i in range(0, len(data), step):
            self.held += data[i:i + step]
            if len(self.held) > self.lookahead + self.window:
                stable, end = len(self.held) - self.lookahead, 0
                for x in self.rules.merge(self.held):
                    size = len(self.rules.bytes[x])
                    if end + size > stable:
                        break
                    end += size
                    yield x
                self.held = self.held[end:]

    def finish(self) -> Iterator[int]:
        held, self.held = self.held, b""
        yield from self.rules.merge(held)


class Decoder:
    """Ids in, text out, whole characters at a time; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, rules: Merges):
        self.rules, self.state = rules, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.bytes(b"".join(map(self.rules.bytes.__getitem__, ids)))

    def bytes(self, data: bytes) -> str:
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


class Encoder:
    """Ids of pretokens, with a bounded memo."""

    def __init__(self, path: str, lookahead: int):
        self.rules, self.lookahead = merges(path), lookahead
        (self.special_text, self.special_id), = list(self.rules.special.items()) or [("", -1)]
        self.special = self.special_text.encode()
        self.memo: dict[int, tuple[int, ...]] = {}
        #: One object an id, shared by all that the memo holds.
        self.one = {i: i for i in self.rules.bytes}.__getitem__

    def pretoken(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= WINDOW:
            return tuple(map(self.one, self.rules.merge(data)))
        t = Transducer(self.rules, self.lookahead)
        return (*t.feed(data), *t.finish())

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Pretokens, list[tuple[int, ...]], np.ndarray]:
        """The pretokens, the ids of the distinct ones, and the distinct index of each pretoken."""
        p = Pretokens(data, offsets, self.special)
        hashes, where, index = p.distinct()
        if len(self.memo) > MEMO:
            self.memo.clear()
        out = []
        for h, a, b, special in zip(hashes.tolist(), p.start[where].tolist(), p.end[where].tolist(),
                                    p.special[where].tolist(), strict=True):
            ids = self.memo.get(h)
            if ids is None:
                ids = self.memo[h] = (self.special_id,) if special else self.pretoken(p.data[a:b])
            out.append(ids)
        return p, out, index


@worker_table
def encoder(path: str, lookahead: int) -> Encoder:
    """One by worker."""
    return Encoder(path, lookahead)


@functools.cache
def lookahead_of(path: str) -> int:
    return sufficient_lookahead(merges(path).rules)


def encode_rows(docs: DataFrame, carry: list[str], path: str | None = None, digests: bool = False) -> DataFrame:
    """The columns ``carry`` and, by row, ``n_tokens`` with ``ids`` (array) or, with ``digests``, with
    ``ids_sha256`` and ``decoded_sha256``."""
    path = path or vocabulary_path()
    ahead = lookahead_of(path)
    made = [StructField("n_tokens", LongType())] + (
        [StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())] if digests
        else [StructField("ids", ArrayType(IntegerType()))])
    schema = StructType([docs.schema[c] for c in carry] + made)

    def run(batches):
        enc = encoder(path, ahead)
        give_back()             # what the file took to be parsed
        for batch in batches:
            for first, last in text_chunks(batch, limit=SLIM_BYTES):
                part = batch.slice(first, last - first)
                p, distinct, index = enc.chunk(*buffers(part.column("text").fill_null("")))
                if digests:
                    cols = _digests(enc, p, distinct, index)
                else:
                    flat, total = flattened(distinct, index)
                    ends = total[p.first]
                    cols = [pa.array(np.diff(ends)),
                            pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carry] + cols, schema.names)

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def _digests(enc: Encoder, p: Pretokens, distinct: list, index: np.ndarray) -> list[pa.Array]:
    as_text = [(",".join(map(str, ids)) + ",").encode() for ids in distinct]
    as_bytes = [b"".join(map(enc.rules.bytes.__getitem__, ids)) for ids in distinct]
    size = np.array([len(x) for x in distinct], np.int64)
    n, ids_sha, text_sha = [], [], []
    for a, b in zip(p.first[:-1].tolist(), p.first[1:].tolist(), strict=True):
        own = index[a:b]
        n.append(int(size[own].sum()) if b > a else 0)
        ids, text, decoder = hashlib.sha256(), hashlib.sha256(), Decoder(enc.rules)
        # a piece at a time: neither all ids nor all text of a long document at once
        for i in range(0, b - a, WINDOW):
            part = own[i:i + WINDOW].tolist()
            joined = b"".join(map(as_text.__getitem__, part))
            ids.update(joined[:-1] if i + WINDOW >= b - a else joined)
            text.update(decoder.bytes(b"".join(map(as_bytes.__getitem__, part))).encode())
        text.update(decoder.finish().encode())
        ids_sha.append(ids.hexdigest())
        text_sha.append(text.hexdigest())
    return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]


def decode_rows(rows: DataFrame, carry: list[str], path: str | None = None) -> DataFrame:
    """The columns ``carry`` and the ``text`` of ``ids`` (null ids: empty)."""
    path = path or vocabulary_path()
    schema = StructType([rows.schema[c] for c in carry] + [StructField("text", StringType())])

    def run(batches):
        rules = merges(path)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                d, ids = Decoder(rules), ids.values.to_pylist() if ids.is_valid else []
                texts.append("".join(d.feed(ids[i:i + WINDOW]) for i in range(0, len(ids), WINDOW)) + d.finish())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(texts, pa.string())],
                                             schema.names)

    return rows.select(*carry, "ids").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: tokens of every document, and their text again."""
    return encode_rows(documents(spark, sf_dir), ["doc_id"], digests=True)
