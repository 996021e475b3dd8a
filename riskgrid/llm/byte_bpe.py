"""Byte-level BPE with the tokenizers library over Arrow batches (12), from a file of ranks.

A rank file names only tokens and their order.  ``library_spec`` turns it into the library's byte-level model: each
byte has its letter, and a token's merge is the pair of parts that the merges of lower rank leave of it.  Texts
are split by the pattern of the ranks; the library encodes each distinct match once a worker (a bounded memo keyed
by the match itself).  Character offsets come from the bytes of the tokens: a token that holds a part
of a character only spans that character.  Decoding reverses the byte table; ``text`` is made by an incremental decoder,
so characters split over tokens are whole again and broken ones become U+FFFD.

Very long texts are encoded in pieces cut before a white space that follows something else: no match reaches over
such a place, and none depends on what lies before it.

Defined results: a null text is empty and gives no ids; no string is a special token; repeated rows are encoded alike;
an empty table gives no rows.  Carried columns named like an output (``ids``, ``starts``, ``ends``, ``bytes``) are replaced by it.
"""

from __future__ import annotations

import base64
import codecs
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from riskgrid.llm.common import documents
from riskgrid.llm.pretokens import byte_letters

#: Characters of a piece of a long text, matches that a worker remembers, and ids of a batch that goes back to Spark.
PIECE, MEMO, OUT_IDS = 1 << 18, 300_000, 1 << 20


def ranks_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _last_pair(token: bytes, order: dict[bytes, int]) -> list[bytes]:
    """What merges of lower rank than the token's leave of it."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((order.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank >= order[token]:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


@functools.cache
def library_spec(path: str) -> str:
    """The library's model of a rank file, as its JSON.  A token that no pair of parts makes is found only as a whole
    match (``ignore_merges``), as with the ranks."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers
    order = ranks(path)
    letter = {b: c for c, b in byte_letters().items()}
    spelt = {t: "".join(letter[b] for b in t) for t in order}
    pairs = (_last_pair(t, order) for t in sorted(order, key=order.get) if len(t) > 1)
    merges = [(spelt[p[0]], spelt[p[1]]) for p in pairs if len(p) == 2]
    made = Tokenizer(models.BPE(vocab={spelt[t]: r for t, r in order.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    made.decoder = decoders.ByteLevel()
    return made.to_str()


class Memo(dict):
    """A number for each match, in order of appearance; ``new`` are those that have no ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class Codec:
    """The library's tokenizer with a memo, and the bytes of every id."""

    def __init__(self, spec: str, split: str):
        import regex
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.findall = regex.compile(split).findall
        self.cut = regex.compile(r"\S(?=\s)")
        # the model itself, without the library's threads: matches are many and short, and every core has a task
        self.tokenize = self.library.model.tokenize
        self.forget()
        code = byte_letters()
        self.letters = {b: c for c, b in code.items()}
        tokens = [b""] * (max(self.library.get_vocab().values(), default=-1) + 1)
        for letters, i in self.library.get_vocab().items():
            tokens[i] = bytes(code[c] for c in letters)
        self.bytes = pa.array(tokens, pa.binary())
        self.length = np.array([len(t) for t in tokens], np.int64)

    def pieces(self, text: str) -> Iterator[str]:
        first = 0
        while len(text) - first > PIECE:
            at = self.cut.search(text, first + PIECE)
            if at is None:
                break
            yield text[first:at.end()]
            first = at.end()
        yield text[first:] if first else text

    def forget(self) -> None:
        """An empty memo: the ids of its matches lie one after the other in ``known``, match ``i`` up to ``ends[i + 1]``."""
        self.memo, self.known, self.ends = Memo(), array("i"), array("q", [0])

    def encode(self, text: str) -> np.ndarray:
        out = []
        for piece in self.pieces(text):
            if len(self.memo) > MEMO:
                self.forget()
            found = self.findall(piece)
            which = np.fromiter(map(self.memo.__getitem__, found), np.int64, len(found))
            for word in self.memo.new:
                self.known.extend([t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.letters))])
                self.ends.append(len(self.known))
            self.memo.new.clear()
            out.append(self._gathered(which))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def _gathered(self, which: np.ndarray) -> np.ndarray:
        """The ids of the matches ``which``, in order."""
        ends = np.frombuffer(self.ends, np.int64)
        begin, size = ends[which], ends[which + 1] - ends[which]
        step = begin - np.cumsum(size) + size
        at = np.repeat(step, size)
        at += np.arange(len(at))
        return np.frombuffer(self.known, np.int32)[at] if len(at) else np.zeros(0, np.int32)

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each id's span."""
        ends = np.cumsum(self.length[ids])
        if text.isascii():
            return (ends - self.length[ids]).astype(np.int32), ends.astype(np.int32)
        raw = np.frombuffer(text.encode(), np.uint8)
        chars = np.cumsum((raw & 0xC0) != 0x80)
        return (chars[ends - self.length[ids]] - 1).astype(np.int32), chars[ends - 1].astype(np.int32)

    def joined(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids, by one gather over the whole batch."""
        tokens = self.bytes.take(ids.values if ids.offset == 0 else ids.flatten())
        at = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1, tokens.offset * 4)
        where = ids.offsets.to_numpy() - ids.offsets[0].as_py() if ids.offset else ids.offsets.to_numpy()
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at[where].astype(np.int32)),
                                                             tokens.buffers()[2]])


@functools.lru_cache(maxsize=2)
def _codec(spec: str, split: str) -> Codec:
    return Codec(spec, split)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


def encode_rows(docs: DataFrame, carry: list[str], path: str | None = None, offsets: bool = False) -> DataFrame:
    """The columns ``carry`` and ``ids`` of the text of every row; with ``offsets`` also ``starts`` and ``ends``, the
    characters that each id spans."""
    spec, split = library_spec(path or ranks_path()), pattern()
    made = ["ids", "starts", "ends"] if offsets else ["ids"]
    carry = [c for c in carry if c not in made]
    ints = ArrayType(IntegerType(), False)
    schema = StructType([docs.schema[c] for c in carry] + [StructField(c, ints) for c in made])

    def run(batches):
        codec = _codec(spec, split)
        for batch in batches:
            first, size, cols = 0, 0, [[] for _ in made]
            texts = batch.column("text")
            for i in range(len(batch)):
                text = texts[i].as_py() or ""
                ids = codec.encode(text)
                cols[0].append(ids)
                if offsets:
                    for col, part in zip(cols[1:], codec.offsets(text, ids), strict=True):
                        col.append(part)
                size += len(ids)
                if size >= OUT_IDS or i + 1 == len(batch):
                    rows = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in carry), *map(_lists, cols)], schema.names)
                    first, size, cols = i + 1, 0, [[] for _ in made]

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def decode_rows(rows: DataFrame, carry: list[str], path: str | None = None, text: bool = False) -> DataFrame:
    """The columns ``carry`` and the decoded ``bytes`` of ``ids`` (null ids: empty); with ``text`` also their ``text``."""
    spec, split = library_spec(path or ranks_path()), pattern()
    made = [StructField("bytes", BinaryType())] + ([StructField("text", StringType())] if text else [])
    carry = [c for c in carry if c not in [f.name for f in made]]
    schema = StructType([rows.schema[c] for c in carry] + made)

    def run(batches):
        codec = _codec(spec, split)
        for batch in batches:
            ids = batch.column("ids")
            if ids.null_count or ids.offset:
                ids = pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.int32()))
            raw = codec.joined(ids)
            out = [*(batch.column(c) for c in carry), raw]
            if text:
                out.append(pa.array([TextDecoder().whole(b.as_py()) for b in raw], pa.string()))
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return rows.select(*dict.fromkeys([*carry, "ids"])).mapInArrow(run, schema)


class TextDecoder:
    """Bytes to text as they come: an unfinished character waits for the rest of its bytes."""

    def __init__(self):
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, raw: bytes) -> str:
        return self._state.decode(raw)

    def finish(self) -> str:
        return self._state.decode(b"", True)

    def whole(self, raw: bytes) -> str:
        return self.feed(raw) + self.finish()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: ids of every document by the ranks, and their bytes again."""
    ids = encode_rows(documents(spark, sf_dir), ["doc_id"])
    back = decode_rows(ids, ["doc_id", "ids"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))
