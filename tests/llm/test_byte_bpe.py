import hashlib
import random

import pytest
from cases import docs, empty, texts
from pyspark.sql import functions as F

from riskgrid.llm import byte_bpe
from riskgrid.llm.common import prepare
from riskgrid.llm.queries import REGISTRY


@pytest.fixture(scope="module")
def reference():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=byte_bpe.ranks(byte_bpe.ranks_path()),
                             special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.library_spec(byte_bpe.ranks_path()), byte_bpe.pattern())


def hard_texts(n=1500):
    rng = random.Random(8)
    parts = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "'", "'s", "'re", "'LL", "a", "Ab", "ß", "é", "中", "9", "½", "Ⅷ",
             "!", "?!", "́", "🙂", "​", "<|endoftext|>", "\r\n", "_", "١", "ª", "the", " and", "---", "aaaa"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 50))) for _ in range(n)]


def test_ids_are_those_of_the_ranks(codec, reference):
    for t in [x or "" for x in texts()] + hard_texts():
        assert codec.encode(t).tolist() == reference.encode_ordinary(t), t[:80]


def test_every_code_point(codec, reference):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    given = ["".join(f"a{c}1{c}!{c} {c}a" for c in points[i:i + 200]) for i in range(0, len(points), 200)]
    assert all(codec.encode(t).tolist() == reference.encode_ordinary(t) for t in given)


def test_one_lookup_a_match_and_no_threads(codec, reference, monkeypatch):
    asked = []
    made = byte_bpe.Codec(byte_bpe.library_spec(byte_bpe.ranks_path()), byte_bpe.pattern())
    plain = made.tokenize
    monkeypatch.setattr(made, "tokenize", lambda letters: asked.append(letters) or plain(letters))
    made.library = None                                 # its batch calls start a thread for each core
    for t in hard_texts(300):
        assert made.encode(t).tolist() == reference.encode_ordinary(t)
    assert len(asked) == len(set(asked)) == len(made.memo)
    # a full memo starts anew
    monkeypatch.setattr(byte_bpe, "MEMO", 5)
    for t in hard_texts(300):
        assert made.encode(t).tolist() == reference.encode_ordinary(t)
    assert len(made.memo) < len(set(asked))


def test_long_texts_in_pieces(codec, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE", 7)
    for t in hard_texts(400):
        assert "".join(codec.pieces(t)) == t
        assert codec.encode(t).tolist() == reference.encode_ordinary(t)


def test_offsets_and_split_characters(codec):
    for t in hard_texts(300) + ["🙂🙂 中a", ""]:
        ids = codec.encode(t)
        starts, ends = codec.offsets(t, ids)
        raw, at = t.encode(), 0
        for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
            token = codec.bytes[i].as_py()
            assert raw[at:at + len(token)] == token
            # the least span of characters that holds the token's bytes
            assert len(t[:a].encode()) <= at < len(t[:a + 1].encode())
            assert len(t[:b - 1].encode()) < at + len(token) <= len(t[:b].encode())
            at += len(token)
        assert at == len(raw)
        d = byte_bpe.TextDecoder()
        assert "".join(d.feed(codec.bytes[i].as_py()) for i in ids.tolist()) + d.finish() == t


def test_rows(spark, reference):
    prepare(spark)
    d = docs(spark)
    ids = byte_bpe.encode_rows(d.withColumn("ids", F.lit("clash")), ["doc_id", "ids", "text"], offsets=True)
    for r in ids.collect():
        assert r["ids"] == reference.encode_ordinary(r["text"] or "") and len(r["starts"]) == len(r["ends"]) == len(r["ids"])
    back = byte_bpe.decode_rows(ids.withColumnRenamed("text", "was"), ["doc_id", "was"], text=True)
    assert all(r["text"] == (r["was"] or "") and bytes(r["bytes"]).decode() == r["text"] for r in back.collect())
    nothing = byte_bpe.decode_rows(ids.limit(1).withColumn("ids", F.lit(None).cast("array<int>")), [], text=True).first()
    assert (bytes(nothing["bytes"]), nothing["text"]) == (b"", "")
    assert byte_bpe.encode_rows(empty(spark), ["doc_id"]).count() == 0


def test_query_against_the_reference(spark, reference, tmp_path):
    d = docs(spark)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, REGISTRY["op12_byte_bpe"][0](spark, str(tmp_path)).collect()), key=repr)

    def row(r):
        t = r["text"] or ""
        ids = reference.encode_ordinary(t)
        return (r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())

    assert got == sorted(map(row, d.collect()), key=repr)
