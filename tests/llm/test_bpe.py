import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from cases import docs, empty, texts
from tokenizers import Tokenizer

from riskgrid.llm import bpe
from riskgrid.llm.common import prepare
from riskgrid.llm.textkernel import buffers

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def chunk_ids(given):
    e = bpe.encoder(PATH, bpe.lookahead_of(PATH))
    p, distinct, index = e.chunk(*buffers(pa.array(given, pa.string())))
    return [[i for k in index[a:b].tolist() for i in distinct[k]] for a, b in zip(p.first, p.first[1:], strict=False)]


def hard_texts():
    rng = random.Random(3)
    alphabet = [" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "'", "'s", "'re", "'ll", "'S", "a", "Ab", "ß", "é", "中", "9", "½",
                "Ⅷ", "!", "?!", "́", "🙂", "​", "<|endoftext|>", "<|endof", "text|>", "\r\n", "_", "١", "ª"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]


def test_chunks_equal_the_library(library):
    given = [t or "" for t in texts()] + hard_texts()
    assert chunk_ids(given) == [library.encode(t, add_special_tokens=False).ids for t in given]


def test_every_code_point_has_the_class_of_the_library(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    given = ["".join(f"a{c}1{c}!{c} {c}a" for c in points[i:i + 200]) for i in range(0, len(points), 200)]
    got = chunk_ids(given)
    wrong = [i for i, t in enumerate(given) if got[i] != library.encode(t, add_special_tokens=False).ids]
    assert not wrong, (len(wrong), wrong[:20])


def test_transducer_with_small_windows(library):
    rng = random.Random(9)
    rules, ahead = bpe.merges(PATH), bpe.lookahead_of(PATH)
    longs = ["a" * 20_000, "ab" * 10_000, "".join(rng.choice("aehinorst") for _ in range(20_000)), "=" * 15_001,
             "ÃÂ" * 4000]
    for t in longs:
        whole = library.encode(t, add_special_tokens=False).ids
        for window in (1000, 4096):
            x = bpe.Transducer(rules, ahead, window)
            got = []
            for i in range(0, len(t.encode()), 1000):
                got += x.feed(t.encode()[i:i + 1000])
                assert len(x.held) <= ahead + 2 * window
            assert got + list(x.finish()) == whole


def test_lookahead_of_a_small_merge_list():
    # ab, bc: whether "a b" merges hangs on nothing to the right; "b c" must wait for the lower rank
    rules = [(b"b", b"c"), (b"a", b"b")]
    assert bpe.sufficient_lookahead(rules) >= 3


def test_decoder_equals_the_library(library):
    rng = random.Random(4)
    rules = bpe.merges(PATH)
    for _ in range(300):
        ids = [rng.randrange(50257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randrange(0, 30))]
        d = bpe.Decoder(rules)
        assert "".join(d.feed([i]) for i in ids) + d.finish() == library.decode(ids, skip_special_tokens=False)


def test_rows(spark, library):
    prepare(spark)
    d = docs(spark)
    got = bpe.encode_rows(d, ["doc_id", "text", "shard"])
    for r in got.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    back = bpe.decode_rows(got.withColumnRenamed("text", "was"), ["was"]).collect()
    assert all(r.text == (r.was or "") for r in back)
    for r in bpe.encode_rows(d, ["doc_id", "text"], digests=True).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_rows(empty(spark), ["doc_id"], digests=True).count() == 0


def test_empty_chunk():
    p, distinct, index = bpe.encoder(PATH, 100).chunk(np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert not distinct and p.first.tolist() == [0, 0, 0]
