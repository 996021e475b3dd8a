import zlib

import numpy as np
import pytest
from cases import docs, empty
from tokenizers import Tokenizer

from riskgrid.llm import bpe, idcoder, token_files
from riskgrid.llm.common import prepare


def blocks():
    rng = np.random.default_rng(0)
    out = [np.zeros(0, int), np.array([5]), np.arange(50), np.zeros(5000, int), rng.integers(0, 50257, 4096),
           np.tile(rng.integers(0, 50257, 37), 60), rng.zipf(1.3, 3000) % 50257, rng.integers(0, 1 << 32, 500),
           np.tile([1, 2, 1, 3], 500), np.array([(1 << 32) - 1, 0, 65535, 65536])]
    return out + [rng.zipf(1.2, int(rng.integers(1, 800))) % 60000 for _ in range(20)]


def test_codec_round_trip():
    coded = idcoder.encode(blocks())
    for a, b in zip(blocks(), idcoder.decode(coded), strict=True):
        assert np.array_equal(a, b)
    assert idcoder.split(b"".join(coded)) == coded
    # a block doesn't hang on its neighbours
    assert idcoder.encode([blocks()[6]])[0] == coded[6] and np.array_equal(idcoder.decode([coded[6]])[0], blocks()[6])
    # repeats are predicted
    assert len(coded[5]) < 2 * 37 * 2.2 and len(coded[8]) < 100


def test_damage_is_found():
    block = bytearray(idcoder.encode([np.arange(300)])[0])
    block[-20] ^= 1
    with pytest.raises(ValueError):
        idcoder.decode([bytes(block)])


@pytest.mark.parametrize("run_bytes,row_blocks", [(1 << 24, 64), (3000, 1)])
def test_files(spark, monkeypatch, run_bytes, row_blocks):
    prepare(spark)
    monkeypatch.setattr(token_files, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(token_files, "ROW_BLOCKS", row_blocks)
    d = docs(spark)
    library = Tokenizer.from_file(bpe.vocabulary_path())
    rows = sorted(((r.doc_id, r.text) for r in d.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_files.read_back(token_files.file_rows(d).checkpoint()).collect()), key=lambda r: r[1])
    assert got == want


def test_empty_table(spark):
    assert token_files.read_back(token_files.file_rows(empty(spark)).checkpoint()).count() == 0
