"""What a worker keeps between its tasks."""

import pyarrow as pa
import pytest

from riskgrid.llm import bpe, common, near_dedup, quality

PATH = bpe.vocabulary_path()


class Docs:
    """Stands for a table: gives back the kernel."""

    def select(self, *_):
        return self

    def mapInArrow(self, kernel, _):
        return kernel


@pytest.mark.parametrize("stage", [
    lambda docs: quality.measured(docs, []), lambda docs: near_dedup.signed(docs, 5), lambda docs: near_dedup.shingle_sets(docs, 5)])
def test_other_kernels_drop_the_encoder(spark, stage):
    bpe.encoder(PATH, 100).memo[1] = (1,)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["a few words", None]})
    assert sum(b.num_rows for b in stage(Docs())([batch])) == 2
    assert not bpe.encoder.cache_info().currsize and not bpe.merges.cache_info().currsize
    assert bpe.encoder(PATH, 100).memo == {}


def test_tables_stay_for_the_same_operator():
    assert bpe.encoder(PATH, 100) is bpe.encoder(PATH, 100)
    common.forget()
    assert not bpe.encoder.cache_info().currsize


def test_memo_shares_its_numbers():
    e = bpe.Encoder(PATH, 100)
    a, b = e.pretoken(b" therefore"), e.pretoken(b" therefore")
    assert a == b and max(a) > 256 and all(x is y for x, y in zip(a, b, strict=True))
