"""Token-ID / binary output (8): ids of all documents in ascending ``doc_id`` order, range-coded.

Texts are dealt once into runs of ``doc_id`` and sorted there.  Ids come from the tokenizers library: texts are split
into pretokens (merges never cross them), each distinct pretoken of a chunk is encoded by the library, and
the id ``END`` follows each document.  A file row holds whole documents: its run and number in the run, a
directory (doc_id and count of ids), and the ids in blocks of ``idcoder`` - each block independent and
checksummed.  Rows are written as Parquet files in the shared checkpoint folder, so that lost
executors cost nothing, and ``read_back`` decodes many blocks of many rows at a time.

Positions are two-level prefix sums over the directories: rows in a run, runs in the whole.

Defined results: a null or empty text has the end id only; null doc_ids come first; rows of one doc_id are
ordered by text; repeated rows are each written; a text's special-token strings become its special ids, as the
library does; an empty table writes no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.llm import idcoder
from riskgrid.llm.bpe import Encoder, vocabulary_path
from riskgrid.llm.common import documents, id_splits, in_runs, sized_broadcast, text_chunks, worker_table, written
from riskgrid.llm.pretokens import flattened
from riskgrid.llm.textkernel import buffers

END = 2
RUN_BYTES = 16 << 20
#: Blocks of ids in a file row (a longer document makes a longer row), and lanes coded at once.
ROW_BLOCKS, LANES = 64, 1024
FILE = "run int, row long, n_ids long, docs array<struct<doc_id:bigint,n_tokens:bigint>>, blocks binary"
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))


class LibraryEncoder(Encoder):
    """Pretokens through the tokenizers library."""

    def __init__(self, path: str):
        super().__init__(path, 0)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def pretoken(self, data: bytes) -> tuple[int, ...]:
        return tuple(self.library.encode(data.decode(), add_special_tokens=False).ids)


@worker_table
def library_encoder(path: str) -> LibraryEncoder:
    """One by worker."""
    return LibraryEncoder(path)


class _Rows:
    """Collects documents into file rows and codes the blocks of many rows together."""

    def __init__(self):
        self.rows, self.docs, self.ids, self.size, self.lanes = [], [], [], 0, 0
        self.run, self.number = None, 0

    def add(self, run: int, doc_id: int | None, ids: np.ndarray) -> None:
        if run != self.run:
            self.close()
            self.run, self.number = run, 0
        elif self.size and self.size + len(ids) > ROW_BLOCKS * idcoder.BLOCK:
            self.close()
        self.docs.append({"doc_id": doc_id, "n_tokens": len(ids)})
        self.ids.append(ids)
        self.size += len(ids)

    def close(self) -> None:
        if self.docs:
            ids = np.concatenate(self.ids)
            blocks = [ids[i:i + idcoder.BLOCK] for i in range(0, len(ids), idcoder.BLOCK)]
            self.rows.append((self.run, self.number, len(ids), self.docs, blocks))
            self.lanes += len(blocks)
            self.number += 1
            self.docs, self.ids, self.size = [], [], 0

    def batch(self) -> pa.RecordBatch:
        coded = iter(idcoder.encode([b for *_, blocks in self.rows for b in blocks]))
        made = [(*head, b"".join(next(coded) for _ in blocks)) for *head, blocks in self.rows]
        self.rows, self.lanes = [], 0
        kinds = [pa.int32(), pa.int64(), pa.int64(), _DOCS, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)],
                                          ["run", "row", "n_ids", "docs", "blocks"])


def file_rows(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """``FILE`` rows of ``docs``."""
    path = path or vocabulary_path()
    runs = in_runs(docs.select("doc_id", "text"), id_splits(docs, RUN_BYTES))

    def run(batches):
        enc, rows = library_encoder(path), _Rows()
        for batch in batches:
            for first, last in text_chunks(batch):
                part = batch.slice(first, last - first)
                p, distinct, index = enc.chunk(*buffers(part.column("text").fill_null("")))
                flat, ends = flattened(distinct, index)
                cuts = ends[p.first]
                for i, (at, doc_id) in enumerate(zip(part.column("run").to_pylist(), part.column("doc_id").to_pylist(),
                                                     strict=True)):
                    rows.add(at, doc_id, np.append(flat[cuts[i]:cuts[i + 1]], np.int32(end)))
                if rows.lanes >= LANES:
                    yield rows.batch()
        rows.close()
        if rows.rows:
            yield rows.batch()

    return runs.select("run", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FILE)


def read_back(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from file rows."""
    places = files.select("run", "row", "n_ids")
    in_run = Window.partitionBy("run").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    by_run = places.groupBy("run").agg(F.sum("n_ids").alias("n"))             # one row by run
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (places.withColumn("in_run", F.coalesce(F.sum("n_ids").over(in_run), F.lit(0)))
              .join(F.broadcast(by_run.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("run_start"))), "run")
              .select("run", "row", (F.col("in_run") + F.col("run_start")).alias("row_start")))

    def run(batches):
        def decoded(held):
            blocks = [idcoder.split(b) for *_, b in held]
            ids = iter(idcoder.decode([b for bs in blocks for b in bs]))
            out = []
            for (at, row, n_ids, docs, _), bs in zip(held, blocks, strict=True):
                raw = np.concatenate([next(ids) for _ in bs]).astype("<u4")
                if len(raw) != n_ids:
                    raise ValueError("a row of ids is not whole")
                place = 0
                for d in docs:
                    own = raw[place:place + d["n_tokens"]]
                    out.append((at, row, d["doc_id"], place, len(own), zlib.crc32(own.tobytes())))
                    place += len(own)
            kinds = [pa.int32(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                              ["run", "row", "doc_id", "in_row", "n_tokens", "ids_crc32"])

        held, lanes = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("run", "row", "n_ids", "docs", "blocks")), strict=True):
                held.append(row)
                lanes += -(-row[2] // idcoder.BLOCK)
                if lanes >= LANES:
                    yield decoded(held)
                    held, lanes = [], 0
        if held:
            yield decoded(held)

    found = files.mapInArrow(run, "run int, row long, doc_id long, in_row long, n_tokens long, ids_crc32 long")
    return (found.join(sized_broadcast(starts, files.select("run").count()), ["run", "row"])
            .select("doc_id", (F.col("row_start") + F.col("in_row")).alias("start"), "n_tokens", "ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents written as coded ids, and read from the files again."""
    # a row of coded blocks is some hundred KB
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    return read_back(written(file_rows(documents(spark, sf_dir))))
