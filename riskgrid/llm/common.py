"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.session import apply_defaults, ensure_checkpoint_dir, ship_package

#: A relation is broadcast only when it is known to hold at most this many (slim) rows.
BROADCAST_ROWS = 100_000
#: Texts are handed to the numpy kernels in groups of about this many bytes.
CHUNK_BYTES = 2 << 20
#: The same for kernels with 40 and more bytes of arrays for each byte of text, and nothing to gain from larger groups.
SLIM_BYTES = CHUNK_BYTES // 4


def prepare(spark: SparkSession) -> None:
    """Session settings, shared checkpoint folder and the package on the workers."""
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    # a batch may hold very long texts: keep it small on the way to the workers
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit range partitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a slim relation whose row count is known and small; a plain
    join (shuffle, split by AQE when skewed) beyond that."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_chunks(batch: pa.RecordBatch, text_col: str = "text", limit: int = CHUNK_BYTES):
    """Row ranges ``(first, last)`` of a batch, each of about ``limit`` bytes of text (one
    longer text makes a range of its own)."""
    sizes = pc.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += int(n)
    if first < len(sizes):
        yield first, len(sizes)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and read back: cuts the lineage
    and survives lost executors, in less space than a checkpoint of rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/riskgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a worker keeps between its tasks.
_TABLES: list = []


def worker_table(make: Callable) -> Callable:
    """``make``, cached: a table that a worker keeps from task to task, until a ``tidy`` kernel runs in it."""
    cached = functools.cache(make)
    _TABLES.append(cached)
    return cached


def give_back() -> None:
    """Freed memory goes back to the system: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


def forget() -> None:
    """Drops the tables of this worker."""
    for table in _TABLES:
        table.cache_clear()
    give_back()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable:
    """A kernel without tables of its own, for mapInArrow: the tables that other operators left in the worker go first, and
    what it freed itself at its end."""
    @functools.wraps(run)
    def kernel(batches):
        forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return kernel


def id_splits(docs: DataFrame, part_bytes: int, most: int = 20_000) -> list[int]:
    """Ascending ``doc_id`` values that cut the table into runs of at most about ``part_bytes`` of text, and at
    least two runs a shuffle partition; the list's length hangs on the number of partitions only."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(most, max(-(-total // part_bytes), 2 * partitions(docs)))
    if n < 2:
        return []
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)],
                                         max(10_000, 10 * n))).first()[0]
    return sorted(set(found or []))


def in_runs(docs: DataFrame, splits: list[int], lead: bool = False) -> DataFrame:
    """``docs`` hash-partitioned by ``run``, the number of splits up to the ``doc_id`` (nulls: run 0), and
    sorted by run, ``lead`` and doc_id inside a partition.  With ``lead``, the first document of each run
    (of run 0 after the last) also ends the run before it, in a row with ``lead`` true."""
    ids = F.col("doc_id").cast("long")
    low = docs.agg(F.min(ids), F.count(F.lit(1)) - F.count("doc_id")).first() if lead else (None, 0)
    # nulls come first: with any, they are what follows the last document
    least = None if low[1] else low[0]
    edges = np.array([s for s in splits if least is None or s > least], np.int64)

    @F.pandas_udf("array<int>")
    def runs(doc_id: pd.Series) -> pd.Series:
        nulls = doc_id.isna().to_numpy()
        values = doc_id.fillna(0).astype("int64").to_numpy()
        run = np.where(nulls, 0, np.searchsorted(edges, values, side="right"))
        first = nulls if least is None else (values == least) & ~nulls
        first = first | (np.isin(values, edges) & ~nulls & (run > 0))
        return pd.Series([[r, -1 if not f else (r - 1 if r else len(edges))] for r, f in zip(run, first, strict=True)])

    placed = docs.withColumn("__runs", runs(ids))
    if lead:
        placed = (placed.select("*", F.posexplode("__runs").alias("__pos", "run")).where("run >= 0")
                  .withColumn("lead", F.col("__pos") == 1).drop("__pos"))
    else:
        placed = placed.withColumn("run", F.col("__runs")[0]).withColumn("lead", F.lit(False))
    return (placed.drop("__runs").repartition(max(partitions(docs), len(splits) + 1), "run")
            .sortWithinPartitions("run", "lead", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()))
