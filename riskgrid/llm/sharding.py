"""Sharding (10): contiguous shards of near equal bytes from a two-level prefix sum.

Rows are range-partitioned by ``doc_id``; each partition's byte and row totals are summed to
offsets (one row per partition), a window inside the partition adds the local prefix, and the
global prefix is cut at equal byte targets.  Only ids, sizes and checksums are shuffled.

Defined results: a null text has size 16 and checksum 0; null doc_ids come first; rows of one
doc_id are ordered by size and checksum (identical rows are interchangeable); a shard that no
row starts in is empty (a document larger than the target skips it); an empty table gives no
rows.  Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.llm.common import documents, partitions

SHARDS = 40
ROW_BYTES = 16


def ranked(slim: DataFrame, order: list[str], weight: str) -> DataFrame:
    """``slim`` with its global position: ``before`` (sum of ``weight`` of all earlier rows),
    ``row`` (count of earlier rows) and ``total`` (sum of all weights), in ``order``."""
    placed = (slim.repartitionByRange(partitions(slim), *[F.col(c).asc_nulls_first() for c in order])
              .withColumn("__part", F.spark_partition_id()).checkpoint())
    per_part = placed.groupBy("__part").agg(F.sum(weight).alias("__w"), F.count(F.lit(1)).alias("__n"))
    # one row per partition, whatever the data size
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    offsets = per_part.select(
        "__part", F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("__w0"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        F.sum("__w").over(every).alias("total"))
    local = Window.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    return (placed.withColumn("__local_w", F.sum(weight).over(upto) - F.col(weight))
            .withColumn("__local_n", F.row_number().over(local) - 1)
            .join(F.broadcast(offsets), "__part")     # one row per partition
            .withColumn("before", F.col("__w0") + F.col("__local_w"))
            .withColumn("row", F.col("__n0") + F.col("__local_n"))
            .drop("__part", "__w0", "__n0", "__local_w", "__local_n"))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: shard of each row and its place in it."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(row_bytes)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"))
    cut = (ranked(slim, ["doc_id", "size", "text_crc32"], "size")
           .withColumn("shard", F.expr(f"cast((before * {shards}) div total as int)")))
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first_row"))    # one row per shard
    return (cut.join(F.broadcast(firsts), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all ``documents`` in shards 0 to 39, law ``bytes``."""
    return shard_by_bytes(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is CRC-32 (polynomial 0xEDB88320) over the UTF-8 bytes, low half byte first.
SQL = f"""
WITH tab AS (SELECT list(list_reduce([i]::UBIGINT[] || range(4)::UBIGINT[],
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
             FROM range(16) AS r(i)),
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + {ROW_BYTES} AS size,
             hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, CASE WHEN h = '' THEN 0 ELSE
        xor(4294967295::UBIGINT, list_reduce([4294967295]::UBIGINT[] || list_transform(range(length(h)),
          lambda i: ('0x' || substr(h, xor(i, 1) + 1, 1))::UBIGINT),
          lambda c, x: xor(list_extract(t, ((xor(c, x) & 15) + 1)::BIGINT), c >> 4)))::BIGINT END AS text_crc32
      FROM d, tab),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before,
             sum(size) OVER () AS total FROM c),
k AS (SELECT *, ((before * {SHARDS}) // total)::INT AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot,
       NULL::INT AS grown_shard FROM k
"""
