"""Sinks (SK1-SK3)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_events(df: DataFrame, path: str, partition_by: str | None = None) -> bool:
    """SK1-SK3: overwrite a parquet event table.  Like the flood feeder, nothing is written
    when there is no row (returns False)."""
    if df.isEmpty():
        return False
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return True
