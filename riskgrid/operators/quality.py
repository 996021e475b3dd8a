"""Geometry quality: GE3 validity, GE4 repair, FI3/FI4 valid/rejected split, AG1 counts.

Validity is a relational job over edges (``validity``).  Repair is an Arrow-batched kernel that runs only on rows that fail
the check (per row, not the whole layer, Q10); its result is checked again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.functions import udfs, wkt
from riskgrid.operators.validity import validity
from riskgrid.session import Tables, spread


def check_polygons(df: DataFrame, wkt_col: str = "polig") -> DataFrame:
    """Adds ``is_valid`` (GE3, null for null geometry), ``repaired`` WKT for invalid rows (GE4) and ``valid_after`` (GE3 of the
    repaired one; an empty result is not valid)."""
    tables = Tables(df.sparkSession)
    rows = tables.kept(spread(df.withColumn("_row", F.monotonically_increasing_id()), "_row").withColumn("_g", wkt.parse_wkt(F.col(wkt_col))))
    checked = tables.kept(rows.join(validity(rows, "_row", "_g"), "_row"))
    mended = tables.kept(udfs.repaired(spread(checked.where("not is_valid"), "_row"), "_g", "repaired", ["_row"])
                         .withColumn("_g", wkt.parse_wkt(F.col("repaired"))))
    again = validity(mended.where("_g.xmin is not null"), "_row", "_g").withColumnRenamed("is_valid", "valid_again")
    out = (checked.drop("_g").join(mended.drop("_g"), "_row", "left").join(again, "_row", "left")
           .withColumn("valid_after", F.coalesce(F.col("is_valid") | F.col("valid_again"), F.lit(False))))
    out = tables.result(spread(out, "_row").select(*df.columns, "is_valid", "repaired", "valid_after"))
    tables.drop()
    return out


def valid_polygons(checked: DataFrame, wkt_col: str = "polig") -> DataFrame:
    """FI3: valid rows, repaired where needed (the repaired WKT replaces the original)."""
    return checked.filter("valid_after").withColumn(wkt_col, F.coalesce(F.col("repaired"), F.col(wkt_col)))


def rejected_polygons(checked: DataFrame, wkt_col: str = "polig") -> DataFrame:
    """FI4: rows that stay invalid, with the first 100 characters of their WKT."""
    return checked.filter(~F.col("valid_after")).select("*", F.substring(F.col(wkt_col), 1, 100).alias("wkt_head"))


def validity_counts(checked: DataFrame) -> DataFrame:
    """AG1: valid, repaired and rejected totals (rows without geometry are in none)."""
    return checked.agg(F.count_if(F.col("is_valid")).alias("n_valid"),
                       F.count_if(~F.col("is_valid") & F.col("valid_after")).alias("n_repaired"),
                       F.count_if(~F.col("is_valid") & ~F.col("valid_after")).alias("n_rejected"))
