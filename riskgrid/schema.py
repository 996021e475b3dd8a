"""Schemas of the tables the engine reads and writes, and a checker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("tipo_evento", T.StringType()),
    T.StructField("origem", T.StringType()),
    T.StructField("polig", T.StringType()),
    T.StructField("additional_value", T.StringType()),
    T.StructField("data_run", T.StringType()),
])
EVENT_COLUMNS = [f.name for f in EVENT.fields]

STANDARD_EVENT = T.StructType(EVENT.fields + [T.StructField("id_polig_evento", T.StringType())])

CUSTOMER = T.StructType([
    T.StructField("id_customer", T.LongType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("polig_customer", T.StringType()),
    T.StructField("description", T.StringType()),
])
CUSTOMER_COLUMNS = [f.name for f in CUSTOMER.fields]

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
# part -> ring (0 = shell) -> vertex
PARTS = T.ArrayType(T.ArrayType(T.ArrayType(VERTEX)))
GEOMETRY = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("parts", PARTS),
    T.StructField("has_z", T.BooleanType()),
    T.StructField("xmin", T.DoubleType()),
    T.StructField("ymin", T.DoubleType()),
    T.StructField("xmax", T.DoubleType()),
    T.StructField("ymax", T.DoubleType()),
])


class SchemaError(ValueError):
    pass


def check_schema(df: DataFrame, expected: T.StructType, *, exact_types: bool = True, name: str = "input") -> DataFrame:
    """Fail early when required columns are missing or typed differently."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in expected.fields if f.name not in have]
    if missing:
        raise SchemaError(f"{name}: missing columns {missing}; has {list(have)}")
    if exact_types:
        bad = [(f.name, have[f.name].simpleString(), f.dataType.simpleString())
               for f in expected.fields if have[f.name] != f.dataType]
        if bad:
            raise SchemaError(f"{name}: wrong column types (column, has, expected): {bad}")
    return df
