"""SC3: GeoJSON features -> properties + WKT, of any geometry type, Z kept.

Properties and geometries keep their JSON text, which is read as VARIANT: properties that nobody asked for survive in ``properties``.
Coordinates are read with ``from_json`` at the depth that their type calls for, and written as WKT by columns.  A file of one
Feature a line splits over tasks; a FeatureCollection is exploded.

Defined results: a feature without geometry, with empty coordinates or of an unknown type has null WKT; positions beyond the third
ordinate are dropped; members of a GeometryCollection may be of any type but a collection (null otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgrid.functions.wkt import let

#: How deep the positions of each geometry type lie in its coordinates.
DEPTHS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
FEATURE = "type string, properties string, geometry string"


def _number(v: Column) -> Column:
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def _position(p: Column, z: Column) -> Column:
    x = F.concat(_number(F.get(p, F.lit(0))), F.lit(" "), _number(F.get(p, F.lit(1))))
    return F.when(z, F.concat(x, F.lit(" "), _number(F.coalesce(F.get(p, F.lit(2)), F.lit(0.0))))).otherwise(x)


def _nested(c: Column, depth: int, z: Column, points: bool = False) -> Column:
    """'(..)' of positions nested ``depth`` deep; ``points``: each position in brackets of its own."""
    if depth == 0:
        return F.concat(F.lit("("), _position(c, z), F.lit(")"))
    if depth == 1:
        items = F.transform(c, lambda p: F.concat(F.lit("("), _position(p, z), F.lit(")")) if points else _position(p, z))
    else:
        items = F.transform(c, lambda x: _nested(x, depth - 1, z))
    return F.concat(F.lit("("), F.array_join(items, ", "), F.lit(")"))


def _written(name: str, depth: int):
    """WKT of read coordinates of one geometry type."""
    def wkt(c: Column) -> Column:
        flat = F.array(c) if depth == 0 else c
        for _ in range(depth - 1):
            flat = F.flatten(flat)
        z = F.exists(flat, lambda p: F.size(p) >= 3)
        return F.when(F.size(flat) > 0, F.concat(F.lit(name.upper()), F.when(z, F.lit(" Z ")).otherwise(F.lit(" ")),
                                                 _nested(c, depth, z, name == "MultiPoint")))
    return wkt


def _simple(kind: Column, coordinates: Column) -> Column:
    """WKT of a geometry that is no collection."""
    out = F.lit(None).cast("string")
    for name, depth in DEPTHS.items():
        read = F.from_json(coordinates, "array<" * (depth + 1) + "double" + ">" * (depth + 1))
        out = F.when(kind == name, let(read, _written(name, depth))).otherwise(out)
    return out


def geometry_wkt(geometry: Column) -> Column:
    """WKT of a geometry's JSON text."""
    member = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))
    members = F.transform(F.from_json(F.get_json_object(geometry, "$.geometries"), member), lambda m: _simple(m["type"], m["coordinates"]))

    def collected(texts: Column) -> Column:
        z = F.exists(texts, lambda t: t.contains(" Z "))
        return F.when((F.size(texts) > 0) & F.forall(texts, lambda t: t.isNotNull()), F.concat(
            F.lit("GEOMETRYCOLLECTION"), F.when(z, F.lit(" Z (")).otherwise(F.lit(" (")), F.array_join(texts, ", "), F.lit(")")))

    kind = F.get_json_object(geometry, "$.type")
    return F.when(kind == "GeometryCollection", let(members, collected)).otherwise(
        _simple(kind, F.get_json_object(geometry, "$.coordinates")))


def features(rows: DataFrame, props: list[str], carry: list[str] | None = None) -> DataFrame:
    """``FEATURE`` rows -> the asked ``props`` (as text, null where missing), all ``properties`` (VARIANT) and ``geometry_wkt``."""
    read = rows.withColumn("__p", F.try_parse_json("properties"))
    return read.select(*(carry or []), *(F.try_variant_get("__p", f"$['{p}']", "string").alias(p) for p in props),
                       F.col("__p").alias("properties"), geometry_wkt(F.col("geometry")).alias("geometry_wkt"))


def collections(docs: DataFrame, text_col: str, props: list[str], carry: list[str] | None = None) -> DataFrame:
    """SC3 over FeatureCollections in a text column: a row for each feature, in ``seq`` order."""
    parsed = F.from_json(F.col(text_col), f"features array<struct<{', '.join(c.replace(' ', ':') for c in FEATURE.split(', ')) }>>")
    rows = docs.select(*(carry or []), F.posexplode(parsed["features"]).alias("seq", "f")).select(*(carry or []), "seq", "f.*")
    return features(rows, props, [*(carry or []), "seq"])


def read_geojson(spark: SparkSession, path: str, props: list[str] = ("uf_codigo", "Valor"),
                 line_delimited: bool = False) -> DataFrame:
    """SC3 over files."""
    if line_delimited:
        return features(spark.read.schema(FEATURE).json(path), list(props))
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType.fromDDL(FEATURE)))])
    return features(spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*"), list(props))


def property_schema(read: DataFrame) -> str:
    """SC4: the schema of all properties, by one aggregate over the features."""
    return read.agg(F.schema_of_variant_agg("properties")).first()[0]


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """SC4 / ST4: the first rows, unordered (the reference's head())."""
    return df.limit(n)


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """SC4: fail early when a source lacks a column the feeders need."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"source is missing columns {missing}; has {df.columns}")
    return df
