"""Geometry as Spark columns.

WKT text is parsed once into a struct (see ``riskgrid.schema.GEOMETRY``)::

    kind   POINT | LINESTRING | POLYGON | MULTIPOINT | MULTILINESTRING | MULTIPOLYGON
    parts  part -> ring (0 = shell, then holes) -> vertex {x, y}
    has_z  the text carried a third ordinate (dropped here)
    xmin ymin xmax ymax   bounding box (null when there is no vertex)

Everything here is built from Spark SQL expressions (regex, split, higher-order
array functions), so it runs in the JVM with no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(expr: Column, fn) -> Column:
    """Bind ``expr`` once and pass it to ``fn`` as a lambda variable.

    Geometry functions refer to their argument many times; without the binding
    every reference copies the argument's whole expression tree, and nested
    calls grow the plan exponentially."""
    return F.transform(F.array(expr), fn)[0]


_NUM = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_COORDS = "array<array<array<array<double>>>>"


def parse_wkt(wkt: Column) -> Column:
    """GE1: WKT string -> geometry struct.  Null in, null out; text that does not parse
    gives null (GE1 rejects it; it is never rewritten).

    The body is rewritten to JSON ('(x y z, ...)' -> '[[x,y], ...]', Z and M dropped)
    and read with one ``from_json`` into part -> ring -> vertex, whatever the kind."""
    t = F.upper(F.trim(wkt))
    return F.when(wkt.isNotNull(), let(F.struct(
        F.regexp_extract(t, r"^([A-Z]+)", 1).alias("kind"),
        F.regexp_replace(t, r"^[A-Z]+\s*(ZM|Z|M)?\s*", "").alias("body"),
        (F.size(F.split(F.trim(F.regexp_extract(t, r"\(+\s*([^,()]*)", 1)), r"\s+")) >= 3).alias("has_z"),
    ), _parse))


def _parse(kb: Column) -> Column:
    kind, body = kb["kind"], kb["body"]
    # numbers as JSON writes them: no sign +, a digit on both sides of the point
    body = F.regexp_replace(body, r"(^|[\s(,])\+", "$1")
    body = F.regexp_replace(body, r"(^|[\s(,-])\.(?=[0-9])", "$10.")
    body = F.regexp_replace(body, r"([0-9])\.(?![0-9])", "$1.0")
    j = F.regexp_replace(body, rf"({_NUM})\s+({_NUM})(?:\s+{_NUM})*", "[$1,$2]")
    j = F.translate(j, "()", "[]")
    # '(x y)' and '(x y, ...)' are already a ring level: '[[x,y], ...]'
    wrapped = (F.when(kind.isin("POINT", "LINESTRING", "LINEARRING"), F.concat(F.lit("[["), j, F.lit("]]")))
               .when(kind == "MULTIPOINT", F.when(j.startswith("[[["), F.concat(F.lit("["), j, F.lit("]")))
                     .otherwise(F.concat(F.lit("[["), j, F.lit("]]"))))
               .when(kind.isin("POLYGON", "MULTILINESTRING"), F.concat(F.lit("["), j, F.lit("]")))
               .when(kind == "MULTIPOLYGON", j))
    coords = F.from_json(wrapped, _COORDS)
    parts = F.transform(F.coalesce(coords, F.array().cast(_COORDS)), lambda p: F.transform(p, lambda r: F.transform(
        r, lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))))
    empty = body.rlike(r"^EMPTY\s*$") & kind.isin("POINT", "LINESTRING", "LINEARRING", "POLYGON", "MULTIPOINT",
                                                  "MULTILINESTRING", "MULTIPOLYGON")
    parts = F.when(empty, F.array().cast("array<array<array<struct<x:double,y:double>>>>")).otherwise(parts)
    read = empty | coords.isNotNull()
    return F.when(read, with_bbox(F.struct(kind.alias("kind"), parts.alias("parts"), (kb["has_z"] & ~empty).alias("has_z"))))


def xs(geom: Column) -> Column:
    return F.flatten(F.flatten(F.transform(geom["parts"], lambda p: F.transform(p, lambda r: F.transform(r, lambda v: v["x"])))))


def ys(geom: Column) -> Column:
    return F.flatten(F.flatten(F.transform(geom["parts"], lambda p: F.transform(p, lambda r: F.transform(r, lambda v: v["y"])))))


def with_bbox(geom: Column) -> Column:
    """(Re)compute the bounding box fields from ``parts``."""
    return let(geom, _with_bbox)


def _with_bbox(g: Column) -> Column:
    gx, gy = xs(g), ys(g)
    return F.struct(
        g["kind"].alias("kind"), g["parts"].alias("parts"), g["has_z"].alias("has_z"),
        F.array_min(gx).alias("xmin"), F.array_min(gy).alias("ymin"),
        F.array_max(gx).alias("xmax"), F.array_max(gy).alias("ymax"),
    )


def point(lon: Column, lat: Column) -> Column:
    """PR7: (lon, lat) -> POINT geometry; null when either is null or NaN (Q20)."""
    ok = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
    v = F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y"))
    g = F.struct(F.lit("POINT").alias("kind"), F.array(F.array(F.array(v))).alias("parts"), F.lit(False).alias("has_z"))
    return F.when(ok, with_bbox(g))


# ---------------------------------------------------------------- formatting

def format_number(x: Column) -> Column:
    """Shortest round-trip decimal text, no exponent, no trailing '.0'."""
    s = x.cast("string")
    plain = F.regexp_replace(s, r"\.0$", "")
    # 1.0E-4 and friends: go through a wide decimal and trim zeros
    dec = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", "")
    return F.when(s.contains("E"), dec).otherwise(plain)


def _vertex_text(v: Column) -> Column:
    return F.concat(format_number(v["x"]), F.lit(" "), format_number(v["y"]))


def _ring_text(r: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(r, _vertex_text), ", "), F.lit(")"))


def _polygon_text(p: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(p, _ring_text), ", "), F.lit(")"))


def to_wkt(geom: Column) -> Column:
    """GE2: geometry struct -> 2-D WKT ('POLYGON ((x y, ...))')."""
    return let(geom, _to_wkt)


def _to_wkt(geom: Column) -> Column:
    kind, parts = geom["kind"], geom["parts"]
    empty = F.size(parts) == 0
    txt = (
        F.when(empty, F.concat(kind, F.lit(" EMPTY")))
        .when(kind == "POINT", F.concat(F.lit("POINT ("), _vertex_text(parts[0][0][0]), F.lit(")")))
        .when(kind.isin("LINESTRING", "LINEARRING"), F.concat(kind, F.lit(" "), _ring_text(parts[0][0])))
        .when(kind == "POLYGON", F.concat(F.lit("POLYGON "), _polygon_text(parts[0])))
        .when(kind == "MULTIPOLYGON", F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(parts, _polygon_text), ", "), F.lit(")")))
        .when(kind == "MULTILINESTRING", F.concat(F.lit("MULTILINESTRING ("), F.array_join(F.transform(parts, lambda p: _ring_text(p[0])), ", "), F.lit(")")))
        .when(kind == "MULTIPOINT", F.concat(F.lit("MULTIPOINT ("), F.array_join(F.transform(parts, lambda p: F.concat(F.lit("("), _vertex_text(p[0][0]), F.lit(")"))), ", "), F.lit(")")))
    )
    return F.when(geom.isNotNull(), txt)


# ---------------------------------------------------------- standardisation

def first_part(geom: Column) -> Column:
    """GE5: MULTIPOLYGON -> its first POLYGON part (other parts are dropped, as the reference does)."""
    return let(geom, _first_part)


def _first_part(geom: Column) -> Column:
    is_multi = geom["kind"] == "MULTIPOLYGON"
    g = F.struct(
        F.when(is_multi, F.lit("POLYGON")).otherwise(geom["kind"]).alias("kind"),
        F.when(is_multi, F.slice(geom["parts"], 1, 1)).otherwise(geom["parts"]).alias("parts"),
        geom["has_z"].alias("has_z"),
    )
    return F.when(geom.isNotNull(), with_bbox(g))


def drop_z(geom: Column, keep_holes: bool = False) -> Column:
    """GE6: 3-D polygon -> 2-D from its exterior ring (holes are lost, as in the reference,
    unless ``keep_holes``); 2-D polygons and non-polygons pass through unchanged."""
    return let(geom, lambda g: _drop_z(g, keep_holes))


def _drop_z(geom: Column, keep_holes: bool) -> Column:
    cut = (geom["kind"] == "POLYGON") & geom["has_z"] & F.lit(not keep_holes)
    parts = F.when(cut, F.transform(geom["parts"], lambda p: F.slice(p, 1, 1))).otherwise(geom["parts"])
    g = F.struct(geom["kind"].alias("kind"), parts.alias("parts"), F.lit(False).alias("has_z"))
    return F.when(geom.isNotNull(), with_bbox(g))


def standardise(geom: Column, keep_all_parts: bool = False, keep_holes: bool = False) -> Column:
    """GE7: first part of a multi-polygon, then drop Z (GE5 then GE6)."""
    g = geom if keep_all_parts else first_part(geom)
    return drop_z(g, keep_holes)


def standardise_wkt(wkt: Column, keep_all_parts: bool = False, keep_holes: bool = False) -> Column:
    return to_wkt(standardise(parse_wkt(wkt), keep_all_parts, keep_holes))


# ------------------------------------------------------------------ measures

def _ring_signed_area2(r: Column) -> Column:
    """Twice the signed shoelace area of a closed ring."""
    n = F.size(r)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(
        F.sequence(F.lit(0), n - 2), F.lit(0.0),
        lambda acc, i: acc + (r[i]["x"] * r[i + 1]["y"] - r[i + 1]["x"] * r[i]["y"]),
    ))


def area(geom: Column) -> Column:
    """GE15: planar area in squared coordinate units; shells minus holes, summed over parts."""
    return let(geom, _area)


def _area(geom: Column) -> Column:
    part_area = lambda p: F.aggregate(
        F.transform(p, lambda r, j: F.when(j == 0, F.abs(_ring_signed_area2(r))).otherwise(-F.abs(_ring_signed_area2(r)))),
        F.lit(0.0), lambda a, b: a + b)
    total = F.aggregate(F.transform(geom["parts"], part_area), F.lit(0.0), lambda a, b: a + b) / 2.0
    return F.when(geom.isNotNull() & geom["kind"].isin("POLYGON", "MULTIPOLYGON"), total).when(geom.isNotNull(), F.lit(0.0))


def n_vertices(geom: Column) -> Column:
    return F.size(xs(geom))


def geometry_type(geom: Column) -> Column:
    """GE17: 'Polygon', 'MultiPolygon', ... (the reference's dispatch names)."""
    names = {"POINT": "Point", "LINESTRING": "LineString", "LINEARRING": "LinearRing", "POLYGON": "Polygon",
             "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return m[geom["kind"]]


def exterior_vertices(df, geom_col: str, keep=()):
    """GE16: one row per exterior vertex: (part, seq, x, y)."""
    return (
        df.select(*keep, F.posexplode(F.col(geom_col)["parts"]).alias("part", "_p"))
        .select(*keep, "part", F.posexplode(F.col("_p")[0]).alias("seq", "_v"))
        .select(*keep, "part", "seq", F.col("_v.x").alias("x"), F.col("_v.y").alias("y"))
    )
