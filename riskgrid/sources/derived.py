"""Disaster events, customers and location pings derived from the driver's tables.

The driver's tables carry no coordinates, so coordinates are derived with
integer arithmetic in units of 1e-4 degree (``FIXTURES.md`` section 2).  Every
rule is written as a Spark column expression and, in ``riskgrid.plans.oracle``,
as the same SQL for DuckDB, so both engines see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_DATE = "2024-07-31"

# Hazard type labels and their sources, by s_suppkey % 3.
HAZARDS = [
    ("enchentes RS", "IPH"),
    ("Secas Brasil", "monitordesecas.ana.gov.br"),
    ("Incêndios Brasil", "queimadas"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deg(v: Column) -> Column:
    """1e-4 degree units -> double degrees (same rounding as DuckDB)."""
    return v.cast("double") / F.lit(10000).cast("double")


def coord_text(v: Column) -> Column:
    return deg(v).cast("decimal(9,4)").cast("string")


def _ring_text(pts) -> Column:
    items = []
    for i, (x, y) in enumerate(pts):
        if i:
            items.append(F.lit(", "))
        items += [coord_text(x), F.lit(" "), coord_text(y)]
    return F.concat(F.lit("("), *items, F.lit(")"))


def _ring_text_z(pts, z: str) -> Column:
    items = []
    for i, (x, y) in enumerate(pts):
        if i:
            items.append(F.lit(", "))
        items += [coord_text(x), F.lit(" "), coord_text(y), F.lit(" " + z)]
    return F.concat(F.lit("("), *items, F.lit(")"))


def box_ring(x0, y0, x1, y1, clockwise: bool = False):
    if clockwise:
        return [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hazard polygons in the 5-column event contract, one per supplier.

    ``s % 4`` picks the WKT form: 0 box, 1 two-part MULTIPOLYGON, 2 box with a
    quarter-area hole, 3 POLYGON Z (Z = 5 on every vertex)."""
    s = F.col("s_suppkey")
    cx = F.lit(-540000) + (s * 3701) % 60000
    cy = F.lit(-320000) + (s * 5309) % 100000
    h = F.lit(500) + (s % 7) * 500
    x0, x1, y0, y1 = cx - h, cx + h, cy - h, cy + h
    hh = h / 2
    hx0, hx1, hy0, hy1 = (cx - hh).cast("long"), (cx + hh).cast("long"), (cy - hh).cast("long"), (cy + hh).cast("long")
    shell = _ring_text(box_ring(x0, y0, x1, y1))
    second = _ring_text(box_ring(cx + 2 * h, y0, cx + 4 * h, y1))
    hole = _ring_text(box_ring(hx0, hy0, hx1, hy1, clockwise=True))
    shape = s % 4
    polig = (
        F.when(shape == 0, F.concat(F.lit("POLYGON ("), shell, F.lit(")")))
        .when(shape == 1, F.concat(F.lit("MULTIPOLYGON (("), shell, F.lit("), ("), second, F.lit("))")))
        .when(shape == 2, F.concat(F.lit("POLYGON ("), shell, F.lit(", "), hole, F.lit(")")))
        .otherwise(F.concat(F.lit("POLYGON Z ("), _ring_text_z(box_ring(x0, y0, x1, y1), "5"), F.lit(")")))
    )
    kind = s % 3
    tipo = F.when(kind == 0, HAZARDS[0][0]).when(kind == 1, HAZARDS[1][0]).otherwise(HAZARDS[2][0])
    origem = F.when(kind == 0, HAZARDS[0][1]).when(kind == 1, HAZARDS[1][1]).otherwise(HAZARDS[2][1])
    addv = (F.when(kind == 1, F.when(s % 11 == 0, F.lit("si")).otherwise(F.concat(F.lit("s"), (s % 5).cast("string"))))
            .otherwise(F.lit(" ")))
    return table(spark, sf_dir, "supplier").select(
        tipo.alias("tipo_evento"), origem.alias("origem"), polig.alias("polig"),
        addv.alias("additional_value"), F.lit(RUN_DATE).alias("data_run"))


def hazard_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three per-hazard event tables (flood, drought, fire) the union step reads."""
    ev = raw_events(spark, sf_dir)
    return {
        "floods": ev.filter(F.col("tipo_evento") == HAZARDS[0][0]),
        "droughts": ev.filter(F.col("tipo_evento") == HAZARDS[1][0]),
        "fires": ev.filter(F.col("tipo_evento") == HAZARDS[2][0]),
    }


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer locations: ``k%3=0`` box polygon, ``k%50=49`` no geometry, else a point."""
    k = F.col("c_custkey")
    ix = F.lit(-540000) + (k * 7919) % 60000
    iy = F.lit(-320000) + (k * 104729) % 100000
    is_poly = k % 3 == 0
    is_none = (~is_poly) & (k % 50 == 49)
    is_point = ~is_poly & ~is_none
    poly = F.concat(F.lit("POLYGON ("), _ring_text(box_ring(ix - 500, iy - 500, ix + 500, iy + 500)), F.lit(")"))
    desc = F.concat(F.lit("customer "), k.cast("string"), F.lit(" - "),
                    F.when(is_poly, F.lit("polygon")).when(is_none, F.lit("none")).otherwise(F.lit("point")))
    return table(spark, sf_dir, "customer").select(
        k.cast("long").alias("id_customer"),
        F.when(is_point, deg(iy)).alias("latitude"),
        F.when(is_point, deg(ix)).alias("longitude"),
        F.when(is_poly, poly).alias("polig_customer"),
        desc.alias("description"),
    )


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location pings (user_id, latitude, longitude as double) plus the row order (ts, event_id).

    Home (e%10<6), work (e%10<9: home + 501 units) and noise points; the
    longitude is missing when e%97=0 so that imputation has work to do."""
    u, e = F.col("user_id"), F.col("event_id")
    home_dx, home_dy = 3 * ((e * 31) % 14), 3 * ((e * 17) % 13)
    dx = (F.when(e % 10 < 6, home_dx).when(e % 10 < 9, home_dx + 501)
          .otherwise(1200 + 3 * ((e * 7919) % 6000)))
    dy = (F.when(e % 10 < 6, home_dy).when(e % 10 < 9, home_dy + 501)
          .otherwise(1200 + 3 * ((e * 6101) % 6000)))
    x = F.lit(-540000) + 3 * ((u * 397) % 20000) + dx
    y = F.lit(-320000) + 3 * ((u * 1009) % 33000) + dy
    return table(spark, sf_dir, "events").select(
        u.cast("string").alias("user_id"),
        deg(y).alias("latitude"),
        F.when(e % 97 != 0, deg(x)).alias("longitude"),
        F.col("ts"), e.alias("event_id"),
    )


def survey_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons as surveys deliver them, one per supplier, ``s % 8``: 0 box, 1 bow-tie, 2 spike, 3 hole that touches its shell, 4 hole
    from side to side, 5 hole outside, 6 overlapping parts, 7 flat ring."""
    s = F.col("s_suppkey")
    cx = F.lit(-540000) + (s * 3701) % 60000
    cy = F.lit(-320000) + (s * 5309) % 100000
    h = F.lit(500) + (s % 7) * 500
    x0, x1, y0, y1, hh = cx - h, cx + h, cy - h, cy + h, (h / 2).cast("long")
    box = _ring_text(box_ring(x0, y0, x1, y1))

    def closed(*points):
        return _ring_text([*points, points[0]])

    def polygon(*rings):
        return F.concat(F.lit("POLYGON ("), F.concat_ws(", ", *rings), F.lit(")"))

    shapes = [
        polygon(box), polygon(closed((x0, y0), (x1, y1), (x1, y0), (x0, y1))),
        polygon(closed((x0, y0), (x1, y0), (x1, y1), (x1 + h, y1), (x1, y1), (x0, y1))),
        polygon(box, closed((x0, cy), (cx, cy - hh), (cx, cy + hh))),
        polygon(box, closed((x0, cy), (cx, cy - hh), (x1, cy), (cx, cy + hh))),
        polygon(box, _ring_text(box_ring(x1 + h, y0, x1 + 2 * h, y1))),
        F.concat(F.lit("MULTIPOLYGON (("), box, F.lit("), ("), _ring_text(box_ring(cx, cy, cx + 2 * h, cy + 2 * h)), F.lit("))")),
        polygon(closed((x0, y0), (x1, y0), (cx, y0)))]
    polig = shapes[-1]
    for i, shape in enumerate(shapes[:-1]):
        polig = F.when(s % 8 == i, shape).otherwise(polig)
    return table(spark, sf_dir, "supplier").select(s.cast("long").alias("s"), polig.alias("polig"))


def _box_of(s: Column) -> tuple[Column, ...]:
    cx = F.lit(-540000) + (s * 3701) % 60000
    cy = F.lit(-320000) + (s * 5309) % 100000
    h = F.lit(500) + (s % 7) * 500
    return cx, cy, cx - h, cx + h, cy - h, cy + h


def _tuples(points, sep: str, z: str = "") -> Column:
    """Coordinate text 'x,y[,z]' with blanks (KML) between the points."""
    return F.concat_ws(sep, *(F.concat(coord_text(x), F.lit(","), coord_text(y), F.lit(z)) for x, y in points))


def kml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s, kml``: a document per supplier with nested folders (a deeper one for even ``s``), a polygon with Z, a MultiGeometry of
    mixed kinds (a nested one where ``s % 3 = 0``) and a feature without geometry."""
    s = F.col("s_suppkey")
    cx, cy, x0, x1, y0, y1 = _box_of(s)

    def polygon(z: str) -> Column:
        return F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), _tuples(box_ring(x0, y0, x1, y1), " ", z),
                        F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"))

    inner = F.concat(F.lit("<Folder><name>inner</name><Placemark><name>a</name>"), polygon(",5"), F.lit("</Placemark></Folder>"))
    mixed = F.concat(
        F.lit("<Placemark><name>b</name><description>mixed</description><MultiGeometry><Point><coordinates>"), _tuples([(cx, cy)], " "),
        F.lit("</coordinates></Point><LineString><coordinates>"), _tuples([(x0, y0), (x1, y1)], " "), F.lit("</coordinates></LineString>"),
        F.when(s % 3 == 0, F.concat(F.lit("<MultiGeometry>"), polygon(""), F.lit("</MultiGeometry>"))).otherwise(""),
        F.lit("</MultiGeometry></Placemark>"))
    kml = F.concat(
        F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>doc '), s.cast("string"),
        F.lit("</name><Folder><name>events</name><description>all &amp; more</description>"), F.when(s % 2 == 0, inner).otherwise(""), mixed,
        F.lit("</Folder><Placemark><name>c</name></Placemark></Document></kml>"))
    return table(spark, sf_dir, "supplier").select(s.cast("long").alias("s"), kml.alias("kml"))


def state_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kml``: a closed line for each nation, named by its key and described as 'NATION / REGION'."""
    k = F.col("n_nationkey")
    x0, y0 = -540000 + k * 1000, -320000 + k * 2000
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.concat(
        F.lit("<kml><Document><Placemark><name>U"), k.cast("string"), F.lit("</name><description>"), F.col("n_name"), F.lit(" / "), F.col("r_name"),
        F.lit("</description><LineString><coordinates>"), _tuples(box_ring(x0, y0, x0 + 900, y0 + 900), " "),
        F.lit("</coordinates></LineString></Placemark></Document></kml>")).alias("kml"))


def geojson_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s, geojson``: a FeatureCollection per supplier with a polygon (Z on it), a MultiPolygon, a feature without geometry, a
    GeometryCollection and a MultiPoint; properties beyond the asked ones."""
    s = F.col("s_suppkey")
    cx, cy, x0, x1, y0, y1 = _box_of(s)

    def position(x, y, z=""):
        return F.concat(F.lit("["), _tuples([(x, y)], ",", z), F.lit("]"))

    def line(points, z=""):
        return F.concat(F.lit("["), F.concat_ws(",", *(position(x, y, z) for x, y in points)), F.lit("]"))

    box = box_ring(x0, y0, x1, y1)
    geometries = [
        F.concat(F.lit('{"type":"Polygon","coordinates":['), line(box, ",5.5"), F.lit("]}")),
        F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), line(box), F.lit("],["), line(box_ring(x0 + 90000, y0, x1 + 90000, y1)), F.lit("]]}")),
        F.lit("null"),
        F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":'), position(cx, cy),
                 F.lit('},{"type":"LineString","coordinates":'), line([(x0, y0), (x1, y1)]), F.lit("}]}")),
        F.concat(F.lit('{"coordinates":'), line([(x0, y0), (x1, y1)]), F.lit(',"type":"MultiPoint"}'))]
    features = [F.concat(F.lit('{"type":"Feature","properties":{"uf_codigo":"s'), (s % 5).cast("string"), F.lit(f'","Valor":{i},"more":{{"deep":[1,'),
                         s.cast("string"), F.lit(']}},"geometry":'), g, F.lit("}")) for i, g in enumerate(geometries)]
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", *features), F.lit("]}"))
    return table(spark, sf_dir, "supplier").select(s.cast("long").alias("s"), text.alias("geojson"))
