"""Registered queries: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Every builder reads the driver's tables under ``sf_dir`` (through
``riskgrid.sources.derived``) so its work grows with them.  Computed doubles are
rounded the same way on both sides; every computed column is aliased.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.functions import crs, geodesy, wkt
from riskgrid.operators import events as ev
from riskgrid.operators import spatial
from riskgrid.plans import oracle as O
from riskgrid.session import ensure_checkpoint_dir
from riskgrid.sources import derived, sinks

BAND_KM = 50.0  # distance band of the distance query (JO3)

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ------------------------------------------------------------------ shared inputs

def standard_events_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = derived.hazard_tables(spark, sf_dir)
    return ev.standardise_events(ev.union_events(h["floods"], h["droughts"], h["fires"]))


def standard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standardised event table (SC6) as the impact job reads it; ``prepare_events`` cuts its lineage."""
    return standard_events_plan(spark, sf_dir)


def impact_events(spark: SparkSession, sf_dir: str) -> spatial.Prepared:
    return spatial.prepare_events(standard_events(spark, sf_dir))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.customers(spark, sf_dir)


# ------------------------------------------------------------------ events

@register("tagged_events", O.with_(O.EVENT_BASE, O.RAW_EVENTS)
          + "SELECT tipo_evento, origem, polig, additional_value, data_run FROM raw_events")
def q_tagged_events(spark, sf_dir):
    """PR1-PR5 + ST1: untagged flood shapes and drought features through the feeders' tagging, unioned with the fire
    table in the 5-column contract."""
    h = derived.hazard_tables(spark, sf_dir)
    floods = ev.tag_floods(h["floods"].select("polig"), date=derived.RUN_DATE)
    droughts = ev.tag_droughts(h["droughts"].select(F.col("additional_value").alias("uf_codigo"),
                                                    F.col("polig").alias("geometry_wkt")), date=derived.RUN_DATE)
    return ev.tagged_events(floods, droughts, h["fires"])


@register("events_union_standardised", O.with_(O.EVENT_BASE, O.STD_EVENTS)
          + "SELECT tipo_evento, origem, polig, additional_value, data_run, id_polig_evento FROM std_events_id")
def q_events_union_standardised(spark, sf_dir):
    """ST1, FI1, GE5-GE7, PR6."""
    return standard_events_plan(spark, sf_dir)


@register("round_trip_parquet", O.with_(O.EVENT_BASE, O.STD_EVENTS)
          + "SELECT tipo_evento, origem, polig, additional_value, data_run, id_polig_evento FROM std_events_id")
def q_round_trip_parquet(spark, sf_dir):
    """SK1-SK3, SC5, SC6: the standardised events written by day and read again."""
    path = f"{ensure_checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    plan = standard_events_plan(spark, sf_dir)
    if not sinks.write_events(plan, path, partition_by="data_run"):
        return plan
    return spark.read.schema(plan.schema).parquet(path).select(*plan.columns)


# ------------------------------------------------------------------ customers

@register("customer_geometry", O.with_(O.CUSTOMERS) + f"""
SELECT id_customer,
       CASE WHEN shape = 'polygon' THEN polig_customer
            WHEN shape = 'point' THEN 'POINT (' || {O.num('ix')} || ' ' || {O.num('iy')} || ')' END AS geom_customer,
       CASE WHEN shape = 'polygon' THEN 'Polygon' WHEN shape = 'point' THEN 'Point' END AS geometry_type
FROM customers""")
def q_customer_geometry(spark, sf_dir):
    """SC7, PR7, PR8, PR17, GE1, GE2, GE17."""
    c = spatial.customer_geometry(customers(spark, sf_dir))
    return c.select("id_customer", "geom_customer", wkt.geometry_type(F.col("_cg")).alias("geometry_type"))


# ------------------------------------------------------------------ impact

# intersects of a standardised event (box, optional hole when shape = 2) with a customer, in integer units
_HIT = """(
  (c.shape = 'point' AND c.ix BETWEEN e.x0 AND e.x1 AND c.iy BETWEEN e.y0 AND e.y1
     AND NOT (e.shape = 2 AND c.ix > e.hx0 AND c.ix < e.hx1 AND c.iy > e.hy0 AND c.iy < e.hy1))
  OR
  (c.shape = 'polygon' AND c.bx0 <= e.x1 AND e.x0 <= c.bx1 AND c.by0 <= e.y1 AND e.y0 <= c.by1
     AND NOT (e.shape = 2 AND c.bx0 > e.hx0 AND c.bx1 < e.hx1 AND c.by0 > e.hy0 AND c.by1 < e.hy1))
)"""

HITS = f"""hits AS (
  SELECT c.*, e.s, e.tipo_evento, e.origem, e.polig, e.additional_value, e.data_run, e.id_polig_evento,
         e.x0, e.x1, e.y0, e.y1, e.hx0, e.hx1, e.hy0, e.hy1, e.shape AS eshape
  FROM customers c JOIN std_events_id e ON {_HIT}
)"""


def _quad_rows(prefix: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """4 UTM corners (CCW) of a degree box as rows (i, x, y)."""
    rows = []
    for i, (x, y) in enumerate([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]):
        ux, uy = O.utm_sql(O.dval(x), O.dval(y))
        rows.append(f"SELECT id_customer, s, '{prefix}' AS q, {i} AS i, {ux} AS x, {uy} AS y FROM area_pairs")
    return " UNION ALL ".join(rows)


# UTM overlap of convex quads by vertical slabs (midpoint rule), independent of the Spark kernel
AREA_PCT = f"""area_pairs AS (
  SELECT * FROM hits WHERE shape = 'polygon'
), quads AS (
  {_quad_rows('C', 'bx0', 'by0', 'bx1', 'by1')}
  UNION ALL {_quad_rows('E', 'x0', 'y0', 'x1', 'y1')}
  UNION ALL SELECT id_customer, s, q, i, x, y FROM ({_quad_rows('H', 'hx0', 'hy0', 'hx1', 'hy1')}) hq
    WHERE (SELECT eshape FROM area_pairs a WHERE a.id_customer = hq.id_customer AND a.s = hq.s LIMIT 1) = 2
), edges AS (
  SELECT a.id_customer, a.s, a.q, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM quads a JOIN quads b ON a.id_customer = b.id_customer AND a.s = b.s AND a.q = b.q AND b.i = (a.i + 1) % 4
), other AS (
  SELECT 'E' AS q UNION ALL SELECT 'H'
), crossings AS (
  SELECT c.id_customer, c.s, o.q,
         c.x1 + ((c.x1 - o.x1) * (o.y1 - o.y2) - (c.y1 - o.y1) * (o.x1 - o.x2))
               / ((c.x1 - c.x2) * (o.y1 - o.y2) - (c.y1 - c.y2) * (o.x1 - o.x2)) * (c.x2 - c.x1) AS x,
         ((c.x1 - o.x1) * (o.y1 - o.y2) - (c.y1 - o.y1) * (o.x1 - o.x2))
               / ((c.x1 - c.x2) * (o.y1 - o.y2) - (c.y1 - c.y2) * (o.x1 - o.x2)) AS t,
         ((c.x1 - o.x1) * (c.y1 - c.y2) - (c.y1 - o.y1) * (c.x1 - c.x2))
               / ((c.x1 - c.x2) * (o.y1 - o.y2) - (c.y1 - c.y2) * (o.x1 - o.x2)) AS u
  FROM edges c JOIN edges o ON c.id_customer = o.id_customer AND c.s = o.s AND c.q = 'C' AND o.q IN ('E', 'H')
  WHERE ((c.x1 - c.x2) * (o.y1 - o.y2) - (c.y1 - c.y2) * (o.x1 - o.x2)) <> 0
), ranges AS (
  SELECT c.id_customer, c.s, o.q, greatest(min(c.x), min(o.x)) AS lo, least(max(c.x), max(o.x)) AS hi
  FROM quads c JOIN quads o ON c.id_customer = o.id_customer AND c.s = o.s AND c.q = 'C' AND o.q IN ('E', 'H')
  GROUP BY c.id_customer, c.s, o.q
), breaks AS (
  SELECT DISTINCT id_customer, s, q, x FROM (
    SELECT r.id_customer, r.s, r.q, v.x FROM ranges r JOIN quads v
      ON r.id_customer = v.id_customer AND r.s = v.s AND (v.q = 'C' OR v.q = r.q)
    UNION ALL SELECT id_customer, s, q, x FROM crossings WHERE t > 0 AND t < 1 AND u > 0 AND u < 1
    UNION ALL SELECT id_customer, s, q, lo FROM ranges
    UNION ALL SELECT id_customer, s, q, hi FROM ranges
  ) b
), breaks_in AS (
  SELECT b.* FROM breaks b JOIN ranges r ON b.id_customer = r.id_customer AND b.s = r.s AND b.q = r.q
  WHERE r.hi > r.lo AND b.x >= r.lo AND b.x <= r.hi
), slabs AS (
  SELECT id_customer, s, q, x, lead(x) OVER (PARTITION BY id_customer, s, q ORDER BY x) AS nx FROM breaks_in
), cuts AS (
  SELECT sl.id_customer, sl.s, sl.q AS pair_q, e.q AS poly, sl.x, sl.nx,
         min(e.y1 + ((sl.x + sl.nx) / 2 - e.x1) * (e.y2 - e.y1) / (e.x2 - e.x1)) AS ylo,
         max(e.y1 + ((sl.x + sl.nx) / 2 - e.x1) * (e.y2 - e.y1) / (e.x2 - e.x1)) AS yhi
  FROM slabs sl JOIN edges e ON sl.id_customer = e.id_customer AND sl.s = e.s AND (e.q = 'C' OR e.q = sl.q)
  WHERE sl.nx IS NOT NULL AND sl.nx > sl.x
    AND least(e.x1, e.x2) < (sl.x + sl.nx) / 2 AND (sl.x + sl.nx) / 2 < greatest(e.x1, e.x2)
  GROUP BY sl.id_customer, sl.s, sl.q, e.q, sl.x, sl.nx
), overlap AS (
  SELECT a.id_customer, a.s, a.pair_q AS q,
         sum((a.nx - a.x) * greatest(0, least(a.yhi, b.yhi) - greatest(a.ylo, b.ylo))) AS ov
  FROM cuts a JOIN cuts b ON a.id_customer = b.id_customer AND a.s = b.s AND a.pair_q = b.pair_q AND a.x = b.x
   AND a.poly = 'C' AND b.poly = a.pair_q
  GROUP BY a.id_customer, a.s, a.pair_q
), carea AS (
  SELECT a.id_customer, a.s, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area
  FROM quads a JOIN quads b ON a.id_customer = b.id_customer AND a.s = b.s AND a.q = 'C' AND b.q = 'C' AND b.i = (a.i + 1) % 4
  GROUP BY a.id_customer, a.s
), pct AS (
  SELECT p.id_customer, p.s,
         CASE WHEN ca.area > 0 THEN 100 * (coalesce(oe.ov, 0) - coalesce(oh.ov, 0)) / ca.area ELSE 0.0 END AS pct
  FROM area_pairs p JOIN carea ca ON p.id_customer = ca.id_customer AND p.s = ca.s
  LEFT JOIN overlap oe ON oe.id_customer = p.id_customer AND oe.s = p.s AND oe.q = 'E'
  LEFT JOIN overlap oh ON oh.id_customer = p.id_customer AND oh.s = p.s AND oh.q = 'H'
)"""

IMPACT_CTES = O.with_(O.EVENT_BASE, O.STD_EVENTS, O.CUSTOMERS, HITS, AREA_PCT)


def _round_result(df: DataFrame) -> DataFrame:
    return df.withColumn("percentage_area_affected", F.round("percentage_area_affected", 4)) \
             .withColumn("distance_to_event", F.round("distance_to_event", 6))


@register("affected_pairs", IMPACT_CTES + """
SELECT h.id_customer, h.latitude, h.longitude, h.polig_customer, h.description,
       h.tipo_evento, h.origem, h.polig, h.additional_value, h.data_run, h.id_polig_evento,
       true AS is_in_event, CAST(NULL AS DOUBLE) AS distance_to_event,
       CASE WHEN h.shape = 'polygon' THEN round(coalesce(p.pct, 0.0), 4) END AS percentage_area_affected
FROM hits h LEFT JOIN pct p ON p.id_customer = h.id_customer AND p.s = h.s""")
def q_affected_pairs(spark, sf_dir):
    """Flagship: JO2 grid join + JO4 area + PR10 columns, FI7 (is_in_event = true)."""
    return _round_result(spatial.affected_pairs(customers(spark, sf_dir), impact_events(spark, sf_dir)))


@register("affected_customers", IMPACT_CTES + """
SELECT id_customer, count(*) AS n_events FROM hits GROUP BY id_customer""")
def q_affected_customers(spark, sf_dir):
    """JO6: customers hit by at least one event."""
    return spatial.affected_customers(customers(spark, sf_dir), impact_events(spark, sf_dir))


@register("affected_area_pct", IMPACT_CTES + """
SELECT p.id_customer, h.id_polig_evento, round(p.pct, 4) AS percentage_area_affected
FROM pct p JOIN hits h ON p.id_customer = h.id_customer AND p.s = h.s
WHERE round(p.pct, 4) <> 0""")
def q_affected_area_pct(spark, sf_dir):
    """JO4 + FI8: polygon customers with a non-zero affected share (UTM 22S)."""
    c = customers(spark, sf_dir).filter(F.col("polig_customer").isNotNull())
    e = impact_events(spark, sf_dir)
    p = spatial.area_pct_pairs(c, e, cols=("id_polig_evento",), keep=("id_customer",))
    return p.select("id_customer", "id_polig_evento", F.round("percentage_area_affected", 4).alias("percentage_area_affected")) \
        .filter(F.col("percentage_area_affected") != 0)


def _distance_ctes() -> str:
    """``dist``: customers and events apart, with the km between their nearest points.  All shapes are boxes (a point is
    one without sides; ``hx``/``hy`` is the hole of an event) in integer units.  On an axis the nearest
    values are the facing sides, or the lowest common value where the boxes overlap; inside a hole it is the
    nearest side of the hole (equal distances: lowest latitude, then longitude)."""
    not_hit = _HIT
    in_hole = "(shape2 AND bx0 > hx0 AND bx1 < hx1 AND by0 > hy0 AND by1 < hy1)"

    def axis(lo, hi, elo, ehi):
        c = f"CASE WHEN {hi} < {elo} THEN {hi} WHEN {ehi} < {lo} THEN {lo} ELSE greatest({lo}, {elo}) END"
        e = f"CASE WHEN {hi} < {elo} THEN {elo} WHEN {ehi} < {lo} THEN {ehi} ELSE greatest({lo}, {elo}) END"
        return c, e

    (cx, ex), (cy, ey) = axis("bx0", "bx1", "x0", "x1"), axis("by0", "by1", "y0", "y1")
    side = {"db": ("bx0", "by0", "bx0", "hy0"), "dl": ("bx0", "by0", "hx0", "by0"), "dr": ("bx1", "by0", "hx1", "by0"),
            "dt": ("bx0", "by1", "bx0", "hy1")}

    def pick(i, outside):
        return (f"CASE WHEN {in_hole} THEN CASE least(dl, dr, db, dt) " + " ".join(
            f"WHEN {k} THEN {v[i]}" for k, v in side.items()) + f" END ELSE {outside} END")

    d = O.haversine_sql(O.dval("cy"), O.dval("cx"), O.dval("ey"), O.dval("ex"))
    return O.with_(O.EVENT_BASE, O.STD_EVENTS, O.CUSTOMERS) + f"""
, boxed AS (
  SELECT * REPLACE (CASE WHEN shape = 'point' THEN ix ELSE bx0 END AS bx0, CASE WHEN shape = 'point' THEN ix ELSE bx1 END AS bx1,
                    CASE WHEN shape = 'point' THEN iy ELSE by0 END AS by0, CASE WHEN shape = 'point' THEN iy ELSE by1 END AS by1)
  FROM customers
), apart AS (
  SELECT c.id_customer, e.id_polig_evento, c.bx0, c.bx1, c.by0, c.by1, e.x0, e.x1, e.y0, e.y1, e.hx0, e.hx1, e.hy0, e.hy1,
         e.shape = 2 AS shape2, c.bx0 - e.hx0 AS dl, e.hx1 - c.bx1 AS dr, c.by0 - e.hy0 AS db, e.hy1 - c.by1 AS dt
  FROM boxed c JOIN std_events_id e ON c.shape IN ('point', 'polygon') AND NOT {not_hit}
), near AS (
  SELECT id_customer, id_polig_evento, {pick(0, cx)} AS cx, {pick(1, cy)} AS cy, {pick(2, ex)} AS ex, {pick(3, ey)} AS ey FROM apart
), dist AS (
  SELECT id_customer, id_polig_evento, {d} AS d FROM near
)
"""


@register("nearest_event", _distance_ctes() + f""", inside AS (
  SELECT c.id_customer, e.id_polig_evento, 0.0 AS d FROM customers c JOIN std_events_id e ON {_HIT}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id_customer ORDER BY d, id_polig_evento) AS r
  FROM (SELECT * FROM dist UNION ALL SELECT * FROM inside) t
)
SELECT c.id_customer, round(r.d, 6) AS distance_to_event FROM customers c
LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r ON r.id_customer = c.id_customer""")
def q_nearest_event(spark, sf_dir):
    """JO3 in full: km from every customer to its nearest event, however far (0 inside one)."""
    n = spatial.nearest_event(customers(spark, sf_dir), impact_events(spark, sf_dir))
    return n.select("id_customer", F.round("distance_to_event", 6).alias("distance_to_event"))


@register("distance_to_event_km", _distance_ctes()
          + f"SELECT id_customer, id_polig_evento, round(d, 6) AS distance_to_event FROM dist WHERE d <= {BAND_KM!r}")
def q_distance_to_event_km(spark, sf_dir):
    """JO3 as a 50 km band: km from each point or polygon customer to every event it is apart from, in the band."""
    e = impact_events(spark, sf_dir)
    d = spatial.distance_pairs(customers(spark, sf_dir), e, BAND_KM, cols=("id_polig_evento",), keep=("id_customer",))
    return d.select("id_customer", "id_polig_evento", F.round("distance_to_event", 6).alias("distance_to_event"))


# ------------------------------------------------------------------ geometry functions

@register("first_part_2d", O.with_(O.EVENT_BASE, O.RAW_EVENTS, O.ALL_2D) + """
SELECT r.polig AS polig_raw, s.polig AS polig_2d
FROM raw_events r JOIN all_2d s ON r.s = s.s""")
def q_first_part_2d(spark, sf_dir):
    """GE5, GE6, GE7 on all raw hazard polygons."""
    raw = derived.raw_events(spark, sf_dir)
    return raw.select(F.col("polig").alias("polig_raw"), wkt.standardise_wkt(F.col("polig")).alias("polig_2d"))


@register("ring_area_deg2", O.with_(O.EVENT_BASE, O.RAW_EVENTS) + f"""
SELECT polig,
       round(CASE shape WHEN 1 THEN 2.0 * ({O.deg('x1')} - {O.deg('x0')}) * ({O.deg('y1')} - {O.deg('y0')})
                        WHEN 2 THEN ({O.deg('x1')} - {O.deg('x0')}) * ({O.deg('y1')} - {O.deg('y0')})
                                    - ({O.deg('hx1')} - {O.deg('hx0')}) * ({O.deg('hy1')} - {O.deg('hy0')})
                        ELSE ({O.deg('x1')} - {O.deg('x0')}) * ({O.deg('y1')} - {O.deg('y0')}) END, 8) AS area_deg2,
       CASE shape WHEN 1 THEN 10 WHEN 2 THEN 10 ELSE 5 END AS n_vertices
FROM raw_events r JOIN ev_box b USING (s)""")
def q_ring_area_deg2(spark, sf_dir):
    """GE1 + GE15: shoelace area (shells minus holes, all parts) of the raw hazard polygons."""
    raw = derived.raw_events(spark, sf_dir)
    g = wkt.parse_wkt(F.col("polig"))
    return raw.select("polig", F.round(wkt.area(g), 8).alias("area_deg2"), wkt.n_vertices(g).alias("n_vertices"))


def _vertex_sql() -> str:
    rows = []
    shells = {0: ("x0", "y0", "x1", "y1"), 1: ("cx + 2 * h", "y0", "cx + 4 * h", "y1")}
    for part, (a, b, c, d) in shells.items():
        for seq, (x, y) in enumerate(O.box(a, b, c, d)):
            cond = "" if part == 0 else "WHERE shape = 1"
            rows.append(f"SELECT s, {part} AS part, {seq} AS seq, {O.dval(x)} AS x, {O.dval(y)} AS y FROM ev_box {cond}")
    return O.with_(O.EVENT_BASE, O.RAW_EVENTS) + "SELECT r.polig, v.part, v.seq, v.x, v.y FROM (" + \
        " UNION ALL ".join(rows) + ") v JOIN raw_events r ON r.s = v.s"


@register("vertex_rows", _vertex_sql())
def q_vertex_rows(spark, sf_dir):
    """GE16: exterior vertices (part, seq, x, y) of every raw hazard polygon."""
    raw = derived.raw_events(spark, sf_dir).withColumn("_g", wkt.parse_wkt(F.col("polig")))
    return wkt.exterior_vertices(raw, "_g", keep=["polig"])


# ------------------------------------------------------------------ projections

def _customer_points_sql(expr_cols: str) -> str:
    return O.with_(O.CUSTOMERS) + f"SELECT id_customer, {expr_cols} FROM customers WHERE shape = 'point'"


_LAT, _LON = O.deg("iy"), O.deg("ix")
_UX, _UY = O.utm_sql(_LON, _LAT)
_MX, _MY = O.mercator_sql(_LON, _LAT)


@register("haversine_km", _customer_points_sql(
    f"round({O.haversine_sql(_LAT, _LON, '-30.0', '-51.0')}, 6) AS km_to_reference"))
def q_haversine_km(spark, sf_dir):
    """GE10: km from each point customer to (-30, -51)."""
    c = customers(spark, sf_dir).filter(F.col("latitude").isNotNull())
    return c.select("id_customer", F.round(geodesy.haversine_km(F.col("latitude"), F.col("longitude"),
                                                                F.lit(-30.0), F.lit(-51.0)), 6).alias("km_to_reference"))


@register("utm_xy", _customer_points_sql(f"round({_UX}, 3) AS utm_x, round({_UY}, 3) AS utm_y"))
def q_utm_xy(spark, sf_dir):
    """GE11: UTM zone 22S of each point customer (m)."""
    c = customers(spark, sf_dir).filter(F.col("latitude").isNotNull())
    u = geodesy.utm(F.col("longitude"), F.col("latitude"))
    return c.select("id_customer", F.round(u["x"], 3).alias("utm_x"), F.round(u["y"], 3).alias("utm_y"))


@register("mercator_xy", _customer_points_sql(f"round({_MX}, 3) AS merc_x, round({_MY}, 3) AS merc_y"))
def q_mercator_xy(spark, sf_dir):
    """GE12: web Mercator of each point customer (m)."""
    c = customers(spark, sf_dir).filter(F.col("latitude").isNotNull())
    m = geodesy.mercator(F.col("longitude"), F.col("latitude"))
    return c.select("id_customer", F.round(m["x"], 3).alias("merc_x"), F.round(m["y"], 3).alias("merc_y"))


# ------------------------------------------------------------------ clustering

def _pings_sql() -> str:
    dx = ("CASE WHEN event_id % 10 < 6 THEN 3 * ((event_id * 31) % 14) WHEN event_id % 10 < 9 THEN 3 * ((event_id * 31) % 14) + 501 "
          "ELSE 1200 + 3 * ((event_id * 7919) % 6000) END")
    dy = ("CASE WHEN event_id % 10 < 6 THEN 3 * ((event_id * 17) % 13) WHEN event_id % 10 < 9 THEN 3 * ((event_id * 17) % 13) + 501 "
          "ELSE 1200 + 3 * ((event_id * 6101) % 6000) END")
    x = f"(-540000 + 3 * ((user_id * 397) % 20000) + {dx})"
    y = f"(-320000 + 3 * ((user_id * 1009) % 33000) + {dy})"
    return f"""pings AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, ts, event_id,
         CAST({O.deg(y)} AS FLOAT) AS latitude,
         CASE WHEN event_id % 97 <> 0 THEN CAST({O.deg(x)} AS FLOAT) END AS longitude
  FROM events
), imp AS (
  SELECT user_id, ts, event_id,
         coalesce(latitude, CAST(avg(latitude) OVER (PARTITION BY user_id) AS FLOAT)) AS latitude,
         coalesce(longitude, CAST(avg(longitude) OVER (PARTITION BY user_id) AS FLOAT)) AS longitude
  FROM pings WHERE user_id IS NOT NULL
), imputed AS (
  SELECT * FROM imp WHERE latitude IS NOT NULL AND longitude IS NOT NULL
)"""


def _dbscan_sql(src: str, group: str, order: str, eps: float, name: str) -> str:
    """Recursive-CTE DBSCAN over ``src`` rows (columns user_id, latitude, longitude, ...)."""
    g = f"{group}, " if group else ""
    on = (lambda a, b: f"{a}.{group} = {b}.{group} AND ") if group else (lambda a, b: "")
    part = f"PARTITION BY {group} " if group else ""
    return f"""{name}_ranked AS (
  SELECT *, CAST(longitude AS DOUBLE) AS _x, CAST(latitude AS DOUBLE) AS _y,
         row_number() OVER (ORDER BY {order}) AS _rk FROM {src}
), {name}_pts AS (
  SELECT {g}_x, _y, count(*) AS w, min(_rk) AS pid FROM {name}_ranked GROUP BY {g}_x, _y
), {name}_pairs AS (
  SELECT {'a.' + group + ', ' if group else ''}a.pid, b.pid AS npid, b.w AS nw
  FROM {name}_pts a JOIN {name}_pts b ON {on('a', 'b')}(a._x - b._x) * (a._x - b._x) + (a._y - b._y) * (a._y - b._y) <= {eps!r} * {eps!r}
), {name}_core AS (
  SELECT {g}pid FROM {name}_pairs GROUP BY {g}pid HAVING sum(nw) >= 5
), {name}_edges AS (
  SELECT {'p.' + group + ', ' if group else ''}p.pid AS src, p.npid AS dst FROM {name}_pairs p
  JOIN {name}_core a ON {on('p', 'a')}p.pid = a.pid JOIN {name}_core b ON {on('p', 'b')}p.npid = b.pid
), {name}_reach AS (
  SELECT {g}pid AS src, pid AS dst FROM {name}_core
  UNION
  SELECT {'r.' + group + ', ' if group else ''}r.src, e.dst FROM {name}_reach r JOIN {name}_edges e ON {on('r', 'e')}r.dst = e.src
), {name}_root AS (
  SELECT {g}src AS pid, min(dst) AS root FROM {name}_reach GROUP BY {g}src
), {name}_num AS (
  SELECT {g}root, CAST(dense_rank() OVER ({part}ORDER BY root) - 1 AS INTEGER) AS label
  FROM (SELECT DISTINCT {g}root FROM {name}_root) t
), {name}_corelab AS (
  SELECT {'r.' + group + ', ' if group else ''}r.pid, n.label FROM {name}_root r JOIN {name}_num n ON {on('r', 'n')}r.root = n.root
), {name}_border AS (
  SELECT {'p.' + group + ', ' if group else ''}p.pid, min(c.label) AS label FROM {name}_pairs p
  JOIN {name}_corelab c ON {on('p', 'c')}p.npid = c.pid
  WHERE NOT EXISTS (SELECT 1 FROM {name}_core k WHERE {on('k', 'p')}k.pid = p.pid)
  GROUP BY {'p.' + group + ', ' if group else ''}p.pid
), {name}_lab AS (
  SELECT * FROM {name}_corelab UNION ALL SELECT * FROM {name}_border
), {name} AS (
  SELECT r.*, coalesce(l.label, -1) AS _label FROM {name}_ranked r
  JOIN {name}_pts p ON {on('r', 'p')}r._x = p._x AND r._y = p._y
  LEFT JOIN {name}_lab l ON {on('p', 'l')}p.pid = l.pid
)"""


CLUSTER_CTES = "WITH RECURSIVE " + _pings_sql() + ",\n" + _dbscan_sql("imputed", "user_id", "user_id, ts, event_id", 0.002, "du")
ALL_CTES = CLUSTER_CTES + """, labelled AS (
  SELECT user_id, ts, event_id, latitude, longitude, _label AS cluster FROM du WHERE _label <> -1
),
""" + _dbscan_sql("labelled", "", "user_id, ts, event_id", 0.001, "da")


def pings(spark, sf_dir):
    from riskgrid.operators import cluster
    return cluster.ping_source(derived.pings(spark, sf_dir))


@register("impute_mean_user", CLUSTER_CTES + "\nSELECT user_id, event_id, latitude, longitude FROM imputed")
def q_impute_mean_user(spark, sf_dir):
    """SC8, PR16, AG4: float pings with per-user mean imputation."""
    from riskgrid.operators import cluster
    return cluster.impute_mean(pings(spark, sf_dir)).select("user_id", "event_id", "latitude", "longitude")


@register("dbscan_per_user", CLUSTER_CTES + "\nSELECT user_id, latitude, longitude, CAST(_label AS INTEGER) AS cluster FROM du WHERE _label <> -1")
def q_dbscan_per_user(spark, sf_dir):
    """AG5 + FI6: per-user DBSCAN (eps 0.002, min_samples 5), noise dropped."""
    from riskgrid.operators import cluster
    return cluster.dbscan_per_user(pings(spark, sf_dir)).select("user_id", "latitude", "longitude", "cluster")


@register("main_cluster", CLUSTER_CTES + """, per AS (
  SELECT user_id, CAST(_label AS INTEGER) AS cluster, count(*) AS n_points,
         avg(CAST(latitude AS DOUBLE)) AS latitude, avg(CAST(longitude AS DOUBLE)) AS longitude
  FROM du WHERE _label <> -1 GROUP BY user_id, _label
)
SELECT user_id, cluster, n_points, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_points DESC, cluster) AS r FROM per) t WHERE r = 1""")
def q_main_cluster(spark, sf_dir):
    """AG8: each user's main place."""
    from riskgrid.operators import cluster
    m = cluster.main_cluster(cluster.dbscan_per_user(pings(spark, sf_dir)))
    return m.select("user_id", "cluster", "n_points", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@register("dbscan_all", ALL_CTES + "\nSELECT user_id, latitude, longitude, cluster, CAST(_label AS INTEGER) AS label_all FROM da")
def q_dbscan_all(spark, sf_dir):
    """AG6: DBSCAN over all labelled points together (eps 0.001)."""
    from riskgrid.operators import cluster
    return cluster.dbscan_all(cluster.dbscan_per_user(pings(spark, sf_dir))).select(
        "user_id", "latitude", "longitude", "cluster", "label_all")


def _metrics_sql(src: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    on = (lambda a, b: f"{a}.{by} = {b}.{by}") if by else (lambda a, b: "true")
    return f""", mp AS (
  SELECT {g}cluster, CAST(longitude AS DOUBLE) AS x, CAST(latitude AS DOUBLE) AS y FROM {src}
), cent AS (
  SELECT {g}cluster, count(*) AS ni, avg(x) AS cx, avg(y) AS cy FROM mp GROUP BY {g}cluster
), tot AS (
  SELECT {g}count(*) AS n, avg(x) AS ox, avg(y) AS oy FROM mp {'GROUP BY ' + by if by else ''}
), kk AS (
  SELECT {g}count(*) AS k FROM cent {'GROUP BY ' + by if by else ''}
), within AS (
  SELECT {'p.' + by + ', ' if by else ''}p.cluster, sum((p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy)) AS w,
         avg(sqrt((p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy))) AS s
  FROM mp p JOIN cent c ON {on('p', 'c')} AND p.cluster = c.cluster GROUP BY {'p.' + by + ', ' if by else ''}p.cluster
), sums AS (
  SELECT {'c.' + by + ', ' if by else ''}sum(c.ni * ((c.cx - t.ox) * (c.cx - t.ox) + (c.cy - t.oy) * (c.cy - t.oy))) AS b, sum(w.w) AS w
  FROM cent c JOIN within w ON {on('c', 'w')} AND c.cluster = w.cluster JOIN tot t ON {on('c', 't')}
  {'GROUP BY c.' + by if by else ''}
), dbr AS (
  SELECT {'a.' + by + ', ' if by else ''}a.cluster, max((wa.s + wb.s) / sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) AS r
  FROM cent a JOIN cent b ON {on('a', 'b')} AND a.cluster <> b.cluster
  JOIN within wa ON {on('a', 'wa')} AND wa.cluster = a.cluster JOIN within wb ON {on('b', 'wb')} AND wb.cluster = b.cluster
  GROUP BY {'a.' + by + ', ' if by else ''}a.cluster
), db AS (
  SELECT {g}avg(r) AS dbi FROM dbr {'GROUP BY ' + by if by else ''}
)
SELECT {'t.' + by + ', ' if by else ''}t.n, k.k,
       round(CASE WHEN k.k >= 2 AND k.k < t.n THEN (CASE WHEN s.w = 0 THEN 1.0 ELSE (s.b / (k.k - 1)) / (s.w / (t.n - k.k)) END) END, 6) AS calinski_harabasz,
       round(CASE WHEN k.k >= 2 AND k.k < t.n THEN d.dbi END, 6) AS davies_bouldin
FROM tot t JOIN kk k ON {on('t', 'k')} JOIN sums s ON {on('t', 's')} LEFT JOIN db d ON {on('t', 'd')}"""


def _round_metrics(df):
    return df.withColumn("calinski_harabasz", F.round("calinski_harabasz", 6)).withColumn("davies_bouldin", F.round("davies_bouldin", 6))


@register("cluster_metrics", CLUSTER_CTES + ", lab AS (SELECT user_id, latitude, longitude, _label AS cluster FROM du WHERE _label <> -1)"
          + _metrics_sql("lab"))
def q_cluster_metrics(spark, sf_dir):
    """AG7b, AG7c: Calinski-Harabasz and Davies-Bouldin of the per-user labels (as the reference, Q12)."""
    from riskgrid.operators import cluster, metrics
    return _round_metrics(metrics.centroid_metrics(cluster.dbscan_per_user(pings(spark, sf_dir))))


@register("top_labels", ALL_CTES + """
SELECT _label AS label, CAST(dense_rank() OVER (ORDER BY _label) AS INTEGER) AS rank
FROM (SELECT DISTINCT _label FROM da WHERE _label <> -1) t""")
def q_top_labels(spark, sf_dir):
    """AG10, ST3: distinct all-points labels ascending, ranked."""
    from riskgrid.operators import cluster, metrics
    return metrics.top_labels(cluster.dbscan_all(cluster.dbscan_per_user(pings(spark, sf_dir)))).select(
        "label", F.col("rank").cast("int").alias("rank"))


@register("metric_sweep", ALL_CTES + """, rk AS (
  SELECT _label, dense_rank() OVER (ORDER BY _label) AS rank FROM (SELECT DISTINCT _label FROM da WHERE _label <> -1) t
), sweep AS (
  SELECT n.n_clusters, d.user_id, d.latitude, d.longitude, d.cluster
  FROM da d JOIN rk ON d._label = rk._label JOIN range(2, 11) n(n_clusters) ON rk.rank <= n.n_clusters
)""" + _metrics_sql("sweep", "n_clusters"))
def q_metric_sweep(spark, sf_dir):
    """AG9 + FI9: CH and DB for the points of the first n all-points labels, n = 2..10."""
    from riskgrid.operators import cluster, metrics
    return _round_metrics(metrics.metric_sweep(cluster.dbscan_all(cluster.dbscan_per_user(pings(spark, sf_dir)))))


# ------------------------------------------------------------------ map layers

_NORM = "strip_accents(lower(trim(coalesce(tipo_evento, 'None'))))"
_LAYER = (f"CASE {_NORM} WHEN 'secas brasil' THEN 'droughts' WHEN 'incendios brasil' THEN 'fires' "
          "WHEN 'enchentes rs' THEN 'floods' END")
_COLOUR = (f"CASE {_LAYER} WHEN 'droughts' THEN (CASE strip_accents(lower(trim(additional_value))) "
           + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ev.SEVERITY_COLOURS.items())
           + f" END) WHEN 'fires' THEN '{ev.FIRE_COLOUR}' WHEN 'floods' THEN '{ev.FLOOD_COLOUR}' END")
_LAYER_CTES = O.with_(O.EVENT_BASE, O.STD_EVENTS) + f""", layered AS (
  SELECT *, {_NORM} AS tipo_evento_normalizado, {_LAYER} AS layer, {_COLOUR} AS color FROM std_events_id
)"""


def _layered(spark, sf_dir):
    return ev.layers(standard_events(spark, sf_dir))


@register("normalise_text", _LAYER_CTES + "\nSELECT id_polig_evento, tipo_evento_normalizado FROM layered")
def q_normalise_text(spark, sf_dir):
    """PR13: normalised hazard type of every standardised event."""
    return _layered(spark, sf_dir).select("id_polig_evento", "tipo_evento_normalizado")


@register("layer_colours", _LAYER_CTES + "\nSELECT id_polig_evento, layer, color FROM layered")
def q_layer_colours(spark, sf_dir):
    """FI2, PR14, PR15: map layer and colour of every event."""
    return _layered(spark, sf_dir).select("id_polig_evento", "layer", "color")


@register("layer_counts", _LAYER_CTES + """, dim AS (
  SELECT * FROM (VALUES ('droughts'), ('fires'), ('floods'), ('states')) t(layer)
)
SELECT d.layer, CAST(count(l.layer) AS BIGINT) AS n FROM dim d LEFT JOIN layered l ON l.layer = d.layer GROUP BY d.layer""")
def q_layer_counts(spark, sf_dir):
    """AG2 + FI10: events per layer, zero rows for empty layers (no state layer here)."""
    return ev.layer_counts(_layered(spark, sf_dir))


@register("layer_crs", _LAYER_CTES + """
SELECT layer, CAST(4326 AS INTEGER) AS crs, count(*) AS n FROM layered WHERE layer IS NOT NULL GROUP BY layer""")
def q_layer_crs(spark, sf_dir):
    """GE13: the system that each layer's geometry is declared in."""
    return crs.summary(ev.layer_geometries(_layered(spark, sf_dir)), "geom", "layer")


def _bounds_select(by: str) -> str:
    lo_x, lo_y = O.mercator_sql("min(" + O.dval("x0") + ")", "min(" + O.dval("y0") + ")")
    hi_x, hi_y = O.mercator_sql("max(" + O.dval("x1") + ")", "max(" + O.dval("y1") + ")")
    g = f"{by}, " if by else ""
    return (f"SELECT {g}round({lo_x}, 3) AS xmin, round({lo_y}, 3) AS ymin, round({hi_x}, 3) AS xmax, "
            f"round({hi_y}, 3) AS ymax FROM layered WHERE layer IS NOT NULL" + (f" GROUP BY {by}" if by else ""))


def _round_bounds(df):
    return df.select(*[F.round(c, 3).alias(c) if c in ("xmin", "ymin", "xmax", "ymax") else F.col(c) for c in df.columns])


@register("layer_bounds_3857", _LAYER_CTES + "\n" + _bounds_select("layer"))
def q_layer_bounds_3857(spark, sf_dir):
    """GE12 + AG3 per layer: web Mercator bounds of each layer."""
    return _round_bounds(ev.layer_bounds_3857(ev.layer_geometries(_layered(spark, sf_dir))))


@register("total_bounds", _LAYER_CTES + "\n" + _bounds_select(""))
def q_total_bounds(spark, sf_dir):
    """ST2 + AG3: web Mercator bounds over all layers."""
    return _round_bounds(ev.total_bounds_3857(ev.layer_geometries(_layered(spark, sf_dir))))


# ------------------------------------------------------------------ geometry quality

def _box_lists(x0, y0, x1, y1):
    return f"[{x0}, {x1}, {x1}, {x0}, {x0}] AS xs, [{y0}, {y0}, {y1}, {y1}, {y0}] AS ys"


def _ring_lists(points):
    xs, ys = zip(*[*points, points[0]], strict=True)
    return f"[{', '.join(xs)}] AS xs, [{', '.join(ys)}] AS ys"


_SURVEY_RINGS = {
    0: [(0, 0, _box_lists("x0", "y0", "x1", "y1"))],
    1: [(0, 0, _ring_lists([("x0", "y0"), ("x1", "y1"), ("x1", "y0"), ("x0", "y1")]))],
    2: [(0, 0, _ring_lists([("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x1 + h", "y1"), ("x1", "y1"), ("x0", "y1")]))],
    3: [(0, 0, _box_lists("x0", "y0", "x1", "y1")), (0, 1, _ring_lists([("x0", "cy"), ("cx", "cy - h // 2"), ("cx", "cy + h // 2")]))],
    4: [(0, 0, _box_lists("x0", "y0", "x1", "y1")),
        (0, 1, _ring_lists([("x0", "cy"), ("cx", "cy - h // 2"), ("x1", "cy"), ("cx", "cy + h // 2")]))],
    5: [(0, 0, _box_lists("x0", "y0", "x1", "y1")), (0, 1, _box_lists("x1 + h", "y0", "x1 + 2 * h", "y1"))],
    6: [(0, 0, _box_lists("x0", "y0", "x1", "y1")), (1, 0, _box_lists("cx", "cy", "cx + 2 * h", "cy + 2 * h"))],
    7: [(0, 0, _ring_lists([("x0", "y0"), ("x1", "y0"), ("cx", "y0")]))],
}


def _validity_sql() -> str:
    """Validity in whole numbers: all pairs of edges of a polygon, points where rings touch, and vertices on the wrong side."""
    rings = [f"SELECT 's' || s AS id, {part} AS part, {pos} AS pos, {lists} FROM ev_box WHERE s % 8 = {k}"
             for k, shape in _SURVEY_RINGS.items() for part, pos, lists in shape]
    rings += [f"SELECT 'e' || s, 0, 0, {_box_lists('x0', 'y0', 'x1', 'y1')} FROM ev_box",
              f"SELECT 'e' || s, 1, 0, {_box_lists('cx + 2 * h', 'y0', 'cx + 4 * h', 'y1')} FROM ev_box WHERE shape = 1",
              f"SELECT 'e' || s, 0, 1, {_box_lists('hx0', 'hy0', 'hx1', 'hy1')} FROM ev_box WHERE shape = 2",
              f"SELECT 'c' || k, 0, 0, {_box_lists('bx0', 'by0', 'bx1', 'by1')} FROM customers WHERE shape = 'polygon'"]

    def side(p, q, x, y):
        return f"sign(({q[0]} - {p[0]}) * ({y} - {p[1]}) - ({q[1]} - {p[1]}) * ({x} - {p[0]}))"

    def on(e, x, y):
        return (f"{x} BETWEEN least({e}.x1, {e}.x2) AND greatest({e}.x1, {e}.x2) "
                f"AND {y} BETWEEN least({e}.y1, {e}.y2) AND greatest({e}.y1, {e}.y2)")

    ea, eb = (("a.x1", "a.y1"), ("a.x2", "a.y2")), (("b.x1", "b.y1"), ("b.x2", "b.y2"))
    spots = [(f"o{i + 1} = 0 AND {on(e, x, y)}", x, y) for i, (e, (x, y)) in enumerate([("a", eb[0]), ("a", eb[1]), ("b", ea[0]), ("b", ea[1])])]
    spots = [(c.replace("a.", "ax_").replace("b.", "bx_"), x.replace(".", "x_"), y.replace(".", "x_")) for c, x, y in spots]
    names = ", ".join(f"{t}.{c} AS {t}x_{c}" for t in "ab" for c in ("part", "pos", "i", "x1", "y1", "x2", "y2"))
    return O.with_(O.EVENT_BASE, O.CUSTOMERS) + f""", rings AS (
  {' UNION ALL '.join(rings)}
), edges AS (
  SELECT id, part, pos, i, len(xs) - 1 AS m, xs[i] AS x1, ys[i] AS y1, xs[i + 1] AS x2, ys[i + 1] AS y2, xs[1] AS fx, ys[1] AS fy
  FROM (SELECT *, unnest(range(1, len(xs))) AS i FROM rings) t
), sized AS (
  SELECT id, part, pos, max(abs((x1 - fx) * (y2 - fy) - (x2 - fx) * (y1 - fy))) AS width FROM edges GROUP BY id, part, pos
), pairs AS (
  SELECT a.id, a.m, {names},
         {side(ea[0], ea[1], *eb[0])} AS o1, {side(ea[0], ea[1], *eb[1])} AS o2,
         {side(eb[0], eb[1], *ea[0])} AS o3, {side(eb[0], eb[1], *ea[1])} AS o4,
         (a.x2 - a.x1) * (b.x2 - b.x1) + (a.y2 - a.y1) * (b.y2 - b.y1) AS along
  FROM edges a JOIN edges b ON a.id = b.id AND (a.part, a.pos, a.i) < (b.part, b.pos, b.i)
), points AS (
  {' UNION ALL '.join(f"SELECT *, {x} AS px, {y} AS py FROM pairs WHERE {c}" for c, x, y in spots)}
), touching AS (
  SELECT id, ax_part, ax_pos, bx_part, bx_pos, count(DISTINCT (px, py)) AS n FROM points
  WHERE (ax_part, ax_pos) <> (bx_part, bx_pos) GROUP BY ALL
), vertices AS (
  SELECT v.id, v.part, v.pos, w.part AS qpart, w.pos AS qpos,
         sum(CASE WHEN (w.y1 > v.y1) <> (w.y2 > v.y1) AND sign(w.y2 - w.y1) * ((v.x1 - w.x1) * (w.y2 - w.y1) - (w.x2 - w.x1) * (v.y1 - w.y1)) < 0
             THEN 1 ELSE 0 END) % 2 = 1 AS inside,
         max(CASE WHEN (w.x2 - w.x1) * (v.y1 - w.y1) = (w.y2 - w.y1) * (v.x1 - w.x1) AND {on('w', 'v.x1', 'v.y1')} THEN 1 ELSE 0 END) AS on_line
  FROM edges v JOIN edges w ON v.id = w.id AND (v.part, v.pos) <> (w.part, w.pos)
  GROUP BY v.id, v.part, v.pos, v.i, w.part, w.pos
), bad AS (
  SELECT id FROM sized WHERE width = 0
  UNION SELECT id FROM pairs WHERE o1 * o2 < 0 AND o3 * o4 < 0
  UNION SELECT id FROM points WHERE (ax_part, ax_pos) = (bx_part, bx_pos) AND NOT (bx_i - ax_i = 1 OR (ax_i = 1 AND bx_i = m))
  UNION SELECT id FROM pairs WHERE (ax_part, ax_pos) = (bx_part, bx_pos) AND (bx_i - ax_i = 1 OR (ax_i = 1 AND bx_i = m))
    AND o1 = 0 AND o2 = 0 AND along < 0
  UNION SELECT id FROM touching WHERE n > 1
  UNION SELECT id FROM vertices WHERE on_line = 0 AND (
    (part = qpart AND pos > 0 AND qpos = 0 AND NOT inside) OR (part <> qpart AND pos = 0 AND qpos = 0 AND inside))
), judged AS (
  SELECT id, max(width) > 0 AS has_area, id IN (SELECT id FROM bad) AS is_bad FROM sized GROUP BY id
)
SELECT CAST(count_if(NOT is_bad) AS BIGINT) AS n_valid, CAST(count_if(is_bad AND has_area) AS BIGINT) AS n_repaired,
       CAST(count_if(is_bad AND NOT has_area) AS BIGINT) AS n_rejected FROM judged"""


@register("polygon_validity", _validity_sql())
def q_polygon_validity(spark, sf_dir):
    """GE3, GE4, FI3, FI4, AG1 over survey polygons (invalid ones among them), raw hazard polygons and customer polygons."""
    from riskgrid.operators import quality
    polys = derived.survey_polygons(spark, sf_dir).select("polig").unionByName(derived.raw_events(spark, sf_dir).select("polig")).unionByName(
        customers(spark, sf_dir).filter(F.col("polig_customer").isNotNull()).select(F.col("polig_customer").alias("polig")))
    return quality.validity_counts(quality.check_polygons(polys))


_EVEN_ODD_AREA = {0: "4 * h * h", 1: "2 * h * h", 2: "4 * h * h", 3: "4 * h * h - h * h // 2", 4: "4 * h * h - h * h",
                  5: "6 * h * h", 6: "6 * h * h"}


@register("repaired_polygons", O.with_(O.EVENT_BASE) + f"""
SELECT CAST(s AS BIGINT) AS s, s % 8 NOT IN (0, 3) AS was_repaired, CAST(CASE s % 8 WHEN 1 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 6 THEN 2 ELSE 1 END AS INTEGER) AS parts,
       round(CASE s % 8 {' '.join(f'WHEN {k} THEN {v}' for k, v in _EVEN_ODD_AREA.items())} END / 1e8, 6) AS area_deg2
FROM ev_box WHERE s % 8 <> 7""")
def q_repaired_polygons(spark, sf_dir):
    """FI3 + GE4: the survey polygons that are valid or could be repaired, with their parts and even-odd area."""
    from riskgrid.operators import quality
    kept = quality.valid_polygons(quality.check_polygons(derived.survey_polygons(spark, sf_dir)))
    g = kept.withColumn("g", wkt.parse_wkt(F.col("polig")))
    return g.select("s", F.col("repaired").isNotNull().alias("was_repaired"), F.size("g.parts").alias("parts"),
                    F.round(wkt.area(F.col("g")), 6).alias("area_deg2"))


# ------------------------------------------------------------------ KML and GeoJSON sources

def _kml_sql() -> str:
    x0, x1, y0, y1, cx, cy = (O.ctext(c) for c in ("x0", "x1", "y0", "y1", "cx", "cy"))
    box = O.ring(O.box("x0", "y0", "x1", "y1"))
    mixed = (f"'GEOMETRYCOLLECTION (POINT (' || {cx} || ' ' || {cy} || '), LINESTRING (' || {x0} || ' ' || {y0} || ', ' || {x1} || ' ' || {y1} || ')' || "
             f"CASE WHEN s % 3 = 0 THEN ', MULTIPOLYGON ((' || {box} || '))' ELSE '' END || ')'")
    none = "CAST(NULL AS VARCHAR)"
    even = "s % 2 = 0"
    rows = [("0", 0, "Document", "'doc ' || s", none, none, none, "true"), ("1", 1, "Folder", "'events'", "'all & more'", none, none, "true"),
            ("2", 2, "Folder", "'inner'", none, none, none, even),
            ("3", 3, "Placemark", "'a'", none, "'Polygon'", f"'POLYGON Z (' || {O.ring(O.box('x0', 'y0', 'x1', 'y1'), z='5')} || ')'", even),
            (f"CASE WHEN {even} THEN 4 ELSE 2 END", 2, "Placemark", "'b'", "'mixed'", "'GeometryCollection'", mixed, "true"),
            (f"CASE WHEN {even} THEN 5 ELSE 3 END", 1, "Placemark", "'c'", none, none, none, "true")]
    return O.with_(O.EVENT_BASE) + ", inventory AS (" + " UNION ALL ".join(
        f"SELECT CAST(s AS BIGINT) AS s, CAST({seq} AS INTEGER) AS seq, CAST({depth} AS INTEGER) AS depth, '{kind}' AS feature_type, {name} AS name, "
        f"{text} AS description, {geom} AS geometry_type, {w} AS wkt FROM ev_box WHERE {cond}"
        for seq, depth, kind, name, text, geom, w, cond in rows) + ")"


def _kml_inventory(spark, sf_dir):
    from riskgrid.sources import kml
    return kml.inventory(derived.kml_documents(spark, sf_dir), "kml", ["s"])


@register("kml_inventory", _kml_sql() + " SELECT * FROM inventory")
def q_kml_inventory(spark, sf_dir):
    """SC2: every feature of every document, containers included, in order, with its depth."""
    return _kml_inventory(spark, sf_dir).drop("error")


@register("kml_features", _kml_sql() + " SELECT s, name, description, geometry_type, wkt FROM inventory WHERE wkt IS NOT NULL")
def q_kml_features(spark, sf_dir):
    """SC1: the features with a geometry, mixed and nested MultiGeometry whole."""
    from riskgrid.sources import kml
    return kml.features(_kml_inventory(spark, sf_dir)).select("s", "name", "description", "geometry_type", "wkt")


@register("state_boundaries", f"""
WITH placed AS (SELECT n_nationkey AS k, n_name, r_name, -540000 + n_nationkey * 1000 AS x0, -320000 + n_nationkey * 2000 AS y0
            FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'U' || k AS uf, n_name AS state, r_name AS region, 'LINESTRING ' || {O.ring(O.box('x0', 'y0', 'x0 + 900', 'y0 + 900'))} AS wkt FROM placed""")
def q_state_boundaries(spark, sf_dir):
    """SC9: state boundaries with code, name and region."""
    from riskgrid.sources import kml
    return kml.states(kml.features(kml.inventory(derived.state_documents(spark, sf_dir), "kml", [])))


def _geojson_sql() -> str:
    def ring(x0, y0, x1, y1, z=None):
        return O.ring(O.box(x0, y0, x1, y1), fmt=O.num, z=z)

    p = {c: O.num(c) for c in ("x0", "x1", "y0", "y1", "cx", "cy")}
    texts = [f"'POLYGON Z (' || {ring('x0', 'y0', 'x1', 'y1', '5.5')} || ')'",
             f"'MULTIPOLYGON ((' || {ring('x0', 'y0', 'x1', 'y1')} || '), (' || {ring('x0 + 90000', 'y0', 'x1 + 90000', 'y1')} || '))'",
             "CAST(NULL AS VARCHAR)",
             f"'GEOMETRYCOLLECTION (POINT (' || {p['cx']} || ' ' || {p['cy']} || '), LINESTRING (' || {p['x0']} || ' ' || {p['y0']} || ', ' || {p['x1']} || ' ' || {p['y1']} || '))'",
             f"'MULTIPOINT ((' || {p['x0']} || ' ' || {p['y0']} || '), (' || {p['x1']} || ' ' || {p['y1']} || '))'"]
    return O.with_(O.EVENT_BASE) + " UNION ALL ".join(
        f"SELECT CAST(s AS BIGINT) AS s, CAST({i} AS INTEGER) AS seq, 's' || s % 5 AS uf_codigo, '{i}' AS \"Valor\", CAST(s AS BIGINT) AS deep, "
        f"{t} AS geometry_wkt FROM ev_box" for i, t in enumerate(texts))


@register("geojson_features", _geojson_sql())
def q_geojson_features(spark, sf_dir):
    """SC3, PR5: features of every geometry type with the asked properties, and one that nobody asked for from ``properties``."""
    from riskgrid.sources import geojson
    rows = geojson.collections(derived.geojson_documents(spark, sf_dir), "geojson", ["uf_codigo", "Valor"], ["s"])
    return rows.select("s", "seq", "uf_codigo", "Valor", F.variant_get("properties", "$.more.deep[1]", "bigint").alias("deep"), "geometry_wkt")


# ------------------------------------------------------------------ users' places x events

_PLACE_HIT = f"""(m.lon BETWEEN {O.dval('e.x0')} AND {O.dval('e.x1')} AND m.lat BETWEEN {O.dval('e.y0')} AND {O.dval('e.y1')}
  AND NOT (e.shape = 2 AND m.lon > {O.dval('e.hx0')} AND m.lon < {O.dval('e.hx1')}
           AND m.lat > {O.dval('e.hy0')} AND m.lat < {O.dval('e.hy1')}))"""


@register("user_place_hits", CLUSTER_CTES + ", " + O.EVENT_BASE + ", " + O.STD_EVENTS + f""", per AS (
  SELECT user_id, _label AS cluster, count(*) AS n_points,
         avg(CAST(latitude AS DOUBLE)) AS lat, avg(CAST(longitude AS DOUBLE)) AS lon
  FROM du WHERE _label <> -1 GROUP BY user_id, _label
), main AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n_points DESC, cluster) AS r FROM per) t WHERE r = 1
)
SELECT 'user ' || m.user_id AS description, e.id_polig_evento
FROM main m JOIN std_events_id e ON {_PLACE_HIT}""")
def q_user_place_hits(spark, sf_dir):
    """JO7 + JO6: users whose main clustered place lies in an event."""
    from riskgrid.operators import cluster
    places = spatial.user_place_customers(cluster.main_cluster(cluster.dbscan_per_user(pings(spark, sf_dir))))
    e = impact_events(spark, sf_dir)
    hits = spatial.intersecting_pairs(places, e, cols=("id_polig_evento",))
    return hits.select("description", "id_polig_evento")
