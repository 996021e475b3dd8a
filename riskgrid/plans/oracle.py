"""DuckDB SQL for every registered query (the correctness oracle).

The derived inputs (events from ``supplier``, customers from ``customer``, pings
from ``events``) are rebuilt here with the same integer rules as
``riskgrid.sources.derived``.  Geometry is computed in SQL with box arithmetic
in integer 1e-4 degree units, independent of the Spark geometry code.
"""

from __future__ import annotations

import math

from riskgrid.functions import geodesy


def deg(v: str) -> str:
    return f"(CAST({v} AS DOUBLE) / CAST(10000 AS DOUBLE))"


def ctext(v: str) -> str:
    """decimal(9,4) text as written into the fixture WKT."""
    return f"CAST(CAST({deg(v)} AS DECIMAL(9,4)) AS VARCHAR)"


def num(v: str) -> str:
    """Shortest double text without a trailing '.0' (what GE2 writes)."""
    return f"regexp_replace(CAST(CAST(CAST({deg(v)} AS DECIMAL(9,4)) AS DOUBLE) AS VARCHAR), '\\.0$', '')"


def dval(v: str) -> str:
    """The double a parsed decimal(9,4) coordinate becomes."""
    return f"CAST(CAST({deg(v)} AS DECIMAL(9,4)) AS DOUBLE)"


def ring(pts, fmt=ctext, z: str | None = None) -> str:
    items = []
    for x, y in pts:
        v = f"{fmt(x)} || ' ' || {fmt(y)}" + (f" || ' {z}'" if z else "")
        items.append(v)
    return "'(' || " + " || ', ' || ".join(items) + " || ')'"


def box(x0, y0, x1, y1, cw=False):
    if cw:
        return [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


EVENT_BASE = """ev_base AS (
  SELECT s_suppkey AS s,
         -540000 + (s_suppkey * 3701) % 60000 AS cx,
         -320000 + (s_suppkey * 5309) % 100000 AS cy,
         500 + (s_suppkey % 7) * 500 AS h
  FROM supplier
), ev_box AS (
  SELECT s, cx, cy, h, cx - h AS x0, cx + h AS x1, cy - h AS y0, cy + h AS y1,
         cx - h // 2 AS hx0, cx + h // 2 AS hx1, cy - h // 2 AS hy0, cy + h // 2 AS hy1,
         s % 4 AS shape, s % 3 AS kind
  FROM ev_base
)"""

TIPO = "CASE kind WHEN 0 THEN 'enchentes RS' WHEN 1 THEN 'Secas Brasil' ELSE 'Incêndios Brasil' END"
ORIGEM = "CASE kind WHEN 0 THEN 'IPH' WHEN 1 THEN 'monitordesecas.ana.gov.br' ELSE 'queimadas' END"
ADDV = "CASE WHEN kind = 1 THEN (CASE WHEN s % 11 = 0 THEN 'si' ELSE 's' || CAST(s % 5 AS VARCHAR) END) ELSE ' ' END"


def _raw_polig() -> str:
    shell = ring(box("x0", "y0", "x1", "y1"))
    second = ring(box("cx + 2 * h", "y0", "cx + 4 * h", "y1"))
    hole = ring(box("hx0", "hy0", "hx1", "hy1", cw=True))
    shellz = ring(box("x0", "y0", "x1", "y1"), z="5")
    return (f"CASE shape WHEN 0 THEN 'POLYGON (' || {shell} || ')' "
            f"WHEN 1 THEN 'MULTIPOLYGON ((' || {shell} || '), (' || {second} || '))' "
            f"WHEN 2 THEN 'POLYGON (' || {shell} || ', ' || {hole} || ')' "
            f"ELSE 'POLYGON Z (' || {shellz} || ')' END")


def _std_polig() -> str:
    shell = ring(box("x0", "y0", "x1", "y1"), fmt=num)
    hole = ring(box("hx0", "hy0", "hx1", "hy1", cw=True), fmt=num)
    return f"CASE WHEN shape = 2 THEN 'POLYGON (' || {shell} || ', ' || {hole} || ')' ELSE 'POLYGON (' || {shell} || ')' END"


RAW_EVENTS = f"""raw_events AS (
  SELECT s, {TIPO} AS tipo_evento, {ORIGEM} AS origem, {_raw_polig()} AS polig,
         {ADDV} AS additional_value, '2024-07-31' AS data_run
  FROM ev_box
)"""

STD_EVENTS = f"""std_events AS (
  SELECT b.*, {TIPO} AS tipo_evento, {ORIGEM} AS origem, {_std_polig()} AS polig,
         {ADDV} AS additional_value, '2024-07-31' AS data_run
  FROM ev_box b
  WHERE ({ADDV}) <> 'si'
), std_events_id AS (
  SELECT *, tipo_evento || '_' || origem || '_' || polig || '_' || additional_value || '_' || data_run AS id_polig_evento
  FROM std_events
)"""

ALL_2D = f"""all_2d AS (
  SELECT b.s, {_std_polig()} AS polig FROM ev_box b
)"""

CUSTOMERS = f"""cust_base AS (
  SELECT c_custkey AS k,
         -540000 + (c_custkey * 7919) % 60000 AS ix,
         -320000 + (c_custkey * 104729) % 100000 AS iy,
         CASE WHEN c_custkey % 3 = 0 THEN 'polygon' WHEN c_custkey % 50 = 49 THEN 'none' ELSE 'point' END AS shape
  FROM customer
), customers AS (
  SELECT k, ix, iy, shape, CAST(k AS BIGINT) AS id_customer,
         CASE WHEN shape = 'point' THEN {deg('iy')} END AS latitude,
         CASE WHEN shape = 'point' THEN {deg('ix')} END AS longitude,
         CASE WHEN shape = 'polygon' THEN 'POLYGON (' || {ring(box('ix - 500', 'iy - 500', 'ix + 500', 'iy + 500'))} || ')' END AS polig_customer,
         'customer ' || CAST(k AS VARCHAR) || ' - ' || shape AS description,
         ix - 500 AS bx0, ix + 500 AS bx1, iy - 500 AS by0, iy + 500 AS by1
  FROM cust_base
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------------ geodesy in SQL

def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))")
    return f"(2 * {geodesy.EARTH_RADIUS_KM} * atan2(sqrt({a}), sqrt(1 - {a})))"


def utm_sql(lon: str, lat: str, zone: int = geodesy.DEFAULT_UTM_ZONE) -> tuple[str, str]:
    cm = math.radians(geodesy.utm_central_meridian(zone))
    e = geodesy.UTM_E
    t = f"sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat}))))"
    dl = f"(radians({lon}) - {cm!r})"
    xi = f"atan2({t}, cos({dl}))"
    eta = f"atanh(sin({dl}) / sqrt(1 + {t} * {t}))"
    es, ns = eta, xi
    for j, a in enumerate(geodesy.UTM_ALPHA, start=1):
        es += f" + {a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})"
        ns += f" + {a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})"
    k = geodesy.UTM_K0 * geodesy.UTM_A
    return (f"({geodesy.UTM_FALSE_EASTING!r} + {k!r} * ({es}))", f"({geodesy.UTM_FALSE_NORTHING_SOUTH!r} + {k!r} * ({ns}))")


def mercator_sql(lon: str, lat: str) -> tuple[str, str]:
    r = geodesy.MERCATOR_R
    return (f"({r!r} * radians({lon}))", f"({r!r} * ln(tan({math.pi / 4!r} + radians({lat}) / 2)))")
