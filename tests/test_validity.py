"""GE3 as a relational job, and GE4 with it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.functions import wkt
from riskgrid.operators import quality
from riskgrid.operators.validity import validity


def ring(*points):
    return "(" + ", ".join(f"{x} {y}" for x, y in [*points, points[0]]) + ")"


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def polygon(*rings):
    return f"POLYGON ({', '.join(rings)})"


def multi(*parts):
    return f"MULTIPOLYGON ({', '.join('(' + ', '.join(p) + ')' for p in parts)})"


SHELL = box(0, 0, 8, 8)
CASES = {
    "box": (polygon(SHELL), True),
    "null": (None, None),
    "empty": ("POLYGON EMPTY", True),
    "point": ("POINT (1 2)", True),
    "line that crosses itself": ("LINESTRING (0 0, 2 2, 2 0, 0 2)", True),
    "repeated vertices": ("POLYGON ((0 0, 0 0, 1 0, 1 0, 1 1, 0 0, 0 0))", True),
    "bow-tie": (polygon(ring((0, 0), (1, 1), (1, 0), (0, 1))), False),
    "spike": (polygon(ring((0, 0), (2, 0), (2, 2), (3, 2), (2, 2), (0, 2))), False),
    "spike inwards": (polygon(ring((0, 0), (2, 0), (2, 2), (1, 2), (1, 1), (1, 2), (0, 2))), False),
    "not closed": ("POLYGON ((0 0, 1 0, 1 1, 0 1))", False),
    "too few": ("POLYGON ((0 0, 1 0, 0 0))", False),
    "flat": ("POLYGON ((0 0, 1 0, 2 0, 0 0))", False),
    "ring that touches itself": (polygon(ring((0, 0), (4, 0), (4, 4), (2, 0), (0, 4))), False),
    "hole": (polygon(SHELL, box(1, 1, 2, 2)), True),
    "two holes": (polygon(SHELL, box(1, 1, 2, 2), box(3, 3, 4, 4)), True),
    "hole outside": (polygon(SHELL, box(9, 9, 10, 10)), False),
    "hole across": (polygon(SHELL, box(7, 7, 10, 10)), False),
    "hole around the shell": (polygon(box(1, 1, 2, 2), SHELL), False),
    "hole equal to the shell": (polygon(SHELL, SHELL), False),
    "hole in a hole": (polygon(SHELL, box(1, 1, 5, 5), box(2, 2, 3, 3)), False),
    "hole touches the shell": (polygon(SHELL, ring((0, 2), (1, 1), (1, 3))), True),
    "hole touches the shell twice": (polygon(SHELL, ring((0, 2), (2, 0), (2, 2))), False),
    "holes touch": (polygon(SHELL, ring((1, 1), (3, 1), (3, 3)), ring((3, 3), (5, 3), (5, 5))), True),
    "holes touch twice": (polygon(SHELL, ring((1, 1), (3, 1), (3, 5), (1, 5), (2, 3)), ring((3, 1), (5, 3), (3, 5), (4, 3))), False),
    "chain of holes from side to side": (polygon(SHELL, ring((0, 4), (2, 3), (4, 4), (2, 5)), ring((4, 4), (6, 3), (8, 4), (6, 5))), False),
    "chain of holes to one side": (polygon(SHELL, ring((0, 4), (2, 3), (4, 4), (2, 5)), ring((4, 4), (6, 3), (7, 4), (6, 5))), True),
    "ring of three holes": (polygon(SHELL, ring((2, 2), (4, 1), (6, 2)), ring((6, 2), (7, 4), (4, 6)), ring((4, 6), (1, 4), (2, 2))), False),
    "hole along the shell": (polygon(SHELL, box(0, 2, 2, 4)), False),
    "parts apart": (multi([SHELL], [box(9, 9, 10, 10)]), True),
    "parts touch at a corner": (multi([SHELL], [box(8, 8, 9, 9)]), True),
    "parts touch twice": (multi([SHELL], [ring((8, 2), (9, 3), (8, 4), (10, 3))]), True),
    "parts share an edge": (multi([SHELL], [box(8, 0, 9, 8)]), False),
    "parts overlap": (multi([SHELL], [box(7, 7, 9, 9)]), False),
    "part in a part": (multi([SHELL], [box(1, 1, 2, 2)]), False),
    "part around a part": (multi([box(1, 1, 2, 2)], [SHELL]), False),
    "equal parts": (multi([SHELL], [SHELL]), False),
    "part in a hole": (multi([SHELL, box(1, 1, 5, 5)], [box(2, 2, 3, 3)]), True),
    "part in a hole that touches it": (multi([SHELL, box(1, 1, 5, 5)], [ring((1, 2), (3, 1.5), (3, 3))]), True),
    "not finite": ("POLYGON ((0 0, 1e999 0, 1 1, 0 0))", False),
}


def star(n, seed, cross=False):
    """A ring of many vertices around the origin; ``cross`` swaps two that lie far apart."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) * 2 * np.pi / n
    r = rng.uniform(5, 6, n)
    points = [(float(a), float(b)) for a, b in zip(r * np.cos(t), r * np.sin(t), strict=True)]
    if cross:
        points[n // 4], points[n // 2] = points[n // 2], points[n // 4]
    return polygon(ring(*points), box(-1, -1, 1, 1))


def test_validity_of_many_shapes(spark):
    cases = CASES | {f"star {n}": (star(n, n), True) for n in (50, 700, 3000)}
    cases |= {f"crossed star {n}": (star(n, n, True), False) for n in (50, 700, 3000)}
    df = spark.createDataFrame([(i, name, w) for i, (name, (w, _)) in enumerate(cases.items())], "i long, name string, w string")
    got = {r["i"]: r["is_valid"] for r in validity(df.withColumn("g", wkt.parse_wkt(F.col("w"))), "i", "g").collect()}
    wrong = {name: got[i] for i, (name, (_, want)) in enumerate(cases.items()) if got[i] != want}
    assert not wrong


def test_validity_without_polygons(spark):
    df = spark.createDataFrame([(1, "POINT (1 2)")], "i long, w string").withColumn("g", wkt.parse_wkt(F.col("w")))
    assert [tuple(r) for r in validity(df, "i", "g").collect()] == [(1, True)]
    assert validity(df.limit(0), "i", "g").count() == 0


def test_repaired_rows_are_valid(spark):
    df = spark.createDataFrame([(name, w, "x") for name, (w, _) in CASES.items()] * 2, "name string, polig string, _row string")
    rows = quality.check_polygons(df.drop("_row")).collect()
    assert len(rows) == 2 * len(CASES)
    for r in rows:
        assert r["is_valid"] == CASES[r["name"]][1]
        assert (r["repaired"] is None) == (r["is_valid"] is not False)
        empty = r["repaired"] == "POLYGON EMPTY"
        assert r["valid_after"] == (r["is_valid"] is not None and not empty), r
        assert empty == (r["name"] in ("too few", "flat", "hole equal to the shell", "equal parts", "not finite")), r


@pytest.mark.parametrize("extra", ["_ck", "_ek", "k"])
def test_clashing_names(spark, extra):
    df = spark.createDataFrame([("POLYGON ((0 0, 1 1, 1 0, 0 1, 0 0))", 7)], f"polig string, {extra} long")
    r = quality.check_polygons(df).first()
    assert (r[extra], r["is_valid"], r["valid_after"]) == (7, False, True)


def test_repair_is_spread_over_tasks(spark):
    # few bytes in one partition, but work in every row
    bow = [f"POLYGON (({i} 0, {i + 1} 1, {i + 1} 0, {i} 1, {i} 0))" for i in range(64)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(bow)], "id long, polig string").coalesce(1)
    out = quality.check_polygons(df)
    assert {(r.is_valid, r.valid_after) for r in out.collect()} == {(False, True)}
    assert out.count() == 64 and out.select(F.input_file_name()).distinct().count() > 4
