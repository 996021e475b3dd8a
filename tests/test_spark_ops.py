"""Operator tests on Spark: geometry columns, filters, spatial join, clustering."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.functions import text, udfs, wkt
from riskgrid.operators import cluster, events, metrics, spatial
from riskgrid.plans.queries import customers, standard_events_plan
from riskgrid.schema import CUSTOMER
from riskgrid.session import Tables

SF = "/root/testdata/sf0.001"


def test_wkt_round_trip_and_standardise(spark):
    df = spark.createDataFrame([
        ("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))",),
        ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",),
        ("POLYGON Z ((0 0 5, 2 0 5, 2 2 5, 0 2 5, 0 0 5), (0.5 0.5 5, 0.5 1 5, 1 1 5, 0.5 0.5 5))",),
        ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 1 1))",),
        ("POINT (-47.5 -21.25)",),
        (None,),
    ], "w string")
    out = [r[0] for r in df.select(wkt.standardise_wkt(F.col("w"))).collect()]
    assert out[0] == "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"
    assert out[1] == "POLYGON ((0 0, 1 0, 1 1, 0 0))"              # first part only (Q1)
    assert out[2] == "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"          # Z drops holes (Q2)
    assert out[3] == "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 1 1))"  # 2-D keeps holes
    assert out[4] == "POINT (-47.5 -21.25)"
    assert out[5] is None                                            # Q4


def test_area_and_point_in_polygon(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))",)], "w string") \
        .select(wkt.parse_wkt(F.col("w")).alias("g"))
    assert df.select(wkt.area(F.col("g"))).first()[0] == 12.0
    probe = [(0.5, 0.5, True), (2.0, 2.0, False), (1.0, 2.0, True), (4.0, 4.0, True), (5.0, 1.0, False)]
    for x, y, want in probe:
        got = df.select(spatial.point_in_polygon(F.lit(x), F.lit(y), F.col("g"))).first()[0]
        assert got == want, (x, y)


def test_drop_no_data_semantics(spark):
    df = spark.createDataFrame([("si",), ("SI",), (None,), (" ",)], "additional_value string")
    assert sorted(r[0] for r in events.drop_no_data(df).collect()) == [" ", "SI"]


def test_normalise(spark):
    df = spark.createDataFrame([("  Incêndios Brasil ",), ("ENCHENTES RS",), (None,)], "t string")
    got = [r[0] for r in df.select(text.normalise_exact(F.col("t"))).collect()]
    assert got == ["incendios brasil", "enchentes rs", "none"]


def test_layers_by_collation_equal_the_normalised_names(spark):
    names = ["secas brasil", "incendios brasil", "enchentes rs"]
    given = ["  Incêndios Brasil ", "INCE\u0302NDIOS BRASIL", "\tsecas BRASIL\n", "Enchentes RS", "enchentes  rs", "enchentes", "", None,
             "séçàs brasil", "secas中 brasil", "secasbrasil", "ＥＮＣＨＥＮＴＥＳ rs"]
    df = spark.createDataFrame([(i, t, "S1", "o", "POINT (1 2)", "d") for i, t in enumerate(given)],
                               "i int, tipo_evento string, additional_value string, origem string, polig string, data_run string")
    rows = events.layers(df).select("i", "layer", "color", "tipo_evento_normalizado").collect()
    want = {n: events.LAYER_OF[n] for n in names}
    for r in rows:
        if r["i"] != 11:                                   # wide letters are Latin too: folded by both
            assert r["layer"] == want.get(r["tipo_evento_normalizado"]), given[r["i"]]
        assert (r["color"] == "#feb24c") == (r["layer"] == "droughts")
    plan = events.layer_counts(events.layers(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_crs_metadata(spark, tmp_path):
    from riskgrid.functions import crs
    df = spark.createDataFrame([("Secas Brasil", "POLYGON ((0 0, 1 0, 1 1, 0 0))", "s1")], "tipo_evento string, polig string, additional_value string")
    assert crs.crs_of(df, "polig") is None and crs.same((df, "polig")) == 4326
    tagged = crs.tagged(df, "polig")
    assert crs.crs_of(tagged, "polig") == 4326 and crs.crs_of(crs.tagged(crs.declared(df, "polig", 3857), "polig"), "polig") == 3857
    tagged.where("polig is not null").select("polig", "tipo_evento").write.parquet(str(tmp_path / "t"))
    assert crs.crs_of(spark.read.parquet(str(tmp_path / "t")), "polig") == 4326
    layers = events.layers(tagged)
    geoms = events.layer_geometries(layers)
    assert crs.crs_of(geoms, "geom") == 4326 and crs.crs_of(events.total_bounds_3857(geoms), "xmax") == 3857
    assert events.total_bounds_3857(geoms).first()["xmax"] == pytest.approx(111319.49, abs=0.1)
    wrong = events.layers(crs.declared(df, "polig", 3857))
    with pytest.raises(ValueError, match="3857"):
        events.total_bounds_3857(events.layer_geometries(wrong))
    with pytest.raises(ValueError, match="different"):
        events.layer_geometries(wrong, spark.range(1).select(wkt.parse_wkt(F.lit("POINT (1 2)")).alias("geom")))
    cust = crs.declared(spark.createDataFrame([(1, 1.0, 2.0, None, "x")], CUSTOMER), "polig_customer", 32722)
    with pytest.raises(ValueError, match="32722"):
        spatial.prepare_customers(cust)


def test_union_rejects_wrong_schema(spark):
    good = spark.createDataFrame([("a", "b", "POINT (0 0)", " ", "2024-07-31")], "tipo_evento string, origem string, polig string, additional_value string, data_run string")
    bad = spark.createDataFrame([(1,)], "x long")
    with pytest.raises(Exception):
        events.union_events(good, bad)
    assert events.union_events(good, good).count() == 2


@pytest.mark.parametrize("force_shuffle", [False, True])
def test_grid_join_equals_brute_force(spark, force_shuffle):
    c = customers(spark, SF)
    e = spatial.prepare_events(standard_events_plan(spark, SF))
    cfg = spatial.JoinConfig(cell_deg=0.1, force_shuffle=force_shuffle, hot_cell_rows=1)
    c = spatial.prepare_customers(c)
    got = {(r[0], r[1]) for r in spatial.intersecting_pairs(c, e, cfg).select("id_customer", "_ek").collect()}
    # brute force: every pair, numpy kernel on all of them
    cg = c.rows.filter(F.col("_cg").isNotNull())
    allp = cg.crossJoin(e.rows.select("_ek", "_eg"))
    from riskgrid.functions import udfs
    brute = udfs.pair_kernel(allp, "_cg", "_eg", "intersects", "_hit", ["id_customer", "_ek"]).filter("_hit")
    want = {(r[0], r[1]) for r in brute.select("id_customer", "_ek").collect()}
    assert got == want and len(got) > 0


def test_grid_join_plan_has_no_cartesian(spark):
    c = customers(spark, SF)
    e = spatial.prepare_events(standard_events_plan(spark, SF))
    plan = spatial.intersecting_pairs(c, e)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_polygon_customer_distance_and_area(spark):
    cust = spark.createDataFrame([
        (1, None, None, "POLYGON ((-51 -30, -50.9 -30, -50.9 -29.9, -51 -29.9, -51 -30))", "poly"),
        (2, -29.95, -50.5, None, "point"),
    ], CUSTOMER)
    ev = spark.createDataFrame([("x", "o", "POLYGON ((-50.95 -30, -50.8 -30, -50.8 -29.9, -50.95 -29.9, -50.95 -30))", " ", "d")],
                               "tipo_evento string, origem string, polig string, additional_value string, data_run string")
    ev = ev.withColumn("id_polig_evento", events.event_id())
    pct = spatial.area_pct_pairs(cust, ev).collect()
    assert len(pct) == 1 and pct[0]["percentage_area_affected"] == pytest.approx(50.0, abs=0.5)
    d = spatial.distance_pairs(cust, ev, 100.0).collect()
    assert [r["id_customer"] for r in d] == [2]
    # point at lat -29.95, lon -50.5; nearest event point (-50.8, -29.95)
    from riskgrid.functions.geodesy import haversine_km_np
    assert d[0]["distance_to_event"] == pytest.approx(haversine_km_np(-29.95, -50.5, -29.95, -50.8), rel=1e-9)


def test_dbscan_two_groups_and_noise(spark):
    rows = [("u", 0.0, 0.0, 1), ("u", 0.0005, 0.0, 2), ("u", 0.0, 0.0005, 3), ("u", 0.0005, 0.0005, 4), ("u", 0.001, 0.0, 5),
            ("u", 1.0, 1.0, 6), ("u", 1.0005, 1.0, 7), ("u", 1.0, 1.0005, 8), ("u", 1.0005, 1.0005, 9), ("u", 1.001, 1.0, 10),
            ("u", 5.0, 5.0, 11), ("v", 3.0, 3.0, 12)]
    df = spark.createDataFrame(rows, "user_id string, latitude double, longitude double, event_id long")
    lab = cluster.dbscan(df, 0.002, 5, ["user_id"], ["event_id"])
    got = {r["event_id"]: r["cluster"] for r in lab.collect()}
    assert [got[i] for i in range(1, 6)] == [0] * 5
    assert [got[i] for i in range(6, 11)] == [1] * 5
    assert got[11] == -1 and got[12] == -1


def test_impute_mean_and_drop(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None), ("b", 1.0, None), (None, 1.0, 1.0)],
                               "user_id string, latitude float, longitude float")
    out = {(r[0], r[1], r[2]) for r in cluster.impute_mean(df).collect()}
    assert out == {("a", 1.0, 2.0), ("a", 3.0, 2.0)}


def test_centroid_metrics_by_hand(spark):
    rows = [(0, 0.0, 0.0), (0, 0.0, 1.0), (0, 1.0, 0.0), (1, 10.0, 10.0), (1, 10.0, 11.0), (1, 11.0, 10.0)]
    df = spark.createDataFrame(rows, "cluster int, latitude double, longitude double")
    m = metrics.centroid_metrics(df).first()
    # centroids (1/3,1/3) and (10+1/3, 10+1/3); W = 2 * 4/3; B = 6 * 50
    assert m["calinski_harabasz"] == pytest.approx((300.0 / 1) / ((8.0 / 3) / 4))
    s = (2 ** 0.5 / 3 + 2 * (5 ** 0.5 / 3)) / 3  # mean distance to the centroid
    assert m["davies_bouldin"] == pytest.approx(2 * s / (200 ** 0.5))


KML = """<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>doc</name>
<Folder><name>f1</name>
<Placemark><name>RS</name><description>RIO GRANDE DO SUL / SUL</description>
<Polygon><outerBoundaryIs><LinearRing><coordinates>-51,-30,5 -50,-30,5 -50,-29,5 -51,-29,5 -51,-30,5</coordinates></LinearRing></outerBoundaryIs>
<innerBoundaryIs><LinearRing><coordinates>-50.8,-29.8,5 -50.8,-29.2,5 -50.2,-29.2,5 -50.2,-29.8,5 -50.8,-29.8,5</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark>
<Folder><name>f2</name>
<Placemark><name>MG</name><MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon><Polygon><outerBoundaryIs><LinearRing><coordinates>5,5 6,5 6,6 5,5</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark>
</Folder></Folder>
<Placemark><name>P</name><Point><coordinates>-47.5,-21.2</coordinates></Point></Placemark>
<Placemark><name>AC</name><description>ACRE / NORTE</description><LineString><coordinates>-70,-10 -69,-10 -69,-9 -70,-10</coordinates></LineString></Placemark>
<Placemark><name>none</name></Placemark>
</Document></kml>
"""


def test_kml_source(spark, tmp_path):
    from riskgrid.sources import kml
    p = tmp_path / "a.kml"
    p.write_text(KML)
    rows = {r["name"]: r["wkt"] for r in kml.read_kml(spark, str(p)).collect()}
    assert set(rows) == {"RS", "MG", "P", "AC"}          # nested folders walked, no-geometry skipped
    assert rows["RS"].startswith("POLYGON Z ((-51 -30 5, ") and rows["RS"].count("(") == 3
    assert rows["MG"] == "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"
    assert rows["P"] == "POINT (-47.5 -21.2)"
    std = {r[0]: r[1] for r in kml.read_kml(spark, str(p)).select("name", wkt.standardise_wkt(F.col("wkt"))).collect()}
    assert std["RS"] == "POLYGON ((-51 -30, -50 -30, -50 -29, -51 -29, -51 -30))"   # Z: exterior only
    assert std["MG"] == "POLYGON ((0 0, 1 0, 1 1, 0 0))"
    states = kml.read_states(spark, str(p)).filter("uf = 'AC'").first()
    assert (states["state"], states["region"]) == ("ACRE", "NORTE")
    with pytest.warns(UserWarning, match="missing"):
        assert kml.read_states(spark, str(tmp_path / "missing.kml")).count() == 0
    with pytest.warns(UserWarning, match="no file"):
        assert kml.read_states(spark, None).count() == 0
    found = kml.read_inventory(spark, str(p)).orderBy("seq").collect()
    assert [(r["depth"], r["feature_type"], r["name"]) for r in found] == [
        (0, "Document", "doc"), (1, "Folder", "f1"), (2, "Placemark", "RS"), (2, "Folder", "f2"), (3, "Placemark", "MG"),
        (1, "Placemark", "P"), (1, "Placemark", "AC"), (1, "Placemark", "none")]
    assert {r["name"]: r["wkt"] for r in found if r["wkt"]} == rows


def test_kml_geometry_without_losses(spark):
    from riskgrid.sources import kml

    def mark(inner):
        return f"<Placemark>{inner}</Placemark>"

    point, line = "<Point><coordinates> 1,2,3 </coordinates></Point>", "<LineString><coordinates>0,0 1e1,-.5</coordinates></LineString>"
    given = {
        mark(f"<MultiGeometry>{point}{line}</MultiGeometry>"): ("GeometryCollection", "GEOMETRYCOLLECTION Z (POINT Z (1 2 3), LINESTRING (0 0, 1e1 -.5))"),
        mark(f"<MultiGeometry>{line}{line}</MultiGeometry>"): ("MultiLineString", "MULTILINESTRING ((0 0, 1e1 -.5), (0 0, 1e1 -.5))"),
        mark(f"<MultiGeometry><MultiGeometry>{point}</MultiGeometry>{line}</MultiGeometry>"):
            ("GeometryCollection", "GEOMETRYCOLLECTION Z (MULTIPOINT Z ((1 2 3)), LINESTRING (0 0, 1e1 -.5))"),
        mark("<LineString><coordinates>0,0,1 2,2</coordinates></LineString>"): ("LineString", "LINESTRING Z (0 0 1, 2 2 0)"),
        mark("<LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing>"): ("LinearRing", "LINEARRING (0 0, 1 0, 1 1, 0 0)"),
        mark("<Point><coordinates>x,2</coordinates></Point>"): (None, None),
        mark("<MultiGeometry/>"): (None, None), mark("<Polygon/>"): (None, None), mark(""): (None, None)}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)] + [(90, "<kml><Folder>"), (91, None), (92, "")], "i int, doc string")
    got = {r["i"]: r for r in kml.inventory(df, "doc", ["i"]).where("seq = 0 or error is not null").collect() if r["error"] is None or r["i"] < 90}
    for i, want in enumerate(given.values()):
        assert (got[i]["geometry_type"], got[i]["wkt"]) == want
        assert (got[i]["error"] is not None) == (want[0] is None and i != 8)
    errors = [r["i"] for r in kml.inventory(df, "doc", ["i"]).where("error like 'not XML%'").collect()]
    assert sorted(errors) == [90, 92]


def test_geojson_types_and_properties(spark):
    import json
    from riskgrid.sources import geojson
    shapes = [("Point", [1, 2.5]), ("MultiPoint", [[1, 2], [3, 4]]), ("LineString", [[0, 0, 7], [1, 1, 8]]), ("MultiLineString", [[[0, 0], [1, 1]]]),
              ("Polygon", [[[0, 0, 1], [1, 0], [1, 1, 2], [0, 0, 1]]]), ("Polygon", []), ("Circle", [1]), ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]]])]
    want = ["POINT (1 2.5)", "MULTIPOINT ((1 2), (3 4))", "LINESTRING Z (0 0 7, 1 1 8)", "MULTILINESTRING ((0 0, 1 1))",
            "POLYGON Z ((0 0 1, 1 0 0, 1 1 2, 0 0 1))", None, None, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))"]
    feats = [{"type": "Feature", "properties": {"a": i, "b": {"c": [i]}}, "geometry": {"type": t, "coordinates": c}} for i, (t, c) in enumerate(shapes)]
    feats += [{"type": "Feature", "properties": None, "geometry": None},
              {"type": "Feature", "properties": {"a": "x"}, "geometry": {"type": "GeometryCollection", "geometries": [
                  {"type": t, "coordinates": c} for t, c in shapes[:3]]}},
              {"type": "Feature", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Circle", "coordinates": [1]}]}}]
    want += [None, "GEOMETRYCOLLECTION Z (POINT (1 2.5), MULTIPOINT ((1 2), (3 4)), LINESTRING Z (0 0 7, 1 1 8))", None]
    df = spark.createDataFrame([(1, json.dumps({"features": feats})), (2, None), (3, '{"features": []}')], "k int, t string")
    read = geojson.collections(df, "t", ["a", "missing"], ["k"])
    rows = read.orderBy("seq").collect()
    assert [r["geometry_wkt"] for r in rows] == want and [r["a"] for r in rows] == [*map(str, range(8)), None, "x", None]
    assert all(r["missing"] is None for r in rows)
    assert read.where("seq = 3").select(F.variant_get("properties", "$.b.c[0]", "int")).first()[0] == 3
    schema = geojson.property_schema(read.where("seq < 8"))
    assert "a" in schema and "b" in schema and "OBJECT" in schema


def test_geojson_source_and_drought_tags(spark, tmp_path):
    import json
    from riskgrid.sources import geojson
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"uf_codigo": "s1", "Valor": 2},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"uf_codigo": "s3", "Valor": 4},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
    ]}
    p = tmp_path / "d.geojson"
    p.write_text(json.dumps(fc))
    g = geojson.require_columns(geojson.read_geojson(spark, str(p)), ["uf_codigo", "Valor", "geometry_wkt"])
    rows = sorted(g.collect())
    assert rows[0]["geometry_wkt"] == "POLYGON ((0 0, 1 0, 1 1, 0 0))"
    assert rows[1]["geometry_wkt"] == "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"
    ev = events.tag_droughts(g, date="2024-07-31")
    assert ev.columns == ["tipo_evento", "origem", "polig", "additional_value", "data_run"]
    assert {r["additional_value"] for r in ev.collect()} == {"s1", "s3"}
    assert geojson.preview(g, 1).count() == 1


def test_quality_split_and_repair(spark):
    from riskgrid.operators import quality
    df = spark.createDataFrame([
        ("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))",),
        ("POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))",),        # bow-tie: repaired
    ], "polig string")
    checked = quality.check_polygons(df)
    c = quality.validity_counts(checked).first()
    assert (c["n_valid"], c["n_repaired"], c["n_rejected"]) == (1, 1, 0)
    fixed = quality.valid_polygons(checked).select(wkt.area(wkt.parse_wkt(F.col("polig"))).alias("a")).collect()
    assert sorted(round(r["a"], 9) for r in fixed) == [1.0, 2.0]


def test_native_functions_stay_in_jvm(spark):
    from riskgrid.functions import geodesy
    df = spark.createDataFrame([("POLYGON Z ((0 0 1, 1 0 1, 1 1 1, 0 0 1))", -30.0, -51.0)], "w string, lat double, lon double")
    out = df.select(wkt.standardise_wkt(F.col("w")).alias("s"),
                    wkt.to_wkt(wkt.point(F.col("lon"), F.col("lat"))).alias("p"),
                    geodesy.haversine_km(F.col("lat"), F.col("lon"), F.lit(-29.0), F.lit(-51.0)).alias("h"),
                    geodesy.utm(F.col("lon"), F.col("lat")).alias("u"),
                    geodesy.mercator(F.col("lon"), F.col("lat")).alias("m"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapInPandas" not in plan
    r = out.first()
    assert r["s"] == "POLYGON ((0 0, 1 0, 1 1, 0 0))" and r["p"] == "POINT (-51 -30)"
    assert r["u"]["x"] == pytest.approx(500000.0)


EVENT_DDL = "tipo_evento string, origem string, polig string, additional_value string, data_run string, id_polig_evento string"


def box(x0, y0, x1, y1):
    return f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"


def test_rows_not_ids_are_joined(spark):
    """Null event ids, one event twice, one customer id at two places: every row counts once."""
    ev = spark.createDataFrame([
        ("a", "o", box(-51, -30, -50.9, -29.9), " ", None, None),
        ("b", "o", box(-48, -28, -47.9, -27.9), " ", None, None),
        ("c", "o", box(-45, -25, -44.9, -24.9), " ", "d", "c"), ("c", "o", box(-45, -25, -44.9, -24.9), " ", "d", "c"),
    ], EVENT_DDL)
    cust = spark.createDataFrame([
        (1, -29.95, -50.95, None, "in a"), (2, -27.95, -47.95, None, "in b"),
        (3, None, None, box(-45, -25, -44.9, -24.95), "half of c"), (3, None, None, box(-44.95, -25, -44.9, -24.9), "inside c"),
        (4, -24.95, -44.8, None, "near c"), (4, -24.95, -44.7, None, "near c"),
    ], CUSTOMER)
    got = sorted((r.id_customer, r.tipo_evento, r.description) for r in spatial.affected_pairs(cust, ev).collect())
    assert got == [(1, "a", "in a"), (2, "b", "in b"), (3, "c", "half of c"), (3, "c", "half of c"),
                   (3, "c", "inside c"), (3, "c", "inside c")]
    pct = {r.description: round(r.percentage_area_affected) for r in spatial.affected_pairs(cust, ev).where("id_customer = 3").collect()}
    assert pct == {"half of c": 100, "inside c": 100}
    far = spatial.distance_pairs(cust, ev, 60.0).where("id_customer = 4")
    assert far.count() == 4 and far.select(F.round("distance_to_event", 3)).distinct().count() == 2
    assert {r.id_customer: r.n_events for r in spatial.affected_customers(cust, ev).collect()} == {1: 1, 2: 1, 3: 2}


def test_invalid_geometry_has_no_measure(spark):
    bow = "POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))"
    cust = spark.createDataFrame([(1, None, None, bow, "bow-tie"), (2, None, None, box(0.5, 0.5, 1.5, 1.5), "box"),
                                  (3, 1.0, 1.0, None, "point")], CUSTOMER)
    ev = spark.createDataFrame([("e", "o", box(1, 0, 3, 3), " ", "d", "e"), ("p", "o", "POINT (1 1)", " ", "d", "p"),
                                ("g", "o", "garbage", " ", "d", "g")], EVENT_DDL)
    rows = {(r.description, r.tipo_evento): r.percentage_area_affected for r in spatial.affected_pairs(cust, ev).collect()}
    assert rows[("bow-tie", "e")] == 0.0 and rows[("box", "e")] == pytest.approx(50, abs=5)  # far outside its UTM zone
    assert rows[("point", "p")] is None and ("point", "e") in rows          # a point event on the point itself, boundary contact
    assert not [k for k in rows if k[1] == "g"]
    assert spatial.distance_pairs(cust, ev, 500.0).where("id_customer = 1").count() == 0


def test_nearest_event_has_no_limit(spark):
    ev = spark.createDataFrame([("far", "o", box(100, 60, 101, 61), " ", "d", "far"), ("edge", "o", box(179, 0, 179.9, 1), " ", "d", "edge"),
                                ("near", "o", box(0, 0, 1, 1), " ", "d", "near")], EVENT_DDL)
    cust = spark.createDataFrame([(1, 0.5, 0.5, None, "in"), (2, 0.5, 5.0, None, "5 degrees"), (3, 0.5, -179.9, None, "over the date line"),
                                  (4, -80.0, -60.0, None, "south"), (5, None, None, None, "nowhere"), (6, 89.9, 10.0, None, "pole")], CUSTOMER)
    got = {r.id_customer: (r.id_polig_evento, r.distance_to_event) for r in spatial.nearest_event(cust, ev).collect()}
    assert got[1] == ("near", 0.0) and got[2][0] == "near" and got[3][0] == "edge"
    assert got[4][0] == "near" and got[4][1] > 8000 and got[5] == (None, None) and got[6][0] == "far"


def test_numbers_and_rejects_of_wkt(spark):
    df = spark.createDataFrame([("POLYGON ((.5 .5, 1. .5, 1. +1., -.5 1, .5 .5))",), ("garbage",), ("POLYGON EMPTY",)], "w string")
    rows = df.select(wkt.parse_wkt(F.col("w")).alias("g")).collect()
    assert rows[0].g.xmin == -0.5 and rows[0].g.ymax == 1.0 and rows[0].g.xmax == 1.0
    assert rows[1].g is None and rows[2].g.parts == []


def test_packed_cell_and_long_chain(spark):
    """20,000 points of one cell without their pairs; a chain that needs many rounds is one cluster."""
    packed = spark.range(20_000).select(F.lit("u").alias("user_id"), (F.col("id") * 1e-8).alias("longitude"),
                                        ((F.col("id") * 7919 % 20_000) * 1e-8).alias("latitude"), "id")
    lab = cluster.dbscan(packed, 0.002, 5, ["user_id"], ["id"])
    assert lab.where("cluster = 0").count() == 20_000
    chain = spark.range(400).select((F.col("id") * 0.0005).alias("longitude"), F.lit(0.0).alias("latitude"), F.lit("u").alias("user_id"))
    assert cluster.dbscan_per_user(chain).select("cluster").distinct().count() == 1
    twins = spark.createDataFrame([("u", 0.0, 0.0, 1)] * 3 + [("u", 1.0, 1.0, 1)] * 3, "user_id string, latitude double, longitude double, k int")
    assert cluster.dbscan(twins, 0.002, 5, ["user_id"], ["k"]).where("cluster <> -1").count() == 0


def test_worst_neighbour_without_all_pairs(spark):
    rng = np.random.default_rng(5)
    pts = [(int(c), float(x), float(y)) for c in range(60) for x, y in rng.normal(rng.uniform(0, 50, 2), 0.3, (6, 2))]
    got = metrics.centroid_metrics(spark.createDataFrame(pts, "cluster int, longitude double, latitude double")).first()
    cent = {c: np.mean([p[1:] for p in pts if p[0] == c], axis=0) for c in range(60)}
    s = {c: np.mean([np.hypot(*(np.array(p[1:]) - cent[c])) for p in pts if p[0] == c]) for c in range(60)}
    want = np.mean([max((s[i] + s[j]) / np.hypot(*(cent[i] - cent[j])) for j in range(60) if j != i) for i in range(60)])
    assert got.davies_bouldin == pytest.approx(want)


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(0, 3000, 7).select((F.col("id") * 3).alias("k"))
    got = [(r["k"], r["r"]) for r in cluster.global_rank(df, ["k"], "r", Tables(spark)).orderBy("k").collect()]
    assert [r for _, r in got] == list(range(len(got)))


def test_nearest_event_equals_brute_force(spark):
    """Customers near, far, across the date line, at a pole, inside; events of equal shape; null and invalid geometry."""
    from riskgrid.functions import udfs
    rng = np.random.default_rng(9)

    def square(x, y, h):
        return f"POLYGON (({x - h} {y - h}, {x + h} {y - h}, {x + h} {y + h}, {x - h} {y + h}, {x - h} {y - h}))"

    ev = [("t", "o", square(x, y, h), " ", str(i)) for i, (x, y, h) in enumerate(
        [(round(float(rng.uniform(-60, -40)), 2), round(float(rng.uniform(-35, -5)), 2), round(float(rng.uniform(0.01, 1)), 2)) for _ in range(150)])]
    ev += [("t", "o", square(179.5, -10, 0.4), " ", "a"), ("t", "o", square(179.5, -10, 0.4), " ", "b"), ("t", "o", "POLYGON ((0 0, 1 1, 1 0, 0 1, 0 0))", " ", "c"),
           ("t", "o", None, " ", "d"), ("t", "o", "POLYGON EMPTY", " ", "e")]
    ev = spark.createDataFrame(ev, "tipo_evento string, origem string, polig string, additional_value string, data_run string")
    ev = spatial.prepare_events(ev.withColumn("id_polig_evento", events.event_id()))
    cu = [(i, float(rng.uniform(-40, 0)), float(rng.uniform(-70, -30)), None, "p") for i in range(60)]
    cu += [(100 + i, None, None, square(round(float(rng.uniform(-60, -40)), 2), round(float(rng.uniform(-35, -5)), 2), 0.5), "s") for i in range(40)]
    cu += [(200, -10.0, -179.9, None, "over the date line"), (201, 89.9, 0.0, None, "pole"), (202, None, None, None, "none"),
           (203, None, None, "POLYGON ((0 0, 1 1, 1 0, 0 1, 0 0))", "bow-tie"), (200, -10.0, -179.9, None, "repeated")]
    cu = spatial.prepare_customers(spark.createDataFrame(cu, CUSTOMER))
    got = {(r["description"], r["id_customer"]): (r["id_polig_evento"], r["distance_to_event"]) for r in spatial.nearest_event(cu, ev).collect()}
    pairs = cu.rows.where("_cv and _cg.xmin is not null").crossJoin(ev.rows.where("_ev and _eg.xmin is not null").select("_ek", "_eg", "id_polig_evento"))
    want = {}
    for r in udfs.pair_kernel(pairs, "_cg", "_eg", "apart_km", "km", ["id_customer", "description", "id_polig_evento"]).collect():
        key, answer = (r["description"], r["id_customer"]), (r["km"], r["id_polig_evento"])
        want[key] = min(want.get(key, answer), answer)
    assert {k for k, v in got.items() if v[0] is None} == {("none", 202), ("bow-tie", 203)}
    assert len(got) == 105 and set(got) - set(want) == {("none", 202), ("bow-tie", 203)}
    for k, (km, name) in want.items():
        assert got[k] == (name, pytest.approx(km, abs=1e-9)), k


def test_nearest_event_without_events(spark):
    ev = spark.createDataFrame([], "tipo_evento string, origem string, polig string, additional_value string, data_run string")
    cu = spark.createDataFrame([(1, -10.0, -50.0, None, "p")], CUSTOMER)
    r = spatial.nearest_event(cu, ev.withColumn("id_polig_evento", events.event_id())).first()
    assert (r["id_polig_evento"], r["distance_to_event"]) == (None, None)


def test_pairs_are_not_shuffled(spark):
    """Customers and events are dealt by cell once; what comes of the pairs stays where it was made."""
    cfg = spatial.JoinConfig(force_shuffle=True)
    hits = spatial.affected_pairs(customers(spark, SF), standard_events_plan(spark, SF), cfg)
    plan = hits._jdf.queryExecution().executedPlan().toString().splitlines()
    kernels = [i for i, line in enumerate(plan) if "MapInArrow" in line]
    joins = [i for i, line in enumerate(plan) if "SortMergeJoin" in line and "_at" in line]
    assert len(kernels) == len(joins) == 2                    # points, polygons
    above = plan[:kernels[0]] + plan[kernels[0]:joins[0]] + plan[kernels[1]:joins[1]]
    assert not any("Exchange" in line for line in above)


def test_point_measures_equal_the_column_kernels(spark):
    shapes = ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))", "LINESTRING (0 0, 2 2, 5 0)", "POINT (2 2)",
              "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((2 2, 3 2, 3 3, 2 2)))", "POLYGON EMPTY"]
    probe = [(0.5, 0.5), (2.0, 2.0), (1.0, 2.0), (4.0, 4.0), (5.0, 1.0), (-1.0, 2.0), (2.5, 2.2), (0.0, 0.0)]
    df = spark.createDataFrame([(i, w, x, y) for i, (w, (x, y)) in enumerate((w, p) for w in shapes for p in probe)],
                               "i int, w string, x double, y double").withColumn("g", wkt.parse_wkt(F.col("w"))).withColumn("f", udfs.flat(F.col("g")))
    inside = spatial.point_in_polygon(F.col("x"), F.col("y"), F.col("g"))
    want = {r.i: (r.hit, r.km) for r in df.select("i", inside.alias("hit"), F.when(inside, 0.0).otherwise(
        spatial.point_distance_km(F.col("x"), F.col("y"), F.col("g"))).alias("km")).collect()}
    hit = {r.i: r.v for r in udfs.point_kernel(df, F.col("x"), F.col("y"), "f", "intersects", "v", ["i"]).collect()}
    km = {r.i: r.v for r in udfs.point_kernel(df, F.col("x"), F.col("y"), "f", "apart_km", "v", ["i"]).collect()}
    assert hit == {i: h for i, (h, _) in want.items()}
    assert {i for i, v in km.items() if v is None} == {i for i, (_, v) in want.items() if v is None}
    assert all(abs(v - want[i][1]) < 1e-9 for i, v in km.items() if v is not None)
