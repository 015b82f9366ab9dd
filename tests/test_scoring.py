"""Tiers of coordinates, security evidence and territory reasons on small layers."""

from pyspark.sql import functions as F

from casagrid.operators import scoring as Z
from casagrid.operators import spatial as G


def boxes(spark, rows, schema="feature_idx long, zone string, score double, level string, south double, west double, north double, east double"):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("rings", F.array(G.rectangle_rings("south", "west", "north", "east"))).drop("south", "west", "north", "east")


def test_coordinates_by_tiers(spark):
    rows = [
        (1, -34.6, -58.6, True, None, None, ["a"]), (2, -34.6, -58.6, None, -1.0, -1.0, ["a"]), (3, None, None, None, -34.7, -58.7, ["a"]), (4, None, None, None, None, None, ["a", "b"]),
        (5, None, None, None, None, None, ["miss", "b"]), (6, None, None, None, None, None, ["x", "b"]), (7, None, None, None, None, None, ["x"]), (8, None, None, None, None, None, []), (9, None, -58.6, None, 1.0, None, None),
    ]
    df = spark.createDataFrame(rows, "property_id long, latitude double, longitude double, manually_corrected boolean, detected_latitude double, detected_longitude double, candidates array<string>")
    cache = spark.createDataFrame([("a", -34.61, -58.61, 0.5), ("b", -34.62, -58.62, 0.5), ("miss", None, None, 0.0)], "query string, latitude double, longitude double, confidence double")
    got = {r["property_id"]: (r["coordinate_source"], r["geocoding_status"], r["latitude"], r["geocode_query"]) for r in Z.resolve_coordinates(df, cache).collect()}
    assert got == {
        1: ("manual_location", "not_needed", -34.6, None), 2: ("location", "not_needed", -34.6, None), 3: ("detected_coordinates", "not_needed", -34.7, None), 4: ("geocode_cache", "cache_hit", -34.61, "a"),
        5: ("geocode_cache", "cache_hit", -34.62, "b"), 6: ("geocode_cache", "cache_applied", -34.62, "b"), 7: ("", "cache_miss", None, None), 8: ("", "no_query", None, None), 9: ("", "no_query", None, None),
    }


def test_security_evidence(spark):
    places = spark.createDataFrame([(1, -34.6, -58.6), (2, -34.6, -58.6), (3, -34.7, -58.7), (4, None, None)], "property_id long, latitude double, longitude double")
    zones = boxes(spark, [(1, "low", 10.0, "", -34.61, -58.61, -34.59, -58.59), (2, "same", 50.0, "", -34.61, -58.61, -34.59, -58.59), (3, "none", None, "", -34.71, -58.71, -34.69, -58.69)])
    points = [(i, "cam" if i % 2 else None, -34.6 + i * 1e-4, -58.6) for i in range(12)] + [(99, "cam", -34.65, -58.6)]
    around = spark.createDataFrame(points, "point_id long, point_type string, latitude double, longitude double")
    only = spark.createDataFrame([(7, "point", 50.0, "", -34.6, -58.6), (8, "far", 99.0, "", -34.61, -58.6)], "feature_idx long, zone string, score double, level string, latitude double, longitude double")
    got = {r["property_id"]: r for r in Z.score_security(places, zones, around, point_zones=only).collect()}
    assert got[1]["zone_label"] == "same" and got[1]["coverage_score"] == 50 and got[1]["risk_score"] == 50
    assert got[1]["points_nearby"] == 12 and got[1]["points_by_type"] == {"cam": 6, "otro": 6} and [x["point_id"] for x in got[1]["nearest"]] == list(range(8))
    assert {k: v for k, v in got[2].asDict().items() if k != "property_id"} == {k: v for k, v in got[1].asDict().items() if k != "property_id"}
    assert (got[3]["zone_label"], got[3]["coverage_score"], got[3]["points_nearby"]) == ("none", None, 0) and got[4]["zone_label"] == ""


def test_flood_areas_of_the_own_zone_alone(spark):
    pins = Z.pins_of(spark.createDataFrame([(1, -34.6, -58.6), (2, -34.65, -58.6)], "property_id long, latitude double, longitude double"))
    zoned = pins.select("pin", F.when(F.col("latitude") > -34.62, "Centro").otherwise("Otra").alias("zone"))
    box = lambda i, risk, zone: (i, risk, zone, -34.7, -58.7, -34.5, -58.5)
    floods = boxes(spark, [box(1, 90.0, None), box(2, 20.0, " centro "), box(3, 30.0, "CENTRO"), box(4, 5.0, ""), box(5, 40.0, "centro")], "feature_idx long, risk_score double, assigned_zone string, south double, west double, north double, east double")
    got = {round(r["pin"]["latitude"], 2): (r["flood_risk"], r["flood_matches"], [x["feature_idx"] for x in r["flood_list"]]) for r in Z.flood_matches(pins, floods, zoned).collect()}
    assert got == {-34.6: (40.0, 3, [5, 3, 2]), -34.65: (90.0, 5, [1, 5, 3])}


def test_flood_areas_of_one_shape_are_met_once(spark, monkeypatch):
    ring = [{"lon": x, "lat": y} for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    rows = [(i, float(i % 4), "zona 1" if i % 2 else None, [ring]) for i in range(12)]
    floods = spark.createDataFrame(rows, "feature_idx long, risk_score double, assigned_zone string, rings array<array<struct<lon:double,lat:double>>>")
    pins = Z.pins_of(spark.createDataFrame([(0.5, 0.5), (0.25, 0.5), (5.0, 5.0)], "latitude double, longitude double"))
    zoned = pins.selectExpr("pin", "case when latitude = 0.25 then 'Zona 1' else 'Zona 2' end as zone")
    met, plain = [], Z.candidates
    monkeypatch.setattr(Z, "candidates", lambda points, shapes: met.append(shapes.count()) or plain(points, shapes))
    got = {r["pin"]["latitude"]: (r["flood_risk"], r["flood_matches"], [tuple(x) for x in r["flood_list"]]) for r in Z.flood_matches(pins, floods, zoned).collect()}
    assert got == {0.5: (3.0, 12, [(3, 3.0), (7, 3.0), (11, 3.0)]), 0.25: (3.0, 6, [(3, 3.0), (7, 3.0), (11, 3.0)])}
    assert met == [2]


def test_tables_of_the_properties_are_not_broadcast(spark, tmp_path):
    from casagrid.operators.search import join_base

    for name in ("a", "b", "c"):
        spark.range(2000).selectExpr("id as property_id", f"id % 7 as {name}").write.parquet(f"{tmp_path}/{name}")
    df = join_base(*(spark.read.parquet(f"{tmp_path}/{name}") for name in ("a", "b", "c")))
    before = df.selectExpr("property_id", "a + 1 as a")
    plans = [frame._jdf.queryExecution().executedPlan().toString() for frame in (df, Z.changed_rows(before, df, "property_id", ["a"]))]
    assert not any("Broadcast" in plan for plan in plans) and df.count() == 2000


def test_the_curated_table_is_dealt_by_its_rows(spark, tmp_path, monkeypatch):
    from casagrid.plans import inputs
    from casagrid.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 25)
    spark.range(400).selectExpr("id as p_partkey", "concat('n', id) as p_name", "'b' as p_brand", "1 as p_size", "100.0D as p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    sizes = [r["count"] for r in inputs.curated(spark, str(tmp_path)).groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).count().collect()]
    assert sum(sizes) == 400 and len(sizes) > 12 and max(sizes) <= 50


def test_location_is_scored_with_a_short_plan(spark):
    places = spark.createDataFrame([(1, -34.6, -58.6, "x"), (2, -34.6, -58.6, "x"), (3, None, None, "Far"), (4, None, None, "x")], "property_id long, latitude double, longitude double, locality string")
    zones = boxes(spark, [(1, "near", 10.0, "", -34.61, -58.61, -34.59, -58.59), (2, "far", 80.0, "", -35.0, -59.0, -34.9, -58.9)])
    floods = boxes(spark, [(5, 40.0, None, -34.61, -58.61, -34.59, -58.59)], "feature_idx long, risk_score double, assigned_zone string, south double, west double, north double, east double")
    settled = boxes(spark, [(7, "s", -34.61, -58.61, -34.59, -58.59)], "feature_idx long, settlement string, south double, west double, north double, east double")
    out = Z.score_location(places, zones, floods, settled, ["locality"])
    got = {r["property_id"]: (r["match_method"], r["zone_name"], r["overall_score"], r["flood_matches"], r["settlement"]) for r in out.collect()}
    assert got == {1: ("coordinates", "near", 10.0, 1, "s"), 2: ("coordinates", "near", 10.0, 1, "s"), 3: ("zone", "far", 80.0, None, None), 4: ("", "", None, None, None)}
    # The driver holds a plan and all its later forms.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate ") < 300
