import random

import numpy as np
from pyspark.sql import functions as F

from casagrid.functions.geo import haversine_m
from casagrid.operators import quantiles as K
from casagrid.operators import spatial as G
from casagrid.operators.trace_rules import metres

RING = "array<array<struct<lon:double,lat:double>>>"


def ring(points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def layer(spark, rows):
    return spark.createDataFrame(rows, f"feature_idx long, zone string, score double, area double, rings {RING}")


def test_haversine(spark):
    row = spark.range(1).select((haversine_m(F.lit(-34.6), F.lit(-58.6), F.lit(-34.61), F.lit(-58.6)) / 1000).alias("d"), haversine_m(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("n")).first()
    assert abs(row["d"] - 1.11) < 0.01 and row["n"] is None


def test_hole_boundary_and_ties(spark):
    big = [ring([(0, 0), (1, 0), (1, 1), (0, 1)]), ring([(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6)])]
    other = [ring([(0, 0), (2, 0), (2, 2), (0, 2)])]
    zones = layer(spark, [(0, "a", 10.0, 1.0, big), (1, "b", 10.0, 4.0, other)])
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.1, 0.1), (3, 0.0, 0.5), (4, 1.5, 1.5), (5, None, 1.0)], "id long, latitude double, longitude double")
    first = {r["id"]: r["zone"] for r in G.first_covering(pts, zones, "id", ["zone"]).collect()}
    assert first == {1: "b", 2: "a", 3: "a", 4: "b"}
    assert {r["id"]: r["zone"] for r in G.best_score_covering(pts, zones, "id", ["zone"]).collect()}[2] == "a"
    assert {r["id"]: r["zone"] for r in G.best_score_covering(pts, zones, "id", ["zone"], True).collect()}[2] == "b"
    near = {r["id"]: (r["zone"], r["match"]) for r in G.covering_or_nearest(pts, zones.filter("feature_idx = 0"), "id", ["zone"], 500.0).collect()}
    assert near[1] == ("a", "nearest") and near[2] == ("a", "polygon") and 4 not in near


def test_radius_join_equals_brute_force(spark):
    rnd = random.Random(7)
    left = [(i, -34.6 + rnd.uniform(-0.03, 0.03), -58.6 + rnd.uniform(-0.03, 0.03)) for i in range(200)]
    right = [(i, -34.6 + rnd.uniform(-0.03, 0.03), -58.6 + rnd.uniform(-0.03, 0.03)) for i in range(150)]
    a = spark.createDataFrame(left, "id long, latitude double, longitude double")
    b = spark.createDataFrame(right, "rid long, latitude double, longitude double")
    got = {(r["id"], r["rid"]) for r in G.radius_pairs(a, b, 700.0).collect()}
    want = {(x[0], y[0]) for x in left for y in right if metres(x[1], x[2], y[1], y[2]) <= 700.0}
    assert got == want


def test_exact_percentiles_with_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.choice([1.5, 100.0, 100.0, rnd.uniform(0, 1e6)])) for _ in range(3000)] + [("cold", float(i)) for i in range(7)] + [(None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in K.percentiles(df, ["k"], "v", {"q1": 0.25, "med": 0.5, "q3": 0.75}).collect()}
    for key in ("hot", "cold"):
        values = [v for k, v in rows if k == key]
        assert np.allclose([got[key][c] for c in ("q1", "med", "q3")], np.quantile(values, [0.25, 0.5, 0.75]))
    assert got[None]["med"] == 4.0


def test_boxes_of_all_sizes_meet_once(spark):
    rnd = random.Random(12)
    boxes = [(0, -40.0, -63.0, -30.0, -53.0)]  # one feature as large as a province
    for i in range(1, 120):
        s, w, side = -34.6 + rnd.uniform(-0.05, 0.05), -58.6 + rnd.uniform(-0.05, 0.05), rnd.choice((0.0005, 0.004, 0.03))
        boxes.append((i, s, w, s + side, w + side * rnd.uniform(0.5, 2)))
    rings = [(i, [[(w, s), (e, s), (e, n), (w, n), (w, s)]]) for i, s, w, n, e in boxes]
    layer = spark.createDataFrame(rings, "feature_idx int, rings array<array<struct<lon:double,lat:double>>>")
    got = [tuple(r) for r in G.bbox_conflicts(layer).collect()]
    far = 1e-4  # boxes are widened by less than this
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    most = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] - far <= b[3] and b[1] - far <= a[3] and a[2] - far <= b[4] and b[2] - far <= a[4]}
    assert len(got) == len(set(got)) and want <= set(got) <= most


def test_copies_of_pins_and_shapes_are_met_once(spark, monkeypatch):
    shape = [ring([(0, 0), (0.001, 0), (0.001, 0.001), (0, 0.001)])]
    areas = layer(spark, [(i, f"z{i}", 1.0, 1.0, shape) for i in range(9, -1, -1)])
    pts = spark.createDataFrame([(i, 0.002, 0.0005) for i in range(20)] + [(20, 0.9, 0.9), (21, None, 0.1)], "id long, latitude double, longitude double")
    met, plain = [], G.candidates
    monkeypatch.setattr(G, "candidates", lambda points, shapes, margin: met.append((points.count(), shapes.count())) or plain(points, shapes, margin))
    got = G.nearest_feature(pts, areas, "id", ["zone"], 1000.0).collect()
    assert sorted((r["id"], r["zone"], round(r["distance_m"])) for r in got) == [(i, "z0", 111) for i in range(20)]
    assert met[0] == (2, 1) and met[1][1] == 1
