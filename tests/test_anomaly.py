"""Anomalies over Parquet files of few bytes and many rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from casagrid.operators import anomaly as A
from casagrid.operators import stats as M


@pytest.fixture(scope="module")
def properties(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("curated") / "table")
    k = F.col("id")
    spark.range(600).select(
        k.alias("property_id"), F.lit("casa").alias("title"), F.lit("").alias("description"), F.lit("house").alias("property_type"), F.lit("sale").alias("operation"), F.lit("used").alias("condition_category"),
        F.lit("6-20").alias("age_band"), F.lit("USD").alias("currency"), F.lit("Zona").alias("geo_zone"), F.lit("").alias("locality"), *[F.lit(3).alias(c) for c in ("rooms", "bedrooms", "bathrooms", "garages")],
        *[F.lit(50).cast("decimal(10,2)").alias(c) for c in ("covered_area", "land_area", "total_area")], F.lit(90000).cast("decimal(16,2)").alias("price"),
        (1000 + k % 7 + F.when(k == 5, 5000).otherwise(0)).cast("decimal(18,2)").alias("price_m2"), (50 + k % 40).cast("decimal(10,2)").alias("comparable_area"),
        (50000 + (k % 40) * 1000 + F.when(k == 9, 30000).otherwise(k % 3)).cast("decimal(16,2)").alias("valid_price"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_scans(df) -> int:
    """Broadcast exchanges with no shuffle between them and a scan: the planner chose them by the size of files."""
    lines = plan_of(df).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-|*"))
    found = 0
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[i + 1 :]
            end = next((n for n, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            found += not any("Exchange" in x for x in below[:end]) and any("Scan parquet" in x for x in below[:end])
    return found


def test_models_broadcast_no_properties(properties):
    iqr, trend = A.iqr_mad_outliers(properties), A.regression_anomalies(properties)
    assert not broadcast_scans(iqr) and not broadcast_scans(trend)
    assert [r["property_id"] for r in iqr.collect()] == [5] and [r["property_id"] for r in trend.collect()] == [9]


def test_rules_broadcast_no_properties(spark, properties, tmp_path):
    day = dt.date(2024, 1, 1)
    adverts = [
        (1, 3, "https://a.example/ficha/1", True, day, ""), (2, 3, "https://a.example/x/pagina-2", False, day, ""), (3, 4, "https://a.example/ficha/3", True, day, "metric_conflict_review"),
        (4, 5, None, True, None, ""), (5, 900, "https://a.example/x/pagina-5", True, day, "metric_conflict_review"),
    ]
    spark.createDataFrame(adverts, "listing_id long, property_id long, url string, active boolean, last_seen_on date, source_status string").write.parquet(f"{tmp_path}/adverts")
    out = A.rule_anomalies(properties, spark.read.parquet(f"{tmp_path}/adverts"))
    assert not broadcast_scans(out)
    assert sorted((r["property_id"], r["category"], r["value"]) for r in out.collect()) == [(3, "listing_page", "https://a.example/ficha/1"), (4, "source_conflict", "metric_conflict_review")]


def test_distinct_properties_broadcast_no_properties(spark, properties):
    pairs = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (900, 7), (2, None)], "property_id long, agency_id long")
    out = M.distinct_properties(properties, pairs, "agency_id")
    assert not broadcast_scans(out) and [tuple(r) for r in out.collect()] == [(7, 2)]
