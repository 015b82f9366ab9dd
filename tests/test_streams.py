"""Streams against what a batch job gives, with late, repeated and replayed rows."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from casagrid.operators import lifecycle as L
from casagrid.streaming import streams

ARRIVAL = "session_id long, ts timestamp, received timestamp, latitude double, longitude double, accuracy double"


def drained(spark, parts, schema, path, drain):
    for rows in parts:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{path}/in")
        drain(spark.readStream.schema(schema).parquet(f"{path}/in"))


def test_late_and_future_positions(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 12) + dt.timedelta(seconds=s)
    fix = lambda s, age=0, lat=-34.6, acc=5.0: (1, None if s is None else at(s), None if s is None else at(s + age), lat, -58.6, acc)
    parts = [
        [fix(1), fix(59, 10), fix(2, 11), fix(500, -2), fix(3, 0, None), fix(4, 0, -34.6, None), fix(None), fix(5, 0, -34.6, 61.0)],
        [fix(75), fix(30)],  # the window of 30 is open until an event of 70 or later was seen
        [fix(31), fix(200)],  # 31 is late now
    ]
    drained(spark, parts, ARRIVAL, tmp_path, lambda s: streams.run_to_table(streams.position_windows(s), f"{tmp_path}/out", f"{tmp_path}/state"))
    got = spark.read.parquet(f"{tmp_path}/out").select("positions", F.date_format("first_at", "ss"), F.date_format("last_at", "ss")).collect()
    assert sorted(map(tuple, got)) == [(1, "15", "15"), (3, "01", "59")]
    marked = spark.createDataFrame(parts[0], ARRIVAL).groupBy(streams.arrival_verdict().alias("v")).count().collect()
    assert {r.v: r["count"] for r in marked} == {"usable": 2, "late": 1, "future": 1, "invalid": 4}


def test_changes_equal_the_whole_history(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_PROVIDER)
    rng = random.Random(2)
    schema = "property_id long, snapshot_id long, observed_on date, content_hash string, currency string, price long"
    rows = []
    for i in range(400):
        content = (rng.choice(("USD", "ARS", "")), rng.choice((None, 1, 2, 3)))
        rows.append((rng.randint(0, 20), i, dt.date(2024, 1, 1) + dt.timedelta(days=i // 3), repr(content), *content))
    parts = [rows[:150] + rows[:5], rows[150:151], rows[151:]]
    drained(spark, parts, schema, tmp_path, lambda s: streams.run_to_table(streams.snapshot_changes(s), f"{tmp_path}/out", f"{tmp_path}/state"))
    want, seen, last = [], set(), {}
    for p, i, day, content, currency, price in rows:
        if (p, content) not in seen:
            want.append((p, i, day, "change" if p in last else "first", *last.get(p, (None, None)), currency, price))
            seen.add((p, content))
            last[p] = currency, price
    assert sorted(map(repr, map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))) == sorted(map(repr, want))


def test_one_call_works_all_properties_of_a_bucket():
    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        update = lambda self, value: setattr(self, "held", value)

    work = streams.ContentChanges()
    work.kept = Value()
    day = dt.date(2024, 1, 1)
    frame = lambda *rows: pd.DataFrame(rows, columns=["property_id", "snapshot_id", "observed_on", "content_hash", "currency", "price"])
    call = lambda *rows: [tuple(None if pd.isna(v) else v for v in r) for out in work.handleInputRows((0,), iter([frame(*rows)]), None) for r in out.itertuples(index=False)]
    assert call((2, 11, day, "b", "USD", 5), (1, 10, day, "a", "USD", None), (2, 12, day, "b", "USD", 5)) == [(1, 10, day, "first", None, None, "USD", None), (2, 11, day, "first", None, None, "USD", 5)]
    assert call((1, 13, day, "b", "USD", 5), (2, 14, day, "b", "USD", 5), (2, 15, day, "c", "ARS", None)) == [(1, 13, day, "change", "USD", None, "USD", 5), (2, 15, day, "change", "USD", 5, "ARS", None)]
    assert call((1, 16, day, "a", "USD", None)) == []


def test_lookups_are_worked_once_for_all_batches(spark):
    known = spark.createDataFrame([(1, 10, 100, 7, "u10", True), (1, 20, 200, 8, "u20", False)], "source_id long, external_id long, listing_id long, property_id long, url string, active boolean")
    remembered = spark.createDataFrame([(1, 10, "old10", dt.date(2024, 1, 1))], "source_id long, external_id long, url string, last_seen_on date")
    lookups = {name: spark.createDataFrame(rows.collect(), rows.schema) for name, rows in L.discovery_lookups(known, remembered).items()}
    found = [(1, 10, "x", 1), (1, 99, "u10", 2), (1, 98, "old10", 3), (1, 20, "u20", 4), (2, 10, "u10", 5)]
    got = {(r.source_id, r.external_id, r.position, r.listing_id, r.matched_by) for part in (found[:1], found[1:2], found[2:3], found[3:]) for r in L.resolve_links(spark.createDataFrame(part, "source_id long, external_id long, url string, position long"), **lookups).collect()}
    assert got == {(1, 10, 1, 100, "id"), (1, 10, 2, 100, "url"), (1, 10, 3, 100, "memory"), (1, 20, 4, None, "none"), (2, 10, 5, None, "none")}


def test_a_replayed_discovery_batch_changes_nothing(spark, tmp_path):
    known = spark.createDataFrame([(1, 10, 100, 7, "u10", True)], "source_id long, external_id long, listing_id long, property_id long, url string, active boolean")
    remembered = spark.createDataFrame([(1, 10, "old10", dt.date(2024, 1, 1))], "source_id long, external_id long, url string, last_seen_on date")
    log = streams.DiscoveryLog(spark, str(tmp_path), lambda b: L.discovery_status(L.resolve_discovery(b, known, remembered)))
    batch = lambda *rows: spark.createDataFrame(rows, "source_id long, external_id long, url string, position long")
    parts = [batch((1, 10, "u10", 1), (1, 11, "u11", 2), (1, 11, "u11b", 3)), batch((1, 99, "old10", 4), (1, 12, "u12", 5), (2, 5, "x", 6)), batch((1, 11, "u11", 7))]
    for number, part in enumerate(parts):
        log.record(part, number)
    want = {(1, 10, 1, "id"), (1, 11, 2, "none"), (1, 12, 5, "none"), (2, 5, 6, "none")}
    for number in (None, 1, 2):
        if number:
            log.record(parts[number], number)
        assert {(r.source_id, r.external_id, r.position, r.matched_by) for r in log.items().collect()} == want
        assert {tuple(r) for r in log.counts().collect()} == {(1, 3, 1, 2, 0), (2, 1, 0, 1, 0)}
