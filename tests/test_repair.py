"""Rollback and detail repair on small histories."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from casagrid.operators import repair as R

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def listings(spark, rows):
    full = [(i, p, 1, i, f"u{i}", active, DAY(first), DAY(last), "", 0) for i, p, active, first, last in rows]
    return spark.createDataFrame(full, "listing_id long, property_id long, source_id long, external_id long, url string, active boolean, first_seen_on date, last_seen_on date, source_status string, missing_runs int")


def test_rollback_plan_and_its_effects(spark):
    # The window is from day 10 to 50, which is more than one stretch, and a second one overlaps it.
    runs = spark.createDataFrame([(1, DAY(10), DAY(50)), (1, DAY(45), DAY(60)), (2, DAY(0), DAY(400)), (1, DAY(90), DAY(80))], "source_id long, started_on date, finished_on date")
    adverts = listings(spark, [
        (1, 1, True, 10, 200), (2, 1, True, 5, 100), (3, 1, True, 9, 150), (4, 1, False, 0, 300),  # survivor 3
        (5, 2, True, 50, 60), (6, 3, True, 60, 61), (7, 4, True, 20, 30), (8, 4, False, 1, 30), (9, 5, True, 61, 70),
    ])
    props = spark.createDataFrame([(1, False), (2, False), (3, True), (4, True), (5, False)], "property_id long, has_manual_state boolean")
    plan = R.rollback_plan(adverts, props, runs)
    got = {r["property_id"]: r for r in plan.collect()}
    assert {i: (r["action"], r["rolled_back"], r["survivor_id"]) for i, r in got.items()} == {1: ("restore", 1, 3), 2: ("delete", 1, None), 3: ("preserve", 1, None), 4: ("retire", 1, None)}
    assert (got[2]["from_on"], got[2]["to_on"]) == (DAY(10), DAY(60)) and (got[1]["from_on"], got[1]["to_on"]) == (DAY(10), DAY(50))

    stored = spark.createDataFrame(
        [(i, 1, "USD", "removed", False, "", DAY(0), ["currency"]) for i in range(1, 6)],
        "property_id long, price long, currency string, status string, is_hidden boolean, personal_notes string, last_seen_on date, overrides array<string>",
    )
    snaps = spark.createDataFrame([(3, DAY(1), 1, 7, "ARS"), (3, DAY(2), 2, None, "ARS"), (1, DAY(9), 3, 9, "ARS")], "listing_id long, observed_on date, snapshot_id long, price long, currency string")
    after = {r["property_id"]: r for r in R.after_rollback(stored, plan, snaps, ["price", "currency"], "note").collect()}
    assert set(after) == {1, 3, 4, 5}
    assert (after[1]["price"], after[1]["currency"], after[1]["status"], after[1]["last_seen_on"]) == (None, "USD", "active", DAY(150))
    assert (after[3]["status"], after[3]["is_hidden"], after[3]["personal_notes"]) == ("removed", True, "note") and after[4]["status"] == "removed" and after[5]["price"] == 1

    pins = spark.createDataFrame([(1, 0.0, False), (2, 0.0, False)], "property_id long, latitude double, manually_corrected boolean")
    history = spark.createDataFrame(
        [(1, 1, DAY(9), 1.0), (1, 3, DAY(40), 3.0), (1, 2, DAY(40), 2.0), (1, 4, DAY(41), 4.0), (2, 5, DAY(40), 5.0)], "property_id long, history_id long, changed_on date, latitude double"
    ).selectExpr("*", "latitude as longitude", "'x' as precision_kind", "'y' as provider")
    assert [(r["property_id"], r["latitude"]) for r in R.restored_pins(pins, history, plan).collect()] == [(1, 2.0)]
    left = {r["listing_id"]: (r["active"], r["source_status"], r["missing_runs"]) for r in R.rollback_listings(adverts, runs, plan).collect()}
    assert set(left) == {2, 3, 4, 6, 8, 9} and left[6] == (False, "removed", 2) and left[2] == (True, "", 0)
    known = spark.createDataFrame([(1, 1, "old", DAY(0), DAY(1), "ingest")], "source_id long, external_id long, url string, first_seen_on date, last_seen_on date, last_seen_reason string")
    back = {r["external_id"]: (r["url"], r["first_seen_on"], r["last_seen_reason"]) for r in R.remembered_identities(known, R.rolled_back(adverts, runs), "2024-06-01", "back").collect()}
    assert back == {1: ("u1", DAY(0), "back"), 5: ("u5", DAY(50), "back"), 6: ("u6", DAY(60), "back"), 7: ("u7", DAY(20), "back")}


def test_corrections_beat_details_beat_stored_values(spark):
    fields = {"address": "string", "rooms": "int"}
    stored = spark.createDataFrame([(1, "a", 1, []), (2, "b", 2, ["rooms"]), (3, "c", 3, None), (4, "d", None, [])], "property_id long, address string, rooms int, overrides array<string>").selectExpr("*", "'' as copy")
    parsed = spark.createDataFrame([(1, 1, "x", 9), (1, 2, "", None), (1, 3, "y", None), (2, 4, None, 8), (3, 5, "c", 3), (9, 6, "z", 1)], "property_id long, listing_id long, address string, rooms int")
    fixes = spark.createDataFrame([(1, "fixed", None), (4, "", 5)], "property_id long, address string, rooms int")
    changes = R.overlay(stored, parsed, fixes, fields)
    assert {tuple(r) for r in changes.collect()} == {(1, "address", "a", "fixed", "correction"), (1, "rooms", "1", "9", "parsed"), (4, "rooms", None, "5", "correction")}
    after = R.with_changes(stored, changes, fields, {"address": {"copy": stored["address"]}})
    assert {r["property_id"]: (r["address"], r["rooms"], r["copy"]) for r in after.collect()} == {1: ("fixed", 9, "a"), 2: ("b", 2, ""), 3: ("c", 3, ""), 4: ("d", 5, "")}
    assert R.overlay(stored, parsed.limit(0), fixes.limit(0), fields).count() == 0


def test_edits_apply_in_order_and_leave_their_time(spark):
    fields = {"price": "decimal(16,2)", "title": "string", "rooms": "int"}
    stored = spark.createDataFrame([(1, 5, "a", 2), (2, None, "b", None), (3, 7, "c", 1)], "property_id long, price long, title string, rooms int").withColumn("price", F.col("price").cast("decimal(16,2)"))
    edits = [
        (1, 10, "rooms", "3"), (1, 11, "rooms", "2"), (1, 12, "rooms", "2"),  # changed and changed back
        (1, 13, "title", ""), (1, 14, "title", " a "), (1, 15, "unknown", "x"),  # refused, equal, unknown
        (2, 16, "price", "1.500"), (2, 17, "price", "abc"), (2, 18, "rooms", ""),
        (3, 19, "rooms", "4"), (3, 20, "rooms", "4"), (3, 21, "price", ""), (9, 22, "rooms", "1"),
    ]
    out = R.apply_edits(stored, spark.createDataFrame(edits, "property_id long, edit_id long, field string, value string"), fields)
    got = {r["property_id"]: (r["price"], r["title"], r["rooms"], r["edited_at"]) for r in out.collect()}
    assert (got[1][1:3], got[1][3]) == (("a", 2), {"rooms": 11})
    assert (float(got[2][0]), got[2][2], got[2][3]) == (1500.0, None, {"price": 16})
    assert got[3] == (None, "c", 4, {"rooms": 19, "price": 21})


def test_link_audit_changes_nothing_in_a_dry_run(spark):
    adverts = spark.createDataFrame([(1, 1, 1, 7, True, "", 0), (1, 2, 2, 7, True, "", 0), (1, 3, 3, 8, True, "", 1)], "source_id long, external_id long, listing_id long, property_id long, active boolean, source_status string, missing_runs int")
    props = spark.createDataFrame([(7, "active", ""), (8, "active", ""), (9, "active", "")], "property_id long, status string, override_field string")
    audit = spark.createDataFrame([(1, "unavailable"), (2, "error"), (3, "unavailable")], "listing_id long, result string")
    after, states, log = R.link_audit(adverts, audit, props, True)
    assert {r["listing_id"]: (r["active"], r["source_status"], r["missing_runs"]) for r in after.collect()} == {1: (False, "removed", 2), 2: (True, "", 0), 3: (False, "removed", 2)}
    assert {r["property_id"]: r["status"] for r in states.collect()} == {7: "active", 8: "removed", 9: "active"}
    assert {r["listing_id"]: r["applied"] for r in log.collect()} == {1: True, 2: False, 3: True}
    after, states, log = R.link_audit(adverts, audit, props, False)
    assert all(r["active"] for r in after.collect()) and {r["status"] for r in states.collect()} == {"active"} and not any(r["applied"] for r in log.collect())


def test_a_sibling_price_stays_and_protection_is_joint(spark):
    props = spark.createDataFrame([(i, "active", 5, "USD", o) for i, o in ((1, []), (2, ["currency"]), (3, []), (4, ["status"]))], "property_id long, status string, price long, currency string, overrides array<string>")
    rows = [(1, 1, "", None, "", 9, "ARS"), (1, 2, "x", "reserved", "x", None, None), (2, 3, "", "active", "r", 9, "ARS"), (3, 4, None, None, None, None, "ARS"), (4, 5, "", "removed", "", 1, None)]
    parsed = spark.createDataFrame(rows, "property_id long, listing_id long, source_status string, parsed_status string, parsed_source_status string, parsed_price long, parsed_currency string")
    after, adverts = R.repair_status_and_price(props, parsed)
    assert {tuple(r) for r in after.collect()} == {(1, "reserved", 9, "ARS"), (2, "active", 5, "USD"), (3, "active", None, "ARS"), (4, "active", 1, "")}
    assert [tuple(r) for r in adverts.collect()] == [(3, 2, "", "r")]


def test_edits_broadcast_no_stored_values(spark, tmp_path):
    spark.createDataFrame([(i, "t") for i in range(50)], "property_id long, title string").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([(i, i, "title", "new") for i in range(0, 50, 2)], "property_id long, edit_id long, field string, value string").write.parquet(f"{tmp_path}/e")
    out = R.apply_edits(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/e"), {"title": "string"})
    joins = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftOuter" in line or "Join" in line]
    assert any("SortMergeJoin" in line and "LeftOuter" in line for line in joins)
    assert sum("SortMergeJoin" in line for line in joins) >= 2 and out.filter("title = 'new'").count() == 25


def test_properties_without_changed_fields_equal_the_sql(spark, tmp_path):
    from casagrid.plans import oracle_sql, queries

    con, small = duckdb.connect(), "/root/testdata/sf0.001"
    kept = {"part": "true", "lineitem": "l_partkey%3=0 or (l_partkey%3=1 and l_linenumber in (4, 7))"}  # all edits, two fields, none
    for name, rows in kept.items():
        con.execute(f"copy (select * from '{small}/{name}.parquet' where {rows}) to '{tmp_path}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = con.sql(oracle_sql()["applied_edits"])
    got = queries()["applied_edits"](spark, str(tmp_path)).select(*want.columns)
    rows = want.fetchall()
    assert 67 <= sum(r[want.columns.index("edited_at")] == ":" for r in rows) < len(rows) == 200
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(rows, key=lambda r: r[0])


def test_locality_repairs_are_spread_over_tasks(spark):
    from casagrid.plans import queries

    plan = queries()["locality_repairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan
