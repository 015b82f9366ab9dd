import random

from pyspark.sql import functions as F

from casagrid.operators import lifecycle as L
from casagrid.operators import merge as M

LISTING = "source_id long, external_id long, listing_id long, property_id long, url string, active boolean, missing_runs int, last_seen_on date"


def test_components_match_union_find(spark):
    rnd = random.Random(11)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}


def test_second_miss_deactivates(spark):
    rows = [(1, 10, 1, 100, "u", True, 0, None), (1, 11, 2, 100, "v", True, 1, None), (1, 12, 3, 101, "w", True, 1, None)]
    before = spark.createDataFrame(rows, LISTING)
    after = L.mark_missing(before, spark.createDataFrame([], "source_id long, external_id long"))
    assert {r["listing_id"]: (r["missing_runs"], r["active"]) for r in after.collect()} == {1: (1, True), 2: (2, False), 3: (2, False)}
    assert [r["property_id"] for r in L.removed_properties(before, after).collect()] == [101]


def test_ingest_twice_changes_nothing_and_keeps_manual_edits(spark):
    props = spark.createDataFrame([(1, "a", 10, ["price"], None), (2, "b", 20, [], None)], "property_id long, title string, price long, overrides array<string>, last_seen_on date")
    batch = spark.createDataFrame([(1, 5, 1, "new", 99), (1, 6, 2, "", 77)], "source_id long, external_id long, property_id long, title string, price long")
    batch = batch.withColumn("seen_on", F.lit("2024-01-02").cast("date"))
    order = [F.col("seen_on"), F.col("external_id")]
    once = L.merge_properties(props, batch, ["title", "price"], order)
    assert {r["property_id"]: (r["title"], r["price"]) for r in once.collect()} == {1: ("new", 10), 2: ("b", 77)}
    again = L.merge_properties(once, batch, ["title", "price"], order)
    assert sorted(map(tuple, again.select("property_id", "title", "price").collect())) == sorted(map(tuple, once.select("property_id", "title", "price").collect()))


def test_merge_fills_from_best_duplicate(spark):
    cols = "property_id long, title string, price long, status string, is_hidden boolean, listing_count long, image_count long, is_favorite boolean, personal_notes string, latitude double, is_reviewed boolean, first_seen_on date, last_seen_on date, overrides array<string>"
    rows = [
        (1, "", None, "removed", True, 0, 0, True, "", None, False, None, None, ["title"]), (2, "t2", None, "active", False, 1, 1, False, "own", None, False, None, None, None),
        (3, "t3", 50, "active", False, 0, 0, False, "three", 1.0, True, None, None, ["price"]), (4, "", None, "removed", True, 0, 0, False, "own", 2.0, True, None, None, []),
    ]
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "node long, component long")
    props = spark.createDataFrame(rows, cols)
    merged = M.merge_components(props, members, ["title", "price"])
    r = merged.first()
    assert (r["canonical_id"], r["title"], r["price"], r["is_favorite"], r["is_hidden"], r["status"]) == (3, "t3", 50, True, False, "active")
    assert r["overrides"] == ["price", "title"] and r["pin_from"] == 3 and not M.moved_pins(merged).collect()
    assert r["personal_notes"] == "three\n\nFusionada con propiedad #2\n\nNotas de #2: own\n\nFusionada con propiedad #4\n\nFusionada con propiedad #1"
    after = {s["property_id"]: s for s in M.merged_state(props, members, merged, "now", ["title", "price"]).collect()}
    assert {i: (s["is_hidden"], s["status"]) for i, s in after.items()} == {1: (True, "removed"), 2: (True, "removed"), 3: (False, "active"), 4: (True, "removed")}
    assert after[2]["personal_notes"] == "own\n\nFusionada en propiedad #3 el now" and after[1]["title"] == ""
    undo = M.undo_record(props, M.merged_state(props, members, merged, "now", ["title", "price"]), ["title", "status", "overrides"]).collect()
    assert {(u["property_id"], u["field"]) for u in undo} == {(2, "status"), (3, "overrides")}


def test_mirrors_do_not_keep_a_property_on_sale(spark):
    schema = "listing_id long, property_id long, source_id long, url string, active boolean, source_status string"
    rows = [
        (1, 1, 1, "https://a.example/casa-1-7", True, "reserved"), (2, 1, 2, "https://b.example/x/casa-1-7/", True, ""),  # only its mirror
        (3, 2, 2, "https://b.example/casa-2-7?x=1", True, "reserved"), (4, 2, 1, "https://a.example/CASA-2-7", True, ""),  # only what it mirrors
        (5, 3, 2, "https://b.example/casa-3-7", True, "reserved"), (6, 3, 1, "https://a.example/casa-9-7", True, ""),  # another advert of the origin
        (7, 4, 1, "https://a.example/casa-4-7", True, "reserved"), (8, 4, 3, "https://c.example/z", True, ""),  # a third source
        (9, 5, 3, "https://c.example/z", True, "reserved"), (10, 5, 3, "https://c.example/y", True, ""),  # its own source only
    ]
    df = spark.createDataFrame(rows, schema)
    proposed = df.filter("source_status = 'reserved'").withColumn("status", F.col("source_status"))
    got = {r["listing_id"]: r["final_status"] for r in L.status_policy(df, proposed, ["reserved"], origin=1, mirror=2).collect()}
    assert got == {1: "reserved", 3: "reserved", 5: "active", 7: "active", 9: "reserved"}


def test_new_properties_get_the_next_ids_without_gaps(spark):
    listings = spark.createDataFrame([(1, 10, 5, 100, "u", True, 0, None)], LISTING)
    props = spark.createDataFrame([(100, "a"), (120, "b"), (90, "b")], "property_id long, fingerprint string")
    rows = [(1, 10, "zz"), (1, 11, "b"), (2, 1, "new1"), (2, 2, "new1"), (2, 3, "new2"), (2, 4, None), (2, 5, "")] + [(3, i, f"p{i}") for i in range(300)]
    batch = spark.createDataFrame(rows, "source_id long, external_id long, fingerprint string")
    got = {(r["source_id"], r["external_id"]): (r["match"], r["property_id"]) for r in L.resolve_batch(batch.repartition(7), listings, props).collect()}
    assert got == {(r["source_id"], r["external_id"]): (r["match"], r["property_id"]) for r in L.resolve_batch(batch.coalesce(1), listings, props).collect()}
    assert got[1, 10] == ("listing", 100) and got[1, 11] == ("fingerprint", 90)
    made = {k: v[1] for k, v in got.items() if v[0] == "created"}
    assert sorted(set(made.values())) == list(range(121, 121 + 303))
    assert made[2, 1] == made[2, 2] and made[2, 4] == made[2, 5]
