"""Market statistics panels over the curated table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casagrid.functions.numbers import non_empty, round_stat, truthy
from casagrid.functions.quality import MISSING_LABEL, safe_label
from casagrid.operators.quantiles import summarize, values_at_ranks, wide
from casagrid.sources.tables import join_rows


def zone_price_statistics(df: DataFrame, zone: str = "geo_zone", top: int = 20) -> DataFrame:
    rows = df.withColumn("zone", safe_label(zone))
    s = summarize(rows, ["zone"], {"price": "valid_price"}, {"median": 0.5, "q1": 0.25, "q3": 0.75})
    cv = F.when(F.col("avg") != 0, F.col("std") / F.col("avg") * 100).otherwise(0.0)
    out = s.select(
        "zone",
        F.col("n").alias("total"),
        *[round_stat(c, 4).alias(c) for c in ("avg", "std", "median")],
        round_stat(cv, 4).alias("cv"),
        *[round_stat(c, 4).alias(c) for c in ("min", "max", "q1", "q3")],
    )
    return out.orderBy(F.desc("total"), "zone").limit(top)


def zone_type_matrix(df: DataFrame, top: int = 80) -> DataFrame:
    rows = df.withColumn("zone", safe_label("geo_zone")).filter(
        F.col("valid_price").isNotNull() | F.col("price_m2").isNotNull()
    )
    keys = ["zone", "property_type"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    s = summarize(rows, keys, {"price": "valid_price", "m2": "price_m2"})
    stats = wide(
        s,
        keys,
        {
            "avg_price": ("price", "avg"),
            "median_price": ("price", "median"),
            "std_price": ("price", "std"),
            "avg_price_m2": ("m2", "avg"),
            "median_price_m2": ("m2", "median"),
            "std_price_m2": ("m2", "std"),
        },
    )
    return counts.join(stats, keys, "left").orderBy(F.desc("total"), "zone", "property_type").limit(top)


def counter(df: DataFrame, label: Column | str) -> DataFrame:
    return (
        df.groupBy(safe_label(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), "label")
    )


def triage_counts() -> list[Column]:
    fav, rev = F.col("is_favorite"), F.col("is_reviewed")
    return [
        F.count_if(fav).alias("favorites"),
        F.count_if(~fav & rev).alias("reviewed"),
        F.count_if(~fav & ~rev).alias("pending"),
    ]


def triage_series(df: DataFrame, label: Column | str) -> DataFrame:
    return df.groupBy(safe_label(label).alias("label")).agg(F.count(F.lit(1)).alias("total"), *triage_counts())


def distinct_properties(df: DataFrame, listings: DataFrame, key: str, top: int = 12) -> DataFrame:
    """Distinct properties per agency or source; the pair dedupe spreads a hot agency over tasks."""
    pairs = listings.filter(F.col(key).isNotNull()).select("property_id", key).distinct()
    pairs = join_rows(pairs, df.select("property_id"), "property_id", "left_semi")
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), key).limit(top)


# Age buckets of an advert, in days.
LIQUIDITY = ("0-15 dias", "16-45 dias", "46-90 dias", "+90 dias")


def liquidity_buckets(df: DataFrame, as_of: str) -> DataFrame:
    today = F.lit(as_of).cast("date")
    age = F.coalesce(F.datediff(today, "first_seen_on"), F.lit(0))
    unseen = F.coalesce(F.datediff(today, "last_seen_on"), F.lit(0))
    bucket = F.when(age <= 15, 0).when(age <= 45, 1).when(age <= 90, 2).otherwise(3)
    found = df.groupBy(bucket.alias("slot")).agg(
        F.count(F.lit(1)).alias("total"),
        round_stat(F.avg("valid_price"), 4).alias("avg_price"),
        F.count_if(age <= 15).alias("new"),
        F.count_if(age >= 90).alias("persistent"),
        F.count_if(unseen >= 30).alias("stale"),
    )
    slots = df.sparkSession.createDataFrame(list(enumerate(LIQUIDITY)), "slot int, label string")
    zero = F.lit(0).cast("bigint")
    return slots.join(found, "slot", "left").select(
        "label", "avg_price", *[F.coalesce(c, zero).alias(c) for c in ("total", "new", "persistent", "stale")]
    )


def price_histogram(df: DataFrame, sample: int = 500, buckets: int = 8) -> DataFrame:
    """Equal-width buckets whose limits come from the first valid prices by id; counts use every row."""
    first = df.filter(F.col("valid_price").isNotNull()).select("property_id", "valid_price").orderBy("property_id").limit(sample)
    limits = first.agg(F.min("valid_price").cast("double").alias("lo"), F.max("valid_price").cast("double").alias("hi"))
    box = limits.select(F.struct("lo", F.greatest((F.col("hi") - F.col("lo")) / buckets, F.lit(1.0)).alias("step")))
    rows = df.filter(F.col("valid_price").isNotNull()).withColumn("box", box.scalar())
    value, lo, step = F.col("valid_price").cast("double"), F.col("box.lo"), F.col("box.step")
    last_end = lo + step * buckets
    slot = F.when(value == last_end, buckets - 1).otherwise(F.floor((value - lo) / step))
    rows = rows.withColumn("slot", slot.cast("int")).filter((F.col("slot") >= 0) & (F.col("slot") < buckets))
    found = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("total"), *triage_counts())
    slots = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("slot"))
    zero = F.lit(0).cast("bigint")
    return slots.join(found, "slot", "left").select(
        "slot", *[F.coalesce(c, zero).alias(c) for c in ("total", "favorites", "reviewed", "pending")]
    )


def quality_score(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Share of six presence checks, 0–100."""
    joined = df.join(facts, "property_id", "left")
    checks = [
        F.col("price").isNotNull(),
        F.coalesce(truthy("covered_area"), truthy("total_area"), truthy("land_area")).isNotNull(),
        F.col("latitude").isNotNull(),
        F.coalesce("has_image", F.lit(False)),
        F.coalesce("listing_count", F.lit(0)) > 0,
        F.coalesce("has_agency", F.lit(False)),
    ]
    total = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int"))
    return joined.withColumn("quality_score", F.bround((total * 100 / 6).cast("decimal(12,6)"), 0).cast("int"))


KPI_METRICS = {
    "price": "valid_price",
    "price_m2": "price_m2",
    "covered_area": "valid_covered_area",
    "bedrooms": "valid_bedrooms",
    "bathrooms": "valid_bathrooms",
}


def kpi_summaries(df: DataFrame) -> DataFrame:
    total_area = F.coalesce(truthy("valid_land_area"), truthy("valid_total_area"))
    s = summarize(df, [], {**KPI_METRICS, "total_area": total_area})
    return s.select("metric", "n", *[round_stat(c, 4).alias(c) for c in ("avg", "median", "min", "max", "std")])


def kpi_counts(df: DataFrame, facts: DataFrame, latest_run: str) -> DataFrame:
    """Completeness, doubtful location, duplicates and novelty in one pass plus one key count."""
    scored = quality_score(df, facts)
    f = F.col
    has_address = F.coalesce(non_empty("detected_address"), non_empty("address")).isNotNull()
    counts = scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(f("valid_price").isNotNull()).alias("with_price"),
        F.count_if(f("valid_area").isNotNull()).alias("with_surface"),
        F.count_if(has_address).alias("with_address"),
        F.count_if(f("latitude").isNotNull()).alias("with_location"),
        F.count_if(F.coalesce("has_image", F.lit(False))).alias("with_image"),
        F.count_if(F.coalesce("listing_count", F.lit(0)) > 0).alias("with_link"),
        F.count_if(F.coalesce("has_agency", F.lit(False))).alias("with_agency"),
        F.count_if(~f("location_confidence").isin("high", "medium")).alias("weak_location"),
        F.count_if(f("first_seen_on") >= F.lit(latest_run).cast("date")).alias("new_since_run"),
        F.count_if(f("quality_score") < 70).alias("incomplete"),
        F.count_if(f("location_notes") != "").alias("with_location_notes"),
    )
    key = F.coalesce(non_empty("normalized_address"), non_empty(F.lower("detected_address")))
    groups = df.select(key.alias("key")).filter(f("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    dup = groups.agg(F.coalesce(F.sum(F.when(f("n") > 1, f("n"))), F.lit(0)).alias("d"))
    return counts.withColumn("possible_duplicates", dup.scalar().cast("bigint"))


# Fixed order: the parts of a property that the panel counts.
QUALITY_PARTS = ("price", "surface", "address", "location", "image", "link", "agency")


def kpi_quality(counts: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Percentages of the counts of :func:`kpi_counts` (whole, half to even; 0 without properties), and the inconsistent:
    properties with an anomaly, plus those with location notes."""
    odd = anomalies.agg(F.countDistinct("property_id")).scalar()
    share = lambda part: F.when(F.col("total") > 0, F.bround(F.col(f"with_{part}") / F.col("total") * 100, 0)).otherwise(0).cast("int").alias(f"{part}_percent")
    return counts.select("total", *map(share, QUALITY_PARTS), (odd + F.col("with_location_notes")).alias("inconsistent"))


def location_zone_matrix(df: DataFrame, top: int = 80) -> DataFrame:
    zone = F.coalesce(non_empty("geo_zone"), non_empty("detected_neighborhood"), non_empty("neighborhood"), F.lit(MISSING_LABEL))
    rows = df.withColumn("zone", zone)
    s = summarize(
        rows,
        ["zone"],
        {"score": "overall_score", "m2": "price_m2", "transport": "transport_score", "flood": "flood_penalty_score", "urban": "urban_informality_score"},
    )
    stats = wide(
        s,
        ["zone"],
        {
            "avg_score": ("score", "avg"),
            "median_score": ("score", "median"),
            "median_price_m2": ("m2", "median"),
            "avg_transport": ("transport", "avg"),
            "avg_flood": ("flood", "avg"),
            "avg_urban": ("urban", "avg"),
        },
    )
    counts = rows.groupBy("zone").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(stats, "zone", "left").orderBy(F.col("avg_score").desc_nulls_last(), F.desc("total"), "zone").limit(top)


def incident_zone_insights(df: DataFrame, events_by_zone: DataFrame, top: int = 80) -> DataFrame:
    """Property statistics per zone beside incident counts; zones known only to one side stay."""
    rows = df.withColumn("zone", safe_label("geo_zone"))
    counts = rows.groupBy("zone").agg(F.count(F.lit(1)).alias("property_count"))
    s = summarize(rows, ["zone"], {"m2": "price_m2", "coverage": "security_coverage_score", "risk": "security_risk_score"})
    stats = wide(s, ["zone"], {"median_price_m2": ("m2", "median"), "avg_coverage": ("coverage", "avg"), "avg_risk": ("risk", "avg")})
    both = counts.join(stats, "zone", "left").join(events_by_zone, "zone", "full_outer")
    zero = F.lit(0).cast("bigint")
    out = both.select(
        "zone",
        *[F.coalesce(c, zero).alias(c) for c in ("property_count", "event_count", "victim_count")],
        "median_price_m2",
        "avg_coverage",
        "avg_risk",
    )
    return out.orderBy(F.desc("property_count"), F.desc("event_count"), "zone").limit(top)


def zone_facets(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Counts of every canonical zone, zeros included."""
    from casagrid.functions.text import text_key

    label = F.coalesce(non_empty("inferred_zone"), non_empty("zone_name"), non_empty("inferred_neighborhood"))
    found = df.groupBy(text_key(label).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    keyed = zones.select(F.col("zone_name").alias("zone"), text_key("zone_name").alias("_key")).dropDuplicates(["_key"])
    return keyed.join(found, "_key", "left").select("zone", F.coalesce("n", F.lit(0).cast("bigint")).alias("total"))


# Levels always offered as a filter.
DEFAULT_LEVELS = ("alta", "media_alta", "media", "baja")


def distinct_facet(df: DataFrame, columns: Sequence[str], defaults: Sequence[str] = ()) -> DataFrame:
    values = df.select(F.explode(F.array(*columns)).alias("value")).filter(F.coalesce("value", F.lit("")) != "").distinct()
    if defaults:
        extra = df.sparkSession.createDataFrame([(v,) for v in defaults], "value string")
        values = values.union(extra).distinct()
    return values


def change_signature(df: DataFrame) -> DataFrame:
    """Counts and newest dates hashed into a key that changes when results may change."""
    agg = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.max("first_seen_on").alias("first"),
        F.max("last_seen_on").alias("last"),
        F.count_if("is_hidden").alias("hidden"),
        F.count_if("is_favorite").alias("fav"),
        F.count_if("is_reviewed").alias("rev"),
    )
    body = F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "first", "last", "hidden", "fav", "rev")])
    return agg.select(F.sha2(body, 256).alias("signature"), "n")


def robust_extent(df: DataFrame, share: float, minimum: int) -> DataFrame:
    """Bounds after trimming the extreme coordinates; all points when too few remain."""
    pts = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select("latitude", "longitude")
    low = F.floor(F.col("total") * F.lit(share))
    ranks = {"lo": low, "hi": F.greatest(low, F.ceil(F.col("total") * F.lit(1 - share)) - 1)}
    lat = values_at_ranks(pts, [], "latitude", ranks)
    lon = values_at_ranks(pts, [], "longitude", ranks)
    box = lat.select(F.struct("lo", "hi", "total"))
    rows = pts.withColumn("a", box.scalar()).withColumn("b", lon.select(F.struct("lo", "hi")).scalar())
    inside = F.col("latitude").between(F.col("a.lo"), F.col("a.hi")) & F.col("longitude").between(F.col("b.lo"), F.col("b.hi"))
    kept = inside | (F.col("a.total") < minimum)
    agg = rows.agg(
        F.count_if(kept).alias("n"),
        *[
            x
            for name, fn, c in (("south", F.min, "latitude"), ("north", F.max, "latitude"), ("west", F.min, "longitude"), ("east", F.max, "longitude"))
            for x in (fn(F.when(kept, F.col(c))).alias(name), fn(c).alias(f"all_{name}"))
        ],
    )
    return agg.select(
        *[F.when(F.col("n") >= 3, F.col(c)).otherwise(F.col(f"all_{c}")).alias(c) for c in ("south", "north", "west", "east")],
        F.col("n").alias("kept"),
    )


def legend_quantiles(df: DataFrame, value: str, q: dict[str, float]) -> DataFrame:
    """Lower-index quantiles of the map legend."""
    ranks = {n: F.greatest(F.lit(0), F.floor((F.col("total") - 1) * F.lit(p))) for n, p in q.items()}
    return values_at_ranks(df, [], value, ranks).drop("total")


def coordinate_sharing(df: DataFrame, threshold: int = 5) -> DataFrame:
    """Properties per six-decimal coordinate; many at one spot mean a default pin."""
    from casagrid.functions.numbers import price_short

    spot = F.concat_ws(",", F.format_string("%.6f", F.col("latitude")), F.format_string("%.6f", F.col("longitude")))
    rows = df.filter(F.col("latitude").isNotNull()).withColumn("group_id", spot)
    out = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("group_count"),
        F.min("currency").alias("_c1"),
        F.max("currency").alias("_c2"),
        F.min(F.when(F.col("price").isNotNull(), F.struct("price", "property_id", "currency"))).alias("best"),
    )
    label = F.when(F.col("_c1") == F.col("_c2"), price_short(F.col("best.currency"), F.col("best.price"))).otherwise("")
    return out.select(
        "group_id", "group_count", (F.col("group_count") >= threshold).alias("suspicious"), F.coalesce(label, F.lit("")).alias("cheapest")
    )


def price_segments(snapshots: DataFrame) -> DataFrame:
    """Price history: runs of equal (currency, price) per property.

    Runs are first closed inside each month, then neighbouring runs are joined, so that a property with a
    very long history is not ordered as one group.
    """
    month = F.date_trunc("month", F.col("observed_on")).cast("date")
    key = F.struct(F.coalesce("currency", F.lit("")).alias("currency"), F.col("price"))
    at = F.struct("observed_on", "snapshot_id", "currency", "price")
    rows = snapshots.select("property_id", month.alias("month"), at.alias("at"), key.alias("key"))
    w = Window.partitionBy("property_id", "month").orderBy("at")
    rows = rows.withColumn("run", F.sum((~F.lag("key").over(w).eqNullSafe(F.col("key"))).cast("int")).over(w))
    runs = rows.groupBy("property_id", "month", "run").agg(
        F.min("key").alias("key"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy("property_id").orderBy("lo")
    runs = runs.withColumn("segment", F.sum((~F.lag("key").over(w).eqNullSafe(F.col("key"))).cast("int")).over(w))
    out = runs.groupBy("property_id", "segment").agg(
        F.min("key").alias("key"), F.min("lo.observed_on").alias("first_seen"), F.max("hi.observed_on").alias("last_seen"), F.sum("n").alias("observations")
    )
    return out.select(
        "property_id",
        "segment",
        "key.currency",
        "key.price",
        "first_seen",
        "last_seen",
        "observations",
        (F.col("first_seen") == F.col("last_seen")).alias("same_day"),
    )
