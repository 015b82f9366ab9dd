"""Listing lifecycle: identity resolution, upsert, snapshots, missing and removed adverts, discovery runs.

Every operator is a pure function from current tables and an input batch to new rows; writing them is
left to the caller, so a dry run is the same plan without the write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casagrid.sources.tables import join_rows

KEY = ["source_id", "external_id"]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Newest row per key; aggregation keeps one row per key and task, so hot keys do not gather."""
    rank = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in keep])
    best = df.groupBy(*keys).agg(F.max(rank).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in keep])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    others = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *others)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in [*order, *others]])


def keep_richest(df: DataFrame, keys: Sequence[str], props: Sequence[str], order: str) -> DataFrame:
    """Row with most filled properties per key, the earliest on ties."""
    filled = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in props), F.lit(0))
    return latest_per_key(df, keys, [filled, -F.col(order)], [order, *props])


def preferred_latest(runs: DataFrame, key: str, preferred: Column, order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Newest complete run, any newest run where there is none."""
    return latest_per_key(runs, [key], [preferred.cast("int"), *order], keep)


def new_and_known(found: DataFrame, identities: DataFrame) -> DataFrame:
    """Mark each discovered identity as new or already known."""
    known = identities.select(*KEY).distinct().withColumn("known", F.lit(True))
    return found.join(known, KEY, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def upsert_identities(identities: DataFrame, batch: DataFrame, seen_on: str) -> DataFrame:
    """First and last sighting per advert after a batch."""
    fresh = batch.groupBy(*KEY).agg(F.max("url").alias("new_url"))
    day = F.lit(seen_on).cast("date")
    out = identities.join(fresh, KEY, "full_outer")
    hit = F.col("new_url").isNotNull()
    return out.select(
        *KEY,
        F.coalesce("new_url", "url").alias("url"),
        F.coalesce("first_seen_on", day).alias("first_seen_on"),
        F.when(hit, F.greatest(F.coalesce("last_seen_on", day), day)).otherwise(F.col("last_seen_on")).alias("last_seen_on"),
        F.when(hit, "ingest").otherwise(F.col("last_seen_reason")).alias("last_seen_reason"),
    )


ID_BUCKETS = 16**3


def dense_ids(keys: DataFrame, order: Sequence[str], after: int, name: str) -> DataFrame:
    """Each distinct ``order`` of ``keys`` with an id: ``after + 1`` and on, without gaps.

    Keys are ordered by the first three digits of their MD5 and then by themselves. Buckets of one such prefix are
    counted, the counts of the buckets before one are its offset, and within a bucket keys are numbered by a window. The
    ids follow from the keys alone, so a retry or another number of tasks gives the same ones.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    rows = keys.select(*order).distinct().withColumn("_bucket", F.left(F.md5(text.cast("binary")), F.lit(3)))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # ID_BUCKETS rows at most
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return rows.withColumn("_place", place).join(offsets, "_bucket").select(*order, (F.lit(after) + F.col("_before") + F.col("_place")).cast("long").alias(name))


def resolve_batch(batch: DataFrame, listings: DataFrame, properties: DataFrame) -> DataFrame:
    """Property of each incoming advert: by advert key, else by fingerprint, else a new one.

    ``batch`` holds one row per advert key. New fingerprints get the ids after the largest in use; adverts that share one
    share the new property. A null fingerprint counts as an empty one.
    """
    prints = F.coalesce("fingerprint", F.lit("")).alias("fingerprint")
    by_key = listings.groupBy(*KEY).agg(F.min("property_id").alias("key_property"))
    by_print = properties.groupBy(prints).agg(F.min("property_id").alias("print_property"))
    out = batch.withColumn("fingerprint", prints).join(by_key, KEY, "left").join(by_print, "fingerprint", "left")
    new = F.col("key_property").isNull() & F.col("print_property").isNull()
    largest = properties.agg(F.max("property_id")).scalar()
    made = dense_ids(out.filter(new), ["fingerprint"], 0, "_new").withColumn("_new", F.col("_new") + F.coalesce(largest, F.lit(0)))
    match = F.when(F.col("key_property").isNotNull(), "listing").when(F.col("print_property").isNotNull(), "fingerprint").otherwise("created")
    out = out.withColumn("match", match).join(made, "fingerprint", "left")
    return out.withColumn("property_id", F.coalesce("key_property", "print_property", "_new")).drop("key_property", "print_property", "_new")


# What a new property has where no advert tells it.
CREATED = {"title": "Propiedad sin título", "operation": "sale", "status": "active", "currency": "", "description": "", "address": "", "locality": "", "neighborhood": "", "condition_category": "unknown", "location_source": "unknown", "location_confidence": "unknown"}


def merge_properties(properties: DataFrame, resolved: DataFrame, fields: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """New property state: non-empty incoming values replace, fields edited by hand stay, new properties get defaults.

    ``properties`` carries ``overrides`` (array of protected field names); the last advert of a batch wins.
    """
    fresh = resolved.groupBy("property_id").agg(
        *[F.max_by(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c)), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(*order))).alias(f"_n_{c}") for c in fields],
        F.max("seen_on").alias("_seen"),
        F.bool_or(F.col("match") == "created" if "match" in resolved.columns else F.lit(False)).alias("_made"),
    )
    out = properties.join(fresh, "property_id", "full_outer")
    cols = []
    for c in fields:
        guarded = F.coalesce(F.array_contains("overrides", c), F.lit(False))
        plain = F.coalesce(F.col(f"_n_{c}"), F.col(c))
        filled = F.coalesce(plain, F.when(F.col("_made"), F.lit(CREATED[c]))) if c in CREATED else plain
        cols.append(F.when(guarded, F.col(c)).otherwise(filled).alias(c))
    made = F.coalesce("_made", F.lit(False)).alias("created")
    return out.select("property_id", *cols, F.greatest("last_seen_on", "_seen").alias("last_seen_on"), F.coalesce("overrides", F.array().cast("array<string>")).alias("overrides"), made)


def merge_listings(listings: DataFrame, resolved: DataFrame) -> DataFrame:
    """Incoming adverts become active again with no missing runs, the rest stay as they are; new ones get the ids after
    the largest in use."""
    fresh = resolved.select(*KEY, F.col("property_id").alias("_p"), F.col("url").alias("_u"), F.col("seen_on").alias("_s"))
    out = listings.select(*KEY, "listing_id", "property_id", "url", "active", "missing_runs", "last_seen_on").join(fresh, KEY, "full_outer")
    largest = listings.agg(F.max("listing_id")).scalar()
    made = dense_ids(resolved.join(listings.select(*KEY), KEY, "left_anti"), KEY, 0, "_new").withColumn("_new", F.col("_new") + F.coalesce(largest, F.lit(0)))
    hit = F.col("_u").isNotNull()
    return out.join(made, KEY, "left").select(
        *KEY,
        F.coalesce("listing_id", "_new").alias("listing_id"),
        F.coalesce("_p", "property_id").alias("property_id"),
        F.coalesce("_u", "url").alias("url"),
        F.when(hit, True).otherwise(F.col("active")).alias("active"),
        F.when(hit, 0).otherwise(F.col("missing_runs")).alias("missing_runs"),
        F.greatest("last_seen_on", "_s").alias("last_seen_on"),
        F.col("_new").isNotNull().alias("created"),
    )


def new_snapshots(snapshots: DataFrame, batch: DataFrame, keys: Sequence[str], hash_column: str = "content_hash") -> DataFrame:
    """Rows whose content was never seen for the advert; repeats inside the batch count once."""
    fresh = batch.dropDuplicates([*keys, hash_column])
    return fresh.join(snapshots.select(*keys, hash_column), [*keys, hash_column], "left_anti")


def new_images(images: DataFrame, batch: DataFrame) -> DataFrame:
    """Unseen image links of each advert with their first position."""
    found = batch.select("listing_id", F.posexplode("images").alias("position", "url")).groupBy("listing_id", "url").agg(F.min("position").alias("position"))
    return found.join(images.select("listing_id", "url"), ["listing_id", "url"], "left_anti")


def location_changes(current: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pins after an update, and the old pins that move to history. Hand-set pins never move."""
    new = fresh.select("property_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    both = current.join(new, "property_id", "full_outer")
    fixed = F.coalesce("manually_corrected", F.lit(False)) | F.col("_lat").isNull()
    after = both.select(
        "property_id",
        F.when(fixed, F.col("latitude")).otherwise(F.col("_lat")).alias("latitude"),
        F.when(fixed, F.col("longitude")).otherwise(F.col("_lon")).alias("longitude"),
        F.coalesce("manually_corrected", F.lit(False)).alias("manually_corrected"),
    )
    moved = ~fixed & F.col("latitude").isNotNull() & ((F.col("latitude") != F.col("_lat")) | (F.col("longitude") != F.col("_lon")))
    return after, both.filter(moved).select("property_id", "latitude", "longitude")


def stale_adverts(listings: DataFrame, seen: DataFrame) -> DataFrame:
    return listings.filter("active").join(seen.select(*KEY), KEY, "left_anti")


def mark_missing(listings: DataFrame, seen: DataFrame) -> DataFrame:
    """Missing runs grow for active adverts not seen; the second miss deactivates."""
    known = seen.select(*KEY).distinct().withColumn("_seen", F.lit(True))
    out = listings.join(known, KEY, "left")
    missed = F.col("active") & F.col("_seen").isNull()
    runs = F.when(missed, F.col("missing_runs") + 1).otherwise(F.col("missing_runs"))
    return out.withColumns({"missing_runs": runs, "active": F.when(missed & (runs >= 2), False).otherwise(F.col("active")), "missed": missed}).drop("_seen")


def removed_properties(before: DataFrame, after: DataFrame) -> DataFrame:
    """Properties whose last active advert went away."""
    had = before.groupBy("property_id").agg(F.bool_or("active").alias("had"))
    has = after.groupBy("property_id").agg(F.bool_or("active").alias("has"))
    return had.join(has, "property_id").filter(F.col("had") & ~F.col("has")).select("property_id")


def may_mark_missing(runs: DataFrame) -> DataFrame:
    """Reason why a source run must not mark adverts as missing; empty when it may."""
    f = F.col
    reason = (
        F.when(f("mode") != "complete", "incomplete mode")
        .when(f("max_pages").isNotNull() | f("max_listings").isNotNull(), "limited run")
        .when(f("status") != "success", F.concat(F.lit("status "), f("status")))
        .when(f("planned") <= 0, "nothing planned")
        .when(f("processed") != f("planned"), "partly processed")
        .when(f("errors") > 0, "errors")
        .when(F.coalesce(f("coverage_ratio"), F.lit(100.0)) < 80, "low coverage")
        .otherwise("")
    )
    return runs.withColumn("skip_reason", reason)


def missing_report(listings: DataFrame, seen: DataFrame) -> DataFrame:
    """Dry-run counts of marking adverts as missing, per source."""
    after = mark_missing(listings, seen)
    gone = removed_properties(listings, after).withColumn("gone", F.lit(1))
    f = F.col
    off = after.filter(f("missed") & ~f("active")).select("source_id", "property_id").distinct().join(gone, "property_id", "left_semi")
    removed = off.groupBy("source_id").agg(F.count(F.lit(1)).alias("removed_properties"))
    counts = after.groupBy("source_id").agg(
        F.count_if("missed").alias("stale"), F.count_if(f("missed") & f("active")).alias("incremented"), F.count_if(f("missed") & ~f("active")).alias("deactivated")
    )
    return counts.join(removed, "source_id", "left").withColumn("removed_properties", F.coalesce("removed_properties", F.lit(0).cast("bigint")))


def mark_removed(listings: DataFrame, removed: DataFrame, properties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adverts reported as gone become inactive; properties without active adverts become removed."""
    gone = removed.select(*KEY).distinct().withColumn("_gone", F.lit(True))
    after = listings.join(gone, KEY, "left")
    hit = F.col("_gone").isNotNull()
    after = after.withColumns(
        {
            "active": F.when(hit, False).otherwise(F.col("active")),
            "source_status": F.when(hit, "removed").otherwise(F.col("source_status")),
            "missing_runs": F.when(hit, F.greatest("missing_runs", F.lit(2))).otherwise(F.col("missing_runs")),
        }
    )
    touched = after.groupBy("property_id").agg(F.bool_or(F.col("_gone").isNotNull()).alias("t"), F.bool_or("active").alias("a"))
    state = properties.join(touched, "property_id", "left")
    status = F.when(F.col("t") & ~F.col("a") & (F.col("override_field") != "status"), "removed").otherwise(F.col("status"))
    return after.drop("_gone"), state.select("property_id", status.alias("status"))


def pending_audit(listings: DataFrame, audit: DataFrame) -> DataFrame:
    """Adverts still to check when an audit resumes."""
    return listings.join(audit.select("listing_id", "url").distinct(), ["listing_id", "url"], "left_anti")


def discovery_lookups(listings: DataFrame, identities: DataFrame) -> dict[str, DataFrame]:
    """Active adverts by id, by link and by remembered link, one row per key."""
    active = listings.filter("active")
    by_id = active.groupBy(*KEY).agg(F.min("listing_id").alias("id_hit"))
    by_url = active.groupBy("source_id", "url").agg(F.min(F.struct("listing_id", F.col("external_id").alias("url_ext"))).alias("url_hit"))
    remembered = join_rows(identities.select("source_id", "url", "external_id", "last_seen_on"), by_id.withColumnRenamed("id_hit", "listing_id"), KEY)
    by_memory = remembered.groupBy("source_id", "url").agg(F.max(F.struct("last_seen_on", "external_id", "listing_id")).alias("memory_hit"))
    return {"by_id": by_id, "by_url": by_url, "by_memory": by_memory}


def resolve_links(found: DataFrame, by_id: DataFrame, by_url: DataFrame, by_memory: DataFrame) -> DataFrame:
    """Advert of each discovered link from the tables of :func:`discovery_lookups`."""
    out = join_rows(join_rows(join_rows(found, by_id, KEY, "left"), by_url, ["source_id", "url"], "left"), by_memory, ["source_id", "url"], "left")
    listing = F.coalesce("id_hit", "url_hit.listing_id", "memory_hit.listing_id")
    external = F.when(F.col("id_hit").isNotNull(), F.col("external_id")).otherwise(F.coalesce("url_hit.url_ext", "memory_hit.external_id", "external_id"))
    how = F.when(F.col("id_hit").isNotNull(), "id").when(F.col("url_hit").isNotNull(), "url").when(F.col("memory_hit").isNotNull(), "memory").otherwise("none")
    out = out.select("source_id", external.alias("external_id"), "url", "position", listing.alias("listing_id"), how.alias("matched_by"))
    return keep_first(out, KEY, ["position"])


def resolve_discovery(found: DataFrame, listings: DataFrame, identities: DataFrame) -> DataFrame:
    """Advert of each discovered link: by id, then by link, then by a remembered link.

    ``found`` carries source_id, external_id, url, position; every lookup side is one row per key.
    """
    return resolve_links(found, **discovery_lookups(listings, identities))


def discovery_status(resolved: DataFrame) -> DataFrame:
    return resolved.withColumn("status", F.when(F.col("listing_id").isNotNull(), "existing_pending").otherwise("new_pending"))


def gone_adverts(listings: DataFrame, resolved: DataFrame) -> DataFrame:
    return listings.filter("active").join(resolved.select(*KEY), KEY, "left_anti")


def discovery_counts(classified: DataFrame, phase_has_new: bool = True) -> DataFrame:
    existing = F.count_if(F.col("status") == "existing_pending")
    fresh = F.count_if(F.col("status") == "new_pending")
    zero = F.lit(0).cast("bigint")
    return classified.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("seen"),
        existing.alias("existing"),
        (fresh if phase_has_new else zero + F.min(F.lit(0))).alias("new"),
        (zero + F.min(F.lit(0)) if phase_has_new else fresh).alias("out_of_phase"),
    )


def running_counts(classified: DataFrame) -> DataFrame:
    """Position and running new/existing counts in discovery order, per source.

    Positions are first counted per thousand, so that one large source is not ordered as one group.
    """
    block = F.floor(F.col("position") / 1000)
    rows = classified.withColumns({"_block": block, "_new": (F.col("status") == "new_pending").cast("long")})
    totals = rows.groupBy("source_id", "_block").agg(F.count(F.lit(1)).alias("_n"), F.sum("_new").alias("_m"))
    before = Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    totals = totals.select("source_id", "_block", F.coalesce(F.sum("_n").over(before), zero).alias("_bn"), F.coalesce(F.sum("_m").over(before), zero).alias("_bm"))
    w = Window.partitionBy("source_id", "_block").orderBy("position", "external_id")
    out = rows.withColumns({"_k": F.row_number().over(w), "_s": F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    out = out.join(totals, ["source_id", "_block"])
    place, fresh = F.col("_bn") + F.col("_k"), F.col("_bm") + F.col("_s")
    return out.select(*KEY, "position", place.alias("place"), fresh.alias("new_so_far"), (place - fresh).alias("existing_so_far"))


def reprocess_selection(snapshot: DataFrame, mode: str, as_of: str, stale_days: int = 30) -> DataFrame:
    """Known adverts to read again: all, the stale ones or the incomplete ones."""
    rows = snapshot.filter(F.col("listing_id").isNotNull() & F.col("active") & F.col("status").isin("existing_pending", "skipped_existing", "error"))
    if mode == "stale":
        rows = rows.filter(F.datediff(F.lit(as_of).cast("date"), "last_seen_on") > stale_days)
    elif mode == "incomplete":
        rows = rows.filter(F.col("incomplete"))
    return rows


def mirror_key(url: str | Column) -> Column:
    """Last path part that ends in two numbers, in lower case; empty if there is none."""
    path = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"^[^/?#]*//[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(F.lower(path), "/"), lambda part: part.rlike(r"-\d+-\d+$"))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def status_policy(listings: DataFrame, proposed: DataFrame, inactive: Sequence[str], origin: int, mirror: int) -> DataFrame:
    """A property stays active while an advert of another source, not a mirror of it, is still on sale.

    Source ``mirror`` repeats adverts of source ``origin``: for an advert of ``origin`` all of ``mirror``'s are mirrors,
    for one of ``mirror`` those of ``origin`` with its mirror key. Adverts are not paired: sources, and adverts of the
    origin by key, are counted per property.
    """
    on_sale = listings.filter(F.col("active") & ~F.coalesce(F.col("source_status"), F.lit("")).isin(*inactive)).withColumn("_key", mirror_key("url"))
    source = F.col("source_id")
    of_property = on_sale.groupBy("property_id").agg(
        F.countDistinct("source_id").alias("_sources"),
        F.min("source_id").alias("_only"),
        F.count_if(~source.isin(origin, mirror)).alias("_third"),
        F.count_if(source == origin).alias("_origin"),
    )
    same = on_sale.filter((source == origin) & (F.col("_key") != "")).groupBy("property_id", "_key").agg(F.count(F.lit(1)).alias("_same"))
    out = proposed.withColumn("_key", mirror_key("url")).join(of_property, "property_id", "left").join(same, ["property_id", "_key"], "left")
    other = (
        F.when(source == origin, F.col("_third") > 0)
        .when(source == mirror, (F.col("_third") > 0) | (F.col("_origin") > F.coalesce("_same", F.lit(0))))
        .otherwise((F.col("_sources") > 1) | (F.col("_only") != source))
    )
    keep = F.col("status").isin(*inactive) & F.coalesce(other, F.lit(False))
    return out.withColumn("final_status", F.when(keep, "active").otherwise(F.col("status"))).drop("_sources", "_only", "_third", "_origin", "_same", "_key")
