"""Repairs of stored properties: taking back source runs, and details read again."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casagrid.functions import address as A
from casagrid.functions.text import normalize_whitespace
from casagrid.operators.lifecycle import KEY, latest_per_key, mark_removed
from casagrid.operators.listing import canonical_zone_name, coerce_edit, replace_zone_in_json
from casagrid.sources.tables import join_rows

STRETCH_DAYS = 32


def _stretch(day: str | Column) -> Column:
    return F.floor(F.unix_date((F.col(day) if isinstance(day, str) else day).cast("date")) / STRETCH_DAYS)


def rolled_back(listings: DataFrame, runs: DataFrame) -> DataFrame:
    """Adverts first seen inside a window of their source's runs, with the bounds of all windows they lie in.

    ``runs``: source_id, started_on, finished_on. Windows meet adverts by source and stretch of days, so a busy source is
    spread over its history; a window over many stretches is repeated for each.
    """
    windows = runs.select("source_id", F.col("started_on").alias("_from"), F.col("finished_on").alias("_to")).filter("_from <= _to").distinct()
    windows = windows.withColumn("_at", F.explode(F.sequence(_stretch("_from"), _stretch("_to"))))
    rows = listings.select("listing_id", "property_id", *KEY, "url", "active", "first_seen_on", _stretch("first_seen_on").alias("_at"))
    met = rows.join(windows, ["source_id", "_at"]).filter(F.col("first_seen_on").between(F.col("_from"), F.col("_to")))
    return met.groupBy("listing_id", "property_id", *KEY, "url", "active", "first_seen_on").agg(F.min("_from").alias("from_on"), F.max("_to").alias("to_on"))


def rollback_plan(listings: DataFrame, properties: DataFrame, runs: DataFrame) -> DataFrame:
    """What happens to each property with rolled-back adverts, and its own window.

    All of its adverts rolled back: ``preserve`` it if it has manual state, else ``delete`` it. Others left: ``restore`` it
    from the survivor, the active one seen last; ``retire`` it where none of them is active.
    """
    hit = rolled_back(listings, runs).select("listing_id", "from_on", "to_on")
    rows = listings.select("listing_id", "property_id", "active", "last_seen_on").join(hit, "listing_id", "left")
    inside = F.col("from_on").isNotNull()
    left = F.when(~inside & F.col("active"), F.struct("last_seen_on", "listing_id"))
    state = rows.groupBy("property_id").agg(
        F.count_if(inside).alias("rolled_back"), F.count_if(inside & F.col("active")).alias("deactivated"), F.count(F.lit(1)).alias("adverts"),
        F.min("from_on").alias("from_on"), F.max("to_on").alias("to_on"), F.max(left).alias("_survivor"),
    )
    state = state.filter("rolled_back > 0").join(properties.select("property_id", "has_manual_state"), "property_id")
    whole, survivor = F.col("rolled_back") == F.col("adverts"), F.col("_survivor")
    action = F.when(whole & F.col("has_manual_state"), "preserve").when(whole, "delete").when(survivor.isNull(), "retire").otherwise("restore")
    return state.select("property_id", "rolled_back", "deactivated", "adverts", "from_on", "to_on", survivor["listing_id"].alias("survivor_id"), survivor["last_seen_on"].alias("survivor_seen_on"), action.alias("action"))


def after_rollback(properties: DataFrame, plan: DataFrame, snapshots: DataFrame, fields: list[str], note: str) -> DataFrame:
    """Properties as the plan leaves them; deleted ones are gone.

    A restored property takes the fields of its survivor's last snapshot, except those edited by hand (``overrides``); a
    survivor without a snapshot changes no field. ``snapshots``: listing_id, observed_on, snapshot_id and the fields.
    """
    wanted = plan.filter("survivor_id is not null and action = 'restore'").select(F.col("survivor_id").alias("listing_id"), "property_id")
    found = latest_per_key(snapshots, ["listing_id"], [F.col("observed_on"), F.col("snapshot_id")], fields)
    values = wanted.join(found, "listing_id").select("property_id", F.lit(True).alias("_has"), *[F.col(c).alias(f"_s_{c}") for c in fields])
    out = properties.join(plan.select("property_id", "action", "survivor_seen_on"), "property_id", "left").join(values, "property_id", "left")
    action, guarded = F.col("action"), lambda c: F.coalesce(F.array_contains("overrides", c), F.lit(False))
    changed = {c: F.when(F.col("_has") & ~guarded(c), F.col(f"_s_{c}")).otherwise(F.col(c)) for c in fields}
    notes = F.coalesce("personal_notes", F.lit(""))
    changed |= {
        "status": F.when(action.isin("preserve", "retire"), "removed").when((action == "restore") & (F.col("status") == "removed"), "active").otherwise(F.col("status")),
        "is_hidden": F.when(action == "preserve", True).otherwise(F.col("is_hidden")),
        "last_seen_on": F.coalesce(F.when(action == "restore", F.col("survivor_seen_on")), F.col("last_seen_on")),
        "personal_notes": F.when((action == "preserve") & ~notes.contains(note), F.concat(notes, F.when(notes != "", "\n\n").otherwise(""), F.lit(note))).otherwise(F.col("personal_notes")),
    }
    return out.filter(~action.eqNullSafe(F.lit("delete"))).withColumns(changed).select(*properties.columns)


def restored_pins(locations: DataFrame, history: DataFrame, plan: DataFrame) -> DataFrame:
    """Pins of restored properties as they were before their own window changed them; hand-set pins stay.

    ``history``: property_id, history_id, changed_on and the pin that a change replaced. It meets the plan by property and
    stretch of days; the first change inside the window has the pin of before.
    """
    windows = plan.filter("action = 'restore'").select("property_id", "from_on", "to_on").withColumn("_at", F.explode(F.sequence(_stretch("from_on"), _stretch("to_on"))))
    rows = history.withColumn("_at", _stretch("changed_on")).join(windows, ["property_id", "_at"]).filter(F.col("changed_on").between(F.col("from_on"), F.col("to_on")))
    first = rows.groupBy("property_id").agg(F.min(F.struct("changed_on", "history_id", "latitude", "longitude", "precision_kind", "provider")).alias("_b"))
    movable = locations.filter("not coalesce(manually_corrected, false) and latitude is not null").select("property_id")
    return first.join(movable, "property_id").select("property_id", *[F.col(f"_b.{c}").alias(c) for c in ("latitude", "longitude", "precision_kind", "provider")])


def rollback_listings(listings: DataFrame, runs: DataFrame, plan: DataFrame) -> DataFrame:
    """Adverts as the plan leaves them: rolled-back ones go, but for those of preserved properties, which are inactive."""
    hit = rolled_back(listings, runs).select("listing_id", F.lit(True).alias("_hit"))
    kept = plan.filter("action = 'preserve'").select("property_id", F.lit(True).alias("_kept"))
    out = listings.join(hit, "listing_id", "left").join(kept, "property_id", "left").filter("_hit is null or _kept is not null")
    off = F.col("_hit").isNotNull()
    changes = {"active": F.when(off, False).otherwise(F.col("active")), "source_status": F.when(off, "removed").otherwise(F.col("source_status")), "missing_runs": F.when(off, 2).otherwise(F.col("missing_runs"))}
    return out.withColumns(changes).select(*listings.columns)


def remembered_identities(identities: DataFrame, gone: DataFrame, day: str, reason: str) -> DataFrame:
    """Identities after a rollback: every rolled-back advert stays known, so that it does not come back as new."""
    fresh = gone.groupBy(*KEY).agg(F.max_by("url", F.struct("listing_id", "url")).alias("_url"), F.min("first_seen_on").alias("_first"))
    out, hit, today = identities.join(fresh, KEY, "full_outer"), F.col("_url").isNotNull(), F.lit(day).cast("date")
    return out.select(
        *KEY, F.coalesce("_url", "url").alias("url"), F.coalesce("first_seen_on", "_first").alias("first_seen_on"),
        F.when(hit, today).otherwise(F.col("last_seen_on")).alias("last_seen_on"), F.when(hit, reason).otherwise(F.col("last_seen_reason")).alias("last_seen_reason"),
    )


def overlay(stored: DataFrame, parsed: DataFrame, corrections: DataFrame, fields: Mapping[str, str], protected: str = "overrides", order: str = "listing_id") -> DataFrame:
    """Changes (property_id, field, old, new, origin) from details read again and curated corrections.

    All three tables become rows of (property, field, value, rank of origin). A correction beats what was parsed, of the
    adverts of a property the last with a value counts, and empty values and fields edited by hand change nothing. Values
    are compared in their own type (``fields``: name to type). One aggregation picks each value, so a property with very
    many adverts is combined before the shuffle.
    """
    def long(df: DataFrame, origin: int, place: Column) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast(t).cast("string").alias("value")) for c, t in fields.items()])
        rows = df.select("property_id", F.struct(F.lit(origin).alias("origin"), place.cast("long").alias("place")).alias("rank"), F.inline(pairs))
        return rows.filter(F.coalesce("value", F.lit("")) != "")

    given = long(parsed, 1, F.col(order)).unionByName(long(corrections, 2, F.lit(0)))
    best = given.groupBy("property_id", "field").agg(F.max(F.struct("rank", "value")).alias("b")).select("property_id", "field", F.col("b.value").alias("new"), F.col("b.rank.origin").alias("origin"))
    before = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast(t).cast("string").alias("old")) for c, t in fields.items()])
    held = stored.select("property_id", F.coalesce(protected, F.array().cast("array<string>")).alias("_held"), F.inline(before))
    both = best.join(held, ["property_id", "field"]).filter(~F.array_contains("_held", F.col("field")) & ~F.col("new").eqNullSafe(F.col("old")))
    return both.select("property_id", "field", "old", "new", F.when(F.col("origin") == 2, "correction").otherwise("parsed").alias("origin"))


def with_changes(stored: DataFrame, changes: DataFrame, fields: Mapping[str, str], copies: Mapping[str, Mapping[str, Column]] | None = None) -> DataFrame:
    """``stored`` with the changes of :func:`overlay`, pivoted once; ``copies`` sets further columns where a field changes."""
    wide = changes.groupBy("property_id").pivot("field", list(fields)).agg(F.first("new"))
    out = stored.join(wide.select("property_id", *[F.col(c).alias(f"_n_{c}") for c in fields]), "property_id", "left")
    columns = {c: F.coalesce(F.col(f"_n_{c}").cast(t), F.col(c)) for c, t in fields.items()}
    for field, others in (copies or {}).items():
        columns |= {name: F.when(F.col(f"_n_{field}").isNotNull(), value).otherwise(F.col(name)) for name, value in others.items()}
    return out.withColumns(columns).select(*stored.columns)


def link_audit(listings: DataFrame, audit: DataFrame, properties: DataFrame, apply: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Adverts, property states and log after a link audit (``audit``: listing_id, result).

    Only links found unavailable retire their advert, and a property without active adverts is removed. A dry run leaves
    both tables and says in the log what it would have done.
    """
    log = audit.select("listing_id", "result", ((F.col("result") == "unavailable") & F.lit(apply)).alias("applied"), F.lit(not apply).alias("dry_run"))
    if not apply:
        return listings, properties.select("property_id", "status"), log
    gone = audit.filter(F.col("result") == "unavailable").select("listing_id").distinct().join(listings.select("listing_id", *KEY), "listing_id")
    return (*mark_removed(listings, gone, properties), log)


def page_kind_changes(listings: DataFrame, properties: DataFrame, kind: Column, parsed_operation: str | None = None) -> DataFrame:
    """Changes (listing_id, property_id, field, old, new) of adverts that are no sale: search pages, rentals, other offers.

    ``kind`` tells ``listing`` or ``rent`` from the link; otherwise the operation read from the page counts. Such a
    property gets that operation and is hidden.
    """
    rows = listings.withColumn("_kind", kind).join(properties.select("property_id", "operation", "is_hidden"), "property_id")
    told = F.col(parsed_operation) if parsed_operation else F.lit(None).cast("string")
    new = F.coalesce(F.col("_kind"), F.when(~told.isin("sale", ""), told))
    as_row = lambda field, old, value: F.struct(F.lit(field).alias("field"), old.cast("string").alias("old"), value.cast("string").alias("new"))
    pairs = F.array_compact(F.array(F.when(~F.col("operation").eqNullSafe(new), as_row("operation", F.col("operation"), new)), F.when(~F.col("is_hidden"), as_row("is_hidden", F.col("is_hidden"), F.lit(True)))))
    return rows.filter(new.isNotNull()).select("listing_id", "property_id", F.inline(pairs))


def repair_status_and_price(properties: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status and price of properties from adverts read again, and adverts whose source status changes.

    ``parsed``: property_id, listing_id, source_status, and the new parsed_status, parsed_source_status, parsed_price and
    parsed_currency. Adverts of a property count in the order of their ids: the last one's status, and the last price that
    any of them has; without one the price goes. Price and currency are protected together.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    last = F.struct("listing_id", F.coalesce("parsed_status", F.lit("active")).alias("status"), blank("parsed_currency").alias("currency"))
    priced = F.when(F.col("parsed_price").isNotNull(), F.struct("listing_id", "parsed_price", blank("parsed_currency").alias("currency")))
    found = parsed.groupBy("property_id").agg(F.max(last).alias("_last"), F.max(priced).alias("_priced"))
    out = properties.join(found, "property_id")
    held = F.coalesce("overrides", F.array().cast("array<string>"))
    priced_held = F.array_contains(held, "price") | F.array_contains(held, "currency")
    after = out.select(
        "property_id",
        F.when(F.array_contains(held, "status"), F.col("status")).otherwise(F.col("_last.status")).alias("status"),
        F.when(priced_held, F.col("price")).otherwise(F.col("_priced.parsed_price").cast(properties.schema["price"].dataType)).alias("price"),
        F.when(priced_held, F.col("currency")).otherwise(F.coalesce("_priced.currency", "_last.currency")).alias("currency"),
    )
    adverts = parsed.filter(blank("source_status") != blank("parsed_source_status")).select("listing_id", "property_id", F.col("source_status").alias("old_status"), blank("parsed_source_status").alias("new_status"))
    return after, adverts


def repair_localities(df: DataFrame) -> DataFrame:
    """Localities written as towns; zones and other texts that stand in a locality move or go, each with a note.

    Columns read and returned: locality, detected_locality, neighborhood, detected_neighborhood, location_notes; edited
    ones (``overrides``) stay.
    """
    f, empty = F.col, F.lit("")
    held = lambda c: F.coalesce(F.array_contains("overrides", c), F.lit(False))
    df = df.withColumns({f"_{c}": normalize_whitespace(c) for c in ("locality", "detected_locality")})
    df = df.withColumns({f"{c}_town": A.normalize_locality(c) for c in ("_locality", "_detected_locality")} | {f"{c}_zone": A.known_neighborhood(c) for c in ("_locality", "_detected_locality")})
    town, zone = lambda c: f(f"_{c}_town"), lambda c: F.coalesce(f(f"_{c}_zone"), empty)
    other = F.coalesce(F.nullif(town("detected_locality"), empty), F.nullif(town("locality"), empty))
    as_town = lambda c: (f(f"_{c}") != "") & (town(c) != "") & (f(f"_{c}") != town(c))
    as_zone = lambda c: (f(f"_{c}") != "") & (town(c) == "") & (zone(c) != "")
    as_none = lambda c: (f(f"_{c}") != "") & (town(c) == "") & (zone(c) == "")
    own = ~held("locality")
    moved = F.coalesce(other, F.nullif(A.locality_from_neighborhood("_locality_zone"), empty), F.lit(A.DEFAULT_LOCALITY))
    gap = ~held("neighborhood") & (F.coalesce("neighborhood", empty) == "")
    gap_detected = ~gap & (F.coalesce("detected_neighborhood", empty) == "")
    first, second = own & as_zone("locality"), as_zone("detected_locality")
    into = lambda free, c: F.when(first & free, zone("locality")).when(second & free, zone("detected_locality")).otherwise(f(c))
    note = lambda c, when: F.when(
        when,
        F.when(as_town(c), F.concat(F.lit(f"{c}: "), f(f"_{c}"), F.lit(" -> "), town(c)))
        .when(as_zone(c), F.concat(F.lit(f"{c}: se movio localidad invalida a zona "), zone(c), F.lit(": "), f(f"_{c}")))
        .when(as_none(c), F.concat(F.lit(f"{c}: se descarto valor no-localidad: "), f(f"_{c}"))),
    )
    notes = F.transform(F.array_compact(F.array(note("locality", own), note("detected_locality", F.lit(True)))), lambda n: F.concat(F.lit("[repair_localities] "), n))
    known = normalize_whitespace("location_notes")
    lines = F.concat(F.when(known != "", F.array(known)).otherwise(F.array().cast("array<string>")), F.filter(notes, lambda n: n != known))
    out = df.select(
        *[c for c in df.columns if not c.startswith("_") and c not in ("locality", "detected_locality", "neighborhood", "detected_neighborhood", "location_notes")],
        F.when(own & as_town("locality"), town("locality")).when(own & as_zone("locality"), moved).when(own & as_none("locality"), F.coalesce(F.nullif(town("detected_locality"), empty), F.lit(A.DEFAULT_LOCALITY))).otherwise(f("locality")).alias("locality"),
        F.when(as_town("detected_locality"), town("detected_locality")).when(as_zone("detected_locality") | as_none("detected_locality"), empty).otherwise(f("detected_locality")).alias("detected_locality"),
        into(gap, "neighborhood").alias("neighborhood"),
        into(gap_detected, "detected_neighborhood").alias("detected_neighborhood"),
        F.when(F.size(notes) > 0, F.array_join(F.array_distinct(lines), "\n")).otherwise(f("location_notes")).alias("location_notes"),
    )
    return out


def unify_zone(df: DataFrame, columns: list[str], json_columns: list[str]) -> DataFrame:
    """The one name of a zone with aliases in plain columns and, at any depth, in JSON texts."""
    return df.withColumns({c: canonical_zone_name(c) for c in columns} | {c: replace_zone_in_json(c) for c in json_columns})


def apply_edits(properties: DataFrame, edits: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Properties after all valid edits (property_id, edit_id, field, value), with the edit that last changed each field.

    An edit is its own request: refused ones, unknown fields and an empty title change nothing. Edits of a field apply in
    the order of their ids; ``edited_at`` maps each changed field to the last edit that gave it another value, which is
    the first after the last one with a value other than the final. Aggregations only: a field with very many edits is
    combined before the shuffle. A changed address is normalised again.
    """
    result, error = coerce_edit("field", "value")
    rows = edits.filter(F.col("field").isin(*fields)).withColumns({"_result": result, "_error": error})
    rows = rows.filter((F.col("_error") == "") & ~((F.col("field") == "title") & (F.coalesce("_result", F.lit("")) == ""))).select("property_id", "edit_id", "field", F.col("_result").alias("result"))
    stored = properties.select("property_id", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast(t).cast("string").alias("before")) for c, t in fields.items()])))
    final = rows.groupBy("property_id", "field").agg(F.max_by(F.struct("result"), "edit_id").alias("_f")).select("property_id", "field", F.col("_f.result").alias("final"))
    both = rows.join(final, ["property_id", "field"])
    turns = both.groupBy("property_id", "field").agg(F.max(F.when(~F.col("result").eqNullSafe(F.col("final")), F.col("edit_id"))).alias("_other"))
    since = both.join(turns, ["property_id", "field"]).filter(F.col("_other").isNull() | (F.col("edit_id") > F.col("_other")))
    at = since.groupBy("property_id", "field").agg(F.min("edit_id").alias("edit_id"), F.max("_other").alias("_other"))
    changes = join_rows(final.join(at, ["property_id", "field"]), stored, ["property_id", "field"]).filter(F.col("_other").isNotNull() | ~F.col("final").eqNullSafe(F.col("before")))
    wide = changes.groupBy("property_id").pivot("field", list(fields)).agg(F.first(F.struct("final", "edit_id")))
    out = join_rows(properties, wide.select("property_id", *[F.col(c).alias(f"_e_{c}") for c in fields]), "property_id", "left")
    columns = {c: F.when(F.col(f"_e_{c}").isNotNull(), F.col(f"_e_{c}.final").cast(t)).otherwise(F.col(c)) for c, t in fields.items()}
    if "address" in fields and "normalized_address" in properties.columns:
        columns["normalized_address"] = F.when(F.col("_e_address").isNotNull(), A.normalize_address(F.col("_e_address.final"))).otherwise(F.col("normalized_address"))
    entries = F.array_compact(F.array(*[F.when(F.col(f"_e_{c}").isNotNull(), F.struct(F.lit(c).alias("key"), F.col(f"_e_{c}.edit_id").alias("value"))) for c in fields]))
    columns["edited_at"] = F.map_from_entries(entries)
    return out.withColumns(columns).select(*properties.columns, "edited_at")
