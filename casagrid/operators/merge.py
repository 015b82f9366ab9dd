"""Duplicate components, merging, splitting, field diffs and curated corrections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casagrid.functions.urls import url_tail
from casagrid.session import ensure_checkpoint_dir


def tail_edges(listings: DataFrame, sources: Sequence[int] | None = None) -> DataFrame:
    """Star edges between properties whose adverts share the last path part across two sources.

    Each property is tied to the least property of its group, so a group of n gives n−1 edges, not n².
    """
    rows = listings if sources is None else listings.filter(F.col("source_id").isin(list(sources)))
    rows = rows.select("property_id", "source_id", url_tail("url").alias("tail")).filter(F.col("tail") != "").distinct()
    hub = rows.groupBy("tail").agg(F.min("property_id").alias("hub"), F.min("source_id").alias("_a"), F.max("source_id").alias("_b"))
    hub = hub.filter(F.col("_a") != F.col("_b")).select("tail", "hub")
    pairs = rows.select("property_id", "tail").distinct().join(hub, "tail")
    return pairs.filter(F.col("property_id") != F.col("hub")).select(F.col("property_id").alias("a"), F.col("hub").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components as (node, component = least node).

    Alternates star steps: every node points its larger neighbours at its least neighbour, then points its
    smaller neighbours at the least of all. Each round is two aggregations; the frame is checkpointed
    every round because the plan would otherwise grow, and the number of rounds is logarithmic. It ends when a round
    changes no link, and raises if ``max_rounds`` do not suffice: an unfinished result is never returned.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("_m"))
        least = least.select(F.col("a").alias("_node"), F.least("a", "_m").alias("_m"))
        joined = both.join(least, both.a == least._node).drop("_node")
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(joined.select("a", F.col("_m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    for _ in range(max_rounds):
        after = star(star(current, True), False).checkpoint()
        settled = after.exceptAll(current).isEmpty() and current.exceptAll(after).isEmpty()
        current = after
        if settled:
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.union(roots).groupBy("node").agg(F.min("component").alias("component"))


# What a merged property takes from its duplicates where its own value is empty.
FILL_FIELDS = (
    "property_type", "operation", "title", "description", "address", "normalized_address", "locality", "neighborhood", "currency", "price", "rooms", "bedrooms", "bathrooms",
    "garages", "toilets", "covered_area", "total_area", "land_area", "uncovered_area", "semicovered_area", "front_width", "lot_depth", "building_floors", "age_years",
    "condition_category", "features", "detected_locality", "detected_neighborhood", "detected_address", "detected_latitude", "detected_longitude", "inferred_neighborhood",
    "inferred_neighborhood_method", "inferred_neighborhood_distance_m", "location_source", "location_confidence", "location_notes", "location_evidence",
)
STATE_FIELDS = ("is_favorite", "is_hidden", "is_reviewed", "status", "personal_notes", "overrides", "first_seen_on", "last_seen_on")


def has_value(df: DataFrame, c: str) -> Column:
    """Neither null, nor empty text, nor an empty list or map."""
    kind = df.schema[c].dataType.typeName()
    if kind in ("array", "map"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(F.col(c) != "", F.lit(False)) if kind == "string" else F.col(c).isNotNull()


def merge_score(df: DataFrame, fields: Sequence[str]) -> Column:
    """Worth of a property as the one that stays."""
    f = F.col
    filled = sum((has_value(df, c).cast("int") for c in fields), F.lit(0))
    return (
        F.when(f("status") != "removed", 1000).otherwise(0)
        + F.when(~f("is_hidden"), 700).otherwise(0)
        + F.when(f("status") == "active", 200).otherwise(0)
        + filled
        + F.coalesce(f("listing_count"), F.lit(0)) * 3
        + F.least(F.coalesce(f("image_count"), F.lit(0)), F.lit(8))
        + F.when(f("is_favorite"), 12).otherwise(0)
        + F.when(f("personal_notes") != "", 6).otherwise(0)
        + F.when(f("latitude").isNotNull(), 5).otherwise(0)
        + F.when(f("is_reviewed"), 2).otherwise(0)
    )


def joined_notes(own: Column, others: Column) -> Column:
    """``own`` notes, and for each of ``others`` (property_id, notes) in turn its mark and notes, unless they are there."""

    def add(text: Column, part: Column | str) -> Column:
        return F.concat(text, F.when(text != "", "\n\n").otherwise(""), part)

    def step(text: Column, other: Column) -> Column:
        id, notes = other["property_id"].cast("string"), other["notes"]
        mark = F.concat(F.lit("Fusionada con propiedad #"), id)
        marked = F.when(text.contains(mark), text).otherwise(add(text, mark))
        fresh = (notes != "") & ~marked.contains(notes)
        return F.when(fresh, add(marked, F.concat(F.lit("Notas de #"), id, F.lit(": "), notes))).otherwise(marked)

    return F.aggregate(others, own, step)


def merge_components(properties: DataFrame, members: DataFrame, fields: Sequence[str] = FILL_FIELDS, normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per component: the best property, its empty fields filled from the others in the order of their scores.

    ``properties`` carries listing_count, image_count, personal_notes, overrides and the fields. Each field is the value of
    the best property that has one, so all are one aggregation, combined before the shuffle; only the notes, which hold a
    mark of every duplicate anyway, list members. ``normalize`` makes normalized_address from an address that was filled.
    ``pin_from`` is the property whose pin the canonical one has: its own, else that of the best duplicate with one.
    """
    rows = properties.join(members.withColumnRenamed("node", "property_id"), "property_id")
    rows = rows.withColumn("score", merge_score(rows, fields))
    rank = F.struct(F.col("score"), -F.col("property_id"))
    notes = F.coalesce("personal_notes", F.lit(""))
    best = [F.max_by(F.when(has_value(rows, c), F.col(c)), F.when(has_value(rows, c), rank)).alias(c) for c in fields]
    out = rows.groupBy("component").agg(
        F.max_by("property_id", rank).alias("canonical_id"),
        F.count(F.lit(1)).alias("members"),
        *best,
        F.bool_or("is_favorite").alias("is_favorite"),
        F.bool_and("is_hidden").alias("is_hidden"),
        F.bool_or("is_reviewed").alias("is_reviewed"),
        F.when(F.bool_or(F.col("status") == "active"), "active").otherwise(F.max_by("status", rank)).alias("status"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("overrides", F.array().cast("array<string>")))))).alias("overrides"),
        F.min("first_seen_on").alias("first_seen_on"),
        F.max("last_seen_on").alias("last_seen_on"),
        F.max_by("property_id", F.when(F.col("latitude").isNotNull(), rank)).alias("pin_from"),
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("_order"), "property_id", notes.alias("notes")))).alias("_notes"),
        *([F.max_by(has_value(rows, "address"), rank).alias("_had_address")] if "address" in fields else []),
    )
    out = out.withColumn("personal_notes", joined_notes(F.col("_notes")[0]["notes"], F.slice("_notes", 2, F.greatest(F.size("_notes") - 1, F.lit(0)))))
    if normalize is not None:
        filled = ~F.col("_had_address") & F.col("address").isNotNull()
        out = out.withColumn("normalized_address", F.when(filled, normalize(F.col("address"))).otherwise(F.col("normalized_address")))
    return out.drop("_notes", "_had_address")


def merged_state(properties: DataFrame, members: DataFrame, merged: DataFrame, note_time: str, fields: Sequence[str] = FILL_FIELDS) -> DataFrame:
    """All properties after the merge: canonical ones with the merged values, absorbed ones hidden, removed and marked."""
    names = [*fields, *STATE_FIELDS]
    role = members.withColumnRenamed("node", "property_id").join(merged.select("component", "canonical_id"), "component").drop("component")
    values = merged.select(F.col("canonical_id").alias("property_id"), *[F.col(c).alias(f"_m_{c}") for c in names])
    out = properties.join(role, "property_id", "left").join(values, "property_id", "left")
    canonical, absorbed = F.col("canonical_id") == F.col("property_id"), F.col("canonical_id") != F.col("property_id")
    notes = F.coalesce("personal_notes", F.lit(""))
    mark = F.concat(notes, F.when(notes != "", "\n\n").otherwise(""), F.lit("Fusionada en propiedad #"), F.col("canonical_id").cast("string"), F.lit(f" el {note_time}"))
    columns = {c: F.when(canonical, F.coalesce(F.col(f"_m_{c}"), F.col(c))).otherwise(F.col(c)) for c in names}
    columns |= {
        "is_hidden": F.when(absorbed, True).otherwise(columns["is_hidden"]),
        "status": F.when(absorbed, "removed").otherwise(columns["status"]),
        "personal_notes": F.when(absorbed, mark).otherwise(columns["personal_notes"]),
    }
    return out.withColumns(columns).select(*properties.columns)


def undo_record(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """What a change of ``fields`` takes to be undone: (property_id, field, old, new) of each value that differs."""
    text = lambda df, c: (F.to_json(c) if df.schema[c].dataType.typeName() in ("array", "map") else F.col(c).cast("string"))
    old = before.select("property_id", *[text(before, c).alias(f"_o_{c}") for c in fields])
    new = after.select("property_id", *[text(after, c).alias(f"_n_{c}") for c in fields])
    pairs = [F.when(~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"_o_{c}").alias("old"), F.col(f"_n_{c}").alias("new"))) for c in fields]
    return old.join(new, "property_id").select("property_id", F.inline(F.array_compact(F.array(*pairs))))


def moved_pins(merged: DataFrame) -> DataFrame:
    """Pins that move to another property."""
    return merged.filter("pin_from <> canonical_id").select(F.col("pin_from").alias("from_id"), F.col("canonical_id").alias("property_id"))


def repoint_listings(listings: DataFrame, members: DataFrame, merged: DataFrame) -> DataFrame:
    target = members.join(merged.select("component", "canonical_id"), "component").select(F.col("node").alias("property_id"), "canonical_id")
    out = listings.join(target, "property_id", "left")
    return out.withColumn("property_id", F.coalesce("canonical_id", "property_id")).drop("canonical_id")


def split_plan(properties: DataFrame, listings: DataFrame, plausible: Column) -> DataFrame:
    """Active adverts to separate from properties that joined several without a plausible address.

    The first advert keeps the property; an advert with the property's own fingerprint gets a split identity.
    """
    doubtful = properties.filter(~plausible).select("property_id", "fingerprint")
    rows = listings.filter("active").join(doubtful, "property_id")
    first = rows.groupBy("property_id").agg(F.min("listing_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    rows = rows.join(first, "property_id").filter(F.col("listing_id") != F.col("_first"))
    identity = F.concat_ws("|", F.lit("split"), F.col("source_id").cast("string"), F.col("external_id").cast("string"), "url")
    new = F.when(F.col("listing_print") == F.col("fingerprint"), F.sha2(identity, 256)).otherwise(F.col("listing_print"))
    return rows.select("listing_id", "property_id", "source_id", "external_id", "url", new.alias("new_fingerprint"))


def field_diff(
    before: DataFrame,
    after: DataFrame,
    key: str,
    fields: Sequence[str],
    protected: str | None = None,
    clearable: Sequence[str] = (),
) -> DataFrame:
    """Long change report (key, field, old, new).

    Hand-edited fields are left alone, empty values clear only fields that may be cleared, and an address
    is not replaced by a poorer one.
    """
    old = before.select(key, *[F.col(c).cast("string").alias(f"_o_{c}") for c in fields], *([protected] if protected else []))
    new = after.select(key, *[F.col(c).cast("string").alias(f"_n_{c}") for c in fields])
    both = old.join(new, key)
    items = []
    for c in fields:
        a, b = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        change = ~a.eqNullSafe(b)
        if c not in clearable:
            change = change & (F.coalesce(b, F.lit("x")) != "")
        if protected:
            change = change & ~F.coalesce(F.array_contains(protected, c), F.lit(False))
        if c in ("address", "detected_address"):
            change = change & ~is_downgrade(a, b)
        items.append(F.when(change, F.struct(F.lit(c).alias("field"), a.alias("old"), b.alias("new"))))
    return both.select(key, F.inline(F.array_compact(F.array(*items))))


def is_downgrade(old: Column, new: Column) -> Column:
    a, b = F.btrim(F.coalesce(old, F.lit(""))), F.btrim(F.coalesce(new, F.lit("")))
    loses_number = a.rlike(r"\d") & ~b.rlike(r"\d")
    shorter = (F.length(a) >= F.length(b) + 18) & a.contains(",")
    return (a != "") & (b != "") & (a != b) & (loses_number | shorter)


def apply_corrections(df: DataFrame, corrections: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Curated values replace stored ones where they are given."""
    fixes = corrections.groupBy(key).agg(*[F.max(c).alias(f"_c_{c}") for c in fields])
    out = df.join(fixes, key, "left")
    return out.withColumns({c: F.coalesce(f"_c_{c}", c) for c in fields}).drop(*[f"_c_{c}" for c in fields])


def apply_decisions(df: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Review decisions (approve, address, locality, zone, remove); the last decision of a property wins."""
    last = decisions.groupBy(key).agg(F.max(F.struct("decided_at", "decision", "value")).alias("_d"))
    out = df.join(last.select(key, F.col("_d.decision").alias("_k"), F.col("_d.value").alias("_v")), key, "left")
    k, v = F.col("_k"), F.col("_v")
    return out.withColumns(
        {
            "address": F.when(k == "address", v).otherwise(F.col("address")),
            "locality": F.when(k == "locality", v).otherwise(F.col("locality")),
            "inferred_zone": F.when(k == "zone", v).otherwise(F.col("inferred_zone")),
            "status": F.when(k == "remove", "removed").otherwise(F.col("status")),
            "is_reviewed": F.when(k.isNotNull(), True).otherwise(F.col("is_reviewed")),
        }
    ).drop("_k", "_v")


def prefix_rules(df: DataFrame, column: str, rules: DataFrame, fields: Sequence[str]) -> DataFrame:
    """First rule whose prefix starts the text, found by equi join on every prefix length in use.

    ``rules``: prefix, rule_no and the fields; prefixes end at a word or inside one.
    """
    sizes = rules.agg(F.array_sort(F.collect_set(F.length("prefix")))).scalar()
    heads = df.withColumn("_len", F.explode(sizes)).withColumn("prefix", F.left(F.col(column), F.col("_len"))).filter(F.length(column) >= F.col("_len"))
    best = heads.join(rules, "prefix").groupBy(column).agg(F.min(F.struct("rule_no", *fields)).alias("_r"))
    return df.join(best.select(column, *[F.col(f"_r.{c}").alias(f"rule_{c}") for c in fields]), column, "left")


def remap_agencies(listings: DataFrame, agencies: DataFrame, canonical: Column) -> tuple[DataFrame, DataFrame]:
    """Point adverts at the least agency of each canonical name; agencies without adverts are dropped."""
    named = agencies.withColumn("canonical_name", canonical)
    target = named.filter(F.col("canonical_name") != "").groupBy("canonical_name").agg(F.min("agency_id").alias("target_id"))
    mapping = named.join(target, "canonical_name", "left").select("agency_id", "target_id", "canonical_name")
    moved = listings.join(mapping.select("agency_id", "target_id"), "agency_id", "left").withColumn("agency_id", F.col("target_id")).drop("target_id")
    kept = target.join(moved.select(F.col("agency_id").alias("target_id")), "target_id", "left_semi")
    return moved, kept


def sample_per_category(df: DataFrame, category: str, key: str, n: int) -> DataFrame:
    """First ids per category; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(category).orderBy(key)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
