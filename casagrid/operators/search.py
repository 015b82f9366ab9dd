"""Faceted, text and spatial search over properties: predicates, sort, page."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casagrid.functions.geo import BOUNDARY_M, haversine_m, literal_ring, radius_bbox, ring_contains, ring_edges
from casagrid.functions.numbers import bind, non_empty, truthy
from casagrid.functions.quality import curate
from casagrid.functions.text import fold_literal, search_text, text_key
from casagrid.sources.tables import join_rows

# Other spellings of the merged centre zone.
CENTRE_ZONE = "Hurlingham Centro (Barrio Ingles)"
CENTRE_ALIASES = (
    CENTRE_ZONE,
    "Hurlingham Centro",
    "Hurlingham Centro Barrio Ingles",
    "Barrio Ingles",
    "Barrio Inglés",
    "B Ingles",
    "B Inglés",
    "Ingles",
    "Inglés",
)

MEMBERSHIP = {
    "property_type": "property_type",
    "operation": "operation",
    "currency": "currency",
    "status": "status",
    "condition_category": "condition_category",
    "security_level": "security_level",
    "security_zone": "security_zone_label",
    "location_value_level": "level",
}

# parameter -> (column, lower bound?)
RANGES = {
    "price_min": ("price", True),
    "price_max": ("price", False),
    "security_coverage_min": ("security_coverage_score", True),
    "security_coverage_max": ("security_coverage_score", False),
    "security_risk_min": ("security_risk_score", True),
    "security_risk_max": ("security_risk_score", False),
    "location_score_min": ("overall_score", True),
    "location_score_max": ("overall_score", False),
    "transport_score_min": ("transport_score", True),
    "flood_penalty_min": ("flood_penalty_score", True),
    "flood_penalty_max": ("flood_penalty_score", False),
    "settlement_near_max": ("nearest_settlement_m", False),
    "land_min": ("land_area", True),
    "land_max": ("land_area", False),
    "covered_min": ("covered_area", True),
    "covered_max": ("covered_area", False),
    "bedrooms_min": ("bedrooms", True),
    "bedrooms_max": ("bedrooms", False),
    "bathrooms_min": ("bathrooms", True),
    "bathrooms_max": ("bathrooms", False),
    "garages_min": ("garages", True),
    "age_min": ("age_years", True),
    "age_max": ("age_years", False),
}


def values_of(params: Mapping, key: str) -> list[str]:
    raw = params.get(key)
    items = raw if isinstance(raw, (list, tuple, set)) else [raw]
    return [str(v) for v in items if v not in (None, "")]


def number_of(params: Mapping, key: str) -> Decimal | None:
    try:
        raw = params.get(key)
        return None if raw in (None, "") else Decimal(str(raw))
    except InvalidOperation:
        return None


def join_base(properties: DataFrame, locations: DataFrame, intelligence: DataFrame) -> DataFrame:
    """property ⟕ location ⟕ intelligence, one row per property."""
    return join_rows(join_rows(properties, locations, "property_id", "left"), intelligence, "property_id", "left")


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def zone_values(zones: list[str]) -> list[str]:
    out: list[str] = []
    for zone in zones:
        out.extend(CENTRE_ALIASES if zone == CENTRE_ZONE else (zone,))
    return out


def canonical_zones(params: Mapping, known: Iterable[str]) -> list[str]:
    def key(text: str) -> str:
        return "".join(ch for ch in fold_literal(text) if ch.isascii() and ch.isalnum())

    by_key = {key(name): name for name in known}
    picked = [by_key.get(key(v)) for v in values_of(params, "neighborhood")]
    return list(dict.fromkeys(v for v in picked if v))


def text_predicate(query: str, *columns: str) -> Column:
    """All words required, each a prefix; a word holding punctuation is a phrase."""
    words = [" ".join("".join(ch if ch.isalnum() else " " for ch in fold_literal(w)).split()) for w in query.split()]

    def has_all(body: Column) -> Column:
        out = F.lit(True)
        for word in words:
            if word:
                out = out & body.contains(" " + word)
        return out

    # The text is folded once for all words.
    return bind(search_text(*columns), has_all)


def has_completeness(field: str) -> Column:
    """Presence tests over columns that :func:`listing_facts` and ``curate`` add."""
    return {
        "price": F.col("valid_price").isNotNull(),
        "surface": F.col("valid_area").isNotNull(),
        "location": F.col("latitude").isNotNull(),
        "address": F.coalesce(non_empty("address"), non_empty("detected_address")).isNotNull(),
        "image": F.coalesce(F.col("has_image"), F.lit(False)),
        "link": F.coalesce(F.col("listing_count"), F.lit(0)) > 0,
        "agency": F.coalesce(F.col("has_agency"), F.lit(False)),
    }[field]


def listing_facts(listings: DataFrame) -> DataFrame:
    """Per property: number of adverts and whether any carries an image or an agency."""
    return listings.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("listing_count"),
        F.bool_or(F.coalesce(F.col("image_url"), F.lit("")) != "").alias("has_image"),
        F.bool_or(F.col("agency_id").isNotNull()).alias("has_agency"),
    )


def search(
    df: DataFrame,
    params: Mapping,
    listings: DataFrame | None = None,
    known_zones: Iterable[str] = (),
) -> DataFrame:
    """Apply every filter of a search request to the joined base as one lazy plan."""
    f = F.col
    if params.get("q"):
        df = df.filter(text_predicate(str(params["q"]), "title", "description", "address", "locality", "neighborhood", "feature_text"))
    if params.get("title"):
        df = df.filter(F.lower(f("title")).contains(str(params["title"]).strip().lower()))
    for parameter, column in MEMBERSHIP.items():
        wanted = values_of(params, parameter)
        if wanted:
            df = df.filter(f(column).isin(wanted))
    wanted = values_of(params, "locality")
    if wanted:
        df = df.filter(any_of(f(c).isin(wanted) for c in ("inferred_locality", "locality", "detected_locality")))
    wanted = values_of(params, "location_value_zone")
    if wanted:
        df = df.filter(any_of(f(c).isin(wanted) for c in ("inferred_zone", "zone_name")))
    if not values_of(params, "status"):
        df = df.filter(f("status") == "active")
    if values_of(params, "neighborhood"):
        zones = zone_values(canonical_zones(params, known_zones))
        columns = ("inferred_zone", "neighborhood", "detected_neighborhood", "inferred_neighborhood", "zone_name")
        df = df.filter(any_of(f(c).isin(zones) for c in columns) if zones else F.lit(False))
    if params.get("zone_missing") == "1":
        for c in ("inferred_zone", "inferred_neighborhood", "zone_name"):
            df = df.filter(F.coalesce(f(c), F.lit("")) == "")
    if not params.get("operation") and params.get("show_non_sale") != "1":
        df = df.filter(f("operation") == "sale")
    if "1" not in values_of(params, "show_hidden"):
        df = df.filter(~f("is_hidden"))
    if "1" in values_of(params, "favorite"):
        df = df.filter(f("is_favorite"))
    states = set(values_of(params, "review_state"))
    if states == {"pending"}:
        df = df.filter(~f("is_reviewed"))
    elif states == {"reviewed"}:
        df = df.filter(f("is_reviewed"))
    df = _location_quality(df, set(values_of(params, "location_quality")))
    for key, column in (("agency", "agency_id"), ("source", "source_id")):
        wanted = values_of(params, key)
        if wanted and listings is not None:
            hits = listings.filter(f(column).isin([int(v) for v in wanted])).select("property_id")
            df = df.join(hits, "property_id", "left_semi")
    for parameter, (column, lower) in RANGES.items():
        bound = number_of(params, parameter)
        if bound is not None:
            limit = F.lit(float(bound)) if dict(df.dtypes)[column] == "double" else F.lit(bound)
            df = df.filter(f(column) >= limit if lower else f(column) <= limit)
    flood = set(values_of(params, "location_flood_risk"))
    if flood == {"yes"}:
        df = df.filter(f("in_flood_risk_zone"))
    elif flood == {"no"}:
        df = df.filter(~f("in_flood_risk_zone"))
    wanted = values_of(params, "feature")
    if wanted:
        df = df.filter(
            any_of(F.lower(f(c)).contains(v.lower()) for v in wanted for c in ("feature_text", "description"))
        )
    df = within_bounds(df, *(number_of(params, k) for k in ("south", "west", "north", "east")))
    df = within_radius(df, *(number_of(params, k) for k in ("radius_lat", "radius_lng", "radius_km")))
    if params.get("polygon"):
        df = within_polygon(df, params["polygon"])
    low, high = number_of(params, "price_m2_min"), number_of(params, "price_m2_max")
    if low is not None:
        df = df.filter(f("price_m2") >= F.lit(low))
    if high is not None:
        df = df.filter(f("price_m2") <= F.lit(high))
    field, state = params.get("quality_field"), params.get("quality_state")
    if field and state in {"present", "missing"}:
        if field in {"image", "link", "agency"} and listings is not None:
            df = df.join(listing_facts(listings), "property_id", "left")
        df = df.filter(has_completeness(field) if state == "present" else ~has_completeness(field))
    return df


def _location_quality(df: DataFrame, wanted: set[str]) -> DataFrame:
    f = F.col
    tests = {
        "reliable": f("location_confidence").isin("high", "medium"),
        "unreliable": f("location_confidence").isin("low", "unknown") | f("latitude").isNull(),
        "detected": (f("location_source") != "unknown")
        | (F.coalesce(f("address"), F.lit("")) != "")
        | (F.coalesce(f("detected_address"), F.lit("")) != ""),
    }
    picked = [tests[w] for w in tests if w in wanted]
    return df.filter(any_of(picked)) if picked else df


def within_bounds(df: DataFrame, south, west, north, east) -> DataFrame:
    if None in (south, west, north, east):
        return df
    return df.filter(
        F.col("latitude").between(float(south), float(north)) & F.col("longitude").between(float(west), float(east))
    )


def within_radius(df: DataFrame, lat, lon, radius_km) -> DataFrame:
    """Box first, so that file statistics prune, then the exact distance."""
    if None in (lat, lon, radius_km):
        return df
    lat, lon, radius_km = float(lat), float(lon), float(radius_km)
    df = within_bounds(df, *radius_bbox(lat, lon, radius_km))
    distance = haversine_m(F.lit(lat), F.lit(lon), "latitude", "longitude") / F.lit(1000.0)
    return df.withColumn("distance_km", distance).filter(F.col("distance_km") <= radius_km)


def within_polygon(df: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    lons, lats = [p[0] for p in ring], [p[1] for p in ring]
    df = within_bounds(df, min(lats), min(lons), max(lats), max(lons))
    edges = ring_edges(literal_ring(ring))
    return df.filter(ring_contains(F.col("latitude"), F.col("longitude"), edges, BOUNDARY_M))


SORT_KEYS = {
    "price": lambda: F.col("price"),
    "title": lambda: F.col("title"),
    "agency": lambda: F.col("agency_name"),
    "source": lambda: F.col("source_name"),
    "locality": lambda: F.col("display_locality"),
    "bedrooms": lambda: F.col("bedrooms"),
    "bathrooms": lambda: F.col("bathrooms"),
    "covered_area": lambda: F.col("covered_area"),
    "land_area": lambda: F.col("land_area"),
    "area": lambda: F.coalesce(truthy("land_area"), truthy("total_area"), F.col("covered_area")),
    "price_m2": lambda: F.col("price_m2"),
    "first_seen": lambda: F.col("first_seen_on"),
    "last_seen": lambda: F.col("last_seen_on"),
    "reviewed": lambda: F.col("is_reviewed").cast("int"),
    "quality": lambda: F.col("quality_score"),
    "distance": lambda: F.col("distance_km"),
}


def sort_tokens(raw: str | None) -> list[str]:
    out: dict[str, str] = {}
    for token in (raw or "-last_seen").split(","):
        token = token.strip()
        field = token.removeprefix("-")
        if field in SORT_KEYS and field not in out:
            out[field] = token
    return list(out.values()) or ["-last_seen"]


def order_columns(df: DataFrame, raw: str | None) -> list[Column]:
    """Sort keys with missing values last in both directions and the id as the last tie-break."""
    columns = []
    for token in sort_tokens(raw):
        field = token.removeprefix("-")
        key = SORT_KEYS[field]()
        if field in {"title", "agency", "source", "locality"}:
            key = non_empty(F.lower(key))
        columns.append(key.desc_nulls_last() if token.startswith("-") else key.asc_nulls_last())
    return [*columns, F.col("property_id").asc()]


def sort_results(df: DataFrame, raw: str | None) -> DataFrame:
    return df.orderBy(*order_columns(df, raw))


def page(df: DataFrame, raw_sort: str | None, number: int = 1, size: int = 24) -> DataFrame:
    return sort_results(df, raw_sort).offset((number - 1) * size).limit(size)


def numbered_top(df: DataFrame, order: list[Column], limit: int, name: str = "position") -> DataFrame:
    """Top rows with their place. The limit runs first, so the numbering sees a bounded set."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def primary_listing(listings: DataFrame, *columns: str) -> DataFrame:
    """First active advert, else the first, newest seen first."""
    rank = F.struct(
        F.col("active").cast("int"), F.col("last_seen_on"), -F.col("listing_id"), *[F.col(c) for c in columns]
    )
    best = listings.groupBy("property_id").agg(F.max(rank).alias("best"))
    return best.select("property_id", *[F.col(f"best.{c}").alias(c) for c in columns])


def first_last_listing(listings: DataFrame) -> DataFrame:
    return primary_listing(listings, "source_id", "agency_id", "url")


def card_image(listings: DataFrame) -> DataFrame:
    """Newest https image of an active advert, with a fallback advert link."""
    url = F.lower(F.coalesce(F.col("image_url"), F.lit("")))
    usable = F.col("active") & (url != "") & ~url.rlike("^(http://|javascript:|data:|file:|ftp:)")
    fallback = F.col("active") & F.lower(F.col("url")).startswith("https://")
    key = (-F.datediff(F.col("last_seen_on"), F.lit("1970-01-01").cast("date")), F.col("listing_id"), F.col("line_no"), F.col("image_url"), F.col("url"))
    back = (key[0], F.col("listing_id"), F.col("url"))
    out = listings.groupBy("property_id").agg(
        F.min(F.when(usable, F.struct(*key))).alias("img"), F.min(F.when(fallback, F.struct(*back))).alias("alt")
    )
    return out.select(
        "property_id",
        F.col("img.image_url").alias("image_url"),
        F.col("img.url").alias("image_listing_url"),
        F.col("alt.url").alias("fallback_url"),
    )


def nearby_eligible(
    base: DataFrame,
    listings: DataFrame,
    property_types: list[str] | None = None,
    price_currency: str = "USD",
    price_min=None,
    price_max=None,
    bedrooms_min=None,
    covered_area_min=None,
    land_area_min=None,
) -> DataFrame:
    """Properties fit for the nearby search: shown, priced, well placed and with a live advert."""
    f = F.col
    usd = (f("currency") == "USD") & f("price").between(1000, 5000000)
    other = (f("currency") != "USD") & (f("price") > 0)
    placed = (f("precision_kind") == "manual") | f("manually_corrected") | f("location_confidence").isin("high", "medium")
    df = base.filter(
        (f("operation") == "sale")
        & (f("status") == "active")
        & ~f("is_hidden")
        & ~f("outside_target")
        & f("precision_kind").isin("exact", "manual")
        & (usd | other)
        & placed
    )
    if property_types:
        df = df.filter(f("property_type").isin(property_types))
    if price_min is not None:
        df = df.filter((f("currency") == price_currency) & (f("price") >= price_min))
    if price_max is not None:
        df = df.filter((f("currency") == price_currency) & (f("price") <= price_max))
    if bedrooms_min is not None:
        df = df.filter(f("bedrooms") >= bedrooms_min)
    if covered_area_min is not None:
        df = df.filter(f("covered_area") >= covered_area_min)
    if land_area_min is not None:
        df = df.filter(f("land_area") >= land_area_min)
    return df.join(listings.filter(f("active")).select("property_id"), "property_id", "left_semi")


def suspicious_prices(base: DataFrame, listings: DataFrame) -> DataFrame:
    f = F.col
    joined = listings.join(base.select("property_id", "price", "currency", "status"), "property_id")
    return joined.filter(
        (f("price") == 1) | f("price").isNull() | (f("currency") == "ARS") | (f("status") != "active") | (f("source_status") != "")
    )


def token_index(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Inverted index (word, key) for repeated text searches; write it partitioned by first letter."""
    words = F.explode(F.array_distinct(F.split(F.btrim(search_text(*columns)), " ")))
    return df.select(F.col(key), words.alias("word")).filter((F.col("word") != "") & (F.col("word") != "\u0001"))


def search_index(index: DataFrame, key: str, query: str) -> DataFrame:
    """Keys holding every word of the query as a prefix, counted on the index alone."""
    words = list(dict.fromkeys("".join(ch if ch.isalnum() else " " for ch in fold_literal(query)).split()))
    which = F.array_compact(F.array(*[F.when(F.col("word").startswith(w), F.lit(i)) for i, w in enumerate(words)]))
    hits = index.filter(any_of(F.col("word").startswith(w) for w in words)).select(key, F.explode(which).alias("w"))
    return hits.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(words)).select(key)


def canonical_key_match(df: DataFrame, column: str, zones: DataFrame) -> DataFrame:
    """Equi join on the folded key, so differently written names meet without pairwise tests."""
    keyed = zones.select(text_key("zone_name").alias("_key"), F.col("zone_name").alias("canonical_zone"))
    return df.withColumn("_key", text_key(column)).join(keyed, "_key", "left").drop("_key")


def curated_base(properties: DataFrame, locations: DataFrame, intelligence: DataFrame) -> DataFrame:
    return curate(join_base(properties, locations, intelligence))
