"""Zone scores, security and location scoring of properties, territory inference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casagrid.functions.numbers import (
    classify_level,
    clamp_score,
    location_level,
    non_empty,
    norm_inverse_distance,
    risk_from_coverage,
    round_stat,
    security_level,
    weighted_score,
)
from casagrid.functions.text import fold_plain
from casagrid.operators.geocode import from_cache
from casagrid.operators.spatial import candidates, covering_or_nearest, first_covering, nearby_points, nearest_feature, pick, pins_of, radius_pairs
from casagrid.session import ensure_checkpoint_dir
from casagrid.sources.tables import join_rows


def min_max(df: DataFrame, columns: Sequence[str], prefix: str = "n_") -> DataFrame:
    """Scale columns to 0–100 over the whole table; a constant column is 100 when positive, else 0."""
    limits = df.agg(F.struct(*[x for c in columns for x in (F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"))]))
    out = df.withColumn("_lim", limits.scalar())
    for c in columns:
        lo, hi, v = F.col(f"_lim.lo_{c}"), F.col(f"_lim.hi_{c}"), F.col(c).cast("double")
        scaled = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(v - lo, hi - lo) * 100))
        flat = F.when(hi > 0, 100.0).otherwise(0.0)
        out = out.withColumn(f"{prefix}{c}", F.when(v.isNotNull(), F.when(lo == hi, flat).otherwise(scaled)))
    return out.drop("_lim")


# Components and weights of each zone score. "density" columns are min-max scaled,
# "near" columns are inverse distances with a cap in metres, "as is" columns enter unchanged.
SECURITY_WEIGHTS = (
    ("density", "cameras_per_km2", 0.20, None),
    ("as is", "camera_coverage_250m_pct", 0.25, None),
    ("near", "nearest_police_m", 0.20, 3000),
    ("density", "police_station_count_per_km2", 0.10, None),
    ("density", "women_police_station_count_per_km2", 0.05, None),
    ("density", "safe_stop_count_per_km2", 0.10, None),
    ("density", "plate_reader_count_per_km2", 0.10, None),
)
POI_WEIGHTS = {
    "amenity_density_score": (
        ("density", "commercial_pois_per_km2", 0.50, None),
        ("near", "nearest_supermarket_m", 0.25, 2000),
        ("near", "nearest_pharmacy_m", 0.25, 2000),
    ),
    "green_access_score": (("density", "green_area_pct", 0.60, None), ("near", "nearest_park_m", 0.40, 2000)),
    "walkability_proxy_score": (
        ("as is", "amenity_density_score", 0.50, None),
        ("as is", "green_access_score", 0.25, None),
        ("near", "nearest_bus_stop_m", 0.25, 1500),
    ),
    "transport_access_score": (
        ("density", "bus_stops_per_km2", 0.35, None),
        ("near", "nearest_bus_stop_m", 0.35, 1500),
        ("near", "nearest_train_station_m", 0.30, 3500),
    ),
    "education_access_score": (("density", "schools_per_km2", 0.45, None), ("near", "nearest_school_m", 0.55, 2500)),
    "health_access_score": (("density", "health_points_per_km2", 0.40, None), ("near", "nearest_health_center_m", 0.60, 3000)),
    "flood_penalty_score": (("near", "distance_to_waterway_m", 1.0, 1200),),
    "environmental_penalty_score": (
        ("near", "distance_to_externality_m", 0.70, 1000),
        ("density", "industrial_area_pct", 0.30, None),
    ),
}
OFFICIAL_WEIGHTS = {
    "education_access_score": (("density", "schools_per_km2", 0.45, None), ("near", "nearest_school_m", 0.55, 2500)),
    "health_access_score": (
        ("density", "health_points_per_km2", 0.30, None),
        ("near", "nearest_health_center_m", 0.45, 3000),
        ("near", "nearest_hospital_m", 0.25, 5000),
    ),
    "transport_access_score": (
        ("density", "official_bus_lines_count", 0.40, None),
        ("near", "nearest_official_bus_route_m", 0.25, 1200),
        ("density", "sube_points_count", 0.20, None),
        ("near", "nearest_sube_point_m", 0.15, 2500),
    ),
}
OVERALL_WEIGHTS = {
    "base": (
        ("security_infrastructure_score", 0.15),
        ("transport_access_score", 0.20),
        ("education_access_score", 0.15),
        ("health_access_score", 0.10),
        ("amenity_density_score", 0.15),
        ("green_access_score", 0.10),
        ("-flood_penalty_score", 0.10),
        ("-environmental_penalty_score", 0.05),
    ),
    "official": (
        ("security_infrastructure_score", 0.13),
        ("transport_access_score", 0.18),
        ("education_access_score", 0.14),
        ("health_access_score", 0.10),
        ("amenity_density_score", 0.12),
        ("green_access_score", 0.08),
        ("-flood_penalty_score", 0.12),
        ("-environmental_penalty_score", 0.05),
        ("-urban_informality_score", 0.08),
    ),
}
# Flood wording in the order it is tested; the first contained key wins.
FLOOD_LEVELS = (("muy baja a nula", 5), ("baja", 25), ("media", 50), ("alta", 75), ("muy alta", 100))


def _components(spec: Sequence[tuple]) -> list[tuple[Column, float]]:
    out = []
    for kind, column, weight, cap in spec:
        value = {"density": lambda: F.col(f"n_{column}"), "near": lambda: norm_inverse_distance(column, cap), "as is": lambda: F.col(column)}[kind]()
        out.append((value, weight))
    return out


def _scores(df: DataFrame, weights: Mapping[str, Sequence[tuple]]) -> DataFrame:
    scaled = list(dict.fromkeys(c for spec in weights.values() for kind, c, _w, _cap in spec if kind == "density"))
    df = min_max(df, scaled)
    for name, spec in weights.items():
        df = df.withColumn(name, weighted_score(_components(spec)))
    return df.drop(*[f"n_{c}" for c in scaled])


def security_infrastructure(df: DataFrame) -> DataFrame:
    df = _scores(df, {"security_infrastructure_score": SECURITY_WEIGHTS})
    return df.withColumn("security_level", classify_level("security_infrastructure_score"))


def poi_scores(df: DataFrame) -> DataFrame:
    return _scores(df, POI_WEIGHTS)


def official_scores(df: DataFrame) -> DataFrame:
    return _scores(df, OFFICIAL_WEIGHTS)


def settlement_penalty(overlap_m2: Column, zone_m2: Column, nearest_m: Column) -> Column:
    share = F.least(F.lit(100.0), overlap_m2 / F.greatest(zone_m2, F.lit(1.0)) * 1000)
    return weighted_score([(share, 0.60), (norm_inverse_distance(nearest_m, 1500), 0.40)])


def overall_value(df: DataFrame, model: str = "official") -> DataFrame:
    """Overall score, level, number of known components and data confidence."""
    pairs = []
    for name, weight in OVERALL_WEIGHTS[model]:
        value = F.col(name.removeprefix("-")).cast("double")
        pairs.append((F.lit(100.0) - value if name.startswith("-") else value, weight))
    used = F.size(F.filter(F.array(*[v for v, _ in pairs]), lambda v: v.isNotNull()))
    confidence = F.when(used >= 6, "medium_high").when(used >= 4, "medium").when(used >= 2, "low").otherwise("very_low")
    df = df.withColumns({"overall_score": weighted_score(pairs), "sources_count": used, "data_confidence": confidence})
    return df.withColumn("value_level", classify_level("overall_score"))


def flood_level_value(c: Column | str) -> Column:
    text = fold_plain(c)
    out = None
    for words, value in FLOOD_LEVELS:
        out = F.when(text.contains(words), value) if out is None else out.when(text.contains(words), value)
    return out.otherwise(0)


def area_weighted_score(overlaps: DataFrame, key: str = "zone") -> DataFrame:
    """Overlap rows (zone, area, score, zone_area) to the flood summary of each zone."""
    area, score = F.col("area"), F.col("score")
    agg = overlaps.groupBy(key).agg(
        F.sum("area").alias("a"),
        F.sum(area * score).alias("w"),
        F.sum(F.when(score >= 50, area).otherwise(0.0)).alias("high"),
        F.max("score").alias("top"),
        F.max("zone_area").alias("zone_area"),
    )
    weighted = F.try_divide(F.col("w"), F.nullif("a", F.lit(0.0)))
    return agg.select(
        key,
        round_stat("a").alias("overlap_m2"),
        round_stat(F.col("a") / F.col("zone_area") * 100, 4).alias("overlap_pct"),
        round_stat("high").alias("high_m2"),
        (F.col("a") > 0).alias("in_flood_risk_zone"),
        round_stat(weighted).alias("flood_penalty_score"),
        classify_level(weighted).alias("flood_risk_level"),
        F.nullif("top", F.lit(0)).alias("max_score"),
    )


def apportioned_sum(overlaps: DataFrame, amount: str, key: str = "zone") -> DataFrame:
    share = F.least(F.lit(1.0), F.col("area") / F.col("source_area"))
    return overlaps.groupBy(key).agg(round_stat(F.sum(F.coalesce(F.col(amount), F.lit(0.0)) * share)).alias("total"))


def route_lines(df: DataFrame, key: str = "zone", line: str = "line", top: int = 30) -> DataFrame:
    """Routes and distinct lines per zone with the first names joined; lines are made distinct before grouping, and only
    the first ``top`` are gathered (the rank limit applies before the shuffle)."""
    routes = df.groupBy(key).agg(F.count(F.lit(1)).alias("routes"))
    lines = df.filter(F.coalesce(F.col(line), F.lit("")) != "").select(key, line).distinct()
    counts = lines.groupBy(key).agg(F.count(F.lit(1)).alias("lines"))
    first = lines.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(line))).filter(F.col("_rank") <= top)
    names = first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("line_names"))
    return routes.join(counts, key, "left").join(names, key, "left").select(
        key, "routes", F.coalesce("lines", F.lit(0).cast("bigint")).alias("lines"), F.coalesce("line_names", F.lit("")).alias("line_names")
    )


def infrastructure_by_zone(points: DataFrame, zones: DataFrame, types: Sequence[str], key: str = "zone") -> DataFrame:
    """Counts and densities of point types per zone, zeros filled."""
    counts = points.groupBy(key).pivot("point_type", list(types)).count()
    out = zones.join(counts, key, "left")
    zero = F.lit(0).cast("bigint")
    cols = []
    for t in types:
        n = F.coalesce(F.col(t), zero)
        cols += [n.alias(f"{t}_count"), F.when(F.col("area_km2") > 0, round_stat(n / F.col("area_km2"), 4)).alias(f"{t}_per_km2")]
    return out.select(key, "area_km2", *cols)


def parcel_metrics(parcels: DataFrame, zones: DataFrame, key: str = "zone") -> DataFrame:
    from casagrid.operators.quantiles import percentiles

    moments = parcels.groupBy(key).agg(F.count(F.lit(1)).alias("parcels"), round_stat(F.avg("area"), 4).alias("mean_area"))
    q = percentiles(parcels, [key], "area", {"median_area": 0.5, "p25_area": 0.25, "p75_area": 0.75}).drop("total")
    q = q.select(key, *[round_stat(c, 4).alias(c) for c in ("median_area", "p25_area", "p75_area")])
    out = zones.join(moments, key, "left").join(q, key, "left")
    n = F.coalesce("parcels", F.lit(0).cast("bigint"))
    return out.select(key, n.alias("parcels"), round_stat(n / F.col("area_km2"), 4).alias("parcels_per_km2"), "mean_area", "median_area", "p25_area", "p75_area")


# Point-of-interest buckets and the tags that select them.
COMMERCIAL_AMENITIES = ("atm", "bank", "cafe", "fast_food", "fuel", "pharmacy", "restaurant")
COMMERCIAL_SHOPS = ("bakery", "convenience", "greengrocer", "supermarket")
SCHOOLS = ("college", "kindergarten", "school", "university")
HEALTH = ("clinic", "dentist", "doctors", "hospital", "pharmacy")
GREEN_LEISURE = ("garden", "park", "pitch", "recreation_ground", "sports_centre")
GREEN_LANDUSE = ("grass", "recreation_ground")
MAJOR_ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary")
RAILS = ("rail", "light_rail", "subway", "tram")
STATIONS = ("station", "halt", "tram_stop")
PLATFORMS = ("platform", "stop_position")
NUISANCES = ("fuel", "recycling", "waste_transfer_station")
TAGS = ("amenity", "shop", "leisure", "landuse", "highway", "railway", "waterway", "public_transport")


def poi_buckets(tags: Mapping[str, Column]) -> Column:
    """Names of all buckets a feature belongs to; one feature may be routed to several."""
    tag = {k: tags.get(k, F.lit(None).cast("string")) for k in TAGS}
    has_water = F.coalesce(tag["waterway"], F.lit("")) != ""
    tests = {
        "amenities": tag["amenity"].isin(*COMMERCIAL_AMENITIES, *SCHOOLS, *HEALTH) | tag["shop"].isin(*COMMERCIAL_SHOPS),
        "education_points": tag["amenity"].isin(*SCHOOLS),
        "health_points": tag["amenity"].isin(*HEALTH),
        "green_spaces": tag["leisure"].isin(*GREEN_LEISURE) | tag["landuse"].isin(*GREEN_LANDUSE),
        "transport_stops": (tag["highway"] == "bus_stop") | tag["public_transport"].isin(*PLATFORMS) | tag["railway"].isin(*STATIONS),
        "transport_routes": tag["railway"].isin(*RAILS),
        "waterways": has_water,
        "externalities": tag["highway"].isin(*MAJOR_ROADS)
        | tag["railway"].isin(*RAILS)
        | (tag["landuse"] == "industrial")
        | tag["amenity"].isin(*NUISANCES)
        | has_water,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))


def poi_by_zone(points: DataFrame, zones: DataFrame, buckets: Sequence[str], key: str = "zone") -> DataFrame:
    counts = points.groupBy(key).agg(*[F.count_if(F.array_contains("buckets", b)).alias(b) for b in buckets])
    zero = F.lit(0).cast("bigint")
    return zones.join(counts, key, "left").select(
        key,
        *[F.coalesce(b, zero).alias(f"{b}_count") for b in buckets],
        *[round_stat(F.coalesce(b, zero) / F.col("area_km2"), 4).alias(f"{b}_per_km2") for b in buckets],
    )


def integrate_layers(zones: DataFrame, layers: Sequence[DataFrame], key: str = "zone") -> DataFrame:
    """Chain of left joins in which a later layer's fields replace earlier ones wherever it has the zone."""
    out = zones
    for i, layer in enumerate(layers):
        mark = f"_has{i}"
        fields = [c for c in layer.columns if c != key]
        renamed = layer.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias(mark))
        out = out.join(renamed, key, "left")
        for c in fields:
            old = F.col(c) if c in out.columns else F.lit(None)
            out = out.withColumn(c, F.when(F.col(mark), F.col(f"_new_{c}")).otherwise(old))
        out = out.drop(mark, *[f"_new_{c}" for c in fields])
    return out


def at_pins(places: DataFrame, *found: DataFrame) -> DataFrame:
    """``places`` with what was found for their pins; every frame of ``found`` has one row per pin."""
    out = places
    for frame in found:
        plain = frame.select(F.col("pin.latitude").alias("latitude"), F.col("pin.longitude").alias("longitude"), *[c for c in frame.columns if c not in ("pin", "latitude", "longitude")])
        out = out.join(plain, ["latitude", "longitude"], "left")
    return out


# Fixed value: how far a zone that is only a point reaches.
POINT_ZONE_M = 250.0


def score_security(
    places: DataFrame, zones: DataFrame, points: DataFrame, key: str = "property_id", radius_m: float = 500.0, point_zones: DataFrame | None = None, facts: Sequence[str] = (), nearest: int = 8
) -> DataFrame:
    """Best zone of each property, its risk and level, and the evidence around it.

    Zones are polygons, and points (``point_zones``: feature_idx, zone, score, level, the facts, latitude, longitude) that
    reach ``POINT_ZONE_M``; the highest score wins, then the earlier feature. Evidence: ``facts`` of the zone,
    ``points_nearby``, ``points_by_type`` (map; points without a type are ``otro``) and ``nearest`` points, nearest first.
    Everything is looked up for distinct pins. Nearest points are a rank within the pin whose limit applies before the
    shuffle, so each task hands on no more than ``nearest`` points of a pin.
    """
    pins = pins_of(places)
    keep = ["feature_idx", "score", "zone", "level", *facts]
    pairs = candidates(pins, zones).filter("covers").select("pin", *keep)
    if point_zones is not None:
        pairs = pairs.unionByName(radius_pairs(pins, point_zones, POINT_ZONE_M).select("pin", *keep))
    best = pick(pairs, "pin", [F.coalesce(F.col("score"), F.lit(-1.0)), -F.col("feature_idx")], ["score", "zone", "level", *facts], smallest=False)
    typed = points.withColumn("point_type", F.coalesce(non_empty("point_type"), F.lit("otro")))
    counts, near = nearby_points(pins, typed, "pin", radius_m, nearest)
    entries = F.array_sort(F.collect_list(F.struct("point_type", "n")))
    around = counts.groupBy("pin").agg(F.sum("n").alias("points_nearby"), F.map_from_entries(entries).alias("points_by_type"))
    out = at_pins(places, best, around, near.select("pin", "nearest"))
    return out.select(
        key,
        clamp_score("score").alias("coverage_score"),
        risk_from_coverage("score").alias("risk_score"),
        F.coalesce(non_empty("level"), F.when(F.col("zone").isNotNull(), security_level("score")), F.lit("")).alias("security_level"),
        F.coalesce("zone", F.lit("")).alias("zone_label"),
        *facts,
        F.coalesce("points_nearby", F.lit(0).cast("bigint")).alias("points_nearby"),
        "points_by_type",
        "nearest",
    )


def name_match(places: DataFrame, zones: DataFrame, key: str, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First zone in file order whose folded name equals one of a property's names."""
    names = F.array_distinct(F.filter(F.array(*[fold_plain(F.btrim(F.coalesce(F.col(c), F.lit("")))) for c in columns]), lambda n: n != ""))
    asked = places.select(key, F.explode(names).alias("_name"))
    keyed = zones.groupBy(fold_plain(F.btrim(F.col("zone"))).alias("_name")).agg(F.min(F.struct(F.col("feature_idx").alias("_i"), *keep)).alias("_z"))
    best = asked.join(keyed, "_name").groupBy(key).agg(F.min("_z").alias("_z"))
    return best.select(key, *[F.col(f"_z.{c}").alias(c) for c in keep])


def flood_matches(pins: DataFrame, floods: DataFrame, zoned: DataFrame, top: int = 3) -> DataFrame:
    """Flood areas that cover each pin: their number, greatest risk and the ``top`` by risk.

    Where any flood area is assigned to the zone of the pin (``zoned``: pin, zone), only those of that zone count.
    """
    own = fold_plain(F.btrim(F.coalesce("assigned_zone", F.lit(""))))
    named = floods.filter(own != "").select(own.alias("_zone")).distinct().withColumn("_zoned", F.lit(True))
    wanted = zoned.select("pin", fold_plain(F.btrim("zone")).alias("_zone")).join(named, "_zone").select("pin", F.col("_zone").alias("_only"))
    # Areas of one shape and zone meet the pins once, with their number, greatest risk and first ``top``.
    shape = ["rings", "_own"]
    by_risk = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.coalesce("risk_score", F.lit(0.0))), "feature_idx"))
    floods = floods.withColumn("_own", own)
    heads = floods.withColumn("_rank", by_risk(*shape)).filter(F.col("_rank") <= top).groupBy(*shape).agg(F.collect_list(F.struct("feature_idx", "risk_score")).alias("_heads"))
    shapes = floods.groupBy(*shape).agg(F.max("risk_score").alias("_greatest"), F.count(F.lit(1)).alias("_areas")).join(heads, shape)
    hits = candidates(pins, shapes).filter("covers").join(wanted, "pin", "left").filter(F.col("_only").isNull() | (F.col("_own") == F.col("_only")))
    ranked = hits.select("pin", F.inline("_heads")).withColumn("_rank", by_risk("pin"))
    listed = ranked.filter(F.col("_rank") <= top).groupBy("pin").agg(F.array_sort(F.collect_list(F.struct("_rank", "feature_idx", "risk_score"))).alias("_l"))
    totals = hits.groupBy("pin").agg(F.max("_greatest").alias("flood_risk"), F.sum("_areas").alias("flood_matches"))
    return totals.join(listed.select("pin", F.transform("_l", lambda x: F.struct(x["feature_idx"].alias("feature_idx"), x["risk_score"].alias("risk_score"))).alias("flood_list")), "pin")


def score_location(
    places: DataFrame, zones: DataFrame, floods: DataFrame, settlements: DataFrame, names: Sequence[str], key: str = "property_id", components: Mapping[str, str] | None = None
) -> DataFrame:
    """Zone by coordinates, else by name; flood areas and the nearest settlement of those found by coordinates.

    ``components`` names the zone's component scores by result column; each is clamped to 0 to 100. Distinct pins are
    looked up once in each layer, and floods and settlements only for pins inside a zone.
    """
    parts = dict(components or {})
    keep = ["zone", "score", "level", *parts.values()]
    # Written once: four steps read it, and the driver would hold and plan the way to it in each of them.
    ensure_checkpoint_dir(places.sparkSession)
    zoned = first_covering(pins_of(places), zones, "pin", keep).checkpoint()
    inside = zoned.select("pin", "pin.latitude", "pin.longitude")
    flood = flood_matches(inside, floods, zoned)
    near = nearest_feature(inside, settlements, "pin", ["settlement"], 1000.0)
    on_pin = F.lit("coordinates").alias("match_method")
    by_point = at_pins(places, zoned.select("*", on_pin), flood, near)
    # Whom no pin places is known before floods and settlements are looked up.
    unplaced = at_pins(places, zoned.select("pin", on_pin)).filter("match_method is null")
    by_name = name_match(unplaced.select(key, *names), zones, key, names, keep).select(key, F.struct(*keep).alias("_named"))
    out = join_rows(by_point, by_name, key, "left")
    on_point = F.col("match_method").isNotNull()
    pick_of = lambda c: F.when(on_point, F.col(c)).otherwise(F.col(f"_named.{c}"))
    zone = pick_of("zone")
    return out.select(
        key,
        F.coalesce("match_method", F.when(F.col("_named").isNotNull(), "zone"), F.lit("")).alias("match_method"),
        F.coalesce(zone, F.lit("")).alias("zone_name"),
        clamp_score(pick_of("score")).alias("overall_score"),
        F.when(zone.isNotNull(), location_level(pick_of("score"), pick_of("level"))).otherwise("").alias("value_level"),
        *[clamp_score(pick_of(c)).alias(name) for name, c in parts.items()],
        "flood_risk",
        "flood_matches",
        "flood_list",
        F.round("distance_m", 1).alias("settlement_m"),
        "settlement",
    )


def resolve_coordinates(df: DataFrame, cache: DataFrame) -> DataFrame:
    """Coordinates of each property by tiers: its pin, what its text told, the first cached one of its ``candidates``.

    Adds coordinate_source, geocode_query and geocoding_status: ``not_needed``, ``no_query``, ``cache_hit`` (the query
    itself is in the cache), ``cache_applied`` (only a later candidate is) and ``cache_miss``. Only properties without
    coordinates ask the cache, and each distinct list of candidates asks once.
    """
    f = F.col
    pinned = f("latitude").isNotNull() & f("longitude").isNotNull()
    told = f("detected_latitude").isNotNull() & f("detected_longitude").isNotNull()
    asked = df.filter(~pinned & ~told & (F.size("candidates") > 0)).select("candidates").distinct()
    found = from_cache(asked, cache, "candidates").select("candidates", f("latitude").alias("_lat"), f("longitude").alias("_lon"), f("query").alias("_query"))
    first = asked.withColumn("query", f("candidates")[0]).join(cache.select("query").distinct(), "query", "left_semi").select("candidates", F.lit(True).alias("_known"))
    out = df.join(found, "candidates", "left").join(first, "candidates", "left")
    cached = ~pinned & ~told & f("_lat").isNotNull()
    source = F.when(pinned, F.when(F.coalesce("manually_corrected", F.lit(False)), "manual_location").otherwise("location")).when(told, "detected_coordinates").when(cached, "geocode_cache").otherwise("")
    status = (
        F.when(pinned | told, "not_needed").when(F.coalesce(F.size("candidates"), F.lit(0)) < 1, "no_query").when(~cached, "cache_miss").when(f("_known"), "cache_hit").otherwise("cache_applied")
    )
    lat = F.when(pinned, f("latitude")).when(told, f("detected_latitude")).when(cached, f("_lat"))
    lon = F.when(pinned, f("longitude")).when(told, f("detected_longitude")).when(cached, f("_lon"))
    return out.withColumns({"coordinate_source": source, "geocoding_status": status, "geocode_query": F.when(cached, f("_query")), "latitude": lat, "longitude": lon}).drop("_lat", "_lon", "_query", "_known")


def infer_zone(df: DataFrame, zones: DataFrame, max_m: float = 800.0, key: str = "property_id") -> DataFrame:
    """Zone by polygon, else nearest within the limit; ``df`` carries what :func:`resolve_coordinates` gives and source_zone."""
    hit = covering_or_nearest(pins_of(df), zones, "pin", ["zone"], max_m)
    out = at_pins(df, hit)
    method = (
        F.when(F.col("latitude").isNull(), "no_coordinates")
        .when(F.col("zone").isNull(), F.concat(F.col("coordinate_source"), F.lit("_no_match")))
        .otherwise(F.concat_ws("_", "coordinate_source", "match"))
    )
    zone = F.coalesce("zone", F.lit(""))
    return out.select(
        key,
        zone.alias("inferred_zone"),
        method.alias("method"),
        F.round("distance_m", 2).alias("distance_m"),
        ((F.coalesce("source_zone", F.lit("")) != "") & (zone != "") & (F.col("source_zone") != zone)).alias("zone_conflict"),
        F.col("zone").isNull().alias("needs_review"),
        "coordinate_source",
        "geocoding_status",
        "geocode_query",
    )


def zone_report(inferred: DataFrame) -> DataFrame:
    f = F.col
    return inferred.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(f("inferred_zone") != "").alias("inferred"),
        F.count_if(f("method").endswith("_polygon")).alias("strict_polygon"),
        F.count_if(f("method").endswith("_nearest")).alias("nearest_fallback"),
        F.count_if("zone_conflict").alias("conflicts"),
        F.count_if("needs_review").alias("needs_review"),
        F.count_if(f("method") == "no_coordinates").alias("no_data"),
        F.count_if(f("method").startswith("geocode_cache")).alias("from_cache"),
    )


def infer_territory(df: DataFrame, municipalities: DataFrame, localities: DataFrame, zones: DataFrame, key: str = "property_id", near_m: float = 2000.0) -> DataFrame:
    """Municipality, locality and zone of each property, with confidence and method of the finest level found.

    Each layer carries zone, confidence, source_method and needs_manual_review. ``review_reasons`` lists why a row needs
    review; the nearest zone, a hint for the reviewer, is looked for within ``near_m``.
    """
    keep = ["zone", "confidence", "source_method", "needs_manual_review"]
    pins = pins_of(df)
    found = []
    for name, layer in (("p", municipalities), ("l", localities), ("z", zones)):
        hit = first_covering(pins, layer, "pin", keep)
        found.append(hit.select("pin", *[F.col(c).alias(f"{name}_{c}") for c in keep]))
    near = nearest_feature(pins, zones, "pin", ["zone"], near_m).select("pin", F.col("zone").alias("nearest_zone"), F.col("distance_m").alias("nearest_m"))
    out = at_pins(df, *found, near)
    f = F.col

    def conflict(source: str, name: str) -> Column:
        a, b = F.coalesce(f(source), F.lit("")), F.coalesce(f(name), F.lit(""))
        return (a != "") & (b != "") & (a != b)

    # Fixed order of the reasons.
    reasons = {
        "no_municipality": f("p_zone").isNull(), "no_locality": f("l_zone").isNull(), "no_zone": f("z_zone").isNull(), "manual_review": F.coalesce(f("z_needs_manual_review"), F.lit(False)),
        "zone_conflict": conflict("source_zone", "z_zone"), "locality_conflict": conflict("source_locality", "l_zone"),
    }
    why = F.when(f("latitude").isNull() | f("longitude").isNull(), F.array(F.lit("no_coordinates"))).otherwise(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in reasons.items()])))
    finest = lambda c: F.when(f("z_zone").isNotNull(), f(f"z_{c}")).when(f("l_zone").isNotNull(), f(f"l_{c}")).otherwise(F.coalesce(f"p_{c}", F.lit("")))
    return out.select(
        key,
        F.coalesce("p_zone", F.lit("")).alias("municipality"),
        F.coalesce("l_zone", F.lit("")).alias("locality"),
        F.coalesce("z_zone", F.lit("")).alias("zone"),
        finest("confidence").alias("confidence"),
        finest("source_method").alias("source_method"),
        (F.size(why) > 0).alias("needs_review"),
        why.alias("review_reasons"),
        "nearest_zone",
        F.round("nearest_m", 2).alias("nearest_m"),
    )


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose stored values differ from fresh ones: what a backfill has to write."""
    b = before.select(key, *[F.col(c).alias(f"old_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return join_rows(after.select(key, *columns), b, key).filter(differs)
