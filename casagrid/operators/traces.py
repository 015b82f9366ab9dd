"""GPS traces: steps, acceptance, sampling, heading, encounters, alerts, trip checks and simplification.

Rules whose state is the last *accepted* point are scanned in order by a small Python step, over
segments that Spark cuts where the outcome cannot depend on what came before, so one very long session is
spread over tasks. Rows stream through a task in Arrow batches; no group is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casagrid.functions.geo import EARTH_M, TRIP_EARTH_M, bearing, haversine_m, relative_direction
from casagrid.operators import trace_rules as R
from casagrid.operators.spatial import radius_pairs
from casagrid.operators.trace_rules import CONTINUITY_MS, MAX_ACCURACY_M, MAX_SPEED_KMH, MIN_DISTANCE_M, QUERY_IDLE_MS
from casagrid.operators.windows import previous_row, running_sum
from casagrid.session import ensure_checkpoint_dir

# Limits of the drive mode.
ALERT_M, CLOSE_M, SUSPICIOUS_GROUP, MAX_NEARBY = 120.0, 120.0, 5, 250
MAX_TRIP_MS, MAX_TRIP_M, MAX_TRIP_POINTS = 7 * 86400 * 1000, 2_000_000.0, 1500
DAY_MS = 86_400_000
# Stretches of a trace up to this length are simplified in one task; longer ones are split over tasks first.
STRETCH_POINTS = 20_000
# A stretch with more points on the rims of its blocks is not split by these in one task, and after so many distances
# a task leaves the parts that are still long to the next round.
RIM_POINTS, MAX_DISTANCES = 500_000, 2e9


def usable_positions(df: DataFrame, now: str = "now_ms", max_age_ms: int = 10000) -> DataFrame:
    age = F.col(now) - F.col("ts_ms")
    return df.filter((F.col("accuracy") <= MAX_ACCURACY_M) & (age >= -1000) & (age <= max_age_ms) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("_day", F.floor(F.col("ts_ms") / DAY_MS))


def trace_steps(df: DataFrame) -> DataFrame:
    """Distance, elapsed time and speed since the point before, and the distance so far."""
    order = ["ts_ms", "event_id"]
    rows = previous_row(with_day(df), ["session_id"], "_day", order, ["ts_ms", "latitude", "longitude"])
    step = F.coalesce(haversine_m("prev_latitude", "prev_longitude", "latitude", "longitude", TRIP_EARTH_M), F.lit(0.0))
    rows = rows.withColumns({"step_m": step, "elapsed_s": (F.col("ts_ms") - F.col("prev_ts_ms")) / 1000})
    rows = rows.withColumn("speed_kmh", F.try_divide(F.col("step_m"), F.nullif("elapsed_s", F.lit(0.0))) * 3.6)
    return running_sum(rows, ["session_id"], "_day", order, F.col("step_m"), "total_m").drop("_day")


def scan_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], rule: R.Rule, schema: str, needs: Sequence[str], apart: Sequence[str] = ()) -> DataFrame:
    """Runs a rule of ``trace_rules`` over each key in order; ``schema`` names key and carried columns and the rule's.

    Partitions are sorted and only the columns in ``needs`` travel; a key's rows meet the rule in Arrow batches, so only
    the running state of one key is in memory. Rows of a key that differ in ``apart`` may go to different tasks, each of
    which goes on from the state of those it has; that is for rules whose state does not matter where these change.
    """
    keys, order = list(keys), list(order)
    names = [f.split()[0] for f in schema.split(",")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            mark = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
            begins = np.flatnonzero(mark).tolist()
            for lo, hi in zip(begins, [*begins[1:], len(batch)], strict=True):
                frame = batch.iloc[lo:hi]
                key = tuple(frame.iloc[0][keys])
                if key != current:
                    current, state = key, None
                state, columns = rule(state, frame)
                keep = columns.pop("_out", None)
                out = frame.assign(**columns)
                yield (out if keep is None else out[keep])[names]

    columns = list(dict.fromkeys([*keys, *apart, *order, *needs]))
    return df.select(*columns).repartition(*[F.col(k) for k in (*keys, *apart)]).sortWithinPartitions(*keys, *order).mapInPandas(scan, schema)


ACCEPT_SCHEMA = "session_id long, segment long, event_id long, ts_ms long, latitude double, longitude double, accepted boolean, distance_m double, reason string"


def accept_trace_points(df: DataFrame) -> DataFrame:
    """Keep or reject every point of a trace with its reason.

    A point that comes at least 30 s after the one before, and so long after it that no point of the
    session could be a jump, is accepted whatever was accepted earlier: segments start there.
    """
    order = ["ts_ms", "event_id"]
    why = F.when(F.col("latitude").isNull() | F.col("longitude").isNull() | F.isnan("latitude") | F.isnan("longitude"), "invalid")
    why = why.when(~F.coalesce(F.col("accuracy") <= MAX_ACCURACY_M, F.lit(False)), "accuracy").when(F.col("ts_ms").isNull(), "timestamp")
    usable = why.isNull()
    bad = df.filter(~usable).select("session_id", "event_id", "ts_ms", F.lit(False).alias("accepted"), F.lit(0.0).alias("distance_m"), why.alias("reason"))
    good = with_day(df.filter(usable))
    box = good.groupBy("session_id").agg(
        F.min("latitude").alias("_s"), F.max("latitude").alias("_n"), F.min("longitude").alias("_w"), F.max("longitude").alias("_e")
    )
    # Both sides of the box at its widest parallel bound every distance inside it.
    span = (haversine_m("_s", "_w", "_n", "_w") + F.radians(F.col("_e") - F.col("_w")) * F.lit(EARTH_M)) * 1.001
    calm = F.greatest(F.lit(float(CONTINUITY_MS)), span / F.lit(MAX_SPEED_KMH / 3.6) * 1000)
    rows = previous_row(good, ["session_id"], "_day", order, ["ts_ms"]).join(box.select("session_id", calm.alias("_calm")), "session_id")
    cut = F.coalesce((F.col("ts_ms") - F.col("prev_ts_ms")) >= F.col("_calm"), F.lit(True)).cast("long")
    rows = running_sum(rows, ["session_id"], "_day", order, cut, "segment")
    slim = rows.select("session_id", "segment", "event_id", "ts_ms", "latitude", "longitude", "accuracy")
    out = scan_sorted(slim, ["session_id", "segment"], order, R.accept_rule, ACCEPT_SCHEMA, ["latitude", "longitude", "accuracy"])
    # The head of a later segment is compared with the last point accepted in the segment before.
    tails = out.filter("accepted").groupBy("session_id", "segment").agg(F.max(F.struct("ts_ms", "event_id", "latitude", "longitude")).alias("_t"))
    tails = tails.select("session_id", (F.col("segment") + 1).alias("segment"), F.col("_t.latitude").alias("_lat"), F.col("_t.longitude").alias("_lon"))
    out = out.join(tails, ["session_id", "segment"], "left")
    head = (F.col("reason") == "first") & F.col("_lat").isNotNull()
    gap = haversine_m("_lat", "_lon", "latitude", "longitude")
    moved = gap >= MIN_DISTANCE_M
    out = out.select(
        "session_id",
        "event_id",
        "ts_ms",
        "accepted",
        F.when(head, F.when(moved, gap).otherwise(0.0)).otherwise(F.col("distance_m")).alias("distance_m"),
        F.when(head, F.when(moved, "movement").otherwise("continuity")).otherwise(F.col("reason")).alias("reason"),
    )
    return out.unionByName(bad)


def sample_positions(df: DataFrame) -> DataFrame:
    """Positions to query from. After 15 s of silence a position is always emitted, so segments start there.

    Segments of a session that meet in a task are worked as one run: most are a few rows long.
    """
    order = ["ts_ms", "event_id"]
    rows = previous_row(with_day(df), ["session_id"], "_day", order, ["ts_ms"])
    cut = F.coalesce((F.col("ts_ms") - F.col("prev_ts_ms")) >= QUERY_IDLE_MS, F.lit(True)).cast("long")
    rows = running_sum(rows, ["session_id"], "_day", order, cut, "segment")
    slim = rows.select("session_id", "segment", "event_id", "ts_ms", "latitude", "longitude")
    schema = "session_id long, event_id long, ts_ms long, latitude double, longitude double"
    return scan_sorted(slim, ["session_id"], order, R.sample_rule, schema, ["latitude", "longitude"], ["segment"])


def track_heading(df: DataFrame) -> DataFrame:
    """Heading, motion flag and reason of every fix; with a ``now_ms`` column, fixes too old or ahead are ``stale``.

    The smoothed heading has no point where it forgets, so a session is one sorted stream.
    """
    schema = "session_id long, event_id long, camera_heading double, moving boolean, reason string"
    needs = [c for c in ("latitude", "longitude", "accuracy", "speed", "heading", "now_ms") if c in df.columns]
    out = scan_sorted(df, ["session_id"], ["ts_ms", "event_id"], R.heading_rule, schema, needs)
    return out.withColumn("camera_heading", F.nanvl("camera_heading", F.lit(None).cast("double")))


def property_groups(properties: DataFrame) -> DataFrame:
    """Properties that share a coordinate: identity, position, size and whether it is a default pin."""
    spot = F.concat_ws(",", F.format_string("%.6f", F.col("latitude")), F.format_string("%.6f", F.col("longitude")))
    rows = properties.filter(F.col("latitude").isNotNull()).withColumn("group_id", spot)
    return rows.groupBy("group_id").agg(
        F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"), F.count(F.lit(1)).alias("group_count"), F.min("property_id").alias("first_property")
    )


def accumulate_encounters(positions: DataFrame, properties: DataFrame, radius_m: float = 350.0, most_properties: int | None = None) -> DataFrame:
    """Per trip and coordinate group: first seen, least distance, and how many of its properties the trip holds.

    Repeated positions of a trip and properties at one spot are collapsed before they meet. ``most_properties`` ends a
    trip's list at so many properties, groups entering in the order they are first seen; without it nothing is cut.
    """
    stops = positions.groupBy("session_id", "latitude", "longitude").agg(F.min("ts_ms").alias("ts_ms"))
    pairs = radius_pairs(stops, property_groups(properties), radius_m)
    met = pairs.groupBy("session_id", "group_id", "group_count").agg(F.min("ts_ms").alias("first_seen"), F.min(F.round("distance_m").cast("bigint")).alias("min_distance_m"))
    if most_properties is None:
        return met.withColumn("kept_properties", F.col("group_count"))
    w = Window.partitionBy("session_id").orderBy("first_seen", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.lit(most_properties) - F.coalesce(F.sum("group_count").over(w), F.lit(0)))
    return met.withColumn("kept_properties", F.least("group_count", room)).filter("kept_properties > 0")


def trip_properties(encounters: DataFrame, properties: DataFrame, favorites: DataFrame) -> DataFrame:
    """Properties met on a trip with the marks the trip lists filter by."""
    spot = F.concat_ws(",", F.format_string("%.6f", F.col("latitude")), F.format_string("%.6f", F.col("longitude")))
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("property_id"))
    ids = properties.filter(F.col("latitude").isNotNull()).select("property_id", spot.alias("group_id"))
    # A group that entered in part is met by its first properties only.
    part = encounters.filter("kept_properties < group_count")
    ids_of_part = ids.join(part.select("group_id").distinct(), "group_id", "left_semi").withColumn("place", place)
    some = part.join(ids_of_part, "group_id").filter("place <= kept_properties").drop("place")
    rows = encounters.filter("kept_properties = group_count").join(ids, "group_id").unionByName(some).withColumn("favorite", F.lit(False))
    liked = favorites.select("session_id", "property_id").distinct().withColumn("_liked", F.lit(True))
    out = rows.join(liked, ["session_id", "property_id"], "full_outer")
    return out.select(
        "session_id",
        "property_id",
        F.coalesce("group_id", F.concat(F.lit("property-"), F.col("property_id").cast("string"))).alias("group_id"),
        "first_seen",
        "min_distance_m",
        F.coalesce(F.col("min_distance_m") <= CLOSE_M, F.lit(False)).alias("passed_close"),
        F.col("_liked").isNotNull().alias("favorite"),
        F.coalesce(F.col("group_count") >= SUSPICIOUS_GROUP, F.lit(False)).alias("suspicious"),
    )


def alert_candidates(positions: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups near each fix with direction rank; groups behind the car and default pins are left out."""
    near = radius_pairs(positions, groups.filter(F.col("group_count") < SUSPICIOUS_GROUP), ALERT_M)
    side = relative_direction("heading", "speed", bearing("latitude", "longitude", "r_latitude", "r_longitude"))
    near = near.withColumn("direction", side).filter(F.col("direction") != "detras")
    return near.withColumn("rank", F.when(F.col("direction") == "adelante", 0).otherwise(1)).select(
        "session_id", "ts_ms", "event_id", "group_id", "first_property", "rank", "direction", "distance_m"
    )


def proximity_alerts(positions: DataFrame, properties: DataFrame) -> DataFrame:
    rows = alert_candidates(positions, property_groups(properties))
    schema = "session_id long, event_id long, group_id string, direction string, distance_m double"
    order = ["ts_ms", "event_id", "rank", "distance_m", "first_property"]
    return scan_sorted(rows, ["session_id"], order, R.alert_rule, schema, ["group_id", "direction"])


def trip_check(df: DataFrame) -> DataFrame:
    """Reason why a trip is refused, empty when it is fine; plus its totals."""
    f = F.col
    rows = trace_steps(df)
    jump = f("step_m") > F.greatest(F.lit(250.0), f("elapsed_s") * 75 + 100)
    off = ~f("latitude").between(-90, 90) | ~f("longitude").between(-180, 180) | ~f("accuracy").between(0, 10000)
    agg = rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("points"),
        (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms"),
        F.sum("step_m").alias("distance_m"),
        F.bool_or(F.coalesce(off, F.lit(True))).alias("_off"),
        F.bool_or(F.coalesce(jump, F.lit(False))).alias("_jump"),
    )
    reason = (
        F.when(f("points") > MAX_TRIP_POINTS, "points")
        .when(f("duration_ms") > MAX_TRIP_MS, "duration")
        .when(f("_off"), "bounds")
        .when(f("_jump"), "jump")
        .when(f("distance_m") > MAX_TRIP_M, "distance")
        .otherwise("")
    )
    return agg.select("session_id", "points", "duration_ms", "distance_m", reason.alias("reason"))


def save_trips(saved: DataFrame, incoming: DataFrame) -> DataFrame:
    """Trips to insert: the first upload of each (owner, session) that neither exists nor was deleted."""
    key = ["owner", "session_id"]
    others = [c for c in incoming.columns if c not in key and c != "arrived"]
    first = incoming.groupBy(*key).agg(F.min(F.struct("arrived", *others)).alias("_b"))
    first = first.select(*key, "_b.arrived", *[F.col(f"_b.{c}").alias(c) for c in others])
    return first.join(saved.select(*key), key, "left_anti")


def fill_observed(observed: DataFrame, current: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Trip references with values seen on the trip kept before today's values."""
    now = current.select("property_id", *[F.col(c).alias(f"_now_{c}") for c in fields])
    out = observed.join(now, "property_id", "left")
    cols: dict[str, Column] = {}
    for c in fields:
        seen = F.col(c)
        if dict(observed.dtypes)[c] == "string":
            seen = F.nullif(seen, F.lit(""))
        cols[c] = F.coalesce(seen, F.col(f"_now_{c}"))
    return out.withColumns(cols).drop(*[f"_now_{c}" for c in fields])


def note_step(state: dict | None, row: dict) -> tuple[dict, tuple[str, int | None]]:
    """Revisioned note: a change applies on its own revision only, a repeated change is a no-op, deletion is final."""
    s = state or {"rev": None, "mutation": None, "deleted": False}
    if s["deleted"]:
        return s, ("deleted", s["rev"])
    if row["action"] == "delete":
        if s["rev"] is None:
            return s, ("ignored", None)
        return {**s, "deleted": True}, ("removed", s["rev"])
    if s["rev"] is not None and s["mutation"] == row["mutation_id"]:
        return s, ("repeated", s["rev"])
    revision = int(row["revision"])
    if s["rev"] is None and revision == 0:
        return {"rev": 1, "mutation": row["mutation_id"], "deleted": False}, ("created", 1)
    if s["rev"] is None or revision != s["rev"]:
        return s, ("conflict", s["rev"])
    return {"rev": revision + 1, "mutation": row["mutation_id"], "deleted": False}, ("updated", revision + 1)


note_step.names = ("outcome", "revision_after")


def apply_notes(mutations: DataFrame) -> DataFrame:
    schema = "note_id long, arrived long, outcome string, revision_after long"
    return scan_sorted(mutations, ["note_id"], ["arrived"], R.by_row(note_step), schema, ["action", "revision", "mutation_id"])


def trip_memory(encounters: DataFrame, deleted: DataFrame) -> DataFrame:
    return encounters.join(deleted.select("session_id"), "session_id", "left_anti").select("group_id").distinct()


def downsample(df: DataFrame, target: int = 199) -> DataFrame:
    """Every n-th point of a trace and its last one, so that at most 200 remain."""
    order = ["ts_ms", "event_id"]
    rows = running_sum(with_day(df), ["session_id"], "_day", order, F.lit(1), "place").drop("_day")
    sizes = df.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, "session_id")
    step = F.greatest(F.lit(1), F.floor((F.col("n") + target - 1) / target))
    return rows.filter((F.col("n") > 1) & (((F.col("place") - 1) % step == 0) | (F.col("place") == F.col("n"))))


def latest_trips(df: DataFrame, limit: int = 10) -> DataFrame:
    ends = df.groupBy("session_id").agg(F.max("ts_ms").alias("ended"))
    return df.join(ends.orderBy(F.desc("ended"), F.desc("session_id")).limit(limit).select("session_id"), "session_id", "left_semi")


def farthest_cuts(points: DataFrame, tolerance_m: float) -> DataFrame:
    """Both halves of each stretch at its farthest point, or the stretch itself where that is within the tolerance."""
    key = ["session_id", "lo"]
    ends = points.filter("place = lo").select(*key, "hi", F.col("x").alias("x1"), F.col("y").alias("y1"))
    ends = ends.join(points.filter("place = hi").select(*key, F.col("x").alias("x2"), F.col("y").alias("y2")), key)
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = F.coalesce(F.try_divide((F.col("x") - F.col("x1")) * wide + (F.col("y") - F.col("y1")) * high, F.nullif(wide * wide + high * high, F.lit(0.0))), F.lit(0.0))
    along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    off = F.hypot(F.col("x") - F.col("x1") - along * wide, F.col("y") - F.col("y1") - along * high)
    inner = points.filter("place > lo and place < hi").join(ends.drop("hi"), key)
    top = inner.groupBy(*key).agg(F.max(F.struct(off.alias("off"), (-F.col("place")).alias("less"))).alias("top"))
    cut = F.when(F.col("top.off") > tolerance_m, -F.col("top.less"))
    parts = ends.select(*key, "hi").join(top.select(*key, cut.alias("at")), key, "left")
    whole = F.array(F.struct(F.col("lo").alias("begins"), F.col("hi").alias("ends"), F.lit(True).alias("flat")))
    halves = F.array(
        F.struct(F.col("lo").alias("begins"), F.col("at").alias("ends"), F.lit(False).alias("flat")), F.struct(F.col("at").alias("begins"), F.col("hi").alias("ends"), F.lit(False).alias("flat"))
    )
    return parts.select(*key, F.inline(F.when(F.col("at").isNull(), whole).otherwise(halves)))


def simplify_traces(df: DataFrame, tolerance_m: float = 8.0, stretch_points: int = STRETCH_POINTS, rim_points: int = RIM_POINTS) -> DataFrame:
    """(session_id, event_id, place) of the points that stay when each stretch keeps its farthest point off the chord.

    Traces of any length. A stretch longer than ``stretch_points`` is cut into blocks; only points at the hull of a block
    can be the farthest from a chord, so one task splits the stretch by these few, as often as they settle it. A round
    does so for all such stretches. One with more than ``rim_points`` of them is split once a round by an aggregation.
    Shorter stretches no longer depend on others and are finished in one task each. Distances are on the plane at the
    trace's first latitude.
    """
    spark, order = df.sparkSession, ["ts_ms", "event_id"]
    ensure_checkpoint_dir(spark)
    rows = running_sum(with_day(df), ["session_id"], "_day", order, F.lit(1), "place").select("session_id", "event_id", "place", "latitude", "longitude")
    whole = rows.groupBy("session_id").agg(F.min(F.struct("place", "latitude")).alias("first"), F.max("place").alias("hi"))
    whole = whole.select("session_id", F.cos(F.radians("first.latitude")).alias("shrink"), F.lit(1).cast("long").alias("lo"), "hi")
    rows = rows.join(whole, "session_id")
    points = rows.select("session_id", "event_id", "place", (F.radians("longitude") * EARTH_M * F.col("shrink")).alias("x"), (F.radians("latitude") * EARTH_M).alias("y"), "lo", "hi").checkpoint()
    settled = points.filter(F.col("hi") - F.col("lo") < stretch_points)
    points = points.filter(F.col("hi") - F.col("lo") >= stretch_points)
    key, size = ["session_id", "lo"], max(2, stretch_points // 4)
    block = lambda place: F.floor((F.col(place) - F.col("lo")) / size)

    def outline(rows: pd.DataFrame) -> pd.DataFrame:
        place, at_end = rows["place"].to_numpy(), (rows["place"] == rows["lo"]) | (rows["place"] == rows["hi"])
        inner = rows[~at_end]
        stays = at_end.to_numpy(copy=True)
        stays[~stays] = R.rim(inner["x"].to_numpy(), inner["y"].to_numpy())
        return rows[stays][[*key, "block", "place", "x", "y"]].iloc[np.argsort(place[stays])]

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        parts = R.stretches(*(rows[c].to_numpy() for c in ("place", "x", "y", "block")), tolerance_m, stretch_points, MAX_DISTANCES)
        out = pd.DataFrame(parts, columns=["begins", "ends", "flat"])
        return out.assign(session_id=rows["session_id"].iloc[0], lo=rows["lo"].iloc[0])[[*key, "begins", "ends", "flat"]]

    def deal(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        """Each point with its part; one that cuts ends a part and begins the next. A flat part keeps its ends."""
        parts = parts.sort_values("begins")
        begins, ends, flat = (parts[c].to_numpy() for c in ("begins", "ends", "flat"))
        place = rows["place"].to_numpy()
        own = np.searchsorted(begins, place, "right") - 1
        cuts = np.flatnonzero((own > 0) & (begins[own] == place))
        at, own = np.r_[np.arange(len(rows)), cuts], np.r_[own, own[cuts] - 1]
        inside = (place[at] <= ends[own]) & (~flat[own] | (place[at] == begins[own]) | (place[at] == ends[own]))
        at, own = at[inside], own[inside]
        return rows.iloc[at].assign(lo=begins[own], hi=ends[own], flat=flat[own])[["session_id", "event_id", "place", "x", "y", "lo", "hi", "flat"]]

    while not points.isEmpty():
        points = points.withColumn("block", block("place"))
        rims = points.groupBy(*key, "block").applyInPandas(outline, "session_id long, lo long, block long, place long, x double, y double").checkpoint()
        dense = rims.groupBy(*key).count().filter(F.col("count") > rim_points).select(*key)
        parts = rims.join(dense, key, "left_anti").groupBy(*key).applyInPandas(split, "session_id long, lo long, begins long, ends long, flat boolean")
        parts = parts.unionByName(farthest_cuts(points.join(dense, key, "left_semi"), tolerance_m))
        parts = parts.withColumn("block", F.explode(F.sequence(block("begins"), block("ends"))))
        dealt = points.groupBy(*key, "block").cogroup(parts.groupBy(*key, "block"))
        dealt = dealt.applyInPandas(deal, "session_id long, event_id long, place long, x double, y double, lo long, hi long, flat boolean").checkpoint()
        long = ~F.col("flat") & (F.col("hi") - F.col("lo") >= stretch_points)
        settled = settled.unionByName(dealt.filter(~long).drop("flat"))
        points = dealt.filter(long).drop("flat")

    def finish(stretch: pd.DataFrame) -> pd.DataFrame:
        stretch = stretch.sort_values("place")
        return stretch[R.corners(stretch["x"].to_numpy(), stretch["y"].to_numpy(), tolerance_m)][["session_id", "event_id", "place"]]

    kept = settled.groupBy("session_id", "lo").applyInPandas(finish, "session_id long, event_id long, place long")
    return kept.dropDuplicates(["session_id", "place"])


def nearby_query(positions: DataFrame, eligible: DataFrame, radius_m: float = 350.0, limit: int = MAX_NEARBY) -> DataFrame:
    """For a table of positions: eligible properties in range, whole coordinate groups in distance order up to the limit.

    Distances run per coordinate group, and groups beyond the limit are dropped by a rank filter that
    Spark applies before the shuffle; members are attached only to admitted groups.
    """
    groups = property_groups(eligible)
    near = radius_pairs(positions, groups, radius_m).withColumn("distance_m", F.round("distance_m").cast("bigint")).filter(F.col("distance_m") <= radius_m)
    key = ["position_id"]
    w = Window.partitionBy(*key).orderBy("distance_m", "first_property")
    near = near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit + 1)
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_sum", F.sum("group_count").over(w))
    fits = F.col("_sum") <= limit
    # An oversized first group of a default pin may be cut; any other group that does not fit ends the list.
    cut = (F.col("_rn") == 1) & ~fits & (F.col("group_count") >= SUSPICIOUS_GROUP)
    near = near.withColumn("_take", F.when(fits, F.col("group_count")).when(cut, F.lit(limit))).filter(F.col("_take").isNotNull())
    spot = F.concat_ws(",", F.format_string("%.6f", F.col("latitude")), F.format_string("%.6f", F.col("longitude")))
    wm = Window.partitionBy("group_id").orderBy("property_id")
    members = eligible.select("property_id", spot.alias("group_id")).withColumn("_place", F.row_number().over(wm)).filter(F.col("_place") <= limit)
    out = near.select(*key, "group_id", "distance_m", "group_count", "_take").join(members, "group_id").filter(F.col("_place") <= F.col("_take"))
    return out.select(
        *key, "property_id", "group_id", "distance_m", "group_count", (F.col("group_count") >= SUSPICIOUS_GROUP).alias("group_suspicious"), (F.col("_take") < F.col("group_count")).alias("group_truncated")
    )


def latency_report(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median, nearest-rank 95th percentile and maximum."""
    from casagrid.operators.quantiles import percentiles, values_at_ranks

    med = percentiles(df, [group], value, {"p50": 0.5}).drop("total")
    rank = F.greatest(F.lit(0), F.ceil(F.col("total") * F.lit(0.95)) - 1)
    tail = values_at_ranks(df, [group], value, {"p95": rank})
    top = df.groupBy(group).agg(F.max(value).alias("max"))
    return med.join(tail.drop("total"), group).join(top, group)
