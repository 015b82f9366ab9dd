"""Distances, bearings and polygon tests as native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from casagrid.functions.numbers import col

EARTH_M = 6371008.8
TRIP_EARTH_M = 6371000.0
BOUNDARY_M = 0.5


def haversine_m(lat1, lon1, lat2, lon2, radius_m: float = EARTH_M) -> Column:
    a1, o1, a2, o2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), F.lit(2.0))
    return F.asin(F.sqrt(F.when(h > 1.0, F.lit(1.0)).otherwise(h))) * F.lit(2.0 * radius_m)


def radius_bbox(lat: float, lon: float, radius_km: float) -> tuple[float, float, float, float]:
    """south, west, north, east of a circle, for pruning before the exact distance."""
    dlat = radius_km / 111.32
    dlon = radius_km / (111.32 * max(math.cos(math.radians(lat)), 0.01))
    return lat - dlat, lon - dlon, lat + dlat, lon + dlon


def bearing(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    y = F.sin(o2 - o1) * F.cos(a2)
    x = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(o2 - o1)
    angle = F.degrees(F.atan2(y, x)) + F.lit(360.0)
    return F.when((F.abs(x) < 1e-12) & (F.abs(y) < 1e-12), None).otherwise(angle % F.lit(360.0))


def signed_angle(target, origin) -> Column:
    return ((col(target) - col(origin) + F.lit(540.0)) % F.lit(360.0)) - F.lit(180.0)


def relative_direction(heading, speed, target_bearing) -> Column:
    diff = signed_angle(target_bearing, heading)
    usable = col(heading).isNotNull() & (col(speed) >= 2) & col(target_bearing).isNotNull()
    return F.when(
        usable,
        F.when(F.abs(diff) <= 35, "adelante")
        .when(F.abs(diff) >= 155, "detras")
        .when(diff > 0, "a tu derecha")
        .otherwise("a tu izquierda"),
    ).otherwise("")


def bbox_distance_m(lat, lon, south, west, north, east) -> Column:
    clamped_lat = F.least(F.greatest(col(lat), col(south)), col(north))
    clamped_lon = F.least(F.greatest(col(lon), col(west)), col(east))
    return haversine_m(lat, lon, clamped_lat, clamped_lon)


def segment_distance_m(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular distance to a segment, projected at the point's own latitude."""
    lat, lon = col(lat), col(lon)
    scale = F.cos(F.radians(lat))

    def xy(a: Column, o: Column) -> tuple[Column, Column]:
        return F.radians(o) * scale * F.lit(EARTH_M), F.radians(a) * F.lit(EARTH_M)

    (px, py), (ax, ay), (bx, by) = xy(lat, lon), xy(lat1, lon1), xy(lat2, lon2)
    dx, dy = bx - ax, by - ay
    norm = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, norm), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a ring, closing it when its ends differ."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"), b["lon"].alias("x2"), b["lat"].alias("y2")),
    )


def ray_cast(lat: Column, lon: Column, edges: Column) -> Column:
    def step(acc: Column, e: Column) -> Column:
        straddles = (e["y1"] > lat) != (e["y2"] > lat)
        rise = e["y2"] - e["y1"]
        slope = (e["x2"] - e["x1"]) / F.when(rise == 0, F.lit(1e-12)).otherwise(rise)
        hit = straddles & (lon < slope * (lat - e["y1"]) + e["x1"])
        return acc != hit

    return F.aggregate(edges, F.lit(False), step)


def edges_distance_m(lat: Column, lon: Column, edges: Column) -> Column:
    return F.array_min(F.transform(edges, lambda e: segment_distance_m(lat, lon, e["y1"], e["x1"], e["y2"], e["x2"])))


def ring_contains(lat: Column, lon: Column, edges: Column, tolerance_m: float = BOUNDARY_M) -> Column:
    inside = ray_cast(lat, lon, edges)
    if tolerance_m <= 0:
        return inside
    return inside | (edges_distance_m(lat, lon, edges) <= tolerance_m)


def literal_ring(points: list[tuple[float, float]]) -> Column:
    """Ring column of fixed ``(lon, lat)`` points."""
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])
