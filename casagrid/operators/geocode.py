"""Geocoding from a cache and from nearby house numbers on the same street."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The box of the target area.
TARGET_BOX = {"south": -34.6655, "west": -58.7065, "north": -34.5480, "east": -58.6040}
DEFAULT_PIN = (25.7308309, -80.444149)
MAX_NUMBER_GAP = 250


def outside_target(lat, lon):
    b = TARGET_BOX
    return ~(lat.between(b["south"], b["north"]) & lon.between(b["west"], b["east"]))


def is_default_pin(lat, lon):
    return (F.abs(lat - DEFAULT_PIN[0]) < 1e-6) & (F.abs(lon - DEFAULT_PIN[1]) < 1e-6)


def from_cache(asked: DataFrame, cache: DataFrame, key: str = "property_id") -> DataFrame:
    """First candidate text with cached coordinates; entries without coordinates are known misses.

    ``asked`` carries the key and an ordered array ``candidates``.
    """
    known = cache.filter(F.col("latitude").isNotNull()).groupBy("query").agg(F.min(F.struct("latitude", "longitude", "confidence")).alias("_c"))
    rows = asked.select(key, F.posexplode("candidates").alias("pos", "query")).join(known, "query")
    best = rows.groupBy(key).agg(F.min(F.struct("pos", "query", "_c")).alias("_b"))
    lat, lon = F.col("_b._c.latitude"), F.col("_b._c.longitude")
    return best.select(
        key, F.col("_b.query").alias("query"), F.col("_b.pos").alias("pos"), lat.alias("latitude"), lon.alias("longitude"), outside_target(lat, lon).alias("outside_target")
    )


def from_street(asked: DataFrame, placed: DataFrame, key: str = "property_id") -> DataFrame:
    """Coordinates of the nearest house number on the same street.

    Both sides carry street_key and house_number. Placed rows are first reduced to one per (street, number),
    and numbers meet only in neighbouring bands, so a long street is never paired with itself.
    """
    refs = placed.filter(F.col("street_key") != "")
    heads = F.min(F.struct(F.col(key).alias("ref_id"), "latitude", "longitude"))
    by_number = refs.filter(F.col("house_number").isNotNull()).groupBy("street_key", "house_number").agg(heads.alias("_r"))
    by_number = by_number.select("street_key", F.col("house_number").alias("ref_number"), "_r")
    by_number = by_number.withColumn("_band", F.explode(F.array(*[F.floor(F.col("ref_number") / MAX_NUMBER_GAP) + d for d in (-1, 0, 1)])))
    targets = asked.filter(F.col("street_key") != "").select(key, "street_key", "house_number", "precision_kind")
    numbers = targets.filter(F.col("house_number").isNotNull()).select("street_key", "house_number").distinct()
    numbers = numbers.withColumn("_band", F.floor(F.col("house_number") / MAX_NUMBER_GAP))
    gap = F.abs(F.col("house_number") - F.col("ref_number"))
    near = numbers.join(by_number, ["street_key", "_band"]).withColumn("gap", gap).filter(F.col("gap") <= MAX_NUMBER_GAP)
    near = near.groupBy("street_key", "house_number").agg(F.min(F.struct("gap", "_r")).alias("_b"))
    near = near.select("street_key", "house_number", "_b.gap", "_b._r.*")
    numbered = targets.join(near, ["street_key", "house_number"])
    by_street = refs.groupBy("street_key").agg(heads.alias("_r")).select("street_key", "_r.*")
    plain = targets.filter(F.col("house_number").isNull()).join(by_street, "street_key").withColumn("gap", F.lit(0))
    cols = [key, "house_number", "precision_kind", "gap", "ref_id", "latitude", "longitude"]
    out = numbered.select(*cols).unionByName(plain.select(*cols))
    exact = F.col("house_number").isNotNull() & (F.col("gap") <= 50)
    kind = F.when(exact, "exact").when(F.col("precision_kind") == "intersection", "intersection").otherwise("street")
    return out.select(
        key, "ref_id", "gap", kind.alias("precision_kind"), F.greatest(F.lit(0.2), F.lit(0.75) - F.col("gap") / 500).alias("confidence"), "latitude", "longitude"
    )
