"""Audits: residual work per source, territory defects, layer profiles and hierarchy checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casagrid.operators.merge import sample_per_category


def residual_by_source(properties: DataFrame, listings: DataFrame) -> DataFrame:
    """Work left per source; properties without an advert count under a sentinel."""
    pairs = listings.select("property_id", F.col("source_id").cast("string").alias("source")).distinct()
    rows = properties.join(pairs, "property_id", "left").withColumn("source", F.coalesce("source", F.lit("sin fuente")))
    f = F.col
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~f("is_reviewed")).alias("pending"),
        F.count_if(F.coalesce(f("inferred_zone"), F.lit("")) == "").alias("without_zone"),
        F.count_if(F.coalesce(f("address"), F.lit("")) == "").alias("without_address"),
    )


def defects(df: DataFrame, tests: Mapping[str, Column], key: str, sample: int = 5) -> DataFrame:
    """Count of each defect with its first ids. Only the first ids of a defect are gathered."""
    hits = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    rows = df.select(key, F.explode(hits).alias("defect"))
    counts = rows.groupBy("defect").agg(F.count(F.lit(1)).alias("total"))
    first = sample_per_category(rows, "defect", key, sample)
    first = first.groupBy("defect").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda v: v.cast("string")), ",").alias("sample"))
    names = df.sparkSession.createDataFrame([(n,) for n in tests], "defect string")
    return names.join(counts, "defect", "left").join(first, "defect", "left").select(
        "defect", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"), F.coalesce("sample", F.lit("")).alias("sample")
    )


# Zone spellings that should no longer occur.
LEGACY_ZONES = ("barrio ingles", "barrio inglés", "b ingles", "b inglés", "ingles", "inglés", "hurlingham centro")


def territory_tests() -> dict[str, Column]:
    f = F.col
    legacy = F.lit(False)
    for c in ("neighborhood", "detected_neighborhood", "inferred_neighborhood", "inferred_zone"):
        legacy = legacy | F.lower(F.btrim(F.coalesce(f(c), F.lit("")))).isin(*LEGACY_ZONES)
    return {
        "sin_coordenadas": f("latitude").isNull(),
        "fuera_partido": f("inferred_locality") == "",
        "sin_zona": (f("inferred_locality") != "") & (f("inferred_zone") == ""),
        "conflicto_texto_poligono": f("zone_conflict"),
        "alias_viejo": legacy,
    }


def layer_profile(layer: DataFrame, kind: Column, label: str, box: Mapping[str, float]) -> DataFrame:
    """Features, geometry types, bounds, empty geometries, features out of bounds and repeated labels of a layer."""
    f = F.col
    out = (f("latitude") < box["south"]) | (f("latitude") > box["north"]) | (f("longitude") < box["west"]) | (f("longitude") > box["east"])
    agg = layer.withColumn("_kind", kind).agg(
        F.count(F.lit(1)).alias("features"),
        F.array_join(F.array_sort(F.collect_set("_kind")), ",").alias("geometry_types"),
        F.min("latitude").alias("south"),
        F.max("latitude").alias("north"),
        F.min("longitude").alias("west"),
        F.max("longitude").alias("east"),
        F.count_if(f("latitude").isNull()).alias("empty"),
        F.count_if(out).alias("out_of_bounds"),
    )
    repeated = duplicate_labels(layer, label).agg(F.count(F.lit(1)).alias("n"))
    return agg.withColumn("duplicate_labels", repeated.scalar())


def duplicate_labels(layer: DataFrame, label: str) -> DataFrame:
    return layer.groupBy(label).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def infrastructure_check(points: DataFrame, types: Sequence[str], box: Mapping[str, float], score: Column) -> DataFrame:
    f = F.col
    inside = f("latitude").between(box["south"], box["north"]) & f("longitude").between(box["west"], box["east"])
    return points.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(~f("point_type").isin(*types)).alias("unknown_types"),
        F.count_if(~inside).alias("out_of_bounds"),
        F.count_if(~score.between(0, 100)).alias("bad_scores"),
    )


def hierarchy_check(nodes: DataFrame, aliases: DataFrame, levels: Mapping[str, str]) -> DataFrame:
    """Defects of a nested territory: unknown parents, wrong levels, unknown and repeated aliases.

    ``nodes``: name, level, parent; ``levels``: child level to parent level.
    """
    f = F.col
    parents = nodes.groupBy(f("name").alias("parent")).agg(F.min("level").alias("parent_level"))
    rows = nodes.filter(f("parent").isNotNull()).join(parents, "parent", "left")
    expected = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    unknown = rows.filter(f("parent_level").isNull()).select(F.lit("unknown_parent").alias("defect"), "name")
    wrong = rows.filter(f("parent_level") != F.try_element_at(expected, f("level"))).select(F.lit("wrong_level").alias("defect"), "name")
    lost = aliases.join(nodes.select(f("name").alias("target")), "target", "left_anti").select(F.lit("unknown_alias_target").alias("defect"), f("alias").alias("name"))
    twice = aliases.groupBy("alias").agg(F.countDistinct("target").alias("n")).filter(f("n") > 1)
    twice = twice.select(F.lit("ambiguous_alias").alias("defect"), f("alias").alias("name"))
    return unknown.unionByName(wrong).unionByName(lost).unionByName(twice)
