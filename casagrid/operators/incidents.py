"""Incident statistics: standard long rows, monthly series, pivots and windowed totals."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casagrid.functions.numbers import col
from casagrid.functions.text import contains_folded, fold_plain, squeeze

# Month names as published.
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7,
    "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}
# Ordered tests of the incident group (after homicide, injury and sexual offences come thefts).
FIRST_GROUPS = (("homicidio", ("homicidio",)), ("lesiones", ("lesion",)), ("integridad_sexual", ("violacion", "sexual")))
LAST_GROUPS = (("amenazas", ("amenaza",)), ("secuestro", ("secuestro",)), ("extorsion", ("extorsion",)))
VEHICLE_WORDS = ("automotor", "motocicleta", "vehiculo")
VEHICLE_EXCLUSION = "excluir de automotores"
NULL_WORDS = ("na", "nan", "none", "null", "s/d", "sd")
PREFERRED_GROUPS = ("robo", "hurto", "robo_vehiculo", "hurto_vehiculo", "extorsion", "secuestro")


def parse_number(c: Column | str) -> Column:
    """Open-data numbers: a comma makes dots thousands marks; marker words and non-finite values are NULL."""
    t = F.btrim(col(c).cast("string"))
    plain = F.when(t.contains(","), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t)
    known = (t != "") & ~fold_plain(t).isin(*NULL_WORDS)
    value = F.when(known & plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def parse_month(c: Column | str) -> Column:
    names = F.from_json(F.lit(str(MONTHS).replace("'", '"')), "map<string,int>")
    return F.coalesce(parse_number(c).cast("int"), F.try_element_at(names, squeeze(fold_plain(c))))


def classify_incident(c: Column | str) -> Column:
    t = squeeze(fold_plain(c))
    vehicle = contains_folded(t, list(VEHICLE_WORDS)) & ~t.contains(VEHICLE_EXCLUSION)
    out = None
    for label, words in FIRST_GROUPS:
        test = contains_folded(t, list(words))
        out = F.when(test, label) if out is None else out.when(test, label)
    out = (
        out.when(t.contains("hurto") & vehicle, "hurto_vehiculo")
        .when(t.contains("robo") & vehicle, "robo_vehiculo")
        .when(t.contains("hurto"), "hurto")
        .when(t.contains("robo"), "robo")
    )
    for label, words in LAST_GROUPS:
        out = out.when(contains_folded(t, list(words)), label)
    return out.otherwise("otros")


def standard_rows(df: DataFrame, source_key: Column, year, month, incident_type, measure: Column, value) -> DataFrame:
    """Long rows of the standard shape; rows without a year or value are left out."""
    out = df.select(
        source_key.alias("source_key"),
        parse_number(year).cast("int").alias("period_year"),
        parse_month(month).alias("period_month"),
        classify_incident(incident_type).alias("incident_group"),
        measure.alias("measure"),
        parse_number(value).alias("value"),
    )
    return out.filter(F.col("period_year").isNotNull() & F.col("value").isNotNull())


def unpivot_measures(df: DataFrame, ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(measures), "measure", "value").filter(F.col("value").isNotNull())


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def learn_names(target: DataFrame, code: str, teacher: DataFrame, name: str, order: str, default: str) -> DataFrame:
    """Names learned per code from one source (the last one wins) and applied to another."""
    names = teacher.filter(F.col(name).isNotNull()).groupBy(code).agg(F.max_by(name, F.struct(order, name)).alias("_name"))
    return target.join(names, code, "left").withColumn("incident_name", F.coalesce("_name", F.lit(default))).drop("_name")


def monthly_series(df: DataFrame) -> DataFrame:
    snic = df.filter((F.col("source_key") == "snic_departamentos_mensual") & F.col("period_month").isNotNull())
    return snic.groupBy("period_year", "period_month", "incident_group").agg(
        *[F.sum(F.when(F.col("measure") == m, F.col("value")).otherwise(0)).cast("bigint").alias(m) for m in ("cantidad_hechos", "cantidad_victimas")]
    )


def property_rows(df: DataFrame) -> DataFrame:
    return df.filter((F.col("source_key") == "sat_propiedad") & (F.col("measure") == "cantidad_hechos"))


def seasonality(df: DataFrame) -> DataFrame:
    """year × month matrix of property incidents, zeros filled, beside the largest cell."""
    cells = property_rows(df).groupBy("period_year").pivot("period_month", list(range(1, 13))).agg(F.sum("value"))
    months = [F.coalesce(F.col(str(m)), F.lit(0)).cast("bigint").alias(f"m{m:02d}") for m in range(1, 13)]
    return cells.select("period_year", *months)


def seasonal_intensity(df: DataFrame) -> DataFrame:
    cells = property_rows(df).groupBy("period_year", "period_month").agg(F.sum("value").cast("double").alias("value"))
    top = cells.agg(F.greatest(F.max("value"), F.lit(1.0)))
    cells = cells.withColumn("top", top.scalar())
    return cells.select("period_year", "period_month", "value", (F.lit(0.12) + F.least(F.lit(0.78), F.col("value") / F.col("top") * 0.78)).alias("alpha"))


def annual_by_group(df: DataFrame, start: int, end: int, top: int = 7) -> DataFrame:
    """Yearly totals of the leading groups: preferred order first, then by size."""
    rows = property_rows(df).filter(F.col("period_year").between(start, end))
    cells = rows.groupBy("period_year", "incident_group").agg(F.sum("value").cast("bigint").alias("total"))
    sizes = cells.groupBy("incident_group").agg(F.sum("total").alias("n"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(g) for g in PREFERRED_GROUPS]), F.col("incident_group")), F.lit(0).cast("bigint")), F.lit(99))
    lead = sizes.orderBy(place, F.desc("n"), "incident_group").limit(top).select("incident_group")
    return cells.join(lead, "incident_group", "left_semi")


def incident_metrics(df: DataFrame, start: int, end: int) -> DataFrame:
    """Windowed totals by source, measure and group in one aggregate."""
    inside = F.col("period_year").between(start, end)

    def total(name: str, source: str, measure: str, group: str | None = None) -> Column:
        test = inside & (F.col("source_key") == source) & (F.col("measure") == measure)
        if group:
            test = test & (F.col("incident_group") == group)
        return F.sum(F.when(test, F.col("value")).otherwise(0)).cast("bigint").alias(name)

    sat, snic, hd = "sat_propiedad", "snic_departamentos_mensual", "sat_homicidios"
    out = df.agg(
        F.min("period_year").alias("first_year"),
        F.max("period_year").alias("last_year"),
        F.array_join(F.array_sort(F.collect_set(F.when(inside, F.col("source_key")))), ",").alias("sources"),
        total("reported_total", snic, "cantidad_hechos"),
        total("property_total", sat, "cantidad_hechos"),
        total("robbery", sat, "cantidad_hechos", "robo"),
        total("theft", sat, "cantidad_hechos", "hurto"),
        total("vehicle_robbery", sat, "cantidad_hechos", "robo_vehiculo"),
        total("vehicle_theft", sat, "cantidad_hechos", "hurto_vehiculo"),
        total("homicide", hd, "cantidad_hechos_dedup", "homicidio"),
        total("homicide_victims", hd, "cantidad_victimas", "homicidio"),
        total("injury", snic, "cantidad_hechos", "lesiones"),
        total("sexual_integrity", snic, "cantidad_hechos", "integridad_sexual"),
    )
    return out.withColumn("vehicle_total", F.col("vehicle_robbery") + F.col("vehicle_theft"))


def events_by_zone(df: DataFrame, zone: str = "zone_name", victims: str = "victims") -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(zone), F.lit("")), F.lit("Sin zona")).alias("zone")).agg(
        F.count(F.lit(1)).alias("event_count"), F.sum(victims).cast("bigint").alias("victim_count")
    )


def dedupe_events(df: DataFrame, key: str, person: str, order: str) -> DataFrame:
    """First victim row per event; the order column decides which one is first."""
    kept = df.filter(fold_plain(person).startswith("victima") & (F.btrim(F.col(key).cast("string")) != ""))
    others = [c for c in df.columns if c not in (key, order)]
    best = kept.groupBy(key).agg(F.min(F.struct(order, *others)).alias("b"))
    return best.select(key, f"b.{order}", *[f"b.{c}" for c in others])


def event_order(key: str) -> list[Column]:
    """Numbers first by value, then texts."""
    number = F.col(key).cast("string").try_cast("bigint")
    return [F.coalesce(number, F.lit(0).cast("bigint")).asc(), F.col(key).cast("string").asc()]


def validate_table(df: DataFrame, expected: Mapping[str, str], value: str = "value") -> DataFrame:
    """Counts of rows that break the table's promises."""
    wrong = F.lit(False)
    for column, want in expected.items():
        wrong = wrong | ~F.col(column).eqNullSafe(F.lit(want))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value) < 0).alias("negative"), F.count_if(wrong).alias("foreign_rows")
    )
