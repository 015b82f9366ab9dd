"""Loaders shared by the registered queries, and the SQL twins of the curated base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casagrid.functions.quality import curate
from casagrid.operators.search import join_base
from casagrid.plans.registry import shared
from casagrid.sources.projections import projection, table
from casagrid.sources.tables import dealt, stored


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return projection(spark, folder, name)


def base(spark: SparkSession, folder: str) -> DataFrame:
    return join_base(*(view(spark, folder, n) for n in ("v_property", "v_location", "v_intel")))


def curated(spark: SparkSession, folder: str) -> DataFrame:
    """The curated table every panel reads; visibility is a partition filter, boxes prune row groups."""
    def build() -> DataFrame:
        return curate(dealt(base(spark, folder), view(spark, folder, "v_property").count(), "property_id"))

    return stored(spark, folder, "curated", build, ("operation", "status"), ("latitude", "longitude"))


def listings(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "v_listing")


def rnd(expr: str, digits: int = 2) -> str:
    return f"cast(round(cast({expr} as decimal(28,8)), {digits}) as double)"


def dec_ratio(price: str, area: str) -> str:
    """Half-even cents of price/area by integer arithmetic."""
    n, d = f"(cast({price} * 100 as bigint) * 100)", f"cast({area} * 100 as bigint)"
    return (
        f"cast(({n} // {d} + case when 2 * ({n} % {d}) > {d} or (2 * ({n} % {d}) = {d} and ({n} // {d}) % 2 = 1) "
        f"then 1 else 0 end) as double) / 100"
    )


shared(
    "base",
    "select * from v_property left join v_location using (property_id) left join v_intel using (property_id)",
    "v_property",
    "v_location",
    "v_intel",
)

_T = "strip_accents(lower(title))"
_ALL = "concat(strip_accents(lower(title)), ' ', strip_accents(lower(description)), ' ', property_type)"
shared(
    "flagged",
    f"""select *,
        regexp_matches({_T}, '\\b(cochera|garage|garaje|cocheras)\\b')
          and not regexp_matches({_T}, '\\b(casa|chalet|depto|departamento|ph|duplex|triplex|monoambiente|ambientes?)\\b') as g,
        regexp_matches({_ALL}, '\\b(galpon|deposito|nave|fraccion|industrial)\\b') as c,
        property_type in ('land', 'country_house', 'other') as big
      from base""",
    "base",
)


def _area(field: str, low: int) -> str:
    normal = "3000" if field == "covered_area" else "case when big then 100000 else 10000 end"
    return (
        f"case when {field} between (case when g then 8 when c then 10 else {low} end) "
        f"and (case when g then 100 when c then 100000 else {normal} end) then {field} end as valid_{field}"
    )


shared(
    "ranged",
    f"""select *, case when rooms between 0 and 15 then rooms end as valid_rooms,
        case when bedrooms between 0 and 12 then bedrooms end as valid_bedrooms,
        case when bathrooms between 0 and 10 then bathrooms end as valid_bathrooms,
        case when garages between 0 and 8 then garages end as valid_garages,
        {_area('covered_area', 10)}, {_area('land_area', 20)}, {_area('total_area', 20)},
        case when currency <> 'USD' or price between 1000 and 5000000 then price end as valid_price,
        case when age_years is null then 'unknown' when age_years <= 5 then '0-5' when age_years <= 20 then '6-20'
             when age_years <= 40 then '21-40' else '41+' end as age_band
      from flagged""",
    "flagged",
)
shared(
    "curated",
    f"""select * , case when currency = 'USD' and valid_price is not null and valid_area is not null
            then {dec_ratio('valid_price', 'valid_area')} end as price_m2,
          coalesce(nullif(inferred_zone, ''), nullif(zone_name, ''), nullif(inferred_neighborhood, '')) as geo_zone
        from (select *, coalesce(nullif(valid_covered_area, 0), nullif(valid_total_area, 0), nullif(valid_land_area, 0)) as valid_area,
            case when property_type = 'land' then coalesce(nullif(valid_land_area, 0), valid_total_area)
                 else coalesce(nullif(valid_covered_area, 0), nullif(valid_total_area, 0), valid_land_area) end as comparable_area
          from ranged)""",
    "ranged",
)

K = "p_partkey"
MORE = [
    (K, "property_id"),
    (f"case when {K}%4=0 then null else cast({K}%3 as int) end", "toilets"),
    (f"case when {K}%3=0 then null else cast(p_size*3 as decimal(10,2)) end", "uncovered_area"),
    (f"case when {K}%5=0 then null else cast(p_size*2 as decimal(10,2)) end", "semicovered_area"),
    (f"case when {K}%6=0 then null else cast(8+{K}%7 as decimal(8,2)) end", "front_width"),
    (f"case when {K}%7=0 then null else cast(20+{K}%30 as decimal(8,2)) end", "lot_depth"),
    (f"case when {K}%9=0 then cast(1+{K}%3 as int) else null end", "building_floors"),
    (f"case when {K}%8=0 then '' else concat('f', cast({K}%8 as string)) end", "features"),
    (f"case when {K}%16=0 or {K}%5=1 then -3.461e1 - cast({K}%50 as double)/1e3 else null end", "detected_latitude"),
    (f"case when {K}%16=0 or {K}%5=1 then -5.863e1 - cast({K}%40 as double)/1e3 else null end", "detected_longitude"),
    (f"case when {K}%8=0 then '' else 'location_polygon' end", "inferred_neighborhood_method"),
    (f"case when {K}%3=0 then null else cast({K}%400 as double) end", "inferred_neighborhood_distance_m"),
    (f"case when {K}%10<4 then '' else concat('e', cast({K}%10 as string)) end", "location_evidence"),
]
shared("v_more", "select " + ", ".join(f"{e} as {n}" for e, n in MORE) + " from part")


def more_columns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(*[f"{e} as {n}" for e, n in MORE])

CACHE = [
    ("concat('calle ', cast(c_custkey%60 as string))", "query"),
    ("case when c_custkey%60%4=0 then null else -3.46e1 - cast(c_custkey%60 as double)*2e-3 end", "latitude"),
    ("case when c_custkey%60%4=0 then null else -5.865e1 end", "longitude"),
    ("5e-1", "confidence"),
]
shared("v_cache", "select " + ", ".join(f"{e} as {n}" for e, n in CACHE) + " from customer")
