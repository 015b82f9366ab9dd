"""Registered queries: incident tables, set operations, geocoding joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from casagrid.functions.numbers import round_stat
from casagrid.operators import geocode as G
from casagrid.operators import incidents as I
from casagrid.operators import lifecycle as L
from casagrid.plans.inputs import CACHE, rnd, view
from casagrid.plans.registry import query, shared
from casagrid.sources.projections import table

_GROUP = """case when event_id%9=0 then 'homicidio' when event_id%9=1 then 'lesiones' when event_id%9=2 then 'robo_vehiculo' when event_id%9=3 then 'hurto_vehiculo' when event_id%9=4 then 'robo'
  when event_id%9=5 then 'hurto' when event_id%9=6 then 'amenazas' when event_id%9=7 then 'extorsion' else 'otros' end"""
shared("inc", f"select *, {_GROUP} as incident_group from v_incident", "v_incident")
_PROP = "source_key='sat_propiedad' and measure='cantidad_hechos'"


def incidents(spark, folder):
    return view(spark, folder, "v_incident").withColumn("incident_group", I.classify_incident("incident_type"))


@query("incident_groups", "T33", oracle="select event_id, incident_group from inc", uses=("inc",))
def incident_groups(spark, folder):
    return incidents(spark, folder).select("event_id", "incident_group")


@query(
    "standard_incident_rows",
    "U1",
    oracle="""select source_key, period_year, period_month, incident_group, measure, value::double as value from inc union all select 'snic_departamentos_mensual', period_year, period_month, incident_group, 'cantidad_victimas', victims::double from inc""",
    uses=("inc",),
)
def standard_incident_rows(spark, folder):
    raw = view(spark, folder, "v_incident")
    first = I.standard_rows(raw, F.col("source_key"), "period_year", F.col("period_month").cast("string"), "incident_type", F.col("measure"), F.col("value").cast("string"))
    second = I.standard_rows(raw, F.lit("snic_departamentos_mensual"), "period_year", F.col("period_month").cast("string"), "incident_type", F.lit("cantidad_victimas"), "victims")
    return I.union_sources([first, second])


@query(
    "unpivoted_measures",
    "U2",
    oracle="select event_id, 'value' as measure, value from inc where value is not null union all select event_id, 'victims', victims from inc union all select event_id, 'half', value//2 from inc where event_id%3<>0",
    uses=("inc",),
)
def unpivoted_measures(spark, folder):
    df = view(spark, folder, "v_incident").select("event_id", "value", "victims", F.when(F.col("event_id") % 3 != 0, F.floor(F.col("value") / 2)).alias("half"))
    return I.unpivot_measures(df, ["event_id"], ["value", "victims", "half"])


@query(
    "learned_names",
    "U8",
    oracle="""select event_id, user_id, coalesce(n, 'sin nombre') as incident_name from inc left join (select user_id, arg_max(incident_type, event_id) as n from inc where source_key='sat_propiedad' and user_id%3<>0 group by 1) using (user_id)""",
    uses=("inc",),
)
def learned_names(spark, folder):
    df = view(spark, folder, "v_incident").select("event_id", "user_id", "source_key", "incident_type")
    known = F.when(F.col("user_id") % 3 != 0, F.col("incident_type"))
    teacher = df.filter(F.col("source_key") == "sat_propiedad").withColumn("incident_type", known)
    return I.learn_names(df.select("event_id", "user_id"), "user_id", teacher, "incident_type", "event_id", "sin nombre")


@query(
    "monthly_series",
    "A16",
    oracle="""select period_year, period_month, incident_group, cast(sum(case when measure='cantidad_hechos' then value else 0 end) as bigint) as cantidad_hechos, cast(sum(case when measure='cantidad_victimas' then value else 0 end) as bigint) as cantidad_victimas
      from inc where source_key='snic_departamentos_mensual' group by 1,2,3""",
    uses=("inc",),
)
def monthly_series(spark, folder):
    return I.monthly_series(incidents(spark, folder))


_MONTHS = ", ".join(f"cast(coalesce(sum(value) filter (period_month={m}),0) as bigint) as m{m:02d}" for m in range(1, 13))


@query("seasonality", "A17", oracle=f"select period_year, {_MONTHS} from inc where {_PROP} group by 1", uses=("inc",))
def seasonality(spark, folder):
    return I.seasonality(incidents(spark, folder))


@query(
    "seasonal_intensity",
    "A17",
    oracle=f"with c as (select period_year, period_month, sum(value)::double as value from inc where {_PROP} group by 1,2) select period_year, period_month, value, {rnd('0.12+least(0.78, value/greatest((select max(value) from c),1)*0.78)', 6)} as alpha from c",
    uses=("inc",),
)
def seasonal_intensity(spark, folder):
    return I.seasonal_intensity(incidents(spark, folder)).withColumn("alpha", round_stat("alpha", 6))


@query(
    "annual_by_group",
    "A18",
    oracle=f"""with c as (select period_year, incident_group, cast(sum(value) as bigint) as total from inc where {_PROP} and period_year between 2018 and 2023 group by 1,2),
      t as (select incident_group from c group by 1 order by coalesce(nullif(list_position(['robo','hurto','robo_vehiculo','hurto_vehiculo','extorsion','secuestro'], incident_group),0),99), sum(total) desc, incident_group limit 7)
      select * from c where incident_group in (select incident_group from t)""",
    uses=("inc",),
)
def annual_by_group(spark, folder):
    return I.annual_by_group(incidents(spark, folder), 2018, 2023)


def _sum(name: str, source: str, measure: str, group: str | None = None) -> str:
    extra = f" and incident_group='{group}'" if group else ""
    return f"cast(coalesce(sum(value) filter (period_year between 2018 and 2023 and source_key='{source}' and measure='{measure}'{extra}),0) as bigint) as {name}"


@query(
    "incident_metrics",
    "A19",
    oracle=f"""select *, vehicle_robbery+vehicle_theft as vehicle_total from (select min(period_year) as first_year, max(period_year) as last_year,
      (select string_agg(source_key, ',' order by source_key) from (select distinct source_key from inc where period_year between 2018 and 2023)) as sources,
      {_sum('reported_total', 'snic_departamentos_mensual', 'cantidad_hechos')}, {_sum('property_total', 'sat_propiedad', 'cantidad_hechos')}, {_sum('robbery', 'sat_propiedad', 'cantidad_hechos', 'robo')},
      {_sum('theft', 'sat_propiedad', 'cantidad_hechos', 'hurto')}, {_sum('vehicle_robbery', 'sat_propiedad', 'cantidad_hechos', 'robo_vehiculo')}, {_sum('vehicle_theft', 'sat_propiedad', 'cantidad_hechos', 'hurto_vehiculo')},
      {_sum('homicide', 'sat_homicidios', 'cantidad_hechos_dedup', 'homicidio')}, {_sum('homicide_victims', 'sat_homicidios', 'cantidad_victimas', 'homicidio')}, {_sum('injury', 'snic_departamentos_mensual', 'cantidad_hechos', 'lesiones')},
      {_sum('sexual_integrity', 'snic_departamentos_mensual', 'cantidad_hechos', 'integridad_sexual')} from inc)""",
    uses=("inc",),
)
def incident_metrics(spark, folder):
    return I.incident_metrics(incidents(spark, folder), 2018, 2023)


@query("source_row_counts", "A21", oracle="select source_key, count(*) as total from inc group by 1", uses=("inc",))
def source_row_counts(spark, folder):
    return view(spark, folder, "v_incident").groupBy("source_key").agg(F.count(F.lit(1)).alias("total"))


@query("events_by_zone", "A20", oracle="select zone_name as zone, count(*) as event_count, cast(sum(victims) as bigint) as victim_count from inc group by 1", uses=("inc",))
def events_by_zone(spark, folder):
    return I.events_by_zone(view(spark, folder, "v_incident"))


_PERSON = "case when event_id%3=0 then 'Inculpado' when event_id%3=1 then 'Víctima' else 'VICTIMA directa' end"


@query(
    "deduped_events",
    "W6,O7",
    oracle=f"select id_hecho, event_id, value from (select *, row_number() over (partition by id_hecho order by event_id) as rn from (select user_id*3 as id_hecho, event_id, value, {_PERSON} as person from inc) where strip_accents(lower(person)) like 'victima%') where rn=1",
    uses=("inc",),
)
def deduped_events(spark, folder):
    df = view(spark, folder, "v_incident").selectExpr("user_id*3 as id_hecho", "event_id", "value", f"{_PERSON} as person")
    out = I.dedupe_events(df, "id_hecho", "person", "event_id").select("id_hecho", "event_id", "value")
    return out.orderBy(*I.event_order("id_hecho"))


@query(
    "incident_table_check",
    "Q19",
    oracle="select count(*) as rows, count(*) filter (value-3<0) as negative, count(*) filter (measure<>'cantidad_hechos' or zone_name='Zona 3') as foreign_rows from inc",
    uses=("inc",),
)
def incident_table_check(spark, folder):
    df = view(spark, folder, "v_incident").withColumns({"value": F.col("value") - 3, "place": F.when(F.col("zone_name") == "Zona 3", "otro").otherwise("propio")})
    return I.validate_table(df, {"measure": "cantidad_hechos", "place": "propio"})


@query("missing_zone_keys", "U6", oracle="select distinct zone_name from inc where zone_name not in (select concat('Zona ', c_custkey%15) from customer)", uses=("inc",))
def missing_zone_keys(spark, folder):
    have = table(spark, folder, "customer").selectExpr("concat('Zona ', cast(c_custkey%15 as string)) as zone_name").distinct()
    return view(spark, folder, "v_incident").select("zone_name").distinct().join(have, "zone_name", "left_anti")


@query(
    "alias_merge",
    "U5",
    oracle="""select alias, canonical, origin from (select *, row_number() over (partition by alias order by origin, canonical) as rn from (select distinct concat('a', p_partkey%300) as alias, concat('c', p_partkey%300%50) as canonical, 0 as origin from part
        union all select distinct concat('a', s_suppkey%400), 'agregado', 1 from supplier)) where rn=1""",
)
def alias_merge(spark, folder):
    rows = table(spark, folder, "part").selectExpr("concat('a', cast(p_partkey%300 as string)) as alias", "concat('c', cast(p_partkey%300%50 as string)) as canonical", "0 as origin")
    extra = table(spark, folder, "supplier").selectExpr("concat('a', cast(s_suppkey%400 as string)) as alias", "'agregado' as canonical", "1 as origin")
    return L.keep_first(rows.unionByName(extra), ["alias"], ["origin"])


@query(
    "geocode_cache_hits",
    "J20,F21,F25",
    oracle="""with a as (select p_partkey as property_id, [concat('calle ', p_partkey%100), concat('calle ', (p_partkey+1)%100), concat('calle ', (p_partkey*7)%100)] as cs from part), e as (select property_id, unnest(cs) as query, generate_subscripts(cs,1)-1 as pos from a),
      h as (select e.*, c.latitude, c.longitude, row_number() over (partition by property_id order by pos) as rn from e join (select distinct query, latitude, longitude from v_cache where latitude is not null) c using (query))
      select property_id, query, cast(pos as int) as pos, latitude, longitude, not (latitude between -34.6655 and -34.5480 and longitude between -58.7065 and -58.6040) as outside_target from h where rn=1""",
    uses=("v_cache",),
)
def geocode_cache_hits(spark, folder):
    asked = table(spark, folder, "part").selectExpr("p_partkey as property_id", "array(concat('calle ', p_partkey%100), concat('calle ', (p_partkey+1)%100), concat('calle ', (p_partkey*7)%100)) as candidates")
    return G.from_cache(asked, table(spark, folder, "customer").selectExpr(*[f"{e} as {n}" for e, n in CACHE]))


_STREET = [
    ("p_partkey", "property_id"),
    ("case when p_partkey%9=0 then '' else concat('calle ', cast(p_partkey%12 as string)) end", "street_key"),
    ("case when p_partkey%7=0 then null else cast(p_partkey*31%4000 as int) end", "house_number"),
    ("case when p_partkey%7<>0 then 'exact' when p_partkey%14=0 then 'intersection' else 'street' end", "precision_kind"),
    ("-3.46e1 + cast(p_partkey%500 as double)*1e-5", "latitude"),
    ("-5.865e1 + cast(p_partkey%300 as double)*1e-5", "longitude"),
    ("p_partkey%5=0", "placed"),
]
shared("v_street", "select " + ", ".join(f"{e} as {n}" for e, n in _STREET) + " from part")


@query(
    "street_reference",
    "J21",
    oracle=f"""select property_id, ref_id, cast(gap as int) as gap, case when house_number is not null and gap<=50 then 'exact' when precision_kind='intersection' then 'intersection' else 'street' end as precision_kind, {rnd('greatest(0.2, 0.75-gap/500.0::double)', 6)} as confidence, latitude, longitude from
      (select a.property_id, a.house_number, a.precision_kind, r.property_id as ref_id, r.latitude, r.longitude, case when a.house_number is null then 0 else abs(a.house_number-r.house_number) end as gap,
         row_number() over (partition by a.property_id order by case when a.house_number is null then 0 else abs(a.house_number-r.house_number) end, r.property_id) as rn
       from v_street a join v_street r on a.street_key=r.street_key and a.street_key<>'' and not a.placed and r.placed and (a.house_number is null or abs(a.house_number-r.house_number)<=250)) where rn=1""",
    uses=("v_street",),
)
def street_reference(spark, folder):
    df = table(spark, folder, "part").selectExpr(*[f"{e} as {n}" for e, n in _STREET])
    out = G.from_street(df.filter(~F.col("placed")), df.filter("placed"))
    return out.withColumn("confidence", round_stat("confidence", 6))
