"""Registered queries: statistics panels, windows, quality, anomalies and opportunities."""

from __future__ import annotations

from pyspark.sql import functions as F

from casagrid.functions import numbers as N
from casagrid.functions import quality as Q
from casagrid.operators import anomaly as A
from casagrid.operators import search as S
from casagrid.operators import stats as M
from casagrid.plans.inputs import base, curated, dec_ratio, listings, rnd, view
from casagrid.plans.registry import query, shared
from casagrid.sources.projections import table

SALE = "status = 'active' and operation = 'sale' and not is_hidden"
shared("visible", f"select * from curated where {SALE}", "curated")


def visible(spark, folder):
    return S.search(curated(spark, folder), {})


def q(expr: str, p: float) -> str:
    return f"quantile_cont(cast({expr} as double), {p})"


@query(
    "curated_metrics",
    "Q1,Q2,Q3,Q4,T30,T36",
    oracle=f"""select property_id, valid_rooms, valid_bedrooms, valid_garages, valid_bathrooms::double as valid_bathrooms, valid_covered_area::double as valid_covered_area,
      valid_land_area::double as valid_land_area, valid_total_area::double as valid_total_area, valid_price::double as valid_price, valid_area::double as valid_area,
      comparable_area::double as comparable_area, price_m2, age_band, case when coalesce(nullif(covered_area,0),nullif(total_area,0),nullif(land_area,0)) is not null and price is not null
        then {dec_ratio('price', 'coalesce(nullif(covered_area,0),nullif(total_area,0),nullif(land_area,0))')} end as raw_price_m2 from curated""",
    uses=("curated",),
)
def curated_metrics(spark, folder):
    df = curated(spark, folder)
    dbl = ["valid_bathrooms", "valid_covered_area", "valid_land_area", "valid_total_area", "valid_price", "valid_area", "comparable_area", "price_m2"]
    return df.select(
        "property_id", "valid_rooms", "valid_bedrooms", "valid_garages", *[F.col(c).cast("double").alias(c) for c in dbl], "age_band",
        Q.raw_price_per_m2().cast("double").alias("raw_price_m2"),
    )


@query(
    "zone_price_statistics",
    "A2,O4",
    oracle=f"""select coalesce(geo_zone, 'Sin dato') as zone, count(*) as total, {rnd('avg(valid_price::double)',4)} as avg, {rnd('stddev_pop(valid_price::double)',4)} as std,
      {rnd(q('valid_price',.5),4)} as median, {rnd('stddev_pop(valid_price::double)/avg(valid_price::double)*100',4)} as cv, {rnd('min(valid_price::double)',4)} as min,
      {rnd('max(valid_price::double)',4)} as max, {rnd(q('valid_price',.25),4)} as q1, {rnd(q('valid_price',.75),4)} as q3
      from visible where valid_price is not null group by 1 order by total desc, zone limit 20""",
    uses=("visible",),
)
def zone_price_statistics(spark, folder):
    return M.zone_price_statistics(visible(spark, folder))


@query(
    "zone_type_matrix",
    "A3,O4",
    oracle=f"""select coalesce(geo_zone, 'Sin dato') as zone, property_type, count(*) as total, {rnd('avg(valid_price::double)',4)} as avg_price, {rnd(q('valid_price',.5),4)} as median_price,
      {rnd('stddev_pop(valid_price::double)',4)} as std_price, {rnd('avg(price_m2)',4)} as avg_price_m2, {rnd(q('price_m2',.5),4)} as median_price_m2, {rnd('stddev_pop(price_m2)',4)} as std_price_m2
      from visible where valid_price is not null or price_m2 is not null group by 1, 2 order by total desc, zone, property_type limit 80""",
    uses=("visible",),
)
def zone_type_matrix(spark, folder):
    return M.zone_type_matrix(visible(spark, folder))


@query(
    "currency_counter",
    "A4",
    oracle="select coalesce(nullif(geo_zone,''),'Sin dato') as label, count(*) as total from curated group by 1",
    uses=("curated",),
)
def currency_counter(spark, folder):
    return M.counter(curated(spark, folder), "geo_zone")


@query(
    "triage_by_zone",
    "A5",
    oracle="""select coalesce(geo_zone,'Sin dato') as label, count(*) as total, cast(sum(case when is_favorite then 1 else 0 end) as bigint) as favorites,
      cast(sum(case when not is_favorite and is_reviewed then 1 else 0 end) as bigint) as reviewed, cast(sum(case when not is_favorite and not is_reviewed then 1 else 0 end) as bigint) as pending
      from visible group by 1""",
    uses=("visible",),
)
def triage_by_zone(spark, folder):
    return M.triage_series(visible(spark, folder), "geo_zone")


for _key in ("agency_id", "source_id"):

    @query(
        f"properties_per_{_key[:-3]}",
        "A6,O4",
        oracle=f"""select {_key}, count(distinct property_id) as total from v_listing where {_key} is not null and property_id in (select property_id from visible)
          group by 1 order by total desc, {_key} limit 12""",
        uses=("visible", "v_listing"),
    )
    def properties_per(spark, folder, key=_key):
        return M.distinct_properties(visible(spark, folder), listings(spark, folder), key)


_AGE = "(date '2024-06-01' - first_seen_on)"
_UNSEEN = "(date '2024-06-01' - last_seen_on)"


@query(
    "liquidity_buckets",
    "A7",
    oracle=f"""select b.label, {rnd('avg(valid_price::double)',4)} as avg_price, count(v.property_id) as total, count(*) filter ({_AGE} <= 15) as new,
      count(*) filter ({_AGE} >= 90) as persistent, count(*) filter ({_UNSEEN} >= 30) as stale
      from (values (0,'0-15 dias'),(1,'16-45 dias'),(2,'46-90 dias'),(3,'+90 dias')) b(slot,label)
      left join visible v on b.slot = case when {_AGE} <= 15 then 0 when {_AGE} <= 45 then 1 when {_AGE} <= 90 then 2 else 3 end group by b.label""",
    uses=("visible",),
)
def liquidity_buckets(spark, folder):
    return M.liquidity_buckets(visible(spark, folder), "2024-06-01")


@query(
    "price_histogram",
    "A8",
    oracle="""with lim as (select min(p) as lo, greatest((max(p)-min(p))/8, 1.0) as step from
         (select valid_price::double as p from visible where valid_price is not null order by property_id limit 500)),
       slots as (select cast(range as int) as slot from range(8))
      select slot, count(v.property_id) as total, count(*) filter (is_favorite) as favorites, count(*) filter (not is_favorite and is_reviewed) as reviewed,
        count(*) filter (not is_favorite and not is_reviewed) as pending
      from slots cross join lim left join visible v on v.valid_price::double >= lo + step*slot and (v.valid_price::double < lo + step*(slot+1) or (slot = 7 and v.valid_price::double <= lo + step*8))
      group by slot""",
    uses=("visible",),
)
def price_histogram(spark, folder):
    return M.price_histogram(visible(spark, folder))


_METRICS = {
    "price": "valid_price", "price_m2": "price_m2", "covered_area": "valid_covered_area", "bedrooms": "valid_bedrooms", "bathrooms": "valid_bathrooms",
    "total_area": "coalesce(nullif(valid_land_area,0), nullif(valid_total_area,0))",
}


@query(
    "dashboard_summaries",
    "A1,A9",
    oracle=" union all ".join(
        f"select '{n}' as metric, count(v) as n, {rnd('avg(v)',4)} as avg, {rnd(q('v',.5),4)} as median, {rnd('min(v)',4)} as min, {rnd('max(v)',4)} as max, {rnd('stddev_pop(v)',4)} as std from (select cast({e} as double) as v from visible)"
        for n, e in _METRICS.items()
    ),
    uses=("visible",),
)
def dashboard_summaries(spark, folder):
    return M.kpi_summaries(visible(spark, folder))


shared(
    "facts",
    "select property_id, count(*) as listing_count, bool_or(image_url <> '') as has_image, bool_or(agency_id is not null) as has_agency from v_listing group by property_id",
    "v_listing",
)
shared(
    "scored",
    """select v.*, listing_count, has_image, has_agency, cast(round_even((
        (price is not null)::int + (coalesce(nullif(covered_area,0),nullif(total_area,0),nullif(land_area,0)) is not null)::int + (latitude is not null)::int
        + coalesce(has_image,false)::int + (coalesce(listing_count,0)>0)::int + coalesce(has_agency,false)::int)*100/6.0, 0) as int) as quality_score
      from visible v left join facts using (property_id)""",
    "visible",
    "facts",
)


@query("quality_scores", "A10", oracle="select property_id, quality_score from scored", uses=("scored",))
def quality_scores(spark, folder):
    return M.quality_score(visible(spark, folder), S.listing_facts(listings(spark, folder))).select("property_id", "quality_score")


@query(
    "dashboard_counts",
    "A9",
    oracle="""select count(*) as total, count(valid_price) as with_price, count(valid_area) as with_surface, count(*) filter (detected_address<>'' or address<>'') as with_address,
      count(latitude) as with_location, count(*) filter (has_image) as with_image, count(*) filter (listing_count>0) as with_link, count(*) filter (has_agency) as with_agency,
      count(*) filter (location_confidence not in ('high','medium')) as weak_location, count(*) filter (first_seen_on >= date '2024-04-01') as new_since_run,
      count(*) filter (quality_score < 70) as incomplete, count(*) filter (location_notes <> '') as with_location_notes,
      (select cast(coalesce(sum(n),0) as bigint) from (select count(*) as n from visible where coalesce(nullif(normalized_address,''),nullif(lower(detected_address),'')) is not null
         group by coalesce(nullif(normalized_address,''),nullif(lower(detected_address),'')) having count(*)>1)) as possible_duplicates from scored""",
    uses=("scored",),
)
def dashboard_counts(spark, folder):
    return M.kpi_counts(visible(spark, folder), S.listing_facts(listings(spark, folder)), "2024-04-01")


@query(
    "location_zone_matrix",
    "A12",
    oracle=f"""select coalesce(geo_zone, nullif(detected_neighborhood,''), nullif(neighborhood,''), 'Sin dato') as zone, count(*) as total, {rnd('avg(overall_score)',4)} as avg_score,
      {rnd(q('overall_score',.5),4)} as median_score, {rnd(q('price_m2',.5),4)} as median_price_m2, {rnd('avg(transport_score)',4)} as avg_transport, {rnd('avg(flood_penalty_score)',4)} as avg_flood,
      {rnd('avg(urban_informality_score)',4)} as avg_urban from visible group by 1 order by avg_score desc nulls last, total desc, zone limit 80""",
    uses=("visible",),
)
def location_zone_matrix(spark, folder):
    return M.location_zone_matrix(visible(spark, folder))


@query(
    "incident_zone_insights",
    "A11,A20,J19",
    oracle=f"""with p as (select coalesce(geo_zone,'Sin dato') as zone, count(*) as pc, {rnd(q('price_m2',.5),4)} as median_price_m2, {rnd('avg(security_coverage_score)',4)} as avg_coverage,
        {rnd('avg(security_risk_score)',4)} as avg_risk from visible group by 1), e as (select zone_name as zone, count(*) as ec, sum(victims) as vc from v_incident group by 1)
      select zone, coalesce(pc,0) as property_count, coalesce(ec,0) as event_count, cast(coalesce(vc,0) as bigint) as victim_count, median_price_m2, avg_coverage, avg_risk
      from p full join e using (zone) order by property_count desc, event_count desc, zone limit 80""",
    uses=("visible", "v_incident"),
)
def incident_zone_insights(spark, folder):
    from casagrid.operators.incidents import events_by_zone

    return M.incident_zone_insights(visible(spark, folder), events_by_zone(view(spark, folder, "v_incident")))


@query(
    "zone_facets",
    "A13",
    oracle="""select z.zone, count(v.property_id) as total from (select concat('zona-', cast(r.r_regionkey*5+s.r_regionkey as varchar)) as zone, concat('zona', cast(r.r_regionkey*5+s.r_regionkey as varchar)) as k
        from region r cross join region s) z left join curated v on regexp_replace(lower(v.geo_zone), '[^a-z0-9]+', '', 'g') = z.k group by 1""",
    uses=("curated",),
)
def zone_facets(spark, folder):
    r = table(spark, folder, "region").select("r_regionkey")
    zones = r.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c"), "r_regionkey").select(
        F.concat(F.lit("zona-"), (F.col("r_regionkey") * 5 + F.col("c")).cast("string")).alias("zone_name")
    )
    return M.zone_facets(curated(spark, folder), zones)


@query(
    "level_facets",
    "A14,U4",
    oracle="select distinct value from (select level as value from v_intel where level<>'' union all select unnest(['alta','media_alta','media','baja']))",
    uses=("v_intel",),
)
def level_facets(spark, folder):
    return M.distinct_facet(view(spark, folder, "v_intel"), ["level"], M.DEFAULT_LEVELS)


@query(
    "value_zone_facets",
    "A14,U4",
    oracle="select inferred_zone as value from base where inferred_zone<>'' union select zone_name from base where zone_name<>''",
    uses=("base",),
)
def value_zone_facets(spark, folder):
    return M.distinct_facet(base(spark, folder), ["inferred_zone", "zone_name"])


@query(
    "change_signature",
    "A38",
    oracle="""select sha256(concat_ws('|', count(*), max(first_seen_on), max(last_seen_on), count(*) filter (is_hidden), count(*) filter (is_favorite), count(*) filter (is_reviewed))) as signature,
      count(*) as n from v_property""",
    uses=("v_property",),
)
def change_signature(spark, folder):
    return M.change_signature(view(spark, folder, "v_property"))


def _extent_sql(share: float) -> str:
    return f"""with p as (select latitude, longitude, row_number() over (order by latitude)-1 as ra, row_number() over (order by longitude)-1 as ro, count(*) over () as n from v_location where latitude is not null),
      l as (select max(n) as n, cast(floor(max(n)*{share}) as bigint) as lo, greatest(cast(floor(max(n)*{share}) as bigint), cast(ceil(max(n)*{1 - share}) as bigint)-1) as hi from p),
      b as (select (select latitude from p where ra=lo) as s, (select latitude from p where ra=hi) as t, (select longitude from p where ro=lo) as w, (select longitude from p where ro=hi) as e from l)
      select min(latitude) as south, max(latitude) as north, min(longitude) as west, max(longitude) as east, count(*) as kept from p, b where latitude between s and t and longitude between w and e"""


@query("map_extent", "A36", oracle=_extent_sql(0.04), uses=("v_location",))
def map_extent(spark, folder):
    return M.robust_extent(view(spark, folder, "v_location"), 0.04, 25)


@query("heatmap_extent", "A36", oracle=_extent_sql(0.05), uses=("v_location",))
def heatmap_extent(spark, folder):
    return M.robust_extent(view(spark, folder, "v_location"), 0.05, 30)


@query(
    "legend_quantiles",
    "A37",
    oracle="select list_sort(list(price_m2))[cast(floor((count(*)-1)*0.05) as int)+1] as low, list_sort(list(price_m2))[cast(floor((count(*)-1)*0.95) as int)+1] as high from visible where price_m2 is not null",
    uses=("visible",),
)
def legend_quantiles(spark, folder):
    return M.legend_quantiles(visible(spark, folder), "price_m2", {"low": 0.05, "high": 0.95})


shared(
    "spots",
    """select *, concat(printf('%.6f', latitude), ',', printf('%.6f', longitude)) as group_id from base where latitude is not null""",
    "base",
)
_SHORT = """case when p is null then 'Consultar' else trim(concat_ws(' ', cur, case when abs(p)>=1000000 then concat(replace(regexp_replace(cast(cast(round_even(p/1000000.0,1) as decimal(16,1)) as varchar), '\\.0$', ''),'.',','),'M')
  when abs(p)>=1000 then concat(cast(cast(round_even(p/1000.0,0) as bigint) as varchar),'k') else cast(cast(round_even(p,0) as bigint) as varchar) end)) end"""


@query(
    "coordinate_sharing",
    "A40,T31",
    oracle=f"""select group_id, group_count, group_count >= 5 as suspicious, case when single then {_SHORT} else '' end as cheapest from (select group_id, count(*) as group_count,
      count(distinct currency)=1 as single, min(price)::double as p, arg_min(currency, price) as cur from spots group by group_id)""",
    uses=("spots",),
)
def coordinate_sharing(spark, folder):
    return M.coordinate_sharing(base(spark, folder))


@query(
    "price_segments",
    "W1",
    oracle="""with s as (select *, case when lag(k) over w is not distinct from k and row_number() over w > 1 then 0 else 1 end as isnew from
        (select *, concat(coalesce(currency,''),'|',coalesce(cast(price as varchar),'-')) as k from v_snapshot)
        window w as (partition by property_id order by observed_on, snapshot_id, currency, price nulls first)),
      g as (select *, sum(isnew) over (partition by property_id order by observed_on, snapshot_id, currency, price nulls first rows unbounded preceding) as segment from s)
      select property_id, cast(segment as bigint) as segment, min(currency) as currency, min(price) as price, min(observed_on) as first_seen, max(observed_on) as last_seen, count(*) as observations,
        min(observed_on)=max(observed_on) as same_day from g group by property_id, segment""",
    uses=("v_snapshot",),
)
def price_segments(spark, folder):
    return M.price_segments(view(spark, folder, "v_snapshot"))


@query(
    "display_labels",
    "T22,T32,T35",
    oracle="""select property_id, coalesce(geo_zone, nullif(detected_neighborhood,''), nullif(neighborhood,'')) as display_zone, coalesce(nullif(detected_neighborhood,''), nullif(neighborhood,'')) as declared,
      case when overall_score is null then null when overall_score<20 then 'muy_baja' when overall_score<40 then 'baja' when overall_score<60 then 'media' when overall_score<80 then 'media_alta' else 'alta' end as five_step,
      case when security_coverage_score is null then '' when security_coverage_score>=65 then 'alta' when security_coverage_score>=45 then 'media' else 'baja' end as security_step,
      case when overall_score is null then '' when overall_score>=70 then 'alta' when overall_score>=60 then 'media_alta' when overall_score>=45 then 'media' else 'baja' end as location_step,
      100.0::double - security_coverage_score as risk from curated""",
    uses=("curated",),
)
def display_labels(spark, folder):
    df = curated(spark, folder)
    return df.select(
        "property_id",
        F.coalesce("geo_zone", Q.declared_neighborhood()).alias("display_zone"),
        Q.declared_neighborhood().alias("declared"),
        N.classify_level("overall_score").alias("five_step"),
        N.security_level("security_coverage_score").alias("security_step"),
        N.location_level("overall_score").alias("location_step"),
        N.risk_from_coverage("security_coverage_score").alias("risk"),
    )


_RANGE_SQL = " union all ".join(
    f"select property_id, '{f}' as field, cast({f} as varchar) as value, concat('fuera de rango ', cast({lo} as varchar), '-', cast({hi} as varchar)) as reason, 'range' as category from visible where {f} is not null and not ({f} between {lo} and {hi})"
    for f, lo, hi in (
        ("rooms", "0", "15"), ("bedrooms", "0", "12"), ("bathrooms", "0", "10"), ("garages", "0", "8"),
        ("covered_area", "(case when g then 8 when c then 10 else 10 end)", "(case when g then 100 when c then 100000 else 3000 end)"),
        ("land_area", "(case when g then 8 when c then 10 else 20 end)", "(case when g then 100 when c then 100000 when big then 100000 else 10000 end)"),
        ("total_area", "(case when g then 8 when c then 10 else 20 end)", "(case when g then 100 when c then 100000 when big then 100000 else 10000 end)"),
    )
)
_LISTING_RE = "/inmuebles(-|$)|/inmuebles-[^/]+\\.html$|/pagina-[0-9]+|/ciudad/|/tipo-de-propiedad/"
shared(
    "rule_rows",
    f"""{_RANGE_SQL} union all select property_id, 'operation', operation, 'no es venta', 'operation' from visible where operation <> 'sale'
      union all select property_id, 'price', cast(price as varchar), 'fuera de rango 1000-5000000', 'price' from visible where currency='USD' and not (price between 1000 and 5000000)
      union all select p.property_id, 'url', p.url, 'parece pagina de listado, no ficha', 'listing_page' from primary_listing p where p.property_id in (select property_id from visible)
        and p.property_id in (select property_id from v_listing where regexp_matches(regexp_extract(url, '^https://[^/]+(/.*)$', 1), '{_LISTING_RE}'))
      union all select property_id, 'source_status', source_status, 'tabla estructurada contradice descripcion', 'source_conflict' from v_listing
        where source_status = 'metric_conflict_review' and property_id in (select property_id from visible)""",
    "visible",
    "primary_listing",
)


@query("rule_anomalies", "Q5", oracle="select * from rule_rows", uses=("rule_rows",))
def rule_anomalies(spark, folder):
    return A.rule_anomalies(visible(spark, folder), listings(spark, folder))


shared(
    "iqr_rows",
    f"""select property_id, 'modelo IQR/MAD' as field, cast({rnd('v', 0)} as bigint) as value, concat('USD/m2 atipico en ', zone, ' (', property_type, ')') as reason, 'iqr_mad' as model,
        cast(greatest(1, least(100, {rnd('100*(case when z<>0 then abs(z)/5 else (case when v<lo or v>hi then least(abs(v-lo),abs(v-hi)) else abs(z) end)/greatest(1,med) end)', 0)})) as int) as severity
      from (select *, q1-1.5*(q3-q1) as lo, q3+1.5*(q3-q1) as hi, case when mad=0 then 0.0 else 0.6745*(v-med)/mad end as z from
        (select *, quantile_cont(abs(v-med), 0.5) over (partition by zone, property_type) as mad from
          (select property_id, zone, property_type, v, count(*) over w as n, quantile_cont(v,0.25) over w as q1, quantile_cont(v,0.5) over w as med, quantile_cont(v,0.75) over w as q3
            from (select property_id, coalesce(geo_zone, nullif(locality,''), 'Sin zona') as zone, property_type, price_m2 as v from visible where price_m2 is not null)
            window w as (partition by zone, property_type))) where n >= 7) where v < lo or v > hi or abs(z) >= 3.5""",
    "visible",
)


@query("iqr_mad_outliers", "Q6", oracle="select * from iqr_rows", uses=("iqr_rows",))
def iqr_mad_outliers(spark, folder):
    return A.iqr_mad_outliers(visible(spark, folder))


shared(
    "points",
    "select *, comparable_area::double as area, valid_price::double as cost from visible where currency='USD' and valid_price is not null and comparable_area is not null",
    "visible",
)
shared(
    "fit",
    """select property_type, condition_category, age_band, n, slope, intercept, std from (select p.property_type, p.condition_category, p.age_band, max(n) as n, max(slope) as slope, max(intercept) as intercept,
        stddev_samp(cost - (slope*area+intercept)) as std from points p join (select property_type, condition_category, age_band, count(*) as n, regr_slope(cost, area) as slope, regr_intercept(cost, area) as intercept
          from points group by 1,2,3 having count(*)>=5) f on p.property_type=f.property_type and p.condition_category=f.condition_category and p.age_band=f.age_band where slope is not null group by 1,2,3)""",
    "points",
)


@query(
    "hedonic_fit",
    "Q7",
    oracle=f"select property_type, condition_category, age_band, n, {rnd('slope', 4)} as slope, {rnd('intercept', 3)} as intercept, {rnd('std', 3)} as std from fit",
    uses=("fit",),
)
def hedonic_fit(spark, folder):
    fit = A.hedonic_fit(visible(spark, folder))
    return fit.select(*A.GROUP, "n", N.round_stat("slope", 4).alias("slope"), N.round_stat("intercept", 3).alias("intercept"), N.round_stat("std", 3).alias("std"))


shared(
    "expected",
    """select *, (expected-cost)/expected*100 as discount, cost-expected as delta, cast(round(cast(cost/area as decimal(28,8)),2) as double) as point_m2 from
        (select p.*, c.n as comparables, case when slope*area+intercept > 0 then slope*area+intercept end as expected from points p
          join (select property_type, condition_category, age_band, count(*) as n from points where area>0 and cost>0 group by 1,2,3) c using (property_type, condition_category, age_band)
          left join (select property_type, condition_category, age_band, slope, intercept from fit) f using (property_type, condition_category, age_band) where area>0 and cost>0)""",
    "fit",
)


@query(
    "expected_price",
    "Q8,O4",
    oracle=f"select property_id, {rnd('expected',3)} as expected, {rnd('discount',4)} as discount, comparables, point_m2 from expected order by last_seen_on desc, property_id limit 220",
    uses=("expected",),
)
def expected_price(spark, folder):
    df = A.expected_price(visible(spark, folder))
    return df.select("property_id", N.round_stat("expected", 3).alias("expected"), N.round_stat("discount", 4).alias("discount"), "comparables", "point_m2")


shared(
    "reg_rows",
    f"""select property_id, 'regresion comparable' as field, cast({rnd('r',0)} as bigint) as value, concat('precio ', case when r<0 then 'por debajo' else 'por encima' end, ' de comparables: ', property_type, ' / ', condition_category, ' / ', age_band) as reason,
      'regression' as model, cast(greatest(1, least(100, {rnd('100*abs(r)/greatest(1, std*3)', 0)})) as int) as severity from
      (select p.*, std, cost-(slope*area+intercept) as r from points p join fit using (property_type, condition_category, age_band) where std > 0) where abs(r) >= 1.8*std""",
    "fit",
)


@query("regression_anomalies", "Q9", oracle="select * from reg_rows", uses=("reg_rows",))
def regression_anomalies(spark, folder):
    return A.regression_anomalies(visible(spark, folder))


shared(
    "model_rows",
    "select *, 0 as rank from iqr_rows union all select *, 1 as rank from reg_rows",
    "iqr_rows",
    "reg_rows",
)


@query(
    "model_anomalies",
    "Q10,W7,O4",
    oracle="select property_id, field, reason, rank, value, model, severity from model_rows order by rank, property_id, reason limit 80",
    uses=("model_rows",),
)
def model_anomalies(spark, folder):
    return A.model_anomalies(visible(spark, folder), shown=80)


@query(
    "anomaly_summary",
    "A15",
    oracle=f"""with r as (select property_id, case when category='source_conflict' then 'source_conflict' else 'rules' end as model, case when category in ('price','range') then 70 else 55 end as severity from rule_rows
        union all select property_id, model, severity from model_rows)
      select m.model, count(r.property_id) as total, cast(coalesce({rnd('avg(severity)',0)},0) as bigint) as avg_severity, min(property_id) as first_property
      from (values ('rules'),('iqr_mad'),('regression'),('source_conflict')) m(model) left join r using (model) group by m.model""",
    uses=("rule_rows", "model_rows"),
)
def anomaly_summary(spark, folder):
    df = visible(spark, folder)
    rules = A.rules_as_models(A.rule_anomalies(df, listings(spark, folder)))
    return A.anomaly_summary(rules.unionByName(A.model_anomalies(df).select("property_id", "field", "model", "severity")))


@query(
    "dashboard_quality",
    "A9",
    oracle="""with a as (select property_id from rule_rows union select property_id from model_rows), c as (select count(*) as total, count(valid_price) as price, count(valid_area) as surface, count(*) filter (detected_address<>'' or address<>'') as address, count(latitude) as location,
        count(*) filter (has_image) as image, count(*) filter (listing_count>0) as link, count(*) filter (has_agency) as agency, count(*) filter (location_notes<>'') as notes from scored)
      select total, """ + ", ".join(f"cast(round_even({p}/total*100, 0) as int) as {p}_percent" for p in M.QUALITY_PARTS) + """, notes + (select count(*) from a) as inconsistent from c""",
    uses=("scored", "rule_rows", "model_rows"),
)
def dashboard_quality(spark, folder):
    df, adverts = visible(spark, folder), listings(spark, folder)
    odd = A.rule_anomalies(df, adverts).select("property_id").union(A.model_anomalies(df).select("property_id"))
    return M.kpi_quality(M.kpi_counts(df, S.listing_facts(adverts), "2024-04-01"), odd)


@query(
    "security_arbitrage",
    "Q11,O4",
    oracle=f"""with m as (select {q('price_m2',.5)} as med from visible where price_m2 is not null and security_coverage_score is not null),
      r as (select *, security_coverage_score as cv, security_risk_score as rk, case when security_coverage_score>=60 and price_m2<=med then 4 when security_risk_score>=55 and price_m2<=med then 3
          when security_risk_score>=55 and price_m2>med then 2 when security_coverage_score>=60 and price_m2>med*1.15 then 1 end as priority from visible, m where price_m2 is not null and security_coverage_score is not null and security_risk_score is not null)
      select property_id, ['Prima de seguridad','Sobreprecio riesgoso','Negociable por riesgo','Oportunidad segura'][priority] as kind, priority, cast({rnd('med',0)} as bigint) as median_m2, price_m2 as m2,
        security_coverage_score, security_risk_score from r where priority is not null order by priority desc, case when priority=4 then cv else rk end desc, price_m2, property_id limit 40""",
    uses=("visible",),
)
def security_arbitrage(spark, folder):
    return A.security_arbitrage(visible(spark, folder))


@query(
    "location_opportunities",
    "Q12,O4",
    oracle=f"""with m as (select {q('price_m2',.5)} as med from visible where price_m2 is not null and overall_score is not null),
      r as (select *, case when overall_score>=65 and price_m2<=med then 5 when price_m2>med*1.15 and (overall_score<50 or coalesce(flood_penalty_score,0)>=55 or coalesce(transport_score,0)<45) then 4
         when coalesce(nullif(valid_land_area,0),valid_total_area)>=300 and overall_score>=60 and coalesce(flood_penalty_score,0)<45 then 3
         when overall_score>=60 and location_confidence not in ('high','medium') then 2 end as priority from visible, m where price_m2 is not null and overall_score is not null)
      select property_id, ['','Revisión necesaria','Potencial de desarrollo','Sobreprecio con riesgo','Arbitraje territorial'][priority] as kind, priority, cast({rnd('med',0)} as bigint) as median_m2, price_m2 as m2,
        overall_score, flood_penalty_score, transport_score from r where priority is not null order by priority desc, overall_score desc, price_m2, property_id limit 30""",
    uses=("visible",),
)
def location_opportunities(spark, folder):
    return A.location_opportunities(visible(spark, folder))


@query(
    "location_ranking",
    "Q13,O4",
    oracle="select property_id, overall_score, level, zone_name, price_m2 as m2 from visible where overall_score is not null order by overall_score desc, coalesce(price_m2,0), property_id limit 40",
    uses=("visible",),
)
def location_ranking(spark, folder):
    return A.location_ranking(visible(spark, folder))


@query(
    "value_scatter",
    "Q13,O4",
    oracle=f"""select property_id, {rnd('greatest(0, least(100, overall_score + cast(property_id%9-4 as double)*0.08))', 6)} as x, price_m2 as y from visible
      where overall_score is not null and price_m2 is not null order by overall_score desc, price_m2, property_id limit 120""",
    uses=("visible",),
)
def value_scatter(spark, folder):
    return A.value_scatter(visible(spark, folder))


@query(
    "security_price_rows",
    "Q14,O4",
    oracle="""select property_id, security_coverage_score, security_risk_score, price_m2 as m2 from visible where latitude is not null and security_coverage_score is not null
      order by coalesce(security_risk_score,0) desc, coalesce(price_m2,0), property_id limit 120""",
    uses=("visible",),
)
def security_price_rows(spark, folder):
    return A.security_price_rows(visible(spark, folder))


@query(
    "opportunity_score",
    "Q15,O4",
    oracle=f"""select property_id, {rnd('score',4)} as score, {rnd('discount',4)} as discount, security_tag, territory_tag from (select e.*, discount + coalesce(greatest(0.0, 1100-point_m2)/35,0)
        + case when e.location_confidence in ('high','medium') then 8 else 0 end + quality_score/12.0::double + case when e.security_coverage_score>=60 then 8 else 0 end + case when e.security_risk_score>=55 then 4 else 0 end
        + case when e.overall_score>=65 then 10 else 0 end + case when e.flood_penalty_score>=55 then -8 else 0 end as score,
        case when e.security_coverage_score>=60 then 'Oportunidad segura' when e.security_risk_score>=55 then 'Negociable por riesgo' else 'Oportunidad' end as security_tag,
        case when e.overall_score>=65 then 'Buen contexto territorial' else '' end as territory_tag
      from expected e join (select property_id, quality_score from scored) using (property_id) where discount>3 and comparables>=5) order by score desc, property_id limit 12""",
    uses=("expected", "scored"),
)
def opportunity_score(spark, folder):
    df = M.quality_score(visible(spark, folder), S.listing_facts(listings(spark, folder)))
    return A.opportunity_score(A.expected_price(df, None))


@query(
    "under_trend",
    "Q16,O4",
    oracle=f"select property_id, {rnd('expected',4)} as expected, {rnd('delta',4)} as delta, comparables from expected where discount>3 and comparables>=5 order by expected.delta, property_id limit 80",
    uses=("expected",),
)
def under_trend(spark, folder):
    return A.under_trend(A.expected_price(visible(spark, folder), None))


@query(
    "bedrooms_vs_price",
    "Q17,O4",
    oracle="select property_id, valid_bedrooms as x, valid_price::double as y from visible where valid_bedrooms is not null and valid_price is not null order by last_seen_on desc, property_id limit 220",
    uses=("visible",),
)
def bedrooms_vs_price(spark, folder):
    keep = F.col("valid_bedrooms").isNotNull() & F.col("valid_price").isNotNull()
    cols = [F.col("valid_bedrooms").alias("x"), F.col("valid_price").cast("double").alias("y")]
    return A.latest_first(visible(spark, folder), keep, cols, 220)


@query(
    "heatmap_points",
    "Q17,O4",
    oracle="""select property_id, latitude, longitude, valid_price::double as price, coalesce(geo_zone,'Sin dato') as zone from visible where latitude is not null and valid_price is not null
      order by last_seen_on desc, property_id limit 450""",
    uses=("visible",),
)
def heatmap_points(spark, folder):
    keep = F.col("latitude").isNotNull() & F.col("valid_price").isNotNull()
    cols = ["latitude", "longitude", F.col("valid_price").cast("double").alias("price"), Q.safe_label("geo_zone").alias("zone")]
    return A.latest_first(visible(spark, folder), keep, cols, 450)
