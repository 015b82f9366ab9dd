"""Registered queries: search filters, sorts, listing joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from casagrid.functions.numbers import round_stat
from casagrid.operators import search as S
from casagrid.plans.inputs import base, curated, listings, rnd, view
from casagrid.plans.registry import query, shared
from casagrid.sources.projections import table
from casagrid.sources.tables import spread

ZONES = [f"Zona {i}" for i in range(16)] + [S.CENTRE_ZONE]
VISIBLE = "status = 'active' and operation = 'sale' and not is_hidden"


def ids(df):
    return df.select("property_id")


def facet(name: str, covers: str, params: dict, where: str, use_listings: bool = False, extra: tuple = ()):
    uses = ("curated", *(("v_listing",) if use_listings else ()))

    @query(name, covers, oracle=f"select property_id from curated where {where}", uses=uses)
    def run(spark, folder):
        adverts = listings(spark, folder) if use_listings else None
        return ids(S.search(curated(spark, folder), params, adverts, ZONES))

    return run


facet("search_visible", "F1", {}, VISIBLE)
facet("search_show_all", "F1", {"show_non_sale": "1", "show_hidden": "1", "status": ["active", "reserved"]}, "status in ('active','reserved')")
facet(
    "search_membership",
    "F2",
    {"property_type": ["house", "ph", "land"], "currency": "USD", "condition_category": ["new", "used"], "security_level": ["alta", "media"], "location_value_level": ["alta", "media", "baja"]},
    VISIBLE + " and property_type in ('house','ph','land') and currency='USD' and condition_category in ('new','used') and security_level in ('alta','media') and level in ('alta','media','baja')",
)
facet("search_locality", "F3", {"locality": ["Hurlingham", "morris"]}, VISIBLE + " and (inferred_locality in ('Hurlingham','morris') or locality in ('Hurlingham','morris') or detected_locality in ('Hurlingham','morris'))")
facet(
    "search_zone",
    "F4",
    {"neighborhood": ["zona 3", "ZONA-7"]},
    VISIBLE + " and (" + " or ".join(f"{c} in ('Zona 3','Zona 7')" for c in ("inferred_zone", "neighborhood", "detected_neighborhood", "inferred_neighborhood", "zone_name")) + ")",
)
facet("search_unknown_zone", "F4", {"neighborhood": ["Zona 99"]}, "false")
facet("search_value_zone", "F5", {"location_value_zone": ["Zona 4", "Zona 9"]}, VISIBLE + " and (inferred_zone in ('Zona 4','Zona 9') or zone_name in ('Zona 4','Zona 9'))")
facet("search_zone_missing", "F6", {"zone_missing": "1"}, VISIBLE + " and coalesce(inferred_zone,'')='' and coalesce(inferred_neighborhood,'')='' and coalesce(zone_name,'')=''")
facet("search_triage", "F7", {"favorite": "1", "review_state": ["pending"]}, VISIBLE + " and is_favorite and not is_reviewed")
facet("search_location_quality", "F8", {"location_quality": ["reliable"]}, VISIBLE + " and location_confidence in ('high','medium')")
facet("search_location_unreliable", "F8", {"location_quality": ["unreliable", "detected"]}, VISIBLE + " and (location_confidence in ('low','unknown') or latitude is null or location_source<>'unknown' or address<>'' or detected_address<>'')")
facet(
    "search_ranges",
    "F9",
    {"price_min": "20000", "price_max": "120000", "security_coverage_min": "10", "land_min": "100", "bedrooms_max": "4", "age_max": "x"},
    VISIBLE + " and price between 20000 and 120000 and security_coverage_score >= 10 and land_area >= 100 and bedrooms <= 4",
)
facet(
    "search_score_ranges",
    "F9",
    {"location_score_min": "30", "transport_score_min": "20", "flood_penalty_max": "80", "settlement_near_max": "1500", "garages_min": "1", "bathrooms_min": "2"},
    VISIBLE + " and overall_score >= 30 and transport_score >= 20 and flood_penalty_score <= 80 and nearest_settlement_m <= 1500 and garages >= 1 and bathrooms >= 2",
)
facet("search_flood_yes", "F10", {"location_flood_risk": "yes"}, VISIBLE + " and in_flood_risk_zone")
facet("search_flood_no", "F10", {"location_flood_risk": "no"}, VISIBLE + " and not in_flood_risk_zone")
facet("search_features", "F11", {"feature": ["pileta", "Parrilla"]}, VISIBLE + " and (feature_text ilike '%pileta%' or description ilike '%pileta%' or feature_text ilike '%parrilla%' or description ilike '%parrilla%')")
facet("search_title", "F12", {"title": "COCHERA"}, VISIBLE + " and title ilike '%cochera%'")
facet("search_words", "F13", {"q": "galpon indust cred"}, VISIBLE + " and strip_accents(lower(concat(' ',title,' | ',description,' | ',address,' | ',locality,' | ',neighborhood,' | ',feature_text))) like '% galpon%' and strip_accents(lower(concat(' ',title))) like '% indust%' and strip_accents(lower(concat(' ',description))) like '% cred%'")
facet("search_bounds", "F14,U3", {"south": "-34.65", "west": "-58.69", "north": "-34.60", "east": "-58.62"}, VISIBLE + " and latitude between -34.65 and -34.60 and longitude between -58.69 and -58.62")
facet(
    "search_polygon",
    "F16,G3",
    {"polygon": [[-58.69, -34.65], [-58.63, -34.65], [-58.63, -34.58], [-58.69, -34.58]]},
    VISIBLE + " and latitude between -34.65 and -34.58 and longitude between -58.69 and -58.63",
)
facet("search_price_m2", "F17", {"price_m2_min": "900", "price_m2_max": "2500.5"}, VISIBLE + " and price_m2 between 900 and 2500.5")
for _f, _test in (
    ("price", "valid_price is not null"),
    ("surface", "valid_area is not null"),
    ("location", "latitude is not null"),
    ("address", "(address <> '' or detected_address <> '')"),
):
    facet(f"search_{_f}_present", "F18", {"quality_field": _f, "quality_state": "present"}, f"{VISIBLE} and {_test}")
    facet(f"search_{_f}_missing", "F18", {"quality_field": _f, "quality_state": "missing"}, f"{VISIBLE} and not ({_test})")
for _f, _test in (("image", "image_url <> ''"), ("link", "true"), ("agency", "agency_id is not null")):
    facet(f"search_{_f}_missing", "F18", {"quality_field": _f, "quality_state": "missing"}, f"{VISIBLE} and not exists (select 1 from v_listing l where l.property_id = curated.property_id and {_test})", use_listings=True)
facet("search_agency_source", "J2", {"agency": ["3", "5"], "source": ["1"]}, VISIBLE + " and property_id in (select property_id from v_listing where agency_id in (3,5)) and property_id in (select property_id from v_listing where source_id in (1))", use_listings=True)


@query(
    "search_radius",
    "F15,G1,G5",
    oracle=f"""select property_id, {rnd('d', 6)} as distance_km from (select *, 2*6371.0088*asin(sqrt(pow(sin(radians(latitude+34.62)/2),2)
      + cos(radians(-34.62))*cos(radians(latitude))*pow(sin(radians(longitude+58.66)/2),2))) as d from curated where {VISIBLE}) where d <= 2.5""",
    uses=("curated",),
)
def search_radius(spark, folder):
    df = S.search(curated(spark, folder), {"radius_lat": "-34.62", "radius_lng": "-58.66", "radius_km": "2.5"})
    return df.select("property_id", round_stat("distance_km", 6).alias("distance_km"))


_WORD = "concat(' ', regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(
    "documents_word_search",
    "F13",
    oracle=f"select doc_id from documents where contains({_WORD}, ' le') and contains({_WORD}, ' tion')",
)
def documents_word_search(spark, folder):
    return spread(table(spark, folder, "documents")).filter(S.text_predicate("Lé tion", "text")).select("doc_id")


@query(
    "documents_index_search",
    "F13",
    oracle=f"select doc_id from documents where contains({_WORD}, ' the') and contains({_WORD}, ' an')",
)
def documents_index_search(spark, folder):
    index = S.token_index(spread(table(spark, folder, "documents")), "doc_id", "text")
    return S.search_index(index, "doc_id", "the an")


@query(
    "nearby_eligible",
    "F19,J7",
    oracle="""select property_id from base where operation='sale' and status='active' and not is_hidden and not outside_target
      and precision_kind in ('exact','manual') and ((currency='USD' and price between 1000 and 5000000) or (currency<>'USD' and price>0))
      and (precision_kind='manual' or manually_corrected or location_confidence in ('high','medium'))
      and property_type in ('house','apartment','ph') and bedrooms >= 1
      and property_id in (select property_id from v_listing where active)""",
    uses=("base", "v_listing"),
)
def nearby_eligible(spark, folder):
    return ids(S.nearby_eligible(base(spark, folder), listings(spark, folder), ["house", "apartment", "ph"], bedrooms_min=1))


@query(
    "suspicious_price_adverts",
    "F22",
    oracle="""select listing_id, property_id, url from v_listing join (select property_id, price, currency, status from v_property) using (property_id)
      where price = 1 or price is null or currency = 'ARS' or status <> 'active' or source_status <> ''""",
    uses=("v_property", "v_listing"),
)
def suspicious_price_adverts(spark, folder):
    return S.suspicious_prices(view(spark, folder, "v_property"), listings(spark, folder)).select("listing_id", "property_id", "url")


@query(
    "unblocked_adverts",
    "F23",
    oracle="select source_id, cast(count(*) as bigint) as adverts from v_listing where source_id not in (2, 5) group by source_id",
    uses=("v_listing",),
)
def unblocked_adverts(spark, folder):
    kept = listings(spark, folder).filter(~F.col("source_id").isin(2, 5))
    return kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("adverts"))


SORTS = "-price_m2,title,-area,bathrooms"


@query(
    "sorted_first_page",
    "O1,O2,O3",
    oracle=f"""select row_number() over (order by price_m2 desc nulls last, lower(title) asc nulls last,
        coalesce(nullif(land_area,0), nullif(total_area,0), covered_area) desc nulls last, bathrooms asc nulls last, property_id) as position, property_id
      from curated where {VISIBLE} qualify position <= 48""",
    uses=("curated",),
)
def sorted_first_page(spark, folder):
    df = S.search(curated(spark, folder), {})
    return S.numbered_top(df, S.order_columns(df, SORTS), 48).select("position", "property_id")


@query(
    "sorted_second_page",
    "O3",
    oracle=f"select property_id, title from curated where {VISIBLE} order by last_seen_on desc, property_id limit 24 offset 24",
    uses=("curated",),
)
def sorted_second_page(spark, folder):
    df = S.search(curated(spark, folder), {"sort": "bogus"})
    return S.page(df, "bogus", 2).select("property_id", "title")


@query(
    "page_total",
    "O3",
    oracle=f"select cast(count(*) as bigint) as total, cast(ceil(count(*)/24.0) as bigint) as pages from curated where {VISIBLE}",
    uses=("curated",),
)
def page_total(spark, folder):
    df = S.search(curated(spark, folder), {})
    return df.agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / 24).cast("bigint").alias("pages"))


@query(
    "joined_base",
    "J1",
    oracle="select property_id, price::double as price, latitude, longitude, overall_score, level from base",
    uses=("base",),
)
def joined_base(spark, folder):
    return base(spark, folder).select(
        "property_id", F.col("price").cast("double").alias("price"), "latitude", "longitude", "overall_score", "level"
    )


shared(
    "primary_listing",
    """select property_id, source_id, agency_id, url from (select *, row_number() over (partition by property_id
        order by active desc, last_seen_on desc, listing_id, source_id desc, agency_id desc nulls last, url desc) as rn from v_listing) where rn = 1""",
    "v_listing",
)


@query(
    "primary_advert",
    "J3,J4",
    oracle="""select p.property_id, s_name as source_name, c_name as agency_name, p.url from primary_listing p
      left join supplier on s_suppkey = p.source_id left join customer on c_custkey = p.agency_id""",
    uses=("primary_listing",),
)
def primary_advert(spark, folder):
    best = S.primary_listing(listings(spark, folder), "source_id", "agency_id", "url")
    sources = table(spark, folder, "supplier").selectExpr("s_suppkey as source_id", "s_name as source_name")
    agencies = table(spark, folder, "customer").selectExpr("c_custkey as agency_id", "c_name as agency_name")
    return best.join(sources, "source_id", "left").join(agencies, "agency_id", "left").select(
        "property_id", "source_name", "agency_name", "url"
    )


@query(
    "card_image",
    "J5",
    oracle="""with img as (select property_id, image_url, url as image_listing_url, row_number() over (partition by property_id
          order by last_seen_on desc, listing_id, line_no, image_url, url) as rn from v_listing
          where active and image_url <> '' and image_url not like 'http://%'),
        alt as (select property_id, url as fallback_url, row_number() over (partition by property_id order by last_seen_on desc, listing_id, url) as rn
          from v_listing where active and url like 'https://%')
      select p.property_id, image_url, image_listing_url, fallback_url from (select distinct property_id from v_listing) p
        left join (select * from img where rn = 1) i on i.property_id = p.property_id
        left join (select * from alt where rn = 1) a on a.property_id = p.property_id""",
    uses=("v_listing",),
)
def card_image(spark, folder):
    return S.card_image(listings(spark, folder))


@query(
    "source_links",
    "J24",
    oracle="""select property_id, string_agg(entry, ',' order by entry) as links, cast(count(*) as bigint) as link_count from
      (select distinct property_id, concat(cast(source_id as varchar), ':', regexp_extract(url, '^https://([^/]+)/', 1)) as entry from v_listing) group by property_id""",
    uses=("v_listing",),
)
def source_links(spark, folder):
    entry = F.concat_ws(":", F.col("source_id").cast("string"), F.parse_url("url", F.lit("HOST")))
    rows = listings(spark, folder).select("property_id", entry.alias("entry")).distinct()
    return rows.groupBy("property_id").agg(
        F.array_join(F.array_sort(F.collect_list("entry")), ",").alias("links"), F.count(F.lit(1)).alias("link_count")
    )
