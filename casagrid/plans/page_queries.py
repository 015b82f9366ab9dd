"""Registered queries: page extraction, exports, layers, catalogue and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from casagrid.functions.numbers import once
from casagrid.functions.text import snake_key
from casagrid.operators import audit as Q
from casagrid.operators import extract as X
from casagrid.operators import search as S
from casagrid.operators.geocode import TARGET_BOX
from casagrid.plans.inputs import base, curated, listings, rnd, view
from casagrid.plans.market_queries import visible
from casagrid.plans.registry import query, shared
from casagrid.plans.spatial_queries import SECPOINT, secpoints
from casagrid.plans.text_queries import _pick as pick
from casagrid.plans.text_queries import k as by
from casagrid.sources import io
from casagrid.sources.projections import table
from casagrid.sources.tables import spread, stored

A, B = "(1+p_partkey%90)", "(100+p_partkey%900)"
LAT = "concat('-34.', cast(5500+p_partkey%1100 as string))"
LON = "concat('-58.', cast(6100+p_partkey%900 as string))"
LD = [
    "concat('{\"@type\":\"Product\",\"name\":\"n', cast(p_partkey as string), '\"}')",
    "concat('[{\"@type\":\"Other\"},{\"@type\":[\"Place\",\"House\"],\"name\":\"n', cast(p_partkey as string), '\"}]')",
    "concat('{\"@graph\":[{\"@type\":\"House\",\"name\":\"n', cast(p_partkey as string), '\"}]}')",
    "'{broken'",
]
PIN = [
    f"concat('<div data-latitude=\"', {LAT}, '\" data-longitude=\"', {LON}, '\"></div>')",
    f"concat('<script>propertyMapData = {{\"latitude\": \"', {LAT}, '\", \"longitude\": \"', {LON}, '\"}};</script>')",
    f"concat('<div data-map=\"{{&quot;lat&quot;:', {LAT}, ',&quot;lng&quot;:', {LON}, '}}\"></div>')",
    "'<script>mapLatOf = \"LTM0LjYwMDE=\"; mapLngOf = \"LTU4LjY1MDE=\";</script>'",
    f"concat('<i>\"lat\": ', {LAT}, ', \"lng\": ', {LON}, '</i>')",
    f"concat('<b>', {LAT}, ' / ', {LON}, '</b>')",
    "'<div data-latitude=\"25.7308309\" data-longitude=\"-80.444149\"></div>'",
]
TEXT = (
    f"concat('USD ', cast({A} as string), '.', cast({B} as string), ' - 4 ambientes, ', cast(p_size%6 as string), ' dormitorios, 2 baños, ', cast(p_size%4 as string), ' cocheras. "
    f"Superficie cubierta: ', cast(p_size*8 as string), ' m2 Terreno: ', cast(p_size*20 as string), ' m2. Antigüedad: ', cast(p_size as string), ' años. ', "
    f"'Se encontraron ', cast({A} as string), '.', cast({B} as string), ' propiedades')"
)
HTML = (
    f"concat('<html><head><title>Pag</title><style>p{{}}</style><script type=\"application/ld+json\">', {pick(4, LD)}, '</script></head><body><h1>Casa &amp; jardín ', p_name, '</h1><p>', {TEXT}, '</p>', {pick(7, PIN)}, "
    f"'<img src=\"https://img.example/', cast(p_partkey as string), '.jpg\"><img src=\"/local.png\"><a href=\"/ficha/', cast(p_partkey as string), '#x\">v</a><a href=\"/ficha/', cast(p_partkey as string), '\">v</a><a href=\"https://otro.example/ficha/1\">o</a>"
    f"<a href=\"?page=', cast(1+p_partkey%40 as string), '\">s</a><a href=\"mailto:a@b\">m</a></body></html>')"
)
PAGE = [("p_partkey", "page_id"), ("concat('https://www.portal.example/venta/casa-', cast(p_partkey as string))", "url"), (HTML, "html")]
shared("v_page", "select p_partkey as page_id, p_partkey%90+1 as a, 100+p_partkey%900 as b, p_name, p_size, concat('https://www.portal.example/venta/casa-', p_partkey) as url from part")


def pages(spark, folder):
    """Advert pages as a stored table, as a crawl would leave them."""
    return stored(spark, folder, "raw_pages", lambda: spread(table(spark, folder, "part")).selectExpr(*[f"{e} as {n}" for e, n in PAGE]))


@query(
    "advert_page_fields",
    "X1,S5",
    oracle="""select page_id, concat('casa-', page_id) as external_id, concat('Casa & jardín ', p_name) as title, 'USD' as currency, (a*1000+b)::double as price, 4 as rooms, p_size%6 as bedrooms, 2.0::double as bathrooms, p_size%4 as garages,
      (p_size*8)::double as covered_area, (p_size*20)::double as total_area, (p_size*20)::double as land_area, p_size as age_years, concat('https://img.example/', page_id, '.jpg') as images, 'house' as property_type from v_page""",
    uses=("v_page",),
)
def advert_page_fields(spark, folder):
    df = X.page_fields(pages(spark, folder))
    dbl = [F.col(c).cast("double").alias(c) for c in ("price", "bathrooms", "covered_area", "total_area", "land_area")]
    return df.select("page_id", "external_id", "title", "currency", "rooms", "bedrooms", "garages", "age_years", F.array_join("images", ",").alias("images"), "property_type", *dbl)


@query("page_json_ld", "X2", oracle="select page_id, concat('n', page_id) as name from v_page where page_id%4<>3", uses=("v_page",))
def page_json_ld(spark, folder):
    return X.json_ld(pages(spark, folder), "page_id", ["House", "Product"]).select("page_id", F.get_json_object("object", "$.name").alias("name"))


_LAT, _LON = "cast(concat('-34.', 5500+page_id%1100) as double)", "cast(concat('-58.', 6100+page_id%900) as double)"
_OK = f"{_LAT} between -34.6655 and -34.5480 and {_LON} between -58.7065 and -58.6040"


@query(
    "page_pins",
    "X3,F25",
    oracle=f"""select page_id, case page_id%7 when 0 then 'data-latitude' when 1 then 'propertyMapData' when 2 then 'data-map' when 3 then 'base64_map' when 4 then 'regex_pair' else 'fallback_latlon' end as method,
      case when page_id%7=3 then -34.6001 else {_LAT} end::double as latitude, case when page_id%7=3 then -58.6501 else {_LON} end::double as longitude from v_page where page_id%7=3 or (page_id%7<>6 and {_OK})""",
    uses=("v_page",),
)
def page_pins(spark, folder):
    return X.first_coordinate(X.map_coordinates(pages(spark, folder), "page_id"), "page_id")


@query(
    "page_links",
    "X9,W4",
    oracle="select page_id, concat('https://www.portal.example/ficha/', page_id) as link, 0 as pos from v_page",
    uses=("v_page",),
)
def page_links(spark, folder):
    return X.page_links(pages(spark, folder), "page_id", [r"/ficha/\d+"])


@query(
    "crawled_page_links",
    "X9,S5",
    oracle="""select page_id, link, min(pos)-1 as pos from (select page_id, regexp_replace(h, '#.*$', '') as h0, concat(regexp_extract(url, '^(https?://[^/]+)', 1), regexp_replace(h, '#.*$', '')) as link, pos from (select page_id, url, unnest(hs) as h, generate_subscripts(hs, 1) as pos from
      (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as hs from pages)) where h like '/%') where link <> '' group by 1, 2""",
)
def crawled_page_links(spark, folder):
    df = X.page_links(table(spark, folder, "pages"), "page_id", [r"^/"])
    return df.select("page_id", "link", F.col("pos").cast("bigint").alias("pos"))


@query(
    "declared_totals",
    "X10",
    oracle=f"select page_id, a*1000+b as total, 1+page_id%40 as last_page, {rnd('500.0/(a*1000+b)*100', 1)} as coverage from v_page",
    uses=("v_page",),
)
def declared_totals(spark, folder):
    from casagrid.functions.numbers import round_stat

    df = once(once(pages(spark, folder), {"_text": X.visible_text("html")}), {"total": X.declared_total("_text").cast("bigint")})
    ratio = round_stat(F.lit(500.0) / F.col("total") * 100, 1)
    return df.select("page_id", "total", X.max_page("html").cast("bigint").alias("last_page"), ratio.alias("coverage"))


@query(
    "coverage_audit",
    "A28",
    oracle=f"""select source, declared_total, urls_found, pages_seen, {rnd('urls_found/declared_total::double*100',1)} as coverage_ratio, case when urls_found/declared_total::double*100 < 80 then 'partial' else 'ok' end as status from
      (select page_id%9 as source, cast(max(a*1000+b) as int) as declared_total, sum(a*20) as urls_found, count(*) as pages_seen from v_page group by 1)""",
    uses=("v_page",),
)
def coverage_audit(spark, folder):
    df = once(pages(spark, folder), {"_text": X.visible_text("html")})
    out = X.coverage_audit(df, F.col("page_id") % 9, F.col("_text"), (F.col("page_id") % 90 + 1) * 20)
    from casagrid.functions.numbers import round_stat

    return out.withColumn("coverage_ratio", round_stat("coverage_ratio", 1))


RAW = [
    ("l_orderkey*10+l_linenumber", "row_id"),
    ("case l_linenumber when 1 then concat(cast(5+l_orderkey%20 as string), ' x 30 mts') when 2 then '8,66 por 20' when 3 then '120 / 150 m2' when 4 then concat(cast(l_orderkey%300 as string), ' m2') when 5 then 'sin datos' when 6 then '10x' else '1.200' end", "area_text"),
    ("case l_linenumber when 1 then 'Sin cochera' when 2 then 'cochera doble' when 3 then concat(cast(l_orderkey%20 as string), ' autos') when 4 then '-3' when 5 then 'garage para 2' when 6 then 'no posee' else '' end", "garage_text"),
    ("concat('Tipo: casa Ambientes: ', cast(1+l_orderkey%6 as string), ' Estado: muy bueno Lote: ', cast(200+l_orderkey%90 as string), ' m2')", "labels_text"),
    ("case when l_linenumber<5 then concat('Unidad A', cast(l_linenumber as string), ' – 3 Ambientes con balcón Superficie total: ', cast(l_orderkey%90+20 as string), ' m2 Precio: USD ', cast(l_orderkey%90+50 as string), '.500 Unidad B – 2 Ambientes Superficie total 40 m² Precio: $ 900') else 'sin ofertas' end", "units_text"),
    ("l_linenumber", "ln"),
    ("l_orderkey", "o"),
]
shared("v_raw", "select " + ", ".join(f"{e} as {n}" for e, n in RAW) + " from lineitem")


def raw(spark, folder):
    return spread(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")).selectExpr(*[f"{e} as {n}" for e, n in RAW])


@query(
    "measured_texts",
    "X5",
    oracle="""select row_id, case ln when 1 then (5+o%20)*30 when 2 then 8.66*20 when 3 then 1201502 when 4 then o%300*10+2 when 6 then 10 when 7 then 1200 end::double as area, case ln when 1 then 5+o%20 when 2 then 8.66 end::double as front, case ln when 1 then 30 when 2 then 20 end::double as depth,
      case ln when 3 then 120 when 4 then o%300*10+2 when 7 then 1200 else -1 end::double as ranged, case ln when 1 then 0 when 2 then 1 when 3 then case when o%20<=8 then o%20 end when 5 then 2 when 6 then 0 end::int as garages from v_raw""",
    uses=("v_raw",),
)
def measured_texts(spark, folder):
    df = raw(spark, folder).withColumn("d", X.dimensions("area_text"))
    ranged = F.when(F.col("ln").isin(3, 4, 7), X.area_value("area_text").cast("double")).otherwise(-1.0)
    return df.select("row_id", "d.area", "d.front", "d.depth", ranged.alias("ranged"), X.garage_value("garage_text").cast("int").alias("garages"))


@query(
    "labeled_texts",
    "X4",
    oracle="select row_id, 'casa' as kind, cast(1+o%6 as varchar) as rooms, 'muy bueno' as state, concat(200+o%90, ' m2') as lot, (200+o%90)::double as lot_m2 from v_raw",
    uses=("v_raw",),
)
def labeled_texts(spark, folder):
    labels = {"kind": ("Tipo",), "rooms": ("Ambientes",), "state": ("Estado",), "lot": ("Lote",)}
    fields = X.labeled_fields("labels_text", labels)
    return raw(spark, folder).select("row_id", *[c.alias(n) for n, c in fields.items()], X.number_after("labels_text", "Lote").cast("double").alias("lot_m2"))


@query(
    "unit_offers",
    "X6",
    oracle="""select row_id, 0 as pos, concat('A', ln) as unit, 3 as rooms, (o%90+20)::double as total_area, 'USD' as currency, ((o%90+50)*1000+500)::double as price from v_raw where ln<5
      union all select row_id, 1, 'B', 2, 40.0, 'ARS', 900.0 from v_raw where ln<5""",
    uses=("v_raw",),
)
def unit_offers(spark, folder):
    return X.unit_offers(raw(spark, folder), "row_id", "units_text")


@query(
    "metric_conflicts",
    "X7",
    oracle="""select property_id, 'price' as field, price::double as structured, 77000.0::double as in_text from v_property where price is not null and price<>77000
      union all select property_id, 'covered_area', covered_area::double, 120.0 from v_property where covered_area is not null and covered_area<>120
      union all select property_id, 'land_area', land_area::double, 300.0 from v_property where land_area is not null and land_area<>300""",
    uses=("v_property",),
)
def metric_conflicts(spark, folder):
    text = F.lit("Precio USD 77.000. SUP CUBIERTA: 120 m2 SOBRE LOTE de 10x30 (300 m2)")
    return X.metric_conflicts(view(spark, folder, "v_property").withColumn("text", text), "property_id", "text")


@query(
    "hidden_prices",
    "X8",
    oracle="""select property_id, case when r is null then price end::double as price, case when r is not null or price is null then '' else currency end as currency, coalesce(r,'') as hidden_reason from
      (select *, case when price=1 then 'placeholder_price_1' when currency='ARS' and price<1000 then 'ars_placeholder_price' when status<>'active' and currency='ARS' and price is not null then 'non_active_ars_price' end as r
         from (select property_id, status, currency, case when property_id%50=0 then 1 when property_id%30=0 then 500 else price end as price from v_property))""",
    uses=("v_property",),
)
def hidden_prices(spark, folder):
    price = F.when(F.col("property_id") % 50 == 0, 1).when(F.col("property_id") % 30 == 0, 500).otherwise(F.col("price"))
    df = X.hide_placeholder_price(view(spark, folder, "v_property").withColumn("price", price.cast("decimal(16,2)")))
    return df.select("property_id", F.col("price").cast("double").alias("price"), "currency", "hidden_reason")


_STATUS = "case o_orderkey%6 when 0 then 404 when 1 then 403 when 2 then 500 else 200 end"
_BODY = "case when o_orderkey%6=3 then 'Aviso TERMINADO' when o_orderkey%6=4 then 'Request blocked by cloudfront' else 'ok' end"


@query("fetch_outcomes", "X11", oracle=f"select o_orderkey as run_id, case o_orderkey%6 when 0 then 'gone' when 1 then 'blocked' when 2 then 'error' when 3 then 'gone' when 4 then 'blocked' else 'ok' end as outcome from orders")
def fetch_outcomes(spark, folder):
    df = table(spark, folder, "orders").selectExpr("o_orderkey as run_id", f"{_STATUS} as status", f"{_BODY} as body")
    return df.select("run_id", X.fetch_outcome("status", "body").alias("outcome"))


@query(
    "target_area_pages",
    "F24,G18",
    oracle="select property_id from v_property where contains(lower(concat(title,' ',locality,' ',detected_locality)), 'hurlingham') or contains(lower(concat(title,' ',locality,' ',detected_locality)), 'villa tesei') or contains(lower(concat(title,' ',locality,' ',detected_locality)), 'william c. morris')",
    uses=("v_property",),
)
def target_area_pages(spark, folder):
    text = F.concat_ws(" ", "title", "locality", "detected_locality")
    return view(spark, folder, "v_property").filter(X.in_target_text(text)).select("property_id")


_TYPES = by([f"'{v}'" for v in ("Casa", "Departamento", "PH", "Dúplex", "Terreno", "Quinta", "Otro")], 7)


# What territory and location scoring add to the curated table.
_TERRITORY = [
    ("case when property_id%9=0 then '' else 'Hurlingham' end", "inferred_municipality"),
    ("case property_id%3 when 0 then 'high' when 1 then 'medium' else '' end", "territory_confidence"),
    ("property_id%4=0", "territory_needs_review"),
    ("concat('m', cast(property_id%3 as string))", "territory_method"),
    ("case when property_id%5=0 then '' else 'Hurlingham' end", "intel_municipality"),
    ("case when property_id%5=1 then '' else locality end", "intel_locality"),
    ("case property_id%3 when 0 then 'coordinates' when 1 then 'zone' else '' end", "match_method"),
    ("case when property_id%6=0 then null else cast(property_id%101 as double) end", "education_score"),
    ("case when property_id%7=0 then null else cast(property_id*3%101 as double) end", "health_score"),
]
_YES = {"revision_territorial": "territory_needs_review", "conflicto_zona": "zone_conflict", "zona_requiere_revision": "zone_needs_review", "favorita": "is_favorite", "oculta": "is_hidden", "revisada": "is_reviewed"}


def _labels(column: str, labels: dict) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in labels.items()) + " end"


_EXPORT_SQL = {
    **{name: f"t.{source}" for name, source in io.EXPORT_COLUMNS.items() if source},
    **{name: f"case when t.{c} then 'Si' else 'No' end" for name, c in _YES.items()},
    "tipo": _TYPES.replace("property_id", "t.property_id"), "condicion": _labels("condition_category", io.CONDITION_LABELS), "fuente_localizacion": _labels("location_source", io.SOURCE_LABELS),
    "confianza_localizacion": _labels("location_confidence", io.CONFIDENCE_LABELS), "riesgo_hidrico": "case when in_flood_risk_zone is null then '' when in_flood_risk_zone then 'Si' else 'No' end",
    "inmobiliaria": "coalesce(c_name,'')", "fuente": "coalesce(s_name,'')", "link_original": "coalesce(p.url,'')",
}
_MONEY = ("precio", "precio_m2", "banos", "cubierta_m2", "terreno_m2")


@query(
    "export_rows",
    "S7",
    oracle=f"""select {', '.join(f"({_EXPORT_SQL[n]})::double as {n}" if n in _MONEY else f"{_EXPORT_SQL[n]} as {n}" for n in io.EXPORT_COLUMNS)}
      from (select v.*, {', '.join(f'{e} as {n}' for e, n in _TERRITORY)} from visible v) t left join primary_listing p on p.property_id=t.property_id left join supplier on s_suppkey=p.source_id left join customer on c_custkey=p.agency_id""",
    uses=("visible", "primary_listing"),
)
def export_rows(spark, folder):
    best = S.primary_listing(listings(spark, folder), "source_id", "agency_id", "url")
    names = best.join(table(spark, folder, "supplier").selectExpr("s_suppkey as source_id", "s_name as source_name"), "source_id", "left")
    names = names.join(table(spark, folder, "customer").selectExpr("c_custkey as agency_id", "c_name as agency_name"), "agency_id", "left").select("property_id", "url", "source_name", "agency_name")
    rows = visible(spark, folder).selectExpr("*", *[f"{e} as {n}" for e, n in _TERRITORY])
    return io.export_rows(rows, names).withColumns({c: F.col(c).cast("double") for c in _MONEY})


@query(
    "map_features",
    "S8",
    oracle="""select property_id, concat('{"type":"Feature","geometry":{"type":"Point","coordinates":[', longitude, ',', latitude, ']},"properties":{"property_id":', property_id, ',"property_type":"', property_type, '"}}') as feature from base where latitude is not null""",
    uses=("base",),
)
def map_features(spark, folder):
    return io.feature_rows(base(spark, folder), ["property_id", "property_type"])


@query(
    "layer_parts",
    "S2",
    oracle="""select p_partkey as feature_idx, 0 as part, concat('Zona ', p_partkey) as name, case when p_partkey%4=1 then 2 else 1 end as rings, 5 as first_ring from part where p_partkey%6 not in (0,3)
      union all select p_partkey, x, concat('Zona ', p_partkey), 1, 5 from part, (values (0),(1)) t(x) where p_partkey%6=3""",
)
def layer_parts(spark, folder):
    """Features written as layer text by Spark, read back through the layer rules."""
    ring = "concat('[[', p_partkey%50, ',1],[', p_partkey%50+1, ',1],[', p_partkey%50+1, ',2],[', p_partkey%50, ',2]]')"
    hole = "case when p_partkey%4=1 then ',[[0.1,1.1],[0.2,1.1],[0.2,1.2],[0.1,1.1]]' when p_partkey%4=2 then ',[[0,0],[1,1]]' else '' end"
    df = table(spark, folder, "part").selectExpr(
        "p_partkey as feature_idx",
        "map('name', case when p_partkey%6=0 then '' else concat(' Zona  ', p_partkey) end) as properties",
        f"case when p_partkey%6=3 then named_struct('type','MultiPolygon','coordinates', concat('[[', {ring}, '],[', {ring}, ']]')) else named_struct('type','Polygon','coordinates', concat('[', {ring}, {hole}, ']')) end as geometry",
    )
    rows = io.layer_rows(df, "zona")
    return rows.select("feature_idx", "part", "name", F.size("rings").alias("rings"), F.size(F.get("rings", F.lit(0))).alias("first_ring"))


@query(
    "catalog_refresh",
    "S9",
    oracle="""select coalesce(c.file_path, s.file_path) as file_path, coalesce(s.n, c.n) as feature_count, coalesce(s.g, c.g) as geometry_type, concat_ws('; ', nullif(c.notes,''), nullif(s.error,'')) as notes from
      (select concat('f', p_partkey) as file_path, p_size as n, 'Polygon' as g, case when p_partkey%3=0 then 'nota' else '' end as notes from part) c full join
      (select concat('f', s_suppkey*50) as file_path, cast(s_nationkey as int) as n, 'Point' as g, case when s_suppkey%2=0 then 'error' else '' end as error from supplier) s on s.file_path=c.file_path""",
)
def catalog_refresh(spark, folder):
    catalog = table(spark, folder, "part").selectExpr("concat('f', p_partkey) as file_path", "p_size as feature_count", "'Polygon' as geometry_type", "case when p_partkey%3=0 then 'nota' else '' end as notes")
    stats = table(spark, folder, "supplier").selectExpr("concat('f', s_suppkey*50) as file_path", "cast(s_nationkey as int) as feature_count", "'Point' as geometry_type", "case when s_suppkey%2=0 then 'error' else '' end as error")
    return io.refresh_catalog(catalog, stats)


@query("header_keys", "T4,S3", oracle="select p_partkey as property_id, concat('ano_de_', replace(p_name, ' ', '_')) as header from part")
def header_keys(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("property_id"), snake_key(F.concat(F.lit(" Año de-"), "p_name", F.lit(" ("))).alias("header"))


@query(
    "residual_by_source",
    "A30",
    oracle="""select coalesce(cast(source_id as varchar), 'sin fuente') as source, count(*) as total, count(*) filter (not is_reviewed) as pending, count(*) filter (inferred_zone='') as without_zone, count(*) filter (address='') as without_address
      from v_property left join (select distinct property_id, source_id from v_listing) using (property_id) group by 1""",
    uses=("v_property", "v_listing"),
)
def residual_by_source(spark, folder):
    return Q.residual_by_source(view(spark, folder, "v_property"), listings(spark, folder))


_TESTS = {"sin_coordenadas": "latitude is null", "fuera_partido": "inferred_locality=''", "sin_zona": "inferred_locality<>'' and inferred_zone=''", "conflicto_texto_poligono": "zone_conflict", "alias_viejo": "false"}


@query(
    "territory_audit",
    "A31,W14",
    oracle=" union all ".join(
        f"select '{n}' as defect, count(*) as total, coalesce((select string_agg(property_id, ',' order by property_id) from (select property_id from base where {t} order by property_id limit 5)), '') as sample from base where {t}" for n, t in _TESTS.items()
    ),
    uses=("base",),
)
def territory_audit(spark, folder):
    return Q.defects(base(spark, folder), Q.territory_tests(), "property_id")


shared("v_secpt", "select " + ", ".join(f"{e} as {n}" for e, n in SECPOINT) + " from customer")


@query(
    "layer_profile",
    "A34",
    oracle="""select count(*) as features, (select string_agg(distinct point_type, ',' order by point_type) from v_secpt) as geometry_types, min(latitude) as south, max(latitude) as north, min(longitude) as west, max(longitude) as east, count(*) filter (latitude is null) as empty,
      count(*) filter (latitude < -34.6655 or latitude > -34.5480 or longitude < -58.7065 or longitude > -58.6040) as out_of_bounds, (select count(*) from (select point_id%700 from v_secpt group by 1 having count(*)>1)) as duplicate_labels from v_secpt""",
    uses=("v_secpt",),
)
def layer_profile(spark, folder):
    df = secpoints(spark, folder).withColumn("label", F.col("point_id") % 700)
    return Q.layer_profile(df, F.col("point_type"), "label", TARGET_BOX)


@query(
    "infrastructure_check",
    "Q20",
    oracle="select count(*) as points, count(*) filter (point_type not in ('camera','safe_stop','plate_reader')) as unknown_types, count(*) filter (not (latitude between -34.6655 and -34.5480 and longitude between -58.7065 and -58.6040)) as out_of_bounds, count(*) filter (not (point_id%130 between 0 and 100)) as bad_scores from v_secpt",
    uses=("v_secpt",),
)
def infrastructure_check(spark, folder):
    return Q.infrastructure_check(secpoints(spark, folder), ["camera", "safe_stop", "plate_reader"], TARGET_BOX, F.col("point_id") % 130)


@query(
    "hierarchy_check",
    "G21",
    oracle="""with n as (select concat('n', s_suppkey) as name, case when s_suppkey%3=0 then 'partido' when s_suppkey%3=1 then 'localidad' else 'zona' end as level, case when s_suppkey%3=0 then null when s_suppkey%10=4 then 'perdido' when s_suppkey%10=5 then 'n2' else concat('n', s_suppkey-1) end as parent from supplier),
      a as (select concat('a', c_custkey%400) as alias, concat('n', c_custkey%130) as target from customer), p as (select n.*, q.level as pl from n left join n q on q.name=n.parent where n.parent is not null)
      select 'unknown_parent' as defect, name from p where pl is null union all select 'wrong_level', name from p where pl <> case level when 'zona' then 'localidad' else 'partido' end
      union all select 'unknown_alias_target', alias from a where target not in (select name from n) union all select 'ambiguous_alias', alias from a group by alias having count(distinct target)>1""",
)
def hierarchy_check(spark, folder):
    nodes = table(spark, folder, "supplier").selectExpr(
        "concat('n', s_suppkey) as name",
        "case when s_suppkey%3=0 then 'partido' when s_suppkey%3=1 then 'localidad' else 'zona' end as level",
        "case when s_suppkey%3=0 then null when s_suppkey%10=4 then 'perdido' when s_suppkey%10=5 then 'n2' else concat('n', s_suppkey-1) end as parent",
    )
    aliases = table(spark, folder, "customer").selectExpr("concat('a', c_custkey%400) as alias", "concat('n', c_custkey%130) as target")
    return Q.hierarchy_check(nodes, aliases, {"zona": "localidad", "localidad": "partido"})


@query(
    "zones_with_metrics",
    "J17",
    oracle="""select z.zone, m.score from (select distinct concat('Zona-', p_partkey%60) as zone, concat('zona', p_partkey%60) as k from part) z left join (select k, arg_min(score, ord) as score from (select concat('zona', s_suppkey%45) as k, s_suppkey as ord, s_nationkey as score from supplier) group by 1) m using (k)""",
)
def zones_with_metrics(spark, folder):
    from casagrid.functions.text import text_key

    zones = table(spark, folder, "part").selectExpr("concat('Zona-', p_partkey%60) as zone").distinct().withColumn("k", text_key("zone"))
    metrics = table(spark, folder, "supplier").selectExpr("concat('ZONA ', s_suppkey%45) as name", "s_suppkey as ord", "s_nationkey as score")
    first = metrics.groupBy(text_key("name").alias("k")).agg(F.min_by("score", "ord").alias("score"))
    return zones.join(first, "k", "left").select("zone", "score")


@query("curated_zone_labels", "T39,F5", oracle="select geo_zone, count(*) as total from curated where geo_zone is not null group by 1", uses=("curated",))
def curated_zone_labels(spark, folder):
    return curated(spark, folder).filter(F.col("geo_zone").isNotNull()).groupBy("geo_zone").agg(F.count(F.lit(1)).alias("total"))
