"""Registered queries: text folding, addresses, listing words, canonical adverts, URLs, geocoding joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from casagrid.functions import address as A
from casagrid.functions import text as T
from casagrid.functions import urls as U
from casagrid.operators import incidents as I
from casagrid.operators import listing as L
from casagrid.plans.inputs import base, listings, view
from casagrid.operators import aliases as V
from casagrid.plans.registry import ORACLE, query, shared
from casagrid.sources.projections import table
from casagrid.sources.tables import spread, stored

N = "(100+p_partkey%900)"
NS = f"cast({N} as string)"


def _pick(n: int, options: list[str], key: str = "p_partkey") -> str:
    return f"case {key}%{n} " + " ".join(f"when {i} then {o}" for i, o in enumerate(options[:-1])) + f" else {options[-1]} end"


RAW_ADDRESS = [
    f"concat('Av. Vergara al 1.', {NS})",
    f"concat('Jauretche  ', {NS}, ' Piso 3, Hurlingham, B1686ABC, Argentina')",
    "'Cañuelas al 0'",
    f"concat('Delfor Díaz ', {NS}, ' PB')",
    "'Roca y Jauretche'",
    "'Hurlingham, Buenos Aires'",
    f"concat('Schubert ', {NS}, ' Barrio Parque Quirno')",
    "''",
    f"concat('GÃ¼emes ', {NS})",
    "'Contacto buscador tipo de propiedad'",
]
TITLES = ["'Casa en venta '", "'Depto luminoso '", "'Lote ideal '", "'DÚPLEX moderno '", "'Hermoso PH '", "'Oficina '"]
ADVERT = [
    ("p_partkey", "property_id"),
    (_pick(10, RAW_ADDRESS), "address"),
    (f"concat({_pick(6, TITLES)}, p_name)", "title"),
    (_pick(5, ["'casa a estrenar'", "'para refaccionar, muy usado'", "'totalmente reciclada'", "'muy buen estado'", "'sin datos'"]), "description"),
    (_pick(7, ["'Hurlingham'", "'Villa Santos Tesei'", "'morris'", "'Parque Quirno'", "'Moron'", "''", "'William C. Morris'"]), "locality"),
    (_pick(8, ["'barrio ingles, Hurlingham'", "'Jhonston'", "'consultanos ya'", "'Loma Verde'", "'Km18'", "''", "'El Destino'", "'Villa Tesei | Centro'"]), "neighborhood"),
    (_pick(6, ["'U$S'", "'$'", "'ars'", "'US$ '", "'euros'", "'dólares USD'"]), "symbol"),
    ("p_size*200000", "amount"),
    (_pick(5, ["'  Inmobiliaria R&amp;S  - '", "'Ubicación y mapa'", "'Lopez Prop 120 m2 casa'", "'Perez Price: 100'", "'Gomez'"]), "agency"),
    ("p_size%7", "source_id"),
    ("p_partkey*3", "external_id"),
    ("concat('https://portal.example/', case when p_partkey%3=0 then 'alquiler/' else 'venta-' end, 'casa-', cast(p_partkey as string))", "url"),
    ("case when p_partkey%9=0 then null else -3.46e1 end", "latitude"),
    ("case when p_partkey%9=0 then null else -5.865e1 end", "longitude"),
    ("concat('USD ', cast(p_size as string), '.500,50')", "price"),
    ("cast(p_size*8 as string)", "covered_area"),
    ("case when p_partkey%5=0 then '999999999999' else cast(p_size*14 as string) end", "total_area"),
    ("'USD'", "currency"),
    ("'sale'", "operation"),
    ("''", "property_type"),
    ("''", "condition_category"),
    ("cast(p_size%6 as int)", "bedrooms"),
]
_cols = ", ".join(f"{e} as {n}" for e, n in ADVERT)
shared("v_advert", f"select *, property_id%10 as k, 100+property_id%900 as n from (select {_cols} from part)")


def adverts(spark, folder):
    """Raw adverts as a stored table, as a crawl would leave them."""
    return stored(spark, folder, "raw_adverts", lambda: spread(table(spark, folder, "part")).selectExpr(*[f"{e} as {n}" for e, n in ADVERT]))


def k(options: list[str], mod: int = 10, key: str = "property_id") -> str:
    return f"case {key}%{mod} " + " ".join(f"when {i} then {o}" for i, o in enumerate(options)) + " end"


STREET = k(["concat('Av. Vergara 1', n)", "concat('Jauretche ', n, ', Hurlingham, B1686ABC, Argentina')", "'Cañuelas 100'", "concat('Delfor Díaz ', n)", "'Roca y Jauretche'", "'Hurlingham, Buenos Aires'", "concat('Schubert ', n, ' Barrio Parque Quirno')", "''", "concat('Güemes ', n)", "'Contacto buscador tipo de propiedad'"])
NORMAL = k(["concat('avenida vergara 1', n)", "concat('jauretche ', n, ' hurlingham b1686abc argentina')", "'canuelas 100'", "concat('delfor diaz ', n)", "'roca y jauretche'", "'hurlingham buenos aires'", "concat('schubert ', n, ' barrio parque quirno')", "''", "concat('guemes ', n)", "'contacto buscador tipo de propiedad'"])
CLEAN_OF = ["concat('Av. Gdor. Vergara 1', n)", "concat('Jauretche ', n)", "'Cañuelas 100'", "concat('Dr. Delfor Díaz ', n)", "'Roca y Jauretche'", "''", "concat('Schubert ', n)", "''", "concat('Gral. Martín Güemes ', n)", "'Contacto buscador tipo de propiedad'"]
CLEAN = k(CLEAN_OF)


@query(
    "address_forms",
    "T13,T14,T16,T17,T19,T24,T25",
    oracle=f"""select property_id, {STREET} as street_number, {NORMAL} as normalized, {CLEAN} as cleaned, k not in (5,7,9) as plausible,
      {k(["'exact'", "'exact'", "'exact'", "'exact'", "'intersection'", "'street'", "'exact'", "'neighborhood'", "'exact'", "'street'"])} as precision_kind,
      {k(['1000+n', 'n', '100', 'n', 'null', 'null', 'n', 'null', 'n', 'null'])}::int as house_number,
      {k(["'avenida gobernador vergara'", "'jauretche'", "'canuelas'", "'dr delfor diaz'", "'roca'", "'hurlingham buenos aires'", "'schubert'", "''", "'general martin guemes'", "'contacto buscador tipo de propiedad'"])} as street_key,
      case when k=6 then 'Parque Quirno' else '' end as inside from v_advert""",
    uses=("v_advert",),
)
def address_forms(spark, folder):
    return adverts(spark, folder).select(
        "property_id",
        A.normalize_street_number("address").alias("street_number"),
        A.normalize_address("address").alias("normalized"),
        A.clean_address("address").alias("cleaned"),
        A.is_plausible_address("address").alias("plausible"),
        A.classify_precision("address").alias("precision_kind"),
        A.address_number("address").alias("house_number"),
        A.street_key("address").alias("street_key"),
        A.embedded_neighborhood("address").alias("inside"),
    )


@query(
    "address_spellings",
    "T15",
    oracle="""select property_id, v as variant from (select property_id, unnest(case k when 0 then [concat('Av. Gdor. Vergara 1', n)] when 3 then [concat('Dr. Delfor Díaz ', n)] when 8 then [concat('Gral. Martín Güemes ', n)] else [] end) as v from v_advert)""",
    uses=("v_advert",),
)
def address_spellings(spark, folder):
    return adverts(spark, folder).select("property_id", F.explode(A.address_variants("address")).alias("variant"))


@query("address_spellings_by_rules", "T15", oracle=ORACLE["address_spellings"])
def address_spellings_by_rules(spark, folder):
    """The same from all rules as a table."""
    found = V.alias_variants(adverts(spark, folder).select("property_id", "address"), V.street_rules(spark), "address")
    return found.select("property_id", F.explode("variants").alias("variant"))


_QUERY = k(["concat('Av. Vergara 1', n)", "concat('Jauretche ', n)", "'Cañuelas 100'", "concat('Delfor Díaz ', n)", "'Roca y Jauretche'", "null", "concat('Schubert ', n)", "null", "concat('Güemes ', n)", "null"])
_TOWN = k(["'Hurlingham'", "'Villa Tesei'", "'William C. Morris'", "'Hurlingham'", "'Hurlingham'", "'Hurlingham'", "'William C. Morris'"], 7)


@query(
    "geocode_candidates",
    "T26",
    oracle=f"""select property_id, case when q is not null then concat(q, ', ', town, ', Buenos Aires, Argentina') end as first_candidate,
      case when q is null then 0 when k in (0,3,4,8) then 6 else 3 end as candidates from (select *, {_QUERY} as q, {_TOWN} as town from v_advert)""",
    uses=("v_advert",),
)
def geocode_candidates(spark, folder):
    df = adverts(spark, folder).select("property_id", A.geocode_candidates("address", "locality").alias("c"))
    return df.select("property_id", F.get("c", F.lit(0)).alias("first_candidate"), F.size("c").alias("candidates"))


@query(
    "listing_words",
    "T8,T9,T10,T11,T12,T23",
    oracle=f"""select property_id, {k(["'house'", "'apartment'", "'land'", "'duplex'", "'ph'", "case when property_id%5=0 then 'house' else 'other' end"], 6)} as kind,
      {k(["'new'", "'needs_work'", "'renovated'", "'used'", "'unknown'"], 5)} as state, {k(["'USD'", "'ARS'", "'ARS'", "'USD'", "'EUROS'", "'USD'"], 6)} as currency,
      case when property_id%6=1 then case when amount < 5000000 then 'USD' else 'ARS' end else {k(["'USD'", "'-'", "'ARS'", "'USD'", "'EUROS'", "'USD'"], 6)} end as price_currency,
      case when property_id%6=1 then case when amount < 5000000 then 'ambiguous_sale_price_below_5000000' else 'ambiguous_sale_price_at_or_above_5000000' end else 'explicit_currency' end as price_rule,
      case when property_id%3=0 then 'rent' else 'sale' end as operation, {k(["'Inmobiliaria R&S'", "''", "'Lopez Prop'", "'Perez'", "'Gomez'"], 5)} as agency from v_advert""",
    uses=("v_advert",),
)
def listing_words(spark, folder):
    df = adverts(spark, folder)
    df = df.withColumn("r", A.resolve_currency("symbol", "amount"))
    return df.select(
        "property_id",
        A.infer_property_type("title", "description").alias("kind"),
        A.infer_condition("title", "description").alias("state"),
        A.normalize_currency("symbol").alias("currency"),
        F.col("r.currency").alias("price_currency"),
        F.col("r.rule").alias("price_rule"),
        A.detect_operation("title", "url").alias("operation"),
        A.normalize_agency("agency").alias("agency"),
    )


_HOOD = k(["'Hurlingham Centro (Barrio Ingles)'", "'Parque Johnston'", "''", "'Loma Verde'", "'Km 18'", "''", "'Barrio Destino'", "'Villa Tesei'"], 8)


@query(
    "places",
    "T18,T20",
    oracle=f"""select property_id, {_HOOD} as hood, case when property_id%8=3 then '' else {_HOOD} end as known,
      {k(["'Hurlingham'", "'Villa Tesei'", "'William C. Morris'", "''", "''", "''", "'William C. Morris'"], 7)} as town,
      {k(["'Hurlingham'", "'Hurlingham'", "''", "''", "'Hurlingham'", "''", "'Hurlingham'", "'Villa Tesei'"], 8)} as hood_town, {_TOWN} as query_town from v_advert""",
    uses=("v_advert",),
)
def places(spark, folder):
    return adverts(spark, folder).select(
        "property_id",
        A.normalize_neighborhood("neighborhood").alias("hood"),
        A.known_neighborhood("neighborhood").alias("known"),
        A.normalize_locality("locality").alias("town"),
        A.locality_from_neighborhood("neighborhood").alias("hood_town"),
        A.canonical_geocoding_locality("locality").alias("query_town"),
    )


_DISPLAY = """case when property_id%9=0 then 'Hurlingham' when property_id%7=0 then 'William C. Morris' when property_id%7 in (1,2) then 'Villa Tesei' when property_id%4=0 then 'Hurlingham'
  when property_id%4=1 then 'Villa Tesei' when property_id%4=2 then 'William C. Morris' when property_id%5 in (0,1) then 'Villa Tesei' else 'Sin dato' end"""


@query("display_locality", "T21", oracle=f"select property_id, {_DISPLAY} as display_locality from v_property", uses=("v_property",))
def display_locality(spark, folder):
    return view(spark, folder, "v_property").select("property_id", A.display_locality().alias("display_locality"))


@query("folded_documents", "T2,T3,T4", oracle="select doc_id, md5(strip_accents(lower(text))) as folded, md5(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '', 'g')) as join_key, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as squeezed from documents")
def folded_documents(spark, folder):
    docs = spread(table(spark, folder, "documents"))
    return docs.select("doc_id", F.md5(T.fold_plain("text")).alias("folded"), F.md5(T.text_key("text")).alias("join_key"), F.md5(T.squeeze("text")).alias("squeezed"))


BROKEN = [("é", "Ã©"), ("ó", "Ã³"), ("ñ", "Ã±"), ("ü", "ÃƒÂ¼")]


def _broken(spark, folder):
    text = F.col("text")
    for good, bad in BROKEN:
        text = F.replace(text, F.lit(good), F.lit(bad))
    return spread(table(spark, folder, "documents")).select("doc_id", text.alias("text"))


@query("repaired_documents", "T1", oracle="select doc_id, md5(text) as repaired from documents")
def repaired_documents(spark, folder):
    return _broken(spark, folder).select("doc_id", F.md5(T.repair_mojibake("text")).alias("repaired"))


@query(
    "mojibake_lines",
    "Q21",
    oracle="select doc_id, cast(line_no as int) as line_no from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents) where regexp_matches(line, '[éóñü]')",
)
def mojibake_lines(spark, folder):
    return L.scan_mojibake(_broken(spark, folder), "doc_id", "text")


NUMBERS = [
    ("l_orderkey*10+l_linenumber", "row_id"),
    ("1+l_orderkey%900", "a"),
    ("100+l_partkey%900", "b"),
    ("l_linenumber", "line_no"),
]
_NUM = "case line_no when 1 then concat(a,'.',b,',50') when 2 then concat(a,',',b,'.25') when 3 then concat(a,'.',b) when 4 then concat(b,',5') when 5 then concat('USD ',a,'.',b,'.',b) when 6 then concat(b,'.75') else 'consultar' end"
_MONTH = "case line_no when 1 then 'Enero' when 2 then ' SETIEMBRE ' when 3 then '11' when 4 then 'diciembre' when 5 then 's/d' when 6 then 'Mayo' else 'nan' end"
shared("v_number", "select " + ", ".join(f"{e} as {n}" for e, n in NUMBERS) + " from lineitem")


@query(
    "parsed_numbers",
    "T5,T6,T7",
    oracle="""select row_id, case line_no when 1 then a*1000+b+0.5 when 2 then a*1000+b+0.25 when 3 then a*1000+b when 4 then b+0.5 when 5 then a*1000000+b*1000+b when 6 then b+0.75 end::double as amount,
      case line_no when 1 then a*1000+b+0.5 when 3 then cast(concat(a,'.',b) as double) when 4 then b+0.5 when 6 then b+0.75 when 2 then cast(concat(a,'.',b,'25') as double) end::double as open_amount,
      case line_no when 1 then 1 when 2 then 9 when 3 then 11 when 4 then 12 when 6 then 5 end::int as month from v_number""",
    uses=("v_number",),
)
def parsed_numbers(spark, folder):
    df = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")).selectExpr(*[f"{e} as {n}" for e, n in NUMBERS]).selectExpr("row_id", f"{_NUM} as t", f"{_MONTH} as m")
    return df.select("row_id", A.parse_decimal("t").cast("double").alias("amount"), I.parse_number("t").alias("open_amount"), I.parse_month("m").alias("month"))


@query(
    "url_parts",
    "T29,J23,L18",
    oracle="""select distinct url, concat('casa-', split_part(url, '/casa-', 2)) as tail, regexp_extract(url, '^https://([^/]+)', 1) as domain, concat('casa-', split_part(url, '/casa-', 2)) as external_id,
      url like '%/inmuebles-pagina/%' as is_listing, url like '%/alquiler/%' as is_rental, concat('casa-', split_part(url, '/casa-', 2)) as mirror, url as safe, concat(regexp_extract(url, '^(https://[^/]+)', 1), '/x') as joined from v_listing""",
    uses=("v_listing",),
)
def url_parts(spark, folder):
    u = listings(spark, folder).select("url").distinct()
    return u.select(
        "url", U.url_tail("url").alias("tail"), U.url_domain("url").alias("domain"), U.external_id("url").alias("external_id"), U.is_listing_url("url").alias("is_listing"),
        U.is_rental_url("url").alias("is_rental"), U.mirror_key("url").alias("mirror"), U.safe_https_url("url").alias("safe"), U.absolute_url("url", F.lit("/x#top")).alias("joined"),
    )


@query(
    "canonical_adverts",
    "T37,T38",
    oracle=f"""select property_id, case when k in (5,7,9) then '' else {STREET} end as address, case when k in (5,7,9) then '' else {NORMAL} end as normalized_address, {k(["'house'", "'apartment'", "'land'", "'duplex'", "'ph'", "case when property_id%5=0 then 'house' else 'other' end"], 6)} as property_type,
      {k(["'new'", "'needs_work'", "'renovated'", "'used'", "'unknown'"], 5)} as condition_category, split_part(split_part(price, ' ', 2), '.', 1)::int*1000+500.5::double as price, covered_area::double as covered_area,
      case when property_id%5=0 then null else total_area::double end as total_area, case when latitude is null then null else 'map' end as map_source from v_advert""",
    uses=("v_advert",),
)
def canonical_adverts(spark, folder):
    df = L.canonicalize_listing(adverts(spark, folder))
    return df.select(
        "property_id", "address", "normalized_address", "property_type", "condition_category", F.col("price").cast("double").alias("price"), F.col("covered_area").cast("double").alias("covered_area"),
        F.col("total_area").cast("double").alias("total_area"), F.when(F.col("location_source") == "map", "map").alias("map_source"),
    )


@query(
    "fingerprints",
    "T27,T28",
    oracle="""select property_id, sha256(case when normalized_address<>'' then concat(normalized_address,'|',locality,'|',property_type,'|',coalesce(cast(covered_area as varchar),cast(total_area as varchar)))
        else concat('listing|',property_id%6,'|',property_id*3,'|u',property_id) end) as fingerprint,
      sha256(concat('{"currency":"',currency,'","property_id":',property_id,',"title":',to_json(title),'}')) as content_hash from v_property""",
    uses=("v_property",),
)
def fingerprints(spark, folder):
    df = view(spark, folder, "v_property").selectExpr("*", "property_id%6 as source_id", "property_id*3 as external_id", "concat('u', property_id) as url")
    return df.select("property_id", L.fingerprint().alias("fingerprint"), L.content_hash(["title", "currency", "property_id"]).alias("content_hash"))


_ZONE_RAW = _pick(6, ["'BARRIO INGLÉS'", "'hurlingham-centro'", "'Jhonston'", "'Loma'", "'b. ingles'", "' Villa Club '"])


@query(
    "zone_names",
    "T39,T40",
    oracle=f"""select p_partkey as property_id, {k(["'Hurlingham Centro (Barrio Ingles)'", "'Hurlingham Centro (Barrio Ingles)'", "'Parque Johnston'", "'Loma'", "'Hurlingham Centro (Barrio Ingles)'", "'Villa Club'"], 6, 'p_partkey')} as zone,
      concat('{{"a":{{"zone":"Hurlingham Centro (Barrio Ingles)","n":', p_partkey, '}},"l":["Hurlingham Centro (Barrio Ingles)","otro ingles"]}}') as payload from part""",
)
def zone_names(spark, folder):
    df = table(spark, folder, "part").selectExpr("p_partkey as property_id", f"{_ZONE_RAW} as raw", "concat('{\"a\":{\"zone\":\"Barrio Inglés\",\"n\":', p_partkey, '},\"l\":[\"ingles\",\"otro ingles\"]}') as j")
    return df.select("property_id", L.canonical_zone_name("raw").alias("zone"), L.replace_zone_in_json("j").alias("payload"))


EDIT = [
    ("l_orderkey*10+l_linenumber", "edit_id"),
    ("l_partkey", "property_id"),
    ("case l_linenumber when 1 then 'price' when 2 then 'bedrooms' when 3 then 'property_type' when 4 then 'currency' when 5 then 'covered_area' when 6 then 'title' else 'rooms' end", "field"),
    ("case l_linenumber when 1 then concat(cast(l_orderkey%90+1 as string), '.500') when 2 then case when l_orderkey%2=0 then '3' else 'tres' end when 3 then case when l_orderkey%3=0 then 'castillo' else 'ph' end when 4 then 'USD' when 5 then '' when 6 then ' Casa ' else '-4' end", "value"),
]
shared("v_edit", "select *, edit_id//10 as o, edit_id%10 as ln from (select " + ", ".join(f"{e} as {n}" for e, n in EDIT) + " from lineitem)")


@query(
    "checked_edits",
    "T41",
    oracle="""select edit_id, field, case ln when 1 then concat(o%90+1,'500.00') when 2 then case when o%2=0 then '3' end when 3 then value when 4 then 'USD' when 6 then 'Casa' end as result,
      case when ln=2 and o%2<>0 then 'valor numerico invalido' when ln=3 and o%3=0 then 'opcion invalida' when ln=7 then 'valor numerico invalido' else '' end as error from v_edit""",
    uses=("v_edit",),
)
def checked_edits(spark, folder):
    df = table(spark, folder, "lineitem").selectExpr(*[f"{e} as {n}" for e, n in EDIT])
    result, error = L.coerce_edit("field", "value")
    return df.select("edit_id", "field", result.alias("result"), error.alias("error"))


@query(
    "card_payload",
    "T42",
    oracle="""select property_id, coalesce(nullif(covered_area,0),nullif(total_area,0),land_area)::double as area_m2, case when address<>'' then address else detected_address end as address_text,
      case when address<>'' then case when override_field='address' then 'confirmed' else 'published' end when detected_address<>'' then 'detected' else 'unavailable' end as address_reliability,
      case when precision_kind='manual' or manually_corrected or provider='manual' then 'confirmed' when provider='nominatim' and regexp_matches(concat(address,' ',detected_address), '\\b[0-9]{1,6}\\b') then 'address' else 'published' end as location_reliability from base""",
    uses=("base",),
)
def card_payload(spark, folder):
    df = base(spark, folder).withColumn("p", L.address_payload(F.col("override_field") == "address"))
    return df.select("property_id", L.area_m2().cast("double").alias("area_m2"), "p.address_text", "p.address_reliability", L.location_reliability().alias("location_reliability"))


@query(
    "plain_page_text",
    "T34",
    oracle="select page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) as text from pages",
)
def plain_page_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.md5(T.squeeze(F.regexp_replace("html", "<[^>]+>", " "))).alias("text"))
