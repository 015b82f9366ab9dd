"""Market-shaped projections of the star-schema tables.

Each projection is ``base table + list of (expression, name)``. The expressions stay inside the SQL
subset that Spark and the checking engine share, so both sides of a check start from the same rows.
Every projection keeps every row of its base table: unknown values become NULL, never a dropped row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = "p_partkey"


def _case(n: int, values: dict, default: str, key: str = K) -> str:
    whens = " ".join(f"when {key}%{n}={r} then {v}" for r, v in values.items())
    return f"case {whens} else {default} end"


PROPERTY = [
    (K, "property_id"),
    (f"concat(p_name, {_case(6, {0: chr(39) + ' cochera' + chr(39), 1: chr(39) + ' galpón industrial' + chr(39), 2: chr(39) + ' casa con cochera' + chr(39)}, chr(39) + chr(39))})", "title"),
    (_case(7, {0: "'house'", 1: "'apartment'", 2: "'ph'", 3: "'duplex'", 4: "'land'", 5: "'country_house'"}, "'other'"), "property_type"),
    (f"case when {K}%11=0 then 'rent' else 'sale' end", "operation"),
    (f"case when {K}%13=0 then 'reserved' when {K}%17=0 then 'removed' else 'active' end", "status"),
    (_case(3, {0: "'new'", 1: "'used'"}, "'unknown'"), "condition_category"),
    (f"case when {K}%9=0 then null else cast({K}%60 as int) end", "age_years"),
    (f"case when {K}%10=0 then 'ARS' else 'USD' end", "currency"),
    (
        f"case when {K}%23=0 then null when {K}%97=0 then cast(p_size*90000 as decimal(16,2)) "
        "else cast(p_size*1500 + cast(p_retailprice as decimal(12,2))*50 as decimal(16,2)) end",
        "price",
    ),
    (f"case when {K}%19=0 then null else cast(p_size*8 as decimal(10,2)) end", "covered_area"),
    ("cast(p_size*14 as decimal(10,2))", "total_area"),
    (f"case when {K}%4=0 then null else cast(p_size*20 as decimal(10,2)) end", "land_area"),
    (f"case when {K}%21=0 then null else cast({K}%18 as int) end", "rooms"),
    (f"case when {K}%6=0 then null else cast(p_size%6 as int) end", "bedrooms"),
    (f"case when {K}%14=0 then null else cast({K}%13 as decimal(4,1)) end", "bathrooms"),
    (f"case when {K}%5=0 then null else cast({K}%11 as int) end", "garages"),
    ("p_brand", "neighborhood"),
    (_case(5, {0: "'Villa Tesei'", 1: "'Santos Tesei'", 2: "''"}, "p_brand"), "detected_neighborhood"),
    (_case(6, {0: "''"}, f"concat('Zona ', cast({K}%16 as string))"), "inferred_zone"),
    (_case(8, {0: "''"}, f"concat('Zona ', cast({K}%12 as string))"), "inferred_neighborhood"),
    (_case(4, {0: "'Hurlingham'", 1: "'Villa Tesei'", 2: "'William C. Morris'"}, "''"), "locality"),
    (_case(7, {0: "'morris'", 1: "'Tesei'", 2: "'Barrio Tesei Norte'"}, "''"), "detected_locality"),
    (_case(9, {0: "'Hurlingham'"}, "''"), "inferred_locality"),
    (_case(4, {0: "'high'", 1: "'medium'", 2: "'low'"}, "'unknown'"), "location_confidence"),
    (_case(5, {0: "'unknown'"}, "'listing'"), "location_source"),
    (f"case when {K}%10=3 then '' else concat('Calle ', cast({K}%40 as string), ' ', cast(100+{K}%900 as string)) end", "address"),
    (f"case when {K}%4=1 then concat('Av. Roca ', cast(100+{K}%700 as string)) else '' end", "detected_address"),
    (f"case when {K}%10=3 then '' else concat('calle ', cast({K}%40 as string), ' ', cast(100+{K}%900 as string)) end", "normalized_address"),
    (f"case when {K}%8=0 then 'con Pileta y jardín' when {K}%8=1 then 'Apto credito' else 'propiedad estándar' end", "description"),
    (f"case when {K}%12=0 then 'Quincho' when {K}%12=5 then 'Parrilla' else '' end", "feature_text"),
    (f"case when {K}%31=4 then 'Contradiccion de zonas detectadas' else '' end", "location_notes"),
    (f"{K}%29=0", "is_hidden"),
    (f"{K}%15=0", "is_favorite"),
    (f"{K}%4=1", "is_reviewed"),
    (f"{K}%6=2 and {K}%4=0", "zone_conflict"),
    (f"{K}%18=3", "zone_needs_review"),
    (f"case when {K}%7=0 then null else cast(({K}*37)%101 as double) end", "security_coverage_score"),
    (f"case when {K}%7=0 then null else cast(100-({K}*37)%101 as double) end", "security_risk_score"),
    (f"case when {K}%7=0 then '' when ({K}*37)%101>=65 then 'alta' when ({K}*37)%101>=45 then 'media' else 'baja' end", "security_level"),
    (f"date '2024-01-01' + cast({K}%150 as int)", "first_seen_on"),
    (f"date '2024-03-01' + cast({K}%90 as int)", "last_seen_on"),
    (f"case when {K}%50=7 then 'nota propia' else '' end", "personal_notes"),
    (f"case when {K}%20=0 then 'price' when {K}%20=1 then 'address' else '' end", "override_field"),
]

LOCATION = [
    (K, "property_id"),
    (f"case when {K}%8=0 then null else -3.466e1 + cast(({K}*7919)%1000 as double)*1.1e-4 end", "latitude"),
    (f"case when {K}%8=0 then null else -5.870e1 + cast(({K}*104729)%1000 as double)*1e-4 end", "longitude"),
    (f"case when {K}%8=0 then null when {K}%5=0 then 'street' when {K}%31=0 then 'manual' else 'exact' end", "precision_kind"),
    (f"case when {K}%8=0 then null else {K}%31=0 end", "manually_corrected"),
    (f"case when {K}%8=0 then null else {K}%37=0 end", "outside_target"),
    (f"case when {K}%8=0 then null when {K}%31=0 then 'manual' when {K}%3=0 then 'nominatim' else 'portal' end", "provider"),
]

INTELLIGENCE = [
    (K, "property_id"),
    (f"case when {K}%5=0 then null else cast(({K}*53)%101 as double) end", "overall_score"),
    (f"case when {K}%5=0 then '' when ({K}*53)%101>=70 then 'alta' when ({K}*53)%101>=60 then 'media_alta' when ({K}*53)%101>=45 then 'media' else 'baja' end", "level"),
    (f"case when {K}%5=0 or {K}%16=3 then '' else concat('Zona ', cast({K}%16 as string)) end", "zone_name"),
    (f"case when {K}%5=0 or {K}%6=1 then null else cast(({K}*29)%101 as double) end", "transport_score"),
    (f"case when {K}%5=0 or {K}%9=1 then null else cast(({K}*17)%101 as double) end", "flood_penalty_score"),
    (f"case when {K}%5=0 then null else cast(({K}*11)%101 as double) end", "urban_informality_score"),
    (f"case when {K}%5=0 or {K}%9=1 then null else {K}%4=2 end", "in_flood_risk_zone"),
    (f"case when {K}%5=0 then null else cast(({K}*7)%2000 as double) end", "nearest_settlement_m"),
]

_SRC = "l_suppkey%6"
LISTING = [
    ("l_orderkey*10+l_linenumber", "listing_id"),
    ("case when l_partkey%37=0 then l_partkey+1 else l_partkey end", "property_id"),
    (_SRC, "source_id"),
    ("case when l_orderkey%7=0 or l_partkey%29=0 then null else l_orderkey%40 end", "agency_id"),
    ("l_orderkey-l_linenumber", "external_id"),
    (
        f"concat('https://site', cast({_SRC} as string), '.example/', case when l_orderkey%33=0 then 'inmuebles-pagina/' "
        "when l_orderkey%33=1 then 'alquiler/' else 'ficha/' end, 'casa-', cast(l_orderkey as string), '-', cast(l_partkey as string))",
        "url",
    ),
    ("l_linestatus='O'", "active"),
    ("cast(l_linenumber%3 as int)", "missing_runs"),
    ("cast(l_shipdate as date)", "last_seen_on"),
    ("case when l_orderkey%45=0 then 'metric_conflict_review' when l_orderkey%45=1 then 'reserved' else '' end", "source_status"),
    ("cast(l_quantity as int)", "quantity"),
    ("l_linenumber", "line_no"),
    (
        "case when l_orderkey%3=0 or l_partkey%23=0 then '' when l_orderkey%11=1 then 'http://img.example/a.jpg' "
        "else concat('https://img.example/', cast(l_orderkey as string), '-', cast(l_linenumber%4 as string), '.jpg') end",
        "image_url",
    ),
]

SNAPSHOT = [
    ("l_partkey", "property_id"),
    ("cast(l_shipdate as date)", "observed_on"),
    ("l_orderkey*10+l_linenumber", "snapshot_id"),
    ("case when l_orderkey%10=0 then 'ARS' else 'USD' end", "currency"),
    ("case when l_orderkey%41=0 then null else cast(floor(l_quantity/2e1)*10000 as bigint) end", "price"),
]

TRACE = [
    ("user_id", "session_id"),
    ("event_id", "event_id"),
    ("ts", "ts"),
    ("event_type", "event_type"),
    ("-3.460e1 + cast(event_id%200 as double)*1e-4", "latitude"),
    ("-5.864e1 + cast((event_id*7)%200 as double)*1e-4", "longitude"),
    ("value", "accuracy"),
]

INCIDENT = [
    ("event_id", "event_id"),
    ("case when event_id%4=0 then 'sat_homicidios' when event_id%4=1 then 'snic_departamentos_mensual' else 'sat_propiedad' end", "source_key"),
    ("cast(2017 + event_id%8 as int)", "period_year"),
    ("cast(1 + (event_id*5)%12 as int)", "period_month"),
    (
        "case when event_id%9=0 then 'Homicidios dolosos' when event_id%9=1 then 'Lesiones' when event_id%9=2 then 'Robo de automotor' "
        "when event_id%9=3 then 'Hurto de motocicletas' when event_id%9=4 then 'Robos (excluir de automotores)' "
        "when event_id%9=5 then 'Hurtos' when event_id%9=6 then 'Amenazas' when event_id%9=7 then 'Extorsión' else 'Otros delitos' end",
        "incident_type",
    ),
    ("case when event_id%4=0 then case when event_id%8=0 then 'cantidad_hechos_dedup' else 'cantidad_victimas' end else case when event_id%8=5 then 'cantidad_victimas' else 'cantidad_hechos' end end", "measure"),
    ("cast(event_id%50 as bigint)", "value"),
    ("concat('Zona ', cast(event_id%20 as string))", "zone_name"),
    ("cast(1+event_id%3 as bigint)", "victims"),
    ("user_id", "user_id"),
]

PROJECTIONS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "v_property": ("part", PROPERTY),
    "v_location": ("part", LOCATION),
    "v_intel": ("part", INTELLIGENCE),
    "v_listing": ("lineitem", LISTING),
    "v_snapshot": ("lineitem", SNAPSHOT),
    "v_trace": ("events", TRACE),
    "v_incident": ("events", INCIDENT),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def projection(spark: SparkSession, folder: str, name: str) -> DataFrame:
    base, columns = PROJECTIONS[name]
    return table(spark, folder, base).selectExpr(*[f"{e} as {n}" for e, n in columns])


def projection_sql(name: str) -> str:
    base, columns = PROJECTIONS[name]
    body = ", ".join(f"{e} as {n}" for e, n in columns)
    return f"select {body} from {base}"
