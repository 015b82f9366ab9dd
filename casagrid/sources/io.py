"""Readers and writers: listing tables, geographic layers, open data, pages, audit logs, exports, catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casagrid.functions.numbers import non_empty
from casagrid.functions.quality import TYPE_LABELS, label_of
from casagrid.functions.text import normalize_whitespace, text_key

MONEY, AREA = T.DecimalType(16, 2), T.DecimalType(10, 2)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SCHEMAS = {
    "property": _schema(
        property_id=T.LongType(), fingerprint=T.StringType(), title=T.StringType(), description=T.StringType(), property_type=T.StringType(), operation=T.StringType(),
        status=T.StringType(), condition_category=T.StringType(), currency=T.StringType(), price=MONEY, covered_area=AREA, total_area=AREA, land_area=AREA,
        rooms=T.IntegerType(), bedrooms=T.IntegerType(), bathrooms=T.DecimalType(4, 1), garages=T.IntegerType(), age_years=T.IntegerType(), address=T.StringType(),
        normalized_address=T.StringType(), locality=T.StringType(), neighborhood=T.StringType(), features=T.ArrayType(T.StringType()),
        overrides=T.MapType(T.StringType(), T.TimestampType()), is_hidden=T.BooleanType(), is_favorite=T.BooleanType(), is_reviewed=T.BooleanType(),
        first_seen_at=T.TimestampType(), last_seen_at=T.TimestampType(),
    ),
    "listing": _schema(
        listing_id=T.LongType(), property_id=T.LongType(), source_id=T.LongType(), agency_id=T.LongType(), external_id=T.StringType(), url=T.StringType(),
        active=T.BooleanType(), missing_runs=T.IntegerType(), source_status=T.StringType(), first_seen_at=T.TimestampType(), last_seen_at=T.TimestampType(),
    ),
    "location": _schema(
        property_id=T.LongType(), latitude=T.DoubleType(), longitude=T.DoubleType(), precision_kind=T.StringType(), provider=T.StringType(), confidence=T.DoubleType(),
        manually_corrected=T.BooleanType(), outside_target=T.BooleanType(),
    ),
    "snapshot": _schema(
        listing_id=T.LongType(), content_hash=T.StringType(), price=MONEY, currency=T.StringType(), status=T.StringType(), payload=T.StringType(), observed_at=T.TimestampType(),
    ),
    "source": _schema(source_id=T.LongType(), name=T.StringType(), slug=T.StringType()),
    "agency": _schema(agency_id=T.LongType(), name=T.StringType(), website=T.StringType()),
}


def read_listing_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Typed scans of the stored tables."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in SCHEMAS.items()}


_FEATURE = T.StructType(
    [
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ]
)
LAYER_SCHEMA = "feature_idx long, part int, name string, level string, rings array<array<struct<lon:double,lat:double>>>, props map<string,string>"


def as_ring(points: Column) -> Column:
    """Numeric pairs as a closed ring."""
    ring = F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    first, last = F.get(ring, F.lit(0)), F.try_element_at(ring, F.lit(-1))
    return F.when(F.size(ring) == 0, ring).when(first != last, F.concat(ring, F.array(first))).otherwise(ring)


def layer_rows(features: DataFrame, level: str) -> DataFrame:
    """One row per polygon part from (feature_idx, geometry, properties); nameless features and short rings are left out."""
    props = F.col("properties")
    name = F.coalesce(*[non_empty(props[k]) for k in ("canonical_name", "zone_name", "name", "label")])
    coords = F.col("geometry.coordinates")
    single = F.array(F.from_json(coords, "array<array<array<double>>>"))
    many = F.from_json(coords, "array<array<array<array<double>>>>")
    polygons = F.when(F.col("geometry.type") == "Polygon", single).when(F.col("geometry.type") == "MultiPolygon", many)
    rows = features.select("feature_idx", normalize_whitespace(name).alias("name"), props.alias("props"), F.posexplode(polygons).alias("part", "polygon"))
    rings = F.filter(F.transform("polygon", as_ring), lambda r: F.size(r) >= 4)
    rows = rows.withColumn("rings", rings).filter((F.col("name") != "") & (F.size("rings") > 0))
    return rows.select("feature_idx", "part", "name", F.lit(level).alias("level"), "rings", "props")


def ordered_pieces(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Text between separators with its place: (file, block, seq, value), a large file split over many tasks.

    A piece belongs to the split in which it starts; within a split ``seq`` grows in file order.
    """
    reader = spark.read if sep is None else spark.read.option("lineSep", sep)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return rows.withColumn("seq", F.monotonically_increasing_id())


def running(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over all pieces of a file before each one: sums of the splits first, then within each split."""
    rows = pieces.withColumn("_v", value.cast("long"))
    sums = rows.groupBy("file", "block").agg(F.sum("_v").alias("_s"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    offsets = sums.select("file", "block", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, ["file", "block"]).withColumn(name, F.col("_o") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_o")


# What a pattern calls a string that may have begun before the piece or go on after it.
JSON_STRING = r'"[^"]*(?:"|$)'
JSON_LEAD = r'^(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'


def collection_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects directly inside the top object of JSON files, or inside its arrays: (file, number, body).

    Files are cut at ``}``. Running sums of quotes tell which braces are inside strings, those of braces how deep a piece
    is; pieces of one object then meet by file and number, so no task reads a whole file.
    """
    plain = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    rows = running(ordered_pieces(spark, path, "}"), quotes, "_quotes")
    inside = F.col("_quotes") % 2 == 1
    bare = F.regexp_replace(F.when(inside, F.concat(F.lit('"'), plain)).otherwise(plain), JSON_STRING, "")
    opens = F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))
    closes = F.when((F.col("_quotes") + quotes) % 2 == 0, 1).otherwise(0)
    rows = rows.withColumns({"_inside": inside, "_opens": opens, "_delta": opens - closes})
    rows = running(rows, F.col("_delta"), "_depth")
    depth = F.col("_depth")
    begins = ~F.col("_inside") & (depth <= 1) & (depth + F.col("_opens") >= 2)
    rows = running(rows.withColumn("_begins", begins), F.col("_begins").cast("int"), "_number")
    first = F.regexp_replace(F.when(depth == 0, F.regexp_replace("value", JSON_LEAD + r"\{", "")).otherwise(F.col("value")), JSON_LEAD, "")
    rows = rows.withColumns({"text": F.when(F.col("_begins"), first).otherwise(F.col("value")), "number": F.col("_number") + F.col("_begins").cast("int")})
    part = rows.filter(F.col("_begins") | (depth >= 2)).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("_p"))
    return part.select("file", (F.col("number") - 1).alias("number"), F.concat(F.array_join(F.transform("_p", lambda x: x["text"]), "}"), F.lit("}")).alias("body"))


def read_geo_layer(spark: SparkSession, path: str, level: str) -> DataFrame:
    """Polygons of FeatureCollection files of any size; a missing file, or one without features, is an empty layer."""
    try:
        found = collection_objects(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], LAYER_SCHEMA)
    typed = T.StructType([T.StructField("type", T.StringType()), *_FEATURE.fields])
    rows = found.withColumn("f", F.from_json("body", typed)).withColumn("_is", F.coalesce(F.col("f.type") == "Feature", F.lit(False)))
    # Objects that are no features (a reference system, metadata) do not count; they are few.
    others = rows.filter(~F.col("_is")).groupBy("file").agg(F.collect_list("number").alias("_others"))
    rows = rows.filter("_is").join(others, "file", "left")
    before = F.coalesce(F.size(F.filter("_others", lambda n: n < F.col("number"))), F.lit(0))
    return layer_rows(rows.select((F.col("number") - F.when(F.col("_others").isNull(), 0).otherwise(before)).cast("long").alias("feature_idx"), "f.geometry", "f.properties"), level)


def _snake(name: str) -> str:
    import re

    from casagrid.functions.text import fold_literal

    return re.sub(r"[^a-z0-9]+", "_", fold_literal(name)).strip("_")


def normalized_headers(columns: Sequence[str]) -> list[str]:
    """snake_case names; empty ones are numbered by place, repeated ones by count."""
    seen: dict[str, int] = {}
    out = []
    for i, column in enumerate(columns):
        base = _snake(column) or f"unnamed_{i}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Whole CSV records (file, block, seq, record) of files that many tasks read: a line break inside quotes does not
    end a record.

    Running sums of quotes tell where records begin; only records of several lines are put together by a shuffle.
    """
    lines = ordered_pieces(spark, path)
    if encoding.upper() != "UTF-8":
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    rows = running(lines, quotes, "_quotes")
    open_before, open_after = F.col("_quotes") % 2 == 1, (F.col("_quotes") + quotes) % 2 == 1
    rows = rows.withColumns({"_begins": ~open_before, "_alone": ~open_before & ~open_after})
    alone = rows.filter("_alone").select("file", "block", "seq", F.col("value").alias("record"))
    rest = running(rows, F.col("_begins").cast("int"), "_number").filter("not _alone")
    number = F.col("_number") + F.col("_begins").cast("int")
    parts = rest.groupBy("file", number.alias("_n")).agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("_p"))
    joined = parts.select("file", F.col("_p")[0]["block"].alias("block"), F.col("_p")[0]["seq"].alias("seq"), F.array_join(F.transform("_p", lambda x: x["value"]), "\n").alias("record"))
    return alone.unionByName(joined)


def read_open_data(spark: SparkSession, path: str, required: Sequence[str], sep: str = ",", encoding: str = "UTF-8", order: str | None = None) -> DataFrame:
    """CSV with normalised headers; missing required columns are an error, cells are trimmed text, blank lines go.

    The first record of each file is its header; all files have the same. ``order`` names a column for the place of a
    record: (file, block, seq).
    """
    records = csv_records(spark, path, encoding).withColumn("record", F.regexp_replace("record", "^\ufeff|\r$", "")).filter(F.trim("record") != "")
    heads = records.groupBy("file").agg(F.min(F.struct("block", "seq")).alias("_first"))
    options = {"sep": sep, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    top = records.join(heads, "file").filter(F.struct("block", "seq") == F.col("_first")).select("record").first()
    if top is None:
        raise ValueError(f"{path}: missing columns {sorted(required)}")
    import csv

    names = normalized_headers([c.lstrip("\ufeff") for c in next(csv.reader([top.record], delimiter=sep))])
    missing = sorted(set(required) - set(names))
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    body = records.join(heads, "file").filter(F.struct("block", "seq") != F.col("_first")).withColumn("_r", F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options))
    cells = [F.trim(F.col(f"_r.c{i}")).alias(n) for i, n in enumerate(names)]
    return body.select(*cells, *([F.struct("file", "block", "seq").alias(order)] if order else []))


def read_alias_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Alias text to canonical zone and locality, keyed by the folded text; the first row of a key wins."""
    df = read_open_data(spark, path, ["source_text_normalized", "canonical_name"], order="_at")
    rows = df.withColumn("alias_key", text_key("source_text_normalized"))
    best = rows.groupBy("alias_key").agg(F.min(F.struct("_at", "canonical_name")).alias("_b"))
    return best.select("alias_key", "_b.canonical_name")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id long, url string, html string").parquet(path)


AUDIT_SCHEMA = "id long, url string, source string, checked_at string, result string, detail string, applied boolean, dry_run boolean"


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def yes_no(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c, "Si").otherwise("No")


# Labels of conditions and of location trust.
CONDITION_LABELS = {"new": "A estrenar", "renovated": "Refaccionada", "used": "Usada", "needs_work": "A refaccionar", "unknown": "Sin dato"}
CONFIDENCE_LABELS = {"high": "Alta", "medium": "Media", "low": "Baja", "unknown": "Sin dato"}


# Columns of the flat export in their order, and where plain ones come from.
EXPORT_COLUMNS = {
    "id": "property_id", "titulo": "title", "tipo": None, "condicion": None, "antiguedad": "age_years", "precio": "valid_price", "moneda": "currency", "precio_m2": "price_m2",
    "direccion": "address", "localidad": "locality", "barrio": "neighborhood", "localidad_detectada": "detected_locality", "barrio_detectado": "detected_neighborhood",
    "barrio_inferido": "inferred_neighborhood", "partido_territorial": "inferred_municipality", "localidad_territorial": "inferred_locality", "zona_territorial_operativa": "inferred_zone",
    "confianza_territorial": "territory_confidence", "revision_territorial": None, "metodo_territorial": "territory_method", "conflicto_zona": None, "zona_requiere_revision": None,
    "direccion_detectada": "detected_address", "fuente_localizacion": None, "confianza_localizacion": None, "score_territorial": "overall_score", "nivel_territorial": "level",
    "zona_territorial": "zone_name", "partido_inteligencia": "intel_municipality", "localidad_inteligencia": "intel_locality", "match_territorial": "match_method",
    "score_transporte": "transport_score", "score_educacion": "education_score", "score_salud": "health_score", "penalidad_inundacion": "flood_penalty_score", "riesgo_hidrico": None,
    "distancia_renabap_m": "nearest_settlement_m", "dormitorios": "valid_bedrooms", "banos": "valid_bathrooms", "cubierta_m2": "valid_covered_area", "terreno_m2": "valid_land_area",
    "inmobiliaria": None, "fuente": None, "link_original": None, "favorita": None, "oculta": None, "revisada": None, "notas": "personal_notes",
}
# Labels of where a location came from.
SOURCE_LABELS = {"listing": "Listado", "detail": "Detalle", "map": "Mapa", "description": "Descripcion", "inferred": "Inferida", "unknown": "Sin dato"}


def export_rows(df: DataFrame, adverts: DataFrame) -> DataFrame:
    """Flat export of 48 columns: display labels, yes/no marks and only plausible metrics.

    ``df`` is the curated, filtered table with territory and location results; ``adverts`` has the main advert of each
    property with names. A property without adverts has empty names and link.
    """
    rows = df.join(adverts, "property_id", "left")
    flood = F.when(F.col("in_flood_risk_zone").isNull(), "").otherwise(yes_no("in_flood_risk_zone"))
    made = {
        "tipo": label_of("property_type", TYPE_LABELS), "condicion": label_of("condition_category", CONDITION_LABELS), "revision_territorial": yes_no("territory_needs_review"),
        "conflicto_zona": yes_no("zone_conflict"), "zona_requiere_revision": yes_no("zone_needs_review"), "fuente_localizacion": label_of("location_source", SOURCE_LABELS),
        "confianza_localizacion": label_of("location_confidence", CONFIDENCE_LABELS), "riesgo_hidrico": flood, "inmobiliaria": F.coalesce("agency_name", F.lit("")),
        "fuente": F.coalesce("source_name", F.lit("")), "link_original": F.coalesce("url", F.lit("")), "favorita": yes_no("is_favorite"), "oculta": yes_no("is_hidden"), "revisada": yes_no("is_reviewed"),
    }
    return rows.select(*[(F.col(source) if source else made[name]).alias(name) for name, source in EXPORT_COLUMNS.items()])


def write_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def feature_rows(df: DataFrame, props: Sequence[str]) -> DataFrame:
    """One GeoJSON feature text per located row."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    body = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))
    return df.filter(F.col("latitude").isNotNull()).select("property_id", F.to_json(body).alias("feature"))


def write_features(df: DataFrame, path: str) -> None:
    df.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def refresh_catalog(catalog: DataFrame, stats: DataFrame) -> DataFrame:
    """Layer metadata with fresh counts; new layers are added and error notes are appended."""
    new = stats.select("file_path", F.col("feature_count").alias("_n"), F.col("geometry_type").alias("_g"), F.col("error").alias("_e"))
    out = catalog.join(new, "file_path", "full_outer")
    note = F.concat_ws("; ", non_empty("notes"), F.when(F.coalesce("_e", F.lit("")) != "", F.col("_e")))
    return out.select("file_path", F.coalesce("_n", "feature_count").alias("feature_count"), F.coalesce("_g", "geometry_type").alias("geometry_type"), note.alias("notes"))


