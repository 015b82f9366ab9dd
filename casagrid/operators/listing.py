"""From raw adverts to canonical listings: location detection, normalisation, identity hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casagrid.functions import address as A
from casagrid.functions.numbers import bind, col, non_empty, once
from casagrid.functions.text import fold_literal, fold_text, normalize_whitespace, squeeze, text_key
from casagrid.operators.search import CENTRE_ALIASES, CENTRE_ZONE

TARGETS = ("Hurlingham", "Villa Tesei", "William C. Morris")
# Words that name a locality or a zone inside a text.
LOCALITY_WORDS = (
    ("William C. Morris", (r"\bwilliam\s+c\.?\s+morris\b", r"\bwilliam\s+morris\b", r"\bmorris\b")),
    ("Villa Tesei", (r"\bvilla\s+tesei\b", r"\bsantos\s+tesei\b", r"\btesei\b")),
    ("Hurlingham", (r"\bhurlingham\b",)),
)
ZONE_WORDS = (
    ("Santos Tesei", (r"\bsantos\s+tesei\b",)),
    ("Parque Johnston", (r"\bparque\s+johnston\b", r"\bjohnston\b")),
    (CENTRE_ZONE, A.CENTRE_PATTERNS),
)
REFERENCES = ("Vergara", "Pedro Diaz", "Jauretche", "Gorriti", "Av. Roca", "Roca", "Bustamante", "Camargo", "Kiernan", "Cuzco", "Malarredo", "Concepcion Arenal", "Gral. Pedro Diaz")
LETTER = "a-zA-ZÁÉÍÓÚÜÑáéíóúüñ"
ADDRESS_IN_TEXT = (
    rf"(?iU)\b((?:av\.?|avenida|calle|boulevard|bvd\.?|pasaje)?\s*[{LETTER}][{LETTER} .'-]{{2,}}"
    rf"(?:\s+\d{{2,5}}|\s+al\s+\d{{2,5}}|\s+y\s+[{LETTER}][{LETTER} .'-]{{2,}}))"
)
ADDRESS_STOP = (
    r"(?iU)\b(?:Ubicaci(?:on|ón)|Agua\s+Corriente|Alumbrado|Cloaca|Pavimento|INFORMACI(?:ON|ÓN)\s+B(?:ASICA|ÁSICA)|Ambientes?\s*:|"
    r"Dormitorios?\s*:|Ba(?:n|ñ)os?\s*:|Condici(?:on|ón)\s*:|Plantas?\s*:|Antig(?:u|ü)edad\s*:|Situaci(?:on|ón)\s*:|"
    r"Caracter(?:isticas|ísticas)|Descripci(?:on|ón)|Venta|USD|U\$S|US\$|ARS|\$).*$"
)
# Largest values the money and area columns hold.
LIMITS = {
    "price": "99999999999999.99", "bathrooms": "99.9", "covered_area": "99999999.99", "total_area": "99999999.99", "land_area": "99999999.99",
    "uncovered_area": "99999999.99", "semicovered_area": "99999999.99", "front_width": "999999.99", "lot_depth": "999999.99",
}


def clean_detected(c: Column | str) -> Column:
    text = F.regexp_replace(normalize_whitespace(c), ADDRESS_STOP, "")
    text = A.sub(text, r"^(?:Direcci(?:on|ón)|Ubicaci(?:on|ón))\s*:?\s*")
    text = A.sub(text, r"^(?:hurlingham|villa\s+tesei|william(?:\s+c\.?)?\s+morris)\s*[-–]\s*")
    text = F.btrim(text, F.lit(" -–|,"))
    cleaned = bind(text, lambda t: F.coalesce(non_empty(A.clean_address(t)), A.normalize_street_number(t)))
    return bind(cleaned, lambda t: F.when(A.is_plausible_address(t), t).otherwise(""))


def first_address(c: Column | str) -> Column:
    """First address-like phrase of a text that is not an advert phrase."""
    found = F.regexp_extract_all(col(c), F.lit(ADDRESS_IN_TEXT), 1)
    cleaned = F.transform(found, clean_detected)
    kept = F.filter(cleaned, lambda v: (F.length(v) <= 80) & ~fold_text(v).rlike("venta|casa|propiedad|ambiente"))
    return F.coalesce(F.get(kept, F.lit(0)), F.lit(""))


def _named(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    from casagrid.functions.text import rlike_any

    return F.array_compact(F.array(*[F.when(rlike_any(text, p), F.lit(n)) for n, p in rules]))


def enrich_location(df: DataFrame) -> DataFrame:
    """Detect locality, zone, address and references in the free text and decide how far to trust them."""
    f = F.col
    parts = ("title", "address", "locality", "neighborhood", "description")
    df = once(df, {"_text": normalize_whitespace(F.concat_ws(" ", *[non_empty(c) for c in parts]))})
    df = once(df, {"_folded": fold_text("_text")})
    df = once(df, {"_towns": _named(f("_folded"), LOCALITY_WORDS), "_zones": _named(f("_folded"), ZONE_WORDS)})
    df = once(
        df,
        {
            "_locality": A.normalize_locality(F.coalesce(non_empty("locality"), F.get("_towns", F.lit(0)), F.lit(""))),
            "_zone": A.normalize_neighborhood(F.coalesce(non_empty("neighborhood"), F.get("_zones", F.lit(0)), F.lit(""))),
            "_inside": A.embedded_neighborhood("address"),
            "_listed": clean_detected("address"),
        },
    )
    df = once(df, {"_address": F.coalesce(non_empty("_listed"), first_address("_text"))})
    df = once(df, {"_zone": F.coalesce(non_empty("_zone"), f("_inside"))})
    street_zone = A.neighborhood_from_address(F.coalesce(non_empty("address"), f("_address")))
    df = once(df, {"_street_zone": street_zone})
    weak = (f("_zone") == "") | f("_zone").isin("Hurlingham", "Hurlingham Centro")
    df = once(df, {"_zone": F.when((f("_street_zone") != "") & weak, f("_street_zone")).otherwise(f("_zone"))})
    refs = F.array_compact(F.array(*[F.when(f("_folded").contains(fold_literal(r)), F.lit(r)) for r in REFERENCES]))
    placed = f("latitude").isNotNull() & f("longitude").isNotNull()
    df = once(df, {"detected_references": refs})
    full = (f("_address") != "") & (f("_locality") != "")
    some = (f("_zone") != "") | (f("_locality") != "") | (F.size("detected_references") > 0)
    has_address = F.coalesce(f("address"), F.lit("")) != ""
    source = (
        F.when(placed, "map")
        .when(full, F.when(has_address, "listing").otherwise("detail"))
        .when(some, F.when(F.coalesce(f("description"), F.lit("")) != "", "description").otherwise("inferred"))
        .otherwise("unknown")
    )
    confidence = (
        F.when(placed, "high")
        .when(full, F.when(f("_address").rlike(r"\d{2,5}"), "high").otherwise("medium"))
        .when(some, F.when((f("_zone") != "") | (f("_locality") != ""), "medium").otherwise("low"))
        .otherwise("unknown")
    )
    listed_town = F.coalesce(f("locality"), F.lit(""))
    notes = F.concat_ws(
        " | ",
        F.when(
            (listed_town != "") & (f("_locality") != "") & (A.normalize_locality("locality") != f("_locality")),
            F.concat(F.lit("Contradiccion localidad listado/detalle: "), listed_town, F.lit(" / "), f("_locality")),
        ),
        F.when(F.size("_towns") > 1, F.concat(F.lit("Contradiccion de zonas detectadas: "), F.array_join("_towns", ", "))),
        F.when(
            has_address & (f("_address") != "") & (f("_listed") != f("_address")),
            F.concat(F.lit("Contradiccion direccion listado/detalle: "), f("address"), F.lit(" / "), f("_address")),
        ),
    )
    df = df.withColumns(
        {
            "detected_locality": F.when(f("_locality").isin(*TARGETS), f("_locality")).otherwise(""),
            "detected_neighborhood": f("_zone"),
            "detected_address": f("_address"),
            "location_source": source,
            "location_confidence": confidence,
            "location_notes": notes,
        }
    )
    df = df.withColumns(
        {
            "locality": F.coalesce(non_empty("locality"), f("detected_locality")),
            "neighborhood": f("_zone"),
            "address": F.coalesce(non_empty("address"), f("_address")),
        }
    )
    return df.drop("_text", "_folded", "_towns", "_zones", "_locality", "_zone", "_inside", "_listed", "_address", "_street_zone")


def bounded(column: str, kind: str) -> Column:
    value = A.parse_decimal(column)
    return F.when(F.abs(value) <= F.lit(LIMITS[column]).cast("decimal(38,10)"), value).cast(kind)


def canonicalize_listing(df: DataFrame) -> DataFrame:
    """The whole normalisation of a batch of raw adverts as one chain of column stages."""
    f = F.col
    df = once(enrich_location(df), {"_raw_locality": F.coalesce("locality", F.lit(""))})
    df = once(
        df,
        {
            "address": bind(A.normalize_street_number("address"), lambda t: F.when(A.is_plausible_address(t), t).otherwise("")),
            "_zone": A.known_neighborhood("_raw_locality"),
            "locality": A.normalize_locality("_raw_locality"),
            "neighborhood": A.normalize_neighborhood("neighborhood"),
        },
    )
    from_zone = (f("locality") == "") & (f("_zone") != "")
    df = once(
        df,
        {
            "neighborhood": F.when(from_zone, F.coalesce(non_empty("neighborhood"), f("_zone"))).otherwise(f("neighborhood")),
            "locality": F.when(from_zone, A.locality_from_neighborhood("_zone")).otherwise(f("locality")),
        },
    )
    note = F.when((f("locality") == "") & (f("_raw_locality") != ""), F.concat(F.lit("Localidad descartada por normalizacion: "), f("_raw_locality")))
    df = df.withColumns(
        {
            "location_notes": squeeze(F.concat_ws(" ", non_empty("location_notes"), note)),
            "locality": F.coalesce(non_empty("locality"), F.lit(A.DEFAULT_LOCALITY)),
            "normalized_address": F.when(f("address") != "", A.normalize_address("address")).otherwise(""),
            "property_type": F.coalesce(non_empty("property_type"), A.infer_property_type("title", "description")),
            "condition_category": F.coalesce(non_empty("condition_category"), A.infer_condition("title", "description")),
        }
    )
    numbers = {"price": "decimal(16,2)", "bathrooms": "decimal(4,1)"}
    present = [c for c in LIMITS if c in df.columns]
    df = df.withColumns({c: bounded(c, numbers.get(c, "decimal(10,2)")) for c in present})
    return df.drop("_raw_locality", "_zone")


def fingerprint(area: str = "covered_area", other_area: str = "total_area", strict_source: int | str | None = None) -> Column:
    """SHA-256 identity: address, else strict content for one source, else advert key, else weak title."""
    f = F.col

    def text(c: Column | str) -> Column:
        return F.coalesce(col(c).cast("string"), F.lit(""))

    addressed = F.concat_ws("|", "normalized_address", "locality", text("property_type"), F.coalesce(f(area).cast("string"), f(other_area).cast("string"), F.lit("")))
    title = F.left(squeeze(F.regexp_replace(fold_text("title"), "[^a-z0-9]+", " ")), F.lit(140))
    body = F.left(squeeze(F.regexp_replace(fold_text("description"), "[^a-z0-9]+", " ")), F.lit(240))
    strict = F.concat_ws("|", F.lit("source_content"), text("source_id"), text("property_type"), text("operation"), text("currency"), text("price"), text(area), title, body)
    strict_ok = (
        F.lit(False)
        if strict_source is None
        else (text("source_id") == str(strict_source)) & f("price").isNotNull() & f(area).isNotNull() & ((F.length(title) >= 18) | (F.length(body) >= 60))
    )
    advert = F.concat_ws("|", F.lit("listing"), text("source_id"), text("external_id"), text("url"))
    has_advert = f("source_id").isNotNull() & (f("external_id").isNotNull() | f("url").isNotNull())
    weak = F.concat_ws("|", F.lower(normalize_whitespace("title")), f("locality"), text("price"), text("bedrooms"))
    identity = F.when(f("normalized_address") != "", addressed).when(strict_ok, strict).when(has_advert, advert).otherwise(weak)
    return F.sha2(identity, 256)


def content_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the canonical JSON of the columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


# Names that mean one canonical zone.
ZONE_ALIASES = {**{a: CENTRE_ZONE for a in CENTRE_ALIASES}, **{a: "Parque Johnston" for a in ("Parque Johnston", "Parque Jhonston", "Johnston", "Jhonston")}}


def canonical_zone_name(c: Column | str) -> Column:
    pairs: dict[str, str] = {}
    for alias, name in ZONE_ALIASES.items():
        pairs["".join(ch for ch in fold_literal(alias) if ch.isascii() and ch.isalnum())] = name
    lookup = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, text_key(c)), F.btrim(F.coalesce(col(c), F.lit(""))))


def replace_zone_in_json(c: Column | str) -> Column:
    """Replace whole quoted alias values at any depth of a JSON text."""
    aliases = sorted((a for a, n in ZONE_ALIASES.items() if n == CENTRE_ZONE and a != CENTRE_ZONE), key=len, reverse=True)
    pattern = r'(?i)"\s*(?:' + "|".join(aliases) + r')\s*"(?=\s*[,}\]])'
    return F.regexp_replace(col(c), pattern, f'"{CENTRE_ZONE}"')


# Editable fields and the kind of value each takes.
EDIT_KINDS = {
    "price": "decimal(16,2)", "covered_area": "decimal(10,2)", "total_area": "decimal(10,2)", "land_area": "decimal(10,2)", "bathrooms": "decimal(4,1)",
    "rooms": "int", "bedrooms": "int", "garages": "int", "age_years": "int",
}
EDIT_CHOICES = {
    "property_type": ("house", "apartment", "ph", "duplex", "land", "country_house", "other"),
    "operation": ("sale", "rent"),
    "status": ("active", "reserved", "sold", "suspended", "removed"),
    "condition_category": ("new", "renovated", "used", "needs_work", "unknown"),
    "currency": ("USD", "ARS", ""),
}


def coerce_edit(field: Column | str, value: Column | str) -> tuple[Column, Column]:
    """Typed value as text and the reason for refusing an edit."""
    f, v = col(field), F.btrim(F.coalesce(col(value), F.lit("")))
    numeric, typed = F.lit(False), F.lit(None).cast("string")
    for name, kind in EDIT_KINDS.items():
        parsed = A.parse_decimal(v).try_cast(kind) if kind != "int" else F.when(v.rlike(r"^\d+$"), v.try_cast("int"))
        typed = F.when((f == name) & (parsed >= 0), parsed.cast("string")).otherwise(typed)
        numeric = numeric | (f == name)
    choice, allowed = F.lit(False), F.lit(False)
    for name, options in EDIT_CHOICES.items():
        choice = choice | (f == name)
        allowed = allowed | ((f == name) & v.isin(*options))
    result = F.when(numeric, F.when(v == "", None).otherwise(typed)).otherwise(v)
    error = F.when(numeric & (v != "") & typed.isNull(), "valor numerico invalido").when(choice & ~allowed, "opcion invalida").otherwise("")
    return result, error


def address_payload(overrides: Column) -> Column:
    """Address text with how far it is confirmed."""
    own, seen = F.btrim(F.coalesce("address", F.lit(""))), F.btrim(F.coalesce("detected_address", F.lit("")))
    kind = F.when(own != "", F.when(overrides, "confirmed").otherwise("published")).when(seen != "", "detected").otherwise("unavailable")
    return F.struct(F.coalesce(non_empty(own), seen).alias("address_text"), kind.alias("address_reliability"))


def location_reliability() -> Column:
    manual = (F.col("precision_kind") == "manual") | F.col("manually_corrected") | (F.col("provider") == "manual")
    numbered = F.concat_ws(" ", "address", "detected_address").rlike(r"(?U)\b\d{1,6}\b")
    return F.when(manual, "confirmed").when((F.col("provider") == "nominatim") & numbered, "address").otherwise("published")


def area_m2() -> Column:
    zero = F.lit(0).cast("decimal(10,2)")
    return F.coalesce(F.nullif("covered_area", zero), F.nullif("total_area", zero), F.col("land_area"))


def scan_mojibake(df: DataFrame, key: str, column: str) -> DataFrame:
    """Lines that still carry wrongly decoded characters, with their number."""
    lines = df.select(key, F.posexplode(F.split(F.col(column), "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike("Ã.|Â.|â€")).select(key, (F.col("line_no") + 1).alias("line_no"))


