"""Addresses, neighbourhoods, localities, agencies and listing words as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casagrid.functions.numbers import bind, col, non_empty
from casagrid.functions.street_rules import STREET_RULES
from casagrid.functions.text import fold_text, normalize_whitespace, rlike_any, squeeze
from casagrid.operators.search import CENTRE_ZONE

FLAGS = "(?iU)"


def sub(c: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(c, FLAGS + pattern, replacement)


def apply_rules(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        c = sub(c, pattern, replacement)
    return c


# House-number spellings.
NUMBER_RULES = (
    (r"\s+\bal\s+0\b", " 100"),
    (r"\s*,?\s*\bpiso\s+(?:pb|bajo|\d+)\b\.?", ""),
    (r"\s*,?\s*\bp\.?\s*b\.?\b\.?", ""),
    (r"\s+\bal\s+(\d{1,2})[.,](\d{3})(?=\b)", " $1$2"),
    (r"\s+\bal\s+(\d{2,5})(?=\b)", " $1"),
)
# Abbreviations opened in the comparable form of an address.
ABBREVIATIONS = (
    (r"[.,;#]", " "),
    (r"\bav(?:enida)?\b", "avenida"),
    (r"\bgdor\b", "gobernador"),
    (r"\bgral\b", "general"),
    (r"\bpte\b", "presidente"),
    (r"\bprov\.?\b", "provincia"),
    (r"\bbs\.?\s*as\.?\b", "buenos aires"),
)
# Localities and the spellings that name them, longest first.
LOCALITIES = (
    ("william c morris", "William C. Morris"),
    ("william morris", "William C. Morris"),
    ("villa tesei", "Villa Tesei"),
    ("hurlingham", "Hurlingham"),
    ("morris", "William C. Morris"),
    ("tesei", "Villa Tesei"),
)
GEOCODING_LOCALITIES = ("hurlingham", "villa tesei", "william c morris", "william morris", "morris")
DEFAULT_LOCALITY = "Hurlingham"
TOWN_ORDER = ("Hurlingham", "Villa Tesei", "William C. Morris")
ADMIN_PARTS = ("argentina", "buenos aires", "provincia de buenos aires", "partido de hurlingham")
NEIGHBORHOOD_LOCALITY = {
    CENTRE_ZONE: "Hurlingham",
    "Villa Tesei": "Villa Tesei",
    "Villa Tesei Centro": "Villa Tesei",
    "Santos Tesei": "Villa Tesei",
    "Barrio Italia": "Villa Tesei",
    "William C. Morris": "William C. Morris",
}
# Place names that alone do not make an address.
GENERIC_PARTS = (
    "argentina", "buenos aires", "provincia de buenos aires", "partido de hurlingham", "hurlingham", "villa tesei",
    "villa santos tesei", "william c morris", "william morris", "morris", "villa alemania", "villa club", "parque johnston",
    "parque quirno", "barrio ingles", "hurlingham centro", "km 18",
)
ADDRESS_NOISE = (
    r"^\s*ciudad\s*:", r"\bcontacto\s+buscador\b", r"\btipo\s+de\s+propiedad\b", r"\botras\s+operaciones\b", r"\bmapa\s+de\s+sitio\b",
    r"\binicio\s+propiedades\b", r"\bclick\s+para\s+llamar\b", r"\bcurso\s+de\s+agente\b", r"\bdesarrollos\s+inmobiliarios\b",
)
NEIGHBORHOOD_NOISE = (
    r"\bconsultanos\b", r"\bmartillero\b", r"\bcolegiado\b", r"\btodos\s+los\s+detalles\b", r"\bcategoria\s*:", r"\bestado\s*:", r"\bventa\s*:", r"\busd\b",
)
CENTRE_PATTERNS = (
    r"\bhurlingham\s+centro(?:\s*\(\s*barrio\s+ingles\s*\))?\b",
    r"\bhurlingham\s+centro\s+barrio\s+ingles\b",
    r"\bbarrio\s+ingles\b",
    r"\bb\s+ingles\b",
    r"\bingles\b",
)
TRONCOS = (r"\bbarrio\s+los\s+troncos\b", r"\bb[°º]\.?\s*los\s+troncos\b", r"\blos\s+troncos\b")
# Neighbourhood names and the patterns that select them, first match wins.
NEIGHBORHOODS = (
    (CENTRE_ZONE, CENTRE_PATTERNS),
    ("Barrio Inglés", (r"\bbarrio\s+ingles\b", r"\bingles\b")),
    ("William C. Morris", (r"\bwilliam\s+c\.?\s*morris\b", r"\bwilliam\s+morris\b", r"^morris$")),
    ("Santos Tesei", (r"\bvilla\s+santos\s+tes", r"\bsantos\s+tesei\b")),
    ("5 esquinas", (r"\b5\s+esquinas\b",)),
    ("Barrio Cartero", (r"\bbarrio\s+cartero\b", r"^cartero$")),
    ("Los Troncos", TRONCOS),
    ("Parque Johnston", (r"\bparque\s+(?:johnston|jhonston)\b", r"\b(?:johnston|jhonston)\b")),
    ("Parque Quirno", (r"\bparque\s+quirno\b",)),
    ("Villa Alemania", (r"\bvilla\s+alemania\b",)),
    ("Villa Club", (r"\bvilla\s+club\b",)),
    ("Villa Tesei Centro", (r"\bvilla\s+tesei\s+centro\b",)),
    ("Villa Tesei", (r"^villa\s+tesei$",)),
    ("Km 18", (r"\bkm\s*18\b",)),
    ("Zona Curupayti", (r"\bzona\s+curupayti\b", r"\bcurupayti\b", r"\bcurapayti\b")),
    ("Zona Iglesia", (r"\bzona\s+iglesia\b",)),
    ("Zona Municipalidad", (r"\bzona\s+municipalidad\b",)),
    ("Barrio Luna", (r"\bbarrio\s+luna\b", r"^luna$")),
    ("Barrio Destino", (r"\bbarrio\s+destino\b", r"^el\s+destino$")),
    ("Barrio Italia", (r"\bbarrio\s+italia\b",)),
    ("Hurlingham Centro", (r"\bhurlingham\s+centro\b",)),
    ("Hurlingham", (r"^hurlingham$",)),
)
# Neighbourhoods named by a street or a place inside an address.
ADDRESS_NEIGHBORHOODS = (
    (CENTRE_ZONE, CENTRE_PATTERNS),
    ("Santos Tesei", (r"\bveragua\b",)),
    ("Villa Club", (r"\bvilla\s+club\b",)),
    ("Barrio Inglés", (r"\bbarrio\s+ingles\b", r"\bingles\b")),
    ("Parque Johnston", (r"\bparque\s+johnston\b", r"\bjohnston\b")),
    ("William C. Morris", (r"\bwilliam\s+c\.?\s*morris\b", r"\bwilliam\s+morris\b")),
    ("Los Troncos", TRONCOS),
)
EDGE = " -–|,."
TRAILING_PLACE = r"\s+\b(?:hurlingham|villa\s+tesei|william\s+c\.?\s+morris|william\s+morris)\b\s*$"
EMBEDDED = r"(\b\d{2,5}\b)(?:\s*[-–,]?\s*hurlingham)?\s*[-–,]?\s+(?:barrio|b[°º]\.?)\s+[^,;/|]+"


def first_label(text: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: Column) -> Column:
    out = None
    for label, patterns in rules:
        test = rlike_any(text, patterns)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


# Cheap test for texts that one of the number rules can change.
NUMBER_HINT = r"\sal\s|piso|p\.?\s*b"


def normalize_street_number(c: Column | str) -> Column:
    def rewrite(t: Column) -> Column:
        return F.when(F.lower(t).rlike(NUMBER_HINT), squeeze(apply_rules(t, NUMBER_RULES))).otherwise(t)

    return bind(normalize_whitespace(c), rewrite)


def normalize_address(c: Column | str) -> Column:
    return squeeze(apply_rules(fold_text(normalize_street_number(c)), ABBREVIATIONS))


def normalize_locality(c: Column | str) -> Column:
    def pick(t: Column) -> Column:
        out = None
        for words, label in LOCALITIES:
            out = F.when(t.contains(words), label) if out is None else out.when(t.contains(words), label)
        return out.otherwise("")

    return bind(normalize_address(c), pick)


def canonical_geocoding_locality(*columns: Column | str) -> Column:
    options = []
    for c in columns:
        name = normalize_locality(c)
        options.append(non_empty(name))
    return F.coalesce(*options, F.lit(DEFAULT_LOCALITY))


def street_stems() -> list[str]:
    """For each street rule the longest run of letters that any match must contain."""
    stems = set()
    for pattern, _ in STREET_RULES:
        text = re.sub(r"\\.", " ", pattern)
        while True:
            flat = re.sub(r"\([^()]*\)[?*]?", " ", text)
            if flat == text:
                break
            text = flat
        text = re.sub(r"\w[?*]", " ", text)
        stems.add(max(re.findall(r"[A-Za-z]+", text), key=len).lower())
    return sorted(stems)


def address_variants(c: Column | str) -> Column:
    """Other spellings of an address in rule order, without repeats and without the address itself."""
    base = normalize_street_number(c)
    any_stem = "|".join(street_stems())

    def expand(b: Column) -> Column:
        items = [squeeze(sub(b, p, r)) for p, r in STREET_RULES]
        solis = F.regexp_extract(fold_text(b), r"^\s*(?:juan\s+diaz\s+(?:de\s+)?)?solis\b", 0)
        tail = F.substring(b, F.length(solis) + 1, F.length(b))
        items.append(F.when(solis != "", squeeze(F.concat(F.lit("Juan Díaz de Solís"), tail))).otherwise(b))
        known = F.lower(b).rlike(any_stem) | (solis != "")
        found = F.array_distinct(F.filter(F.array(*items), lambda x: (x != b) & (x != "")))
        return F.when(known, found).otherwise(F.array().cast("array<string>"))

    return bind(base, expand)


def canonical_alias(c: Column | str) -> Column:
    return F.coalesce(F.get(address_variants(c), F.lit(0)), normalize_street_number(c))


def is_plausible_address(c: Column | str) -> Column:
    text = normalize_street_number(c)
    generic = "|".join(sorted(GENERIC_PARTS, key=len, reverse=True))

    def test(t: Column) -> Column:
        simple = sub(squeeze(sub(normalize_address(t), r"\bb?\d{4}[a-z]{0,4}\b", " ")), rf"\b(?:{generic}|cp|codigo\s+postal)\b", " ")
        return (t != "") & (F.length(t) <= 180) & ~rlike_any(fold_text(t), ADDRESS_NOISE) & simple.rlike("[a-z]")

    return bind(text, test)


def first_address_part(text: Column, dropped: Sequence[str], edge: str) -> Column:
    """First comma part that is not a postal code or a place, cut at cross streets and trailing places."""
    text = sub(text, EMBEDDED, "$1")
    parts = F.transform(F.split(text, ","), lambda p: squeeze(F.btrim(p, F.lit(edge))))
    kept = F.filter(parts, lambda p: (p != "") & ~fold_text(p).rlike(r"^b?\d{4}[a-z]{0,4}$") & ~fold_text(p).isin(list(dropped)))
    first = F.coalesce(F.get(kept, F.lit(0)), F.lit(""))
    return sub(sub(first, r"\.?\s+\bentre\b.*$"), TRAILING_PLACE)


def clean_address(c: Column | str) -> Column:
    """Address as stored: first meaningful part with its street name in canonical spelling."""
    first = first_address_part(normalize_street_number(c), [*ADMIN_PARTS, *GEOCODING_LOCALITIES], " -–|.")
    return bind(first, lambda t: F.when(t == "", "").otherwise(squeeze(F.btrim(canonical_alias(t), F.lit(" ,-")))))


def query_address(c: Column | str) -> Column:
    """Address as asked from a geocoder: the same part in its own spelling."""
    text = normalize_street_number(c)
    first = squeeze(F.btrim(first_address_part(text, [*ADMIN_PARTS, *GEOCODING_LOCALITIES[:4]], " "), F.lit(" ,-")))
    return F.coalesce(non_empty(first), text)


def normalize_neighborhood(c: Column | str) -> Column:
    text = F.btrim(normalize_whitespace(c), F.lit(EDGE))

    def pick(t: Column) -> Column:
        folded = fold_text(t)
        head = bind(fold_text(squeeze(F.get(F.split(t, r",|/|\|"), F.lit(0)))), lambda h: first_label(h, NEIGHBORHOODS, F.lit(None).cast("string")))
        whole = bind(folded, lambda w: first_label(w, NEIGHBORHOODS, F.lit(None).cast("string")))
        return F.when((t == "") | (F.length(t) > 80) | rlike_any(folded, NEIGHBORHOOD_NOISE), "").otherwise(F.coalesce(head, whole, t))

    return bind(text, pick)


def known_neighborhood(c: Column | str) -> Column:
    names = [n for n, _ in NEIGHBORHOODS]
    return bind(normalize_neighborhood(c), lambda n: F.when(n.isin(names), n).otherwise(""))


def locality_from_neighborhood(c: Column | str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in NEIGHBORHOOD_LOCALITY.items() for x in kv])
    return bind(known_neighborhood(c), lambda n: F.when(n == "", "").otherwise(F.coalesce(F.try_element_at(pairs, n), F.lit(DEFAULT_LOCALITY))))


def neighborhood_from_address(c: Column | str) -> Column:
    return bind(fold_text(normalize_street_number(c)), lambda t: first_label(t, ADDRESS_NEIGHBORHOODS, F.lit("")))


def embedded_neighborhood(c: Column | str) -> Column:
    found = F.regexp_extract_all(normalize_whitespace(c), F.lit(FLAGS + r"\b(?:barrio|b[°º]\.?)\s+([^,;/|]+)"), 1)
    names = F.filter(F.transform(found, normalize_neighborhood), lambda n: n != "")
    return F.coalesce(F.get(names, F.lit(0)), F.lit(""))


def display_locality(df_columns: Sequence[str] = ()) -> Column:
    direct = [non_empty(normalize_locality(c)) for c in ("inferred_locality", "detected_locality", "locality")]
    by_zone = [non_empty(locality_from_neighborhood(c)) for c in ("detected_neighborhood", "neighborhood", "inferred_zone", "inferred_neighborhood")]
    return F.coalesce(*direct, *by_zone, F.lit("Sin dato"))


def classify_precision(c: Column | str) -> Column:
    return bind(
        fold_text(normalize_street_number(c)),
        lambda t: F.when(t.rlike(r"(?U)\b\d{2,5}\b"), "exact")
        .when(t.rlike(r"(?U)\b(esq|esquina|y|entre)\b"), "intersection")
        .when(t != "", "street")
        .otherwise("neighborhood"),
    )


def address_number(c: Column | str) -> Column:
    return non_empty(F.regexp_extract(normalize_street_number(c), r"(?U)\b(\d{2,5})\b", 1)).cast("int")


def street_key(c: Column | str) -> Column:
    return squeeze(apply_rules(normalize_address(canonical_alias(c)), ((r"\b\d{2,5}\b.*$", ""), (r"\b(?:entre|e/|esquina|y)\b.*$", ""))))


def best_address(*columns: Column | str) -> Column:
    options = [F.when(is_plausible_address(c), normalize_street_number(c)) for c in columns]
    return F.coalesce(*options, F.lit(""))


def same_target(a: Column | str, b: Column | str) -> Column:
    return (street_key(a) == street_key(b)) & address_number(a).eqNullSafe(address_number(b))


def intersection_variants(c: Column) -> Column:
    """``A e/ B y C`` and ``A y B`` written as corners."""
    between = FLAGS + r"^(.+?)\s+e/\s*(.+?)\s+y\s+(.+)$"
    pair = FLAGS + r"^(.+?)\s+y\s+(.+)$"
    t = normalize_whitespace(c)

    def corner(pattern: str, other: int) -> Column:
        return F.concat(F.regexp_extract(t, pattern, 1), F.lit(" esquina "), F.regexp_extract(t, pattern, other))

    plain = ~fold_text(t).contains("esquina") & ~fold_text(t).contains("batlle y ordonez")
    none = F.array().cast("array<string>")
    return (
        F.when(t.rlike(between), F.array(squeeze(corner(between, 2)), squeeze(corner(between, 3))))
        .when(plain & t.rlike(pair), F.array(squeeze(corner(pair, 2))))
        .otherwise(none)
    )


def geocode_candidates(address: Column | str, *places: Column | str) -> Column:
    """Ordered query texts: every spelling of the address with every likely locality."""
    none = F.array().cast("array<string>")
    town = canonical_geocoding_locality(*places)

    def queries(variants: Column, towns: Column) -> Column:
        def one(v: Column) -> Column:
            silent = fold_text(v).contains("hurlingham")
            parts = F.transform(towns, lambda t: F.array(v, F.when(silent, "").otherwise(t), F.lit("Buenos Aires"), F.lit("Argentina")))
            return F.transform(parts, lambda p: F.array_join(F.array_distinct(F.filter(p, lambda x: x != "")), ", "))

        return F.array_distinct(F.flatten(F.transform(variants, one)))

    def build(best: Column) -> Column:
        towns = F.array_distinct(F.array(town, canonical_geocoding_locality(best), *[F.lit(x) for x in TOWN_ORDER]))
        spelled = bind(query_address(best), lambda q: F.concat(F.array(q), address_variants(q)))
        variants = bind(spelled, lambda vs: F.concat(vs, F.flatten(F.transform(vs, intersection_variants))))
        return F.when(best == "", none).otherwise(bind(towns, lambda t: queries(variants, t)))

    return bind(best_address(address), build)


# Marks of texts that are not agency names, and where a name ends.
AGENCY_INVALID = ("ubicacion", "ubicación", "caracteristicas", "características", "ampliar mapa")
AGENCY_CUT = (
    r"\s+\d+[\d.,]*\s*m2\b", r"\s+\d+[\d.,]*\s*m²\b", r"\s+Operation\s*:", r"\s+Address\s*:", r"\s+Location\s*:", r"\s+Code\s*:", r"\s+Price\s*:", r"\s+Venta\s+Address\s*:",
)
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&ntilde;", "ñ"), ("&aacute;", "á"), ("&eacute;", "é"), ("&iacute;", "í"), ("&oacute;", "ó"), ("&uacute;", "ú"), ("&amp;", "&"))


def unescape_html(c: Column | str) -> Column:
    from casagrid.functions.text import replace_all

    text = F.coalesce(col(c), F.lit(""))
    return F.when(text.contains("&"), replace_all(text, ENTITIES)).otherwise(text)


def normalize_agency(c: Column | str) -> Column:
    edge = F.lit(" -–|·")
    text = F.btrim(normalize_whitespace(unescape_html(c)), edge)
    bad = F.lit(False)
    for mark in AGENCY_INVALID:
        bad = bad | F.lower(text).contains(mark)
    cut = text
    for mark in AGENCY_CUT:
        cut = F.btrim(sub(cut, mark + r".*$"), edge)
    return bind(cut, lambda t: F.when(bad | (F.length(t) > 90), "").otherwise(t))


# Words that name a property type; the earliest one in the text wins.
TYPE_WORDS = (
    ("duplex", "duplex"), ("departamento", "apartment"), ("depto", "apartment"), ("terreno", "land"), ("lote", "land"),
    ("quinta", "country_house"), ("ph", "ph"), ("casa", "house"), ("chalet", "house"),
)


def infer_property_type(*columns: Column | str) -> Column:
    text = fold_text(F.concat_ws(" ", *[non_empty(c) for c in columns]))

    def pick(t: Column) -> Column:
        spots = [F.struct(F.instr(t, w).alias("at"), F.lit(i).alias("i"), F.lit(kind).alias("kind")) for i, (w, kind) in enumerate(TYPE_WORDS)]
        hits = F.filter(F.array(*spots), lambda s: s["at"] > 0)
        return F.coalesce(F.array_min(hits)["kind"], F.lit("other"))

    return bind(text, pick)


# Condition wording, first category wins.
CONDITIONS = (
    ("needs_work", (r"\ba\s+refaccionar\b", r"\bpara\s+refaccionar\b", r"\ba\s+reciclar\b", r"\bpara\s+reciclar\b", r"\ba\s+demoler\b", r"\bpara\s+demoler\b", r"\bmal\s+estado\b", r"\bdeteriorad")),
    ("new", (r"\ba\s+estrenar\b", r"\bestrenar\b", r"\bobra\s+nueva\b", r"\bpozo\b")),
    ("renovated", (r"\brefaccionad", r"\breciclad", r"\bremodelad", r"\brenovad", r"\bimpecable\b", r"\bexcelente\s+estado\b", r"\bactualizad")),
    ("used", (r"\busad[ao]\b", r"\bbuen\s+estado\b", r"\bmuy\s+buen\s+estado\b", r"\bantigu[ao]\b")),
)


def infer_condition(*columns: Column | str) -> Column:
    return bind(fold_text(F.concat_ws(" ", *[non_empty(c) for c in columns])), lambda t: first_label(t, CONDITIONS, F.lit("unknown")))


def detect_operation(text: Column | str, url: Column | str) -> Column:
    from casagrid.functions.urls import url_path

    body = F.lower(F.concat_ws(" ", col(url), F.coalesce(col(text), F.lit(""))))
    path = url_path(url)
    return (
        F.when(path.rlike(r"(?U)\bventa\b|/venta-|/venta/"), "sale")
        .when(path.rlike(r"(?U)\balquiler\b|/alquiler-|/alquiler/|/alcl"), "rent")
        .when(body.rlike(r"(?U)\b(alquiler|alquilar|en\s+alquiler|alcl)"), "rent")
        .otherwise("sale")
    )


def normalize_currency(c: Column | str) -> Column:
    raw = F.coalesce(col(c), F.lit(""))
    folded = fold_text(raw)
    usd = folded.contains("usd") | folded.contains("u$s") | folded.contains("u$d") | folded.contains("us$")
    return F.when(usd, "USD").when(folded.contains("ars") | raw.contains("$"), "ARS").otherwise(F.left(F.upper(normalize_whitespace(raw)), F.lit(8)))


def resolve_currency(symbol: Column | str, amount: Column | str) -> Column:
    """A bare ``$`` is USD for sale prices under five million, else ARS; the rule used is kept."""
    bare = (F.btrim(col(symbol)) == "$") & col(amount).isNotNull()
    small = col(amount) < 5000000
    currency = F.when(bare & small, "USD").when(bare, "ARS").otherwise(normalize_currency(symbol))
    rule = (
        F.when(bare & small, "ambiguous_sale_price_below_5000000")
        .when(bare, "ambiguous_sale_price_at_or_above_5000000")
        .otherwise("explicit_currency")
    )
    return F.struct(currency.alias("currency"), rule.alias("rule"))


def parse_decimal(c: Column | str, kind: str = "decimal(38,10)") -> Column:
    """Numbers written with either thousands mark; the last separator and its tail decide."""
    raw = F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"[^\d,.\-]", "")

    def parse(r: Column) -> Column:
        comma, dot = r.contains(","), r.contains(".")
        last_comma, last_dot = F.instr(F.reverse(r), ","), F.instr(F.reverse(r), ".")
        no_dots, no_commas = F.replace(r, F.lit("."), F.lit("")), F.replace(r, F.lit(","), F.lit(""))
        dots = F.length(r) - F.length(no_dots)
        plain = (
            F.when(comma & dot & (last_comma < last_dot), F.replace(no_dots, F.lit(","), F.lit(".")))
            .when(comma & dot, no_commas)
            .when(comma & (last_comma <= 3), F.replace(r, F.lit(","), F.lit(".")))
            .when(comma, no_commas)
            .when((dots > 1) | (dot & (last_dot == 4)), no_dots)
            .otherwise(r)
        )
        return F.when(plain.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), plain.try_cast(kind))

    return bind(raw, parse)


