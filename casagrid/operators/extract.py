"""Fields, map pins, links and totals from raw pages, as column expressions over the page table."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casagrid.functions.address import FLAGS, infer_property_type, normalize_currency, parse_decimal, unescape_html
from casagrid.functions.numbers import bind, col, non_empty, once
from casagrid.functions.text import repair_mojibake, squeeze
from casagrid.functions.urls import absolute_url, external_id, url_domain, url_path
from casagrid.operators.geocode import is_default_pin, outside_target

S_FLAGS = "(?isU)"


def visible_text(html: Column | str) -> Column:
    """Page text without scripts, styles, comments and tags."""
    t = F.regexp_replace(col(html), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return squeeze(repair_mojibake(unescape_html(F.regexp_replace(t, r"(?s)<[^>]+>", " "))))


def first_match(text: Column, *patterns: str, group: int = 1) -> Column:
    """First pattern that matches gives its captured part."""
    return F.coalesce(*[non_empty(F.btrim(F.regexp_extract(text, S_FLAGS + p, group))) for p in patterns])


def first_tag(html: Column, *tags: str) -> Column:
    return F.coalesce(*[non_empty(visible_text(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1))) for t in tags])


# Wording of prices, rooms and areas on advert pages.
PRICE = r"\b(USD|U\$S|US\$|ARS|\$)\s*([\d.,]+)"
COUNT_PATTERNS = {
    "rooms": (r"(\d+)\s*(?:ambientes|ambiences)",),
    "bedrooms": (r"(\d+)\s*(?:dormitorios|habitaciones|rooms)",),
    "garages": (r"(\d+)\s*(?:cocheras|garages)",),
    "age_years": (r"antig(?:ü|u)edad\s*:?\s*(\d+)",),
}
DECIMAL_PATTERNS = {
    "bathrooms": (r"(\d+(?:[.,]\d+)?)\s*(?:baños|bathrooms)",),
    "covered_area": (r"(?:superficie cubierta|sup\.?\s*cubierta|cubierta|built in)\s*:?\s*([\d.,]+)\s*m", r"([\d.,]+)\s*m2\s*\(Built in"),
    "total_area": (r"(?:superficie total|sup\.?\s*total|terreno)\s*:?\s*([\d.,]+)\s*m",),
    "land_area": (r"(?:terreno|lote)\s*:?\s*([\d.,]+)\s*m",),
}
MAX_IMAGES = 30


def page_fields(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Advert fields of each page: identity, title, price, counts, areas, images."""
    df = once(pages, {"_text": visible_text(html)})
    t = F.col("_text")
    images = F.regexp_extract_all(col(html), F.lit(r"""(?is)<img\b[^>]*?\ssrc\s*=\s*["']([^"']+)["']"""), 1)
    cols: dict[str, Column] = {
        "external_id": external_id(url),
        "title": F.coalesce(first_tag(col(html), "h1", "title"), F.lit("Propiedad")),
        "currency": F.coalesce(bind(first_match(t, PRICE), lambda c: F.when(c.isNotNull(), normalize_currency(c))), F.lit("")),
        "price": parse_decimal(first_match(t, PRICE, group=2)),
        "images": F.slice(F.filter(images, lambda u: u.startswith("http")), 1, MAX_IMAGES),
    }
    cols |= {c: parse_decimal(first_match(t, *p)).cast("int") for c, p in COUNT_PATTERNS.items()}
    cols |= {c: parse_decimal(first_match(t, *p)) for c, p in DECIMAL_PATTERNS.items()}
    df = df.withColumns(cols)
    return df.withColumn("property_type", infer_property_type("title", F.left(t, F.lit(1000)))).drop("_text")


LD_SCRIPT = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""


def first_object(blocks: Sequence[str] | None, wanted: frozenset[str]) -> str | None:
    """The first object of a wanted type in JSON blocks, at any depth: parents first, ``@graph`` before other members,
    which come in document order. Blocks that are not JSON are skipped."""
    for block in () if blocks is None else blocks:
        try:
            todo = [json.loads(block)]
        except (ValueError, RecursionError):
            continue
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                kind = node.get("@type")
                if wanted.intersection(x for x in (kind if isinstance(kind, list) else [kind]) if isinstance(x, str)):
                    return json.dumps(node, ensure_ascii=False)
                members = list(node.values())
                node = [node["@graph"], *members] if node.get("@graph") else members
            if isinstance(node, list):
                todo += [x for x in reversed(node) if isinstance(x, dict | list)]
    return None


def json_ld(pages: DataFrame, key: str, types: Sequence[str], html: str = "html") -> DataFrame:
    """First JSON-LD object of a wanted type per page, in the order of :func:`first_object`.

    Spark cuts the blocks out of the page; only they reach Python, in Arrow batches.
    """
    wanted = frozenset(types)

    @F.pandas_udf("string")
    def pick(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: first_object(b, wanted))

    blocks = pages.select(key, F.regexp_extract_all(col(html), F.lit(LD_SCRIPT), 1).alias("_blocks")).filter(F.size("_blocks") > 0)
    return blocks.select(key, pick("_blocks").alias("object")).filter(F.col("object").isNotNull())


# How pages publish a pin, in order of trust. Each pattern captures latitude and longitude.
NUM = r"(-?\d+(?:[.,]\d+)?)"
PIN_PATTERNS = (
    ("data-latitude", rf"""data-latitude\s*=\s*["']{NUM}["'][^>]*?data-longitude\s*=\s*["']{NUM}["']"""),
    ("propertyMapData", rf"""propertyMapData\s*=\s*\{{[^}}]*?"lat(?:itude)?"\s*:\s*"?{NUM}"?[^}}]*?"l(?:ongitude|ng|ang|on)"\s*:\s*"?{NUM}"""),
    ("data-map", rf"""data-map\s*=\s*["'][^>]*?lat(?:itude)?(?:"|&quot;)\s*:\s*(?:"|&quot;)?{NUM}[^>]*?l(?:ongitude|ng|ang|on)(?:"|&quot;)\s*:\s*(?:"|&quot;)?{NUM}"""),
    ("base64_map", r"""mapLatOf\s*=\s*['"]([A-Za-z0-9+/=]+)['"].{0,240}?mapLngOf\s*=\s*['"]([A-Za-z0-9+/=]+)['"]"""),
    ("jsonld_geo", rf""""geo"\s*:\s*\{{[^}}]*?"lat(?:itude)?"\s*:\s*"?{NUM}"?[^}}]*?"l(?:ongitude|ng|on)"\s*:\s*"?{NUM}"""),
    ("regex_pair", rf""""lat(?:itude)?"\s*:\s*"?(-?\d+[.,]\d+)"?.{{0,180}}?"l(?:ongitude|ng)"\s*:\s*"?(-?\d+[.,]\d+)"""),
    ("fallback_latlon", r"""(-34[.,]\d{4,}).*?(-58[.,]\d{4,})"""),
)


def map_coordinates(pages: DataFrame, key: str, html: str = "html", require_target: bool = True) -> DataFrame:
    """Published pins per page in order of trust, without default pins, outsiders and repeats."""

    def number(c: Column) -> Column:
        return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")

    def decoded(c: Column) -> Column:
        return F.try_to_binary(c, F.lit("base64")).try_cast("string")

    def pins(rank: int, method: str, lats: Column, lons: Column):
        read = decoded if method == "base64_map" else (lambda c: c)

        def pin(p: Column, i: Column) -> Column:
            lat, lon = number(read(p["a"])), number(read(p["o"]))
            return F.struct(F.lit(rank).alias("rank"), i.alias("at"), F.lit(method).alias("method"), lat.alias("latitude"), lon.alias("longitude"))

        return F.transform(F.arrays_zip(lats.alias("a"), lons.alias("o")), pin)

    arrays = []
    for rank, (method, pattern) in enumerate(PIN_PATTERNS):
        flagged = F.lit("(?is)" + pattern)
        lats, lons = F.regexp_extract_all(col(html), flagged, 1), F.regexp_extract_all(col(html), flagged, 2)
        if method == "fallback_latlon":
            lats = F.slice(F.regexp_extract_all(col(html), F.lit(r"(-34[.,]\d{4,})"), 1), 1, 1)
            lons = F.slice(F.regexp_extract_all(col(html), F.lit(r"(-58[.,]\d{4,})"), 1), 1, 1)
        arrays.append(pins(rank, method, lats, lons))
    rows = pages.select(key, F.inline(F.concat(*arrays)))
    lat, lon = F.col("latitude"), F.col("longitude")
    rows = rows.filter(lat.isNotNull() & lon.isNotNull() & ~is_default_pin(lat, lon)).withColumn("outside_target", outside_target(lat, lon))
    if require_target:
        rows = rows.filter(~F.col("outside_target"))
    spot = [F.round(lat, 7).alias("_la"), F.round(lon, 7).alias("_lo")]
    best = rows.groupBy(key, *spot).agg(F.min(F.struct("rank", "at", "method", "latitude", "longitude", "outside_target")).alias("_b"))
    return best.select(key, "_b.*")


def first_coordinate(coords: DataFrame, key: str) -> DataFrame:
    return coords.groupBy(key).agg(F.min(F.struct("rank", "at", "method", "latitude", "longitude")).alias("_b")).select(key, "_b.method", "_b.latitude", "_b.longitude")


def labeled_fields(text: Column | str, labels: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Value after each label up to the next known label."""
    stop = "|".join(p for options in labels.values() for p in options)
    out = {}
    for name, options in labels.items():
        pattern = rf"(?:{'|'.join(options)})\s*:?\s*(.+?)(?=\s+(?:{stop})(?:\s*:|\s+)|\s*$)"
        out[name] = non_empty(squeeze(F.regexp_extract(col(text), S_FLAGS + pattern, 1)))
    return out


UNIT = r"(?:m2|m²|mts²?)?"


def number_after(text: Column | str, *labels: str) -> Column:
    return parse_decimal(first_match(col(text), rf"(?:{'|'.join(labels)})\s*:?\s*([\d.,]+)\s*{UNIT}"))


def number_before(text: Column | str, *labels: str) -> Column:
    return parse_decimal(first_match(col(text), rf"([\d.,]+)\s*{UNIT}\s*(?:{'|'.join(labels)})"))


def surface_pair(text: Column | str) -> Column:
    pattern = r"([\d.,]+)\s*m2\s*\(\s*Built\s+in\s*([\d.,]+)\s*m2\s*\)"
    return F.struct(parse_decimal(first_match(col(text), pattern)).alias("total"), parse_decimal(first_match(col(text), pattern, group=2)).alias("built"))


def dimensions(text: Column | str) -> Column:
    """``10x30`` as area, front and depth; a plain number as area."""
    pattern = r"([\d.,]+)\s*(?:x|×|por)\s*([\d.,]+)"
    front, depth = parse_decimal(first_match(col(text), pattern)), parse_decimal(first_match(col(text), pattern, group=2))
    area = F.when(front.isNotNull() & depth.isNotNull(), front.cast("decimal(18,4)") * depth.cast("decimal(18,4)")).otherwise(parse_decimal(text))
    return F.struct(area.cast("double").alias("area"), front.cast("double").alias("front"), depth.cast("double").alias("depth"))


def area_value(text: Column | str) -> Column:
    """First number of a range such as ``120 / 150``."""
    return F.coalesce(parse_decimal(first_match(col(text), r"([\d.,]+)\s*/\s*[\d.,]+")), parse_decimal(text))


def plausible_int(text: Column | str, maximum: int) -> Column:
    """Whole value inside the bound, else the first such number in the text; plain negatives are refused."""
    t = F.coalesce(col(text).cast("string"), F.lit(""))
    whole = parse_decimal(t).cast("int")
    numbers = F.transform(F.regexp_extract_all(t, F.lit(r"(?<![-\d.,])(\d+)(?![\d.,])"), 1), lambda n: n.try_cast("int"))
    inside = F.get(F.filter(numbers, lambda n: (n >= 0) & (n <= maximum)), F.lit(0))
    negative = t.rlike(r"^\s*-\s*\d+(?:[.,]\d+)?\s*$")
    return F.when(whole.between(0, maximum), whole).when(~negative, inside)


def garage_value(text: Column | str) -> Column:
    t = squeeze(text)
    return (
        F.when(t.rlike(FLAGS + r"\bsin\b|no\s+tiene|no\s+posee"), 0)
        .when(plausible_int(t, 8).isNotNull(), plausible_int(t, 8))
        .when(t.rlike(FLAGS + r"cochera|garage|garaje"), 1)
    )


UNIT_OFFER = (
    r"(?iU)Unidad\s+(.+?)\s+[–-]\s+(\d+)\s*Ambientes?.*?Superficie\s+total\s*:?\s*([\d.,]+)\s*m(?:2|²)?.*?Precio\s*:?\s*(USD|U\$S|US\$|ARS|\$)\s*([\d.,]+)"
)


def unit_offers(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per unit offered inside an advert."""
    t = squeeze(text)
    parts = [F.regexp_extract_all(t, F.lit(UNIT_OFFER), i).alias(n) for i, n in enumerate(("unit", "rooms", "area", "symbol", "price"), 1)]
    rows = df.select(key, F.posexplode(F.arrays_zip(*parts)).alias("pos", "u"))
    return rows.select(
        key,
        "pos",
        squeeze("u.unit").alias("unit"),
        parse_decimal("u.rooms").cast("int").alias("rooms"),
        parse_decimal("u.area").cast("double").alias("total_area"),
        normalize_currency("u.symbol").alias("currency"),
        parse_decimal("u.price").cast("double").alias("price"),
    ).filter(F.col("price").isNotNull() & F.col("total_area").isNotNull())


def metric_conflicts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Structured values that the description contradicts."""
    t = col(text)
    prices = F.transform(F.regexp_extract_all(t, F.lit(FLAGS + r"(?:U\$S|U\$D|US\$|USD|ARS|\$)\s*([\d.,]+)"), 1), lambda p: parse_decimal(p))
    own = F.col("price").cast("decimal(38,10)")
    wrong = F.filter(prices, lambda p: p.isNotNull() & (p != own))

    def item(field: str, mine: Column, theirs: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), mine.cast("double").alias("structured"), theirs.cast("double").alias("in_text"))

    items = F.when(own.isNotNull(), F.transform(wrong, lambda p: item("price", own, p))).otherwise(F.array())
    covered = area_value(first_match(t, r"SUP\s*CUBIERTA\s*:?\s*([\d.,]+)\s*(?:m2|m²|mts)?"))
    land = area_value(first_match(t, r"SOBRE\s+LOTE.*?\(([\d.,]+)\s*(?:m2|m²)\)", r"LOTE.*?\(([\d.,]+)\s*(?:m2|m²)\)"))
    for field, found in (("covered_area", covered), ("land_area", land)):
        mine = F.col(field).cast("decimal(38,10)")
        items = F.concat(items, F.when(mine.isNotNull() & (found != mine), F.array(item(field, mine, found))).otherwise(F.array()))
    return df.select(key, F.inline(items))


def hide_placeholder_price(df: DataFrame) -> DataFrame:
    """Prices that only fill a form are hidden, with the reason."""
    p, cur = F.col("price"), F.col("currency")
    reason = (
        F.when(p == 1, "placeholder_price_1")
        .when((cur == "ARS") & (p < 1000), "ars_placeholder_price")
        .when((F.col("status") != "active") & (cur == "ARS") & p.isNotNull(), "non_active_ars_price")
    )
    df = df.withColumn("hidden_reason", reason)
    gone = F.col("hidden_reason").isNotNull()
    return df.withColumns({"price": F.when(~gone, p), "currency": F.when(gone | p.isNull(), "").otherwise(cur), "hidden_reason": F.coalesce("hidden_reason", F.lit(""))})


def page_links(pages: DataFrame, key: str, patterns: Sequence[str], url: str = "url", html: str = "html") -> DataFrame:
    """Same-host links whose path matches, without fragments, each once at its first place."""
    hrefs = F.regexp_extract_all(col(html), F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*["']([^"']*)["']"""), 1)
    rows = pages.select(key, F.col(url).alias("_page"), F.posexplode(hrefs).alias("pos", "_href"))
    rows = rows.filter(~F.lower("_href").rlike("^(mailto:|tel:|whatsapp:)"))
    rows = rows.withColumn("link", absolute_url("_page", unescape_html("_href")))
    own = (url_domain("link") == "") | (url_domain("link") == url_domain("_page"))
    wanted = F.lit(False)
    for p in patterns:
        wanted = wanted | url_path("link").rlike("(?i)" + p)
    return rows.filter(own & wanted).groupBy(key, "link").agg(F.min("pos").alias("pos"))


# How portals state their number of results.
TOTAL_PATTERNS = (
    r"\bFound\s+([\d.]+)\s+results\b",
    r"\bShowing\s+\d+\s+to\s+\d+\s+properties\s+of\s+([\d.]+)\s+found\b",
    r"\b[\d.]+\s+a\s+[\d.]+\s+de\s+([\d.]+)\s+(?:propiedades|inmuebles)\b",
    r"\b([\d.]+)\s+(?:casas|propiedades|inmuebles)\s+en\s+venta\b",
    r"\b([\d.]+)\s+Results?\s+Found\b",
    r"\b([\d.]+)\s+Resultados?\s+(?:de\s+b[uú]squeda|encontrados?)\b",
    r"\b(?:Se\s+encontraron|Encontramos)\s+([\d.]+)\s+resultados\b",
    r"\bMostrando\s+[\d.]+\s+a\s+[\d.]+\s+propiedades\s+de\s+([\d.]+)\s+encontradas\b",
    r"\b(?:Se\s+encontraron|Encontramos)\s+([\d.]+)\s+propiedades\b",
    r"\b([\d.]+)\s+propiedades\s+encontradas?\b",
    r"\b([\d.]+)\s+Propiedades\s+e\s+inmuebles\b",
    r"\bEn\s+.+?\s+tenemos\s+([\d.]+)\s+Propiedades\b",
    r"\bArgentina\s*\(([\d.]+)\)\s+Tipo\s+de\s+operaci[oó]n\b",
)


def declared_total(text: Column | str) -> Column:
    options = [non_empty(F.regexp_extract(col(text), FLAGS + p, 1)) for p in TOTAL_PATTERNS]
    return F.replace(F.coalesce(*options), F.lit("."), F.lit("")).try_cast("int")


def max_page(html: Column | str) -> Column:
    pages = F.regexp_extract_all(col(html), F.lit(r"(?i)(?:pagina-|/page/|(?:[?&]|&amp;)page=)(\d+)"), 1)
    return F.array_max(F.transform(pages, lambda p: p.try_cast("int")))


def coverage_ratio(found: Column, total: Column) -> Column:
    return F.round(F.try_divide(found.cast("double"), F.nullif(total.cast("double"), F.lit(0.0))) * 100, 1)


def fetch_outcome(status: Column | str, text: Column | str) -> Column:
    t = F.lower(F.coalesce(col(text), F.lit("")))
    gone = col(status).isin(404, 410) | t.rlike("aviso terminado|404 client error|410 client error|404 not found|410 gone")
    blocked = (col(status) == 403) | t.rlike("403|forbidden|cloudfront|request blocked")
    return F.when(gone, "gone").when(blocked, "blocked").when(col(status) >= 400, "error").otherwise("ok")


# Names that place a text inside or outside the target area.
TARGET_WORDS = ("hurlingham", "villa tesei", "william morris", "william c. morris")


def in_target_text(text: Column | str) -> Column:
    out = F.lit(False)
    for word in TARGET_WORDS:
        out = out | F.lower(col(text)).contains(word)
    return out


def coverage_audit(pages: DataFrame, source: Column, text: Column, found: Column) -> DataFrame:
    """Per source: the largest declared total, links found, their ratio and a status."""
    rows = pages.select(source.alias("source"), declared_total(text).alias("declared"), found.alias("found"))
    agg = rows.groupBy("source").agg(F.max("declared").alias("declared_total"), F.sum("found").alias("urls_found"), F.count(F.lit(1)).alias("pages_seen"))
    ratio = coverage_ratio(F.col("urls_found"), F.col("declared_total"))
    status = F.when(F.col("declared_total").isNull(), "unknown").when(ratio < 80, "partial").otherwise("ok")
    return agg.withColumns({"coverage_ratio": ratio, "status": status})


