"""Plausible ranges and the curated metrics every statistic starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casagrid.functions.numbers import bind, col, non_empty, truthy
from casagrid.functions.text import fold_text

# Plausible ranges per field.
BASE_RANGES = {
    "rooms": (0, 15),
    "bedrooms": (0, 12),
    "bathrooms": (0, 10),
    "garages": (0, 8),
    "covered_area": (10, 3000),
    "land_area": (20, 10000),
    "total_area": (20, 10000),
}
AREA_FIELDS = ("covered_area", "land_area", "total_area")
LARGE_LAND_TYPES = ("land", "country_house", "other")
USD_RANGE = (1000, 5000000)
MISSING_LABEL = "Sin dato"

# Labels shown for codes.
TYPE_LABELS = {
    "house": "Casa",
    "apartment": "Departamento",
    "ph": "PH",
    "duplex": "Dúplex",
    "land": "Terreno",
    "country_house": "Quinta",
    "other": "Otro",
}
AGE_LABELS = {
    "0-5": "0-5 anos",
    "6-20": "6-20 anos",
    "21-40": "21-40 anos",
    "41+": "41+ anos",
    "unknown": "antiguedad sin dato",
}


GARAGE = r"(?U)^(?![^|]*\b(?:casa|chalet|depto|departamento|ph|duplex|triplex|monoambiente|ambientes?)\b)[^|]*\b(?:cochera|garage|garaje|cocheras)\b"
COMMERCIAL = r"(?U)\b(?:galpon|deposito|nave|fraccion|industrial)\b"


def advert_kind(has_description: bool = True) -> Column:
    """1 garage-like, 2 commercial-like, 3 neither. The text is folded once, then tested."""
    title = F.replace(F.coalesce(F.col("title"), F.lit("")), F.lit("|"), F.lit(" "))
    text = fold_text(F.concat_ws("|", title, F.col("description") if has_description else F.lit(""), F.col("property_type")))
    return bind(text, lambda t: F.when(t.rlike(GARAGE), 1).when(t.rlike(COMMERCIAL), 2).otherwise(3))


def range_bounds(field: str) -> tuple[Column, Column]:
    low, high = BASE_RANGES[field]
    if field not in AREA_FIELDS:
        return F.lit(low), F.lit(high)
    usual = F.lit(high)
    if field != "covered_area":
        usual = F.when(F.col("property_type").isin(*LARGE_LAND_TYPES), 100000).otherwise(high)
    kind = F.col("_kind")
    return (
        F.element_at(F.array(F.lit(8), F.lit(10), F.lit(low)), kind),
        F.element_at(F.array(F.lit(100), F.lit(100000), usual), kind),
    )


def first_nonzero(*fields: str) -> Column:
    return F.get(F.filter(F.array(*[F.col(f) for f in fields]), lambda v: v != 0), F.lit(0))


def valid_value(field: str) -> Column:
    low, high = range_bounds(field)
    return F.when(F.col(field).between(low, high), F.col(field))


def valid_price(price: Column | str = "price", currency: Column | str = "currency") -> Column:
    p = col(price)
    return F.when((col(currency) != "USD") | p.between(*USD_RANGE), p)


def age_band(c: Column | str) -> Column:
    c = col(c)
    return (
        F.when(c.isNull(), "unknown").when(c <= 5, "0-5").when(c <= 20, "6-20").when(c <= 40, "21-40").otherwise("41+")
    )


def label_of(c: Column | str, labels: dict[str, str]) -> Column:
    out = col(c)
    for code, label in labels.items():
        out = F.when(col(c) == code, label).otherwise(out)
    return out


def price_per_m2(price: Column, area: Column) -> Column:
    """DECIMAL quotient rounded half-even to cents."""
    quotient = F.try_divide(price.cast("decimal(16,2)"), truthy(area).cast("decimal(10,2)"))
    return F.bround(quotient, 2).cast("decimal(18,2)")


def raw_price_per_m2(df_price: Column | str = "price") -> Column:
    area = F.coalesce(truthy("covered_area"), truthy("total_area"), truthy("land_area"))
    return price_per_m2(col(df_price), area)


def geo_zone() -> Column:
    return F.coalesce(non_empty("inferred_zone"), non_empty("zone_name"), non_empty("inferred_neighborhood"))


def declared_neighborhood() -> Column:
    return F.coalesce(non_empty("detected_neighborhood"), non_empty("neighborhood"))


def safe_label(c: Column | str) -> Column:
    return F.coalesce(non_empty(c), F.lit(MISSING_LABEL))


def curate(df: DataFrame) -> DataFrame:
    """Add the curated metrics once, so that every panel reads them instead of re-deriving them."""
    df = df.withColumn("_kind", advert_kind("description" in df.columns))
    df = df.withColumns({f"valid_{f}": valid_value(f) for f in BASE_RANGES if f in df.columns})
    df = df.withColumns(
        {
            "valid_price": valid_price(),
            "valid_area": first_nonzero("valid_covered_area", "valid_total_area", "valid_land_area"),
            "comparable_area": F.when(
                F.col("property_type") == "land", F.coalesce(truthy("valid_land_area"), F.col("valid_total_area"))
            ).otherwise(F.coalesce(first_nonzero("valid_covered_area", "valid_total_area"), F.col("valid_land_area"))),
            "age_band": age_band("age_years"),
        }
    )
    quotient = F.try_divide(F.col("valid_price").cast("decimal(16,2)"), F.col("valid_area").cast("decimal(10,2)"))
    df = df.withColumn("price_m2", F.when(F.col("currency") == "USD", F.bround(quotient, 2).cast("decimal(18,2)")))
    if "zone_name" in df.columns:
        df = df.withColumn("geo_zone", geo_zone())
    return df.drop("_kind")
