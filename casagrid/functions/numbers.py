"""Rounding and small numeric helpers.

Money stays DECIMAL and rounds half-even. Statistics are doubles; they are rounded through a decimal
so that a value such as 12.345 does not depend on its binary expansion.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times, also after the optimizer merges projections."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are evaluated once.

    They come out of a generator, so the optimizer does not copy a costly expression into every use of it.
    Existing columns of the same name are replaced.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made)


def round_stat(c: Column | str, digits: int = 2) -> Column:
    return F.round(col(c).cast("decimal(28,8)"), digits).cast("double")


def non_empty(c: Column | str) -> Column:
    """The value, or NULL when it is missing or an empty string."""
    return F.nullif(col(c), F.lit(""))


def truthy(c: Column | str) -> Column:
    """Numeric value, or NULL when it is missing or zero."""
    return F.nullif(col(c), F.lit(0).cast("decimal(10,2)"))


def clamp_score(c: Column | str) -> Column:
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), col(c).cast("double")))
    return F.when(col(c).isNotNull(), round_stat(bounded))


def risk_from_coverage(c: Column | str) -> Column:
    return round_stat(F.lit(100.0) - clamp_score(c))


def weighted_score(pairs: Iterable[tuple[Column, float]]) -> Column:
    """Weighted mean of the known components; unknown ones give their weight away."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for value, weight in pairs:
        known = value.isNotNull()
        total = total + F.when(known, value.cast("double") * F.lit(float(weight))).otherwise(0.0)
        weights = weights + F.when(known, F.lit(float(weight))).otherwise(0.0)
    return round_stat(F.try_divide(total, F.nullif(weights, F.lit(0.0))))


def norm_inverse_distance(c: Column | str, cap_m: float) -> Column:
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(float(cap_m)), col(c).cast("double")))
    return F.when(
        col(c).isNotNull(),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) * (F.lit(1.0) - clipped / F.lit(float(cap_m))))),
    )


def _steps(c: Column, steps: list[tuple[float, str]], lowest: str) -> Column:
    out = F.lit(lowest)
    for bound, label in sorted(steps):
        out = F.when(c >= bound, label).otherwise(out)
    return out


def classify_level(c: Column | str) -> Column:
    """Five-step scale of the layer builders; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), _steps(c, [(20, "baja"), (40, "media"), (60, "media_alta"), (80, "alta")], "muy_baja"))


def security_level(c: Column | str) -> Column:
    c = clamp_score(c)
    return F.when(c.isNull(), "").otherwise(_steps(c, [(45, "media"), (65, "alta")], "baja"))


def location_level(c: Column | str, explicit: Column | None = None) -> Column:
    c = clamp_score(c)
    stepped = F.when(c.isNull(), "").otherwise(
        _steps(c, [(45, "media"), (60, "media_alta"), (70, "alta")], "baja")
    )
    return stepped if explicit is None else F.coalesce(non_empty(explicit), stepped)


def price_short(currency: Column | str, price: Column | str) -> Column:
    """Compact price label such as ``USD 1,2M`` or ``USD 98k``."""
    p = col(price).cast("decimal(16,2)")
    millions = F.bround((p / F.lit(1000000).cast("decimal(10,0)")).cast("decimal(24,8)"), 1).cast("decimal(16,1)")
    thousands = F.bround((p / F.lit(1000).cast("decimal(10,0)")).cast("decimal(24,8)"), 0).cast("decimal(16,0)")
    mega = F.replace(F.regexp_replace(millions.cast("string"), r"\.0$", ""), F.lit("."), F.lit(","))
    body = (
        F.when(F.abs(p) >= 1000000, F.concat(mega, F.lit("M")))
        .when(F.abs(p) >= 1000, F.concat(thousands.cast("string"), F.lit("k")))
        .otherwise(F.bround(p, 0).cast("decimal(16,0)").cast("string"))
    )
    return F.when(p.isNull(), "Consultar").otherwise(F.trim(F.concat_ws(" ", F.coalesce(col(currency), F.lit("")), body)))
