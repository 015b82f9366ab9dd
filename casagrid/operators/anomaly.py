"""Rule, robust and regression anomalies, comparable prices and opportunity rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casagrid.functions.numbers import non_empty, round_stat
from casagrid.functions.quality import BASE_RANGES, USD_RANGE, advert_kind, range_bounds
from casagrid.functions.urls import is_listing_url
from casagrid.operators.quantiles import percentiles
from casagrid.sources.tables import join_rows

GROUP = ["property_type", "condition_category", "age_band"]
MODELS = ("rules", "iqr_mad", "regression", "source_conflict")


def severity(ratio: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(100.0), round_stat(ratio * 100, 0))).cast("int")


def rule_anomalies(df: DataFrame, listings: DataFrame) -> DataFrame:
    """Long rows (property_id, field, value, reason, category), one per broken rule."""
    f = F.col
    df = df.withColumn("_kind", advert_kind("description" in df.columns))

    def row(test: Column, field: str, value: Column, reason: Column, category: str) -> Column:
        body = F.struct(
            F.lit(field).alias("field"), value.cast("string").alias("value"), reason.alias("reason"), F.lit(category).alias("category")
        )
        return F.when(test, body)

    items = [row((f("operation") != "") & (f("operation") != "sale"), "operation", f("operation"), F.lit("no es venta"), "operation")]
    for field in BASE_RANGES:
        low, high = range_bounds(field)
        reason = F.concat(F.lit("fuera de rango "), low.cast("string"), F.lit("-"), high.cast("string"))
        items.append(row(~f(field).between(low, high), field, f(field), reason, "range"))
    price_reason = F.lit(f"fuera de rango {USD_RANGE[0]}-{USD_RANGE[1]}")
    items.append(row((f("currency") == "USD") & ~f("price").between(*USD_RANGE), "price", f("price"), price_reason, "price"))
    direct = df.select("property_id", F.inline(F.array_compact(F.array(*items))))
    shown = df.select("property_id")
    pages = (
        listings.groupBy("property_id")
        .agg(
            F.bool_or(is_listing_url("url")).alias("is_page"),
            F.max(F.struct(f("active").cast("int"), f("last_seen_on"), -f("listing_id"), f("url"))).alias("best"),
        )
        .filter("is_page")
        .select(
            "property_id",
            F.lit("url").alias("field"),
            f("best.url").alias("value"),
            F.lit("parece pagina de listado, no ficha").alias("reason"),
            F.lit("listing_page").alias("category"),
        )
    )
    conflicts = listings.filter(f("source_status") == "metric_conflict_review").select(
        "property_id",
        F.lit("source_status").alias("field"),
        f("source_status").alias("value"),
        F.lit("tabla estructurada contradice descripcion").alias("reason"),
        F.lit("source_conflict").alias("category"),
    )
    # Adverts are reduced before they meet the properties shown.
    return direct.unionByName(join_rows(pages.unionByName(conflicts), shown, "property_id", "left_semi"))


def iqr_mad_outliers(df: DataFrame, minimum: int = 7) -> DataFrame:
    zone = F.coalesce(non_empty("geo_zone"), non_empty("locality"), F.lit("Sin zona"))
    keys = ["zone", "property_type"]
    rows = df.filter(F.col("price_m2").isNotNull()).select(
        "property_id", zone.alias("zone"), "property_type", F.col("price_m2").cast("double").alias("v")
    )
    q = percentiles(rows, keys, "v", {"q1": 0.25, "med": 0.5, "q3": 0.75}).filter(F.col("total") >= minimum)
    rows = join_rows(rows, q, keys).withColumn("dev", F.abs(F.col("v") - F.col("med")))
    mad = percentiles(rows, keys, "dev", {"mad": 0.5}).drop("total")
    iqr = F.col("q3") - F.col("q1")
    rows = join_rows(rows, mad, keys).withColumns(
        {
            "low": F.col("q1") - iqr * 1.5,
            "high": F.col("q3") + iqr * 1.5,
            "z": F.coalesce(F.try_divide(F.lit(0.6745) * (F.col("v") - F.col("med")), F.nullif("mad", F.lit(0.0))), F.lit(0.0)),
        }
    )
    v, z = F.col("v"), F.abs(F.col("z"))
    outside = (v < F.col("low")) | (v > F.col("high"))
    gap = F.when(outside, F.least(F.abs(v - F.col("low")), F.abs(v - F.col("high")))).otherwise(z)
    ratio = F.when(z != 0, z / 5).otherwise(gap / F.greatest(F.lit(1.0), F.col("med")))
    return rows.filter(outside | (z >= 3.5)).select(
        "property_id",
        F.lit("modelo IQR/MAD").alias("field"),
        round_stat(v, 0).cast("bigint").alias("value"),
        F.concat(F.lit("USD/m2 atipico en "), "zone", F.lit(" ("), "property_type", F.lit(")")).alias("reason"),
        F.lit("iqr_mad").alias("model"),
        severity(ratio).alias("severity"),
    )


def comparable_points(df: DataFrame) -> DataFrame:
    return df.filter(
        (F.col("currency") == "USD") & F.col("valid_price").isNotNull() & F.col("comparable_area").isNotNull()
    ).withColumns({"area": F.col("comparable_area").cast("double"), "cost": F.col("valid_price").cast("double")})


def hedonic_fit(df: DataFrame, minimum: int = 5) -> DataFrame:
    """Price on area per comparable group; slope, intercept and residual deviation from one pass."""
    fit = (
        comparable_points(df)
        .groupBy(*GROUP)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_slope("cost", "area").alias("slope"),
            F.regr_intercept("cost", "area").alias("intercept"),
            F.regr_syy("cost", "area").alias("_syy"),
            F.regr_sxy("cost", "area").alias("_sxy"),
        )
    )
    sse = F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope") * F.col("_sxy"))
    fit = fit.filter((F.col("n") >= minimum) & F.col("slope").isNotNull())
    return fit.select(*GROUP, "n", "slope", "intercept", F.sqrt(sse / (F.col("n") - 1)).alias("std"))


def expected_price(df: DataFrame, top: int | None = 220) -> DataFrame:
    """Expected price and discount of each property against its comparable group."""
    pts = comparable_points(df).filter((F.col("area") > 0) & (F.col("cost") > 0))
    sizes = pts.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("comparables"))
    rows = pts.join(sizes, GROUP).join(hedonic_fit(pts).drop("n"), GROUP, "left")
    expected = F.col("slope") * F.col("area") + F.col("intercept")
    rows = rows.withColumn("expected", F.when(expected > 0, expected))
    rows = rows.withColumns(
        {
            "discount": (F.col("expected") - F.col("cost")) / F.col("expected") * 100,
            "delta": F.col("cost") - F.col("expected"),
            "point_m2": round_stat(F.col("cost") / F.col("area")),
        }
    )
    return rows if top is None else rows.orderBy(F.desc("last_seen_on"), "property_id").limit(top)


def regression_anomalies(df: DataFrame, threshold: float = 1.8) -> DataFrame:
    pts = comparable_points(df)
    rows = join_rows(pts, hedonic_fit(pts).filter(F.col("std") > 0), GROUP)
    resid = F.col("cost") - (F.col("slope") * F.col("area") + F.col("intercept"))
    rows = rows.withColumn("resid", resid).filter(F.abs("resid") >= F.col("std") * threshold)
    side = F.when(F.col("resid") < 0, "por debajo").otherwise("por encima")
    return rows.select(
        "property_id",
        F.lit("regresion comparable").alias("field"),
        round_stat("resid", 0).cast("bigint").alias("value"),
        F.concat(F.lit("precio "), side, F.lit(" de comparables: "), F.concat_ws(" / ", *GROUP)).alias("reason"),
        F.lit("regression").alias("model"),
        severity(F.abs("resid") / F.greatest(F.lit(1.0), F.col("std") * 3)).alias("severity"),
    )


def model_anomalies(df: DataFrame, shown: int | None = None) -> DataFrame:
    """Both models, the later row replacing an earlier one of equal (property, field, reason); all rows, or the first
    ``shown`` for a list."""
    rows = iqr_mad_outliers(df).withColumn("rank", F.lit(0)).unionByName(regression_anomalies(df).withColumn("rank", F.lit(1)))
    best = rows.groupBy("property_id", "field", "reason").agg(F.max(F.struct("rank", "value", "model", "severity")).alias("b"))
    out = best.select("property_id", "field", "reason", "b.rank", "b.value", "b.model", "b.severity")
    return out if shown is None else out.orderBy("rank", "property_id", "reason").limit(shown)


def anomaly_summary(rows: DataFrame) -> DataFrame:
    """Count, mean severity and first property per model; models without rows stay with zero."""
    models = rows.sparkSession.createDataFrame([(m,) for m in MODELS], "model string")
    found = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("total"), round_stat(F.avg("severity"), 0).cast("bigint").alias("avg_severity"), F.min("property_id").alias("first_property")
    )
    zero = F.lit(0).cast("bigint")
    return models.join(found, "model", "left").select(
        "model", F.coalesce("total", zero).alias("total"), F.coalesce("avg_severity", zero).alias("avg_severity"), "first_property"
    )


def rules_as_models(rules: DataFrame) -> DataFrame:
    model = F.when(F.col("category") == "source_conflict", "source_conflict").otherwise("rules")
    sev = F.when(F.col("category").isin("price", "range"), 70).otherwise(55)
    return rules.select("property_id", "field", model.alias("model"), sev.alias("severity"))


def with_median(df: DataFrame, value: str, where: Column) -> DataFrame:
    """Attach the exact median of ``value`` over the rows that pass ``where``."""
    med = percentiles(df.filter(where), [], value, {"median": 0.5}).select("median")
    return df.filter(where).withColumn("median_m2", med.scalar())


def security_arbitrage(df: DataFrame, top: int = 40) -> DataFrame:
    f = F.col
    rows = with_median(df, "price_m2", f("price_m2").isNotNull() & f("security_coverage_score").isNotNull())
    v, med, cover, risk = f("price_m2").cast("double"), f("median_m2"), f("security_coverage_score"), f("security_risk_score")
    rank = (
        F.when((cover >= 60) & (v <= med), 4)
        .when((risk >= 55) & (v <= med), 3)
        .when((risk >= 55) & (v > med), 2)
        .when((cover >= 60) & (v > med * 1.15), 1)
    )
    kinds = F.array(*[F.lit(k) for k in ("Prima de seguridad", "Sobreprecio riesgoso", "Negociable por riesgo", "Oportunidad segura")])
    rows = rows.filter(risk.isNotNull()).withColumn("priority", rank).filter(f("priority").isNotNull())
    rows = rows.withColumns({"kind": F.element_at(kinds, f("priority")), "lead": F.when(f("priority") == 4, cover).otherwise(risk), "m2": v})
    out = rows.orderBy(F.desc("priority"), F.desc("lead"), "m2", "property_id").limit(top)
    return out.select("property_id", "kind", "priority", round_stat("median_m2", 0).cast("bigint").alias("median_m2"), "m2", cover, risk)


def location_opportunities(df: DataFrame, top: int = 30) -> DataFrame:
    f = F.col
    rows = with_median(df, "price_m2", f("price_m2").isNotNull() & f("overall_score").isNotNull())
    v, med, score = f("price_m2").cast("double"), f("median_m2"), f("overall_score")
    flood, transport = F.coalesce("flood_penalty_score", F.lit(0.0)), F.coalesce("transport_score", F.lit(0.0))
    land = F.coalesce(F.nullif("valid_land_area", F.lit(0).cast("decimal(10,2)")), f("valid_total_area")).cast("double")
    rank = (
        F.when((score >= 65) & (v <= med), 5)
        .when((v > med * 1.15) & ((score < 50) | (flood >= 55) | (transport < 45)), 4)
        .when((land >= 300) & (score >= 60) & (flood < 45), 3)
        .when((score >= 60) & ~f("location_confidence").isin("high", "medium"), 2)
    )
    kinds = F.array(*[F.lit(k) for k in ("", "Revisión necesaria", "Potencial de desarrollo", "Sobreprecio con riesgo", "Arbitraje territorial")])
    rows = rows.withColumn("priority", rank).filter(f("priority").isNotNull()).withColumns({"kind": F.element_at(kinds, f("priority")), "m2": v})
    out = rows.orderBy(F.desc("priority"), F.desc("overall_score"), "m2", "property_id").limit(top)
    return out.select(
        "property_id", "kind", "priority", round_stat("median_m2", 0).cast("bigint").alias("median_m2"), "m2", "overall_score", "flood_penalty_score", "transport_score"
    )


def location_ranking(df: DataFrame, top: int = 40) -> DataFrame:
    rows = df.filter(F.col("overall_score").isNotNull()).withColumn("m2", F.col("price_m2").cast("double"))
    order = [F.desc("overall_score"), F.coalesce("m2", F.lit(0.0)).asc(), F.col("property_id").asc()]
    return rows.orderBy(*order).limit(top).select("property_id", "overall_score", "level", "zone_name", "m2")


def value_scatter(df: DataFrame, top: int = 120) -> DataFrame:
    """Score against price with a small fixed offset per id, so equal scores do not overlap."""
    rows = df.filter(F.col("overall_score").isNotNull() & F.col("price_m2").isNotNull()).withColumn("y", F.col("price_m2").cast("double"))
    shift = (F.pmod("property_id", F.lit(9)) - 4).cast("double") * 0.08
    x = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("overall_score") + shift))
    out = rows.orderBy(F.desc("overall_score"), "y", "property_id").limit(top)
    return out.select("property_id", round_stat(x, 6).alias("x"), "y")


def security_price_rows(df: DataFrame, top: int = 120) -> DataFrame:
    f = F.col
    rows = df.filter(f("latitude").isNotNull() & f("security_coverage_score").isNotNull())
    rows = rows.withColumn("m2", f("price_m2").cast("double"))
    out = rows.orderBy(F.coalesce("security_risk_score", F.lit(0.0)).desc(), F.coalesce("m2", F.lit(0.0)).asc(), "property_id").limit(top)
    return out.select("property_id", "security_coverage_score", "security_risk_score", "m2")


def opportunity_score(expected: DataFrame, top: int = 12) -> DataFrame:
    """Discount plus location, quality, safety and price bonuses; ``expected`` comes from expected_price."""
    f = F.col
    rows = expected.filter((f("discount") > 3) & (f("comparables") >= 5))
    bonus = (
        F.coalesce(F.greatest(F.lit(0.0), F.lit(1100.0) - f("point_m2")) / 35, F.lit(0.0))
        + F.when(f("location_confidence").isin("high", "medium"), 8.0).otherwise(0.0)
        + F.coalesce(f("quality_score"), F.lit(0)) / 12
        + F.when(f("security_coverage_score") >= 60, 8.0).otherwise(0.0)
        + F.when(f("security_risk_score") >= 55, 4.0).otherwise(0.0)
        + F.when(f("overall_score") >= 65, 10.0).otherwise(0.0)
        + F.when(f("flood_penalty_score") >= 55, -8.0).otherwise(0.0)
    )
    tag = (
        F.when(f("security_coverage_score") >= 60, "Oportunidad segura")
        .when(f("security_risk_score") >= 55, "Negociable por riesgo")
        .otherwise("Oportunidad")
    )
    context = F.when(f("overall_score") >= 65, "Buen contexto territorial").otherwise("")
    rows = rows.withColumns({"score": f("discount") + bonus, "security_tag": tag, "territory_tag": context})
    return rows.orderBy(F.desc("score"), "property_id").limit(top).select(
        "property_id", round_stat("score", 4).alias("score"), round_stat("discount", 4).alias("discount"), "security_tag", "territory_tag"
    )


def under_trend(expected: DataFrame, top: int = 80) -> DataFrame:
    rows = expected.filter((F.col("discount") > 3) & (F.col("comparables") >= 5))
    return rows.orderBy("delta", "property_id").limit(top).select(
        "property_id", round_stat("expected", 4).alias("expected"), round_stat("delta", 4).alias("delta"), "comparables"
    )


def latest_first(df: DataFrame, keep: Column, columns: list[Column], top: int) -> DataFrame:
    return df.filter(keep).orderBy(F.desc("last_seen_on"), "property_id").limit(top).select("property_id", *columns)


