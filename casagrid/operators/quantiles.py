"""Exact order statistics without bringing a group into one task.

A group may hold a third of the table, so its values are never gathered in one place. Equal values are
counted first, the counts are laid into a monotone histogram of about a thousand steps per group, the steps that
hold a wanted rank are cut again between their own least and greatest value, and only the parts that hold
the rank are looked into. So a group whose values all lie close together is spread as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_E = 64.0
PARTS = 1024.0


def _step(v: Column) -> Column:
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * STEPS_PER_E)).cast("long")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Known values per group with how often they occur: the one pass over the rows."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def values_at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column]) -> DataFrame:
    """Value at each zero-based rank per group; rank expressions may use ``total``, the group size.

    Missing values are left out. The result has the keys, ``total`` and one double per entry of ``ranks``.
    """
    return ranks_from_counts(value_counts(df, keys, value), keys, ranks)


def ranks_from_counts(counts: DataFrame, keys: Sequence[str], ranks: Mapping[str, Column]) -> DataFrame:
    keys, names = list(keys), list(ranks)
    counts = counts.withColumn("_step", _step(F.col("_v")))
    hist = counts.groupBy(*keys, "_step").agg(F.sum("_n").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    hist = hist.withColumns({"total": F.sum("_c").over(part), "_upto": F.sum("_c").over(part.orderBy("_step"))})
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), ranks[n].cast("long").alias("r")) for i, n in enumerate(names)])

    def held(want: Column | str, count: str) -> Column:
        """The wanted ranks between the running count before a row and the one with it."""
        return F.filter(want, lambda t: (t["r"] >= F.col("_upto") - F.col(count)) & (t["r"] < F.col("_upto")))

    picked = hist.select(*keys, "_step", "_lo", "_hi", "total", (F.col("_upto") - F.col("_c")).alias("_before"), held(wanted, "_c").alias("_want"))
    picked = picked.filter(F.size("_want") > 0)
    rows = _look_up(counts, picked, keys, ["_step"])
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    rows = rows.withColumn("_part", F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width) * PARTS), F.lit(0)).cast("long"))
    rows = rows.select(*keys, "_step", "_part", "_v", "_n", "total", "_before", "_want")
    parts = rows.groupBy(*keys, "_step", "_part").agg(F.sum("_n").alias("_c"), F.first("total").alias("total"), F.first("_before").alias("_before"), F.first("_want").alias("_want"))
    parts = parts.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_step").orderBy("_part")))
    fine = parts.select(*keys, "_step", "_part", "total", (F.col("_upto") - F.col("_c")).alias("_before"), held("_want", "_c").alias("_want")).filter(F.size("_want") > 0)
    rows = _look_up(rows.select(*keys, "_step", "_part", "_v", "_n"), fine, keys, ["_step", "_part"])
    w = Window.partitionBy(*keys, "_step", "_part").orderBy("_v")
    rows = rows.withColumn("_upto", F.col("_before") + F.sum("_n").over(w))
    rows = rows.select(*keys, "total", "_v", F.explode(held("_want", "_n")["i"]).alias("_i"))
    return rows.groupBy(*keys).agg(
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)],
    )


def _look_up(rows: DataFrame, picked: DataFrame, keys: list[str], places: list[str]) -> DataFrame:
    """Rows of the picked places; group keys may be NULL labels, so they join with null-safe equality."""
    left, right = rows.alias("c"), picked.alias("p")
    on = F.lit(True)
    for k in places:
        on = on & (F.col(f"c.{k}") == F.col(f"p.{k}"))
    for k in keys:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}"))
    more = [c for c in picked.columns if c not in (*keys, *places)]
    return left.join(right, on).select(*[F.col(f"c.{c}").alias(c) for c in rows.columns], *more)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per group: the keys, ``total`` and one column per probability."""
    return percentiles_from_counts(value_counts(df, keys, value), keys, probs)


def percentiles_from_counts(counts: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    ranks: dict[str, Column] = {}
    for name, p in probs.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        ranks[f"_lo_{name}"], ranks[f"_hi_{name}"] = F.floor(at), F.ceil(at)
    out = ranks_from_counts(counts, keys, ranks)
    cols = []
    for name, p in probs.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        weight = at - F.floor(at)
        cols.append((F.col(f"_lo_{name}") * (1 - weight) + F.col(f"_hi_{name}") * weight).alias(name))
    return out.select(*keys, "total", *cols)


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column | str]) -> DataFrame:
    """One row per known (row, metric): the shape in which several metrics share one pass."""
    items = [
        F.struct(F.lit(n).alias("metric"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("value"))
        for n, c in metrics.items()
    ]
    rows = df.select(*keys, F.inline(F.filter(F.array(*items), lambda s: s["value"].isNotNull())))
    return rows


def summarize(df: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column | str], probs: Mapping[str, float] | None = None) -> DataFrame:
    """n, avg, min, max, population std and exact percentiles per (keys, metric)."""
    probs = probs or {"median": 0.5}
    rows = long_metrics(df, keys, metrics)
    by = [*keys, "metric"]
    # Moments and percentiles both start from the counted values, so the rows are read once.
    counts = value_counts(rows, by, "value")
    v, n = F.col("_v"), F.col("_n")
    moments = counts.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum(v * n) / F.sum("_n")).alias("avg"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    # Squares are taken around the mean: sums of plain squares lose the spread of nearly equal prices.
    a, b = counts.alias("a"), moments.alias("b")
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    gap = F.col("a._v") - F.col("b.avg")
    spread = a.join(b, same).groupBy(*[F.col(f"b.{c}").alias(c) for c in (*by, "n", "avg", "min", "max")]).agg(F.sum(gap * gap * F.col("a._n")).alias("_m2"))
    moments = spread.select(*by, "n", "avg", "min", "max", F.sqrt(F.col("_m2") / F.col("n")).alias("std"))
    order = percentiles_from_counts(counts, by, probs).drop("total")
    left, right = moments.alias("m"), order.alias("o")
    on = F.lit(True)
    for k in by:
        on = on & F.col(f"m.{k}").eqNullSafe(F.col(f"o.{k}"))
    return left.join(right, on).select(
        *[F.col(f"m.{k}").alias(k) for k in by], "n", "avg", "min", "max", "std", *probs
    )


def wide(summary: DataFrame, keys: Sequence[str], picks: Mapping[str, tuple[str, str]], digits: int = 4) -> DataFrame:
    """Bring chosen (metric, statistic) pairs of a summary side by side, rounded."""
    from casagrid.functions.numbers import round_stat

    return summary.groupBy(*keys).agg(
        *[
            round_stat(F.max(F.when(F.col("metric") == m, F.col(s))), digits).alias(name)
            for name, (m, s) in picks.items()
        ]
    )
