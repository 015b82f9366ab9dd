"""Mixing sources to target weights.

Every document gets a hash-random key. Each source's keys are cut into equal ranges of about ``RANGE_ROWS`` rows; the
ranges' token sums are added up in key order, documents are added up within their range, and both sums give the
document's place in its source's order. Whole epochs are taken first, then the front of the order up to the exact rest
of the budget, the last document in part. The work is split over (source, range), so a source with a third of all rows
is spread like any other; only sums of ranges and of sources pass through windows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casagrid.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 4096
KEY_SPAN = 2**60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: Column, seed: int) -> Column:
    """60 bits of md5 over seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source (columns source, size, rows): place by code point with null last, and target.

    A source's share goes by weight, but stops at ``cap`` times its size; the excess goes to the others by weight.
    With sources in order of size to weight the common level follows from sums before each source.
    """
    everything = Window.partitionBy()
    named = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(named) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("top", F.col("size") * F.lit(float(cap)))
    filled = Window.orderBy(F.col("top") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranked.select(
        "*",
        (F.lit(float(share)) * F.sum("size").over(everything)).alias("budget"),
        F.coalesce(F.sum("top").over(filled), F.lit(0.0)).alias("top_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))).alias("weight_left"),
    )
    level = sums.withColumn("level", (F.col("budget") - F.col("top_before")) / F.col("weight_left"))
    # The first source that its level does not fill; the levels after it mean nothing.
    order = Window.orderBy(F.col("top") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = level.withColumn("common", F.first(F.when(F.col("level") <= F.col("top") / F.col("weight"), F.col("level")), ignorenulls=True).over(order))
    return level.select("source", "place", "rows", F.col("size").alias("source_size"), F.coalesce(F.least("top", F.col("common") * F.col("weight")), "top").alias("target"))


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, source, size, source_size, target, taken (tokens that the mix takes of it, repeats counted).

    A null source is a source of its own, the last one; null sizes count as 0 and take nothing; rows alike in id and
    size share one key and follow each other. ``extra`` names further columns to carry. Reruns give the same mix. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), random_key(F.col(id_col), seed).alias("key"), *extra)
    rows = stored(rows, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    targets = stored(source_targets(sizes, weights, share, cap), "mix-targets").withColumnRenamed("source", "named")
    placed = rows.join(targets, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    ranges = F.ceil(F.col("rows") / RANGE_ROWS)
    placed = placed.withColumn("range", F.floor(F.col("key") / F.lit(float(KEY_SPAN)) * ranges))
    sums = placed.groupBy("place", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("place", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.join(sums, ["place", "range"]).withColumn("start", F.col("earlier") + F.sum("size").over(within) - F.col("size"))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("start")
    taken = whole * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return summed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *extra)
