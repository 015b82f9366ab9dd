"""Previous-row and running-sum helpers that cut long groups into chunks.

A plain window orders a whole group in one task. Here a group is cut by a chunk column that follows the
order (a day, a block number); only one row per chunk is ordered across the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_row(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<column>`` of the row before in key and order."""
    keys, order = list(keys), list(order)
    row = F.struct(*order, *[F.col(c).alias(f"_c_{c}") for c in columns])
    rows = df.withColumn("_row", row)
    ends = rows.groupBy(*keys, chunk).agg(F.max("_row").alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy(chunk))).drop("_last")
    rows = rows.join(ends, [*keys, chunk])
    w = Window.partitionBy(*keys, chunk).orderBy(*order)
    prev = F.coalesce(F.lag("_row").over(w), F.col("_before"))
    rows = rows.withColumn("_prev", prev)
    return rows.withColumns({f"{prefix}{c}": F.col(f"_prev._c_{c}") for c in columns}).drop("_row", "_before", "_prev")


def running_sum(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add the running sum of ``value`` within key and order."""
    keys = list(keys)
    rows = df.withColumn("_v", value)
    totals = rows.groupBy(*keys, chunk).agg(F.sum("_v").alias("_t"))
    w = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_b", F.coalesce(F.sum("_t").over(w), F.lit(0))).drop("_t")
    w = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(totals, [*keys, chunk]).withColumn(name, F.col("_b") + F.sum("_v").over(w)).drop("_v", "_b")
