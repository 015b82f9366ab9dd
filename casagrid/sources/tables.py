"""Written intermediate tables: computed once per application, read back with pruning and pushdown."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from casagrid.session import ensure_checkpoint_dir

_WRITTEN: dict[tuple[str, str, str], str] = {}


def stored(
    spark: SparkSession,
    folder: str,
    name: str,
    build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
) -> DataFrame:
    """Write ``build()`` as Parquet in the shared checkpoint folder and return a scan of it.

    Later queries start from plain columns, so their filters reach the scan, and a lost executor only
    costs the tasks it ran. ``cluster_by`` orders rows inside files for min/max pruning.
    """
    app = spark.sparkContext.applicationId
    key = (app, folder, name)
    if key not in _WRITTEN:
        tag = hashlib.sha256(folder.encode()).hexdigest()[:12]
        path = f"{ensure_checkpoint_dir(spark)}/tables/{app}/{tag}/{name}"
        df = build()
        if cluster_by:
            df = df.sortWithinPartitions(*cluster_by)
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def join_rows(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the properties, by sorting both.

    The planner knows Parquet by the size of its files. A few MB of them can hold millions of rows, which it would
    broadcast through the driver and hash whole in every task.
    """
    return left.join(right.hint("merge"), keys if isinstance(keys, str) else list(keys), how)


# Fixed value: how many rows a task of costly expressions works. Sizes of files or shuffles do not bound it: repetitive
# rows pack well, so a task of as many bytes works more and more of them.
TASK_ROWS = 50_000


def dealt(df: DataFrame, rows: int, key: str) -> DataFrame:
    """``df`` of ``rows`` rows with one for each ``key``, in tasks of about ``TASK_ROWS``; few rows keep their tasks."""
    parts = -(-rows // TASK_ROWS)
    return df if parts <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(parts, key)


SMALL_BYTES = 256 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Give a small scan one partition per core before costly expressions; a large one keeps its splits.

    The planner's size estimate decides, so a table that already has many splits is never shuffled for this.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
