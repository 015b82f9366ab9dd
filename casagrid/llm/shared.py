"""Helpers of several operators: tables in the shared folder and text columns as byte arrays."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from casagrid.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Between jobs with large shuffles: files of a shuffle go once the driver has collected what refers to it, which
    its collector otherwise does at its leisure."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, one after the other, and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def binary_column(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column whose row ``i`` holds the items ``starts[i]:starts[i + 1]`` of ``data`` in little-endian order."""
    data = np.ascontiguousarray(data)
    at = np.asarray(starts, np.int64) * data.itemsize
    if at[-1] > 2**31 - 1:
        raise ValueError("one Arrow batch holds over 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22):
    """Parts of a batch of about ``most`` bytes of ``column``, at least one row each."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0), np.int64)
    lo = 0
    ends = np.cumsum(sizes)
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
