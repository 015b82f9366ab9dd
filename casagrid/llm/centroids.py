"""Integer k-means whose distances come from scalar lookup tables.

Vectors become integers ``floor(scale * x)`` and are stored once in blocks: for each dimension the integers that occur in
the block, and for each vector and dimension the place of its integer among them. In each round a block tabulates the
squared difference of every occurring integer and every centroid; a distance is a gather from these tables and a sum.
Nothing is rounded: where 64 bits might not do, tables hold Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casagrid.llm.shared import stored

BLOCK = 4096
#: A component of this size or more has no integer of 64 bits; its vector takes no part.
TOO_LARGE = float(1 << 52)
BLOCKS = ("ids", "absent", "sizes", "occurring", "places")


def integers(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their integers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    good = (np.abs(flat) < TOO_LARGE).all(axis=1)  # false for NaN, which also stands for null
    return rows[good], np.floor(flat[good] * scale).astype(np.int64)


def block(ids: pa.Array, values: np.ndarray) -> pa.RecordBatch:
    occurring, places = zip(*(np.unique(column, return_inverse=True) for column in values.T), strict=True)
    absent = ids.is_null().to_numpy(zero_copy_only=False)
    columns = (ids.fill_null(0).to_numpy(zero_copy_only=False), absent, np.array([len(x) for x in occurring]), np.concatenate(occurring), np.stack(places).astype(np.uint16))
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], BLOCKS)


def tabled(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = integers(batch.column("vector"), dims, scale)
            ids = batch.column("id").take(pa.array(rows))
            for lo in range(0, len(rows), BLOCK):
                yield block(ids.slice(lo, BLOCK), values[lo : lo + BLOCK])

    return stored(vectors.mapInArrow(run, ", ".join(f"{c} binary" for c in BLOCKS)), "centroid-blocks")


class Tables:
    """A block's integers; gathers for one set of centroids."""

    def __init__(self, row: dict):
        self.sizes, self.occurring = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["occurring"], np.int64)
        self.dim = np.repeat(np.arange(len(self.sizes)), self.sizes)
        starts = np.cumsum(self.sizes) - self.sizes
        self.places = np.frombuffer(row["places"], np.uint16).reshape(len(self.sizes), -1) + starts[:, None]

    def nearest(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance, of each vector."""
        middle = np.array(centroids, object).T
        largest = max(int(np.abs(self.occurring).max()), max(abs(x) for c in centroids for x in c))
        kind = np.int64 if len(self.sizes) * (2 * largest) ** 2 < 2**63 else object
        table = self.occurring.astype(kind)[:, None] - middle.astype(kind)[self.dim]
        table *= table
        total = table[self.places[0]]
        for places in self.places[1:]:
            total += table[places]
        best = total.argmin(axis=1)
        return best, total[np.arange(len(best)), best]

    def sums(self, of: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
        """How many vectors each centroid has, and their sum: occurrences of each integer, times the integer."""
        width = len(self.occurring)
        counts = np.bincount((of * width + self.places).ravel(), minlength=k * width).reshape(k, width)
        safe = int(np.abs(self.occurring).max()) * len(of) < 2**62
        weighed = counts * (self.occurring if safe else self.occurring.astype(object))
        return np.bincount(of, minlength=k), np.add.reduceat(weighed, np.cumsum(self.sizes) - self.sizes, axis=1).tolist()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid at the floor of the mean of its vectors; one without vectors stays."""
    k, dims = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [0] * k, [[0] * dims for _ in range(k)]
        for row in _rows(batches):
            table = Tables(row)
            n, sums = table.sums(table.nearest(centroids)[0], k)
            counts = [a + int(b) for a, b in zip(counts, n, strict=True)]
            totals = [[a + int(b) for a, b in zip(x, y, strict=True)] for x, y in zip(totals, sums, strict=True)]
        out = [(c, counts[c], d, Decimal(totals[c][d])) for c in range(k) for d in range(dims) if counts[c]]
        if out:
            types = (pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["c", "n", "d", "total"])

    partial = blocks.mapInArrow(run, "c int, n long, d int, total decimal(38,0)")
    sums = partial.groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # k times dims rows
    moved = [list(c) for c in centroids]
    for r in sums:
        moved[r.c][r.d] = int(r.total) // r.n
    return moved


def _assigned(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            best, distance = Tables(row).nearest(centroids)
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["absent"], bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance.tolist(), pa.int64())], ["id", "cluster", "distance"])

    return blocks.mapInArrow(run, "id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, seed: int, dims: int, scale: int) -> list[list[int]]:
    """The vectors with the ``k`` smallest SHA-256 of ``seed:id`` in ascending order; ties by components."""
    whole = F.col("vector").cast("array<double>")
    taking = (F.size("vector") == dims) & F.forall(whole, lambda x: x.isNotNull() & (F.abs(x) < TOO_LARGE))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = vectors.filter(taking).select(order.alias("order"), F.transform(whole, lambda x: F.floor(x * scale)).alias("v")).filter("order is not null").orderBy("order", "v").limit(k)
    return [list(r.v) for r in found.collect()]


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``rounds`` rounds of integer k-means and a last assignment: rows (id, cluster, distance), and the centroids.

    A vector is assigned to the nearest centroid by squared distance, ties to the smaller number. Vectors that are null,
    have another number of components, or one that is null, not finite or beyond 2^52, take no part. A null id takes part
    but starts no centroid; equal ids and equal rows are vectors of their own. With fewer than ``k`` vectors there are as
    many centroids, with none (an empty table too) no rows. Further columns are not read. A distance beyond 64 bits raises.
    """
    slim = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    kind = slim.schema["id"].dataType.simpleString()
    slim = slim.withColumn("id", F.col("id").cast("long"))
    centroids = first_centroids(slim, k, seed, dims, scale)
    if not centroids:
        return slim.filter("false").select(F.col("id").cast(kind).alias(id), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    blocks = tabled(slim, dims, scale)
    for _ in range(rounds):
        centroids = _moved(blocks, centroids)
    return _assigned(blocks, centroids).select(F.col("id").cast(kind).alias(id), "cluster", "distance"), centroids


def by_cluster(values: list, cluster: Column) -> Column:
    """A value of each cluster, from a list in the order of their numbers."""
    return F.element_at(F.array(*map(F.lit, values)), cluster + 1)
