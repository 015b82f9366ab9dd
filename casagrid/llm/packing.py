"""Best-fit packing of documents into sequences of at most ``capacity`` tokens, by large-item matching.

The plan is made on counts by length, of which there are at most ``capacity``; so it does not grow with the corpus.
Pieces above a third of the capacity fit at most twice into a bin: from the longest down, each takes the longest other
that still fits, which pairs as many as can be paired. Smaller pieces go, longest first, into the tightest gap that
holds them. A plan entry says: of the pieces of one length, those of rank ``from`` and on go, ``per_bin`` to a bin, to
the bins from ``bin`` on at ``offset``. Pieces get their rank within a length from their rank within their partition
plus the counts of the partitions before, so a length that a third of all pieces share is spread over all tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casagrid.llm.shared import stored
from casagrid.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, nth long"


class Plan:
    """Entries by length, each in order of rank."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.entries: dict[int, list[tuple[int, int, int, int]]] = {}
        self.used: dict[int, int] = {}
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first bin, number of bins)
        self.open: list[int] = []  # gaps in use, in order

    def _gap(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.gaps:
                insort(self.open, gap)
            self.gaps.setdefault(gap, []).append((first, count))

    def _take(self, gap: int) -> tuple[int, int]:
        first, count = self.gaps[gap].pop()
        if not self.gaps[gap]:
            del self.gaps[gap]
            self.open.remove(gap)
        return first, count

    def put(self, length: int, count: int, per_bin: int, first: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.entries.setdefault(length, []).append((rank, per_bin, first, offset))
        self.used[length] = rank + count

    def new_bins(self, count: int) -> int:
        first, self.bins = self.bins, self.bins + count
        return first

    def match(self, left: dict[int, int]) -> None:
        """Pieces above a third, longest first, each with the longest that fits beside it."""
        for a in sorted(left, reverse=True):
            for b in sorted((x for x in left if x <= min(a, self.capacity - a)), reverse=True):
                pairs = left[a] // 2 if a == b else min(left[a], left[b])
                if pairs:
                    first = self.new_bins(pairs)
                    self.put(a, pairs, 1, first, 0)
                    self.put(b, pairs, 1, first, a)
                    self._gap(self.capacity - a - b, first, pairs)
                    left[a] -= pairs
                    left[b] -= pairs
                if not left[a]:
                    break
            if left[a]:
                first = self.new_bins(left[a])
                self.put(a, left[a], 1, first, 0)
                self._gap(self.capacity - a, first, left[a])
                left[a] = 0

    def fill(self, length: int, count: int) -> None:
        """Pieces of one length into the tightest gaps; what is left opens bins."""
        while count:
            at = bisect_left(self.open, length)
            if at < len(self.open):
                gap = self.open[at]
                first, bins = self._take(gap)
            else:
                gap, bins = self.capacity, -(-count // (self.capacity // length))
                first = self.new_bins(bins)
            per_bin = gap // length
            full = min(bins, count // per_bin)
            offset = self.capacity - gap
            if full:
                self.put(length, full * per_bin, per_bin, first, offset)
                self._gap(gap - per_bin * length, first, full)
                count -= full * per_bin
            if full < bins:
                rest = count if count < per_bin else 0
                if rest:
                    self.put(length, rest, rest, first + full, offset)
                    self._gap(gap - rest * length, first + full, 1)
                    full, count = full + 1, 0
                self._gap(gap, first + full, bins - full)


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    plan, third = Plan(capacity), capacity / 3
    plan.match({n: c for n, c in counts.items() if n > third and c})
    for length in sorted((n for n, c in counts.items() if 0 < n <= third and c), reverse=True):
        plan.fill(length, counts[length])
    return plan


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each document with ``end_id`` after them, in pieces: a document over ``capacity`` is cut into full
    pieces behind a first piece that holds the rest. ``part`` and ``nth``: the partition, and the rank in it among
    pieces of the same length."""

    def cut(batches):
        encode, end, part, seen = encoder(tokenizer_path), np.uint32(end_id).tobytes(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                hi = n % capacity or capacity
                lo = piece = 0
                while lo < n:
                    rows.append((doc_id, piece, lo, hi - lo, ids[4 * lo : 4 * hi], part, int(seen[hi - lo])))
                    seen[hi - lo] += 1
                    lo, hi, piece = hi, hi + capacity, piece + 1
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit integers. Null and empty texts are the end id alone; repeated rows and
    null ids are packed like any row. An empty table gives an empty result; further columns are not looked at.
    """
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    counts = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    # At most ``capacity`` rows reach the driver.
    plan = make_plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    tables = {n: np.array(e, np.int64) for n, e in plan.entries.items()}
    shared = spark.sparkContext.broadcast(tables)  # bounded by the capacity, not by the data
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches):
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                table = shared.value[int(lengths[rows[0]])]
                entry = table[np.searchsorted(table[:, 0], ranks[rows], side="right") - 1]
                nth = ranks[rows] - entry[:, 0]
                sequence[rows] = entry[:, 2] + nth // entry[:, 1]
                offset[rows] = entry[:, 3] + nth % entry[:, 1] * lengths[rows]
            keep = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
