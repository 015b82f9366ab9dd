"""Removal of byte strings that occur elsewhere, with a logarithmic family of sparse suffix levels.

Of the suffixes of all texts those are indexed that begin at anchors (see ``anchors``): every string of ``window`` bytes
holds exactly one that it belongs to, and equal strings hold it at the same place. A level of the family is a table of
such suffixes by fingerprint, not an array sorted by bytes: ``key`` of their first bytes, ``span`` of all bytes that an
anchor's windows touch, how often that span occurs, and where first. A batch of texts becomes a level of its own, is
scanned by key against itself and the levels there are, and then joins the family; levels of one rank merge into one of
the next rank before the following scan, so n batches make log n levels.

A scan tells two things. A span that occurs twice is repeated with all its windows. A key with several spans is open:
their texts agree around the anchor but differ further out. Their bytes are fetched once and compared window by window
in a task; for a key with very many spans, windows are halved until it is settled which are shared (``shared_windows``).

Skew: counts are combined in each slice of text, by map-side aggregation, and in each level; a span that a third of all
texts share is a row per slice at most. Keys with very many spans are settled by aggregations that cost a
few rows a span and round. Fingerprints have 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casagrid.llm.anchors import BASE, BYTE, PLACE_BITS, anchors, sliding_least, window_hashes
from casagrid.llm.shared import release_shuffles, slices, stored, text_bytes
from casagrid.llm.words import ROLE, mixed

SLICE = 1 << 20
#: Bytes of texts whose windows are worked at once, so that the arrays of a step stay in a core's cache.
BLOCK = 1 << 17
#: The number of windows of an anchor is kept beside the first one in one integer.
PACK = 1 << 16
#: Keys with at most so many spans are compared within a task, others by halving, which moves the bytes of a span each
#: round; both compare all windows.
HOT_SPANS = 512
#: Groups of more than this share of all rows, so a thousand at most, meet their rows by broadcast.
HOT_SHARE = 1000
#: Places of a span that holds over a thousandth of all anchors are dealt over so many groups.
SALTS = 64


def gram_of(window: int) -> int:
    """Bytes that choose an anchor: a quarter of the window, 48 at most."""
    if not 1 <= window < PACK:
        raise ValueError(f"a window has 1 to {PACK - 1} bytes")
    return min(48, (window + 3) // 4)


def text_anchors(raw: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of all texts in ``raw``: key and span of each anchor, its first window (place in ``raw``), how many it has, and the
    place of the anchor in the first window. Texts are worked some at a time; no window touches two."""
    parts, lo = [], 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, side="right")) - 1)
        key, span, first, *rest = _block_anchors(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], window)
        parts.append((key, span, first + at[lo], *rest))
        lo = hi
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else _block_anchors(raw, at, window)


def _block_anchors(raw: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    gram = gram_of(window)
    if len(raw) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    if len(raw) >= 1 << PLACE_BITS:  # one very long text
        key, first, n, place = anchors(raw, window, gram)
    else:
        grams = mixed(window_hashes(raw, gram))
        mask = np.uint64((1 << PLACE_BITS) - 1)
        least = sliding_least((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
        ends = np.repeat(at[1:], np.diff(at))
        inside = np.flatnonzero(np.arange(len(least)) + window <= ends[: len(least)])
        every = (least[inside] & mask).astype(np.int64)
        # An anchor near the end of one text is never that of a window of the next.
        begin = np.flatnonzero(np.diff(every, prepend=-1) != 0)
        key, first, n, place = grams[every[begin]], inside[begin], np.diff(begin, append=len(every)), every[begin]
    whole = window_hashes(raw, window)
    span = mixed(whole[first] * ROLE[50] + mixed(whole[first + n - 1] + ROLE[51]) + n.astype(np.uint64))
    return key, span, first, n, place - first


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc, text): ``doc`` stands for id and text together."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("doc"), F.col(text_col).alias("text"))


def suffixes(texts: DataFrame, window: int) -> DataFrame:
    """(key, span, n, doc, pos, off) combined by (key, span) within slices; ``pos`` is first window * PACK + windows."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                raw, at = text_bytes(part.column(1))
                key, span, first, n, off = text_anchors(raw, at, window)
                row = np.searchsorted(at, first, side="right") - 1
                order = np.lexsort((span, key))
                new = np.ones(len(order), bool)
                new[1:] = (key[order][1:] != key[order][:-1]) | (span[order][1:] != span[order][:-1])
                begin = np.flatnonzero(new)
                pick = order[begin]
                doc = part.column(0).to_numpy()[row[pick]]
                pos = (first[pick] - at[row[pick]]) * PACK + n[pick]
                yield pa.RecordBatch.from_arrays([pa.array(key[pick].view(np.int64)), pa.array(span[pick].view(np.int64)), pa.array(np.diff(begin, append=len(order))), pa.array(doc), pa.array(pos), pa.array(off[pick])], names=["key", "span", "n", "doc", "pos", "off"])

    return texts.select("doc", "text").mapInArrow(run, "key long, span long, n long, doc long, pos long, off long")


def places(texts: DataFrame, window: int) -> DataFrame:
    """(span, doc, pos) of every anchor."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                raw, at = text_bytes(part.column(1))
                _, span, first, n, _ = text_anchors(raw, at, window)
                row = np.searchsorted(at, first, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(span.view(np.int64)), pa.array(part.column(0).to_numpy()[row]), pa.array((first - at[row]) * PACK + n)], names=["span", "doc", "pos"])

    return texts.select("doc", "text").mapInArrow(run, "span long, doc long, pos long")


#: Kept as plain columns, which Spark aggregates by hashing; a struct of them it would sort.
AT = ("doc", "pos", "off")


def combined(rows: DataFrame) -> DataFrame:
    """One row for each (key, span), with the place of its first row; all of ``AT`` are of that row."""
    return rows.groupBy("key", "span").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in AT])


@dataclass
class SuffixLevels:
    """The family: levels by rank, and what scans have found so far."""

    window: int
    levels: list[tuple[int, DataFrame]] = field(default_factory=list)
    repeated: list[DataFrame] = field(default_factory=list)  # (span, n)
    open: list[DataFrame] = field(default_factory=list)  # (key, span, doc, pos, off)

    def add(self, texts: DataFrame) -> None:
        """Indexes a batch (doc, text) and scans it against itself and all levels."""
        self.merge()
        level = stored(combined(suffixes(texts, self.window)), "suffix-level")
        release_shuffles(texts.sparkSession)
        tagged = [level.withColumn("fresh", F.lit(1))] + [old.withColumn("fresh", F.lit(0)) for _, old in self.levels]
        both = reduce(DataFrame.unionByName, tagged)
        if self.levels:
            both = both.groupBy("key", "span").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in AT], F.max("fresh").alias("fresh"))
        keys = both.groupBy("key").agg(F.count("*").alias("spans"), F.max("fresh").alias("fresh")).filter("spans > 1 and fresh = 1").select("key")
        self.repeated.append(stored(both.filter("n > 1 and fresh = 1").select("span", "n"), "repeated-spans"))
        self.open.append(stored(both.join(keys, "key").select("key", "span", "doc", "pos", "off"), "open-spans"))
        release_shuffles(texts.sparkSession)
        self.levels.append((0, level))

    def merge(self) -> None:
        """Levels of equal rank become one of the next rank."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, stored(combined(a.unionByName(b)), "suffix-level")))
            release_shuffles(a.sparkSession)


def with_bytes(rows: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(key, doc, pos, off, bytes): the bytes that the windows of each row (key, doc, pos, off) touch."""
    wanted = rows.groupBy("doc").agg(F.collect_set(F.struct("key", "pos", "off")).alias("at"))
    found = texts.dropDuplicates(["doc"]).join(wanted, "doc").select("doc", F.col("text").cast("binary").alias("text"), F.col("at.key").alias("keys"), F.col("at.pos").alias("poss"), F.col("at.off").alias("offs"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                out = []
                for doc, text, *lists in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for key, pos, off in zip(*lists, strict=True):
                        lo, n = divmod(pos, PACK)
                        out.append((key, doc, pos, off, text[lo : lo + n - 1 + window]))
                if out:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "doc", "pos", "off", "bytes"])

    return found.mapInArrow(run, "key long, doc long, pos long, off long, bytes binary")


def _windows(data: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of each byte string, and where each string's begin."""
    at = np.cumsum([0, *map(len, data)])
    whole = window_hashes(np.frombuffer(b"".join(data), np.uint8), window)
    n = np.diff(at) - window + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    return mixed(whole[np.repeat(at[:-1] - begin[:-1], n) + np.arange(begin[-1])]), begin


def _runs(twice: np.ndarray, begin: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """(doc, pos) of the runs of marked windows; ``twice`` marks windows of rows that begin at ``begin``."""
    row = np.repeat(np.arange(len(doc)), np.diff(begin))
    edge = np.ones(len(twice), bool)
    edge[1:] = (twice[1:] != twice[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(edge)
    length = np.diff(start, append=len(twice))
    start, length = start[twice[start]], length[twice[start]]
    own = row[start]
    return pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array((pos[own] // PACK + start - begin[own]) * PACK + length)], names=["doc", "pos"])


def compare_windows(rows: DataFrame, window: int) -> DataFrame:
    """(doc, pos) of runs of windows that rows (key, doc, pos, bytes) of one key share; a key has few rows."""

    def scan(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size >= SLICE and row[0] != held[-1][0]:
                    yield compare(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield compare(held)

    def compare(held):
        _, doc, pos, data = zip(*held, strict=True)
        prints, begin = _windows(list(data), window)
        order = np.argsort(prints, kind="stable")
        same = prints[order][1:] == prints[order][:-1]
        twice = np.zeros(len(prints), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        return _runs(twice, begin, np.array(doc, np.int64), np.array(pos, np.int64))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("key", "doc", "pos", "bytes").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(scan, "doc long, pos long")


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each ``raw[begin:end]``, from running sums and powers of an odd base and of its inverse."""
    back = np.array([pow(int(BASE[0]), -1, 2**64)], np.uint64)
    up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(base, len(raw))])) for base in (BASE, back))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * up[:-1], dtype=np.uint64)])
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * ROLE[52])


NODES = "doc long, pos long, off long, bytes binary, a int, b int, inner long, outer long, own boolean"


def _halved(rows: DataFrame, window: int) -> DataFrame:
    """Both halves of the windows ``a`` to ``b`` of each row, as far as the row has them.

    A window is numbered by how far before the anchor it begins. ``inner`` is the hash of the bytes that all windows of
    the half touch together, ``outer`` of those that any touches; a row that lacks some of the windows has only the
    former (``own`` is false), and a number of its own for the latter.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "bytes", SLICE):
                data = part.column(3).cast(pa.large_binary())
                at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
                raw = np.frombuffer(data.buffers()[2], np.uint8)[at[0] : at[-1]] if len(data) else np.zeros(0, np.uint8)
                doc, pos, off, a, b = (part.column(i).to_numpy() for i in (0, 1, 2, 4, 5))
                anchor = at[:-1] - at[0] + off
                low, high = off - pos % PACK + 1, off
                half = (a.astype(np.int64) + b) // 2
                pick, left, right = [], [], []
                for x, y in ((a.astype(np.int64), half), (half + 1, b.astype(np.int64))):
                    some = np.flatnonzero((x <= y) & (x <= high) & (y >= low))
                    pick.append(some), left.append(x[some]), right.append(y[some])
                pick, left, right = np.concatenate(pick), np.concatenate(left), np.concatenate(right)
                whole = (low[pick] <= left) & (right <= high[pick])
                node = mixed(left.astype(np.uint64) * ROLE[53] + right.astype(np.uint64))
                inner = mixed(span_hashes(raw, anchor[pick] - left, anchor[pick] - right + window) + node)
                alone = mixed(mixed(doc[pick].view(np.uint64) + ROLE[54]) + pos[pick].astype(np.uint64)) + node
                outer = alone.copy()
                outer[whole] = mixed(span_hashes(raw, (anchor[pick] - right)[whole], (anchor[pick] - left)[whole] + window) + node[whole])
                took = part.column(3).take(pa.array(pick))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[pick]), pa.array(pos[pick]), pa.array(off[pick]), took, pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(inner.view(np.int64)), pa.array(mixed(outer).view(np.int64)), pa.array(whole)],
                    names=["doc", "pos", "off", "bytes", "a", "b", "inner", "outer", "own"],
                )

    return rows.select("doc", "pos", "off", "bytes", "a", "b").mapInArrow(run, NODES)


def in_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """Rows whose key is among ``groups`` (key, n); hot groups, a thousand at most, by broadcast, others by a shuffle."""
    hot = F.col("n") * HOT_SHARE > total
    few = F.broadcast(groups.filter(hot).select(key))
    return rows.join(few, key, "left_semi").unionByName(rows.join(few, key, "left_anti").join(groups.filter(~hot).select(key), key, "left_semi"))


def in_spans(rows: DataFrame, spans: DataFrame, total: int) -> DataFrame:
    """Rows (span, doc, pos) whose span is among ``spans`` (span, n); those of a hot span are dealt over groups."""
    hot = F.col("n") * HOT_SHARE > total
    few = F.broadcast(spans.filter(hot).select("span", F.lit(True).alias("hot")))
    dealt = rows.join(few, "span", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "pos"), F.lit(SALTS))).otherwise(0))
    every = F.when(hot, F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return dealt.join(spans.select("span", F.explode(every).alias("salt")), ["span", "salt"])


def shared_windows(fetched: DataFrame, window: int) -> DataFrame | None:
    """(doc, pos) of runs of windows that a row (key, doc, pos, off, bytes) shares with another of its key.

    The windows of a row are halved again and again. A half whose bytes (``outer``) another row has too is shared as a
    whole; one row then goes on for all of them, as others may share a part of it. A half whose common bytes (``inner``)
    no other row has shares nothing. Any other is halved further, so a row costs a few halves a round, however many rows
    its key has.
    """
    last = window - gram_of(window)
    rows, found = fetched.select("doc", "pos", "off", "bytes", F.lit(0).alias("a"), F.lit(last).alias("b")), []
    for size in range((last + 1).bit_length() + 1):
        nodes = stored(_halved(rows, window), f"window-halves-{size}")
        total = nodes.count()
        if not total:
            break
        twice = nodes.filter("own").groupBy("outer").agg(F.count("*").alias("n")).filter("n > 1")
        place = ((F.floor(F.col("pos") / PACK) + F.col("off") - F.col("b")) * PACK + F.col("b") - F.col("a") + 1).alias("pos")
        found.append(stored(in_groups(nodes.select("outer", "doc", "pos", "off", "a", "b"), twice, "outer", total).select("doc", place), "shared-windows"))
        one = nodes.filter("a < b").groupBy("inner", "outer").agg(F.min(F.struct("doc", "pos", "off", "bytes", "a", "b")).alias("r"))
        one = stored(one.select("inner", "r.*"), f"window-kinds-{size}")
        several = one.groupBy("inner").agg(F.count("*").alias("n")).filter("n > 1")
        rows = in_groups(one, several, "inner", total).drop("inner")
    return reduce(DataFrame.unionByName, found) if found else None


def cut_texts(texts: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) of texts and the windows (doc, pos) that go."""
    of_doc = marks.groupBy("doc").agg(F.collect_set("pos").alias("marks"))
    joined = texts.join(of_doc, "doc", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "marks")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = []
                for text, marks in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text = text or b""
                    if not marks:
                        rows.append((len(text), 0, [], text))
                        continue
                    pos = np.sort(np.array(marks, np.int64))
                    lo, hi = pos // PACK, pos // PACK + pos % PACK - 1 + window
                    reach = np.maximum.accumulate(hi)
                    fresh = np.append(True, lo[1:] > reach[:-1])
                    begin, end = lo[fresh], reach[np.append(fresh[1:], True)]
                    edges = [0, *np.stack([begin, end], axis=1).reshape(-1).tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((len(text), len(text) - len(kept), edges[1:-1], kept))
                n, removed, spans, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    kind = dict(joined.dtypes)["doc_id"]
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")


def remove_repeats(docs: DataFrame, window: int = 200, batches: int = 2, batch_of: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, spans (begin, end, begin, ...), kept (bytes).

    Each byte goes that a string of ``window`` bytes covers which also starts anywhere else, in the same text or
    another. Null texts count as empty; texts shorter than the window stay. Rows alike in id and text are two
    occurrences. Null ids come back as null. An empty table gives an empty result; further columns are not looked at.
    ``batches`` ingests are told apart by a hash of the row unless ``batch_of`` numbers them. Windows of 1 to 65,535 bytes
    work; others raise.
    """
    gram_of(window)
    number = batch_of if batch_of is not None else F.pmod(F.xxhash64(F.lit("ingest"), F.col(id_col)), F.lit(batches))
    family = SuffixLevels(window)
    for i in range(batches):
        family.add(keyed(docs.filter(F.coalesce(number, F.lit(0)) == i), id_col, text_col))
    texts = keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    repeated = reduce(DataFrame.unionByName, family.repeated).groupBy("span").agg(F.max("n").alias("n"))
    total = sum(level.agg(F.sum("n")).first()[0] or 0 for _, level in family.levels)
    full = stored(in_spans(places(texts, window), repeated, total).select("doc", "pos"), "repeated-windows")
    release_shuffles(spark)
    open_spans = reduce(DataFrame.unionByName, family.open).dropDuplicates(["key", "span"])
    fetched = stored(with_bytes(open_spans, texts, window), "open-bytes")
    release_shuffles(spark)
    hot = stored(fetched.groupBy("key").agg(F.count("*").alias("spans")).filter(F.col("spans") > HOT_SPANS).select("key"), "hot-keys")
    marks = full.unionByName(stored(compare_windows(fetched.join(hot, "key", "left_anti"), window), "shared-windows"))
    wide = shared_windows(fetched.join(hot, "key", "left_semi"), window)
    release_shuffles(spark)
    return cut_texts(texts, marks.unionByName(wide) if wide is not None else marks, window)
