"""Token files in canonical, length-limited Huffman code.

File format: Parquet rows, each an independent block of whole documents in order of position:

* ``part``, ``first``, ``start``: the task that numbered the documents, the position of the block's first document
  among them, and the ids of that task before it;
* ``doc_ids``, ``sizes``: int64 and int64 arrays, a document each; ``n_tokens``: their sum;
* ``payload``: the codes, most significant bit first; ``checkpoints``: int64 array, the bit at which every
  ``CHECKPOINT``-th token begins, so that reading may start there.

A file is a folder: ``blocks`` holds these rows, ``book`` the code book (id, bits), so a reader needs its path only.
Codes are canonical: counted up by (bits, id).

Decoding looks ``limit`` bits up in one table of 2^limit entries and runs all checkpoints of a block in step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casagrid.llm.shared import binary_column, shared_path, slices, stored
from casagrid.llm.tokens import as_ids, encoder, vocabulary_size

LIMIT = 16
CHECKPOINT = 256
BLOCK_TOKENS = 1 << 19
BOOK = "id int, bits int"
BLOCK = "part int, first long, start long, n_docs long, n_tokens long, doc_ids binary, sizes binary, checkpoints binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol (0: not coded) with the least total among codes of at most ``limit`` bits: package-merge."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.int64)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit into codes of {limit} bits")
    if len(used) < 2:
        bits[used] = 1
        return bits
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    n, levels, weights = len(leaf), [], leaf
    for _ in range(limit - 1):
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaf, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < n)
        weights = merged[place]
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        bits[order[:leaves]] += 1
        take = 2 * (take - leaves)
    bits[order[:take]] += 1
    return bits


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    codes, code, length = np.zeros(len(bits), np.int64), 0, 0
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    lengths = bits[order]
    for size in np.unique(lengths):
        code <<= int(size) - length
        length = int(size)
        same = order[lengths == size]
        codes[same] = code + np.arange(len(same))
        code += len(same)
    return codes


def pack_codes(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload and checkpoints of a run of ids."""
    size = bits[ids]
    if len(size) and not size.min():
        raise ValueError("an id is not in the code book")
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1]) if len(ids) else 0
    word, shift = at >> 4, at & 15
    wide = codes[ids] << (32 - size - shift)
    out = np.zeros((total >> 4) + 3, np.int64)
    if len(ids):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        np.add.at(out, word[starts], np.add.reduceat(wide >> 16, starts))
        np.add.at(out, word[starts] + 1, np.add.reduceat(wide & 0xFFFF, starts))
    return out.astype(">u2").tobytes(), at[::CHECKPOINT]


def lookup_table(bits: np.ndarray, codes: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    symbol, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    order = np.flatnonzero(bits)
    order = order[np.argsort(codes[order] << (limit - bits[order]), kind="stable")]
    span = 1 << (limit - bits[order])
    filled = np.repeat(order, span)
    symbol[: len(filled)] = filled
    size[: len(filled)] = bits[filled]
    return symbol, size


def unpack_codes(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a block: every checkpoint is a lane, and all lanes go on by one id in step."""
    symbol, size = table
    words = np.frombuffer(payload, ">u2").astype(np.uint32)
    pairs = (words[:-1].astype(np.uint64) << np.uint64(16)) | words[1:]
    at, out = np.array(checkpoints, np.int64), np.zeros((len(checkpoints), CHECKPOINT), np.uint32)
    last = n - (len(at) - 1) * CHECKPOINT
    for step in range(min(CHECKPOINT, n)):
        lanes = len(at) if step < last else len(at) - 1
        here = at[:lanes]
        peek = ((pairs[here >> 4] >> (16 - (here & 15)).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.int64)
        out[:lanes, step] = symbol[peek]
        here += size[peek]
    return out.reshape(-1)[:n]


@dataclass
class TokenFile:
    """A token file by its path; the code book has an entry for each id in use, so it is bounded by the vocabulary."""

    spark: SparkSession
    path: str

    def bits(self) -> np.ndarray:
        """Code length of each id; 0 for ids without a code."""
        book = self.spark.read.schema(BOOK).parquet(f"{self.path}/book").toArrow()
        ids = book.column("id").to_numpy()
        bits = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
        bits[ids] = book.column("bits").to_numpy()
        return bits

    def read(self) -> DataFrame:
        """Per document: part, at (place among the task's documents), doc_id, start (ids of all documents before),
        n_tokens, ids (little-endian unsigned 32-bit integers)."""
        blocks = self.spark.read.schema(BLOCK).parquet(f"{self.path}/blocks")
        # A row for each task that wrote, not for each document or block.
        sums = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
        before = dict(zip([p for p, _ in sums], np.cumsum([0, *(n for _, n in sums)]).tolist(), strict=False))
        shared = self.spark.sparkContext.broadcast((self.bits(), before))

        def decode(batches):
            bits, before = shared.value
            table = lookup_table(bits, canonical_codes(bits))
            for batch in batches:
                for row in batch.to_pylist():
                    sizes, ids = np.frombuffer(row["sizes"], np.int64), unpack_codes(row["payload"], np.frombuffer(row["checkpoints"], np.int64), row["n_tokens"], table)
                    ends = np.cumsum(sizes)
                    n, lo, start = len(sizes), 0, before[row["part"]] + row["start"]
                    while lo < n:  # parts of at most 64 MB of ids
                        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 24))))
                        base = int(ends[lo] - sizes[lo])
                        known = np.unpackbits(np.frombuffer(row["doc_ids"], np.uint8)[8 * n :], count=n).astype(bool)[lo:hi]
                        names = np.frombuffer(row["doc_ids"][: 8 * n], np.int64)[lo:hi]
                        at = np.concatenate([[0], ends[lo:hi] - base])
                        data = ids[base : ends[hi - 1]].astype("<u4")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(hi - lo, row["part"], np.int32)), pa.array(row["first"] + np.arange(lo, hi)), pa.array(names, mask=~known), pa.array(start + base + at[:-1]), pa.array(sizes[lo:hi]), binary_column(data, at)],
                            names=["part", "at", "doc_id", "start", "n_tokens", "ids"],
                        )
                        lo = hi

        return blocks.mapInArrow(decode, "part int, at long, doc_id long, start long, n_tokens long, ids binary")


def tokenize_in_order(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(part, at, start, doc_id, ids) in ascending order of id (null first), then of text; ``part`` and ``at`` number
    tasks and documents in that order, ``start`` counts the task's ids before."""

    def tokenize(batches):
        encode, end, part, at, start = encoder(tokenizer_path), np.uint32(end_id).tobytes(), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            ids = [encode(text) + end for text in batch.column(1).to_pylist()]
            starts = start + np.cumsum([0, *(len(x) // 4 for x in ids)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(at + np.arange(n)), pa.array(starts[:-1]), batch.column(0), pa.array(ids, pa.binary())], names=["part", "at", "start", "doc_id", "ids"])
            at, start = at + n, int(starts[-1])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(tokenize, "part int, at long, start long, doc_id long, ids binary")


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id below ``size`` occurs; the driver gets a row per id in use."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                total += np.bincount(as_ids(b"".join(part.column(0).to_pylist())), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def write_token_file(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFile:
    """Encodes every text, appends ``end_id`` and writes blocks in ascending order of id.

    Null and empty texts are the end id alone. Repeated ids follow each other; a null id comes first and comes back as
    null. A document never crosses blocks: one over ``BLOCK_TOKENS`` has a block of its own. An empty table gives no
    block.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-file")
    tokens = stored(tokenize_in_order(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    bits = code_lengths(count_ids(tokens, max(vocabulary_size(tokenizer_path), end_id + 1)))
    used = np.flatnonzero(bits)
    book = pa.table({"id": pa.array(used, pa.int32()), "bits": pa.array(bits[used], pa.int32())})
    spark.createDataFrame(book, BOOK).coalesce(1).write.parquet(f"{path}/book")
    shared = spark.sparkContext.broadcast((bits, canonical_codes(bits)))

    def block(part: int, first: int, start: int, names: list, ids: list) -> pa.RecordBatch:
        known, sizes = [x is not None for x in names], np.array([len(x) // 4 for x in ids], np.int64)
        payload, checkpoints = pack_codes(as_ids(b"".join(ids)), *shared.value)
        doc_ids = np.array([x or 0 for x in names], np.int64).tobytes() + np.packbits(known).tobytes()
        values = [[part], [first], [start], [len(ids)], [int(sizes.sum())], [doc_ids], [sizes.tobytes()], [checkpoints.astype(np.int64).tobytes()], [payload]]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["part", "first", "start", "n_docs", "n_tokens", "doc_ids", "sizes", "checkpoints", "payload"])

    def encode(batches):
        part = first = start = None
        names, ids, held = [], [], 0
        for batch in batches:
            for p, at, begin, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (p != part or at != first + len(ids) or held + len(data) // 4 > BLOCK_TOKENS):
                    yield block(part, first, start, names, ids)
                    names, ids, held = [], [], 0
                if not ids:
                    part, first, start = p, at, begin
                names.append(name)
                ids.append(data)
                held += len(data) // 4
        if ids:
            yield block(part, first, start, names, ids)

    tokens.mapInArrow(encode, BLOCK).write.parquet(f"{path}/blocks")
    return TokenFile(spark, path)
