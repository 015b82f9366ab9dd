"""Exact deduplication against history by a minimal perfect hash.

The distinct digests of the history are dealt into buckets by their leading bits. Each bucket gets a minimal perfect
hash of its own: level after level, keys that fall alone into a cell of a bit array are settled, the others go on; the
rank of a key's bit is its slot. A slot holds the whole digest and the locator of the winner. A new digest is looked up
in its slot and compared byte by byte there, so a non-member never passes as a member. Members join the group in
history, non-members form groups of their own.

Skew: copies are combined by digest before any shuffle of rows, buckets hold distinct digests only, and the last join
of rows to their group is an ordinary equi join that adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casagrid.llm.shared import stored

SPACES = " \t\n\x0b\x0c\r"
LAST_ID = 2**63 - 1  # stands for a null id, which loses every tie
BUCKET_DIGESTS = 4096
GAMMA = 1.6


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def fingerprints(docs: DataFrame, is_history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, chars, known): sha256 of the text without white space, code points of the original text, history or not."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.unhex(F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256)).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"),
        F.coalesce(is_history, F.lit(False)).alias("known"),
    )


def grouped(prints: DataFrame) -> DataFrame:
    """One row per digest: the winner (most code points, then smallest id) and the number of rows."""
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").alias("id"))).alias("best")
    return prints.groupBy("digest").agg(best, F.count("*").alias("rows")).select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("chars"), "rows")


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.reshape(-1, 32).view("<u8")


def _cells(words: np.ndarray, level: int, size: int) -> np.ndarray:
    x = words[:, 1] ^ (words[:, 2] * np.uint64(2 * level + 1))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build_hash(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels and their bits, one after the other, for distinct digests."""
    sizes, bits, left = [], [], words
    while len(left):
        size = max(2, int(GAMMA * len(left)))
        cell = _cells(left, len(sizes), size)
        alone = np.bincount(cell, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[cell]]
    return np.array(sizes, np.int32), np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(words: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The slot of each digest; -1 where no level has a bit for it."""
    rank = np.cumsum(bits) - 1
    out, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        cell = base + _cells(words[left], level, int(size))
        hit = bits[cell]
        out[left[hit]] = rank[cell[hit]]
        left, base = left[~hit], base + int(size)
    return out


INDEX = "bucket int, sizes binary, bits binary, n int, digests binary, keep_ids binary, chars binary, counts binary"


def _build(group: pd.DataFrame) -> pd.DataFrame:
    digests = np.frombuffer(b"".join(group["digest"]), np.uint8)
    sizes, bits = build_hash(_words(digests))
    order = np.argsort(slots(_words(digests), sizes, bits))
    packed = [group[c].to_numpy(np.int64)[order].tobytes() for c in ("keep_id", "chars", "rows")]
    return pd.DataFrame([[group["bucket"].iloc[0], sizes.tobytes(), np.packbits(bits).tobytes(), len(order), digests.reshape(-1, 32)[order].tobytes(), *packed]], columns=["bucket", "sizes", "bits", "n", "digests", "keep_ids", "chars", "counts"])


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket for grouped digests."""
    return _in_buckets(history, buckets).groupBy("bucket").applyInPandas(_build, INDEX)


def _in_buckets(groups: DataFrame, buckets: int) -> DataFrame:
    lead = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return groups.withColumn("bucket", F.pmod(lead, F.lit(buckets)).cast("int"))


def _merge(index: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
    if len(index):
        row = index.iloc[0]
        digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        keep, chars, rows = (np.frombuffer(row[c], np.int64).copy() for c in ("keep_ids", "chars", "counts"))
        sizes = np.frombuffer(row["sizes"], np.int32)
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
    else:
        digests, keep, chars, rows = np.zeros((0, 32), np.uint8), *(np.zeros(0, np.int64) for _ in range(3))
        sizes, bits = np.zeros(0, np.int32), np.zeros(0, bool)
    new = np.frombuffer(b"".join(fresh["digest"]), np.uint8).reshape(-1, 32)
    new_keep, new_chars, new_rows = (fresh[c].to_numpy(np.int64) for c in ("keep_id", "chars", "rows"))
    slot = slots(_words(new), sizes, bits) if len(new) else np.zeros(0, np.int64)
    member = slot >= 0
    member[member] = (digests[slot[member]] == new[member]).all(axis=1)
    at = slot[member]
    better = (new_chars[member] > chars[at]) | ((new_chars[member] == chars[at]) & (new_keep[member] < keep[at]))
    keep[at[better]], chars[at[better]] = new_keep[member][better], new_chars[member][better]
    rows[at] += new_rows[member]
    both = np.concatenate([digests, new[~member]])
    return pd.DataFrame({"digest": [x.tobytes() for x in both], "keep_id": np.concatenate([keep, new_keep[~member]]), "group_size": np.concatenate([rows, new_rows[~member]])})


def dedup_groups(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of all rows of two tables of :func:`fingerprints`; either may be empty."""
    known = stored(grouped(history), "history-digests")
    buckets = max(1, -(-known.count() // BUCKET_DIGESTS))
    index = stored(build_index(known, buckets), "digest-index")
    incoming = _in_buckets(grouped(fresh), buckets)
    return index.groupBy("bucket").cogroup(incoming.groupBy("bucket")).applyInPandas(_merge, "digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, is_history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the id that stays, the size of its group, whether it stays, sha256 of the normalised text.

    ``is_history`` tells rows already indexed from rows that come in. Null texts count as empty; a null id loses ties
    and comes back as null; repeated rows count each, and each row with the winning id is kept. An empty table gives
    an empty result; further columns are not looked at.
    """
    prints = stored(fingerprints(docs, is_history, id_col, text_col), "fingerprints")
    groups = dedup_groups(prints.filter("known"), prints.filter("not known"))
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return prints.join(groups, "digest").select(
        real("id").alias("doc_id"), real("keep_id").alias("keep_id"), "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
