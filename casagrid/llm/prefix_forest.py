"""Nearest neighbours by largest inner product with a forest of hash-prefix trees.

Rows are dealt into shards of bounded size. A shard has one sorted array of long hash strings per tree; equal leading
bits of such strings are the nodes of a prefix tree. A query descends in every tree to its longest matching prefix and
then ascends in all trees in step, one bit at a time, until the nodes hold enough rows; these are scored exactly.

Hash bits are the signs of random projections. Vectors of unequal norm are first lifted onto a sphere by one more
component, which turns the largest inner product into the smallest angle. Short vectors would crowd at the pole of that
component and fill any node, so a shard keeps norms apart: each band of norms has trees of its own, and bands are read
from the longest on as long as their norm can still beat a query's k-th score. The index is a table, a row for each shard.
Queries come in blocks, and each (shard, block) is a task of its own. How many rows are enough is a share of the band:
vectors without structure have no short cut, so the default reads about half of them for a recall above 0.9.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casagrid.llm.shared import stored

SHARD_ROWS = 8192
QUERY_BLOCK = 2048
TREES = 64
BITS = 32
#: Norms of a band are within this factor.
NORM_STEP = 1.5
#: Rows that the nodes of all trees hold together before the ascent ends, as a share of the band, beside k rows a tree;
#: a row counts in each tree, so ``TREES`` means all rows.
ENOUGH = 0.6


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector, dim) of vectors that are not null, zero, or with null or non-finite components."""
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return slim.filter(finite & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(trees * BITS, dim + 1))


def hash_strings(x: np.ndarray, lift: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """One row per tree: the hash strings of all vectors as numbers whose leading bits are the prefix."""
    out = np.zeros((trees, len(x)), np.uint32)
    flat = planes(x.shape[1], trees, seed)
    for lo in range(0, len(x), 1024):
        part = np.concatenate([x[lo : lo + 1024], lift[lo : lo + 1024, None]], axis=1)
        signs = (flat @ part.T > 0).reshape(trees, BITS, -1)
        for b in range(BITS):
            out[:, lo : lo + 1024] |= signs[:, b].astype(np.uint32) << np.uint32(BITS - 1 - b)
    return out


def norm_bands(norm: np.ndarray) -> np.ndarray:
    """The band of each norm, 0 for the longest; norms too small or too large for a double end in the last or first."""
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.log(norm.max() / norm) / np.log(NORM_STEP)
    return np.minimum(np.nan_to_num(step, nan=0.0), 1 << 12).astype(np.int64)


def band_strings(x: np.ndarray, norm: np.ndarray, begin: np.ndarray, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One row per tree: the sorted hash strings of each band, and the places of their rows in the band."""
    top = np.repeat(np.maximum.reduceat(norm, begin[:-1]), np.diff(begin))
    lift = np.sqrt(np.maximum(np.nan_to_num((top - norm) * (top + norm)), 0))
    strings = hash_strings(x, lift, trees, seed)
    order = np.zeros(strings.shape, np.int32)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        order[:, a:b] = np.argsort(strings[:, a:b], axis=1, kind="stable")
        strings[:, a:b] = np.take_along_axis(strings[:, a:b], order[:, a:b], axis=1)
    return strings, order


def search_shard(ids: np.ndarray, x: np.ndarray, norm: np.ndarray, begin: np.ndarray, strings: np.ndarray, order: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_strings: np.ndarray, k: int, enough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and score of the ``k`` best found in the bands of a shard, each query's own row left out."""
    length = np.sqrt((q * q).sum(axis=1))
    least = np.full(len(q), -np.inf)
    best_ids, best = [np.zeros(0, np.int64)] * len(q), [np.zeros(0)] * len(q)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        live = np.flatnonzero(~(length * norm[a:b].max() * (1 + 1e-9) < least))
        found = search_band(ids[a:b], x[a:b], strings[:, a:b], order[:, a:b], q_ids[live], q[live], q_strings[:, live], k, enough)
        for i, (rows, score) in zip(live, found, strict=True):
            rows, score = np.append(best_ids[i], rows), np.append(best[i], score)
            top = np.lexsort((rows, -score))[:k]
            best_ids[i], best[i] = rows[top], score[top]
            if len(top) == k:
                least[i] = best[i][-1]
    return np.repeat(q_ids, [len(r) for r in best_ids]), np.concatenate([np.zeros(0, np.int64), *best_ids]), np.concatenate([np.zeros(0), *best])


def search_band(ids: np.ndarray, x: np.ndarray, strings: np.ndarray, order: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_strings: np.ndarray, k: int, enough: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores of the ``k`` best among the rows that each query's nodes hold, its own row left out."""
    trees, n, need = len(strings), len(ids), len(strings) * min(len(ids), int(np.ceil(enough * len(ids) / len(strings))) + k)
    low, high = np.zeros((trees, len(q)), np.int64), np.zeros((trees, len(q)), np.int64)
    open_ = np.arange(len(q))
    for depth in range(BITS, -1, -1):
        rest = np.uint32((1 << (BITS - depth)) - 1)
        for t in range(trees):
            own = q_strings[t, open_]
            low[t, open_] = np.searchsorted(strings[t], own & ~rest, side="left")
            high[t, open_] = np.searchsorted(strings[t], own | rest, side="right")
        open_ = open_[(high[:, open_] - low[:, open_]).sum(axis=0) < need]
        if not len(open_):
            break
    found = []
    for i in range(len(q)):
        inside = np.zeros(n, bool)
        for t in range(trees):
            inside[order[t, low[t, i] : high[t, i]]] = True
        rows = np.flatnonzero(inside & (ids != q_ids[i]))
        if len(rows) < k:  # the same few rows in many trees: up to the root
            rows = np.flatnonzero(ids != q_ids[i])
        score = (x[rows] * q[i]).sum(axis=1)  # row by row alike, so that equal vectors tie
        if len(rows) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[score >= least], score[score >= least]
        best = np.lexsort((ids[rows], -score))[:k]
        found.append((ids[rows[best]], score[best]))
    return found


@dataclass
class PrefixForest:
    index: DataFrame  # (dim, shard, n, ids, vectors, norms, bands, strings, places)
    trees: int
    seed: int

    def search(self, queries: DataFrame, k: int = 20, enough: float = ENOUGH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score): each query's ``k`` nearest found, its own id left out, ties to the smaller
        id. Queries with unusable vectors give no rows; those of a length that no row has give none either; a repeated
        query counts once."""
        trees, seed = self.trees, self.seed
        asked = stored(usable(queries, id_col, vector_col).dropDuplicates(["vec_id"]), "forest-queries")
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))

        def run(index: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            if not len(index) or not len(block):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            row = index.iloc[0]
            n, dim = int(row["n"]), int(row["dim"])
            x, ids = np.frombuffer(row["vectors"], np.float64).reshape(n, dim), np.frombuffer(row["ids"], np.int64)
            norm, begin = np.frombuffer(row["norms"], np.float64), np.frombuffer(row["bands"], np.int64)
            strings, order = np.frombuffer(row["strings"], np.uint32).reshape(trees, n), np.frombuffer(row["places"], np.int32).reshape(trees, n)
            q = np.stack(block["vector"].to_list()).astype(np.float64)
            q_strings = hash_strings(q, np.zeros(len(q)), trees, seed)
            found = search_shard(ids, x, norm, begin, strings, order, block["vec_id"].to_numpy(np.int64), q, q_strings, k, enough)
            return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

        shards = self.index.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
        places = self.index.select((F.col("dim") + 0).alias("dim"), (F.col("shard") + 0).alias("shard"))
        sent = asked.join(places, "dim")
        found = shards.groupBy("dim", "shard", "block").cogroup(sent.groupBy("dim", "shard", "block")).applyInPandas(run, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def build_forest(vectors: DataFrame, trees: int = TREES, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> PrefixForest:
    """Indexes every usable row. Null, zero, or partly null or non-finite vectors and null ids take no part; vectors of
    unequal length are kept in shards of their own; repeated ids stay as rows. An empty table gives an empty index."""
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("shards"))
    dealt = rows.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("shards")))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ids, x = group["vec_id"].to_numpy(np.int64), np.stack(group["vector"].to_list()).astype(np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        bands = norm_bands(norm)
        place = np.lexsort((ids, bands))
        ids, x, norm, bands = ids[place], x[place], norm[place], bands[place]
        begin = np.append(np.flatnonzero(np.append(True, bands[1:] != bands[:-1])), len(bands)).astype(np.int64)
        strings, order = band_strings(x, norm, begin, trees, seed)
        packed = [c.tobytes() for c in (ids, x, norm, begin, strings, order)]
        return pd.DataFrame([[x.shape[1], group["shard"].iloc[0], len(x), *packed]], columns=["dim", "shard", "n", "ids", "vectors", "norms", "bands", "strings", "places"])

    schema = "dim int, shard long, n int, ids binary, vectors binary, norms binary, bands binary, strings binary, places binary"
    return PrefixForest(stored(dealt.groupBy("dim", "shard").applyInPandas(build, schema), "forest"), trees, seed)
