"""Near-duplicate groups of documents: SuperMinHash, banding, verification on full sets, union-find.

1. Texts with equal shingle sets form a class; one document stands for it from here on.
2. Bands of the signature put classes into buckets. In a bucket every class is compared with one leader, the class that
   shares most bucket places with others, so a group of thousands of copies costs as many pairs as it has members.
3. Pairs are confirmed on full shingle sets; links are joined to components.
4. What a leader did not settle: classes of a bucket that are still in different components. Jaccard distance is a
   metric, so a class nearer to the leader than the limit and one farther than twice the limit cannot be linked; the
   rest is compared by signature, in blocks, and pairs within 5.2 standard deviations of the limit are confirmed too.

Bands and their registers follow from the limit: a pair exactly at it escapes all bands with a probability of 1e-8 at
most (48 bands of 7 registers at 85 %, 61 of 6 at 80 %).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casagrid.llm.graph import components
from casagrid.llm.shared import binary_column, release_shuffles, slices, stored, text_bytes
from casagrid.llm.superminhash import band_keys, signatures
from casagrid.llm.words import ROLE, mixed, shingle_sets, sums_by_text

ESCAPE = 1e-8
MOST_REGISTERS = 400
SLICE = 1 << 19
BLOCK_CLASSES = 256


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int  # registers of a band

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def fine(self) -> int:
        return 2 * self.registers

    @property
    def sig_bytes(self) -> int:
        return self.fine + 4 * self.bands


def banding(percent: int) -> Banding:
    """The longest bands of which at most ``MOST_REGISTERS`` registers let a pair at ``percent`` escape with a
    probability of at most ``ESCAPE``."""
    found = None
    for rows in range(1, 33) if 0 < percent <= 100 else ():
        hit = (percent / 100) ** rows
        bands = math.ceil(math.log(ESCAPE) / math.log1p(-hit)) if hit < 1 else 1
        if bands * rows <= MOST_REGISTERS:
            found = Banding(bands, rows)
    if found is None:
        raise ValueError(f"no bands for {percent} %")
    return found


def profiles(docs: DataFrame, shingle: int, plan: Banding) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, keys): size and identity of the shingle set, and a key for each band."""

    def profile(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                raw, at = text_bytes(part.column(1))
                elements, begin = shingle_sets(raw, at, shingle)
                keys = band_keys(signatures(elements, begin, plan.registers), plan.bands)
                identity = [sums_by_text(mixed(elements ^ ROLE[k]), begin).view(np.int64) for k in (60, 61)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(begin)), *map(pa.array, identity), pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * plan.bands, pa.array(keys.reshape(-1)))],
                    names=["doc_id", "n_shingles", "k1", "k2", "keys"],
                )

    return docs.mapInArrow(profile, "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>")


def verify(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, shared, total) for pairs (a, b) of ids: sizes of intersection and union of the full shingle sets."""
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def compare(batches):
        for batch in batches:
            for part in slices(batch, "text_a", SLICE):
                sets = [shingle_sets(*text_bytes(part.column(c)), shingle) for c in (2, 3)]
                (x, i), (y, j) = sets
                shared = np.array([len(np.intersect1d(x[i[r] : i[r + 1]], y[j[r] : j[r + 1]], assume_unique=True)) for r in range(part.num_rows)], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared), pa.array(np.diff(i) + np.diff(j) - shared)], names=["a", "b", "shared", "total"])

    both = pairs.select("a", "b").join(one.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(compare, "a long, b long, shared long, total long")


def signature_table(texts: DataFrame, shingle: int, plan: Banding) -> DataFrame:
    """(doc_id, sig): the low byte of each register of a finer signature, then 32 bits of each band's key."""

    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                elements, begin = shingle_sets(*text_bytes(part.column(1)), shingle)
                low = (signatures(elements, begin, plan.fine) & 0xFF).astype(np.uint8)
                keys = (band_keys(signatures(elements, begin, plan.registers), plan.bands) & 0xFFFFFFFF).astype("<u4").view(np.uint8)
                both = np.concatenate([low, keys.reshape(len(low), 4 * plan.bands)], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), binary_column(both.reshape(-1), np.arange(len(both) + 1) * plan.sig_bytes)], names=["doc_id", "sig"])

    return texts.mapInArrow(sign, "doc_id long, sig binary")


@lru_cache(maxsize=256)
def _pairs_within(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def similar_pairs(members: DataFrame, least: float, plan: Banding) -> DataFrame:
    """(a, b) of members (key, lo, hi, blk, band, rep, comp, near, sig) of one block pair whose signatures agree on
    ``least`` of their registers and that nothing has settled yet.

    A pair is judged in the first band that it shares only; what settles it there settles it for all bands.
    """
    need = int(np.floor(least * plan.fine))

    def pairs(block: pa.Table):
        blk, rep, comp = (block.column(c).to_numpy() for c in ("blk", "rep", "comp"))
        side = block.column("near").to_numpy()
        every = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint8).reshape(-1, plan.sig_bytes)
        sig, keys = every[:, : plan.fine], every[:, plan.fine :].copy().view("<u4")
        band = block.column("band").to_numpy()[0]
        lo, hi = block.column("lo").to_numpy()[0], block.column("hi").to_numpy()[0]
        for i in range(len(rep)) if len(rep) > 24 else (None,):
            if i is None:
                x, y = _pairs_within(len(rep))
            else:
                y = np.arange(i + 1, len(rep))
                x = np.full(len(y), i)
            ok = (comp[x] != comp[y]) & (np.abs(side[x] - side[y]) < 2)
            if lo != hi:
                ok &= blk[x] != blk[y]
            x, y = x[ok], y[ok]
            same = (sig[x] == sig[y]).sum(axis=1)
            x, y = x[same >= need], y[same >= need]
            first = (keys[x] == keys[y]).argmax(axis=1) == band
            x, y = x[first], y[first]
            if len(x):
                yield np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])

    def scan(batches):
        held: list[pa.RecordBatch] = []
        ends = None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((groups[:, 1:] != groups[:, :-1]).any(axis=0)) + 1
            begins = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                if held and tuple(groups[:, a]) != ends:
                    yield from out(held)
                    held = []
                ends = tuple(groups[:, a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from out(held)

    def out(held):
        for a, b in pairs(pa.Table.from_batches(held).combine_chunks()):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return members.mapInArrow(scan, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links, its own included), kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. Null and empty texts
    have no shingles and no links. A null id is linked with nothing, has a null component and is kept. Rows that repeat
    an id count as that document. An empty table gives an empty result; further columns are not looked at.
    """
    plan = banding(percent)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(profiles(slim, shingle, plan), "shingle-profiles")
    usable = found.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "shingle-classes")
    links = class_links(classes, slim.filter("doc_id is not null"), percent, shingle)
    labels = components(links)
    home = classes.select("k1", "k2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    # Rows without shingles keep to themselves; the join key is null for them.
    keyed = found.select("doc_id", "n_shingles", *[F.when(F.col("n_shingles") > 0, F.col(k)).alias(k) for k in ("k1", "k2")])
    joined = keyed.join(home, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def class_links(classes: DataFrame, docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links (a, b) that connect the same classes as all links do."""
    places = classes.select("rep", F.posexplode("keys").alias("band", "key"))
    counts = places.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(places.join(counts, "key"), "buckets")
    degree = buckets.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = stored(buckets.join(degree, "rep"), "ranked-buckets")
    leaders = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("less"))).alias("top")).select("key", (-F.col("top.less")).alias("leader"))
    led = stored(ranked.select("key", "band", "rep", "n").join(leaders, "key"), "led-buckets")
    release_shuffles(docs.sparkSession)
    # Texts of all classes that share a bucket, by the same plan at every size.
    texts = stored(docs.join(degree.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "bucket-texts")
    release_shuffles(docs.sparkSession)
    stars = led.filter("rep != leader").select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    tested = stored(verify(stored(stars, "star-pairs"), texts, shingle), "star-tests")
    linked = tested.filter(F.expr(f"100 * shared >= {percent} * total")).select("a", "b")
    first = components(linked)
    more = stored(unsettled_pairs(led.filter("n > 2"), tested, first, texts, percent, shingle), "other-pairs")
    others = stored(verify(more, texts, shingle), "other-tests").filter(F.expr(f"100 * shared >= {percent} * total")).select("a", "b")
    return linked.unionByName(others)


def unsettled_pairs(led: DataFrame, tested: DataFrame, first: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs that share a bucket, are in different components, are not excluded by their distances to the leader, and
    have signatures alike enough."""
    plan, limit = banding(percent), 1 - percent / 100
    least = percent / 100 - 5.2 * float(np.sqrt(percent / 100 * limit / plan.fine))
    far = F.expr(f"100 * shared < {2 * percent - 100} * total")
    near = F.expr(f"100 * shared >= {percent} * total")
    # 0: as near as a link (or the leader itself), 1: between, 2: too far to be linked with any of 0
    zone = F.when(near, 0).when(far, 2).otherwise(1)
    rows = led.withColumn("a", F.least("rep", "leader")).withColumn("b", F.greatest("rep", "leader")).join(tested, ["a", "b"], "left")
    rows = rows.select("key", "band", "rep", F.when(F.col("rep") == F.col("leader"), 0).otherwise(zone).alias("near"))
    rows = rows.join(first.withColumnRenamed("id", "rep"), "rep", "left").select("key", "band", "rep", "near", F.coalesce("component", "rep").alias("comp"))
    rows = stored(rows, "zoned-buckets")
    state = rows.groupBy("key").agg(F.sum((F.col("near") == 1).cast("long")).alias("between"), F.sum((F.col("near") > 0).cast("long")).alias("outer"), (F.min("comp") != F.max("comp")).alias("apart"), F.count("*").alias("n"))
    open_keys = state.filter("apart and outer > 0 and (outer > 1 or between > 0)")
    members = rows.join(open_keys, "key").filter("between > 0 or near > 0")
    members = stored(members.withColumn("blocks", F.ceil(F.when(F.col("between") > 0, F.col("n")).otherwise(F.col("outer")) / BLOCK_CLASSES).cast("int")).select("key", "band", "rep", "near", "comp", "blocks"), "open-members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    signed = stored(signature_table(texts.join(wanted.hint("merge"), "doc_id", "left_semi"), shingle, plan), "signatures").withColumnRenamed("doc_id", "rep")
    dealt = members.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.join(signed, "rep").select("key", F.least("blk", "with").alias("lo"), F.greatest("blk", "with").alias("hi"), "blk", "band", "rep", "comp", F.col("near").cast("int").alias("near"), "sig")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return similar_pairs(sorted_, least, plan).distinct()
