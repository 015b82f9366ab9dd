"""Phrase collocations from sorted count streams.

Counts of phrases of 1, 2, ... words are streams of rows, one stream for all orders. In *prefix order* a phrase comes
right after its first words, in *suffix order* after its last words, so a single pass over either order that remembers
the last row of each length knows the counts of all first or last parts of every phrase. The two passes are then merged
in step. Nothing is looked up by a hash: ranges of the order are dealt to tasks and sorted there.

A phrase that reaches the minimum has parts that reach it too, so streams hold frequent phrases only, and a phrase is
counted only where both parts that are a word shorter may be frequent. What may be is told by a bit array of fixed size
(``FILTER_BITS``): it has no false negatives, so counts stay exact at every size, and a fuller array just prunes less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casagrid.llm.shared import slices, stored, text_bytes
from casagrid.llm.words import LOWER, ROLE, mixed, word_hashes, word_spans

FILTER_BITS = 1 << 26
SLICE_BYTES = 1 << 21
#: The followers (or forerunners) of one word are dealt to this many ranges; the word's own row goes to each.
SPREAD = 16
# Fixed value: what parts pieces, besides line ends.
MARKS = ".,;:!?"
IS_BREAK = np.zeros(256, bool)
IS_BREAK[[*map(ord, MARKS), 0x0A, 0x0B, 0x0C, 0x0D]] = True
PARTS = IS_BREAK.copy()
PARTS[[0x20, 0x09]] = True


class Text:
    """Words of a slice of texts: an id for each distinct word of a language, and the hash of the word."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        raw, at = text_bytes(texts)
        raw = LOWER[raw]
        langs = pc.fill_null(langs, "und").dictionary_encode()
        names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        starts, sizes, first = word_spans(raw, at, PARTS)
        hashes, _ = word_hashes(raw, at, PARTS)
        text = np.repeat(np.arange(len(at) - 1), np.diff(first))
        of_lang = lang[text] if len(text) else np.zeros(0, np.int64)
        seed = word_hashes(*text_bytes(pa.array([n.encode().hex() or "-" for n in names], pa.string())))[0] if names else np.zeros(0, np.uint64)
        self.hash = mixed(hashes + seed[of_lang]) if len(hashes) else hashes
        _, example, self.id = np.unique(self.hash, return_index=True, return_inverse=True)
        head = example[self.id]
        if (sizes != sizes[head]).any() or (of_lang != of_lang[head]).any() or (raw[_bytes(starts, sizes)] != raw[_bytes(starts[head], sizes)]).any():
            seen: dict[tuple, int] = {}
            each = [(g, raw[s : s + z].tobytes()) for g, s, z in zip(of_lang.tolist(), starts.tolist(), sizes.tolist(), strict=True)]
            self.id = np.array([seen.setdefault(w, len(seen)) for w in each])
            _, example = np.unique(self.id, return_index=True)
        passed = np.cumsum(IS_BREAK[raw])
        self.joined = (text[1:] == text[:-1]) & (passed[starts[1:]] == passed[starts[:-1]])
        plain = [raw[s : s + z].tobytes().decode() for s, z in zip(starts[example].tolist(), sizes[example].tolist(), strict=True)]
        self.words = pa.array(plain, pa.string())
        self.led = pa.array([f"{names[g]}\n{w}" for g, w in zip(of_lang[example].tolist(), plain, strict=True)], pa.string())
        self.totals = [(f"{n}\n", int(c)) for n, c in zip(names, np.bincount(of_lang, minlength=len(names)), strict=True) if c]

    def places(self, order: int) -> np.ndarray:
        """Where phrases of ``order`` words start."""
        if len(self.id) < order:
            return np.zeros(0, np.int64)
        whole = np.ones(len(self.id) - order + 1, bool)
        for j in range(order - 1):
            whole &= self.joined[j : len(whole) + j]
        return np.flatnonzero(whole)

    def hashes(self, places: np.ndarray, order: int) -> np.ndarray:
        total = ROLE[order].repeat(len(places))
        for j in range(order):
            total = mixed(total + self.hash[places + j] * ROLE[20 + j])
        return total

    def counts(self, places: np.ndarray, order: int) -> tuple[pa.Array, np.ndarray]:
        """Distinct phrases at ``places`` as ``lang, line end, words`` and how often they are there."""
        code, n = self.id[places], len(self.words)
        for j in range(1, order):
            _, code = np.unique(code * n + self.id[places + j], return_inverse=True)
        _, example, count = np.unique(code, return_index=True, return_counts=True)
        heads = places[example]
        parts = [self.led.take(pa.array(self.id[heads])), *(self.words.take(pa.array(self.id[heads + j])) for j in range(1, order))]
        return (pc.binary_join_element_wise(*parts, " ") if order > 1 else parts[0]), count


def _bytes(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all bytes of spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _bit(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes % np.uint64(size)).astype(np.int64)


def _count(order: int, kept) -> object:
    """Counts the phrases of ``order`` words in each slice of texts; order 1 also counts all words as phrase ``""``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.frombuffer(kept.value, np.uint8) if kept is not None else np.zeros(0, np.uint8)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                text = Text(part.column("lang"), part.column("text"))
                places = text.places(order)
                for shift in (0, 1) if kept is not None else ():
                    bit = _bit(text.hashes(places + shift, order - 1), 8 * len(may))
                    places = places[(may[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                phrases, count = text.counts(places, order)
                yield pa.RecordBatch.from_arrays([phrases, pa.array(count, pa.int64())], ["key", "a"])
                if order == 1 and text.totals:
                    yield pa.RecordBatch.from_pylist([{"key": k, "a": c} for k, c in text.totals], pa.schema([("key", pa.string()), ("a", pa.int64())]))

    return run


def _filter(frequent: DataFrame, order: int, size: int):
    """Bits of the frequent phrases of ``order`` words, the same for every task; its size is fixed."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = Text(batch.column("lang"), batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(_bit(text.hashes(text.places(order), order), size))], ["bit"])

    found = frequent.select("lang", F.array_join("words", " ").alias("text")).mapInArrow(bits, "bit long")
    rows = found.groupBy((F.col("bit") / 8).cast("long").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("bits")).toArrow()
    array = np.zeros(size // 8, np.uint8)
    array[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(array.tobytes())


def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3, lang: str = "lang", text: str = "text", filter_bits: int = FILTER_BITS) -> list[DataFrame]:
    """For each length from 0 to ``longest`` the phrases with ``least`` occurrences or more: (lang, words, a).

    Length 0 has the number of all words of a language. Each table is written to the shared folder once.
    """
    slim = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    tables, kept = [], None
    for order in range(1, longest + 1):
        counted = slim.mapInArrow(_count(order, kept), "key string, a long").groupBy("key").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
        phrase = F.substring_index("key", "\n", -1)
        named = counted.select(F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"), F.when(phrase != "", F.split(phrase, " ")).otherwise(F.array().cast("array<string>")).alias("words"), "a")
        table = stored(named, f"phrases-{order}")
        if order == 1:
            tables.append(table.filter(F.size("words") == 0))
            table = table.filter(F.size("words") == 1)
        tables.append(table)
        if order < longest:
            kept = _filter(table, order, filter_bits)
    return tables


def _parents(longest: int, name: str) -> object:
    """One pass over an ordered stream: each phrase gets the counts of its parts from the last row of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(longest, np.int64)  # count of the last row of 1, 2, ... words
        for batch in batches:
            order, count = batch.column("n").to_numpy(), batch.column("a").to_numpy()
            columns, long = [], pa.array(order > 1)
            for j in range(1, longest):
                at = np.maximum.accumulate(np.where(order == j, np.arange(len(order)), -1))
                known = np.where(at >= 0, count[at], last[j - 1])
                columns.append(pa.array(known, mask=order <= j).filter(long))
                last[j - 1] = known[-1] if len(known) else last[j - 1]
            kept = [batch.column(c).filter(long) for c in ("lang", "words", "n", "a")]
            yield pa.RecordBatch.from_arrays([*kept, *columns], ["lang", "words", "n", "a", *(f"{name}{j}" for j in range(1, longest))])

    return run


def _in_step(stream: DataFrame, longest: int, name: str, order) -> DataFrame:
    """Rows of two words or more with the counts of their first (or, in suffix order, last) 1, 2, ... words."""
    keyed = stream.withColumn("ordered", order)
    slots = F.when(F.size("words") > 1, F.array(F.pmod(F.hash(F.col("ordered")[1]), F.lit(SPREAD)))).otherwise(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    spread = keyed.select("lang", "words", F.size("words").alias("n"), "a", "ordered", F.col("ordered")[0].alias("head"), F.explode(slots).alias("slot"))
    dealt = spread.repartitionByRange("lang", "head", "slot").sortWithinPartitions("lang", "head", "slot", "ordered")
    names = ", ".join(f"{name}{j} long" for j in range(1, longest))
    return dealt.drop("ordered", "head", "slot").mapInArrow(_parents(longest, name), f"lang string, words array<string>, n int, a long, {names}")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, swallow: int = 50, lang: str = "lang", text: str = "text", top: int | None = None, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Phrases of 2 to ``longest`` words with ``least`` occurrences or more of a language, and how firmly they hold.

    A-Z count as a-z; ``.,;:!?`` and line ends part pieces, spaces and tabs part words within a piece. A phrase is cut
    where ``floor(1000000 * a * a / (l * r))`` is least (``a``, ``l``, ``r``: occurrences of the phrase and its two
    parts), at the first such place. Phrases go that lie in a longer one with at least ``swallow`` percent of their
    occurrences. Result: lang, phrase, words, cut, a, l, r, n (all words of the language), score, and with ``top`` the
    ``rank`` of the first ``top`` of a language, by score and ``a`` descending and phrase.

    Null texts are empty and have no words; a null language is ``und``, together with rows that say ``und``. Texts of any
    length are read whole; a repeated row counts each time. An empty table, or one without frequent phrases, gives no
    rows. Further columns are not read. Counts over 10^15 raise.
    """
    totals, *orders = frequent_phrases(docs, least, longest, lang, text, filter_bits)
    stream = orders[0]
    for table in orders[1:]:
        stream = stream.unionByName(table)
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    left = _in_step(stream, longest, "l", F.col("words"))
    right = _in_step(stream, longest, "r", F.reverse("words")).drop("n", "a")
    merged = stored(left.hint("merge").join(right.hint("merge"), ["lang", "words"]), "phrase-parts")

    def part(side: str, words):
        found = F.lit(None).cast("long")
        for j in range(1, longest):
            found = F.when(words == j, F.col(f"{side}{j}")).otherwise(found)
        return found

    whole = F.col("a").cast("decimal(15,0)")
    cuts = []
    for k in range(1, longest):
        l, r = F.col(f"l{k}"), part("r", F.col("n") - k)
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * whole * whole, l.cast("decimal(15,0)") * r.cast("decimal(15,0)"))
        cuts.append(F.when(F.col("n") > k, F.struct(score.alias("score"), F.lit(k).alias("cut"), l.alias("l"), r.alias("r"))))
    best = F.array_min(F.array_compact(F.array(*cuts)))
    scored = merged.select("lang", "words", "n", "a", best.alias("best"))

    swallows = lambda side: merged.filter((F.col("n") > 2) & (100 * F.col("a") >= swallow * part(side, F.col("n") - 1)))
    inner = swallows("l").select("lang", F.expr("slice(words, 1, n - 1)").alias("words")).unionByName(swallows("r").select("lang", F.expr("slice(words, 2, n - 1)").alias("words")))
    kept = scored.join(inner.hint("merge"), ["lang", "words"], "left_anti")
    found = kept.select("lang", F.array_join("words", " ").alias("phrase"), "words", "best.cut", "a", "best.l", "best.r", "best.score")
    if top is not None:  # at most ``top`` rows of a language leave each task
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return found.join(totals.select("lang", F.col("a").alias("n")), "lang")
