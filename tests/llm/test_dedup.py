"""Exact, near, line and byte-string deduplication against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casagrid.llm import anchors, exact_dedup, line_dedup, near_dedup, suffix_levels
from casagrid.llm.graph import components
from casagrid.llm.shared import text_bytes
from casagrid.llm.superminhash import FRACTION_BITS, GOLD, signatures
from casagrid.llm.words import mixed, shingle_sets

WORDS = ("ka", "lo", "mi", "ter", "an", "us", "rel", "op", "sta", "ing", "er", "wo")


def sentence(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


# Exact


@pytest.mark.parametrize("history", ["true", "false", "doc_id % 2 = 0", "cast(null as boolean)"])
def test_exact_groups(make_docs, odd_rows, history):
    rows = [*odd_rows, (20, "x y", "a"), (21, "xy ", "a"), (22, "xy", "a")]
    got = exact_dedup.exact_dedup(make_docs(rows), F.expr(history)).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows]
    want = []
    for (doc_id, *_), text in zip(rows, norm, strict=True):
        group = [r for r, n in zip(rows, norm, strict=True) if n == text]
        keep = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        want.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_exact_empty(make_docs):
    assert exact_dedup.exact_dedup(make_docs([]).limit(0), F.lit(True)).count() == 0


def test_hash_is_minimal_and_perfect():
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)), np.uint8)
    words = exact_dedup._words(digests)
    sizes, bits = exact_dedup.build_hash(words)
    assert sorted(exact_dedup.slots(words, sizes, bits)) == list(range(3000))


# Near


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(rows, percent=85):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rng, text, share):
    return " ".join(sentence(rng, 1) if rng.random() < share else w for w in text.split(" "))


def test_near_groups(make_docs, odd_rows):
    rng = random.Random(1)
    rows = list(odd_rows)
    base = sentence(rng, 150)
    for i in range(150):  # one large group around a hub, at all distances from it
        rows.append((1000 + i, base if i == 77 else edited(rng, base, rng.choice((0.003, 0.01, 0.02, 0.03, 0.05)))))
    chain = sentence(rng, 120)
    for i in range(12):  # each linked with the next only
        rows.append((2000 - i, chain))
        chain = edited(rng, chain, 0.012)
    rows += [(3000 + i, sentence(rng, rng.randint(1, 9))) for i in range(60)]
    want = near_groups(rows)
    got = near_dedup.near_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_empty(make_docs):
    assert near_dedup.near_duplicates(make_docs([]).limit(0)).count() == 0
    assert [tuple(r) for r in near_dedup.near_duplicates(make_docs([(3, "  ")])).collect()] == [(3, 0, 3, True)]


def pairs_at(rng, low, high, n):
    """``n`` pairs of texts, unlike all others, whose similarity is at least ``low`` and under ``high``."""
    out = []
    while len(out) < n:
        one = sentence(rng, rng.randint(60, 200))
        other = edited(rng, one, (1 - low) / 12)
        x, y = shingles(one), shingles(other)
        if low <= len(x & y) / len(x | y) < high:
            out += [(one, other)]
    return out


@pytest.mark.parametrize("percent", [50, 70, 80])
def test_near_pairs_just_above_the_limit(make_docs, percent):
    rng = random.Random(percent)
    rows = [(10 * i + j, text) for i, pair in enumerate(pairs_at(rng, percent / 100, percent / 100 + 0.05, 150)) for j, text in enumerate(pair)]
    want = near_groups(rows, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(make_docs(rows), percent).collect()} == want


def test_no_limit_lets_pairs_escape():
    for percent in range(5, 100):
        plan = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** plan.rows) ** plan.bands <= 1e-8 and plan.fine < 1 << (32 - FRACTION_BITS)
    for percent in (0, 1, 101):
        with pytest.raises(ValueError):
            near_dedup.banding(percent)


def test_stage_drops_copies_between_80_and_85(spark):
    rng = random.Random(7)
    rows = [(10 * i + j, text) for i, pair in enumerate(pairs_at(rng, 0.8, 0.85, 40)) for j, text in enumerate(pair)]
    kept = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i, _ in rows if i % 10 == 0]


def test_blocks_compare_all_pairs(make_docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 8)
    rng = random.Random(5)
    base = sentence(rng, 150)
    rows = [(i, edited(rng, base, rng.choice((0.02, 0.03, 0.04)))) for i in range(80)]
    want = near_groups(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(make_docs(rows)).collect()} == want


def test_signatures_equal_the_sequential_method():
    rng = random.Random(2)
    texts = [sentence(rng, n) for n in (1, 4, 7, 30, 100)] + ["", None]
    elements, begin = shingle_sets(*text_bytes(pa.array(texts)))
    registers = 60
    got = signatures(elements, begin, registers)
    for i in range(len(texts)):
        want = [2**32 - 1] * registers
        for e in elements[begin[i] : begin[i + 1]]:
            order = list(range(registers))
            for rank in range(registers):
                x = int(mixed(np.array([e]) + GOLD * np.array([rank + 1], np.uint64))[0])
                k = rank + (((x >> 32) * (registers - rank)) >> 32)
                order[rank], order[k] = order[k], order[rank]
                want[order[rank]] = min(want[order[rank]], rank << FRACTION_BITS | x & ((1 << FRACTION_BITS) - 1))
        assert got[i].tolist() == want


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    root = list(range(700))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[x] == find(x) for a, b in links if a != b for x in (a, b))


# Lines


def test_lines(make_docs, odd_rows):
    rng = random.Random(6)
    rows = list(odd_rows)
    for i in range(200):
        lines = [f" boiler {k} " if rng.random() < 0.5 else f"boiler {k}" for k in range(30) if rng.random() < k / 60] + [sentence(rng, 4), "", sentence(rng, 2)]
        rng.shuffle(lines)
        rows.append((100 + i, "\n".join(lines), None if i % 17 == 0 else f"site{i % 17 if rng.random() < .5 else i % 5}"))
    least = 12
    sites, first = defaultdict(set), {}
    for doc_id, text, site, *_ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")].add(site)
                place = (doc_id is not None, doc_id or 0, pos)
                first[line.strip(" ")] = min(first.get(line.strip(" "), place), place)
    want = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if not (len(sites[x.strip(" ")]) >= least and first[x.strip(" ")] != (doc_id is not None, doc_id or 0, pos))]
        want.append((doc_id, text if text is None else "\n".join(kept), len(lines) if text else 0, len(lines) - len(kept)))
    assert sum(w[3] for w in want) > 300
    got = line_dedup.dedup_lines(make_docs(rows), least)
    assert got.columns.count("n_lines") == 1 and "score" in got.columns
    assert sorted(map(repr, map(tuple, got.select("doc_id", "text", "n_lines", "n_removed").collect()))) == sorted(map(repr, want))


def test_lines_empty(make_docs):
    assert line_dedup.dedup_lines(make_docs([]).limit(0), 3).count() == 0


# Byte strings


def repeats(texts, window):
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[p : p + window] for d in data for p in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - window + 1):
            if counts[d[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(1 for p in range(len(gone)) if gone[p] and not (p and gone[p - 1])), kept))
    return out


@pytest.mark.parametrize(("batches", "window", "hot"), [(1, 64, 0), (2, 64, 512), (5, 64, 8), (3, 20, 8), (3, 200, 0), (2, 400, 8), (1, 3, 4)])
def test_repeats(make_docs, batches, window, hot, monkeypatch):
    monkeypatch.setattr(suffix_levels, "HOT_SPANS", hot)
    rng = random.Random(batches)
    shared = [sentence(rng, rng.randint(8, 40)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 300), (5, "ab" * 200 + "é" * 150), (6, sentence(rng, 3000)), (None, shared[0] * 2), (7, shared[1])]
    for i in range(60):
        parts = [sentence(rng, rng.randint(1, 12)), rng.choice(shared), sentence(rng, rng.randint(1, 12)), rng.choice(shared)[rng.randint(0, 60) :]]
        rows.append((10 + i, " ".join(parts)))
    rows += [rows[12], (90, rows[13][1])]
    got = suffix_levels.remove_repeats(make_docs(rows), window=window, batches=batches).collect()
    want = [(r[0], *w) for r, w in zip(rows, repeats([r[1] for r in rows], window), strict=True)]
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in got) == sorted(map(repr, want))


def test_levels_merge_geometrically(make_docs):
    rng = random.Random(9)
    family = suffix_levels.SuffixLevels(64)
    ranks = []
    for i in range(5):
        family.add(suffix_levels.keyed(make_docs([(i, sentence(rng, 60))]), "doc_id", "text"))
        ranks.append([r for r, _ in family.levels])
    assert ranks == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0]]


def test_windows_out_of_range_raise(make_docs):
    for window in (0, 1 << 16):
        with pytest.raises(ValueError):
            suffix_levels.remove_repeats(make_docs([(1, "a")]), window=window)


def test_a_hot_key_is_settled_either_way(make_docs, monkeypatch):
    """Texts that share 80 bytes in different contexts, settled by halving and in a task."""
    rng = random.Random(1)
    common = sentence(rng, 200)[:80]
    rows = [(i, sentence(rng, 60) + common + sentence(rng, 60)) for i in range(400)]
    want = repeats([t for _, t in rows], 64)
    for hot in (0, 512):
        monkeypatch.setattr(suffix_levels, "HOT_SPANS", hot)
        got = suffix_levels.remove_repeats(make_docs(rows), window=64, batches=1).collect()
        assert sorted((r["n_removed"], bytes(r["kept"])) for r in got) == sorted((w[1], w[3]) for w in want)


def test_places_of_a_hot_span_are_dealt_over_groups(spark):
    rows = spark.range(3000).selectExpr("if(id < 2000, 7, id) as span", "id as doc", "id * 65536 + 1 as pos")
    spans = spark.createDataFrame([(7, 2000), (2500, 1)], "span long, n long")
    got = suffix_levels.in_spans(rows, spans, 3000).collect()
    assert sorted(r["doc"] for r in got) == [*range(2000), 2500]
    assert len({r["salt"] for r in got if r["span"] == 7}) == suffix_levels.SALTS and {r["salt"] for r in got if r["span"] != 7} == {0}


def test_levels_are_combined_by_hashing_and_anchors_by_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 2, 1, 5, 6, 7), (1, 2, 3, 8, 9, 10), (1, 3, 1, 0, 0, 0)], "key long, span long, n long, doc long, pos long, off long")
    found = suffix_levels.combined(rows)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["n"] for r in found.collect()) == [1, 4] and {tuple(r)[3:] for r in found.collect()} <= {(5, 6, 7), (8, 9, 10), (0, 0, 0)}
    rng = np.random.default_rng(3)
    at = np.cumsum([0, *rng.integers(0, 900, 60)])
    raw = rng.integers(97, 100, at[-1]).astype(np.uint8)
    whole = suffix_levels.text_anchors(raw, at, 64)
    monkeypatch.setattr(suffix_levels, "BLOCK", 1000)
    assert len(whole[0]) and all(np.array_equal(a, b) for a, b in zip(whole, suffix_levels.text_anchors(raw, at, 64), strict=True))


def test_repeats_empty(make_docs):
    assert suffix_levels.remove_repeats(make_docs([]).limit(0)).count() == 0


def test_anchors_depend_on_content_alone():
    rng = np.random.default_rng(1)
    part = rng.integers(97, 100, 400).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(97, 100, n).astype(np.uint8), part, rng.integers(97, 100, n).astype(np.uint8)]) for n in (50, 333))
    found = []
    for raw, at in ((a, 50), (b, 333)):
        key, first, n, place = anchors.anchors(raw, 200, 48)
        of = np.repeat(np.arange(len(first)), n)
        assert len(of) == len(raw) - 199
        found.append([(key[of[p]], place[of[p]] - p) for p in range(at, at + 201)])
    assert found[0] == found[1]
