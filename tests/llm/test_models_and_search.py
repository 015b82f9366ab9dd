"""Classifiers, mixing, nearest neighbours, the pipeline and the registered SQL."""

import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casagrid.llm import mixing, prefix_forest, quality, queries, toxicity
from casagrid.llm.queries import held_out

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels", "embeddings")}


# Classifiers


def test_toxicity_on_rows_not_learnt_from(spark, tables, make_docs, odd_rows):
    model = toxicity.fit(tables["documents"], tables["labels"].filter(~held_out()))
    rows = toxicity.score(tables["documents"], model).join(tables["labels"].select("doc_id", F.col("toxic").alias("label")), "doc_id").filter(held_out()).collect()
    hits, found, all_ = (sum(f(r) for r in rows) for f in (lambda r: r["score"] >= 0.7 and r["label"] == 1, lambda r: r["score"] >= 0.7, lambda r: r["label"] == 1))
    assert all_ > 10 and hits / all_ >= 0.65 and hits / found >= 0.85
    odd = toxicity.score(make_docs(odd_rows), model)
    got = odd.collect()
    assert len(got) == len(odd_rows) and odd.columns.count("score") == 1 and all(0 <= r["score"] <= 1 and r["toxic"] is not None for r in got)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    assert toxicity.score(make_docs([]).limit(0), model).count() == 0


def test_thresholds_learn_from_all_labels(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4000):  # a language of one row in fifty, in which a word that is toxic elsewhere is toxic by half only
        rare, toxic = i % 50 == 0, rng.random() < 0.3
        marks = ["bad"] * (1 if rare else toxic) + (["worse"] if toxic and rng.random() < 0.9 else [])
        words = [rng.choice("abcdefgh") for _ in range(6)] + marks
        rng.shuffle(words)
        rows.append((i, " ".join(words), "xx" if rare else "en", int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    for size in (1_000, 12_000):  # most labels outside the sample, or none
        model = toxicity.fit(frame.drop("toxic"), frame.select("doc_id", "toxic"), training_rows=size)
        assert set(model.thresholds) == {"en", "xx"}
        found = toxicity.score(frame.filter("lang = 'xx'").withColumnRenamed("toxic", "label"), model).collect()
        flagged = [r["label"] for r in found if r["toxic"]]
        assert sum(flagged) / len(flagged) >= 0.9 and sum(flagged) >= 0.6 * sum(r["label"] for r in found)


def test_toxicity_with_labels_of_one_kind(spark, tables, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    for rows in ([], [(1, 0), (2, None)], [(1, 1), (5, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert len({r["score"] for r in toxicity.score(docs, model).collect()}) == 1


def test_quality_on_rows_not_learnt_from(spark, tables, make_docs, odd_rows):
    model = quality.fit(tables["documents"], tables["labels"].filter(~held_out()))
    found = quality.hierarchical_quality(tables["documents"], model, F.col("source"), F.concat("source", "lang"))
    rows = found.select("doc_id", "kept").join(tables["labels"].select("doc_id", F.col("quality").alias("label")), "doc_id").filter(held_out()).collect()
    assert sum(r["kept"] == (r["label"] == 1) for r in rows) / len(rows) > 0.93
    got = quality.hierarchical_quality(make_docs(odd_rows), model, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["quality"] <= 1 for r in got)
    assert quality.hierarchical_quality(make_docs([]).limit(0), model, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink_toward_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, "big", "big/a", float(x)) for i, x in enumerate(rng.beta(2, 8, 400))] + [(900 + i, f"good{i % 5}", f"good{i % 5}/a", float(x)) for i, x in enumerate(rng.beta(8, 2, 400))] + [(2000, "tiny", "tiny/a", 0.01), (2001, "tiny", "tiny/a", 0.02)]
    scored = spark.createDataFrame(rows, "doc_id long, site string, path string, score double")
    monkeypatch.setattr(quality, "evidence", lambda docs, model: scored)
    docs = spark.createDataFrame([(1, "s", "t")], "doc_id long, source string, text string")
    got = {r["doc_id"]: r for r in quality.hierarchical_quality(docs, None, F.col("source"), F.col("source")).collect()}
    center = np.mean([r[3] for r in rows])
    assert abs(got[0]["site_posterior"] - 0.2) < 0.03 and abs(got[900]["site_posterior"] - 0.8) < 0.05
    assert 0.015 < got[2000]["site_posterior"] < center  # moved from its one neighbour toward the whole


def test_quality_of_no_labels(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None)])
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.hierarchical_quality(docs, model, F.col("source"), F.col("lang")).collect()} == {0.5}


# Mixing


def spread(sizes, weights, budget):
    """Targets by resharing the excess until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = budget - sum(2 * sizes[s] for s in capped)
        total = sum(w[s] for s in names if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * w[s] / total for s in names}
        over = {s for s in names if target[s] > 2 * sizes[s] * (1 + 1e-12)} - capped
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_targets(make_docs, seed, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    rng = random.Random(seed)
    names = [None, "", "é", "z", "a", "b", "ab", "Z"][: 3 + seed + 1]
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 5, 30))) if i % 11 else None, rng.choice([names[0], *names])) for i in range(300)] + [(5, "a b c", "z")] * 3
    first = mixing.mix(make_docs(rows), mixing.word_count(F.col("text"))).collect()
    assert len(first) == len(rows)
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in first:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = spread(size, (3, 1, 2), 1.5 * sum(size.values()))
    for s in target:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-6) and abs(taken[s] - math.floor(target[s] + 1e-9)) <= 1
    again = mixing.mix(make_docs(rows).repartition(7), mixing.word_count(F.col("text"))).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    assert mixing.mix(make_docs([]).limit(0), F.lit(1)).count() == 0


# Nearest neighbours


def test_forest_recall(spark, tables):
    rows = tables["embeddings"].collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    forest = prefix_forest.build_forest(tables["embeddings"])
    got = defaultdict(list)
    for r in forest.search(tables["embeddings"].filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(axis=1)
        score[i] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        own = got[ids[i]]
        assert len(own) == 20 and np.allclose([s for _, s in own], [score[ids == v][0] for v, _ in own], rtol=1e-14)
        hits += len({*best.tolist()} & {v for v, _ in own})
    assert hits / sum(map(len, got.values())) >= 0.9


@pytest.mark.parametrize("sigma", [0.5, 1.0])
def test_forest_recall_in_a_full_shard_of_unequal_norms(spark, sigma):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(prefix_forest.SHARD_ROWS, 64))
    x *= np.exp(sigma * rng.normal(size=(len(x), 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in prefix_forest.build_forest(frame).search(frame.filter("vec_id % 80 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for i in range(0, len(x), 80):
        score = x @ x[i]
        score[i] = -np.inf
        hits += len(got[i] & set(np.argsort(-score)[:20].tolist()))
    assert hits / sum(map(len, got.values())) >= 0.9


def test_forest_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(prefix_forest, "SHARD_ROWS", 8)
    monkeypatch.setattr(prefix_forest, "QUERY_BLOCK", 2)
    rows = [(0, [1.0, 0.0]), (1, [5.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (20, [0.5, 0.5]), (None, [9.0, 9.0]), (40, None)]
    rows += [(100 + i, [1.0, 0.0]) for i in range(30)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    forest = prefix_forest.build_forest(frame)
    got = defaultdict(list)
    for r in forest.search(frame.filter("vec_id % 20 = 0"), k=5, enough=64.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert got[0] == [(1, 1, 5.0), (2, 2, 1.0), (3, 3, 1.0), (4, 100, 1.0), (5, 101, 1.0)]
    assert [v for _, v, _ in got[20]] == [1, 0, 2, 3, 100] and set(got) == {0, 20, 100, 120}
    assert prefix_forest.build_forest(frame.limit(0)).search(frame).count() == 0
    assert forest.search(frame.limit(0)).count() == 0


# Registered queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, []
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()} if name != "packing" else None
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL), "test-stage")
        counts.append(docs.count())
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            gone = set(before) - {r["doc_id"] for r in rows}
            assert sum(labels.get(i) == 0 for i in gone) <= 2
        if name == "near_dedup":
            assert len({r["doc_id"] for r in rows}) == len(rows)
        if name == "mixing":
            from collections import Counter

            words = {i: len((r["text"] or "").split()) for i, r in before.items()}
            total = sum(len(r["text"].split()) for r in rows)
            assert abs(total - 1.5 * sum(words.values())) <= 25
            assert max(Counter(r["doc_id"] for r in rows).values()) == 2
        if name == "packing":
            ends = defaultdict(int)
            for r in rows:
                ends[r["sequence_id"]] += r["length"]
            assert max(ends.values()) <= 1024 and len(ends) <= sum(ends.values()) / 1024 * 1.02 + 2
    assert corpus_pipeline.run(spark, SMALL).count() == counts[-1]
