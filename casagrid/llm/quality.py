"""Quality of documents by hierarchical empirical Bayes.

A document's own evidence is a logistic classifier on counts of its bytes, words and lines. The mean evidence of a site
and of a path on it are posteriors of a two-level beta model: a path is shrunk toward its site and a site toward the
global mean, each by a strength that the method of moments finds from the spread of the group means. So a site of two
pages says little and one of a million says much. A document's own evidence is taken out of its groups before they
count as its prior. Groups meet documents through sums by (site, path), combined before every shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casagrid.llm.shared import slices, stored, text_bytes
from casagrid.llm.words import sums_by_text, word_hashes, word_spans

#: Bound of the training sample: labelled rows.
TRAINING_ROWS = 20_000
SLICE = 1 << 20
CLASSES = ("upper", "lower", "digit", "mark", "other")


def _class_of() -> np.ndarray:
    kind = np.full(256, 4)
    for b in range(128):
        c = chr(b)
        kind[b] = 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if c.isdigit() else 3 if c.isprintable() and c != " " else 5
    return kind


CLASS_OF = _class_of()


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row per text: shares of byte classes, odd marks, word lengths, repeated words, lines and length."""
    size = np.maximum(np.diff(at), 1)
    counts = [sums_by_text((CLASS_OF[raw] == k).astype(np.uint64), at) / size for k in range(len(CLASSES))]
    odd = sums_by_text(np.isin(raw, np.frombuffer(b"#$%&*@^_|~<>{}[]\\!", np.uint8)).astype(np.uint64), at) / size
    lines = sums_by_text((raw == 10).astype(np.uint64), at) / size
    hashes, first = word_hashes(raw, at)
    n = np.diff(first)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], np.float64)
    starts, lengths, _ = word_spans(raw, at)
    mean = sums_by_text(lengths.astype(np.uint64), first) / np.maximum(n, 1)
    marked = sums_by_text((CLASS_OF[raw[starts + lengths - 1]] == 3).astype(np.uint64), first) / np.maximum(n, 1) if len(starts) else np.zeros(len(n))
    some = np.log1p(n)
    table = np.stack([*counts, odd, lines, distinct / np.maximum(n, 1), mean / 10, (mean / 10) ** 2, marked, some / 10, (some / 10) ** 2, distinct / np.maximum(n, 1) * some / 10], axis=1)
    return table.astype(np.float64)


@dataclass
class DocumentClassifier:
    center: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    offset: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.expand(np.clip((x - self.center) / self.spread, -6, 6)) @ self.weight + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))

    @staticmethod
    def expand(z: np.ndarray) -> np.ndarray:
        return np.concatenate([z, np.abs(z), np.maximum(z - 1, 0), np.maximum(-z - 1, 0)], axis=1)


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> DocumentClassifier:
    """Ridge logistic regression by Newton steps; labels of one kind only give their smoothed share."""
    center, spread = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    model = DocumentClassifier(center, spread, np.zeros(4 * x.shape[1]), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if 0 < y.sum() < len(y):
        z = np.concatenate([model.expand(np.clip((x - center) / spread, -6, 6)), np.ones((len(x), 1))], axis=1)
        beta, keep = np.append(model.weight, model.offset), np.append(np.full(z.shape[1] - 1, ridge), 0.0)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (y - p) - keep * beta)
            beta = beta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        model.weight, model.offset = beta[:-1], float(beta[-1])
    return model


def fit(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DocumentClassifier:
    """Trains on about ``training_rows`` rows of ``labels`` (doc_id, quality) at most, picked by a hash of the id."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).dropDuplicates(["doc_id"])
    total = known.count()
    share = min(1.0, training_rows / total) if total else 0.0
    picked = stored(known.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)), "quality-sample")

    def measure(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                x = features(*text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # A bounded number of small rows: the broadcast does not grow with the corpus.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality").mapInArrow(measure, "doc_id long, quality int, x array<double>")
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["x"]))
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    return train(np.array([r["x"] for r in rows], np.float64).reshape(-1, width), np.array([r["quality"] for r in rows], np.float64))


def evidence(docs: DataFrame, model: DocumentClassifier) -> DataFrame:
    """(doc_id, site, path, score) of whole texts (doc_id, site, path, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                score = shared.value.scores(features(*text_bytes(part.column(3))))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(score)], names=["doc_id", "site", "path", "score"])

    return docs.mapInArrow(run, "doc_id long, site string, path string, score double")


def strength() -> Column:
    """Pseudo-count of the beta prior over group means by the method of moments, from columns n, mean, center, v (the
    variance of a single document): between-group variance is what the means spread beyond sampling."""
    spread = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("center"), 2))
    noise = F.sum(F.col("v"))
    weight = F.sum("n") - F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("n")), F.sum("n")), F.lit(0.0))
    between = F.try_divide(spread - noise, weight)
    typical = F.avg(F.col("center") * (1 - F.col("center")))
    return F.least(F.greatest(F.coalesce(F.when(between > 1e-9, typical / between - 1), F.lit(1e6)), F.lit(1.0)), F.lit(1e6))


def hierarchical_quality(docs: DataFrame, model: DocumentClassifier, site: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """Per row: doc_id, site, path, score, site_posterior, path_posterior, quality, kept.

    ``score``: the document's own evidence; the posteriors: without its own evidence; ``quality``: the classifier's odds
    moved by how far the path's posterior is from the global mean. Null sites and paths are groups of their own; null
    and empty texts are scored as texts without words; repeated rows count each. An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(site.cast("string"), F.lit("")).alias("site"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    scored = stored(evidence(slim, model), "quality-evidence")
    paths = stored(scored.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.sum(F.col("score") * F.col("score")).alias("squares")), "path-sums")
    sites = stored(paths.groupBy("site").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]), "site-sums")
    # One row from here: the global mean, the variance of a document, and both strengths.
    everything = sites.agg(F.sum("n").alias("all_n"), F.sum("total").alias("all_total"), F.sum("squares").alias("all_squares"))
    everything = everything.select((F.col("all_total") / F.col("all_n")).alias("center"), (F.col("all_squares") / F.col("all_n") - F.pow(F.col("all_total") / F.col("all_n"), 2)).alias("v"))
    whole = everything.first()
    center, v = (whole["center"] if whole["center"] is not None else 0.5), max(whole["v"] or 0.0, 1e-9)
    by_site = sites.select("n", (F.col("total") / F.col("n")).alias("mean"), F.lit(center).alias("center"), F.lit(v).alias("v"))
    site_strength = by_site.agg(strength().alias("k")).first()["k"]
    named = sites.select("site", F.col("n").alias("site_n"), F.col("total").alias("site_total"))
    by_path = paths.join(named, "site")
    inner = by_path.select("n", (F.col("total") / F.col("n")).alias("mean"), (F.col("site_total") / F.col("site_n")).alias("center"), F.lit(v).alias("v"))
    path_strength = inner.agg(strength().alias("k")).first()["k"]
    groups = by_path.select("site", "path", F.col("n").alias("path_n"), F.col("total").alias("path_total"), "site_n", "site_total")
    joined = scored.join(groups, ["site", "path"])
    site_post = (F.col("site_total") - F.col("score") + site_strength * center) / (F.col("site_n") - 1 + site_strength)
    path_post = (F.col("path_total") - F.col("score") + path_strength * F.col("site_posterior")) / (F.col("path_n") - 1 + path_strength)
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))
    logit = odds(F.col("score")) + odds(F.col("path_posterior")) - odds(F.lit(center))
    out = joined.withColumn("site_posterior", site_post).withColumn("path_posterior", path_post).withColumn("quality", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "site", "path", "score", "site_posterior", "path_posterior", "quality", (F.col("quality") >= cut).alias("kept"))
