"""Toxicity of whole texts by the convolutional classifier, with thresholds calibrated by language."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casagrid.llm.shared import binary_column, slices, stored, text_bytes
from casagrid.llm.textcnn import TextCnn, best_cut, gather, train, words_of

#: Bounds of the training sample: labelled rows, and characters of a row.
TRAINING_ROWS = 12_000
TRAINING_CHARS = 200_000
SLICE = 1 << 20
FOLDS = 5
CUT = 0.7  # the score that the best cut of all languages together is moved to
STEPS = 128  # a logit, in the histograms that cuts are made on
LEAST_ROWS = 10  # labelled rows of each kind that a language needs for a threshold of its own


@dataclass
class ToxicityModel:
    cnn: TextCnn
    thresholds: dict[str, float] = field(default_factory=dict)  # by language; others: CUT


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row for each id with a label of 0 or 1."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return stored(known.groupBy("doc_id").agg(F.max("label").alias("label")), "known-labels")


def labelled_sample(docs: DataFrame, known: DataFrame, rows: int, chars: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, lang, label) of about ``rows`` labelled documents at most, picked by a hash of the id, and
    (doc_id, text, lang) of all other documents but those that would have been picked with a label."""
    total = known.count()
    share = min(1.0, rows / total) if total else 0.0
    picked = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("inside", F.coalesce(picked & (F.length("text") <= chars), F.lit(False)))
    # At most about ``rows`` small rows, so the broadcast is bounded by a parameter.
    sample = slim.filter("inside").join(F.broadcast(stored(known.filter(picked), "label-sample")), "doc_id").select("doc_id", "text", "lang", "label")
    return sample, slim.filter("not inside and doc_id is not null").drop("inside")


def logit_steps(docs: DataFrame, cnn: TextCnn) -> DataFrame:
    """(doc_id, lang, step) of ``docs`` (doc_id, text, lang): in which step of the histogram each logit is."""
    shared = docs.sparkSession.sparkContext.broadcast(cnn)

    def run(batches):
        tables = shared.value.tables()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                steps = steps_of(shared.value.logits_of(*words_of(*text_bytes(part.column(1))), tables))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(steps)], names=["doc_id", "lang", "step"])

    return docs.mapInArrow(run, "doc_id long, lang string, step long")


def steps_of(logits: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(logits.astype(np.float64), -30, 30) * STEPS).astype(np.int64)


def cut_of(rows: list) -> float:
    """The best cut of rows (step, label, n) of a histogram."""
    step, label, n = (np.array([r[c] for r in rows], np.int64) for c in ("step", "label", "n"))
    return best_cut((step + 0.5) / STEPS, label, n)


def fit(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, training_chars: int = TRAINING_CHARS) -> ToxicityModel:
    """Trains on a bounded sample of ``labels`` (doc_id, toxic) joined to ``docs`` (doc_id, text, lang).

    Unknown labels and labels without document are left out; of an id labelled both ways, toxic counts. Cuts are made on
    all labelled rows, each judged by a model that has not learnt it: those outside the sample by the model itself, those
    of the sample by models of the other folds. The score is scaled so that the best cut over all languages is ``CUT``;
    the language sets a threshold only and never the score, and a language with fewer than ``LEAST_ROWS`` labelled rows
    of either kind has the common one. With labels of one kind in the sample, the score is that share.
    """

    def to_words(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words, first = words_of(*text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), binary_column(words, first)], names=["doc_id", "lang", "label", "words"])

    known = known_labels(labels, "toxic")
    sample, others = labelled_sample(docs, known, training_rows, training_chars)
    sample = sample.mapInArrow(to_words, "doc_id long, lang string, label int, words binary")
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["words"]))
    texts = [np.frombuffer(r["words"], np.uint64) for r in rows]
    y = np.array([r["label"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        flat = train([], np.array([0, 1]), epochs=0)
        flat.weight[:] = 0
        flat.offset = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return ToxicityModel(flat)
    turn = np.array([(r["doc_id"] * 2654435761 >> 7) % FOLDS for r in rows])
    logits = np.zeros(len(rows))
    for t in range(FOLDS):
        learnt = turn != t
        if y[learnt].any():
            part = train([x for x, k in zip(texts, learnt, strict=True) if k], y[learnt])
            logits[~learnt] = part.logits_of(*gather([x for x, k in zip(texts, learnt, strict=True) if not k]))
    cnn = train(texts, y)
    spark = docs.sparkSession
    # As bounded as the sample itself.
    inside = spark.createDataFrame([(r["lang"], int(s), r["label"]) for r, s in zip(rows, steps_of(logits), strict=True)], "lang string, step long, label int")
    judged = logit_steps(others, cnn).join(known, "doc_id").select("lang", "step", "label").unionByName(inside)
    counts = stored(judged.groupBy("lang", "step", "label").agg(F.count("*").alias("n")), "logit-histogram")
    cnn.shift = float(np.log(CUT / (1 - CUT)) - cut_of(counts.groupBy("step", "label").agg(F.sum("n").alias("n")).collect()))
    both = counts.groupBy("lang").agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)]).filter((F.col("n0") >= LEAST_ROWS) & (F.col("n1") >= LEAST_ROWS))
    by_lang: dict[str, list] = {}
    for r in counts.join(both, "lang").select("lang", "step", "label", "n").collect():
        by_lang.setdefault(r["lang"], []).append(r)
    model = ToxicityModel(cnn)
    for lang, own in sorted(by_lang.items()):
        model.thresholds[lang] = float(1 / (1 + np.exp(-(cut_of(own) + cnn.shift))))
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with columns score and toxic: how likely label 1 is for each whole text, and whether the score reaches
    the threshold of its language.

    Null and empty texts get the score of a text without words; repeated rows are scored alike; a null or new language
    has the common threshold; an empty table gives an empty result. Other columns are carried, but columns named score
    or toxic give way to the new ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.cnn)  # a fixed size
    slim = docs.drop("score", "toxic")
    names = [*slim.columns, "score"]
    at = names.index(text_col)

    def run(batches):
        cnn = shared.value
        tables = cnn.tables()
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                words, first = words_of(*text_bytes(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cnn.scores(words, first, tables))], names=names)

    scored = slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField("score", T.DoubleType())]))
    limits: Column = F.lit(CUT)
    for lang, limit in model.thresholds.items():
        limits = F.when(F.col(lang_col) == lang, F.lit(limit)).otherwise(limits)
    return scored.withColumn("toxic", F.col("score") >= limits)
