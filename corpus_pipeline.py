"""Corpus pipeline: toxicity, line dedup, near dedup, mixing, packing.

Each stage takes all that the stage before it kept, is written as Parquet to the shared folder and read again. All but
the last return the columns of ``documents``. ``python corpus_pipeline.py FOLDER`` prints the rows of each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casagrid.llm import line_dedup, mixing, near_dedup, packing, toxicity
from casagrid.llm.queries import MIN_SITES, held_out, tokenizer_path
from casagrid.llm.shared import stored

#: The stages train a classifier and link by hashes; tests hold them against brute-force versions instead.
ORACLE_SQL = None
END_ID, CAPACITY = 2, 1024


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and those names by the old ones."""
    names = [f"c{i}_" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold of their language; texts null or empty stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    plain, name = numbered(docs)
    scored = toxicity.score(plain, toxicity.fit(docs, labels), name["text"], name["lang"])
    return scored.filter(~F.col("toxic")).select(*plain.columns).toDF(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of twelve sources or more, but for each line's first occurrence; a document goes if
    nothing but white space is left of a text that had such lines."""
    plain, name = numbered(docs)
    cleaned = line_dedup.dedup_lines(plain, MIN_SITES, name["doc_id"], name["source"], name["text"])
    changed = F.col("n_removed") > 0
    left = cleaned.filter(~changed | F.col(name["text"]).rlike(mixing.WORD))
    size = F.when(changed, F.length(name["text"]).cast("long")).otherwise(F.col(name["n_chars"]))
    return left.withColumn(name["n_chars"], size).select(*plain.columns).toDF(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose sets of five-word shingles overlap by 80 % or more; rows
    with a null id all stay."""
    kept = near_dedup.near_duplicates(docs, percent=80, shingle=5).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of 150 % of all words, sources weighing 3, 1, 2: a row for each time that a document is taken, and for
    the last of a source the words that its budget still holds. Documents without words are not part of a mix."""
    plain, name = numbered(docs)
    text, size = F.col(name["text"]), F.col(name["n_chars"])
    keyed = plain.withColumn("version", F.xxhash64(text))
    slim = keyed.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["source"]).alias("source"), text.alias("text"), "version")
    mixed = mixing.mix(slim, mixing.word_count(F.col("text")), extra=("version",)).filter("taken > 0")
    taken = mixed.groupBy("doc_id", F.col("version").alias("of")).agg(F.max("size").alias("size"), F.max("taken").alias("taken"))
    found = keyed.join(taken, F.col(name["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.col("version") == F.col("of")))
    each = found.withColumn("words", F.explode(F.expr("transform(sequence(1, ceil(taken / size)), i -> least(size, taken - (i - 1) * size))")))
    whole = F.col("words") == F.col("size")
    spaces = r"[\x20\x09-\x0D]+"
    front = F.array_join(F.slice(F.split(F.regexp_replace(text, "^" + spaces, ""), spaces), F.lit(1), F.col("words").cast("int")), " ")
    cut = each.withColumn(name["text"], F.when(whole, text).otherwise(front))
    return cut.withColumn(name["n_chars"], F.when(whole, size).otherwise(F.length(name["text"]).cast("long"))).select(*plain.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with the sequence and the place in it."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), END_ID, CAPACITY)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.getOrCreate()
    rows = session.read.parquet(f"{sys.argv[1]}/documents.parquet")
    for title, step in STAGES:
        rows = stored(step(session, rows, sys.argv[1]), f"pipeline-{title}")
        print(title, rows.count())
