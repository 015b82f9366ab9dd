"""Other spellings of addresses from a table of rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casagrid.functions.address import FLAGS, normalize_street_number
from casagrid.functions.street_rules import STREET_RULES
from casagrid.functions.text import fold_literal, fold_text, squeeze

RULES = "rule_no int, pattern string, replacement string, stem string"


def stem_of(pattern: str) -> str:
    """The longest letters with which, in every match of ``pattern``, some word of the folded text begins.

    Parts that may be absent, and what follows an alternative without a space between, are left out.
    """
    text = re.sub(r"\(\?<?[!=][^)]*\)", "", fold_literal(pattern))
    text = re.sub(r"\(\?:(\w)\|\1\)", r"\1", text)
    while (shorter := re.sub(r"\((?:\?:)?[^()]*\)[?*]", "", text)) != text:
        text = shorter
    while (shorter := re.sub(r"\((?:\?:)?[^()]*\)", "\0", text)) != text:
        text = shorter
    words = [re.match(r"[a-z]*", re.sub(r"[a-z][?*].*", "", w)).group() for w in re.split(r"\\s[+*]?|\\b| ", text)]
    if not (best := max(words, key=len)):
        raise ValueError(f"no word of a match is known: {pattern}")
    return best


def street_rules(spark: SparkSession) -> DataFrame:
    """The fixed rules as a table; an own table of the same columns may take its place."""
    return spark.createDataFrame([(i, p, r, stem_of(p)) for i, (p, r) in enumerate(STREET_RULES)], RULES)


def alias_variants(df: DataFrame, rules: DataFrame, text: str) -> DataFrame:
    """``df`` with ``base``, the cleaned address, and ``variants``: its other spellings in the order of the rules, without
    repeats, itself and empty ones.

    Each distinct address is worked once. Its words meet the rules by an equi join on the letters with which they begin,
    so only rules that can match are tried, however many there are.
    """
    keyed = df.withColumn("base", normalize_street_number(text))
    bases = keyed.select("base").filter(F.coalesce("base", F.lit("")) != "").distinct()
    sizes = rules.agg(F.array_sort(F.collect_set(F.length("stem")))).scalar()
    words = bases.select("base", F.explode(F.array_distinct(F.split(fold_text("base"), "[^a-z0-9]+"))).alias("word")).withColumn("size", F.explode(sizes))
    heads = words.filter(F.length("word") >= F.col("size")).select("base", F.left("word", F.col("size")).alias("stem")).distinct()
    tried = heads.join(rules, "stem").select("base", "rule_no", squeeze(F.regexp_replace("base", F.concat(F.lit(FLAGS), "pattern"), F.col("replacement"))).alias("variant"))
    found = tried.filter((F.col("variant") != F.col("base")) & (F.col("variant") != "")).groupBy("base").agg(F.array_sort(F.collect_set(F.struct("rule_no", "variant"))).alias("_v"))
    spelled = found.select("base", F.array_distinct(F.transform("_v", lambda v: v["variant"])).alias("variants"))
    return keyed.join(spelled, "base", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<string>")))
