"""Removal of lines that many sites share.

Each line's hash gets a HyperLogLog sketch of its sites; sketches merge by aggregation, so a line on every page of the
web costs a sketch per task. Lines whose estimate is clearly over the threshold are boilerplate, those clearly under it
are not; lines near it get an exact distinct count of sites. The first occurrence of a boilerplate line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casagrid.llm.shared import stored

SKETCH_BITS = 10
#: Three standard errors of a sketch with 2^SKETCH_BITS cells.
MARGIN = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def line_hashes(text: Column) -> Column:
    """A hash for each line without its outer spaces; 0 for a blank line."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.when(F.trim(line) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(F.trim(line))))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line, first) of lines (line, site, id, version, pos) on ``min_sites`` sites or more; ``first``: where it stays."""
    spread = stored(
        lines.groupBy("line")
        .agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"), F.min(F.struct("id", "version", "pos")).alias("first"), F.count("*").alias("n"))
        .filter(F.col("n") >= min_sites)
        .select("line", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= min_sites * (1 - MARGIN)),
        "line-spread",
    )
    near = spread.filter(F.col("sites") <= min_sites * (1 + MARGIN))
    exact = lines.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("exact")).filter(F.col("exact") >= min_sites)
    clear = spread.filter(F.col("sites") > min_sites * (1 + MARGIN)).select("line", "first")
    return clear.unionByName(near.join(exact, "line").select("line", "first"))


def dedup_lines(docs: DataFrame, min_sites: int, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, and columns n_lines, n_removed.

    A null site counts as one site of its own. Blank lines never count and always stay. Null and empty texts stay as
    they are, with no lines. Rows with the same id and text lose and keep the same lines. An empty table gives an empty
    result; other columns are carried, but a column named like a result column gives way to it.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # Carried columns stay together, so that their names cannot meet those in use here.
    keyed = docs.select(F.struct(*rest).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("text"))
    site = F.coalesce(F.concat(F.lit("="), F.col("site")), F.lit(""))
    hashed = keyed.filter("text != ''").select("id", "version", site.alias("site"), F.posexplode(line_hashes(F.col("text"))).alias("pos", "line"))
    lines = stored(hashed.filter("line != 0"), "lines")
    common = stored(boilerplate(lines, min_sites), "boilerplate")
    hits = lines.join(common, "line").filter(F.expr("struct(id, version, pos) != first"))
    drops = hits.groupBy(F.col("id").alias("of"), F.col("version").alias("of_version")).agg(F.collect_set("pos").alias("drop"))
    found = keyed.select("row", "id", "version").join(drops, F.col("id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("of_version")), "left")
    parts = F.split(F.col(f"row.{text_col}"), "\n", -1)
    left = F.concat_ws("\n", F.filter(parts, lambda line, i: ~F.array_contains(F.col("drop"), i)))
    text = F.when(F.col("drop").isNull(), F.col(f"row.{text_col}")).otherwise(left)
    n_lines = F.when(F.coalesce(F.col(f"row.{text_col}"), F.lit("")) == "", 0).otherwise(F.size(parts)).cast("long")
    columns = [(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in rest]
    return found.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"))
