"""Connected components of links by label spreading and shortcuts, with the state in shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casagrid.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b); the component is the smallest id in it.

    A round gives each id the least label among its own and its neighbours', and then the label of that label, so the
    length of a path shrinks by a factor each round. It ends when no label changes. A hub's links are combined before
    the shuffle.
    """
    ways = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b"), "ways")
    labels = stored(ways.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")), "labels")
    while True:
        heard = ways.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        spread = labels.join(heard, "id", "left").select("id", "component", F.least("component", "heard").alias("now"))
        spread = stored(spread, "spread")
        target = spread.select(F.col("id").alias("now"), F.col("now").alias("next"))
        after = stored(spread.join(target, "now", "left").select("id", F.col("component").alias("old"), F.least("now", "next").alias("component")), "labels")
        labels = after.select("id", "component")
        if after.filter("old != component").isEmpty():
            return labels
