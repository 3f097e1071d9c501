"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import kept_table


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node that it
    reaches.  Each round hangs all larger neighbours of a node on its smallest one, then
    the smaller ones; what is left are stars.  Rounds are few (logarithmic in practice),
    each is written to the shared folder.  Nodes that only link to themselves, and
    null ends, are not part of the result."""
    edges = kept_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) \
                        .union(edges.select("b", "b").distinct())
        seen = tuple(state)
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")) \
                     .union(low.select("a", F.col("low").alias("b"))).distinct()
        edges = kept_table(small, "links")
