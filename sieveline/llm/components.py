"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """id and root (the smallest id of its component) of every end of a link (a, b) that is no root itself.

    Both steps hang a node's neighbours on the smallest of them and leave the components as they are, until each
    component is a star. The rows of a round are checkpointed; there are at most as many as links.
    """
    e = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # done if all components are stars: each node has one edge, and no root has one
        ends = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if not ends.where("n > 1").limit(1).count() and not e.select("v").join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("of"), F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, F.col("x") == F.col("of")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
        met = large.join(low, F.col("u") == F.col("of"))
        e = cut(met.select("u", F.col("m").alias("v")).unionByName(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
