"""Connected components by alternating stars, with the edges written to the shared checkpoint folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import cut


def components(edges: DataFrame, vertices: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, node, root): the smallest node of each node's component; edges are (key, a, b), vertices (key, node).

    In a round every node's larger neighbours, then its smaller ones, are moved to the smallest node it knows;
    the distance to the root at least halves, so rounds grow with the logarithm of the longest path. No task
    holds a component: neighbourhoods are only aggregated and joined.
    """
    e = cut(edges.select(key, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while not e.isEmpty():
        both = e.unionByName(e.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(key, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(key, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.unionByName(low.select(key, "u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.groupBy(key, F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return vertices.join(roots, [key, "node"], "left").select(key, "node", F.coalesce("root", "node").alias("root"))
