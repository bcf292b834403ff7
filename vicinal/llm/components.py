"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.session import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node that has a link.

    ``links`` has columns a and b. In each round, every node hangs its larger neighbours below its smallest one (large
    star), then its smaller ones (small star); paths at least halve, so the rounds grow with the logarithm of the longest
    path, and links never multiply. A node's neighbours are never gathered: all steps are minima, which are taken before
    the shuffle. Each round is written to the shared folder, and only whether it has changed anything comes to the driver.
    Minima are written before links are joined with them, so that the join is a plain one, in which adaptive execution splits
    the links of a node that has very many.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.max("moved").alias("moved")), "lowest")
        others = large.join(lowest.select("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
        edges = stored(others.unionByName(lowest.select("u", F.col("m").alias("v"), "moved")), "links")
        if not edges.agg(F.max("moved")).first()[0]:
            break
        edges = edges.drop("moved")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
