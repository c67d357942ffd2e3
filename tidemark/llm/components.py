"""Connected components of links between keys, by alternating large and small stars.

Only (key, key) pairs travel and each round is written to the shared folder. A hub's links are rows,
not a list, so a large component is spread over tasks; its minimum is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    """``links`` point from the larger key ``u`` to the smaller ``v``."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``u, v`` links to ``key, root``: every linked key, with the smallest key it reaches."""
    pairs = cut_lineage(links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        pairs = cut_lineage(_small(_large(pairs)))
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = pairs.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("key"), F.col("v").alias("root")).union(roots)
