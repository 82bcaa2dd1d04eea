"""Connected components of a distributed link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, spread_join, stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` for every node of ``links``; the root is the least node
    that is reachable, and roots are listed with themselves. An empty link table
    gives no rows; links of a node with itself and repeated links do no harm.

    Each round lets every node hang its larger neighbours, then its smaller ones,
    onto the least neighbour it knows. Both steps are a minimum by node (combined
    before the shuffle) and an equi-join back that spreads the links of a hub, so a node
    with very many links is never gathered into one row or task. The rounds grow with the logarithm of the longest
    path; the link table is written after each, which cuts the lineage.
    """
    spark = links.sparkSession

    def tidy(e: DataFrame) -> DataFrame:
        e = e.filter(F.col("u") != F.col("v"))
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stored(tidy(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    before, same = None, state(now)
    while same[0] and same != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        large = stored(tidy(spread_join(both.filter("v > u"), least, ["u"], "n", same[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, ["u"], "n", same[0])
        after = stored(tidy(small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))), "links")
        dropped(spark, now)
        dropped(spark, large)
        now, before, same = after, same, state(after)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
