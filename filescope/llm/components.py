"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescope.llm.common import discard, materialize


def _star(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each (u, v) with m, the least of u and all its v; and each u with its m. `pairs` is read twice."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # Written, so that the join's sides are two exchanges: Spark can then split the tasks of a node with very many links.
    least = materialize(least)
    return pairs.join(least, "u"), least


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the least node that can be reached.

    Links to oneself and repeats do no harm; nulls take no part. Each round is written to the shared folder. The rounds
    grow with the logarithm of the longest chain, and no round gathers a node's links in one row.
    """
    stars = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        count = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if before == count:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = count
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        linked, first = _star(both)
        large = materialize(linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        linked, least = _star(large)
        small = linked.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small)
        discard(stars, first, large, least)
        stars = after
