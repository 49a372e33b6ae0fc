"""Connected components of a table of links, as DataFrame operations.

Alternating large and small stars: every round is joins and grouped minima, which Spark
combines before it shuffles, so a node with very many links is not one task's burden.
Each round is written to the shared folder; nothing but two numbers comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import forget, store


def _lows(sym: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours; stored, so that Spark can split a node with very many links in the join."""
    return store(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lows")


def _star(sym: DataFrame, low: DataFrame, large: bool) -> DataFrame:
    """New links (u > v) after one star step over links (u, v) of both directions or u > v only."""
    joined = sym.join(low, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (u, v); root is the smallest node that can be reached."""
    now = store(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = _lows(both)
        big = store(_star(both, first, True), "links")
        second = _lows(big)
        done = (now, first, big, second)
        now = store(_star(big, second, False), "links")
        forget(*done)
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
