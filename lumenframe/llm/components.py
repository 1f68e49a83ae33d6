"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (least node of its component) of all nodes in ``links`` (``a``, ``b``).

    Each round every node points its greater neighbours, then its lesser ones, at its least
    neighbour. Only minima are taken over a node's neighbours, combined before the shuffle, and
    the joins have one row a node on one side, so a node with very many links can be split. The
    number of rounds grows with the logarithm of the size. Each round is written down, which
    bounds the lineage; only two sums come to the driver.

    Links to oneself and repeated links do no harm; null ends are dropped.
    """
    edges = staged(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Greater neighbours v of u point at the least of u's neighbourhood.
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u != v").distinct(), "links")
        # Lesser neighbours of u, and u, point at the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = staged(small.filter("u != v").distinct(), "links")
        r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (r["n"], r["h"]) == before:
            break
        before = (r["n"], r["h"])
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
