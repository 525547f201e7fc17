"""Connected components of an edge table by alternating star contractions.

Each round links every node to the smallest node it knows (large star), then every node's
smaller neighbours to the smallest of them (small star). All state is one table of edges,
checkpointed once a round; it never exceeds the input's edges plus one for each node, and the
number of rounds grows with the logarithm of the nodes. Nothing but a count and a checksum
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.session import cut_lineage


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v) with u > v, distinct."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("m", F.least("u", "w")).select("u", "m")
    large = (both.join(least, "u").filter(F.col("v") > F.col("u"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct())
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(least, "u")
    return (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct())


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node reachable.

    Direction, repeats and self links don't matter; null ends are no nodes; no edges give an
    empty result.
    """
    edges = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        edges = cut_lineage(_star(edges))
        was, mark = mark, _mark(edges)
        if was == mark:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
