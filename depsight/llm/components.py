"""Connected components of a table of links, by alternating large and small stars.

Each round links every node's neighbours to the smallest node among them; rounds end when no link changes, after a logarithmic number of them.
Nothing is gathered by node: a node's smallest neighbour is a pre-summed minimum, joined back to its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsight.llm.shared import table


def sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1)), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; links lead from the larger node u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of (a, b) links; links of a node to itself and null ends are left out."""
    edges = table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = sign(edges)
    while before[0]:
        edges = table(small_star(large_star(edges)), "links")
        now = sign(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
