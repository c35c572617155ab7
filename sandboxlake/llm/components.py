"""Connected components of a set of links, with nothing gathered per node and nothing on the driver but two sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandboxlake.session import settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's larger (or its smaller) neighbours are linked to its smallest neighbour instead.

    The minimum is taken with a map-side step, and the join keeps the edges on a side that can be split,
    so that a node with very many links is no single task.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter(F.col("b") < F.col("a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = both.join(least, "a")
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)


def _signature(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another one; the root is the smallest node of its component.

    Large-star and small-star steps alternate until the links are stars around the roots; each pair of
    steps is written to the shared folder, which cuts the lineage.  The links may be repeated, in either
    direction or loops; no links give an empty result.
    """
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = settle(pairs.filter(F.col("a") != F.col("b")).distinct())
    seen = _signature(edges)
    while seen[0]:
        edges = settle(_stars(_stars(edges, large=True).distinct(), large=False).distinct())
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
