"""Connected components of a graph that is held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentrail.llm.shared import checkpoint


def _stars(both: DataFrame, large: bool) -> DataFrame:
    """One step: each node ties its larger (or its smaller) neighbours, and itself, to its least neighbour.

    The least neighbour is found by a combining aggregation and joined back, so a node with very many
    neighbours is split by the adaptive skew join and never gathered into one row.
    """
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m").select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; the root is the least node reachable.

    Alternating large and small stars halve the depth of every tree each round, so a chain of n nodes
    takes about log n rounds. Each round is materialised in the shared folder, and the end is found
    by comparing an order-free digest of the edges, never the edges themselves. Null ends are ignored.
    """
    now = checkpoint(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    digest = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    last = digest(now)
    while last[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = checkpoint(_stars(_mirror_small(_stars(both, True)), False))
        if (new := digest(now)) == last:
            break
        last = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _mirror_small(edges: DataFrame) -> DataFrame:
    """Edges as seen from their larger end."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
