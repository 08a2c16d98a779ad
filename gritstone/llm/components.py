"""Connected components of a link table, by joins and grouped minima alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.runtime import materialize

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether every node with an edge to a smaller one has no other edge, which is when no step changes anything."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("end"))
    nodes = ends.groupBy("end.node").agg(F.sum("end.up").alias("up"), F.count("*").alias("edges"))
    return nodes.where("up > 0 and edges > 1").agg(F.count("*")).first()[0] == 0


def _hook(pairs: DataFrame, both_ways: bool) -> DataFrame:
    """Link the partners of every node to the least of them and the node itself.

    ``both_ways`` takes all partners and moves the larger ones (large star); otherwise only smaller partners count
    and the node itself moves too (small star).
    """
    if both_ways:
        near = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if both_ways:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node that has a link to another; ``links`` has two columns of one type.

    Large-star and small-star steps alternate until nothing would change, which takes a logarithmic number of rounds. Every
    round is written to the shared folder, so lineage stays short. Hubs are pre-aggregated for the minimum, and the
    join that follows can be split by adaptive skew handling.
    """
    a, b = links.columns
    edges = materialize(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    for _ in range(MAX_ROUNDS):
        edges = materialize(_hook(_hook(edges, True), False))
        if _settled(edges):
            break
    else:
        raise RuntimeError("components did not settle")
    # Now every edge points from a node to the least node of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
