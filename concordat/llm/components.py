"""Connected components of a graph given as edges, in rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.session import materialise

MAX_ROUNDS = 60


def _towards_smaller(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node next to it (or to itself)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _fold_smaller(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are all linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node it reaches.

    Alternating contraction towards the smaller neighbour, which ends after about log(n) rounds
    in stars around the roots. Each round is written to the shared folder, so a lost executor
    costs that round only. Edges with a null end and loops are ignored; none gives no rows.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, seen = materialise(links, "links"), None
    for _ in range(MAX_ROUNDS):
        links = materialise(_fold_smaller(_towards_smaller(links).distinct()).distinct(), "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
