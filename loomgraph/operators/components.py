"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Stored, checkpoint


def _star(edges: DataFrame, large: bool, used: list[Stored]) -> DataFrame:
    """Half a round. Each node's smallest neighbour (itself included) takes its larger (large) or its other smaller (small) neighbours."""
    if large:
        pairs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    used.append(Stored(pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "star-minima"))
    least = used[-1].read()  # read again, so that the join has exchanges of its own, which AQE can split at a node with many neighbours
    near = pairs.join(least, "a")
    if large:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge list (a, b); root is the component's smallest node.

    Nodes that compare with < : numbers or strings. Loops give a row of their
    own; nulls are dropped. Rounds grow with the logarithm of the component's
    size; each ends in a checkpoint in the shared folder, so a lost executor
    costs one round at most. A node with many neighbours is no group anywhere:
    minima are pre-aggregated and stored, so that AQE can split the joins.
    """
    edges = edges.select(edges.columns[:2]).toDF("a", "b").where("a is not null and b is not null")
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        used: list[Stored] = []
        now = checkpoint(_star(_star(now, True, used), False, used))
        for x in used:
            x.drop()
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    alone = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return roots.union(alone)
