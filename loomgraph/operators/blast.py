"""How far a change of each node reaches, without a row for each pair.

Strong components are contracted, and nodes numbered so that a component's
members lie side by side. What a component is reached from is kept as bits, 64
nodes to a row, and passed on along the levels of the contracted graph: a level
takes the union of the rows of the components that lead to it. The state can be
carried over an edit: only what lies behind a changed edge is worked out anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import IMPACT_KINDS, strong_components
from loomgraph.session import Stored


def _kept(df: DataFrame) -> DataFrame:
    """Cut lineage by a stored table: unlike a checkpoint it has its true size, where a checkpoint of checkpoints keeps a product of guesses with ever more digits."""
    return Stored(df, "blast").read()


def _bit() -> Column:
    return F.expr("shiftleft(1L, CAST(number % 64 AS INT))")


def roots_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) of all nodes: the smallest id of their strong component, their own where they are on no cycle."""
    return nodes.join(strong_components(edges), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def levels(roots: DataFrame, edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(root, level): of contracted edges (src, dst) the longest way that leads to each component. Rounds are the deepest level; a bound that is passed raises."""
    now = _kept(roots.select("root").distinct().withColumn("level", F.lit(0)))
    moved = now
    for _ in range(most_rounds):
        offer = edges.join(moved.select(F.col("root").alias("src"), "level"), "src").groupBy(F.col("dst").alias("root")).agg((F.max("level") + 1).alias("to"))
        new = _kept(now.join(offer, "root", "left").select("root", F.greatest("level", F.coalesce("to", "level")).alias("level"), F.coalesce(F.col("to") > F.col("level"), F.lit(False)).alias("up")))
        moved = new.where("up").select("root", "level")
        if moved.isEmpty():
            return new.select("root", "level")
        now = new.select("root", "level")
    raise RuntimeError(f"levels deeper than {most_rounds}: edges are not contracted")


@dataclass
class Blast:
    """members (id, root, number) and rows (root, word, mask): the nodes of each component and of all that lead to it, 64 numbers to a mask."""

    members: DataFrame
    rows: DataFrame

    def counts(self) -> DataFrame:
        """(id, blast): how many others lead to each node, directly or not: what its change reaches."""
        n = self.rows.groupBy("root").agg(F.sum(F.bit_count("mask")).alias("n"))
        return self.members.join(n, "root").select("id", (F.col("n") - 1).alias("blast"))


def _passed(members: DataFrame, inner: DataFrame, outer: DataFrame | None) -> DataFrame:
    """Rows of the components of `members`, level by level. inner: contracted edges between them; outer: rows (root, word, mask) that enter from elsewhere."""
    own = members.groupBy("root", F.shiftright("number", 6).alias("word")).agg(F.bit_or(_bit()).alias("mask"))
    start = own if outer is None else own.unionByName(outer)
    at = _kept(levels(members, inner))
    start = _kept(start.groupBy("root", "word").agg(F.bit_or("mask").alias("mask")).join(at, "root"))
    edges = _kept(inner.join(at.select(F.col("root").alias("dst"), "level"), "dst"))
    top = at.agg(F.max("level")).first()[0] or 0
    done = start.where("level = 0").select("root", "word", "mask")
    for k in range(1, top + 1):
        # of a component's predecessors only those of an edge into this level are read
        into = edges.where(F.col("level") == k).select(F.col("src").alias("root"), "dst")
        met = done.join(into, "root").select(F.col("dst").alias("root"), "word", "mask").unionByName(start.where(F.col("level") == k).select("root", "word", "mask"))
        new = _kept(met.groupBy("root", "word").agg(F.bit_or("mask").alias("mask")))
        done = done.unionByName(new)
        if k % 16 == 0:
            done = _kept(done)
    return done


def _contracted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    r = roots.select("id", "root")
    both = edges.join(r.toDF("src", "a"), "src").join(r.toDF("dst", "b"), "dst").where("a <> b")
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def blast(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = IMPACT_KINDS) -> Blast:
    """The state for all nodes (id) and the ends of edges, over edges of some kinds; kind may be absent. Loops and repeated edges count once, null ids are dropped."""
    e = edges.where(F.col("kind").isin(*kinds)) if "kind" in edges.columns else edges
    e = _kept(e.select("src", "dst").where("src <> dst").distinct())
    every = nodes.select("id").union(edges.select("src")).union(edges.select("dst")).where("id IS NOT NULL").distinct()
    roots = _kept(roots_of(every, e))
    # numbers ascend within the sorted parts, so a component's members, and what is near it, share rows
    number = Stored(roots.repartitionByRange("root", "id").sortWithinPartitions("root", "id"), "blast-order").read()
    members = _kept(number.withColumn("number", F.monotonically_increasing_id()))
    return Blast(members, _kept(_passed(members, _contracted(e, members), None)))


def _behind(edges: DataFrame, starts: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(id) of the starts and all that they lead to: the starts together, without a row for each start and what it reaches."""
    edges = _kept(edges)
    got = frontier = _kept(starts)
    for k in range(1, most_rounds + 1):
        frontier = _kept(edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(got, "id", "left_anti"))
        if frontier.isEmpty():
            return _kept(got)
        got = got.union(frontier)
        if k % 8 == 0:
            got = _kept(got)
    raise RuntimeError(f"a way of over {most_rounds} steps")


def carried(state: Blast, nodes: DataFrame, before: DataFrame, after: DataFrame, kinds: tuple[str, ...] = IMPACT_KINDS) -> Blast:
    """The state after an edit from edges `before` to `after`, equal to blast(nodes, after).

    Only nodes that a changed edge leads to, before or after, are worked out
    anew; the rest keep their rows, which is right since nothing that leads to
    them has changed. Nodes that are gone keep their numbers and leave no bit.
    """
    of = lambda e: (e.where(F.col("kind").isin(*kinds)) if "kind" in e.columns else e).select("src", "dst").where("src <> dst").distinct()
    old, new = _kept(of(before)), _kept(of(after))
    changed = old.exceptAll(new).union(new.exceptAll(old))
    every = nodes.select("id").union(after.select("src")).union(after.select("dst")).where("id IS NOT NULL").distinct()
    known = state.members.select("id")
    starts = changed.select(F.col("dst").alias("id")).union(known.join(every, "id", "left_anti")).union(every.join(known, "id", "left_anti")).distinct()
    hit = _behind(old.union(new).distinct(), starts)
    most = state.members.agg(F.max("number")).first()[0]
    fresh = every.join(known, "id", "left_anti").repartitionByRange("id").sortWithinPartitions("id")
    fresh = _kept(fresh.withColumn("number", F.monotonically_increasing_id() + F.lit((most if most is not None else -1) + 1)))
    inside = _kept(new.join(hit.toDF("src"), "src", "left_semi").join(hit.toDF("dst"), "dst", "left_semi"))
    again = every.join(hit, "id", "left_semi")
    numbers = state.members.select("id", "number").union(fresh.select("id", "number"))
    members = _kept(roots_of(again, inside).join(numbers, "id"))
    kept = state.members.join(hit, "id", "left_anti")
    enters = new.join(hit.toDF("src"), "src", "left_anti").join(kept.select(F.col("id").alias("src"), F.col("root").alias("from")), "src").join(members.select(F.col("id").alias("dst"), F.col("root").alias("to")), "dst").select("from", "to").distinct()
    outer = state.rows.join(enters, F.col("root") == F.col("from")).select(F.col("to").alias("root"), "word", "mask")
    rows = _passed(members, _contracted(inside, members), outer)
    still = state.rows.join(kept.select("root").distinct(), "root", "left_semi")
    return Blast(_kept(kept.select("id", "root", "number").union(members.select("id", "root", "number"))), _kept(still.unionByName(rows)))
