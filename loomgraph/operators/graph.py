"""Graph operators over (nodes, edges): neighbours, closures, cycles, edits.

Edge kinds: call, import, inherit, ref, test. Every result has a total order
key; iterative operators cut lineage in the shared folder at each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import Stored, checkpoint

# Which edges carry what.
KINDS = ("call", "import", "inherit", "test", "ref")
IMPACT_KINDS = ("call", "inherit")
CYCLE_KINDS = ("call", "import", "inherit", "ref")
STRUCTURAL_KINDS = ("call", "import", "inherit")


def resolve(nodes: DataFrame, name: str) -> DataFrame:
    """Ids of a symbol: the exact id if there is one, else all nodes of that label."""
    hits = nodes.where((F.col("id") == name) | (F.col("label") == name)).select("id", (F.col("id") == name).alias("exact"))
    return hits.crossJoin(F.broadcast(hits.agg(F.max("exact").alias("any")))).where(F.col("exact") | ~F.col("any")).select("id")


def neighbours(edges: DataFrame, ids: DataFrame, kind: str, incoming: bool = True) -> DataFrame:
    """Q1 to Q4: distinct neighbours of any of the ids over edges of one kind."""
    near, far = ("dst", "src") if incoming else ("src", "dst")
    return edges.where(F.col("kind") == kind).join(ids.select(F.col("id").alias(near)), near, "left_semi").select(F.col(far).alias("id")).distinct()


def dependents(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Q5: per target, distinct dependents by kind and in all."""
    hit = edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    pairs = hit.groupBy("dst", "src").agg(*[F.max(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]).withColumn("n_all", F.lit(True))  # once each, so that nothing is counted apart by kind
    return pairs.groupBy(F.col("dst").alias("id")).agg(*[F.count_if(F.col(c) & F.col("src").isNotNull()).alias(c) for c in (*[f"n_{k}" for k in KINDS], "n_all")])


def fan(edges: DataFrame, incoming: bool = True, kinds: tuple[str, ...] = ("call",)) -> DataFrame:
    """A1: distinct callers (or callees) of each node."""
    at, other, name = ("dst", "src", "fan_in") if incoming else ("src", "dst", "fan_out")
    return edges.where(F.col("kind").isin(*kinds)).groupBy(F.col(at).alias("id")).agg(F.countDistinct(other).alias(name))


def closure(edges: DataFrame, seeds: DataFrame, reverse: bool = True, most_rounds: int = 10_000) -> DataFrame:
    """(seed, id, distance): what each seed reaches, itself only if it lies on a cycle.

    Semi-naive: each round joins the last round's new pairs alone. All seeds go
    together, so the rounds are the graph's depth, not the number of seeds.
    """
    near, far = ("dst", "src") if reverse else ("src", "dst")
    step = checkpoint(edges.select(F.col(near).alias("_at"), F.col(far).alias("_to")).distinct())
    frontier = checkpoint(seeds.select(F.col("id").alias("seed"), F.col("id")).distinct())
    known, rounds = [], 0
    reached = None
    while rounds < most_rounds:
        rounds += 1
        new = frontier.join(step, F.col("id") == F.col("_at")).select("seed", F.col("_to").alias("id")).distinct()
        if reached is not None:
            new = new.join(reached, ["seed", "id"], "left_anti")
        new = checkpoint(new)
        if new.isEmpty():
            break
        known.append(new.withColumn("distance", F.lit(rounds)))
        reached = new if reached is None else reached.union(new)
        if len(known) % 8 == 0:
            reached = checkpoint(reached)
        frontier = new
    if not known:
        return frontier.withColumn("distance", F.lit(0)).limit(0)
    out = known[0]
    for k in known[1:]:
        out = out.union(k)
    return out


def impact(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Q6: everything that reaches any of the ids over call and inherit edges; the seeds themselves never count."""
    hit = closure(edges.where(F.col("kind").isin(*IMPACT_KINDS)), ids)
    return hit.groupBy("id").agg(F.min("distance").alias("distance")).join(ids.select("id"), "id", "left_anti")


def blast_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q8: for every id (dangling ones too) how many others its change reaches; see operators/blast.py."""
    from loomgraph.operators.blast import blast

    return blast(nodes, edges).counts()


def file_edges(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = CYCLE_KINDS) -> DataFrame:
    """Distinct edges between files, those inside a file dropped; n is the witnesses."""
    at = nodes.select("id", "file")
    e = edges.where(F.col("kind").isin(*kinds))
    both = e.join(at.toDF("src", "file_src"), "src").join(at.toDF("dst", "file_dst"), "dst").where("file_src <> file_dst")
    return both.groupBy(F.col("file_src").alias("src"), F.col("file_dst").alias("dst")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


#: Layers of nodes off all cycles that a round of strong_components trims, and steps along edges between two checkpoints.
LAYERS, STEPS = 3, 4


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that nothing leads to or that lead nowhere, LAYERS times over."""
    for _ in range(LAYERS):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return edges


def strong_components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(id, root) of every node on a cycle of two or more; root is the component's smallest id.

    Nodes without an in- or out-edge among those left are trimmed first; then
    each node learns the smallest id that reaches it and the smallest that it
    reaches. Where both are one, that is the root of its component. A component's
    nodes have both in common, so edges between nodes that differ are cut, and
    the rest goes on: each part loses the component of its smallest id at least.
    """
    # stored, not checkpointed: a checkpoint keeps the size its plan is guessed to have, a product of all joins so far, which rounds within rounds make a number of millions of digits
    left = Stored(edges.select("src", "dst").where("src <> dst").distinct(), "cyclic-edges").read()
    n = left.count()
    while n:
        left, before = Stored(_trimmed(left), "cyclic-edges").read(), n
        n = left.count()
        if n > 0.9 * before:
            break
    found = None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        ends = _least_both_ways(left)
        settled = ends.where("least_in = least_out").select("id", F.col("least_in").alias("root"))
        found = settled if found is None else found.union(settled)
        going = ends.where("least_in <> least_out")
        both = left.join(going.toDF("src", "i1", "o1"), "src").join(going.toDF("dst", "i2", "o2"), "dst")
        left = Stored(both.where("i1 = i2 AND o1 = o2").select("src", "dst"), "cyclic-edges").read()
    else:
        raise RuntimeError("components did not settle")
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("root")).limit(0)
    size = found.groupBy("root").count().where("count > 1").select("root")
    return found.join(size, "root", "left_semi").select("id", "root")


def _least_both_ways(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(id, least_in, least_out): the smallest id from which a path leads to it and the smallest to which one leads from it, itself included."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    along = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit("along").alias("way")).union(edges.select("dst", "src", F.lit("against"))).union(nodes.select("id", "id", F.lit("stay")))
    ways = checkpoint(along.repartition("id"))
    now = ways.where("way = 'stay'").select("id", F.col("id").alias("least_in"), F.col("id").alias("least_out"))
    for _ in range(most_rounds):
        for _ in range(STEPS):
            met = ways.join(now, "id").select(
                F.col("to").alias("id"), F.when(F.col("way") != "against", F.col("least_in")).alias("i"), F.when(F.col("way") != "along", F.col("least_out")).alias("o"),
                F.when(F.col("way") == "stay", F.struct("least_in", "least_out")).alias("was"),
            )
            new = met.groupBy("id").agg(F.min("i").alias("least_in"), F.min("o").alias("least_out"), F.max("was").alias("was"))
            now = new.select("id", "least_in", "least_out")
        new = checkpoint(new)
        now = new.select("id", "least_in", "least_out")
        if new.where("least_in < was.least_in OR least_out < was.least_out").isEmpty():
            return now
    raise RuntimeError(f"a way of over {most_rounds * STEPS} steps inside the graph's cycles")


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q9: (root, files, n): strongly connected groups of two or more files."""
    scc = strong_components(file_edges(nodes, edges))
    return scc.groupBy("root").agg(F.sort_array(F.collect_list("id")).alias("files"), F.count("*").alias("n"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no module, not exported, and have no call, import, inherit or ref edge in."""
    used = edges.where(F.col("kind").isin(*CYCLE_KINDS)).select(F.col("dst").alias("id")).distinct()
    return nodes.where((F.col("kind") != "module") & ~F.col("exports")).join(used, "id", "left_anti")


def apply_edit(nodes: DataFrame, edges: DataFrame, kind: str, ids: list[str], into: str | None = None, file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Q16: the graph after deleting, merging (into the smallest id unless named) or moving some nodes.

    A merge redirects edges, drops the loops this makes and leaves one edge of
    each (src, dst, kind), weights summed. The list of ids is small: it is the edit.
    """
    if kind == "delete":
        gone = F.col("id").isin(ids)
        return nodes.where(~gone), edges.where(~F.col("src").isin(ids) & ~F.col("dst").isin(ids))
    if kind == "move":
        return nodes.withColumn("file", F.when(F.col("id").isin(ids), F.lit(file)).otherwise(F.col("file"))), edges
    if kind != "merge":
        raise ValueError(f"unknown edit {kind!r}")
    into = into or min(ids)
    losers = [i for i in ids if i != into]
    to = lambda c: F.when(F.col(c).isin(losers), F.lit(into)).otherwise(F.col(c)).alias(c)
    hit = F.col("src").isin(ids) | F.col("dst").isin(ids)
    moved = edges.where(hit).select(to("src"), to("dst"), "kind", "weight", (F.col("src") == F.col("dst")).alias("loop")).where((F.col("src") != F.col("dst")) | F.col("loop"))
    merged = moved.groupBy("src", "dst", "kind").agg(F.sum("weight").cast("int").alias("weight"))
    return nodes.where(~F.col("id").isin(losers)), edges.where(~hit).select("src", "dst", "kind", "weight").union(merged)


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge of each (src, dst, kind), weights summed."""
    return edges.groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"))
