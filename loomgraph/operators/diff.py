"""Comparing two snapshots of a graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import cycles, fan, file_edges, orphans
from loomgraph.session import Stored, spread


def changes(before: DataFrame, after: DataFrame, keys: list[str], rows: int = 0) -> DataFrame:
    """Keys only before (removed) or only after (added), by one grouping of both; nulls equal each other. rows: about how many both have, by which they are dealt to tasks."""
    both = before.select(*keys, F.lit(1).alias("side")).union(after.select(*keys, F.lit(2).alias("side")))
    sides = spread(both, rows, *keys).groupBy(*keys).agg(F.bit_or("side").alias("side")).where("side < 3")
    return sides.select(*keys, F.when(F.col("side") == 2, "added").otherwise("removed").alias("change"))


def lost_callers(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Q13: nodes of both snapshots that had callers and have none now."""
    calls = lambda g: g[1].where("kind = 'call'")
    sides = calls(before).select("dst", F.lit(1).alias("side")).union(calls(after).select("dst", F.lit(2).alias("side")))
    lost = sides.groupBy(F.col("dst").alias("id")).agg(F.bit_or("side").alias("side")).where("side = 1").select("id")  # found without sources, so that only edges to these are counted by source
    for g in (before, after):
        lost = lost.join(g[0].select("id"), "id", "left_semi")
    lost = Stored(lost.distinct(), "lost-callers").read()  # known to be few where they are, so that the edges need not move
    return fan(before[1].join(lost.withColumnRenamed("id", "dst"), "dst", "left_semi")).withColumnRenamed("fan_in", "was")


def new_cycles(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Q13: cycles (by their files) that were not there before."""
    return cycles(*after).join(cycles(*before).select("files"), "files", "left_anti")


def gate(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], orphan_gate: bool = True) -> DataFrame:
    """Q14: one row: the verdict and what it rests on.

    orphan_gate: nodes that became orphans block (exported ones are no orphans).
    Without it, nodes that lost their last caller block.
    """
    n_cycles = new_cycles(before, after).agg(F.count("*").alias("new_cycles"))
    lost = lost_callers(before, after).agg(F.count("*").alias("lost_callers"))
    was = before[0].select("id")
    fresh = orphans(*after).select("id").join(orphans(*before).select("id"), "id", "left_anti").join(was, "id", "left_semi").agg(F.count("*").alias("new_orphans"))
    row = n_cycles.crossJoin(lost).crossJoin(fresh)
    bad = F.col("new_orphans") if orphan_gate else F.col("lost_callers")
    return row.withColumn("ok", (F.col("new_cycles") == 0) & (bad == 0))


def renames(removed: DataFrame, added: DataFrame, at_least: float = 0.85) -> DataFrame:
    """Greedy 1:1 pairs of removed and added (id, kind, file, label, shingles).

    Candidates share the kind and the file or the label; the best similarity
    wins, removed ids in order, each added id once. The greedy pass is
    sequential by definition; it gets the candidates at or above the limit of
    one kind at a time, so its input is what one change removes and adds.
    """
    r = removed.select(F.col("id").alias("rid"), "kind", F.col("file").alias("rf"), F.col("label").alias("rl"), F.col("shingles").alias("rs"))
    a = added.select(F.col("id").alias("aid"), "kind", F.col("file").alias("af"), F.col("label").alias("al"), F.col("shingles").alias("as_"))
    by_file = r.join(a, (r.kind == a.kind) & (F.col("rf") == F.col("af"))).drop(a.kind)
    by_label = r.join(a, (r.kind == a.kind) & (F.col("rl") == F.col("al"))).drop(a.kind)
    union = F.size(F.array_union("rs", "as_"))
    sim = F.when((F.size("rs") > 0) & (F.size("as_") > 0), F.size(F.array_intersect("rs", "as_")) / union).otherwise(0.0)
    cand = by_file.union(by_label).select("kind", "rid", "aid", sim.alias("sim")).distinct().where(F.col("sim") >= at_least)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for rid, part in pdf.sort_values(["rid", "sim", "aid"], ascending=[True, False, True]).groupby("rid", sort=True):
            for row in part.itertuples():
                if row.aid not in used:
                    used.add(row.aid)
                    out.append((rid, row.aid, row.sim))
                    break
        return pd.DataFrame(out, columns=["removed_id", "added_id", "sim"])

    return cand.groupBy("kind").applyInPandas(greedy, "removed_id string, added_id string, sim double")


def metrics(nodes: DataFrame, edges: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Q33, A5: symbols, files and coupling (tests left out) of each snapshot; both tables carry its column."""
    size = nodes.groupBy(snapshot).agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"))
    dom = nodes.select(snapshot, "id", "domain")
    both = edges.where("kind <> 'test'").join(dom.toDF(snapshot, "src", "d1"), [snapshot, "src"]).join(dom.toDF(snapshot, "dst", "d2"), [snapshot, "dst"])
    cross = both.where("d1 <> d2").groupBy(snapshot).agg(F.sum("weight").alias("coupling"))
    return size.join(cross, snapshot, "left").withColumn("coupling", F.coalesce("coupling", F.lit(0)))


def trend(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Each value with its change since the last row and since the first. One row a snapshot, so one window."""
    w = Window.orderBy(order)
    return rows.select(order, value, (F.col(value) - F.lag(value).over(w)).alias("since_last"), (F.col(value) - F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("since_first"))


def witnesses(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q15: the file-pair table a merge simulation works on."""
    return file_edges(nodes, edges)
