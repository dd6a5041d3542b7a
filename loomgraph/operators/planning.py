"""Sequential planners: each choice depends on the ones before.

They work on what the queries before them left: duplicate groups, file pairs,
the symbols of one scope. That input is bounded by `most` and checked; beyond
it they refuse instead of pulling a large graph to the driver.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import CYCLE_KINDS, STRUCTURAL_KINDS, file_edges, strong_components
from loomgraph.session import Stored

#: Rows that a planner takes to the driver.
MOST = 200_000


def rows_of(df: DataFrame, most: int = MOST) -> list:
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a sequential planner takes at most {most} rows; narrow its scope")
    return got


def components_of(pairs: set[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected groups of two or more, members and groups sorted (iterative, by two depth-first passes)."""
    out_, in_ = {}, {}
    for a, b in pairs:
        if a != b:
            out_.setdefault(a, set()).add(b)
            in_.setdefault(b, set()).add(a)
    seen, order = set(), []
    for s in sorted(out_):
        if s in seen:
            continue
        seen.add(s)
        stack = [(s, iter(sorted(out_.get(s, ()))))]
        while stack:
            node, it = stack[-1]
            for n in it:
                if n not in seen:
                    seen.add(n)
                    stack.append((n, iter(sorted(out_.get(n, ())))))
                    break
            else:
                order.append(node)
                stack.pop()
    done, groups = set(), []
    for s in reversed(order):
        if s in done:
            continue
        group, todo = [], [s]
        done.add(s)
        while todo:
            x = todo.pop()
            group.append(x)
            for y in in_.get(x, ()):
                if y not in done:
                    done.add(y)
                    todo.append(y)
        if len(group) > 1:
            groups.append(sorted(group))
    return sorted(groups)


def cheapest_cuts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q11: for each file cycle, the first structural file pair (by weight, from, to) whose removal dissolves it.

    A pair with a witness of another kind stays after the cut, so it does not
    break the cycle; then verified is false. One group per cycle, not one graph.
    """
    all_pairs = file_edges(nodes, edges)
    hard = file_edges(nodes, edges, STRUCTURAL_KINDS).select("src", "dst", F.col("n").alias("hard"), F.col("weight").alias("hard_weight"))
    scc = strong_components(all_pairs)
    inside = all_pairs.join(scc.toDF("src", "root"), "src").join(scc.toDF("dst", "root2"), "dst").where("root = root2").join(hard, ["src", "dst"], "left")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = set(zip(pdf.src, pdf.dst, strict=True))
        files = sorted({x for p in pairs for x in p})
        trial = pdf[pdf.hard.notna()].sort_values(["hard_weight", "src", "dst"])
        for r in trial.itertuples():
            if r.hard == r.n and files not in components_of(pairs - {(r.src, r.dst)}):
                return pd.DataFrame([(files[0], len(files), r.src, r.dst, int(r.hard_weight), True)], columns=cols)
        return pd.DataFrame([(files[0], len(files), None, None, None, False)], columns=cols)

    cols = ["root", "n", "cut_src", "cut_dst", "weight", "verified"]
    return inside.groupBy("root").applyInPandas(cut, "root string, n long, cut_src string, cut_dst string, weight long, verified boolean")


class MergeSimulator:
    """Q15: file pairs with their witnesses; merges and deletes are tried or committed without copying the graph."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, most: int = MOST):
        self.file = {r.id: r.file for r in rows_of(nodes.select("id", "file"), most)}
        kept = edges.where(F.col("kind").isin(*CYCLE_KINDS)).groupBy("src", "dst").agg(F.count("*").alias("n"))
        self.links: dict[tuple[str, str], int] = {(r.src, r.dst): r.n for r in rows_of(kept, most)}
        self.alias: dict[str, str] = {}
        self.gone: set[str] = set()
        self.of: dict[str, set[tuple[str, str]]] = {}
        for link in self.links:
            for x in link:
                self.of.setdefault(x, set()).add(link)
        self.pairs: dict[tuple[str, str], int] = {}
        for link, n in self.links.items():
            self._add(self.pairs, link, n, {})

    def root(self, x: str, more: dict[str, str] = {}) -> str:
        while (y := more.get(x) or self.alias.get(x)) is not None:
            x = y
        return x

    def _add(self, table: dict, link: tuple[str, str], n: int, more: dict[str, str]) -> None:
        a, b = (self.file.get(self.root(x, more)) for x in link)
        if a is not None and b is not None and a != b:
            table[(a, b)] = table.get((a, b), 0) + n

    def _members(self, x: str) -> set[str]:
        r = self.root(x)
        return {r, *[y for y in self.alias if self.root(y) == r]}

    def _after(self, ids: list[str], into: str) -> dict[tuple[str, str], int]:
        more = {self.root(i): self.root(into) for i in ids if self.root(i) != self.root(into)}
        touched = {link for i in more for m in self._members(i) for link in self.of.get(m, ()) if not (set(link) & self.gone)}
        table = dict(self.pairs)
        for link in touched:
            self._add(table, link, -self.links[link], {})
            self._add(table, link, self.links[link], more)
        return table

    def cycles(self) -> list[list[str]]:
        return components_of({p for p, n in self.pairs.items() if n > 0})

    def simulate(self, ids: list[str], into: str) -> list[list[str]]:
        return components_of({p for p, n in self._after(ids, into).items() if n > 0})

    def commit(self, ids: list[str], into: str) -> None:
        self.pairs = self._after(ids, into)
        target = self.root(into)
        self.alias |= {r: target for i in ids if (r := self.root(i)) != target}

    def delete(self, ids: list[str]) -> None:
        for i in ids:
            for link in self.of.get(i, ()):
                if not (set(link) & self.gone):
                    self._add(self.pairs, link, -self.links[link], {})
            self.gone.add(i)


def campaign(simulator: MergeSimulator, cuts: list[dict], deletes: list[dict], merges: list[dict], budget: int | None = None) -> list[dict]:
    """Q25: cuts, then deletes, then merges that add no coupling, each judged on the state the ones before left.

    A cycle is new coupling unless all its files shared a cycle before. Steps
    carry running sums (W5).
    """
    base = [set(c) for c in simulator.cycles()]
    by_gain = lambda x: (-x["gain"], x["id"])
    plan = sorted(({"id": f"cut:{c['root']}", "type": "cut", "gain": 10, "loc": 0, "cycles": 1} for c in cuts if c["verified"]), key=by_gain)
    plan += sorted(({"id": f"del:{d['id']}", "type": "delete", "gain": d["loc"], "loc": d["loc"], "cycles": 0} for d in deletes), key=by_gain)
    simulator.delete([d["id"] for d in deletes])
    for m in sorted(merges, key=lambda x: (-x["loc"], x["id"])):
        after = simulator.simulate(m["ids"], m["canonical"])
        if all(any(set(c) <= b for b in base) for c in after):
            simulator.commit(m["ids"], m["canonical"])
            plan.append({"id": f"merge:{m['canonical']}", "type": "merge", "gain": m["loc"], "loc": m["loc"], "cycles": 0})
    plan = plan[:budget] if budget is not None else plan
    loc = broken = 0
    for step in plan:
        loc, broken = loc + step["loc"], broken + step["cycles"]
        step |= {"total_loc": loc, "total_cycles": broken}
    return plan


def reading_order(ids: DataFrame, edges: DataFrame, budget: int | None = None, most: int = MOST) -> list[tuple[str, int, int]]:
    """Q26: ids so that what is called comes first: fewest unread callees, then most callers in scope, then id.

    (id, callers, callees) in order. A heap with lazy entries; stops at the budget.
    """
    scope = {r.id for r in rows_of(ids.select("id").distinct(), most)}
    calls = edges.where("kind = 'call'").select("src", "dst").distinct()
    inside = calls.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    callers: dict[str, list[str]] = {}
    callees = dict.fromkeys(scope, 0)
    for r in rows_of(inside, most):
        callers.setdefault(r.dst, []).append(r.src)
        callees[r.src] += 1
    left = dict(callees)
    heap = [(left[i], -len(callers.get(i, ())), i) for i in scope]
    heapq.heapify(heap)
    out, read = [], set()
    while heap and (budget is None or len(out) < budget):
        n, fan, i = heapq.heappop(heap)
        if i in read or n != left[i]:
            continue
        read.add(i)
        out.append((i, -fan, callees[i]))
        for c in callers.get(i, ()):
            if c not in read:
                left[c] -= 1
                heapq.heappush(heap, (left[c], -len(callers.get(c, ())), c))
    return out


def fit_budget(groups: DataFrame, budget: int) -> list[str]:
    """Names of the groups (name, size), by size and name, whose pairs still fit the budget; one that does not is passed over."""
    taken, used = [], 0
    for r in sorted(rows_of(groups.select("name", "size")), key=lambda r: (r["size"], r["name"])):
        pairs = r["size"] * (r["size"] - 1) // 2
        if used + pairs <= budget:
            taken.append(r["name"])
            used += pairs
    return taken


def label_domains(nodes: DataFrame, edges: DataFrame, hub: int = 12, passes: int = 12, most: int = MOST) -> DataFrame:
    """(id, domain) by label propagation from two-level directories, hubs left out, in place and in node order.

    A node takes another label only if strictly more of its neighbours (counted
    with multiplicity) have it than its own; ties among better labels go to the
    smaller one. Domains take the name of the directory most members are in.
    The in-place order is part of the definition, so it runs on one machine; it
    gets the nodes that have links which no hub has a part in, since the others
    keep their labels. Degrees, and the names of domains, are counted on Spark.
    """
    from loomgraph.functions.paths import dir2

    dirs = Stored(nodes.select("id", dir2(F.col("file")).alias("dir")), "label-dirs").read()
    ids = dirs.select("id").distinct()
    within = Stored(edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "label-links").read()
    hubs = within.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") >= hub).select("dst")
    free = within.where("src <> dst").join(hubs, "dst", "left_anti").join(hubs.withColumnRenamed("dst", "src"), "src", "left_anti").select("src", "dst")
    links = rows_of(free, most)
    linked = sorted({x for r in links for x in r}, key=lambda x: x.encode())
    of = nodes.sparkSession.createDataFrame([(x,) for x in linked], "id string")
    label = {r.id: r.dir for r in rows_of(dirs.join(of, "id", "left_semi"), 2 * most)}
    near: dict[str, list[str]] = {x: [] for x in linked}
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    for _ in range(passes):
        moved = False
        for i, around in near.items():
            count: dict[str, int] = {}
            for j in around:
                count[label[j]] = count.get(label[j], 0) + 1
            best = min(count, key=lambda x: (-count[x], x))
            if count[best] > count.get(label[i], 0):
                label[i], moved = best, True
        if not moved:
            break
    told = nodes.sparkSession.createDataFrame([(x, label[x]) for x in linked], "id string, label string")
    ends = Stored(dirs.join(told, "id", "left").select("id", "dir", F.coalesce("label", "dir").alias("label")), "labels").read()
    name = ends.groupBy("label", "dir").agg(F.count("*").alias("n")).groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("n"), "dir")).alias("first"))
    return ends.join(name, "label").select("id", F.col("first.dir").alias("domain"))


def propagate_labels(nodes: DataFrame, edges: DataFrame, hub: int = 12, passes: int = 12, most: int = MOST) -> list[tuple[str, str]]:
    """label_domains() as a list, by id."""
    return [tuple(r) for r in rows_of(label_domains(nodes, edges, hub, passes, most).orderBy("id"), most)]
