"""Rankings, rules and reviews over (nodes, edges)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import CYCLE_KINDS, blast_counts, fan, orphans

# Weights of the two scores.
RISK = {"fan_in": 0.30, "fan_out": 0.15, "loc": 0.15, "blast": 0.30, "churn": 0.10}
HOTSPOT = {"complexity": 0.5, "fan_in": 0.3, "churn": 0.2}
# Names that a framework, a command line or a test runner may call.
ENTRY_NAMES = ("main", "default", "index", "setup", "teardown", "init")


def product_scope(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Product nodes, and how many of each other role were left out."""
    return nodes.where("role = 'product'"), nodes.where("role <> 'product'").groupBy("role").agg(F.count("*").alias("excluded"))


def weighted(df: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """Sum of weight * value / largest value; a column whose largest is 0 adds 0. The maxima are one row."""
    top = df.agg(*[F.max(c).alias(f"max_{c}") for c in weights])
    score = sum((F.when(F.col(f"max_{c}") > 0, w * F.col(c) / F.col(f"max_{c}")).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return df.crossJoin(F.broadcast(top)).withColumn(name, score).drop(*[f"max_{c}" for c in weights])


def _filled(nodes: DataFrame, *parts: DataFrame) -> DataFrame:
    for p in parts:
        name = p.columns[1]
        nodes = nodes.join(p, p.columns[0], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return nodes


def risk(nodes: DataFrame, edges: DataFrame, churn: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Q20: change risk of product nodes; churn: (file, commits). P5: changed keeps only nodes of those files, after scoring."""
    kept, _ = product_scope(nodes)
    parts = _filled(kept, fan(edges), fan(edges, False), blast_counts(nodes, edges))
    parts = parts.join(churn.select("file", F.col("commits").alias("churn")), "file", "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    out = weighted(parts, RISK, "risk").select("id", *RISK, "risk", "file")
    out = out.join(changed, "file", "left_semi") if changed is not None else out
    return out.drop("file").orderBy(F.desc("risk"), "id")


def hotspots(nodes: DataFrame, edges: DataFrame, churn: DataFrame) -> DataFrame:
    """Q21: functions and methods of product code with a complexity column."""
    kept = nodes.where("role = 'product' AND kind IN ('function', 'method')")
    parts = _filled(kept, fan(edges)).join(churn.select("file", F.col("commits").alias("churn")), "file", "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    return weighted(parts, HOTSPOT, "score").select("id", *HOTSPOT, "score").orderBy(F.desc("score"), "id")


def dead_code(nodes: DataFrame, edges: DataFrame, entry_files: list[str] = ()) -> DataFrame:
    """Q22: product orphans with the first reason that holds them back, or safe."""
    from loomgraph.functions.paths import is_test_file

    tested = edges.where("kind = 'test'").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("testers"))
    used = edges.where(F.col("kind").isin(*CYCLE_KINDS)).select(F.col("dst").alias("id")).distinct().withColumn("used", F.lit(True))
    o = orphans(nodes, edges).where("role = 'product'").join(tested, "id", "left")
    parents = nodes.join(used, "id", "left").where("exports OR used").select(F.col("file"), F.col("id").alias("pid"), F.col("line").alias("pl"), F.col("loc").alias("pn"))
    inside = (F.col("pl") < F.col("line")) & (F.col("line") + F.greatest("loc", F.lit(1)) - 1 <= F.col("pl") + F.col("pn") - 1)
    nested = o.join(parents, "file").where(inside & (F.col("pid") != F.col("id"))).select("id").distinct().withColumn("nested", F.lit(True))
    reason = (
        F.when(F.col("testers") > 0, "tested").when(is_test_file(F.col("file")), "test file").when(F.col("file").isin(list(entry_files)), "manifest")
        .when(F.col("nested"), "closure parent").when(F.col("label").isin(*ENTRY_NAMES), "entrypoint name").otherwise("safe")
    )
    return o.join(nested, "id", "left").select("id", "file", "loc", reason.alias("tier"))


def fitness(nodes: DataFrame, edges: DataFrame, rules: list[dict]) -> DataFrame:
    """Q23: (rule, severity, subject, detail) of every violation; an invalid rule is an error.

    forbidden-dependency {from, to}: edges between domains. layer {order}: an
    edge to an earlier domain of the list. max-fan-in {limit}, max-symbol-loc
    {limit}: above. no-cycles: one row for each cycle of files.
    """
    from loomgraph.operators.graph import cycles

    dom = nodes.select("id", "domain")
    e = edges.where(F.col("kind").isin(*CYCLE_KINDS)).join(dom.toDF("src", "d1"), "src").join(dom.toDF("dst", "d2"), "dst")
    found = None
    for r in rules:
        kind = r.get("type")
        if "id" not in r or r.get("severity", "error") not in ("error", "warning"):
            raise ValueError(f"invalid rule {r}")
        if kind == "forbidden-dependency":
            v = e.where((F.col("d1") == r["from"]) & (F.col("d2") == r["to"])).select(F.col("src").alias("subject"), F.col("dst").alias("detail"))
        elif kind == "layer":
            level = F.create_map(*[F.lit(x) for i, n in enumerate(r["order"]) for x in (n, i)])
            v = e.where(level[F.col("d2")] < level[F.col("d1")]).select(F.col("src").alias("subject"), F.col("dst").alias("detail"))
        elif kind == "max-fan-in":
            v = fan(edges).where(F.col("fan_in") > r["limit"]).select(F.col("id").alias("subject"), F.col("fan_in").cast("string").alias("detail"))
        elif kind == "max-symbol-loc":
            v = nodes.where(F.col("loc") > r["limit"]).select(F.col("id").alias("subject"), F.col("loc").cast("string").alias("detail"))
        elif kind == "no-cycles":
            v = cycles(nodes, edges).select(F.col("root").alias("subject"), F.col("n").cast("string").alias("detail"))
        else:
            raise ValueError(f"unknown rule type {kind!r}")
        v = v.select(F.lit(r["id"]).alias("rule"), F.lit(r.get("severity", "error")).alias("severity"), "subject", "detail").distinct()
        found = v if found is None else found.union(v)
    return found


def canonical(groups: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The survivor of each (group, id): most callers, then fewest lines, then smallest id."""
    g = _filled(groups.join(nodes.select("id", "loc"), "id"), fan(edges))
    w = Window.partitionBy("group").orderBy(F.desc("fan_in"), "loc", "id")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").select("group", F.col("id").alias("canonical"), "fan_in", "loc")


def review(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Nodes whose lines a hunk (file, start, end) touches; null bounds stand for the whole file. The file is the equi-key."""
    h = hunks.select("file", F.col("start").alias("hs"), F.col("end").alias("he"))
    last = F.col("line") + F.greatest("loc", F.lit(1)) - 1
    apart = (F.col("he") < F.col("line")) | (last < F.col("hs"))
    return nodes.join(h, "file").where(F.col("hs").isNull() | ~apart).select(*nodes.columns).distinct()


def domain_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A4: size, files, modal role (ties to the smaller name) and five key labels (exported first, then in-degree, then id) of each domain."""
    indeg = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("indeg"))
    n = _filled(nodes, indeg)
    rank = Window.partitionBy("domain").orderBy(F.desc("exports"), F.desc("indeg"), "id")
    top = n.withColumn("r", F.row_number().over(rank)).where("r <= 5").groupBy("domain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]), ", ").alias("key_labels"))
    by_role = n.groupBy("domain", "role").count()
    modal = by_role.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("count"), "role"))).where("r = 1").select("domain", F.col("role").alias("modal_role"))
    return n.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).join(modal, "domain").join(top, "domain")


def coupling(nodes: DataFrame, edges: DataFrame, with_tests: bool = False) -> DataFrame:
    """A5 (tests left out), A6 (counted): summed weight and count of edges between domains, by ordered pair."""
    dom = nodes.select("id", "domain")
    e = edges if with_tests else edges.where("kind <> 'test'")
    both = e.join(dom.toDF("src", "d1"), "src").join(dom.toDF("dst", "d2"), "dst").where("d1 <> d2")
    return both.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def domain_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Summed weight by unordered pair of domains."""
    c = coupling(nodes, edges, True)
    return c.groupBy(F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b")).agg(F.sum("weight").alias("weight"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of an ordered result with the true total and what remains."""
    total = df.agg(F.count("*").alias("total"))
    cut = df.orderBy(*order).offset(offset).limit(limit)
    return cut.crossJoin(F.broadcast(total)).withColumn("remaining", F.greatest(F.col("total") - offset - limit, F.lit(0)))


def placement(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """For each id, the domain that most of its callees have and the file it calls most; ties to the smaller name."""
    c = edges.where("kind = 'call'").join(ids.select(F.col("id").alias("src")), "src", "left_semi").select("src", F.col("dst").alias("id")).distinct().join(nodes.select("id", "domain", "file"), "id")
    pick = lambda col: (
        c.groupBy("src", col).count().withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("count"), col))).where("r = 1").select(F.col("src").alias("id"), F.col(col).alias(f"best_{col}"), F.col("count").alias(f"n_{col}"))
    )
    return pick("domain").join(pick("file"), "id")


def cards(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q28, Q31: fan-in, fan-out, importers, testers of each node with its zero-caller caveat."""
    parts = _filled(nodes, fan(edges), fan(edges, False), fan(edges, True, ("import",)).withColumnRenamed("fan_in", "importers"), fan(edges, True, ("test",)).withColumnRenamed("fan_in", "testers"))
    caveat = F.when(F.col("fan_in") > 0, "").when(F.col("exports"), "exported: callers may be outside").otherwise("no caller found")
    return parts.select("id", "label", "domain", "fan_in", "fan_out", "importers", "testers", caveat.alias("caveat"))
