"""Graph queries over the driver's tables, each with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import blast, diff, graph, planning, ranking
from loomgraph.sources.adapters import COMMERCE_SQL, FLOW_SQL, commerce, flow, market, market_sql, trade, trade_sql
from loomgraph.session import Stored, spread, table

COMMERCE = f"WITH {COMMERCE_SQL}"
RECURSIVE = f"WITH RECURSIVE {COMMERCE_SQL}"
TRADE = f"WITH RECURSIVE {trade_sql()}"
CLOSURE = "R AS (SELECT src AS a, dst AS b FROM E UNION SELECT R.a, E.dst FROM R JOIN E ON E.src = R.b)"
CYC = "M AS (SELECT x.a AS id, min(x.b) AS root FROM R x JOIN R y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"
CALLED = "('call', 'import', 'inherit', 'ref')"


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _lines(spark: SparkSession, d: str) -> int:
    """About how many edges commerce() has."""
    return table(spark, d, "lineitem").count()


def _churn(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Churn of a file: edges that leave it."""
    return edges.join(nodes.select(F.col("id").alias("src"), "file"), "src").groupBy("file").agg(F.count("*").alias("commits"))


CHURN = "H AS (SELECT file, count(*) AS commits FROM E JOIN N ON N.id = E.src GROUP BY file)"


def a1_fan_in(spark, d):
    return ranking.page(graph.fan(commerce(spark, d)[1]), [F.desc("fan_in"), F.col("id")], 0, 20).select("id", "fan_in")


def q1_callers(spark, d):
    return graph.neighbours(commerce(spark, d)[1], _ids(spark, "p:1", "p:7", "c:3"), "call")


def q2_callees(spark, d):
    return graph.neighbours(commerce(spark, d)[1], _ids(spark, "o:2", "o:3", "o:5"), "call", False)


def q3_tests(spark, d):
    return graph.neighbours(commerce(spark, d)[1], _ids(spark, "p:1", "p:7", "c:3"), "test")


def q4_importers(spark, d):
    _, e = commerce(spark, d)
    return graph.neighbours(e, _ids(spark, "s:1"), "import").withColumn("how", F.lit("import")).union(graph.neighbours(e, _ids(spark, "r:0"), "ref").withColumn("how", F.lit("ref")))


def q5_dependents(spark, d):
    n, e = commerce(spark, d)
    return graph.dependents(spread(e, _lines(spark, d), "dst"), n.where("domain = 'part' OR domain = 'geography'").select("id"))


def q6_impact(spark, d):
    return graph.impact(commerce(spark, d)[1], _ids(spark, "n:0", "n:4"))


def q7_impact_count(spark, d):
    return graph.impact(commerce(spark, d)[1], _ids(spark, "r:0")).agg(F.count("*").alias("n"))


def q8_blast_all(spark, d):
    return graph.blast_counts(*trade(spark, d))


def q9_cycles(spark, d):
    return graph.cycles(*trade(spark, d)).select("root", F.array_join("files", ",").alias("files"), "n")


def q10_orphans(spark, d):
    return graph.orphans(*commerce(spark, d)).select("id", "file")


def q11_cuts(spark, d):
    return planning.cheapest_cuts(*trade(spark, d, 1))


def q12_review(spark, d):
    """Documents as nodes on lines of a file per source; hunks are the third line of each document, and all of one file."""
    docs = _spans(table(spark, d, "documents"))
    hunks = docs.select("file", (F.col("line") + 2).alias("start"), (F.col("line") + 2).alias("end")).union(docs.where("file = 'src3'").select("file", F.lit(None).cast("int"), F.lit(None).cast("int")).distinct())
    return ranking.review(docs, hunks).select("id", "file", "line")


def _spans(docs):
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    lines = F.size(F.split("text", "\n"))
    return docs.select(F.concat(F.lit("d:"), "doc_id").alias("id"), F.col("doc_id").alias("k"), F.col("source").alias("file"), (1 + F.coalesce(F.sum(lines).over(w), F.lit(0))).cast("int").alias("line"), lines.alias("loc"))


SPANS = "S AS (SELECT 'd:' || doc_id AS id, doc_id AS k, source AS file, CAST(1 + coalesce(sum(len(string_split(text, chr(10)))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line, len(string_split(text, chr(10))) AS loc FROM documents)"


def _before_after(spark, d):
    """Two snapshots: orders up to the start of 1997, and all."""
    n, e = commerce(spark, d)
    late = table(spark, d, "orders").where("o_orderdate >= '1997-01-01'").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"))
    before = n.join(late, "id", "left_anti"), e.join(late.withColumnRenamed("id", "src"), "src", "left_anti")
    return before, (n, e)


LATE = "L AS (SELECT 'o:' || o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'), NB AS (SELECT * FROM N WHERE id NOT IN (SELECT id FROM L)), EB AS (SELECT * FROM E WHERE src NOT IN (SELECT id FROM L))"


def q13_regressions(spark, d):
    """From all orders back to the early ones: who lost their last caller."""
    before, after = _before_after(spark, d)
    return diff.lost_callers(after, before)


def q14_gate(spark, d):
    n, e = trade(spark, d)
    return diff.gate((n, e.where("src <> 'n:0'")), (n, e), orphan_gate=False)


def q16_edit_merge(spark, d):
    n, e = trade(spark, d)
    return graph.apply_edit(n, e, "merge", ["n:1", "n:2", "n:3"])[1]


def q16_edit_move(spark, d):
    n, e = trade(spark, d)
    return graph.file_edges(*graph.apply_edit(n, e, "move", ["n:1", "n:2"], file="nation/0")).select("src", "dst", "n")


def q17_simulate_delete(spark, d):
    """Deleting every nation that region 0's nations call: what the gate says."""
    n, e = trade(spark, d)
    gone = [r.id for r in planning.rows_of(n.where("domain = 'AFRICA'").select("id"))]
    return diff.gate((n, e), graph.apply_edit(n, e, "delete", gone), orphan_gate=False).select("new_cycles", "lost_callers")


def q18_diff_nodes(spark, d):
    before, after = _before_after(spark, d)
    return diff.changes(before[0], after[0], ["id", "domain"])


def q18_diff_edges(spark, d):
    before, after = _before_after(spark, d)
    return diff.changes(before[1], after[1], ["src", "dst", "kind"], 2 * _lines(spark, d)).groupBy("kind", "change").agg(F.count("*").alias("n"))


def q20_risk(spark, d):
    n, e = trade(spark, d)
    return ranking.risk(n, e, _churn(n, e)).withColumn("risk", F.round("risk", 9))


def q21_hotspots(spark, d):
    n, e = commerce(spark, d)
    out = ranking.hotspots(n.withColumn("complexity", F.col("loc") % 7), e, _churn(n, e))
    return out.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(50)


def q22_dead_code(spark, d):
    return ranking.dead_code(*commerce(spark, d), entry_files=["orders/1"])


RULES = [
    {"id": "no-part-to-asia", "type": "forbidden-dependency", "from": "part", "to": "ASIA"},
    {"id": "layers", "type": "layer", "severity": "warning", "order": ["geography", "part", "orders"]},
    {"id": "fan", "type": "max-fan-in", "limit": 40},
    {"id": "loc", "type": "max-symbol-loc", "limit": 48},
]


def q23_fitness(spark, d):
    return ranking.fitness(*commerce(spark, d), RULES)


def q27_placement(spark, d):
    n, e = commerce(spark, d)
    return ranking.placement(n, e, n.where("domain = 'orders'"))


def q28_cards(spark, d):
    n, e = commerce(spark, d)
    return ranking.cards(n, e).where("fan_in > 30 OR importers > 40 OR fan_out > 6")


def q30_brief(spark, d):
    """Product symbols, load and entry points of each domain."""
    n, e = commerce(spark, d)
    c = ranking.cards(n, e).join(n.select("id", "exports", "role"), "id")
    return c.where("role = 'product'").groupBy("domain").agg(F.count("*").alias("n"), F.max("fan_in").alias("top_fan_in"), F.count_if(F.col("exports") & (F.col("fan_in") == 0) & (F.col("fan_out") >= 2)).alias("entry_points"))


def q31_lenses(spark, d):
    n, e = trade(spark, d)
    return graph.blast_counts(n, e).join(ranking.cards(n, e).select("id", "fan_in"), "id").where("fan_in >= 1").join(n.select("id", "file", "line"), "id")


def q32_codemod(spark, d):
    """Nations of a region as one group: survivor, and the calls that would be rewritten."""
    n, e = trade(spark, d)
    groups = n.select(F.col("domain").alias("group"), "id")
    can = ranking.canonical(groups, n, e)
    losers = groups.join(can.select("group", "canonical"), "group").where("id <> canonical")
    hit = e.where("kind IN ('call', 'import')").join(losers.select(F.col("id").alias("dst"), "group"), "dst")
    return can.select("group", "canonical").join(hit.groupBy("group").agg(F.countDistinct("src").alias("rewrites")), "group", "left").join(losers.join(n.select("id", "loc"), "id").groupBy("group").agg(F.sum("loc").alias("loc_saved"), F.count("*").alias("deletions")), "group")


def q33_trend(spark, d):
    """Orders of each year as a snapshot: size, coupling and change."""
    n, e = commerce(spark, d)
    year = table(spark, d, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("src"), F.year("o_orderdate").alias("snapshot"))
    ey = Stored(e.join(year, "src"), "snapshots").read()  # read four times below
    ny = ey.select("snapshot", F.col("src").alias("id")).union(ey.select("snapshot", "dst")).distinct().join(n, "id")
    m = diff.metrics(ny, ey)
    return m.join(diff.trend(m, "coupling", "snapshot").drop("coupling"), "snapshot")


def a2_indegree(spark, d):
    return commerce(spark, d)[1].groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).where("n >= 12")


def a4_domains(spark, d):
    return ranking.domain_summary(*commerce(spark, d))


def a5_coupling(spark, d):
    return ranking.coupling(*commerce(spark, d))


def a6_cross_edges(spark, d):
    return ranking.coupling(*commerce(spark, d), with_tests=True).agg(F.sum("n").alias("n"))


def a7_matrix(spark, d):
    return ranking.domain_matrix(*commerce(spark, d))


def a12_common_callees(spark, d):
    """Parts that all of three customers' orders... of one day name: callees that every caller of a group shares."""
    e = commerce(spark, d)[1].where("kind = 'call'").select("src", "dst").distinct()
    n = e.where("src IN ('o:2', 'o:3', 'o:5')").select("src").distinct().count()
    return e.where("src IN ('o:2', 'o:3', 'o:5')").groupBy("dst").agg(F.countDistinct("src").alias("n")).withColumn("in_all", F.col("n") == n)


def a13_files(spark, d):
    n, e = commerce(spark, d)
    c = ranking.cards(n, e).join(n.select("id", "file"), "id")
    return c.groupBy("file").agg(F.count("*").alias("symbols"), F.sum("fan_in").alias("call_in"), F.min_by("id", F.struct(-F.col("fan_in"), F.col("id"))).alias("top"))


def p1_scope(spark, d):
    return ranking.product_scope(commerce(spark, d)[0])[1]


def p3_resolve(spark, d):
    n = commerce(spark, d)[0]
    return graph.resolve(n, "CHINA").union(graph.resolve(n, "n:3")).union(graph.resolve(n, "ASIA"))


def p5_changed_risk(spark, d):
    n, e = trade(spark, d)
    return ranking.risk(n, e, _churn(n, e), n.where("domain = 'ASIA'").select("file")).select("id", F.round("risk", 9).alias("risk"))


def p10_dangling(spark, d):
    """Edges of the early snapshot whose ends are both still nodes."""
    before, after = _before_after(spark, d)
    e = after[1]
    ids = before[0].select("id")
    rows = _lines(spark, d)
    kept = spread(e, rows, "src").join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    kept = spread(kept, rows, "dst").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept.groupBy("kind").agg(F.count("*").alias("n"))


def p12_sample(spark, d):
    """Seeded sample without replacement of exported symbols with callers."""
    n, e = commerce(spark, d)
    c = n.where("exports").join(graph.fan(e).where("fan_in >= 3"), "id")
    return c.orderBy(F.md5(F.concat(F.col("id"), F.lit(":7"))), "id").limit(25).select("id")


def w1_page(spark, d):
    return ranking.page(graph.fan(commerce(spark, d)[1]), [F.desc("fan_in"), F.col("id")], 40, 20)


def w3_canonical(spark, d):
    n, e = commerce(spark, d)
    return ranking.canonical(n.where("domain <> 'orders'").select(F.col("label").alias("group"), "id"), n, e)


def u1_union(spark, d):
    e = commerce(spark, d)[1]
    return graph.neighbours(e, _ids(spark, "p:1", "s:1"), "call").union(graph.neighbours(e, _ids(spark, "p:1", "s:1"), "import")).distinct()


def u4_identity(spark, d):
    """Groups of nations by region with their identity: kind and sorted members."""
    n, _ = trade(spark, d)
    members = n.groupBy("domain").agg(F.sort_array(F.collect_list("id")).alias("m"))
    return members.select("domain", F.concat_ws("|", F.lit("group"), F.array_join("m", ",")).alias("identity"))


def u5_merge(spark, d):
    e = flow(spark, d)
    return graph.merge_edges(e.union(e.where("src < dst")))


def p8_suppressed(spark, d):
    """Groups whose fingerprint is not on the list of suppressed ones."""
    n, _ = trade(spark, d)
    g = n.groupBy("domain").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("m")).select("domain", F.substring(F.sha1(F.concat(F.lit("group:"), "m")), 1, 16).alias("fingerprint"))
    killed = g.where("domain IN ('ASIA', 'EUROPE')").select("fingerprint")
    return g.join(killed, "fingerprint", "left_anti")


def q15_merge_simulator(spark, d):
    """File cycles after each of three merges tried on the trade graph."""
    n, e = trade(spark, d, 1)
    sim = planning.MergeSimulator(n, e)
    out = [(",".join(ids), ";".join(",".join(c) for c in sim.simulate(ids, min(ids)))) for ids in (["n:1", "n:2"], ["n:3", "n:4", "n:5"], ["n:10", "n:11"])]
    return spark.createDataFrame(out, "merge string, cycles string")


def q24_optimize(spark, d):
    """Groups of nations by region: survivor, rewired callers and whether merging them makes a new file cycle."""
    n, e = trade(spark, d, 1)
    can = ranking.canonical(n.select(F.col("domain").alias("group"), "id"), n, e)
    members = n.groupBy(F.col("domain").alias("group")).agg(F.sort_array(F.collect_list("id")).alias("ids"), F.sum("loc").alias("all_loc"))
    sim = planning.MergeSimulator(n, e)
    base = {tuple(c) for c in sim.cycles()}
    rows = planning.rows_of(can.join(members, "group"))
    out = [(r["group"], r.canonical, "blocked" if any(tuple(c) not in base for c in sim.simulate(r.ids, r.canonical)) else "ready", r.all_loc - r["loc"]) for r in rows]
    return spark.createDataFrame(out, "group string, canonical string, tier string, loc_saved long")


def q25_campaign(spark, d):
    n, e = trade(spark, d, 1)
    cuts = [r.asDict() for r in planning.rows_of(planning.cheapest_cuts(n, e))]
    dead = [r.asDict() for r in planning.rows_of(ranking.dead_code(n, e).where("tier = 'safe'"))]
    can = ranking.canonical(n.select(F.col("domain").alias("group"), "id"), n, e)
    members = n.groupBy(F.col("domain").alias("group")).agg(F.sort_array(F.collect_list("id")).alias("ids"), F.sum("loc").alias("all_loc"))
    merges = [{"id": r["group"], "ids": r.ids, "canonical": r.canonical, "loc": r.all_loc - r["loc"]} for r in planning.rows_of(can.join(members, "group"))]
    steps = planning.campaign(planning.MergeSimulator(n, e), cuts, dead, merges)
    return spark.createDataFrame([(i, s["id"], s["type"], s["gain"], s["total_loc"], s["total_cycles"]) for i, s in enumerate(steps)], "pos int, id string, type string, gain long, total_loc long, total_cycles long")


def q26_reading_order(spark, d):
    n, e = trade(spark, d)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(planning.reading_order(n.select("id"), e))], "pos int, id string, callers int, callees int")


def c1_clusters(spark, d):
    """Domains of the inherit graph and the nodes on it."""
    n, e = commerce(spark, d)
    e = e.where("kind = 'inherit'")
    on = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return planning.label_domains(n.join(on, "id", "left_semi"), e).groupBy("domain").agg(F.count("*").alias("n"))


def q8_blast_market(spark, d):
    return graph.blast_counts(*market(spark, d))


def q9_cycles_market(spark, d):
    return graph.cycles(*market(spark, d)).select("root", F.array_join("files", ",").alias("files"), "n")


def q9_components_market(spark, d):
    """Strong components of nodes."""
    return graph.strong_components(market(spark, d)[1])


def q20_risk_market(spark, d):
    n, e = market(spark, d)
    return ranking.risk(n, e, _churn(n, e)).withColumn("risk", F.round("risk", 9))


def p5_changed_risk_market(spark, d):
    n, e = market(spark, d)
    return ranking.risk(n, e, _churn(n, e), n.where("domain = 'customer-1'").select("file")).select("id", F.round("risk", 9).alias("risk"))


def q31_lenses_carried(spark, d):
    """Blast counts of the market, carried over from the market without the edges that leave every twentieth customer and those that some suppliers inherit by."""
    n, e = market(spark, d)
    number = F.substring("src", 3, 20).cast("long")
    before = e.where(~((number % 20 == 0) & F.col("src").startswith("c:")) & ~((number % 40 == 0) & F.col("src").startswith("s:")))
    return blast.carried(blast.blast(n, before), n, before, e).counts()


QUERIES = {f.__name__: f for f in (
    a1_fan_in, q1_callers, q2_callees, q3_tests, q4_importers, q5_dependents, q6_impact, q7_impact_count, q8_blast_all, q9_cycles, q10_orphans, q11_cuts, q12_review, q13_regressions, q14_gate,
    q15_merge_simulator, q16_edit_merge, q16_edit_move, q17_simulate_delete, q18_diff_nodes, q18_diff_edges, q20_risk, q21_hotspots, q22_dead_code, q23_fitness, q24_optimize, q25_campaign, q26_reading_order,
    q27_placement, q28_cards, q30_brief, q31_lenses, q32_codemod, q33_trend, c1_clusters, a2_indegree, a4_domains, a5_coupling, a6_cross_edges, a7_matrix, a12_common_callees, a13_files,
    p1_scope, p3_resolve, p5_changed_risk, p8_suppressed, p10_dangling, p12_sample, w1_page, w3_canonical, u1_union, u4_identity, u5_merge, q8_blast_market, q9_cycles_market, q9_components_market, q20_risk_market, p5_changed_risk_market, q31_lenses_carried,
)}

_FAN = "SELECT dst AS id, count(DISTINCT src) AS fan_in FROM E WHERE kind = 'call' GROUP BY dst"
_CARDS = """C AS (SELECT N.id, label, domain, coalesce(a.n, 0) AS fan_in, coalesce(b.n, 0) AS fan_out, coalesce(i.n, 0) AS importers, coalesce(t.n, 0) AS testers,
  CASE WHEN coalesce(a.n, 0) > 0 THEN '' WHEN exports THEN 'exported: callers may be outside' ELSE 'no caller found' END AS caveat FROM N
  LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM E WHERE kind = 'call' GROUP BY dst) a ON a.dst = N.id
  LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM E WHERE kind = 'call' GROUP BY src) b ON b.src = N.id
  LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM E WHERE kind = 'import' GROUP BY dst) i ON i.dst = N.id
  LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM E WHERE kind = 'test' GROUP BY dst) t ON t.dst = N.id)"""
_BLAST = "Z AS (SELECT b AS id, count(DISTINCT a) AS blast FROM R WHERE a <> b GROUP BY b)"
_RISK = f"""{TRADE}, {CLOSURE}, {_BLAST}, {CHURN}, {_CARDS},
X AS (SELECT N.id, N.domain, C.fan_in, C.fan_out, loc, coalesce(blast, 0) AS blast, coalesce(commits, 0) AS churn FROM N JOIN C ON C.id = N.id LEFT JOIN Z ON Z.id = N.id LEFT JOIN H ON H.file = N.file),
Y AS (SELECT *, round(0.30 * fan_in / max(fan_in) OVER () + 0.15 * fan_out / max(fan_out) OVER () + 0.15 * loc / max(loc) OVER () + 0.30 * blast / max(blast) OVER () + 0.10 * churn / max(churn) OVER (), 9) AS risk FROM X)"""
_NEAR = lambda ids, kind, inn=True: f"SELECT DISTINCT {'src' if inn else 'dst'} AS id FROM E WHERE kind = '{kind}' AND {'dst' if inn else 'src'} IN ({ids})"
_COUPLING = "SELECT a.domain AS d1, b.domain AS d2, count(*) AS n, sum(weight) AS weight FROM E JOIN N a ON a.id = src JOIN N b ON b.id = dst WHERE a.domain <> b.domain {} GROUP BY 1, 2"
_CANON = "SELECT grp, id, fan_in, loc, row_number() OVER (PARTITION BY grp ORDER BY fan_in DESC, loc, id) AS r FROM (SELECT {} AS grp, N.id, coalesce(F2.fan_in, 0) AS fan_in, N.loc FROM N LEFT JOIN (" + _FAN + ") F2 ON F2.id = N.id {})"

ORACLE_SQL = {
    "a1_fan_in": f"{COMMERCE} {_FAN} ORDER BY fan_in DESC, id LIMIT 20",
    "q1_callers": f"{COMMERCE} {_NEAR(chr(39) + 'p:1' + chr(39) + ', ' + chr(39) + 'p:7' + chr(39) + ', ' + chr(39) + 'c:3' + chr(39), 'call')}",
    "q2_callees": f"{COMMERCE} SELECT DISTINCT dst AS id FROM E WHERE kind = 'call' AND src IN ('o:2', 'o:3', 'o:5')",
    "q3_tests": f"{COMMERCE} SELECT DISTINCT src AS id FROM E WHERE kind = 'test' AND dst IN ('p:1', 'p:7', 'c:3')",
    "q4_importers": f"{COMMERCE} SELECT DISTINCT src AS id, kind AS how FROM E WHERE (kind = 'import' AND dst = 's:1') OR (kind = 'ref' AND dst = 'r:0')",
    "q5_dependents": f"{COMMERCE} SELECT dst AS id, " + ", ".join(f"count(DISTINCT src) FILTER (WHERE E.kind = '{k}') AS n_{k}" for k in graph.KINDS) + ", count(DISTINCT src) AS n_all FROM E JOIN N ON N.id = dst WHERE domain IN ('part', 'geography') GROUP BY dst",
    "q6_impact": f"{RECURSIVE}, R AS (SELECT src AS id, 1 AS distance FROM E WHERE kind IN ('call', 'inherit') AND dst IN ('n:0', 'n:4') UNION SELECT E.src, distance + 1 FROM R JOIN E ON E.dst = R.id AND E.kind IN ('call', 'inherit')) SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM R WHERE id NOT IN ('n:0', 'n:4') GROUP BY id",
    "q7_impact_count": f"{RECURSIVE}, R AS (SELECT src AS id FROM E WHERE kind IN ('call', 'inherit') AND dst = 'r:0' UNION SELECT E.src FROM R JOIN E ON E.dst = R.id AND E.kind IN ('call', 'inherit')) SELECT count(*) AS n FROM R WHERE id <> 'r:0'",
    "q8_blast_all": f"{TRADE}, {CLOSURE}, {_BLAST} SELECT N.id, coalesce(blast, 0) AS blast FROM N LEFT JOIN Z ON Z.id = N.id",
    "q9_cycles": f"{TRADE}, {CLOSURE}, {CYC}, G AS (SELECT M.root, replace(id, 'n:', 'nation/') AS f FROM M) SELECT min(f) AS root, string_agg(f, ',' ORDER BY f) AS files, count(*) AS n FROM G GROUP BY G.root HAVING count(*) >= 2",
    "q10_orphans": f"{COMMERCE} SELECT id, file FROM N WHERE NOT exports AND id NOT IN (SELECT dst FROM E WHERE kind IN {CALLED})",
    "q12_review": f"WITH {SPANS}, H AS (SELECT file, line + 2 AS s, line + 2 AS e FROM S UNION ALL SELECT DISTINCT file, NULL, NULL FROM S WHERE file = 'src3') SELECT DISTINCT id, S.file, line FROM S JOIN H ON H.file = S.file AND (s IS NULL OR NOT (e < line OR line + greatest(loc, 1) - 1 < s))",
    "q13_regressions": f"{COMMERCE}, {LATE} SELECT dst AS id, count(DISTINCT src) AS was FROM E WHERE kind = 'call' AND dst IN (SELECT id FROM NB) AND dst NOT IN (SELECT dst FROM EB WHERE kind = 'call') GROUP BY dst",
    "q16_edit_merge": f"{TRADE}, T AS (SELECT CASE WHEN src IN ('n:2', 'n:3') THEN 'n:1' ELSE src END AS src, CASE WHEN dst IN ('n:2', 'n:3') THEN 'n:1' ELSE dst END AS dst, kind, weight FROM E) SELECT src, dst, kind, CAST(sum(weight) AS INTEGER) AS weight FROM T WHERE src <> dst GROUP BY 1, 2, 3",
    "q16_edit_move": f"{TRADE}, P AS (SELECT id, CASE WHEN id IN ('n:1', 'n:2') THEN 'nation/0' ELSE file END AS file FROM N) SELECT a.file AS src, b.file AS dst, count(*) AS n FROM E JOIN P a ON a.id = src JOIN P b ON b.id = dst WHERE a.file <> b.file GROUP BY 1, 2",
    "q18_diff_nodes": f"{COMMERCE}, {LATE} SELECT id, domain, 'added' AS change FROM N WHERE id IN (SELECT id FROM L)",
    "q18_diff_edges": f"{COMMERCE}, {LATE} SELECT kind, 'added' AS change, count(*) AS n FROM (SELECT DISTINCT src, dst, kind FROM E WHERE src IN (SELECT id FROM L)) GROUP BY kind",
    "q20_risk": f"{_RISK} SELECT id, fan_in, fan_out, loc, blast, churn, risk FROM Y",
    "q21_hotspots": f"{COMMERCE}, {CHURN}, X AS (SELECT N.id, loc % 7 AS complexity, coalesce(f.fan_in, 0) AS fan_in, coalesce(commits, 0) AS churn FROM N LEFT JOIN ({_FAN}) f ON f.id = N.id LEFT JOIN H ON H.file = N.file WHERE role = 'product') SELECT *, round(0.5 * complexity / max(complexity) OVER () + 0.3 * fan_in / max(fan_in) OVER () + 0.2 * churn / max(churn) OVER (), 9) AS score FROM X ORDER BY score DESC, id LIMIT 50",
    "q22_dead_code": f"{COMMERCE}, O AS (SELECT * FROM N WHERE NOT exports AND role = 'product' AND id NOT IN (SELECT dst FROM E WHERE kind IN {CALLED})) SELECT id, file, loc, CASE WHEN id IN (SELECT dst FROM E WHERE kind = 'test') THEN 'tested' WHEN file = 'orders/1' THEN 'manifest' ELSE 'safe' END AS tier FROM O",
    "q23_fitness": f"""{COMMERCE}, D AS (SELECT src, dst, a.domain AS d1, b.domain AS d2 FROM E JOIN N a ON a.id = src JOIN N b ON b.id = dst WHERE E.kind IN {CALLED}), V AS (SELECT * FROM (VALUES ('geography', 0), ('part', 1), ('orders', 2)) v(name, lvl))
SELECT DISTINCT 'no-part-to-asia' AS rule, 'error' AS severity, src AS subject, dst AS detail FROM D WHERE d1 = 'part' AND d2 = 'ASIA'
UNION ALL SELECT DISTINCT 'layers', 'warning', src, dst FROM D JOIN V x ON x.name = d1 JOIN V y ON y.name = d2 WHERE y.lvl < x.lvl
UNION ALL SELECT 'fan', 'error', id, CAST(fan_in AS VARCHAR) FROM ({_FAN}) WHERE fan_in > 40 UNION ALL SELECT 'loc', 'error', id, CAST(loc AS VARCHAR) FROM N WHERE loc > 48""",
    "q27_placement": f"{COMMERCE}, Q AS (SELECT DISTINCT src, dst FROM E WHERE kind = 'call'), A AS (SELECT src, b.domain, count(*) AS n, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, b.domain) AS r FROM Q JOIN N a ON a.id = src AND a.domain = 'orders' JOIN N b ON b.id = dst GROUP BY 1, 2), B AS (SELECT src, b.file, count(*) AS n, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, b.file) AS r FROM Q JOIN N a ON a.id = src AND a.domain = 'orders' JOIN N b ON b.id = dst GROUP BY 1, 2) SELECT A.src AS id, A.domain AS best_domain, A.n AS n_domain, B.file AS best_file, B.n AS n_file FROM A JOIN B ON A.src = B.src AND A.r = 1 AND B.r = 1",
    "q28_cards": f"{COMMERCE}, {_CARDS} SELECT * FROM C WHERE fan_in > 30 OR importers > 40 OR fan_out > 6",
    "q30_brief": f"{COMMERCE}, {_CARDS} SELECT C.domain, count(*) AS n, max(fan_in) AS top_fan_in, count(*) FILTER (WHERE exports AND fan_in = 0 AND fan_out >= 2) AS entry_points FROM C JOIN N ON N.id = C.id WHERE role = 'product' GROUP BY 1",
    "q31_lenses": f"{TRADE}, {CLOSURE}, {_BLAST}, {_CARDS} SELECT N.id, coalesce(blast, 0) AS blast, C.fan_in, file, line FROM N JOIN C ON C.id = N.id LEFT JOIN Z ON Z.id = N.id WHERE C.fan_in >= 1",
    "q32_codemod": f"{TRADE}, C AS ({_CANON.format('domain', '')}), L AS (SELECT N.id, N.loc, C.grp FROM N JOIN C ON C.grp = N.domain AND C.r = 1 AND C.id <> N.id), W AS (SELECT grp, count(DISTINCT src) AS rewrites FROM E JOIN L ON L.id = dst WHERE kind IN ('call', 'import') GROUP BY grp) SELECT C.grp AS \"group\", C.id AS canonical, W.rewrites, (SELECT sum(loc) FROM L WHERE L.grp = C.grp) AS loc_saved, (SELECT count(*) FROM L WHERE L.grp = C.grp) AS deletions FROM C LEFT JOIN W ON W.grp = C.grp WHERE C.r = 1 AND C.grp IN (SELECT grp FROM L)",
    "q33_trend": f"{COMMERCE}, Y AS (SELECT E.*, CAST(year(o_orderdate) AS INTEGER) AS snapshot FROM E JOIN orders ON 'o:' || o_orderkey = src), I AS (SELECT DISTINCT snapshot, id, file, domain FROM (SELECT snapshot, src AS id FROM Y UNION SELECT snapshot, dst FROM Y) JOIN N USING (id)), S AS (SELECT snapshot, count(*) AS symbols, count(DISTINCT file) AS files FROM I GROUP BY 1), X AS (SELECT Y.snapshot, sum(weight) AS coupling FROM Y JOIN N a ON a.id = src JOIN N b ON b.id = dst WHERE Y.kind <> 'test' AND a.domain <> b.domain GROUP BY 1) SELECT snapshot, symbols, files, coupling, coupling - lag(coupling) OVER (ORDER BY snapshot) AS since_last, coupling - first_value(coupling) OVER (ORDER BY snapshot) AS since_first FROM S JOIN X USING (snapshot)",
    "a2_indegree": f"{COMMERCE} SELECT dst AS id, count(*) AS n FROM E GROUP BY dst HAVING count(*) >= 12",
    "a4_domains": f"{COMMERCE}, X AS (SELECT N.*, coalesce(n, 0) AS indeg FROM N LEFT JOIN (SELECT dst, count(*) AS n FROM E GROUP BY dst) i ON i.dst = id), T AS (SELECT domain, label, row_number() OVER (PARTITION BY domain ORDER BY exports DESC, indeg DESC, id) AS r FROM X), K2 AS (SELECT domain, string_agg(label, ', ' ORDER BY r) AS key_labels FROM T WHERE r <= 5 GROUP BY domain), O AS (SELECT domain, role, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, role) AS r FROM N GROUP BY 1, 2) SELECT N.domain, count(*) AS n, count(DISTINCT file) AS files, any_value(O.role) AS modal_role, any_value(key_labels) AS key_labels FROM N JOIN O ON O.domain = N.domain AND O.r = 1 JOIN K2 ON K2.domain = N.domain GROUP BY N.domain",
    "a5_coupling": f"{COMMERCE} " + _COUPLING.format("AND E.kind <> 'test'"),
    "a6_cross_edges": f"{COMMERCE} SELECT sum(n) AS n FROM ({_COUPLING.format('')})",
    "a7_matrix": f"{COMMERCE} SELECT least(d1, d2) AS a, greatest(d1, d2) AS b, sum(weight) AS weight FROM ({_COUPLING.format('')}) GROUP BY 1, 2",
    "a12_common_callees": f"{COMMERCE} SELECT dst, count(DISTINCT src) AS n, count(DISTINCT src) = (SELECT count(DISTINCT src) FROM E WHERE kind = 'call' AND src IN ('o:2', 'o:3', 'o:5')) AS in_all FROM E WHERE kind = 'call' AND src IN ('o:2', 'o:3', 'o:5') GROUP BY dst",
    "a13_files": f"{COMMERCE}, {_CARDS} SELECT file, count(*) AS symbols, sum(fan_in) AS call_in, first(C.id ORDER BY fan_in DESC, C.id) AS top FROM C JOIN N ON N.id = C.id GROUP BY file",
    "p1_scope": f"{COMMERCE} SELECT role, count(*) AS excluded FROM N WHERE role <> 'product' GROUP BY role",
    "p3_resolve": f"{COMMERCE} SELECT id FROM N WHERE label IN ('CHINA', 'ASIA') OR id = 'n:3'",
    "p5_changed_risk": f"{_RISK} SELECT id, risk FROM Y WHERE domain = 'ASIA'",
    "p8_suppressed": f"{TRADE} SELECT domain, substr(sha1('group:' || string_agg(id, ',' ORDER BY id)), 1, 16) AS fingerprint FROM N WHERE domain NOT IN ('ASIA', 'EUROPE') GROUP BY domain",
    "p10_dangling": f"{COMMERCE}, {LATE} SELECT kind, count(*) AS n FROM E WHERE src IN (SELECT id FROM NB) AND dst IN (SELECT id FROM NB) GROUP BY kind",
    "p12_sample": f"{COMMERCE} SELECT N.id FROM N JOIN ({_FAN}) f ON f.id = N.id WHERE exports AND fan_in >= 3 ORDER BY md5(N.id || ':7'), N.id LIMIT 25",
    "w1_page": f"{COMMERCE}, X AS ({_FAN}) SELECT id, fan_in, (SELECT count(*) FROM X) AS total, greatest((SELECT count(*) FROM X) - 60, 0) AS remaining FROM X ORDER BY fan_in DESC, id LIMIT 20 OFFSET 40",
    "w3_canonical": f"{COMMERCE}, C AS ({_CANON.format('label', chr(87) + 'HERE N.domain <> ' + chr(39) + 'orders' + chr(39))}) SELECT grp AS \"group\", id AS canonical, fan_in, loc FROM C WHERE r = 1",
    "u1_union": f"{COMMERCE} SELECT DISTINCT src AS id FROM E WHERE kind IN ('call', 'import') AND dst IN ('p:1', 's:1')",
    "u4_identity": f"{TRADE} SELECT domain, 'group|' || string_agg(id, ',' ORDER BY id) AS identity FROM N GROUP BY domain",
    "u5_merge": f"WITH {FLOW_SQL} SELECT src, dst, kind, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT * FROM E UNION ALL SELECT * FROM E WHERE src < dst) GROUP BY 1, 2, 3",
}

MARKET = f"WITH RECURSIVE {market_sql()}"
_FILES = f"""{MARKET}, FE AS (SELECT DISTINCT a.file AS x, b.file AS y FROM E JOIN N a ON a.id = src JOIN N b ON b.id = dst WHERE a.file <> b.file), FR AS (SELECT x, y FROM FE UNION SELECT FR.x, FE.y FROM FR JOIN FE ON FE.x = FR.y)"""
_RISK_MARKET = _RISK.replace(TRADE, MARKET).replace("LEFT JOIN H ON H.file = N.file)", "LEFT JOIN H ON H.file = N.file WHERE N.role = 'product')")
ORACLE_SQL |= {
    "q8_blast_market": ORACLE_SQL["q8_blast_all"].replace(TRADE, MARKET),
    "q31_lenses_carried": ORACLE_SQL["q8_blast_all"].replace(TRADE, MARKET),
    "q20_risk_market": f"{_RISK_MARKET} SELECT id, fan_in, fan_out, loc, blast, churn, risk FROM Y",
    "p5_changed_risk_market": f"{_RISK_MARKET} SELECT id, risk FROM Y WHERE id IN (SELECT id FROM N WHERE file IN (SELECT file FROM N WHERE domain = 'customer-1'))",
    "q9_components_market": f"{MARKET}, {CLOSURE} SELECT a.a AS id, least(a.a, min(a.b)) AS root FROM R a JOIN R b ON b.a = a.b AND b.b = a.a WHERE a.a <> a.b GROUP BY a.a",
    "q9_cycles_market": f"{_FILES}, M AS (SELECT a.x, least(a.x, min(a.y)) AS root FROM FR a JOIN FR b ON b.x = a.y AND b.y = a.x WHERE a.x <> a.y GROUP BY a.x) SELECT root, string_agg(x, ',' ORDER BY x) AS files, count(*) AS n FROM M GROUP BY root",
}


def _gate_sql(before: str, after: str, nodes_after: str = "SELECT * FROM N") -> str:
    """Gate of the trade graph: before and after are its edges."""
    side = lambda e, k: (
        f"R{k} AS (SELECT src AS a, dst AS b FROM {e} UNION SELECT R{k}.a, {e}.dst FROM R{k} JOIN {e} ON {e}.src = R{k}.b), M{k} AS (SELECT x.a AS id, min(x.b) AS root FROM R{k} x JOIN R{k} y ON x.a = y.b AND x.b = y.a GROUP BY x.a), "
        f"G{k} AS (SELECT string_agg(id, ',' ORDER BY id) AS ids FROM M{k} GROUP BY root HAVING count(*) >= 2)"
    )
    free = lambda n, e: f"SELECT id FROM {n} WHERE NOT exports AND id NOT IN (SELECT dst FROM {e} WHERE kind IN {CALLED})"
    return f"""{TRADE}, EB AS ({before}), EA AS ({after}), NA AS ({nodes_after}), {side("EB", 1)}, {side("EA", 2)},
P AS (SELECT (SELECT count(*) FROM G2 WHERE ids NOT IN (SELECT ids FROM G1)) AS new_cycles, (SELECT count(*) FROM NA WHERE id IN (SELECT dst FROM EB WHERE kind = 'call') AND id NOT IN (SELECT dst FROM EA WHERE kind = 'call')) AS lost_callers,
(SELECT count(*) FROM ({free("NA", "EA")}) WHERE id NOT IN ({free("N", "EB")})) AS new_orphans)"""


_GONE = "(SELECT id FROM N WHERE domain = 'AFRICA')"
ORACLE_SQL |= {
    "q14_gate": f"{_gate_sql('SELECT * FROM E WHERE src <> ' + chr(39) + 'n:0' + chr(39), 'SELECT * FROM E')} SELECT new_cycles, lost_callers, new_orphans, new_cycles = 0 AND lost_callers = 0 AS ok FROM P",
    "q17_simulate_delete": f"{_gate_sql('SELECT * FROM E', f'SELECT * FROM E WHERE src NOT IN {_GONE} AND dst NOT IN {_GONE}', f'SELECT * FROM N WHERE id NOT IN {_GONE}')} SELECT new_cycles, lost_callers FROM P",
}
