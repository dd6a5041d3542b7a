"""Queries of name resolution, findings and statistics; their inputs are derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.paths import LANGUAGES, language_of
from loomgraph.operators import findings, resolution, series
from loomgraph.plans.graph_queries import COMMERCE, TRADE
from loomgraph.sources.adapters import commerce, trade
from loomgraph.session import table


def _name(prefix: str, number: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(number) if isinstance(number, str) else number).cast("string"))


def _half(k: Column, by: int) -> Column:
    return F.floor(k / by).cast("long")


def x15_re_exports(spark, d):
    """Customers as files: every seventh defines the symbol, every fifth forwards by stars, the others by a renamed re-export."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k, _name("c", "c_custkey").alias("file"), F.lit("f").alias("name"))
    renames = c.where((k % 5 != 0) & (k > 1)).select("file", "name", _name("c", _half(k, 2)).alias("target"), F.lit("f").alias("orig"))
    stars = c.where((k % 5 == 0) & (k > 1)).select("file", F.posexplode(F.array(_name("c", _half(k, 3)), _name("c", _half(k, 2)))).alias("pos", "target"))
    return resolution.resolve_re_exports(c, c.where(k % 7 == 3), renames, stars).select("file", "name", "at_file", "at_name")


def x16_default_exports(spark, d):
    k = F.col("p_partkey")
    forms = [F.format_string(f, k) for f in ("export default class X%s {}", "const a = 1; export { X%s as default };", "export default X%s;", "module.exports = X%s;")]
    text = F.coalesce(*[F.when(k % 5 == i, f) for i, f in enumerate(forms)], F.format_string("export const X%s = 1;", k))
    files = table(spark, d, "part").select(_name("f", "p_partkey").alias("file"), text.alias("text"), _name("X", "p_partkey").alias("name"), k.alias("k"))
    return resolution.default_export(files, files.where("k % 11 <> 0"))


def x17_bindings(spark, d):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit("import D"), k, F.lit(", { a"), k, F.lit(" as b"), k, F.lit(", c"), k, F.lit(" } from './x"), k, F.lit("';\nimport * as N from \"y\";\nconst { p"), k, F.lit(", q: r"), k, F.lit(" } = require('z');\nvar R = require('w"), k, F.lit("');\n"),
    )
    return resolution.import_bindings(table(spark, d, "supplier").select(_name("f", "s_suppkey").alias("file"), text.alias("text")))


def x23_public_api(spark, d):
    """Parts as symbols of 50 files; two entry files."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    nodes = p.select(_name("p", "p_partkey").alias("id"), _name("f", k % 50).alias("file"), _name("l", k % 8).alias("label"), (k % 3 != 0).alias("exports"), F.when(k % 17 == 0, "module").otherwise("function").alias("kind"))
    i = p.select((k % 50).alias("i")).distinct()
    re_exports = i.select(_name("f", "i").alias("file"), _name("f", (2 * F.col("i") + 1) % 50).alias("target"), F.lit(None).cast("string").alias("name"))
    re_exports = re_exports.union(i.select(_name("f", "i"), _name("f", (F.col("i") + 7) % 50), _name("l", F.col("i") % 8)))
    return resolution.public_api(nodes, i.where("i IN (1, 4)").select(_name("f", "i").alias("file")), re_exports)


def x24_typed_receivers(spark, d):
    k = F.col("p_partkey")
    t = k % 97
    methods = table(spark, d, "part").select(_name("m", "p_partkey").alias("id"), F.when(t < 50, _name("s", t % 10)).otherwise(_name("s", "p_size")).alias("file"), _name("T", t).alias("owner"), _name("m", k % 13).alias("label"))
    intents = table(spark, d, "lineitem").select(
        _name("o", "l_orderkey").alias("src"), F.when(F.col("l_orderkey") % 4 == 0, "tests/a.js").otherwise("src/a.js").alias("src_file"), _name("T", F.col("l_partkey") % 120).alias("type"), _name("m", F.col("l_suppkey") % 13).alias("method"),
    )
    return resolution.typed_receivers(intents, methods)


def x27_append_edges(spark, d):
    """The trade graph and its edges turned round; some of their ends are no nodes."""
    n, e = trade(spark, d)
    turned = e.select(F.col("dst").alias("src"), F.when(F.col("weight") % 2 == 0, F.col("src")).otherwise(F.concat("src", F.lit("x"))).alias("dst"), "kind", "weight")
    return resolution.append_edges(e, turned.union(e), n)


#: Lines of code around a call of S, by number.
CALL_FORMS = (
    "const { a, b: c, ...rest } = await S(x, y);", "if (S(x) === null) return;", "try {", "S(g(x), [1, 2]);", "} catch (e) {", "S(a, b, c).catch(stop);",
    "// S(old)", "let v = S('a, b')?.r;", "y = S(z).total + 1;", "if (!S()) stop();", "S(", "w = S(k) ?? d;",
)


def x28_reliance(spark, d):
    """Orders as bodies, a line of code for each of their lines; symbols are called by the lines of their suppliers."""
    label = lambda x: F.concat(F.lit("f"), (x["l_suppkey"] % 7).cast("string"))
    form = lambda x: F.element_at(F.array(*map(F.lit, CALL_FORMS)), (x["l_partkey"] % len(CALL_FORMS) + 1).cast("int"))
    bodies = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.replace(form(x), F.lit("S"), label(x))), "\n")
    callers = bodies.select("l_orderkey", F.array_distinct(F.transform("lines", label)).alias("labels"), text.alias("text")).select(F.explode("labels").alias("label"), _name("o", "l_orderkey").alias("caller"), "text")
    return findings.reliance(callers.select(F.col("label").alias("id"), "label", "caller", "text"))


def x10_languages(spark, d):
    """Parts as paths over all extensions."""
    ext = [*LANGUAGES, "txt"]
    k = F.col("p_partkey")
    path = F.concat(F.lit("src/f"), k.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ext)), (k % len(ext) + 1).cast("int")))
    return table(spark, d, "part").select(language_of(path).alias("language")).groupBy("language").agg(F.count("*").alias("n"))


def p7_declarations(spark, d):
    k = F.col("p_partkey")
    nodes = table(spark, d, "part").select(
        k.alias("id"), F.concat(F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("lib"), (k % 6).cast("string"), F.lit("/"))), F.when(k % 4 == 0, "a.d.ts").otherwise("a.ts")).alias("file"),
        F.when(k % 9 == 0, "module").otherwise("function").alias("kind"), F.when(k % 5 == 0, "Misc").when(k % 5 == 1, F.col("p_brand")).when(k % 5 == 2, "unassigned").when(k % 5 == 3, F.concat(F.col("p_brand"), F.lit(" loose"))).alias("domain"), F.lit("x").alias("t3"),
    )
    return resolution.pruned(resolution.declarations_out(nodes)).groupBy("domain", "file").agg(F.count("*").alias("n"))


def p9_caveats(spark, d):
    n, e = commerce(spark, d)
    n = n.join(e.where("kind = 'call'").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("fan_in")), "id", "left")
    out = resolution.zero_caller_caveat(F.coalesce("fan_in", F.lit(0)), F.col("exports") & (F.col("loc") % 2 == 0), F.col("exports"), F.col("loc") % 3 == 0)
    return n.select("domain", out.alias("caveat")).groupBy("domain", "caveat").agg(F.count("*").alias("n"))


def w4_folded(spark, d):
    """Neighbouring parts as similar pairs, folded by their brands."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    a, b = p.select(k, _name("p", "p_partkey").alias("a"), F.col("p_brand").alias("label_a")), p.select((k - 1).alias("p_partkey"), _name("p", "p_partkey").alias("b"), F.col("p_brand").alias("label_b"))
    return findings.folded(a.join(b, "p_partkey").select("a", "b", "label_a", "label_b", (k % 10 / 10).alias("sim")))


def w11_findings(spark, d):
    """Brands as findings: M14 gives the severity, W11 the order and the names."""
    g = table(spark, d, "part").groupBy("p_brand").agg(F.countDistinct("p_size").alias("files"), F.countDistinct(F.substring_index("p_type", " ", 1)).alias("domains"), F.count("*").alias("rank"))
    g = g.withColumn("files", F.col("files") % 7).withColumn("domains", F.col("domains") % 4)
    conf = F.when(F.col("rank") % 3 == 0, "high").when(F.col("rank") % 3 == 1, "medium").otherwise("low")
    return findings.final_order(g.select(F.col("p_brand").alias("identity"), findings.severity(F.col("files"), F.col("domains")).alias("severity"), conf.alias("confidence"), "rank"))


def m9_structural(spark, d):
    """Orders of one customer as a group whose bodies cannot be read."""
    n, e = commerce(spark, d)
    members = table(spark, d, "orders").select(_name("c", "o_custkey").alias("group"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id")).join(n.select("id", "loc"), "id")
    return findings.structural_confidence(members, e, n.select("id", "label"))


def a9_upper_median(spark, d):
    return series.upper_medians(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


def a17_rates(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 1e9).alias("hits"), F.count("*").alias("n"))
    return n.select("event_type", "hits", "n", F.round(series.rule_of_three(F.col("hits"), F.col("n")), 9).alias("upper"))


def a17_cliffs_delta(spark, d):
    return series.cliffs_delta(table(spark, d, "events"), "event_type", "value", "purchase", "click").select(F.round("delta", 9).alias("delta"))


def a17_paired(spark, d):
    got = series.paired_interval(table(spark, d, "lineitem"), "l_discount", "l_tax")
    return got.select(*[F.round(c, 9).alias(c) for c in ("mean", "lo", "hi")], "n")


def a17_bootstrap(spark, d):
    return series.bootstrap_interval(table(spark, d, "events"), "value", "event_id").select(*[F.round(c, 6).alias(c) for c in ("lo", "hi")])


def q29_context(spark, d):
    """Documents as bodies on lines of a file per source, named by their first word; each is called by the documents that have its id's remainder."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    k = F.col("doc_id")
    nodes = docs.select(_name("d:", "doc_id").alias("id"), F.regexp_extract("text", r"\w+", 0).alias("label"), (k * 10 + 1).cast("int").alias("line"), F.size(F.split("text", "\n")).alias("loc"), "text")
    edges = docs.where("doc_id >= 25").select(_name("d:", "doc_id").alias("src"), _name("d:", k % 25).alias("dst"), F.lit("call").alias("kind"))
    return findings.context_pack(nodes, edges, spark.createDataFrame([("d:3",), ("d:7",)], "id string"), nodes.select("id", "line", "text"))


QUERIES = {f.__name__: f for f in (
    x10_languages, x15_re_exports, x16_default_exports, x17_bindings, x23_public_api, x24_typed_receivers, x27_append_edges, x28_reliance, p7_declarations, p9_caveats, w4_folded, w11_findings, m9_structural,
    a9_upper_median, a17_rates, a17_cliffs_delta, a17_paired, a17_bootstrap, q29_context,
)}

_EXT = [*LANGUAGES, "txt"]
_LINES = "SELECT id, line, n, unnest(string_split(text, chr(10))) AS code, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM B"
ORACLE_SQL = {
    "x10_languages": f"SELECT CASE {' '.join(f'WHEN p_partkey % {len(_EXT)} = {i} THEN {chr(39)}{LANGUAGES.get(x, chr(106) + chr(97) + chr(118) + chr(97) + "script")}{chr(39)}' for i, x in enumerate(_EXT))} END AS language, count(*) AS n FROM part GROUP BY 1",
    "x15_re_exports": """WITH RECURSIVE T AS (SELECT c_custkey AS k, 0 AS r, c_custkey // 2 AS t FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey > 1 UNION ALL SELECT c_custkey, 1, c_custkey // 3 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey > 1 UNION ALL SELECT c_custkey, 2, c_custkey // 2 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey > 1),
W AS (SELECT c_custkey AS w, c_custkey AS k, CAST([] AS INTEGER[]) AS way FROM customer UNION ALL SELECT w, T.t, list_append(way, T.r) FROM W JOIN T ON T.k = W.k WHERE W.k % 7 <> 3),
H AS (SELECT w, k, row_number() OVER (PARTITION BY w ORDER BY way) AS r FROM W WHERE k % 7 = 3 AND k IN (SELECT c_custkey FROM customer)) SELECT 'c' || w AS file, 'f' AS name, 'c' || k AS at_file, 'f' AS at_name FROM H WHERE r = 1""",
    "x16_default_exports": "SELECT 'f' || p_partkey AS file, 'X' || p_partkey AS name FROM part WHERE p_partkey % 5 < 4 AND p_partkey % 11 <> 0",
    "x17_bindings": """WITH S AS (SELECT s_suppkey AS k FROM supplier) SELECT 'f' || k AS file, 'D' || k AS local, 'default' AS imported, './x' || k AS target, 'default' AS form FROM S UNION ALL SELECT 'f' || k, 'b' || k, 'a' || k, './x' || k, 'named' FROM S UNION ALL SELECT 'f' || k, 'c' || k, 'c' || k, './x' || k, 'named' FROM S
UNION ALL SELECT 'f' || k, 'N', '*', 'y', 'namespace' FROM S UNION ALL SELECT 'f' || k, 'p' || k, 'p' || k, 'z', 'named' FROM S UNION ALL SELECT 'f' || k, 'r' || k, 'q', 'z', 'named' FROM S UNION ALL SELECT 'f' || k, 'R', '*', 'w' || k, 'namespace' FROM S""",
    "x23_public_api": """WITH RECURSIVE V AS (SELECT 'p' || p_partkey AS id, p_partkey % 50 AS f, p_partkey % 8 AS l FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 17 <> 0), I AS (SELECT DISTINCT p_partkey % 50 AS i FROM part),
R AS (SELECT i FROM I WHERE i IN (1, 4) UNION SELECT (2 * R.i + 1) % 50 FROM R JOIN I ON I.i = R.i) SELECT DISTINCT id FROM V WHERE f IN (SELECT i FROM R) OR EXISTS (SELECT 1 FROM R JOIN I ON I.i = R.i WHERE (R.i + 7) % 50 = V.f AND R.i % 8 = V.l)""",
    "x24_typed_receivers": """WITH M AS (SELECT 'm' || p_partkey AS id, p_partkey % 97 AS t, 's' || CASE WHEN p_partkey % 97 < 50 THEN p_partkey % 97 % 10 ELSE p_size END AS file, p_partkey % 13 AS l FROM part), K AS (SELECT t FROM M GROUP BY t HAVING count(DISTINCT file) = 1), G AS (SELECT t, l, min(id) AS dst FROM M GROUP BY t, l)
SELECT DISTINCT 'o' || l_orderkey AS src, dst, CASE WHEN l_orderkey % 4 = 0 THEN 'test' ELSE 'call' END AS kind, 1 AS weight FROM lineitem JOIN K ON K.t = l_partkey % 120 JOIN G ON G.t = K.t AND G.l = l_suppkey % 13""",
    "x27_append_edges": f"{TRADE}, T AS (SELECT dst AS src, CASE WHEN weight % 2 = 0 THEN src ELSE src || 'x' END AS dst, kind, weight FROM E) SELECT src, dst, kind, weight FROM E UNION ALL SELECT src, dst, kind, min(weight) FROM T WHERE src <> dst AND src IN (SELECT id FROM N) AND dst IN (SELECT id FROM N) AND (src, dst, kind) NOT IN (SELECT src, dst, kind FROM E) GROUP BY 1, 2, 3",
    "x28_reliance": """WITH L AS (SELECT 'f' || l_suppkey % 7 AS id, l_orderkey AS o, l_partkey % 12 AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem),
D AS (SELECT *, sum(CASE m WHEN 2 THEN 1 WHEN 4 THEN -1 ELSE 0 END) OVER (PARTITION BY o ORDER BY r) AS s FROM L), C AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY o ORDER BY r)) AS open FROM D), T AS (SELECT *, coalesce(lag(open) OVER (PARTITION BY o ORDER BY r), 0) AS tries FROM C),
A AS (SELECT *, CASE WHEN m = 10 THEN NULL WHEN m IN (7, 9) THEN 0 WHEN m IN (1, 8, 11) THEN 1 WHEN m = 5 THEN 3 ELSE 2 END AS args FROM T WHERE m NOT IN (2, 4, 6)),
F AS (SELECT id, unnest(CASE m WHEN 0 THEN ['a', 'b'] WHEN 8 THEN ['total'] ELSE [] END) AS x FROM A), G AS (SELECT id, string_agg(DISTINCT x, ',' ORDER BY x) AS fields FROM F GROUP BY id)
SELECT A.id, count(*) AS n_sites, count(*) FILTER (WHERE m IN (0, 5)) AS awaited, coalesce(any_value(fields), '') AS fields, CAST(min(args) AS INTEGER) AS least_args, CAST(max(args) AS INTEGER) AS most_args,
count(*) FILTER (WHERE tries > 0 OR m = 5) AS handles_errors, count(*) FILTER (WHERE m IN (1, 7, 9, 11)) AS null_checked FROM A LEFT JOIN G ON G.id = A.id GROUP BY A.id""",
    "p7_declarations": "WITH P AS (SELECT p_partkey AS k, p_brand, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'lib' || p_partkey % 6 END AS dir FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 9 <> 0) SELECT CASE WHEN k % 5 = 1 THEN p_brand WHEN dir = '' THEN '(root)' ELSE dir END AS domain, CASE WHEN dir = '' THEN 'a.ts' ELSE dir || '/a.ts' END AS file, count(*) AS n FROM P GROUP BY 1, 2",
    "p9_caveats": f"{COMMERCE}, A AS (SELECT DISTINCT dst FROM E WHERE kind = 'call') SELECT domain, CASE WHEN id IN (SELECT dst FROM A) THEN '' WHEN exports AND loc % 2 = 0 THEN 'public API: callers may be outside' WHEN exports THEN 'exported: callers may be outside' WHEN loc % 3 = 0 THEN 'dynamic calls in this file' ELSE 'no caller found' END AS caveat, count(*) AS n FROM N GROUP BY 1, 2",
    "w4_folded": """WITH P AS (SELECT 'p' || x.p_partkey AS a, 'p' || y.p_partkey AS b, least(x.p_brand, y.p_brand) AS l1, greatest(x.p_brand, y.p_brand) AS l2, (x.p_partkey % 10) / 10 AS sim FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1),
R AS (SELECT *, row_number() OVER (PARTITION BY l1, l2 ORDER BY sim DESC, a, b) AS r, count(*) OVER (PARTITION BY l1, l2) AS n FROM P), F AS (SELECT * FROM R WHERE r = 1), O AS (SELECT R.l1, R.l2, unnest([R.a, R.b]) AS x FROM R)
SELECT F.l1, F.l2, F.a, F.b, F.sim, n - 1 AS folded, coalesce((SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM O WHERE O.l1 = F.l1 AND O.l2 = F.l2 AND x <> F.a AND x <> F.b), '') AS more FROM F""",
    "w11_findings": """WITH G AS (SELECT p_brand AS identity, count(DISTINCT p_size) % 7 AS f, count(DISTINCT split_part(p_type, ' ', 1)) % 4 AS m, count(*) AS rank FROM part GROUP BY 1),
S AS (SELECT identity, CASE WHEN greatest(f, m) >= 5 THEN 'high' WHEN greatest(f, m) >= 3 THEN 'medium' ELSE 'low' END AS severity, CASE rank % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, rank FROM G)
SELECT *, 'ov' || row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, CASE confidence WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END DESC, rank DESC, identity) AS id FROM S""",
    "m9_structural": f"""{COMMERCE}, M AS (SELECT 'c' || o_custkey AS grp, id, loc FROM orders JOIN N ON id = 'o:' || o_orderkey), G AS (SELECT grp, count(DISTINCT id) AS n, CASE WHEN avg(loc) <> 0 THEN stddev_pop(loc) / avg(loc) ELSE 0 END AS cv FROM M GROUP BY grp),
C AS (SELECT DISTINCT grp, M.id, N.label FROM M JOIN E ON E.src = M.id AND E.kind = 'call' JOIN N ON N.id = E.dst), Q AS (SELECT grp, count(DISTINCT id) AS callers FROM C GROUP BY grp HAVING count(DISTINCT id) >= 2),
S AS (SELECT grp, count(*) AS shared FROM (SELECT C.grp, label FROM C JOIN Q ON Q.grp = C.grp GROUP BY C.grp, label, callers HAVING count(*) = callers) GROUP BY grp),
Z AS (SELECT G.grp, n, coalesce(shared, 0) AS shared, round(cv, 9) AS cv, CAST(CASE WHEN shared > 0 THEN 2 ELSE 0 END + CASE WHEN cv < 0.4 THEN 1 ELSE 0 END AS INTEGER) AS score FROM G LEFT JOIN S ON S.grp = G.grp) SELECT grp AS "group", n, shared, cv, score, CASE WHEN score >= 2 THEN 'high' WHEN score = 1 THEN 'medium' ELSE 'low' END AS confidence FROM Z""",
    "a9_upper_median": "SELECT l_returnflag, list_sort(list(l_extendedprice))[len(list(l_extendedprice)) // 2 + 1] AS upper_median FROM lineitem GROUP BY 1",
    "a17_rates": "SELECT event_type, count(*) FILTER (WHERE value > 1e9) AS hits, count(*) AS n, round(CASE WHEN count(*) FILTER (WHERE value > 1e9) = 0 THEN least(1.0, 3.0 / count(*)) END, 9) AS upper FROM events GROUP BY 1",
    "a17_cliffs_delta": "WITH A AS (SELECT value FROM events WHERE event_type = 'purchase'), B AS (SELECT value FROM events WHERE event_type = 'click') SELECT round(avg(sign(A.value - B.value)), 9) AS delta FROM A, B",
    "a17_paired": "WITH D AS (SELECT avg(l_discount - l_tax) AS m, stddev_samp(l_discount - l_tax) AS s, count(*) AS n FROM lineitem) SELECT round(m, 9) AS mean, round(m - 1.959963984540054 * s / sqrt(n), 9) AS lo, round(m + 1.959963984540054 * s / sqrt(n), 9) AS hi, n FROM D",
    "a17_bootstrap": f"""WITH H AS (SELECT value AS v, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % {series.PRIME} AS h FROM events WHERE value IS NOT NULL AND event_id IS NOT NULL),
R AS (SELECT unnest({[pow(series.ROOT, k, series.PRIME) for k in range(1, 201)]}) AS f), W AS (SELECT f, v, (h * f % {series.PRIME} + 0.5) / {series.PRIME} AS u FROM H, R), M AS (SELECT f, sum(v * n) / sum(n) AS mean FROM (SELECT f, v, {" + ".join(f"CAST(u > {x!r}::DOUBLE AS INTEGER)" for x in series.poisson_steps())} AS n FROM W) GROUP BY f)
SELECT round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM M""",
    "q29_context": rf"""WITH B AS (SELECT 'd:' || doc_id AS id, doc_id AS k, regexp_extract(text, '\w+') AS label, CAST(doc_id * 10 + 1 AS INTEGER) AS line, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n, text FROM documents WHERE text IS NOT NULL),
C AS (SELECT id FROM B WHERE k >= 25 AND k % 25 IN (3, 7)), W AS (SELECT DISTINCT label FROM B WHERE id IN ('d:3', 'd:7')), L AS ({_LINES}),
H AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM L WHERE id IN (SELECT id FROM C) AND list_has_any(regexp_extract_all(code, '\w+'), (SELECT list(label) FROM W))),
S AS (SELECT id, pos, line + pos AS hit, greatest(line, line + pos - 3) AS s, least(line + n - 1, line + pos + 3) AS e FROM H WHERE r <= 8), I AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY id ORDER BY pos) + 1 THEN 0 ELSE 1 END AS gap FROM S),
J AS (SELECT *, sum(gap) OVER (PARTITION BY id ORDER BY pos) AS isle FROM I), X AS (SELECT 'caller' AS section, id, CAST(min(s) AS INTEGER) AS "start", CAST(max(e) AS INTEGER) AS "end", string_agg(CAST(hit AS VARCHAR), ',' ORDER BY hit) AS calls FROM J GROUP BY id, isle)
SELECT 'target' AS section, id, line AS "start", line + n - 1 AS "end", '' AS calls FROM B WHERE id IN ('d:3', 'd:7') UNION ALL SELECT * FROM X UNION ALL SELECT 'caller', id, line, line + n - 1, '' FROM B WHERE id IN (SELECT id FROM C) AND id NOT IN (SELECT id FROM X) UNION ALL SELECT 'blast', id, 0, 0, '' FROM C""",
}
