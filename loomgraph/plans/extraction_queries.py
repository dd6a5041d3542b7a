"""Extraction queries over a source tree made of the documents; the SQL knows from the words what each file holds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import codemod, dispatch, edges, extraction
from loomgraph.session import Stored, table
from loomgraph.sources.trees import TREE_SQL, class_tree, document_tree


def _tree(spark, d, of=document_tree):
    """A tree's files and symbols, written once: every branch of the queries below reads them."""
    t = Stored(of(spark, d), "tree").read()
    return t, Stored(extraction.symbols(t), "symbols").read()


def x1_masking(spark, d):
    """Every file with comments and strings blanked, and with comments alone."""
    t = document_tree(spark, d)
    return t.select("file", F.md5(extraction.mask(F.col("text"), F.col("language"))).alias("masked"), F.length("text").alias("n"))


def x2_symbols(spark, d):
    return extraction.symbols(document_tree(spark, d)).select("id", "file", "label", "kind", "owner", "line", "end", "exports")


def x4_signatures(spark, d):
    t = document_tree(spark, d)
    lines = t.select("file", F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike(r"^export function"))
    return lines.select("file", F.regexp_extract("l", r"function (\w+)", 1).alias("label"), F.array_join(extraction.signature(F.col("l"), F.lit("")), ",").alias("params"))


def x9_dynamic(spark, d):
    return extraction.dynamic_files(document_tree(spark, d))


def x12_owners(spark, d):
    return extraction.owners(extraction.symbols(document_tree(spark, d))).select("file", "label", "owner")


def x14_modules(spark, d):
    """Documents as modules of five packages; each asks for the module of twice its number, with and without its package, and for a package."""
    k = F.col("doc_id")
    files = table(spark, d, "documents").select(k, F.concat(F.lit("src/p"), (k % 5).cast("string"), F.lit("/m"), k.cast("string"), F.lit(".py")).alias("file"))
    name = F.concat(F.lit("m"), (2 * k).cast("string"))
    package = F.concat(F.lit("p"), (2 * k % 5).cast("string"))
    wanted = files.select("file", F.explode(F.array(F.concat_ws(".", package, name), name, package)).alias("module"))
    return extraction.resolve_modules(wanted, files.select("file")).select("file", "module", "target")


def x17_aliases(spark, d):
    """Names that imports bind to symbols of other files."""
    t, s = _tree(spark, d)
    return edges.bound_names(t, s)[0]


def x18_edges(spark, d):
    t, s = _tree(spark, d)
    return edges.edges(t, s, t.select("file", "package"))


def x19_dropped(spark, d):
    """Mentions that give no edge, by reason."""
    t, s = _tree(spark, d)
    return edges.ladder(t, s, *edges.bound_names(t, s), t.select("file", "package")).where("why IS NOT NULL").groupBy("file", "form", "why").agg(F.count("*").alias("n"))


def x21_closures(spark, d):
    return extraction.closure_locals(extraction.symbols(document_tree(spark, d))).select("file", "label")


def x22_packages(spark, d):
    """Directories of even packages, and the tests of all, have a manifest."""
    t = document_tree(spark, d)
    dirs = t.where(F.substring("package", 4, 9).cast("int") % 2 == 0).select(F.col("package").alias("dir")).union(t.select(F.concat("package", F.lit("/tests")))).distinct()
    return extraction.package_of(t.select("file"), dirs)


def x26_intents(spark, d):
    """Calls through a receiver in seven languages."""
    return dispatch.intents(*_tree(spark, d, class_tree))


def x26_dispatch(spark, d):
    """The methods they mean, the classes' ancestors looked through."""
    t, s = _tree(spark, d, class_tree)
    up = edges.edges(t, s, aliases=spark.createDataFrame([], "file string, local string, id string"), namespaces=spark.createDataFrame([], "file string, local string, target string")).where("kind = 'inherit'")
    return dispatch.dispatch_edges(dispatch.intents(t, s), s, dispatch.ranked_ancestors(up))


def q32_edits(spark, d):
    """The functions of one name in a package as groups; the edits that leave the one with the smallest id."""
    t, s = _tree(spark, d)
    named = s.where("kind = 'function' AND NOT local").join(t.select("file", "package"), "file")
    w = Window.partitionBy("package", "label")
    groups = named.select(F.concat_ws("/", "package", "label").alias("group"), "id", F.min("id").over(w).alias("canonical"), F.count("*").over(w).alias("n")).where("n > 1")
    e = Stored(edges.edges(t, s, t.select("file", "package")), "edges").read()
    out, _ = codemod.merge_edits(t, s, e, groups.drop("n"))
    return out


QUERIES = {f.__name__: f for f in (x1_masking, x2_symbols, x4_signatures, x9_dynamic, x12_owners, x14_modules, x17_aliases, x18_edges, x19_dropped, x21_closures, x22_packages, x26_intents, x26_dispatch, q32_edits)}

#: S: the symbols; M: the mentions, with what the imports, the file and the package make of them.
_SYMBOLS = f"""WITH {TREE_SQL}, S AS (SELECT file || ':C_' || w[8] AS id, file, package, role, 'C_' || w[8] AS label, 'class' AS kind, NULL AS owner, 3 AS line, 5 AS e, true AS exports FROM T
UNION ALL SELECT file || ':C_' || w[8] || '.' || w[1], file, package, role, w[1], 'method', 'C_' || w[8], 4, 4, false FROM T UNION ALL SELECT file || ':' || w[2], file, package, role, w[2], 'function', NULL, 7, 11, true FROM T
UNION ALL SELECT file || ':in_' || w[8], file, package, role, 'in_' || w[8], 'function', NULL, 9, 9, false FROM T)"""
_EDGES = f"""{_SYMBOLS}, A AS (SELECT file, w[6] AS name, fi || ':' || a AS id FROM T WHERE fi IS NOT NULL),
L AS (SELECT file, package, role, file || ':C_' || w[8] AS src, 'inherit' AS form, 'C_' || w[4] AS name, false AS bound FROM T UNION ALL SELECT file, package, role, file || ':C_' || w[8] || '.' || w[1], 'call', w[3], false FROM T
UNION ALL SELECT file, package, role, file || ':' || w[2], unnest(['call', 'call', 'ref', 'ref', 'ref', 'ref', 'call']), unnest([w[3], w[4], w[1], w[5], 'q_r', w[6], w[6]]), unnest([true, false, false, false, true, false, false]) FROM T
UNION ALL SELECT file, package, role, file || ':in_' || w[8], 'call', w[4], false FROM T UNION ALL SELECT file, package, role, file || ':<module>', unnest(['call', 'ref']), unnest([w[6], w[1]]), false FROM T),
U AS (SELECT package, label AS name, count(*) AS n, min(id) AS id, min(role) AS role FROM S WHERE label NOT LIKE 'in\\_%' ESCAPE '\\' GROUP BY 1, 2),
M AS (SELECT L.file, L.role, L.src, L.form, coalesce(A.id, o.id) AS known, U.id AS one, U.role AS one_role, coalesce(U.n, 0) AS n, bound FROM L LEFT JOIN A ON A.file = L.file AND A.name = L.name LEFT JOIN S o ON o.file = L.file AND o.label = L.name LEFT JOIN U ON U.package = L.package AND U.name = L.name),
R AS (SELECT *, CASE WHEN known IS NOT NULL THEN NULL WHEN form <> 'inherit' AND bound THEN 'bound' WHEN n = 0 THEN 'unknown' WHEN n > 1 THEN 'ambiguous' WHEN form = 'ref' AND role = 'src' AND one_role <> 'src' THEN 'role' END AS why FROM M)"""

#: C: the classes with their base and their parameter's type; I: the calls through a receiver (Ruby knows no types). Classes of php, py, java and cs have bases.
_CLASSES = f"""{TREE_SQL}, C AS (SELECT T.k, 't' || T.k || '.' || ['rb', 'php', 'py', 'go', 'rs', 'java', 'cs'][T.k % 7 + 1] AS file, 'T_' || T.w[8] AS label, T.w[1] AS m1, T.w[2] AS m2, 'T_' || coalesce(b.w[8], 'Object') AS base, coalesce(b.w[2], 'none') AS h, 'T_' || coalesce(p.w[8], 'Object') AS type, coalesce(p.w[1], 'none') AS m
FROM T LEFT JOIN T b ON b.k = T.k - 49 LEFT JOIN T p ON p.k = T.k - 98),
I AS (SELECT DISTINCT file || ':' || label || '.' || m1 AS src, file, unnest([label, label, type]) AS type, unnest([m2, h, m]) AS method, unnest([true, true, false]) AS own, k FROM C), J AS (SELECT src, file, type, method, own FROM I WHERE own OR k % 7 <> 0)"""

ORACLE_SQL = {
    "x1_masking": rf"""WITH {TREE_SQL}, P AS (SELECT file, k, w, a, b, 'import {{ ' || a || ' as ' || w[6] || ' }} from ' AS l1, '''./f' || (k - 35) || '.js''' AS q1, ' import {{ ' || w[1] || ' }} from ''./f' || (k - 35) || '.js''' AS c1, '''./f' || (k - 70) || '.js''' AS q2,
'/* ' || w[2] || '(' || w[3] || ') */' AS c6, '''' || w[5] || '(''' AS q8 FROM T),
Q AS (SELECT file, l1 || repeat(' ', length(q1)) || '; ' || repeat(' ', length(c1) + 2) || chr(10) || 'import * as ' || w[7] || ' from ' || repeat(' ', length(q2)) || ';' || chr(10) || 'export class C_' || w[8] || ' extends C_' || w[4] || ' {{' || chr(10)
|| '  ' || w[1] || '(p_q, ' || w[2] || ') {{ return ' || w[3] || '(p_q, ' || w[5] || ', ' || w[2] || '); }}' || chr(10) || '}}' || chr(10) || repeat(' ', length(c6)) || chr(10) || 'export function ' || w[2] || '(' || w[3] || ', q_r) {{' || chr(10)
|| '  ' || w[3] || '(q_r); ' || w[4] || '(' || w[1] || ', ' || repeat(' ', length(q8)) || ', ' || w[5] || ');' || chr(10) || '  function in_' || w[8] || '() {{ ' || w[4] || '(); }}' || chr(10)
|| '  return ' || w[7] || '.' || b || '(' || w[6] || ') instanceof C_' || w[8] || ' ? C_' || w[4] || '.' || w[1] || '() : ' || repeat(' ', length(w[5]) + 5) || w[6] || '(1)  ;' || chr(10) || '}}' || chr(10) || w[6] || '(' || w[1] || ');' || CASE WHEN k % 3 = 0 THEN chr(10) || 'handlers[' || w[1] || '](2);' ELSE '' END AS m FROM P) SELECT file, md5(m) AS masked, CAST(length(m) AS INTEGER) AS n FROM Q""".replace("{{", "{").replace("}}", "}"),
    "x2_symbols": f'{_SYMBOLS} SELECT id, file, label, kind, owner, CAST(line AS INTEGER) AS line, CAST(e AS INTEGER) AS "end", exports FROM S',
    "x4_signatures": f"WITH {TREE_SQL} SELECT file, w[2] AS label, w[3] || ',q_r' AS params FROM T",
    "x9_dynamic": f"WITH {TREE_SQL} SELECT file FROM T WHERE k % 3 = 0",
    "x12_owners": f"WITH {TREE_SQL} SELECT file, w[1] AS label, 'C_' || w[8] AS owner FROM T",
    "x14_modules": """WITH F AS (SELECT doc_id AS k, 'src/p' || doc_id % 5 || '/m' || doc_id || '.py' AS file FROM documents), A AS (SELECT file, unnest(['p' || 2 * k % 5 || '.m' || 2 * k, 'm' || 2 * k, 'p' || 2 * k % 5]) AS module, unnest([2 * k, -1, -1]) AS j FROM F)
SELECT A.file, A.module, F.file AS target FROM A LEFT JOIN F ON F.k = A.j""",
    "x17_aliases": f"{_EDGES} SELECT file, name AS local, id FROM A",
    "x18_edges": f"""{_EDGES}, E AS (SELECT src, coalesce(known, one) AS dst, form, role FROM R WHERE why IS NULL UNION ALL SELECT file || ':' || w[2], file || ':C_' || w[8], 'ref', role FROM T UNION ALL SELECT file || ':' || w[2], fj || ':' || b, 'call', role FROM T WHERE fj IS NOT NULL)
SELECT DISTINCT src, dst, CASE WHEN form <> 'inherit' AND E.role = 'tests' AND S.role <> 'tests' THEN 'test' ELSE form END AS kind, CAST(1 AS INTEGER) AS weight FROM E JOIN S ON S.id = E.dst WHERE src <> dst""",
    "x19_dropped": f"{_EDGES} SELECT file, form, why, count(*) AS n FROM R WHERE why IS NOT NULL GROUP BY 1, 2, 3",
    "x21_closures": f"WITH {TREE_SQL} SELECT file, 'in_' || w[8] AS label FROM T",
    "q32_edits": f"""{_EDGES}, G AS (SELECT T.*, package || '/' || w[2] AS grp, min(file || ':' || w[2]) OVER (PARTITION BY package, w[2]) AS best, count(*) OVER (PARTITION BY package, w[2]) AS n,
'import {{ ' || a || ' as ' || w[6] || ' }} from ''' AS p1, './f' || (k - 35) || '.js' AS s1, '''; // import {{ ' || w[1] || ' }} from ''./f' || (k - 35) || '.js''' AS q1, 'import * as ' || w[7] || ' from ''' AS p2, './f' || (k - 70) || '.js' AS s2 FROM T),
H AS (SELECT *, split_part(best, ':', 1) AS home, p1 || s1 || q1 || chr(10) AS l1 FROM G),
XX AS (SELECT *, l1 || p2 || s2 || ''';' || chr(10) || 'export class C_' || w[8] || ' extends C_' || w[4] || ' {{' || chr(10) || '  ' || w[1] || '(p_q, ' || w[2] || ') {{ return ' || w[3] || '(p_q, ' || w[5] || ', ' || w[2] || '); }}' || chr(10) || '}}' || chr(10) || '/* ' || w[2] || '(' || w[3] || ') */' || chr(10) AS head,
'export function ' || w[2] || '(' || w[3] || ', q_r) {{' || chr(10) || '  ' || w[3] || '(q_r); ' || w[4] || '(' || w[1] || ', ''' || w[5] || '('', ' || w[5] || ');' || chr(10) || '  function in_' || w[8] || '() {{ ' || w[4] || '(); }}' || chr(10)
|| '  return ' || w[7] || '.' || b || '(' || w[6] || ') instanceof C_' || w[8] || ' ? C_' || w[4] || '.' || w[1] || '() : `' || w[5] || '( $' || '{{' || w[6] || '(1)}}`;' || chr(10) || '}}' || chr(10) AS body FROM H),
Z AS (SELECT XX.*, o.grp AS g, o.home AS way, o.n > 1 AND o.file <> o.home AND XX.file <> o.home AS turns, 1 AS line FROM XX JOIN XX o ON o.file = XX.fi UNION ALL SELECT XX.*, o.grp, o.home, o.n > 1 AND o.file <> o.home AND XX.file <> o.home AND XX.w[7] = XX.b, 2 FROM XX JOIN XX o ON o.file = XX.fj),
Y AS (SELECT grp, file, length(head) AS s, length(head) + length(body) AS e, body AS old, '' AS new FROM XX WHERE n > 1 AND file <> home UNION ALL
SELECT g, file, CASE line WHEN 1 THEN length(p1) ELSE length(l1 || p2) END, CASE line WHEN 1 THEN length(p1 || s1) ELSE length(l1 || p2 || s2) END, CASE line WHEN 1 THEN s1 ELSE s2 END,
CASE WHEN string_split(way, '/')[2] = role THEN './' ELSE '../' || string_split(way, '/')[2] || '/' END || string_split(way, '/')[3] FROM Z WHERE turns)
SELECT grp AS "group", file, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", old, new FROM Y""",
    "x26_intents": f"WITH {_CLASSES} SELECT * FROM J",
    "x26_dispatch": f"""WITH RECURSIVE {_CLASSES}, D AS (SELECT file, label AS type, unnest([m1, m2]) AS method FROM C), U AS (SELECT label, min(file) AS file FROM C GROUP BY label HAVING count(*) = 1),
B AS (SELECT C.file, U.file AS up, U.label AS up_type FROM C JOIN U ON U.label = C.base WHERE k % 7 IN (1, 2, 5, 6) AND U.file <> C.file),
A AS (SELECT file, up, up_type, 1 AS n FROM B UNION SELECT A.file, B.up, B.up_type, n + 1 FROM A JOIN B ON B.file = A.up WHERE n < 1000),
P AS (SELECT J.*, CASE WHEN own THEN J.file ELSE U.file END AS home FROM J LEFT JOIN U ON U.label = J.type), H AS (SELECT P.*, D.method IS NOT NULL AS hit FROM P LEFT JOIN D ON D.file = home AND D.type = P.type AND D.method = P.method WHERE home IS NOT NULL),
R AS (SELECT H.src, H.method, H.type, up, up_type, row_number() OVER (PARTITION BY H.src, H.type, H.method, H.own ORDER BY n) AS r FROM H JOIN A ON A.file = H.home JOIN D ON D.file = A.up AND D.type = A.up_type AND D.method = H.method WHERE NOT hit),
E AS (SELECT src, home || ':' || type || '.' || method AS dst FROM H WHERE hit UNION SELECT src, up || ':' || up_type || '.' || method FROM R WHERE r = 1) SELECT src, dst, 'call' AS kind, CAST(1 AS INTEGER) AS weight FROM E WHERE src <> dst""",
    "x22_packages": f"WITH {TREE_SQL} SELECT file, CASE WHEN role = 'tests' THEN package || '/tests' WHEN k % 5 % 2 = 0 THEN package ELSE '' END AS package FROM T",
}
