from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.functions.paths import language_of
from loomgraph.operators import findings, resolution, series


def test_re_exports_follow_names_before_stars_and_stop_at_cycles(spark):
    wanted = spark.createDataFrame([("i", "a"), ("i", "b"), ("x", "f"), ("i", "none")], "file string, name string")
    symbols = spark.createDataFrame([("m", "b"), ("deep", "a0"), ("n", "a"), ("late", "b")], "file string, name string")
    renames = spark.createDataFrame([("i", "a", "deep", "a0"), ("x", "f", "y", "f"), ("y", "f", "x", "f")], "file string, name string, target string, orig string")
    stars = spark.createDataFrame([("i", 0, "n"), ("i", 1, "mid"), ("i", 2, "late"), ("mid", 0, "i"), ("mid", 1, "m")], "file string, pos int, target string")
    got = {(r.file, r.name): (r.at_file, r.at_name) for r in resolution.resolve_re_exports(wanted, symbols, renames, stars).collect()}
    assert got == {("i", "a"): ("deep", "a0"), ("i", "b"): ("m", "b")}


def test_public_api_receivers_and_appended_edges(spark):
    nodes = spark.createDataFrame([("1", "a.js", "f", True, "function"), ("2", "a.js", "<module>", True, "module"), ("3", "b.js", "g", True, "function"), ("4", "c.js", "h", True, "function"), ("5", "c.js", "k", True, "function"), ("6", "b.js", "p", False, "function")], "id string, file string, label string, exports boolean, kind string")
    out = resolution.public_api(nodes, spark.createDataFrame([("a.js",)], "file string"), spark.createDataFrame([("a.js", "b.js", None), ("b.js", "c.js", "h"), ("b.js", "a.js", None)], "file string, target string, name string"))
    assert {r.id for r in out.collect()} == {"1", "3", "4"}
    methods = spark.createDataFrame([("m1", "a.java", "A", "go"), ("m2", "b.java", "B", "go"), ("m3", "c.java", "B", "go")], "id string, file string, owner string, label string")
    intents = spark.createDataFrame([("s", "x.java", "A", "go"), ("s", "x.java", "B", "go"), ("t", "tests/t.java", "A", "go"), ("m1", "a.java", "A", "go"), ("s", "x.java", "A", "no")], "src string, src_file string, type string, method string")
    assert {(r.src, r.dst, r.kind) for r in resolution.typed_receivers(intents, methods).collect()} == {("s", "m1", "call"), ("t", "m1", "test")}
    e = spark.createDataFrame([("1", "3", "call", 1)], "src string, dst string, kind string, weight int")
    more = spark.createDataFrame([("1", "3", "call", 9), ("1", "3", "import", 1), ("1", "1", "call", 1), ("1", "99", "call", 1)], e.schema)
    assert resolution.append_edges(e, more, nodes).count() == 2
    assert resolution.append_edges(e, more, nodes, ("src", "dst")).count() == 1


def test_windows_statistics_and_names(spark):
    code = "\n".join("hit()" if i in (0, 2, 9, 20) else "x" for i in range(30))
    got = findings.call_windows(spark.createDataFrame([("c", 100, code)], "id string, line int, text string"), spark.createDataFrame([("hit",)], "label string"), 3).collect()
    assert sorted((r.start, r.end, r.calls) for r in got) == [(100, 112, "100,102,109"), (117, 123, "120")]
    v = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 3.0), ("b", 0.0), ("a", None)], "g string, v double")
    pairs = [(x > y) - (x < y) for x in (1, 3) for y in (2, 3, 0)]
    assert abs(series.cliffs_delta(v, "g", "v", "a", "b").first().delta - sum(pairs) / 6) < 1e-12
    assert {r.g: r.upper_median for r in series.upper_medians(v, "g", "v").collect()} == {"a": 3.0, "b": 2.0}
    many = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("v"))
    r = series.bootstrap_interval(many, "v", "id").first()
    assert 4.2 < r.lo < 4.5 < r.hi < 4.8
    p = spark.createDataFrame([("a.kts",), ("b.mts",), ("c.weird",), ("d.py",)], "p string")
    assert [x[0] for x in p.select(language_of(F.col("p"))).collect()] == ["kotlin", "typescript", "javascript", "python"]


def test_reliance_reads_each_call(spark):
    body = "\n".join([
        "const { a, b: c, ...rest } = await x.fn(g(1), [2, 3]);", "  try {", "fn(h(y))", "}", "catch (e) { fn() }  // fn(1)", "z = fn('p, q').total", "fn(1,", "const u = 'http://x' + fn(q, {a, b}).then(r)",
        "await other(); fn(v)", "const [k] = fn(w) === undefined ? 1 : 2; !fn(w)", "} finally { fn(1) }", "xfn(1); fnx(2)",
    ])
    callers = spark.createDataFrame([("s", "fn", "c1", body), ("s", "fn", "c2", "fn(a)?.b ?? 1"), ("d", "$d.e", "c1", "x$d.e(1, 2)\nx$dze(1)"), ("none", "nope", "c1", body)], "id string, label string, caller string, text string")
    got = {r.id: r for r in findings.reliance(callers).collect()}
    r = got["s"]
    assert (r.n_sites, r.awaited, r.fields, r.least_args, r.most_args) == (10, 2, "a,b,total", 0, 2)
    assert (r.handles_errors, r.null_checked) == (8, 2)  # the try ends where `}` and `finally` stand on one line
    assert got.keys() == {"s", "d"} and (got["d"].n_sites, got["d"].most_args) == (1, 2)
    assert {x.id: x.n_sites for x in findings.reliance(callers, 3).collect()}["s"] == 3
    mut = spark.createDataFrame([("m", ["p", "q", "r", "s", "t"], "p.x = 1\nif (q.x == 2) {}\nr[0] += 1\nObject.assign( s, {})\n// t.x = 1\nt.a.sort")], "id string, params array<string>, text string")
    assert {x.param for x in findings.mutated_parameters(mut).collect()} == {"p", "r", "s"}


def test_fallback_confidence_and_domains(spark):
    members = spark.createDataFrame([("g", "a", 10), ("g", "b", 10), ("g", "c", 90), ("h", "a", 10), ("h", "d", 90), ("i", "c", 5), ("i", "d", 5)], "group string, id string, loc int")
    edges = spark.createDataFrame([("a", "x", "call"), ("b", "y", "call"), ("a", "b", "import")], "src string, dst string, kind string")
    labels = spark.createDataFrame([("x", "run"), ("y", "run")], "id string, label string")
    got = {r.group: (r.shared, r.score, r.confidence) for r in findings.structural_confidence(members, edges, labels).collect()}
    assert got == {"g": (1, 2, "high"), "h": (0, 0, "low"), "i": (0, 1, "medium")}
    nodes = spark.createDataFrame([(str(i), f, "function", dom) for i, (f, dom) in enumerate([("lib/a.ts", "Unassigned"), ("a.ts", None), ("lib/b.ts", "core"), ("x/y.ts", "looseends"), ("Makefile", "")])], "id string, file string, kind string, domain string")
    assert [r.domain for r in resolution.declarations_out(nodes).orderBy("id").collect()] == ["lib", "(root)", "core", "x", "Makefile"]


def test_sizes_at_the_limit_of_alike_do_not_depend_on_their_order(spark):
    """The variation is exactly 0.4 in each; sums of floats come out on either side of it."""
    sizes = {"a": [28, 5, 36, 25, 15, 24, 30, 37], "b": [21, 36, 21, 15, 26, 12, 9, 34, 21], "c": [33, 21, 7, 25, 18, 16], "d": [18, 16, 33, 7, 25, 21]}
    members = spark.createDataFrame([(g, f"{g}{i}", x) for g, l in sizes.items() for i, x in enumerate(l)] + [("e", "e0", 3), ("e", "e1", 6), ("f", "f0", None)], "group string, id string, loc int").coalesce(1)
    none = spark.createDataFrame([], "src string, dst string, kind string"), spark.createDataFrame([], "id string, label string")
    got = {r.group: (r.cv, r.score) for r in findings.structural_confidence(members, *none).collect()}
    assert got == {**dict.fromkeys("abcd", (0.4, 0)), "e": (0.333333333, 1), "f": (0.0, 1)}


def test_comments_go_line_by_line_first(spark):
    df = spark.createDataFrame([("/* a // b */ f()\ng() /* h */ `k` 'l\\'m'",)], "b string")
    r = df.select(text.tokens(F.col("b")).alias("t"), text.skeleton(F.col("b")).alias("s")).first()
    assert r.t == ["str", "str"] and r.s == ["STR", "STR"]


def test_reliance_reads_a_line_of_code_once(spark):
    body = "let x = 1;\n// try {\ntry {\ny = 2;\nf(1);\nx += 1; // f(2)\n} catch (e) {\nretry(x);\nf(1);\nz();\n}"
    callers = spark.createDataFrame([("f", "f", f"c{i}", body) for i in range(50)], "id string, label string, caller string, text string")
    got = findings.reliance(callers)
    (row,) = got.collect()
    assert (row.n_sites, row.handles_errors, row.least_args, row.most_args, row.awaited) == (100, 50, 1, 1, 0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # the first by line of code
