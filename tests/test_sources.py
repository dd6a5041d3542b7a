import json

from loomgraph.functions.paths import glob_regex, override_role
from loomgraph.operators import edges, extraction
from loomgraph.sources import readers, sinks
from loomgraph.sources.adapters import trade  # noqa: F401


def test_lcov_and_coverage(spark, tmp_path):
    (tmp_path / "a.info").write_text("TN:\nSF:src\\a.js\nDA:1,1\nDA:2,0\nDA:2,5\nend_of_record\nDA:9,9\nSF:src/b.js\nDA:1,0\nend_of_record\n")
    got = {tuple(r) for r in readers.lcov(spark, str(tmp_path / "a.info")).collect()}
    assert got == {("src/a.js", 1, 1), ("src/a.js", 2, 5), ("src/b.js", 1, 0)}
    nodes = spark.createDataFrame([("a", "src/a.js", 1, 2), ("b", "src/b.js", 1, 1), ("c", "src/c.js", 1, 1)], "id string, file string, line int, loc int")
    out = {r.id: (r.covered, r.hits) for r in readers.coverage_of(nodes, readers.lcov(spark, str(tmp_path / "a.info"))).collect()}
    assert out == {"a": (True, 5), "b": (False, 0), "c": (None, None)}


def test_istanbul(spark, tmp_path):
    doc = {"src/a.js": {"statementMap": {"0": {"start": {"line": 1}, "end": {"line": 3}}, "1": {"start": {"line": 3}, "end": {"line": 3}}}, "s": {"0": 2, "1": 7}}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert {tuple(r) for r in readers.istanbul(spark, str(tmp_path / "c.json")).collect()} == {("src/a.js", 1, 2), ("src/a.js", 2, 2), ("src/a.js", 3, 7)}


def test_churn_hunks_ledger(spark, tmp_path):
    (tmp_path / "log").write_text("a" * 40 + "\n\nx.py\ny.py\n" + "b" * 40 + "\n\nx.py\n")
    assert {tuple(r) for r in readers.churn(spark, str(tmp_path / "log")).collect()} == {("x.py", 2), ("y.py", 1)}
    (tmp_path / "d").write_text("--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@ f\n+a\n@@ -9 +12 @@\n--- a/z\n+++ /dev/null\n@@ -1 +0,0 @@\n+++ b/y.py\n@@ -4,2 +5,0 @@\n")
    assert {tuple(r) for r in readers.diff_hunks(spark, str(tmp_path / "d")).collect()} == {("x.py", 3, 6), ("x.py", 12, 12), ("y.py", 5, 5)}
    assert {tuple(r) for r in readers.named_hunks(spark, "a.js:3-9, b.js:4,c.js").collect()} == {("a.js", 3, 9), ("b.js", 4, 4), ("c.js", None, None)}
    (tmp_path / "l.jsonl").write_text('{"at": "1", "n": 1}\n{"at": "3", "n": 3}\n{"at": "2", "n"')
    assert [r.n for r in readers.tail(spark, str(tmp_path / "l.jsonl"), "at string, n int", "at", 2).collect()] == [3, 1]


def test_graph_round_trip(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "tests/a.js:f", "file": "tests/a.js"}, {"id": "b"}], "edges": [{"from": "b", "to": "gone", "kind": "call"}]}))
    n, e = readers.graph_json(spark, str(tmp_path / "g.json"))
    assert {(r.id, r.label, r.role, r.domain, r.exports) for r in n.collect()} == {("tests/a.js:f", "tests/a.js:f", "test", "unassigned", False), ("b", "b", "product", "unassigned", False)}
    assert [tuple(r) for r in e.collect()] == [("b", "gone", "call", 1)]
    for _ in range(2):
        sinks.write_graph(str(tmp_path / "out"), n, e, "s1")
    sinks.write_graph(str(tmp_path / "out"), n.limit(1), e, "s2")
    assert {(r.snapshot, r["count"]) for r in spark.read.parquet(str(tmp_path / "out/nodes")).groupBy("snapshot").count().collect()} == {("s1", 2), ("s2", 1)}
    assert sinks.markdown(n.select("id"), "t", 1).endswith("... and 1 more")


SOURCES = {
    "src/a.py": ("py", 'import os\n\ndef alpha(x, y=1):\n    """def hidden(): pass"""\n    return beta(x)\n\nclass Box:\n    def area(self):\n        return alpha(1)\n'),
    "src/b.py": ("py", "def beta(x):\n    return x\n"),
    "tests/a.js": ("js", "export function checks(a, {b}) {\n  const s = 'function no() {';\n  return beta(a); }\nconst gamma = (q) => {\n  return checks(q);\n};\n"),
}


def test_extraction(spark):
    files = spark.createDataFrame([(k, v[1], v[0]) for k, v in SOURCES.items()], "file string, text string, language string")
    s = extraction.symbols(files)
    got = {(r.file, r.label, r.kind, r.line, r.end) for r in s.collect()}
    assert got == {("src/a.py", "alpha", "function", 3, 5), ("src/a.py", "Box", "class", 7, 9), ("src/a.py", "area", "method", 8, 9), ("src/b.py", "beta", "function", 1, 2), ("tests/a.js", "checks", "function", 1, 3), ("tests/a.js", "gamma", "function", 4, 6)}
    e = {tuple(r)[:3] for r in edges.edges(files, s).collect()}
    assert e == {("src/a.py:alpha", "src/b.py:beta", "call"), ("src/a.py:Box.area", "src/a.py:alpha", "call"), ("tests/a.js:checks", "src/b.py:beta", "test"), ("tests/a.js:gamma", "tests/a.js:checks", "call")}
    assert [(r.label, r.owner) for r in extraction.owners(s).collect()] == [("area", "Box")]
    for text in (v[1] for v in SOURCES.values()):
        m = extraction.masked_text(text, "js")
        assert len(m) == len(text) and m.count("\n") == text.count("\n")


def test_imports_and_packages(spark):
    known = spark.createDataFrame([("src/a.js",), ("src/lib/index.js",), ("src/pkg/__init__.py",), ("src/pkg/json/x.py",), ("deep/pkg/json/x.py",)], "file string")
    i = spark.createDataFrame([("src/m.js", "./a"), ("src/m.js", "./lib"), ("src/m.js", "../src/a.js"), ("src/m.js", "react")], "file string, spec string")
    assert {(r.spec, r.target) for r in extraction.resolve_imports(i, known).collect()} == {("./a", "src/a.js"), ("./lib", "src/lib/index.js"), ("../src/a.js", "src/a.js"), ("react", None)}
    m = spark.createDataFrame([("t.py", "pkg"), ("t.py", "json.x"), ("t.py", "json")], "file string, module string")
    assert {(r.module, r.target) for r in extraction.resolve_modules(m, known).collect()} == {("pkg", "src/pkg/__init__.py"), ("json.x", "src/pkg/json/x.py"), ("json", None)}
    dirs = spark.createDataFrame([("src",), ("src/pkg",)], "dir string")
    assert {(r.file, r.package) for r in extraction.package_of(known, dirs).collect()} >= {("src/a.js", "src"), ("src/pkg/json/x.py", "src/pkg"), ("deep/pkg/json/x.py", "")}
    f = spark.createDataFrame([("function f(a, b = 2, ...c) {",), ("f(",)], "l string")
    from pyspark.sql import functions as F

    assert [r.s for r in f.select(extraction.signature(F.col("l"), F.lit("f")).alias("s")).collect()] == [["a", "b", "c"], None]
    assert glob_regex("src/**/x?.js") == "^src/(?:.*/)?x[^/]\\.js$"
    p = spark.createDataFrame([("src/gen/a.js",), ("tests/a.js",)], "p string")
    assert [r.r for r in p.select(override_role(F.col("p"), [("**/gen/**", "generated")]).alias("r")).collect()] == ["generated", "test"]
