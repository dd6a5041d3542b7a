import json

from loomgraph.sources.readers import ctags, flat_strings, manifest_files, tagged_symbols

FILES = ["index.js", "lib/a.mjs", "lib/b.cjs", "lib/deep.js", "bin/run.js", "pkg/main.js", "pkg/x.js", "main.js", "hooks/go.mjs", "unused.js"]
MANIFESTS = [
    ("package.json", json.dumps({"main": "./index.js", "bin": {"run": "./bin/run.js", "n": 3}, "exports": {".": {"import": {"default": "./lib/a.mjs", "types": "./a.d.ts"}, "require": ["./lib/b.cjs", {"node": "./lib/deep.js"}]}, "./gone": None}})),
    ("pkg/package.json", json.dumps({"main": "main.js", "bin": "x.js", "exports": "./main.js"})),
    ("bad/package.json", "{"), ("none/package.json", None), ("odd/package.json", json.dumps({"main": {"x": "unused.js"}, "exports": 7})),
    ("hooks/hooks.json", '{"command": "node \\"${ROOT}/hooks/go.mjs\\" --x"}'), ("other/hooks.json", "unused.js"),
]


def test_manifests_name_files_however_nested(spark):
    m = spark.createDataFrame(MANIFESTS, "path string, text string")
    files = spark.createDataFrame([(f,) for f in FILES], "file string")
    got = {(r.file, r.manifest) for r in manifest_files(m, files).collect()}
    assert got == {("index.js", "package.json"), ("bin/run.js", "package.json"), ("lib/a.mjs", "package.json"), ("lib/b.cjs", "package.json"), ("lib/deep.js", "package.json"), ("pkg/main.js", "pkg/package.json"), ("main.js", "pkg/package.json"), ("pkg/x.js", "pkg/package.json"), ("hooks/go.mjs", "hooks/hooks.json")}
    assert manifest_files(m.limit(0), files).count() == 0
    deep = spark.sql("SELECT 1 AS of, parse_json(concat(repeat('[', 20), '\"x\"', repeat(']', 20))) AS v UNION ALL SELECT 2, parse_json('{\"a\": [1, true, null, \"y\", {\"b\": \"z\"}]}')")
    assert sorted(map(tuple, flat_strings(deep).collect())) == [(1, "x"), (2, "y"), (2, "z")]


def test_tags_stand_in_for_line_rules(spark, tmp_path):
    lines = ['{"_type": "tag", "name": "go", "path": "./a.c", "line": 3, "kind": "function", "end": 9}', '{"_type": "tag", "name": "x", "path": "a.c"}', '{"_type": "ptag", "name": "P", "path": "a.c"}', '{"_type": "tag", "name": "", "path": "a.c"}', "no json", "", '{"_type": "tag", "line": "odd", "name": "y", "path": "b.c"}', '{"name": "z"}']
    (tmp_path / "tags.json").write_text("\n".join(lines))
    tags = ctags(spark, str(tmp_path / "tags.json"))
    assert {tuple(r) for r in tags.collect()} == {("a.c", "go", "function", 3), ("a.c", "x", "symbol", 1), ("b.c", "y", "symbol", 1)}
    found = spark.createDataFrame([("a.c", "old", "function", 1, 2), ("c.js", "f", "function", 5, 6)], "file string, label string, kind string, line int, end int")
    assert {r.label for r in tagged_symbols(found, tags).collect()} == {"go", "x", "y", "f"}
    (tmp_path / "none.json").write_text("")
    assert tagged_symbols(found, ctags(spark, str(tmp_path / "none.json"))).count() == 2
