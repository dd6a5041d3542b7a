from loomgraph.operators import codemod, edges, extraction

FILES = {
    "lib/a.js": "export function keep(x) {\n  return x;\n}\nexport function other() {\n}\n",
    "lib/old/b.js": "// spare(1)\nexport function spare(x) {\n  return x;\n}\nexport function more() {\n  return spare(2);\n}",
    "use.js": "import { spare as s2, spare } from './lib/old/b.js'; // spare\nimport { more } from './lib/old/b.js';\nfunction go() {\n  spare(1); $spare(2); spare2(3);\n  return more();\n}\n",
    "c.js": "export function twin() {\n}\nexport function says() {\n  return 'lone' + lone();\n}\n",
    "d.js": "export function twin() {\n  twin2();\n}\nexport function lone() {\n}\nexport function lonely() {\n}\n",
    "e.js": "export function keep(y) {\n  return y;\n}\n",
}


def _all(spark):
    files = spark.createDataFrame([(k, v, "js") for k, v in FILES.items()], "file string, text string, language string")
    s = extraction.symbols(files)
    return files, s, edges.edges(files, s)


def test_edits_apply_and_revert(spark):
    files, s, e = _all(spark)
    groups = spark.createDataFrame([("g", "lib/a.js:keep", "lib/a.js:keep"), ("g", "lib/old/b.js:spare", "lib/a.js:keep"), ("g", "e.js:keep", "lib/a.js:keep")], "group string, id string, canonical string")
    edits, refused = codemod.merge_edits(files, s, e, groups)
    assert refused.count() == 0
    after = {r.file: r.text for r in codemod.applied(files, edits).collect()}
    assert after["lib/a.js"] == FILES["lib/a.js"] and after["e.js"] == "" and after["c.js"] == FILES["c.js"]
    assert after["lib/old/b.js"] == "// spare(1)\nexport function more() {\n  return keep(2);\n}"
    assert after["use.js"] == "import { keep as s2, keep } from './lib/a.js'; // spare\nimport { more } from './lib/old/b.js';\nfunction go() {\n  keep(1); $spare(2); spare2(3);\n  return more();\n}\n"
    new = spark.createDataFrame([(k, v, "js") for k, v in after.items()], files.schema)
    back = codemod.applied(new, codemod.reverted(edits))
    assert {r.file: r.text for r in back.collect()} == FILES
    es = {(r.src, r.dst) for r in edges.edges(new, extraction.symbols(new)).collect()}
    assert ("use.js:go", "lib/a.js:keep") in es and not any("spare" in b for _, b in es)


def test_groups_that_would_need_a_guess_are_refused(spark):
    files, s, e = _all(spark)
    rows = [("one", "c.js:twin", "c.js:twin"), ("many", "lib/a.js:other", "lib/a.js:other"), ("many", "c.js:twin", "lib/a.js:other"), ("said", "d.js:lonely", "d.js:lonely"), ("said", "d.js:lone", "d.js:lonely")]
    rows += [(g, i, "lib/a.js:keep") for g in ("x1", "x2") for i in ("lib/a.js:keep", "e.js:keep")]
    groups = spark.createDataFrame(rows, "group string, id string, canonical string")
    edits, refused = codemod.merge_edits(files, s, e, groups)
    assert {r.group: r.reason for r in refused.collect()} == {"one": "fewer than two symbols", "many": "name of several symbols", "said": "name inside a string", "x1": "edits overlap another group's", "x2": "edits overlap another group's"}
    assert edits.count() == 0
    none, refused = codemod.merge_edits(files, s, e, groups.limit(0))
    assert none.count() == 0 and refused.count() == 0


def test_the_word_from_of_an_import_is_no_name(spark):
    """A symbol called `from` moves; lines that only say `from` before their file stay."""
    body = "export function from(x) {\n  return x;\n}\n"
    user = "import { other } from './b.js';\nimport { from as f } from './b.js';\n"
    files = spark.createDataFrame([("p/a.js", body, "js"), ("p/b.js", body + "export function other() {\n}\n", "js"), ("p/c.js", user, "js")], "file string, text string, language string")
    symbols = spark.createDataFrame([("p/a.js:from", "p/a.js", "from", 1, 3), ("p/b.js:from", "p/b.js", "from", 1, 3), ("p/b.js:other", "p/b.js", "other", 4, 5)], "id string, file string, label string, line int, end int")
    edges = spark.createDataFrame([("p/c.js:<module>", "p/b.js:from", "import")], "src string, dst string, kind string")
    groups = spark.createDataFrame([("g", "p/a.js:from", "p/a.js:from"), ("g", "p/b.js:from", "p/a.js:from")], "group string, id string, canonical string")
    edits, refused = codemod.merge_edits(files, symbols, edges, groups)
    at = user.rindex("./b.js")
    assert {(r.file, r.start, r.end, r.new) for r in edits.collect()} == {("p/b.js", 0, len(body), ""), ("p/c.js", at, at + 6, "./a.js")}
    assert refused.count() == 0
