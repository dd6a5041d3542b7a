from test_extraction import FILES

from loomgraph.operators import reuse

KINDS = {"js": "js", "rb": "rb", "py": "py"}


def _frame(spark, tree):
    return spark.createDataFrame([(k, v, KINDS[k.split(".")[-1]]) for k, v in sorted(tree.items())], "file string, text string, language string")


def test_edits_give_what_a_cold_reading_gives(spark):
    tree = dict(FILES)
    state = reuse.read(_frame(spark, tree))
    edits = [
        {"lib.js": FILES["lib.js"].replace("helper", "helped")},  # a name that others import goes
        {"lib/index.js": "export function helper() {\n}\n", "lib.js": None, "use.js": FILES["use.js"].replace("'./lib.js'", "'./lib'")},  # a path that was looked at in vain is there
        {"other.js": FILES["other.js"] + "function probe() {\n}\n", "m.py": None, "far.js": "function nobody() {\n}\n"},  # a name means two symbols now
    ]
    for change in edits:
        tree = {k: v for k, v in (tree | change).items() if v is not None}
        state = reuse.refresh(state, _frame(spark, tree))
        cold = reuse.read(_frame(spark, tree))
        for part in ("files", "symbols", "names", "paths", "edges"):
            a, b = (sorted(map(repr, getattr(x, part).select(cold.__getattribute__(part).columns).collect())) for x in (state, cold))
            assert a == b, (change.keys(), part)
        assert state.n_read == sum(v is not None for v in change.values()) and state.n_resolved < len(tree)
    assert reuse.refresh(state, _frame(spark, tree | {"far.js": "// function\nfunction nobody() {\n}\n"})).n_resolved == 1
    assert reuse.refresh(state, _frame(spark, tree)).n_resolved == 0
