import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import diff, graph, planning, ranking, similarity
from loomgraph.sources.adapters import EDGE_SCHEMA, NODE_SCHEMA


def make(spark, r, n=7, files=4, p=0.22):
    nodes = [(f"n{i}", f"l{i % 4}", "function", f"f{r.randrange(files)}", 1, r.randrange(1, 40), r.random() < 0.2, f"d{i % 2}", "product") for i in range(n)]
    kinds = ["call"] * 8 + ["import", "inherit", "ref", "test"]
    edges = sorted({(f"n{a}", f"n{b}", r.choice(kinds), 1) for a in range(n) for b in range(n) if r.random() < p})
    return nodes, edges, (spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA))


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if b == x and a not in seen:
                seen.add(a)
                todo.append(a)
    return seen


def file_cycles(nodes, edges, kinds=graph.CYCLE_KINDS):
    at = {n[0]: n[3] for n in nodes}
    e = {(at[a], at[b]) for a, b, k, _ in edges if k in kinds and at[a] != at[b]}
    return {tuple(sorted(f for f in {x for p in e for x in p} if (f == s) or (f in reach(e, s) and s in reach(e, f)))) for s in {x for p in e for x in p} if s in reach(e, s)}


@pytest.mark.parametrize("seed", [1, 2])
def test_closures_and_cycles_equal_brute_force(spark, seed):
    r = random.Random(seed)
    nodes, edges, (n, e) = make(spark, r)
    carry = [(a, b) for a, b, k, _ in edges if k in graph.IMPACT_KINDS]
    seeds = {"n0", "n3"}
    got = {x.id for x in graph.impact(e, spark.createDataFrame([(s,) for s in seeds], "id string")).collect()}
    assert got == set().union(*[reach(carry, s) for s in seeds]) - seeds
    assert {x.id: x.blast for x in graph.blast_counts(n, e).collect()} == {x[0]: len(reach(carry, x[0]) - {x[0]}) for x in nodes}
    assert {tuple(x.files) for x in graph.cycles(n, e).collect()} == file_cycles(nodes, edges)
    called = {b for _, b, k, _ in edges if k in graph.CYCLE_KINDS}
    assert {x.id for x in graph.orphans(n, e).collect()} == {x[0] for x in nodes if not x[6] and x[0] not in called}


def test_merge_simulator_equals_edited_graph(spark):
    r = random.Random(3)
    nodes, edges, (n, e) = make(spark, r, 9, 5, 0.2)
    sim = planning.MergeSimulator(n, e)
    assert {tuple(c) for c in sim.cycles()} == file_cycles(nodes, edges)
    for ids in (["n1", "n4"], ["n2", "n7"], ["n1", "n5"]):
        into = min(ids)
        edges = sorted({(into if a in ids else a, into if b in ids else b, k, 1) for a, b, k, _ in edges})
        assert {tuple(c) for c in sim.simulate(ids, into)} == file_cycles(nodes, edges)
        sim.commit(ids, into)
    sim.delete(["n3"])
    assert {tuple(c) for c in sim.cycles()} == file_cycles(nodes, [x for x in edges if "n3" not in x[:2]])


def test_cut_breaks_its_cycle(spark):
    nodes = [(f"n{i}", "l", "function", f"f{i}", 1, 1, False, "d", "product") for i in range(3)]
    edges = [("n0", "n1", "call", 5), ("n1", "n2", "call", 1), ("n2", "n0", "call", 3)]
    n, e = spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA)
    assert [(c.cut_src, c.cut_dst, c.verified) for c in planning.cheapest_cuts(n, e).collect()] == [("f1", "f2", True)]
    two = e.union(spark.createDataFrame([("n1", "n2", "ref", 1)], EDGE_SCHEMA))
    assert [(c.cut_src, c.cut_dst) for c in planning.cheapest_cuts(n, two).collect()] == [("f2", "f0")]
    row = diff.gate((n, e.where("src <> 'n2'")), (n, e), orphan_gate=False).first()
    assert (row.new_cycles, row.ok) == (1, False)


def test_reading_order_and_labels(spark):
    nodes = [(f"n{i}", f"l{i}", "function", f"a/{'x' if i < 3 else 'y'}/f", 1, 1, False, "d", "product") for i in range(5)]
    edges = [("n0", "n1", "call", 1), ("n1", "n2", "call", 1), ("n3", "n2", "call", 1), ("n4", "n0", "call", 1)]
    n, e = spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA)
    assert [x[0] for x in planning.reading_order(n, e)] == ["n2", "n1", "n0", "n3", "n4"]
    assert dict(planning.propagate_labels(n, e))["n2"] == "a/x"
    assert planning.fit_budget(spark.createDataFrame([("a", 3), ("b", 4), ("c", 2)], "name string, size int"), 4) == ["c", "a"]
    with pytest.raises(ValueError):
        planning.reading_order(n, e, most=2)
    with pytest.raises(ValueError):
        ranking.fitness(n, e, [{"id": "x", "type": "nonsense"}])


def test_labels_take_only_what_hubs_leave_to_the_driver(spark):
    """Nodes around a hub keep their directories, however many they are; the others move as in one pass over all."""
    n = [(f"m{i}", f"a/x{i % 2}/f") for i in range(400)] + [("hub", "h/h/f")] + [(f"k{i}", f"b/{'y' if i else 'z'}/f") for i in range(4)]
    e = [(f"m{i}", "hub") for i in range(400)] + [(f"k{i}", f"k{(i + 1) % 4}") for i in range(4)] + [("k1", "k1"), ("k1", "gone")]
    nodes, edges = spark.createDataFrame(n, "id string, file string"), spark.createDataFrame(e, "src string, dst string")
    got = {r.id: r.domain for r in planning.label_domains(nodes, edges, most=20).collect()}
    assert got == {**{f"m{i}": f"a/x{i % 2}" for i in range(400)}, "hub": "h/h", **{f"k{i}": "b/y" for i in range(4)}}


def test_renames(spark):
    sh = lambda *x: list(x)
    schema = "id string, kind string, file string, label string, shingles array<string>"
    removed = spark.createDataFrame([("a", "function", "f", "one", sh("1", "2", "3")), ("b", "function", "f", "two", sh("1", "2", "3"))], schema)
    added = spark.createDataFrame([("c", "function", "f", "uno", sh("1", "2", "3")), ("d", "class", "f", "one", sh("1", "2", "3"))], schema)
    assert [(x.removed_id, x.added_id, x.sim) for x in diff.renames(removed, added).collect()] == [("a", "c", 1.0)]


def test_similarity_joins_agree(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        base = sorted({f"s{r.randrange(30)}" for _ in range(14)}) if i % 3 == 0 else sorted({*rows[-1][1][1:], f"x{i}"})
        rows.append((i, base, len(base)))
    t = spark.createDataFrame([*rows, (99, [], 0)], "id long, shingles array<string>, n int")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and jac(a[1], b[1]) >= 0.7}
    exact = {(x.a, x.b): x.sim for x in similarity.similar_pairs(t, 0.7).collect()}
    assert set(exact) == want
    assert all(abs(v - jac(rows[a][1], rows[b][1])) < 1e-9 for (a, b), v in exact.items())
    lsh = {(x.a, x.b) for x in similarity.lsh_pairs(t, 0.7, 64, 3).collect()}
    assert lsh <= want and len(lsh) >= 0.9 * len(want)
    assert similarity.item_hash("") == similarity.FNV_START and similarity.signature([], 4).tolist() == [2**32 - 1] * 4
    assert F is not None


def test_blast_is_carried_over_edits(spark):
    import random

    from loomgraph.operators.blast import blast, carried

    r = random.Random(11)
    ids = [f"n{i}" for i in range(150)]
    edges = {(a, b) for a, b in ((r.choice(ids), r.choice(ids)) for _ in range(110))} | {(ids[i], ids[i + 1]) for i in range(10)} | {(ids[10], ids[3])}
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    frame = lambda e: spark.createDataFrame(sorted((a, b, "call") for a, b in e), "src string, dst string, kind string")

    def want(e, ids):
        into = {i: set() for i in ids}
        for a, b in e:
            into.setdefault(b, set()).add(a)
            into.setdefault(a, set())
        out = {}
        for i in into:
            seen, todo = {i}, [i]
            while todo:
                new = into[todo.pop()] - seen
                seen |= new
                todo += new
            out[i] = len(seen) - 1
        return out

    state = blast(nodes, frame(edges))
    assert {x.id: x.blast for x in state.counts().collect()} == want(edges, ids)
    for step in range(1):
        new = set(edges) - set(r.sample(sorted(edges), 4)) | {(r.choice(ids), r.choice(ids)) for _ in range(3)} | {(f"new{step}", ids[3]), (ids[5], f"new{step}")}
        state = carried(state, nodes, frame(edges), frame(new))
        edges = new
        assert {x.id: x.blast for x in state.counts().collect()} == want(edges, ids)
    rows = state.rows.count()
    assert rows < len(ids) ** 2 / 8
    same = carried(state, nodes, frame(edges), frame(edges))
    assert {x.id: x.blast for x in same.counts().collect()} == want(edges, ids)
    assert blast(nodes.limit(0), frame(edges).limit(0)).counts().count() == 0


def test_components_in_a_row_settle_together(spark, monkeypatch):
    """Each leads to the next, and the first has the smallest ids: they need not be found one after the other."""
    made = []
    monkeypatch.setattr(graph, "checkpoint", lambda df, kept=graph.checkpoint: made.append(1) or kept(df))
    rows = [e for k in range(10) for e in ((f"{k}a", f"{k}b"), (f"{k}b", f"{k}a"), (f"{k}b", f"{k + 1}a"))]
    got = graph.strong_components(spark.createDataFrame(rows, "src string, dst string")).collect()
    assert {(r.id, r.root) for r in got} == {(f"{k}{x}", f"{k}a") for k in range(10) for x in "ab"}
    assert len(made) < 30


def test_what_lies_behind_many_starts_is_no_row_for_each(spark):
    from loomgraph.operators import blast

    rows = [(f"{k}", f"{(k + 1) % 20}") for k in range(20)] + [("x", "0")]
    starts = spark.createDataFrame([(f"{k}",) for k in range(0, 20, 2)], "id string")
    assert sorted(r.id for r in blast._behind(spark.createDataFrame(rows, "src string, dst string"), starts).collect()) == sorted(str(k) for k in range(20))


def test_lost_callers_of_many_rows(spark, tmp_path, monkeypatch):
    """Nodes that lost their last caller, with the lines dealt to more tasks than the session's partitions; the same as without."""
    from loomgraph import session
    from loomgraph.operators import diff
    from loomgraph.sources.adapters import commerce

    d = "/root/testdata/sf0.001"
    nodes, edges = commerce(spark, d)
    few = edges.rdd.getNumPartitions()
    after = nodes, edges.where("src LIKE '%1'")
    callers = {}
    for x in edges.where("kind = 'call'").collect():
        callers.setdefault(x.dst, set()).add(x.src)
    ids = {x.id for x in nodes.collect()}
    want = {k: len(v) for k, v in callers.items() if k in ids and not any(s.endswith("1") for s in v)}
    assert want and {x.id: x.was for x in diff.lost_callers((nodes, edges), after).collect()} == want
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    many = commerce(spark, d)[1]
    assert many.rdd.getNumPartitions() > few + 40
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, edges.collect()))
    assert {x.id: x.was for x in diff.lost_callers((nodes, many), (nodes, many.where("src LIKE '%1'"))).collect()} == want


def test_the_market_is_made_once_for_all_who_read_it(spark):
    from loomgraph.sources.adapters import market

    _, e = market(spark, "/root/testdata/sf0.001")
    files = e.inputFiles()
    assert files and not any("lineitem" in f for f in files)
    assert e.where("src LIKE 'c:%'").groupBy("src").count().agg(F.max("count")).first()[0] == 2


def test_dependents_are_counted_without_a_row_for_each_kind(spark):
    e = spark.createDataFrame([("a", "x", "call"), ("a", "x", "test"), ("a", "x", "call"), (None, "x", "call"), ("b", "x", "odd"), ("a", "y", "ref")], "src string, dst string, kind string")
    got = graph.dependents(e, spark.createDataFrame([("x",)], "id string"))
    assert [(r.id, r.n_call, r.n_test, r.n_ref, r.n_all) for r in got.collect()] == [("x", 1, 1, 0, 2)]
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "deals"), [("q5_dependents", 3), ("p10_dangling", 4), ("q18_diff_edges", 5)])
def test_edges_are_dealt_to_more_tasks_as_lines_grow(spark, monkeypatch, name, deals):
    from loomgraph import session
    from loomgraph.plans import graph_queries

    monkeypatch.setattr(session, "ROWS_A_TASK", 1000)
    plan = graph_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == deals


def test_snapshots_of_the_trend_are_made_once(spark):
    from loomgraph.plans import graph_queries

    files = graph_queries.q33_trend(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("lineitem" in f for f in files)
