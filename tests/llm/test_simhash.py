import random

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loomgraph.llm.simhash import PivotTable, _table_keys, candidates, copy_groups, fingerprint_links, fingerprint_of, links, meets, names, near_duplicates, set_links, sketch_of, tables_for
from loomgraph.operators.components import connected_components


def brute_fp(text):
    w = text.lower().split()
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps):
    up = {x: x for x in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    fs = sorted(up)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {x: find(x) for x in fs}


def cloud(r, n):
    out = set()
    centres = [r.getrandbits(64) for _ in range(4)]
    while len(out) < n:
        x = r.choice([*centres, *list(out)[:50]])
        for _ in range(r.randrange(7)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprint():
    for t in ("", " ", "One", "one two three", "A b c d", "a b c d e f g a b c d", "x y z w " * 40):
        assert fingerprint_of(t.encode()) == brute_fp(t)


def test_links_connect_all():
    r = random.Random(1)
    for n in (5, 60, 300):
        fps = cloud(r, n)
        got = links(np.asarray(fps, np.uint64))
        up = list(range(n))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in got:
            assert (fps[i] ^ fps[j]).bit_count() <= 4
            up[max(find(i), find(j))] = min(find(i), find(j))
        want = roots(fps)
        assert {frozenset(x for x in range(n) if find(x) == k) for k in map(find, range(n))} == {frozenset(i for i, x in enumerate(fps) if want[x] == k) for k in want.values()}


def test_spark_links_with_pieces(spark, monkeypatch):
    import loomgraph.llm.simhash as s

    monkeypatch.setattr(s, "PIECE", 40)
    r = random.Random(2)
    fps = cloud(r, 500)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = connected_components(fingerprint_links(df, 500)).collect()
    groups = lambda pairs: {frozenset(k for k, v in pairs if v == x) for x in {v for _, v in pairs}}
    want = groups([(k, v) for k, v in roots(fps).items()])
    assert groups([(x.node & (2**64 - 1), x.root) for x in got]) == {g for g in want if len(g) > 1}


def test_near_duplicates(spark):
    base = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t.upper()) for i, t in enumerate(base)] + [(20, base[0] + " more"), (30, None), (31, ""), (31, ""), (None, "  "), (40, "w " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = near_duplicates(df).collect()
    fp = {i: brute_fp((t or "")) for i, t in rows}
    of = roots(set(fp.values()))
    first = {}
    for i, x in fp.items():
        if i is not None:
            first[of[x]] = min(first.get(of[x], i), i)
    assert len(got) == len(rows)
    assert all(g.fingerprint == f"{fp[g.doc_id]:016x}" and g.component_id == first[of[fp[g.doc_id]]] for g in got)
    assert near_duplicates(df.limit(0)).count() == 0


def test_set_links_connect_what_jaccard_connects():
    r = random.Random(3)
    for n, base, most in ((50, 300, 10), (120, 120, 12), (80, 120, 3)):
        words = [r.randrange(9999) for _ in range(base)]
        sketches = {}
        for _ in range(n):
            copy = list(words)
            for _ in range(r.randrange(most)):
                copy[r.randrange(base)] = r.randrange(9999)
            s = sketch_of(" ".join(map(str, copy)).encode())
            sketches[s[0]] = s
        fps = np.asarray([s[1] for s in sketches.values()], np.int64).view(np.uint64)
        sets = [np.frombuffer(s[3], "<u4") for s in sketches.values()]
        plain = [set(x.tolist()) for x in sets]
        want = [(i, j) for j in range(len(plain)) for i in range(j) if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j])]
        got = set_links(fps, sets)
        assert set(got) <= set(want) and len(got) < len(sets)

        def parts(pairs):
            root = list(range(len(sets)))
            for i, j in pairs:
                root = [root[i] if x == root[j] else x for x in root]
            return {frozenset(i for i, x in enumerate(root) if x == k) for k in root}

        assert parts(got) == parts(want)


def wide(r, n, most):
    """Fingerprints of three words: loners, and clusters in which the next differs from the one before by up to `most` bits."""
    out = []
    while len(out) < n:
        x = [r.getrandbits(64) for _ in range(3)]
        for _ in range(r.choice([1, 1, 6])):
            out.append(x)
            x = list(x)
            for _ in range(r.randrange(1, most)):
                x[r.randrange(3)] ^= 1 << r.randrange(64)
    return np.asarray(out, np.uint64)


def test_pivot_table_of_near_copies_discards_and_loses_nothing():
    r = random.Random(4)
    fps = wide(r, 600, 70)
    table = PivotTable(fps)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(fps)), np.arange(len(fps))))
    i, j = i[i < j], j[i < j]
    apart = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1)
    bound = table.bound(i, j)
    assert (bound <= apart).all()
    assert (bound[apart > 80] > table.most).mean() > 0.95  # the table, not the fingerprints, rejects what is unlike
    assert table.near(i, j).tolist() == np.flatnonzero(apart <= table.most).tolist()


def test_candidates_connect_what_shares_a_key(monkeypatch):
    import loomgraph.llm.simhash as s

    r = random.Random(5)
    fps = wide(r, 400, 40)
    keys = np.sort(np.asarray([r.choice([1, 1, 1, 2, 3, 4]) for _ in fps], np.uint64))
    near = lambda i, j: keys[i] == keys[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= PivotTable(fps[:2]).most
    root = list(range(len(fps)))
    for j in range(len(fps)):
        for i in range(j):
            if root[i] != root[j] and near(i, j):
                root = [root[i] if x == root[j] else x for x in root]
    want = {frozenset(i for i, x in enumerate(root) if x == k) for k in root}
    for run in (10**6, 3):  # pair by pair, and spreading
        monkeypatch.setattr(s, "RUN", run)
        of = np.arange(len(fps))
        i, j = candidates(keys, fps)
        of[j] = i
        assert {frozenset(np.flatnonzero(of == k).tolist()) for k in of.tolist()} == want


def test_near_copies_are_candidates_by_fingerprint_alone(spark, monkeypatch):
    import loomgraph.llm.simhash as s

    monkeypatch.setattr(s, "SHARD", 100)
    monkeypatch.setattr(s, "DEALT", 100)  # in two rounds
    assert len(tables_for(1000)) == 160 and meets(14, 160) >= 0.9996
    r = random.Random(6)
    rows = []
    for _ in range(60):
        words = [str(r.randrange(10**6)) for _ in range(150)]
        copy = list(words)
        for at in (20, 60, 100):  # 15 shingles of 146 differ: Jaccard 0.81
            copy[at] = "x"
        rows += [words, copy]
    got = [sketch_of(" ".join(x).encode()) for x in rows]
    fps = np.asarray([[x[1], *x[2]] for x in got], np.int64)
    df = spark.createDataFrame(fps.tolist(), "fp long, w0 long, w1 long")
    root = {x.node: x.root for x in copy_groups(df, len(rows)).collect()}
    assert [x[4] for x in got] == names(fps.view(np.uint64)).view(np.int64).tolist()
    assert all(root[got[k][4]] == root[got[k + 1][4]] for k in range(0, len(rows), 2)) and len(set(root.values())) == 60
    masks = tables_for(1000)
    assert all(len(set(_table_keys(fps.view(np.uint64), m).tolist())) > 60 for m in masks)  # no table holds them together by itself


def test_a_large_group_of_near_copies_yields_links_by_members_not_by_tables(spark, monkeypatch):
    import loomgraph.llm.simhash as s

    r = random.Random(7)
    words = [str(r.randrange(10**6)) for _ in range(100)]
    texts = []
    for _ in range(400):  # one dense group
        copy = list(words)
        for _ in range(r.randrange(1, 4)):
            copy[r.randrange(100)] = str(r.randrange(10**6))
        texts.append(copy)
    for _ in range(40):  # chains, each text near the one before only, and loners
        copy = [str(r.randrange(10**6)) for _ in range(100)]
        for _ in range(r.choice([1, 1, 6])):
            texts.append(list(copy))
            for _ in range(3):
                copy[r.randrange(100)] = str(r.randrange(10**6))
    fps = np.unique(np.asarray([[x[1], *x[2]] for x in (sketch_of(" ".join(t).encode()) for t in texts)], np.int64), axis=0)
    wide_fps, n = fps.view(np.uint64), len(fps)
    i, j = np.triu_indices(n, 1)
    near = np.bitwise_count(wide_fps[i] ^ wide_fps[j]).sum(axis=1) <= PivotTable(wide_fps[:2]).most
    met = np.zeros(len(i), bool)
    for m in tables_for(n):
        keys = _table_keys(wide_fps, m)
        met |= keys[i] == keys[j]
    root = np.arange(n)
    for x, y in zip(i[near & met].tolist(), j[near & met].tolist(), strict=True):
        if root[x] != root[y]:
            root[root == root[y]] = root[x]
    name = names(wide_fps).view(np.int64)
    want = {frozenset(name[root == k].tolist()) for k in set(root.tolist())}

    entered = []

    def counted(edges):
        entered.append(edges.count())
        return connected_components(edges)

    monkeypatch.setattr(s, "connected_components", counted)
    for run in (256, 3):  # pair by pair, and spreading
        monkeypatch.setattr(s, "RUN", run)
        entered.clear()
        got = {x.node: x.root for x in copy_groups(spark.createDataFrame(fps.tolist(), "fp long, w0 long, w1 long"), n).collect()}
        assert {frozenset(k for k, v in got.items() if v == x) for x in got.values()} == {g for g in want if len(g) > 1}
        assert all(v == min(k for k, w in got.items() if w == v) for v in set(got.values()))
        assert max(entered) <= 3 * n
