import hashlib
import random
import zlib
from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from loomgraph.llm.filter_audit import filter_audit
from loomgraph.llm.merkle import levels, merkle_manifest, traverse
from loomgraph.llm.sharding import shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, place long"


def documents(seed=5, n=120):
    """Rows with nulls in every column, copies, repeated rows, a long text and a hot source."""
    r = random.Random(seed)
    words = ["ab", "Ba", "c#", "é", "DD", "e", "f|"]
    texts = [None, "", " \n", "\n\n", "x y " * 40000, *[r.choice([" ", "\n"]).join(r.choices(words[:3] + ["q%d" % i for i in range(r.choice([3, 90]))], k=r.choice([5, 60, 200]))) for _ in range(20)]]
    rows = [(i, r.choice(texts), r.choice([None, "en"]), r.choice([None, "", "s", "é", "s", "s"]), r.choice([None, i]), -i, 7) for i in range(n)]
    return rows + [(None, "same", "en", "s", 1, 0, 0), (None, "same", None, None, 1, 0, 0), *[(5, "twice", "en", "s", 5, 1, 1)] * 3, (5, "twice!", "en", "s", 5, 1, 1)]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """Digest and, for each leaf, (before, after) of every level."""
    nodes = [(x, [i]) for i, x in enumerate(leaves)]
    paths = [[] for _ in leaves]
    while len(nodes) > 1:
        up = []
        for i in range(0, len(nodes), 3):
            run = nodes[i : i + 3]
            for k, (_, own) in enumerate(run):
                for leaf in own:
                    paths[leaf].append(("".join(x for x, _ in run[:k]), "".join(x for x, _ in run[k + 1 :])))
            up.append((h(*[x for x, _ in run]), [leaf for _, own in run for leaf in own]))
        nodes = up
    return nodes[0][0], paths


def test_traverse_equals_levels():
    for n in (1, 2, 3, 4, 9, 10, 28, 30, 81):
        leaves = [h(str(i)).encode() for i in range(n)]
        top, beside = traverse(leaves, levels(n))
        want, paths = brute_tree([x.decode() for x in leaves])
        assert top.decode() == want
        assert [b"".join(b).decode() for b in beside] == ["".join(a + b for a, b in p) for p in paths]


def brute_manifest(rows):
    def leaf(row, text):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])

    by = defaultdict(list)
    for row in rows:
        by[row[3]].append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    low = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, leaf(x, x[1])))
        low[s] = brute_tree([leaf(x, x[1]) for x in by[s]])
    root, high = brute_tree([low[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for row, path in zip(by[s], low[s][1], strict=True):
            path = path + high[k]
            own = leaf(row, row[1])
            x = own if row[0] is None or zlib.crc32(str(row[0]).encode()) % 2 or row[1] is None else leaf(row, row[1].replace("\n", ""))
            for a, b in path:
                x = h(a, x, b)
            out.append((row[0], own, low[s][0], root, h(*[a + b for a, b in path]), x, x == root))
    return sorted(out, key=repr)


def test_manifest_equals_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    want = brute_manifest(rows)
    assert {x[-1] for x in want} == {True, False}
    for height in (1, 7):
        got = merkle_manifest(df, tampered, height=height)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert merkle_manifest(df.limit(0), tampered).count() == 0
    one = merkle_manifest(df.where("text = 'twice!'"), F.lit(False)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h()


def brute_audit(rows, labels):
    def failures(i, row):
        t = row[1] or ""
        ws = t.encode().split()
        late = any(o[0] is not None and row[0] is not None and o[0] < row[0] and (o[1] or "") == t for o in rows)
        return {x for x, bad in zip("ABCDE", (len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), late), strict=True) if bad}

    fails = [failures(i, row) for i, row in enumerate(rows)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {row[3] or "" for row in rows}:
        own = [(row[0], f) for row, f in zip(rows, fails, strict=True) if (row[3] or "") == part]
        shapley = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(x in d[1] for d in own) - len(gone), sum(d[1] == {x} for d in own), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_equals_brute_force(spark):
    rows = documents(8, 90)
    labels = [(i, i % 3 % 2 if i % 5 else None, i % 2) for i in range(0, 80)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit(df, marks).collect()}
    want = brute_audit(rows, labels)
    assert got == want and len(got) == 600 * len({row[3] or "" for row in rows})
    assert filter_audit(df.limit(0), marks).count() == 0
    assert {tuple(r)[7:9] for r in filter_audit(df, marks.limit(0)).collect()} == {(0, 0)}


def brute_cut(rows, t, slack):
    """rows: (text key, id key, size) in order; bytes before the cut."""
    at, starts = 0, []
    for row in rows:
        starts.append((at, at + row[2], row[0]))
        at += row[2]
    s, e, text = next(x for x in starts if x[0] <= t < x[1])
    group = [x for x in starts if x[2] == text]
    if min(t - group[0][0], group[-1][1] - t) <= slack:
        return group[0][0] if t - group[0][0] <= group[-1][1] - t else group[-1][1]
    return s if t - s <= e - t else e


def test_shards_are_even_and_cut_as_stated(spark):
    key = lambda x: int(hashlib.md5(("" if x is None else str(x)).encode()).hexdigest()[:15], 16)
    hot = [(i, "hot " * 20, None, "s", 1, 0, 0) for i in range(300, 800)]
    rows = documents(9, 300) + hot + [(1000, "alike", "en", "s", 1, 0, 0)] * 200
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    size = lambda t: len((t or "").encode()) + 1
    for pieces in (200_000, 9):
        got = shards(df, piece_rows=pieces).collect()
        assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((x[0] or -1, size(x[1]), zlib.crc32((x[1] or "").encode())) for x in rows)
        assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} <= set(range(16))
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        order = sorted((key(x[1]), key(x[0]), size(x[1])) for x in rows)
        total = sum(x[2] for x in order)
        ends = [0, *[brute_cut(order, total * i // 16, total // 1600) for i in range(1, 16)], total]
        held = [sum(r.size for r in got if r.shard == k) for k in range(16)]
        assert held == [b - a for a, b in zip(ends, ends[1:], strict=False)]
    few = shards(df.where("text = 'twice'"))
    assert few.count() == 3 and shards(df.limit(0)).count() == 0


def test_equal_texts_share_a_shard_if_they_fit(spark):
    rows = [(i, "w%d " % (i // 2) * 50, None, "s", 1, 0, 0) for i in range(4000)]
    got = shards(spark.createDataFrame(rows, SCHEMA)).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    share = sum(r.n for r in got) / 16
    assert len(got) == 16 and all(abs(r.n - share) <= 0.02 * share + 600 for r in got)
    of = defaultdict(set)
    for r in shards(spark.createDataFrame(rows, SCHEMA)).collect():
        of[r.text_crc32].add(r.shard)
    assert all(len(v) == 1 for v in of.values())
