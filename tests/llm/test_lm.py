import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm.lm_scoring import levels, lm_scores

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(t):
    return [*WORD.findall((t or "").encode().lower()), None]


def rows():
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(200):
        w = r.choice(words)
        text = []
        for _ in range(r.randrange(0, 80)):
            text.append(w)
            w = words[(words.index(w) * 7 + r.choice([1, 1, 1, 2, 5])) % 60]
        out.append((i, " ".join(text)))
    return out + [(300, None), (301, ""), (302, "Ünseen X\x0bW1"), (302, "Ünseen X\x0bW1"), (None, "w1 w2")]


def test_scores(spark):
    data = rows()
    df = spark.createDataFrame([(a, b, 1.0) for a, b in data], "doc_id long, text string, score double")
    out = F.col("doc_id") % 7 == 2
    got = lm_scores(df, out, chunk_bytes=3000).collect()
    assert len(got) == len(data)
    c = Counter(w for i, t in data if i is None or i % 7 != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    by = {}
    for i, t in data:
        w = tokens(t)
        by[i] = (len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    for g in got:
        assert (g.n_tokens, g.n_known) == by[g.doc_id][:2] and g.train_tokens == n
        assert abs(g.base_score - by[g.doc_id][2]) < 1e-6
        assert g.held_out == (g.doc_id is not None and g.doc_id % 7 == 2)
    held = [g for g in got if g.held_out]
    assert sum(g.score for g in held) > 0.8 * sum(g.base_score for g in held)  # higher: the words follow one another
    one = lm_scores(df, out, chunk_bytes=10**9).collect()
    assert sorted((g.doc_id or -1, g.n_known, round(g.base_score, 6)) for g in one) == sorted((g.doc_id or -1, g.n_known, round(g.base_score, 6)) for g in got)
    assert lm_scores(df.limit(0), out).count() == 0
    assert {g.n_known for g in lm_scores(df, F.lit(True)).collect()} == {0}


def brute_scores(data, held, rounds=200):
    """Interpolated scores by the definition: dictionaries of counts, EM on every training token under its document's deletion."""
    docs = [(i, held(i), tokens(t)) for i, t in data]
    count, own = Counter(), []
    for _, h, w in docs:
        mine = Counter()
        for at in range(len(w)):
            for k in (1, 2, 3):
                mine[gram(w, at, k)] += 1
        mine["docs"] = 1
        own.append(mine)
        if not h:
            count.update(mine)
    n = sum(len(w) for _, h, w in docs if not h)
    v = len({x for _, h, w in docs if not h for x in w})
    bucket = lambda c: c.bit_length()
    weights = {2: {}, 3: {}}

    def steps(w, at, less, top):
        """(lower-order probability, share, context bucket) of each order up to top."""
        get = lambda g: count[g] - less[g]
        p = (get(gram(w, at, 1)) + 1) / (n + v + 1)
        for k in range(2, top + 1):
            context = get(gram(w, at - 1, k - 1)) if at else get("docs")
            share = get(gram(w, at, k)) / context if context else 0.0
            yield p, share, bucket(context)
            x = weights[k].get(bucket(context), 0.0)
            p = x * share + (1 - x) * p
        yield p, None, None

    for k in (2, 3):
        seen = []
        for (_, h, w), less in zip(docs, own, strict=True):
            if not h:
                seen += [list(steps(w, at, less, k))[-2] for at in range(len(w))]
        for b in {x[2] for x in seen} - {0}:
            mine, x = [(p, s) for p, s, c in seen if c == b], 0.5
            for _ in range(rounds):
                x = min(0.9999, sum(x * s / (x * s + (1 - x) * p) for p, s in mine) / len(mine))
            weights[k][b] = x
        known = sorted(weights[k])
        weights[k] = {b: float(np.interp(b, known, [weights[k][x] for x in known])) for b in range(1, 64)}  # a bucket that no token reaches lies between its neighbours
    none = Counter()
    return {i: sum(math.log10(list(steps(w, at, none, 3))[-1][0]) for at in range(len(w))) for i, _, w in docs}


def gram(w, at, k):
    return tuple(w[j] if j >= 0 else "START" for j in range(at - k + 1, at + 1))


def test_scores_equal_a_brute_force_em(spark):
    data = [x for x in rows() if x[0] is not None]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_scores(data, lambda i: i % 7 == 2)
    for g in lm_scores(df, F.col("doc_id") % 7 == 2, chunk_bytes=2000).collect():
        assert abs(g.score - want[g.doc_id]) <= 0.001 * abs(want[g.doc_id])  # ratios meet in bins of a quarter of a power of two


def test_probabilities_sum_to_one_with_brute_force_counts():
    from loomgraph.llm.lm_scoring import Chunk, Mixture, Tokens, _pack

    ws = np.sort(np.array([3, 9, 11, 200], np.uint64) << np.uint64(40))
    c = Chunk([1, 2], np.array([False, False]), np.array([4, 3]), ws, np.array([0, 1, 0, 3, 0, 1, 3]), 64)
    t = Tokens(c.ids, c.held, c.sizes, [_pack(c.counts(k)[c.gram(k)[1]]) for k in (1, 2, 3)], [_pack(c.own(k).astype(np.uint32)) for k in (1, 2, 3)])
    m = Mixture(7, 3, 2, {k: np.full(64, 0.5) for k in (2, 3)})
    counts, contexts = t.seen(m, 3, False)
    assert counts[2].tolist() == [2, 2, 1, 1, 2, 2, 1] and contexts[2].tolist() == [2, 3, 2, 3, 2, 3, 2]
    assert counts[3].tolist() == [2, 2, 1, 1, 2, 2, 1] and contexts[3].tolist() == [2, 2, 2, 1, 2, 2, 2]
    deleted, _ = t.seen(m, 2, True)
    assert deleted[1].tolist() == [1, 1, 1, 1, 2, 1, 1]


def test_scores_do_not_depend_on_chunks_or_route(spark):
    df = spark.createDataFrame([*rows(), (400, "w1 w2 w3 " * 30_000)], "doc_id long, text string")
    out = F.col("doc_id") % 7 == 2
    ways = ({"chunk_bytes": 10**9}, {"chunk_bytes": 300}, {"chunk_bytes": 300, "bucket_tokens": 4000, "fan_bits": 2})
    one, *more = (sorted((g.doc_id or -1, g.n_known, round(g.score, 6)) for g in lm_scores(df, out, **w).collect()) for w in ways)
    assert all(x == one for x in more)
    assert levels(5, 500, 2) == [(2, 125), (4, 32), (5, 1)] and levels(3, 10**6, 12) == [(3, 1)]
