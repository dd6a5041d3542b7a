import random
import zlib

import numpy as np
import public_tokenizers

from loomgraph.llm.bpe import codec
from loomgraph.llm.packing import QUERY_TERMS, Corpus, Index, pack, pack_documents, terms_of



def corpus_of(parts):
    df = np.zeros(1 + max([0, *(int(p.max()) for p in parts if len(p))]), np.int64)
    for p in parts:
        df[np.unique(p)] += 1
    return Corpus.of(len(parts), sum(map(len, parts)), df)


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pack_covers_everything_once():
    r = np.random.default_rng(1)
    for n, most in ((1, 10), (50, 64), (200, 300)):
        parts = [r.integers(0, 50, r.integers(0, most)).astype(np.uint32) for _ in range(n)]
        windows = list(pack(parts, 64, corpus_of(parts)))
        seen = [np.zeros(len(p), int) for p in parts]
        for w in windows:
            for i, at, k in w:
                seen[i][at : at + k] += 1
        assert all((s == 1).all() for s in seen)
        assert all(sum(k for _, _, k in w) == 64 for w in windows[:-1])


def test_index_equals_brute_force_bm25():
    r = random.Random(2)
    parts = [np.asarray([r.randrange(30) for _ in range(r.randrange(1, 12))], np.uint32) for _ in range(40)]
    index = Index(parts, corpus_of(parts))
    mean = sum(map(len, parts)) / len(parts)
    for seed in (0, 7):
        want = np.zeros(40)
        for t in index.query[seed]:
            token = index.terms[t]
            df = sum(token in p for p in parts)
            for i, p in enumerate(parts):
                tf = int((p == token).sum())
                want[i] += np.log1p((40 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(p) / mean)) if tf else 0
        index.neighbours(seed, np.ones(40, np.float32), 5)
        want[seed] = 0
        assert np.allclose(index.score, want, atol=1e-4)


def test_index_order_equals_a_sort_by_document_weight_and_term():
    r = np.random.default_rng(6)
    for vocabulary in (12, 200_000):
        parts = [r.integers(0, vocabulary, r.integers(0, 90)).astype(np.uint32) for _ in range(1500)]
        corpus = corpus_of(parts)
        index = Index(parts, corpus)
        doc, token, tf, sizes = terms_of(parts)
        weight = corpus.weights(doc, token, tf, sizes)
        terms, term = np.unique(token, return_inverse=True)
        best = np.lexsort((term, -weight, doc))
        assert index.terms.tolist() == terms.tolist()
        assert index.query == [term[best[doc[best] == i][:QUERY_TERMS]].tolist() for i in range(len(parts))]
        by = np.argsort(term, kind="stable")
        assert (index.docs == doc[by]).all() and (index.weights == weight[by]).all()
        assert index.at.tolist() == np.searchsorted(term[by], np.arange(len(terms) + 1)).tolist()


def test_neighbours_are_alike():
    a = [np.arange(10 * k, 10 * k + 10, dtype=np.uint32) for k in range(5)]
    parts = [a[i % 5] for i in range(30)]
    for w in list(pack(parts, 60, corpus_of(parts))):
        assert len({i % 5 for i, _, _ in w}) == 1


def test_pack_documents(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["one", "two", "three", "four"]) for _ in range(r.choice([3, 90, 4000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "same"), (102, "same"), (None, "x"), (103, "word " * 9000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, start string")
    got = pack_documents(df, PATH, shard_bytes=100_000, with_ids=True).collect()
    pieces = {}
    for g in got:
        assert zlib.crc32(g.ids) == g.ids_crc32 and len(g.ids) == 4 * g.length > 0
        pieces.setdefault(g.doc_id, []).append(g)
    for i, t in rows:
        whole = codec(PATH).encode(t) + np.uint32(1).tobytes()
        mine = sorted(pieces[i], key=lambda g: g.start)
        if i != 102:
            assert b"".join(g.ids for g in mine) == whole
            assert all(g.doc_tokens == len(whole) // 4 for g in mine)
    assert sum(g.length for g in pieces[102]) == 2 * (len(codec(PATH).encode("same")) // 4 + 1)
    short = 0
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append(g)
    for s in by.values():
        s.sort(key=lambda g: g.offset)
        assert [g.offset for g in s] == np.cumsum([0, *[g.length for g in s]])[:-1].tolist()
        n = sum(g.length for g in s)
        assert n <= 2048
        short += n < 2048
    assert short <= max(1, -(-sum(len(t or "") for _, t in rows) // 100_000))
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_neighbours_meet_in_a_shard_whatever_their_number(spark):
    r = random.Random(4)
    topics = [[f"{c}{k}q" for c in "abcdefgh"] for k in range(40)]
    rows = []
    for i in range(1600):
        own = topics[r.randrange(40)]
        rows.append((i, " ".join(r.choice(own) if r.random() < 0.3 else r.choice(["of", "the", "and", "to"]) for _ in range(90)), own[0]))
    df = spark.createDataFrame(rows, "doc_id long, text string, topic string")
    topic = {i: t for i, _, t in rows}
    shares = []
    for shard_bytes in (10**9, 30_000):
        by = {}
        for g in pack_documents(df, PATH, shard_bytes=shard_bytes).collect():
            by.setdefault(g.sequence_id, set()).add(g.doc_id)
        pairs = [(a, b) for s in by.values() for a in s for b in s if a < b]
        shares.append(sum(topic[a] == topic[b] for a, b in pairs) / len(pairs))
    assert shares[0] > 0.6 and shares[1] > 0.6  # by chance: 0.025


def test_window_choice_equals_brute_force():
    r = np.random.default_rng(5)
    parts = [r.integers(0, 25, r.integers(1, 30)).astype(np.uint32) for _ in range(30)]
    corpus = corpus_of(parts)
    index = Index(parts, corpus)
    left, size, used, at, want = [len(p) for p in parts], [len(p) for p in parts], set(), 0, []
    while len(used) < 30:
        at = next(i for i in range(30) if i not in used)
        window, room = [], 50

        def put(i, n, window=window):
            window.append((i, size[i] - left[i], n))
            left[i] -= n
            if not left[i]:
                used.add(i)

        n = min(room, left[at])
        put(at, n)
        room -= n
        while room and len(used) < 30:
            score = np.zeros(30, np.float32)
            for t in index.query[at]:
                a, b = index.at[t], index.at[t + 1]
                score[index.docs[a:b]] += index.weights[a:b]
            near = sorted((i for i in range(30) if i not in used and i != at and score[i] > 0), key=lambda i: (-score[i], i))
            if not near:
                near = [next(i for i in range(30) if i not in used)]
            for i in near:
                if left[i] <= room:
                    n = left[i]
                    put(i, n)
                    room -= n
            if room and (rest := [i for i in near if left[i]]):
                n = min(room, left[rest[0]])
                put(rest[0], n)
                room -= n
        want.append(window)
    assert list(pack(parts, 50, corpus)) == want
