import random
import re
from collections import Counter

from loomgraph.llm.language_id import BITS, ORDER, fit, grams, language_id, limits, points, predict, symbols
from loomgraph.llm.quality_rules import RULES, Doc, keep_good, plan, quality_rules

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(text):
    b = (text or "").encode()
    words = WORD.findall(b)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in b.split(b"\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(len(w.decode()) for w in words), sum(c in b"#*$%&|<>" for c in b), dup, len(cover)


def texts():
    r = random.Random(3)
    out = [None, "", " ", "x", "éa\x0bb\x85c d", "w " * 50, "a b c d e f g h " * 3, "\n\n a\n a\r\n a\n"]
    for _ in range(40):
        out.append("".join(r.choice(["a", "bb", "c#", "é"]) + r.choice([" ", " ", "\n", "\t"]) for _ in range(r.choice([5, 30, 200]))))
    return out


def test_counts_equal_brute_force(spark):
    rows = [(i, t, True) for i, t in enumerate(texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, kept boolean")
    got = quality_rules(df).collect()
    assert len(got) == len(rows)
    for g in got:
        n = brute(rows[g.doc_id][1])
        assert tuple(g)[1:6] == n
        assert g.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (g.kept and g.base_failed)
    kept = Counter(g.doc_id for g in got if g.kept)
    assert Counter(r.doc_id for r in keep_good(df).collect()) == kept
    assert keep_good(df).columns == df.columns
    assert quality_rules(df.limit(0)).count() == 0


def test_order_is_by_rejection_per_cost(spark):
    df = spark.createDataFrame([(i, "### " * 30) for i in range(50)], "doc_id long, text string")
    order = plan(df)
    assert sorted(r.name for r in order) == sorted(r.name for r in RULES)
    assert order.index(next(r for r in RULES if r.name == "symbols")) < order.index(next(r for r in RULES if r.name == "capitals"))
    assert Doc(b"A" * 10).upper_share == 1.0


SAMPLES = {
    "xx": ["the cat sat on the mat with the hat and that was that " * 3 + str(i) for i in range(30)],
    "yy": ["der hund und die katze sind nicht im haus weil es regnet " * 3 + str(i) for i in range(30)],
}


def test_kneser_ney_sums_to_one():
    import numpy as np

    m = fit(SAMPLES)
    codes, _ = grams(["the c"], symbols(m.letters))
    history = codes[-1] & ~np.uint32(63)
    p = np.exp2(m.log2(history + np.arange(64, dtype=np.uint32)).astype(float)).sum(axis=0)
    assert np.allclose(p, 1.0, atol=1e-4)


def brute_kneser_ney(texts, table):
    """The textbook estimator over dictionaries: probability of each symbol after a history, by orders 1 to ORDER."""
    seen = Counter()
    for t in texts:
        codes = [0] * (ORDER - 1) + [int(table[c]) for c in points(t)]
        for i in range(ORDER - 1, len(codes)):
            if codes[i] or codes[i - 1]:
                seen[tuple(codes[i - ORDER + 1 : i + 1])] += 1
    counts = {ORDER: seen}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {}
    for k, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(history, w, k=ORDER):
        if k == 0:
            return 2.0**-BITS
        h = history[len(history) - k + 1 :]
        after = {g[-1]: v for g, v in counts[k].items() if g[:-1] == h}
        if not after:
            return p(history, w, k - 1)
        total = sum(after.values())
        return max(after.get(w, 0) - d[k], 0) / total + d[k] * len(after) / total * p(history, w, k - 1)

    return p


def test_kneser_ney_equals_the_textbook():
    import numpy as np

    m = fit(SAMPLES)
    table = symbols(m.letters)
    for j, lang in enumerate(m.langs):
        p = brute_kneser_ney([t for i, t in enumerate(SAMPLES[lang]) if i % 5], table)
        text = "the katze sat, im zug!  und 7 hats"
        codes, n = grams([text], table)
        got = -m.log2(codes)[:, j]
        row = [0] * (ORDER - 1) + [int(table[c]) for c in points(text)]
        want = [p(tuple(row[i - ORDER + 1 : i]), row[i]) for i in range(ORDER - 1, len(row)) if row[i] or row[i - 1]]
        assert len(want) == n[0] and np.allclose(np.exp2(-got), want, rtol=1e-4)


def test_rejection_follows_the_calibration_texts():
    import numpy as np

    bits = np.concatenate([np.tile([1.0, 3.0], 200), [9.0] * 4, np.full(396, 2.0)])
    got = limits(bits, np.array([400, 400]))
    assert got[:4] == [16.0, 16.0, 16.0, 9.0] and got[4:] == [9.0] * (len(got) - 4)  # from 16 positions on there are under 100 pieces
    assert limits(np.zeros(0), np.zeros(0, int)) == [float("inf")] * len(got)


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(100 * k + i, f"{letters[k % 26]}{letters[k // 26]}{letters[k % 7]} " * 30, f"l{k:03d}") for k in range(230) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = predict(df, language_id(df, df)).collect()
    assert len({g.lang_pred for g in got}) > 200


def test_language_id(spark):
    rows = [(i, t, k) for k, v in SAMPLES.items() for i, t in enumerate(v)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = [(100, None, None), (101, "", "xx"), (102, "12 34 !?", "xx"), (103, "that cat and that hat", None), (103, "that cat and that hat", None), (104, "die katze und der hund " * 5000, "xx")]
    both = df.union(spark.createDataFrame(odd, df.schema)).withColumn("score", df.doc_id)
    got = predict(both, language_id(df, both)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {(g.doc_id, g.lang_pred) for g in got if g.doc_id > 99}
    assert by == {(100, "und"), (101, "und"), (102, "und"), (103, "xx"), (104, "yy")}
    assert all(0 <= g.score <= 1 for g in got)
    none = df.limit(0)
    assert predict(none, language_id(none, none)).count() == 0
    assert {g.lang_pred for g in predict(df, language_id(none, df)).collect()} == {"und"}
