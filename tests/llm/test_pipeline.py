import random
import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm.bpe import codec
from loomgraph.llm.quality_rules import RULES, Doc
from loomgraph.llm.substring_dedup import MIN_WORDS, substring_dedup


def brute_cut(docs, min_words=MIN_WORDS):
    """docs: (id, text) in rank order."""
    seen, out = {}, {}
    norm = lambda u: b" ".join(u.encode().lower().split()).decode()
    rows = {i: [u for u in re.findall(r"[^\n]*?(?:[.!?,;:|][ \t\r\x0b\x0c]+|\n|\Z)", t) if u] for i, t in docs}
    for i, _ in docs:
        for p, u in enumerate(rows[i]):
            if norm(u):
                seen.setdefault(norm(u), (i, p))
    for i, _ in docs:
        parts = rows[i]
        rep = [bool(norm(u)) and seen[norm(u)] != (i, p) for p, u in enumerate(parts)]
        gone, p = set(), 0
        while p < len(parts):
            if not rep[p]:
                p += 1
                continue
            q = p
            while q + 1 < len(parts) and (rep[q + 1] or not norm(parts[q + 1])):
                q += 1
            while not rep[q]:
                q -= 1
            if sum(len(norm(u).split()) for u in parts[p : q + 1]) >= min_words:
                gone |= set(range(p, q + 1))
            p = q + 1
        out[i] = "".join(u for k, u in enumerate(parts) if k not in gone)
    return out


def sentence(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]) + r.choice(["s", "ing", "ed", "er", "ly", "or"]) for _ in range(n)) + "."


def corpus():
    r = random.Random(4)
    shared = "\n".join(sentence(r, 20) for _ in range(3))
    out = []
    for i in range(40):
        lines = [sentence(r, r.randrange(3, 40)) for _ in range(r.randrange(3, 12))]
        if i % 6 == 1:
            lines.insert(1, shared)
        if i % 5 == 2:
            lines.append("Short line.")
        out.append((i, "\n".join(lines)))
    out += [(50, out[3][1]), (51, out[4][1] + " " + "end"), (52, "### %%% " * 40), (53, "too short"), (54, ""), (55, "12 34 " * 50)]
    return out


def test_substring_dedup(spark):
    docs = corpus()
    df = spark.createDataFrame([*docs, (60, None)], "doc_id long, text string").withColumn("removed", F.lit(1))
    got = substring_dedup(df).collect()
    want = brute_cut(docs) | {60: None}
    assert {g.doc_id: g.text for g in got} == want
    whole = dict(docs)
    for g in got:
        if g.text is not None:
            left, at = "", 0
            for s in g.removed:
                left, at = left + whole[g.doc_id][at : s.start], s.end
            assert left + whole[g.doc_id][at:] == g.text
    twice = substring_dedup(df.union(df)).collect()
    assert sorted((g.doc_id, g.text or "") for g in twice) == sorted((g.doc_id, g.text or "") for g in [*got, *got])
    assert substring_dedup(df.limit(0)).count() == 0
    assert substring_dedup(df, unit="paragraph").count() == len(docs) + 1


def test_passages_inside_lines_and_short_repeats(spark):
    r = random.Random(8)
    passage = " ".join(sentence(r, 12) for _ in range(5))
    around = lambda: sentence(r, 9) + " " + passage + " " + sentence(r, 9)
    line = sentence(r, 20)
    docs = [(1, around()), (2, around()), (3, line + "\nOwn words of three."), (4, "Other words here.\n" + line.upper().replace(" ", "  ")), (5, "As. " + line), (6, "As. La."), (7, "As. La. Le.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {g.doc_id: g for g in substring_dedup(df).collect()}
    assert {i: g.text for i, g in got.items()} == brute_cut(docs)
    assert passage not in got[2].text and len(got[2].text.split()) == 18
    assert [i for i in sorted(got) if got[i].cut] == [2, 4, 5]
    every = {g.doc_id: g.text for g in substring_dedup(df, min_words=1).collect()}
    assert every == brute_cut(docs, 1) and every[6] == "La."


def test_random_texts_equal_brute_force(spark):
    r = random.Random(9)
    docs = []
    for i in range(120):
        t = "".join(" ".join(r.choice(["é", "B", "bb", "C"]) for _ in range(r.randrange(0, 9))) + r.choice([". ", ", ", "\n", "\n\n", "; \t", ".\r\n", " | ", "!? "]) for _ in range(r.randrange(0, 14)))
        docs.append((i, t))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for least in (1, 6):
        got = substring_dedup(df, min_words=least).collect()
        assert {g.doc_id: g.text for g in got} == brute_cut(docs, least)


def test_null_ids_long_texts_and_clashing_names(spark):
    r = random.Random(10)
    line = sentence(r, 30)
    long = " ".join(sentence(r, 30) for _ in range(20_000))
    rows = [(None, line), (None, line), (1, line), (2, None), (3, long), (4, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    odd = ["_doc", "_v", "_units", "_version", "_cut", "_stays", "row", "doc", "version", "units", "rank", "known", "done", "of_doc", "a.b"]
    for c in odd:
        df = df.withColumn(c, F.lit(7))
    out = substring_dedup(df)
    assert out.columns == [*df.columns, "cut", "n_units", "n_removed", "removed"]
    got = out.collect()
    assert all(g[c] == 7 for g in got for c in odd)
    assert sorted((str(g.doc_id), g.text if g.text is None else len(g.text)) for g in got) == sorted([("None", len(line)), ("None", len(line)), ("1", 0), ("2", None), ("3", len(long)), ("4", 0)])
    docs = df.withColumn("cut", F.lit("x")).withColumn("n_chars", F.length("text").cast("long"))
    kept = corpus_pipeline.no_repeats(spark, docs, "")
    assert kept.columns == docs.columns and {k.cut for k in kept.collect()} == {"x"}


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = corpus()
    rows = [(i, t, "en", "s", len(t)) for i, t in docs] + [(99, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    left = [(i, t) for i, t in docs if any(c.isalpha() for c in t)]
    left = [(i, t) for i, t in left if not any(rule.rejects(Doc(t.encode())) for rule in RULES)]
    sets = {i: {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} for i, t in left for w in [t.lower().split()]}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    left = [(i, t) for i, t in left if find(i) == i]
    cut = {i: t for i, t in brute_cut(left).items() if t.strip() or dict(left)[i] == t}
    d = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == df.columns, name
    assert {r.doc_id: r.text for r in d.collect()} == cut
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    c = codec(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {}
    for g in got:
        tokens[g.doc_id] = tokens.get(g.doc_id, 0) + g.length
    assert tokens == {i: len(c.encode(t)) // 4 + 1 for i, t in cut.items()}


def test_near_copies_of_the_pipeline_are_those_of_jaccard(spark):
    r = random.Random(5)
    docs = []
    for g in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(120)]
        docs.append((10 * g, " ".join(words)))
        for k in range(1, 5):  # one place changes five shingles: Jaccard 0.92, 0.84, 0.77, 0.71
            copy = list(words)
            for at in range(10, 10 + 25 * k, 25):
                copy[at] = f"x{r.randrange(5000)}"
            docs.append((10 * g + k, " ".join(copy)))
    docs += [(200, ""), (201, "\n"), (202, "a b"), (203, "a  B")]
    sets = {i: {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} for i, t in docs for w in [t.lower().split()]}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if x == old else x for i, x in root.items()}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id for x in corpus_pipeline.one_of_each(spark, df, "").collect()} == set(root.values())
    assert corpus_pipeline.one_of_each(spark, df.limit(0), "").count() == 0
    again = df.union(df).union(spark.createDataFrame([(None, docs[0][1]), (None, "lone words of a null id"), (None, "lone words of a null id")], df.schema))
    for c in ("_stays", "row", "of_text", "key", "version", "root"):
        again = again.withColumn(c, F.lit(3))
    got = corpus_pipeline.one_of_each(spark, again, "")
    assert got.columns == again.columns
    assert sorted(str(x.doc_id) for x in got.collect()) == sorted([*map(str, set(root.values())), "None"])


def test_buckets_cut_into_pieces_lose_no_link(spark, monkeypatch):
    import loomgraph.llm.simhash as simhash

    monkeypatch.setattr(simhash, "PIECE", 4)
    r = random.Random(6)
    words = [f"w{r.randrange(5000)}" for _ in range(200)]
    docs = [(i, " ".join([*words[:-1], f"x{i}"])) for i in range(30)]  # each pair of them shares 195 shingles of 196
    docs += [(100 + i, " ".join(f"y{r.randrange(5000)}" for _ in range(60))) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.one_of_each(spark, df, "").collect()) == [0, 100, 101, 102, 103, 104]
