import re

from loomgraph.operators import search

NODES = [
    ("src/retry/http.js:Client.handleError", "handleError", "method", "src/retry/http.js", False, "net", "product"),
    ("src/errors.js:error", "error", "function", "src/errors.js", True, None, "product"),
    ("tests/errors.test.js:errorCase", "errorCase", "function", "tests/errors.test.js", True, "tests", "test"),
    ("src/errors.js:<module>", "<module>", "module", "src/errors.js", False, "errors", "product"),
    ("b/x.js:Handlers.go", "go", "method", "b/x.js", None, "", "bench"),
    (None, None, None, None, None, None, None),
]
EDGES = [("a", "src/errors.js:error", "call"), ("b", "src/errors.js:error", "call"), ("b", "src/errors.js:error", "import"), ("b", "src/errors.js:error", "ref")]


def stem(w):
    if len(w) > 4 and w.endswith("ies"):
        return w[:-3] + "y"
    for n, ends in ((5, ("ing",)), (4, ("ed", "es", "er")), (3, ("s",))):
        if any(len(w) > n and w.endswith(e) and not (e == "s" and w.endswith("ss")) for e in ends):
            w = w[: -len(next(e for e in ends if w.endswith(e)))]
            break
    return w[:-1] if len(w) > 4 and w.endswith("e") else w


def split(s):
    s = re.sub("([a-z0-9])([A-Z])", r"\1 \2", s or "")
    return [x for x in re.split("[^a-z0-9]+", re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", s).lower()) if x]


def brute(query):
    words = list(dict.fromkeys(stem(w) for w in split(query) if w not in search.STOP))
    out = {}
    for id_, label, kind, file, exports, domain, role in NODES[:-1]:
        joined = [stem(w) for w in split(label)]
        tail = id_.rsplit(":", 1)[-1]
        segs = file.split("/")
        places = [set(joined), set(joined if tail == label else [stem(w) for w in split(tail)]), {stem(w) for w in split(re.sub(r"\.[^.]+$", "", segs[-1]))}, {stem(w) for s in segs[:-1] for w in split(s)}, {stem(w) for w in split(domain)}]
        base = matched = 0
        for w in words:
            hit = 3 if w in places[0] else 1.5 if len(w) >= 3 and any(x.startswith(w) for x in places[0]) else next((v for p, v in zip(places[1:], (1.5, 2, 1, 0.75), strict=True) if w in p), 0)
            base, matched = base + hit, matched + (hit > 0)
        if matched:
            base += 4 * ("".join(joined) == "".join(words))
            factor = (1.25 if exports else 1) * (0.4 if kind == "module" else 1) * (1 if {"test", "spec"} & set(words) else {"test": 0.6, "bench": 0.5}.get(role, 1.2))
            degree = len({(a, k) for a, b, k in EDGES if b == id_ and k in ("call", "import")})
            out[id_] = round(base * matched / len(words) * factor * (1 + min(degree, 20) / 40), 6)
    return out


def test_find_equals_brute_force(spark):
    nodes = spark.createDataFrame(NODES, "id string, label string, kind string, file string, exports boolean, domain string, role string")
    edges = spark.createDataFrame(EDGES, "src string, dst string, kind string")
    index = search.build_index(nodes, edges)
    queries = ["where is the error handled?", "error", "errors handle client", "test error", "hand", "retries in http", "net go handler", "the of", "", None, "ab"]
    got = {}
    for r in search.find(index, spark.createDataFrame(list(enumerate(queries)), "query int, text string")).collect():
        got.setdefault(r.query, {})[r.id] = r.score
    assert got == {i: b for i, q in enumerate(queries) if (b := brute(q))}
    plan = search.find(index, spark.createDataFrame([(0, "error")], "query int, text string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(head" in plan.replace("\n", "")  # the folders of other words are not read
    index.drop()
