import random

from loomgraph.operators.components import connected_components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_equal_union_find(spark):
    r = random.Random(5)
    for n, m in ((30, 25), (60, 40)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 130)]
        df = spark.createDataFrame([*edges, (None, 3)], "x long, y long")
        assert {x.node: x.root for x in connected_components(df).collect()} == brute(edges)
    assert connected_components(df.limit(0)).count() == 0
