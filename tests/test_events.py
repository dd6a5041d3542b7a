import random
from collections import Counter
from itertools import combinations

from loomgraph.plans import event_queries


def test_shared_quantities_are_dealt_to_more_tasks_as_lines_grow(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    lines = [(r.choice([None, *range(60)]), r.choice([None, *range(12)])) for _ in range(600)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    n = Counter(x for x in lines if None not in x)
    want = Counter()
    for p in range(60):
        for a, b in combinations([s for s in range(12) if n[p, s]], 2):
            want[a, b] += min(n[p, a], n[p, b])
    monkeypatch.setattr(event_queries, "ROWS_A_TASK", 50, raising=False)
    got = event_queries.a11_shared(spark, str(tmp_path))
    assert {(x.a, x.b): x.shared for x in got.collect()} == want
    assert got.rdd.getNumPartitions() >= 12  # the session has 4
