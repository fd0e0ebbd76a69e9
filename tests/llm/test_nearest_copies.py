"""Copies of queries and candidates are bounded, dealt by a shuffle and never sent to every task."""

import numpy as np

from stratagraph.llm import ann


def test_copies_of_the_grid():
    for queries, candidates, tasks in ((12_312, 615_384, 200), (468_000, 23_400_000, 600), (10, 500, 200), (0, 0, 1)):
        a, b = ann.grid(queries, candidates, tasks)
        assert a == 1 and queries * b <= 2 * max(1, candidates)
    a, b = ann.grid(1_000_000, 1_000_000, 600)
    assert a * b >= 90 and a + b <= 20


def test_queries_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(ann, "CELL_PAIRS", 64, raising=False)
    rng = np.random.default_rng(5)
    m = np.repeat(rng.normal(size=(60, 8)).astype(np.float32), 5, axis=0)  # every vector five times
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(4)
    got = ann.nearest(vectors, vectors.filter("vec_id % 10 = 0"), 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    d = m.astype(np.float64)
    norm = np.sqrt((d * d).sum(axis=1))
    want = []
    for q in range(0, 300, 10):
        s = (d * d[q]).sum(axis=1) / (norm * norm[q])
        s[q] = -9
        want += [(q, rank, int(c), s[c]) for rank, c in enumerate(np.lexsort((np.arange(300), -s))[:7], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
