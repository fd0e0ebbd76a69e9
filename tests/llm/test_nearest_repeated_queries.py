"""Rows of queries that repeat an id are queries of their own."""

import numpy as np

from stratagraph.llm import ann


def test_repeated_query_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 8))
    ids = np.arange(1, 91)
    ids[[10, 20, 30]] = 50  # with row 49, four different vectors of one id
    ids[[60, 61]], m[61] = 100, m[60]  # two equal rows
    vectors = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(ids, m)], "vec_id long, embedding array<double>").repartition(5)
    got = ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect()
    norm = np.sqrt((m * m).sum(axis=1))
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = (m * m[q]).sum(axis=1) / (norm * norm[q])
        s[ids == ids[q]] = -9
        want += [(int(ids[q]), rank, int(ids[c])) for rank, c in enumerate(np.lexsort((ids, -s))[:5], 1)]
    assert len(want) == 30 and sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(want)
