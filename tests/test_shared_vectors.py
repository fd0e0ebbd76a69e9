"""Vectors that many callsites share meet them in the cells; a heavy key is cut into few, worked off in strips."""

import numpy as np

from stratagraph.operators import nearest


def test_best_by_key_with_shared_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 60)
    rng = np.random.default_rng(7)
    vectors = [(s, None if s == 5 else [0.0] * 4 if s == 6 else [1.0] if s == 7 else [float(np.float32(x)) for x in rng.normal(size=4)]) for s in range(40)]
    key = lambda k: "hot" if k % 3 else f"k{k % 17}"
    left = [(key(k), k, k % 41) for k in range(400)]  # site 40 has no vector
    right = [(key(k), f"u{k:03}", vectors[k % 39][1]) for k in range(150)]
    sites, shared = spark.createDataFrame(left, "key string, id bigint, site bigint"), spark.createDataFrame(vectors, "site bigint, vector array<float>")
    offered = spark.createDataFrame(right, "key string, uri string, vector array<float>")
    cosine = lambda a, b: 0.0 if a is None or b is None or len(a) != len(b) or not any(a) or not any(b) else float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    want, known = {}, dict(vectors)
    for k, i, s in left:
        scores = sorted((-round(cosine(known[s], b), 9), u) for n, u, b in right if n == k) if s in known else []
        if scores:
            want[i] = (scores[0][1], round(-scores[0][0], 9) + 0.0)
    for rows in (32, 10_000):
        monkeypatch.setattr(nearest, "KEY_ROWS", rows)
        got = nearest.best_by_key(sites.repartition(3), offered.repartition(3), shared)
        assert {r["id"]: (r["uri"], round(r["score"], 9) + 0.0) for r in got.collect()} == want


def test_strips(monkeypatch):
    import pandas as pd

    a, b = (pd.Series([list(map(float, v)) for v in np.random.default_rng(k).normal(size=(n, 3))] + [None, [1.0]]) for k, n in ((1, 20), (2, 9)))
    whole = np.concatenate([s for _, s in nearest._cosines(a, b)])
    monkeypatch.setattr(nearest, "STRIP", 3 * len(b))
    strips = list(nearest._cosines(a, b))
    assert [first for first, _ in strips] == list(range(0, 22, 3)) and max(len(s) for _, s in strips) == 3
    assert np.allclose(np.concatenate([s for _, s in strips]), whole) and whole.shape == (22, 11) and whole[21, 10] == 1.0 and not whole[20].any()
