"""Centroid clustering against integers of unlimited size, in one process."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import centroids

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows, k=8, rounds=10, seed=3):
    kept = []
    for key, vector in rows:
        if vector is not None and len(vector) == 64 and all(x is not None and np.isfinite(x) for x in vector):
            v = [int(np.floor(np.float64(x) * 1024)) if abs(x) < 2**53 else int(x) * 1024 for x in vector]
            if max(map(abs, v)) < 1 << 63:
                kept.append((key, v))
    first = sorted((hashlib.sha256(f"{seed}:{key}".encode()).hexdigest(), v) for key, v in kept if key is not None)[:k]
    centres = [v for _, v in first]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centres)), key=lambda j: (distance(v, centres[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for j in range(len(centres)):
            held = [v for (_, v), o in zip(kept, own) if o == j]
            if held:
                centres[j] = [sum(x) // len(held) for x in zip(*held)]
    out = [(key, j, distance(v, centres[j])) for key, v in kept for j in [near(v)]]
    return [(key, j, d, sum(x for _, o, x in out if o == j), sum(x for _, _, x in out), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for key, j, d in out]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(centroids.op13_centroids(spark, DATA)) == sorted(plain(rows), key=repr)


def test_overlapping_intervals_are_decided_in_integers():
    """Centroids so close that float32 cannot tell them apart: the smallest distance, then the lowest number."""
    rng = np.random.default_rng(7)
    base = rng.integers(-(1 << 20), 1 << 20, 64)
    centres = np.stack([base + rng.integers(-2, 3, 64) for _ in range(8)])
    centres[5] = centres[2]
    rows = np.concatenate([base + rng.integers(-3, 4, (400, 64)), rng.integers(-(1 << 20), 1 << 20, (100, 64)), centres])
    got, open_ = centroids.nearest(rows, centres)
    d = ((rows[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    assert (got == d.argmin(axis=1)).all() and open_.mean() > 0.5 and 5 not in got[-8:]
    apart = centres * 0 + (np.arange(8) << 16)[:, None]
    assert not centroids.nearest(apart + 5, apart)[1].any()


def test_error_bound_holds():
    """The true value always lies in its interval, also where products cancel."""
    rng = np.random.default_rng(11)
    for scale in (8, 1 << 12, 1 << 26):
        v, c = (rng.integers(-scale, scale + 1, (300, 64)) for _ in range(2))
        c[::2] = -v[::2] + rng.integers(-1, 2, v[::2].shape)
        product = (v.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
        true = (v.astype(object) @ c.astype(object).T).astype(np.float64)
        norms = np.sqrt((v.astype(float) ** 2).sum(1))[:, None] * np.sqrt((c.astype(float) ** 2).sum(1))[None, :]
        assert (np.abs(product - true) <= centroids.ERROR * norms).all()


def test_edge_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=64).tolist()) for k in range(40)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[5][1]), (50, None), (51, []), (52, [1.0] * 63), (53, [*rows[0][1][:63], None]), (54, [*rows[0][1][:63], float("nan")]), (55, [float("inf"), *rows[0][1][:63]]), (56, [0.0] * 64), (57, [1e12] * 64), (58, [-1e5] * 64), (59, [1e300] * 64), (60, [1e15, *[0.5] * 63])]
    vectors = spark.createDataFrame([(*r, *["clash"] * 3) for r in rows], "vec_id long, embedding array<double>, cluster string, key string, v string").repartition(4)
    want = [tuple(None if isinstance(x, int) and x >= 1 << 63 else x for x in r) for r in plain(rows)]
    assert rows_of(centroids.clusters(vectors)) == sorted(want, key=repr) and len(want) == 47
    few = vectors.filter("vec_id in (3, 4)")
    assert rows_of(centroids.clusters(few)) == sorted(plain(rows[3:5]), key=repr)
    assert rows_of(centroids.clusters(vectors.limit(0))) == []
    same = vectors.filter("vec_id = 7").union(vectors.filter("vec_id = 7")).withColumn("vec_id", F.monotonically_increasing_id())
    assert {r["cluster"] for r in centroids.clusters(same).collect()} == {0}
