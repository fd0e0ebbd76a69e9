"""Impact of many starts at once, and the best candidate of each key, against plain versions."""

import random

import numpy as np

from stratagraph.core import SCHEMAS
from stratagraph.operators import nearest, traverse


def test_impact_of_all(spark):
    """More starts than a word has bits, cycles, loops, parallel edges and unknown starts; like one start at a time."""
    rnd = random.Random(6)
    nodes = [f"n{k}" for k in range(150)]
    edges = [(rnd.choice(nodes), rnd.choice(nodes), rnd.choice(["calls", "references", "inherits", "contains"]), 1.0, "static") for _ in range(260)] + [("n1", "n1", "calls", 1.0, "static")] * 2
    starts = [*nodes[:140], "unknown", "n1"]
    want = set()
    into = {}
    for a, b, kind, *_ in edges:
        if kind != "contains":
            into.setdefault(b, set()).add(a)
    for s in set(starts):
        seen, frontier = {s}, {s}
        for depth in (1, 2, 3):
            frontier = {x for n in frontier for x in into.get(n, ())} - seen
            seen |= frontier
            want |= {(s, n, depth) for n in frontier}
    e = spark.createDataFrame(edges, SCHEMAS["edges"])
    got = traverse.impact_all(e, spark.createDataFrame([(s,) for s in starts], "uri string").repartition(3), 3).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert traverse.impact_all(e, spark.createDataFrame([("unknown",)], "uri string"), 3).count() == 0


def test_best_by_key(spark, monkeypatch):
    """Light keys share cells, heavy ones are cut; zero, null and odd vectors score 0; ties go to the smaller uri."""
    monkeypatch.setattr(nearest, "LEFT_ROWS", 7)
    monkeypatch.setattr(nearest, "RIGHT_ROWS", 11)
    monkeypatch.setattr(nearest, "CELL_ROWS", 60)
    rng = np.random.default_rng(1)
    key = lambda k: "hot" if k % 3 == 0 else f"k{k % 17}"
    vec = lambda k: None if k % 29 == 28 else [0.0] * 4 if k % 31 == 30 else [1.0] if k % 37 == 36 else [float(np.float32(x)) for x in rng.normal(size=4)]
    left = [(key(k), k, vec(k)) for k in range(200)] + [("lonely", 999, [1.0] * 4)]
    right = [(key(k), f"u{k}", vec(k)) for k in range(180)]
    right += [(k, f"{u}b", v) for k, u, v in right[:50]]
    cosine = lambda a, b: 0.0 if a is None or b is None or len(a) != len(b) or not any(a) or not any(b) else float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    want = {}
    for k, i, a in left:
        scores = sorted((-round(cosine(a, b), 9), u) for n, u, b in right if n == k)
        if scores:
            want[i] = (scores[0][1], -scores[0][0])
    kind = "key string, {} , vector array<float>"
    got = nearest.best_by_key(spark.createDataFrame(left, kind.format("id bigint")).repartition(3), spark.createDataFrame(right, kind.format("uri string")).repartition(3))
    assert {r["id"]: (r["uri"], round(r["score"], 9) + 0.0) for r in got.collect()} == {i: (u, s + 0.0) for i, (u, s) in want.items()}
