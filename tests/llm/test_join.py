import random

import pytest

from stratagraph.llm import ngram_join


def plain(rows, n, percent):
    sets = {}
    for k, text in rows:
        words = (text or "").encode().lower().split()
        sets[k] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def corpus(seed):
    """Families of near copies whose similarity lies on both sides of the threshold, short and long."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for family in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 3, 8, 14, 22, 30, 45, 80, 160]))]
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            if rnd.random() < 0.3:
                copy = copy[: len(copy) - rnd.randint(0, max(1, len(copy) // 15))]
            rows.append((len(rows), " ".join(copy).upper() if rnd.random() < 0.1 else " ".join(copy)))
    rnd.shuffle(rows)
    return rows + [(len(rows), None), (len(rows) + 1, "")]


@pytest.mark.parametrize(("seed", "n", "percent", "boundary"), [(1, 3, 90, 0), (2, 3, 90, 12), (3, 3, 90, 29), (4, 5, 80, 9), (5, 1, 80, 19), (6, 3, 90, None)])
def test_components_equal_brute_force(spark, monkeypatch, seed, n, percent, boundary):
    monkeypatch.setattr(ngram_join, "TILE", 4)
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n, percent, boundary=boundary).collect()}
    assert got == plain(rows, n, percent)


def test_keys_meet_whatever_the_boundary():
    import numpy as np

    rnd = np.random.default_rng(4)
    for percent in (80, 90):
        for boundary in (0, 9, 15, 25):
            plan = ngram_join.Plan(percent, boundary, rnd.integers(0, 50, 1 << 12).astype(np.uint32))
            for _ in range(300):
                size = int(rnd.integers(1, 120 if boundary < 20 else 30))
                a = np.unique(rnd.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
                b = a[rnd.random(len(a)) > rnd.random() * 0.25]
                b = np.unique(np.concatenate([b, rnd.integers(0, 2**63, int(rnd.integers(0, 1 + size // 8))).astype(np.uint64)]))
                shared = len(np.intersect1d(a, b))
                if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
                    assert len(np.intersect1d(plan.keys(a), plan.keys(b))), (percent, boundary, len(a), len(b), shared)
