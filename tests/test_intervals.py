"""Interval labels against walks up the tree."""

import random

import pytest

from stratagraph.operators import intervals


def test_labels_and_lookups(spark, monkeypatch):
    monkeypatch.setattr(intervals, "PIECES", 3)
    rnd = random.Random(3)
    parent = {k: None if k < 4 else rnd.choice([k - 1, rnd.randrange(k), 2]) for k in range(200)}
    parent[777] = 5000  # a parent that is no scope itself
    scopes = spark.createDataFrame(list(parent.items()), "scope_id bigint, parent_id bigint").repartition(4)
    labels = {r["scope_id"]: r for r in intervals.interval_labels(scopes).collect()}

    def chain(s):
        out = []
        while s is not None:
            out.append(s)
            s = parent.get(s)
        return out

    assert set(labels) == {*parent, 5000}
    for s in labels:
        inside = {a for a, r in labels.items() if r["lo"] <= labels[s]["lo"] and labels[s]["hi"] <= r["hi"]}
        assert inside == set(chain(s)) and labels[s]["depth"] == len(chain(s)) - 1
    defined = [(rnd.choice([*parent]), rnd.choice(["x", "y", "z"]), f"u{k}") for k in range(60)] + [(5000, "x", "top")]
    wanted = [(s, name) for s in parent for name in ("x", "y", "z", "none")]
    got = intervals.lexical_lookup(intervals.interval_labels(scopes), spark.createDataFrame(defined, "scope_id bigint, name string, uri string"), spark.createDataFrame(wanted * 2, "scope_id bigint, name string"))
    want = set()
    for s, name in wanted:
        for distance, a in enumerate(chain(s)):
            if own := [u for d, n, u in defined if (d, n) == (a, name)]:
                want.add((s, name, min(own), distance))
                break
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_long_chain_and_rings(spark):
    n = 20_000
    chain = spark.range(n).selectExpr("id as scope_id", "case when id > 0 then id - 1 end as parent_id")
    labels = intervals.interval_labels(chain)
    assert labels.count() == n and labels.filter("lo <> scope_id or depth <> scope_id or hi <> 2 * 20000 - 1 - scope_id").count() == 0
    for rows in ([(1, 2), (2, 1)], [(1, 1)], [(0, None), (1, 2), (2, 3), (3, 1), (4, 3)]):
        with pytest.raises(ValueError):
            intervals.interval_labels(spark.createDataFrame(rows, "scope_id bigint, parent_id bigint"))
    assert intervals.interval_labels(chain.limit(0)).count() == 0
