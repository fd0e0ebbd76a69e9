"""Steps over all edges read, store and shuffle them no more often than they must."""

from stratagraph.core import SCHEMAS
from stratagraph.operators import link, traverse

EDGES = [("a", "s", "calls", 0.9, "static"), ("a", "s", "calls", 0.9, "static"), ("a", "s", "references", 0.8, "static"), ("b", "a", "inherits", None, "static"), ("c", "b", "calls", 0.7, None), ("s", "t", "contains", 1.0, "static")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_impact_all_stores_edges_as_they_come(spark, monkeypatch):
    kept, stored = [], traverse.stored
    monkeypatch.setattr(traverse, "stored", lambda df: kept.append(df) or stored(df))
    edges = spark.createDataFrame(EDGES, SCHEMAS["edges"])
    got = traverse.impact_all(edges, spark.createDataFrame([("s",), ("a",)], "uri string"), 3).collect()
    assert sorted(map(tuple, got)) == [("a", "b", 1), ("a", "c", 2), ("s", "a", 1), ("s", "b", 2), ("s", "c", 3)]
    own = [df for df in kept if df.columns == ["uri", "next"]]
    assert len(own) == 1 and "Aggregate" not in _plan(own[0])


def test_merged_columns_are_picked_apart(spark):
    edges = spark.createDataFrame(EDGES, SCHEMAS["edges"])
    new = spark.createDataFrame([("a", "s", "calls", 0.9, "semantic"), ("b", "a", "inherits", 0.2, "semantic"), ("c", "b", "calls", 0.1, "semantic")], SCHEMAS["edges"])
    for sure in (False, True):
        got = {tuple(r)[:3]: tuple(r)[3:] for r in link.merge_edges(edges, new, by_confidence=sure).collect()}
        assert got[("a", "s", "calls")] == (0.9, "semantic") and got[("b", "a", "inherits")] == (0.2, "semantic")
        assert got[("c", "b", "calls")] == ((0.7, None) if sure else (0.1, "semantic")) and len(got) == 5
    assert "max_by" not in _plan(link.merge_edges(edges, new, by_confidence=True).drop("resolution_mode"))
