"""Degrees read the edges once."""

from stratagraph.operators import stats


def test_edges_are_read_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", None), ("c", "c")], "from_uri string, to_uri string").repartition(3, "from_uri")
    found = stats.degrees(edges)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", 0, 2), ("b", 2, 1), (None, 1, 0), ("c", 1, 1)], key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
