"""Connected components on DataFrames by alternating large-star and small-star steps.

Each step replaces every edge by edges to the smallest neighbour, so the edge table never grows,
and the number of rounds is logarithmic in the longest path. Nothing is collected but two numbers
a round; every round is written to the shared folder, so lineage stays short and a lost executor
costs one round at most. Hubs are reduced by partial aggregation (min) before the shuffle, and
the joins that follow are plain equi-joins that adaptive execution splits where a hub is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges that does not depend on order."""
    one = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return one[0], one[1]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Edges with a null end are ignored, loops give a node on its own. Any orderable type works.
    """
    # Stored first, so that what makes the edges runs once and no filter is pushed into it.
    pairs = materialize(edges.select(F.col(src).alias("x"), F.col(dst).alias("y")), "pairs").dropna()
    alone = pairs.filter("x = y").select(F.col("x").alias("node")).distinct()
    now = materialize(pairs.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a")
        now = materialize(small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = found.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
