"""Hierarchies by interval labels: a node's number when it is entered and left on a tour of the tree.

An ancestor's interval holds those of all below it, so one row a node says as much as a table of all its
ancestors, which on a chain grows with the square. The tour is a linked list, each node twice on it, made
from first children and next siblings; its numbers come from list ranking by pointer doubling: in every
round each element jumps over as much as the round before, so the rounds are the logarithm of the list's
length, and the table stays linear. Children of one parent are chained in pieces, so a parent of very many
children is no single task.

Lookups up the hierarchy are range joins in bins. An interval is a union of a few dyadic cells, a
position lies in one cell of each size. Of the definitions that cover a cell only the innermost counts, so
a position meets at most one row for each size, however deep its chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import stored

#: Pieces that the children of one parent are chained in.
PIECES = 64


def _tour(scopes: DataFrame) -> DataFrame:
    """(e, next, w): the elements of the tour, 2 v on entering node v (w = 1) and 2 v + 1 on leaving it (w = -1)."""
    rows = scopes.select(F.col("scope_id").cast("bigint").alias("v"), F.col("parent_id").cast("bigint").alias("p")).groupBy("v").agg(F.min("p").alias("p"))
    above = rows.select(F.col("p").alias("v")).dropna().distinct().join(rows, "v", "left_anti")
    nodes = stored(rows.unionByName(above.withColumn("p", F.lit(None).cast("bigint"))))
    # Roots are the children of a node that is none.
    child = nodes.select("v", F.col("p").isNull().alias("top"), F.coalesce("p", F.lit(0)).alias("p"), F.pmod(F.xxhash64("v"), F.lit(PIECES)).alias("piece"))
    next_ = F.lead("v").over(Window.partitionBy("top", "p", "piece").orderBy("v"))
    within = child.select("*", next_.alias("sibling"))
    ends = stored(child.groupBy("top", "p", "piece").agg(F.min("v").alias("head"), F.max("v").alias("tail")))
    over = ends.select("top", "p", F.col("tail").alias("v"), F.lead("head").over(Window.partitionBy("top", "p").orderBy("piece")).alias("further"))
    siblings = within.join(over, ["top", "p", "v"], "left").select("v", "top", "p", F.coalesce("sibling", "further").alias("sibling"))
    first = ends.filter("not top").groupBy(F.col("p").alias("v")).agg(F.min_by("head", "piece").alias("first"))
    both = siblings.join(first, "v", "left")
    enter = both.select((2 * F.col("v")).alias("e"), F.coalesce(2 * F.col("first"), 2 * F.col("v") + 1).alias("next"), F.lit(1).cast("bigint").alias("w"))
    leave = both.select((2 * F.col("v") + 1).alias("e"), F.coalesce(2 * F.col("sibling"), F.when(~F.col("top"), 2 * F.col("p") + 1)).alias("next"), F.lit(-1).cast("bigint").alias("w"))
    return enter.unionByName(leave)


def interval_labels(scopes: DataFrame) -> DataFrame:
    """(scope_id, lo, hi, depth) of every scope and every parent that is none: a is an ancestor of s where
    a.lo < s.lo and s.hi < a.hi. Nodes that contain each other are an error."""
    now = stored(_tour(scopes).withColumn("n", F.lit(1).cast("bigint")))
    total = now.count()
    if not total:
        return scopes.sparkSession.createDataFrame([], "scope_id bigint, lo bigint, hi bigint, depth bigint")
    done: DataFrame | None = None
    for _ in range(total.bit_length() + 1):
        ended = now.filter("next is null")
        done = ended if done is None else done.unionByName(ended)
        jump = now.filter("next is not null")
        if jump.isEmpty():
            break
        # What has reached the end is looked up too, but moves no more.
        every = jump.unionByName(done)
        to = every.select(F.col("e").alias("next"), F.col("next").alias("beyond"), F.col("n").alias("n2"), F.col("w").alias("w2"))
        now = stored(jump.join(to, "next").select("e", F.col("beyond").alias("next"), (F.col("w") + F.col("w2")).alias("w"), (F.col("n") + F.col("n2")).alias("n")))
    else:
        raise ValueError("scopes contain each other")
    if done.count() < total:
        raise ValueError("scopes contain each other")
    at = done.select(F.floor(F.col("e") / 2).alias("scope_id"), F.pmod("e", F.lit(2)).alias("side"), (F.lit(total) - F.col("n")).alias("at"), (-F.col("w")).alias("depth"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return at.groupBy("scope_id").agg(of(0, "at").alias("lo"), of(1, "at").alias("hi"), of(0, "depth").alias("depth"))


def _sizes(total: int) -> int:
    return max(1, total.bit_length())


def covered(intervals: DataFrame, sizes: int) -> DataFrame:
    """Rows of ``intervals`` (lo, hi, ...) once for each dyadic cell (size, cell) of their interval."""
    cells = F.expr(f"""
      filter(flatten(transform(sequence(0, {sizes}), k -> array(
        named_struct('size', k, 'cell', shiftright(lo + shiftleft(1L, k) - 1, k), 'ok', shiftright(lo + shiftleft(1L, k) - 1, k) < shiftright(hi + 1, k) and shiftright(lo + shiftleft(1L, k) - 1, k) % 2 = 1),
        named_struct('size', k, 'cell', shiftright(hi + 1, k) - 1, 'ok', shiftright(lo + shiftleft(1L, k) - 1, k) < shiftright(hi + 1, k) and shiftright(hi + 1, k) % 2 = 1)))), x -> x.ok)""")
    return intervals.withColumn("at", F.explode(cells)).withColumn("size", F.col("at.size")).withColumn("cell", F.col("at.cell")).drop("at")


def lexical_lookup(labels: DataFrame, definitions: DataFrame, wanted: DataFrame) -> DataFrame:
    """What ``traverse.lexical_lookup`` finds, from ``interval_labels``: for (scope_id, name) rows the definition
    nearest up the chain, as (scope_id, name, uri, distance)."""
    labels = stored(labels)
    top = labels.agg(F.max("hi")).first()[0]
    sizes = _sizes((top or 0) + 2)
    held = definitions.select("scope_id", "name", "uri").groupBy("scope_id", "name").agg(F.min("uri").alias("uri")).join(labels, "scope_id")
    innermost = covered(held.select("name", "uri", "lo", "hi", "depth"), sizes).groupBy("name", "size", "cell").agg(F.max_by(F.struct("uri", "depth"), "depth").alias("d"))
    cells = F.explode(F.expr(f"transform(sequence(0, {sizes}), k -> named_struct('size', k, 'cell', shiftright(lo, k)))"))
    asked = wanted.select("scope_id", "name").distinct().join(labels.select("scope_id", "lo", F.col("depth").alias("own")), "scope_id").withColumn("c", cells)
    met = asked.select("scope_id", "name", "own", "c.size", "c.cell").join(innermost, ["name", "size", "cell"])
    found = met.groupBy("scope_id", "name").agg(F.max_by(F.struct("d", "own"), "d.depth").alias("x"))
    return found.select("scope_id", "name", F.col("x.d.uri").alias("uri"), (F.col("x.own") - F.col("x.d.depth")).cast("int").alias("distance"))
