"""Breadth-first traversal and what is built on it.

Only addresses travel: a level is the frontier joined with the edges, less what was seen. Each
level is stored, so plans stay short and a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import DEPENDENCY_KINDS, stored
from ..functions.scoring import impact_label, is_high_confidence


def reach(edges: DataFrame, start: DataFrame, kind: str | None, incoming: bool, depth: int) -> DataFrame:
    """(uri, depth) of nodes within ``depth`` steps of the uris in ``start``, which are left out."""
    own = edges if kind is None else edges.filter(F.col("kind") == kind)
    here, there = ("to_uri", "from_uri") if incoming else ("from_uri", "to_uri")
    own = own.select(F.col(here).alias("uri"), F.col(there).alias("next"))
    frontier = start.select("uri").distinct()
    seen, found = frontier, None
    for level in range(1, depth + 1):
        new = stored(frontier.join(own, "uri").select(F.col("next").alias("uri")).distinct().join(seen, "uri", "left_anti"))
        if new.isEmpty():
            break
        rows = new.withColumn("depth", F.lit(level))
        found = rows if found is None else found.unionByName(rows)
        seen, frontier = seen.unionByName(new), new
    return found if found is not None else start.select("uri").limit(0).withColumn("depth", F.lit(0))


def traverse(symbols: DataFrame, edges: DataFrame, uri: str, kind: str, incoming: bool, depth: int = 1) -> DataFrame:
    """Known symbols within ``depth``; unknown ones are passed through."""
    start = symbols.sparkSession.createDataFrame([(uri,)], "uri string")
    return reach(edges, start, kind, incoming, depth).join(symbols, "uri")


def callers(symbols: DataFrame, edges: DataFrame, uri: str, depth: int = 1) -> DataFrame:
    return traverse(symbols, edges, uri, "calls", True, depth)


def callees(symbols: DataFrame, edges: DataFrame, uri: str, depth: int = 1) -> DataFrame:
    return traverse(symbols, edges, uri, "calls", False, depth)


def neighbours(symbols: DataFrame, edges: DataFrame, uri: str, kind: str, incoming: bool, distinct: bool = True) -> DataFrame:
    here, there = ("to_uri", "from_uri") if incoming else ("from_uri", "to_uri")
    ends = edges.filter((F.col(here) == uri) & (F.col("kind") == kind)).select(F.col(there).alias("uri"))
    return (ends.distinct() if distinct else ends).join(symbols, "uri")


def references(symbols: DataFrame, edges: DataFrame, uri: str) -> DataFrame:
    return neighbours(symbols, edges, uri, "references", True)


def subclasses(symbols: DataFrame, edges: DataFrame, uri: str) -> DataFrame:
    return neighbours(symbols, edges, uri, "inherits", True)


def superclasses(symbols: DataFrame, edges: DataFrame, uri: str) -> DataFrame:
    return neighbours(symbols, edges, uri, "inherits", False)


def members(symbols: DataFrame, edges: DataFrame, uri: str) -> DataFrame:
    return neighbours(symbols, edges, uri, "contains", False)


def container_of(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """For every contained symbol, the first known container: (uri, container_uri)."""
    known = symbols.select(F.col("uri").alias("from_uri"))
    held = edges.filter(F.col("kind") == "contains").join(known, "from_uri", "left_semi")
    return held.groupBy(F.col("to_uri").alias("uri")).agg(F.min("from_uri").alias("container_uri"))


def impact(edges: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """(uri, depth, edge_kind, confidence, via): who depends on ``start``, each at its least depth.

    Of the edges that reach a node from the level before, calls come before references before
    inherits, then more confident ones, then the smaller parent. A depth of 0 counts as 1.
    """
    kinds = F.create_map(*[F.lit(x) for k, name in enumerate(DEPENDENCY_KINDS) for x in (name, k)])
    own = edges.filter(F.col("kind").isin(*DEPENDENCY_KINDS)).select(F.col("to_uri").alias("via"), F.col("from_uri").alias("uri"), "kind", "confidence")
    frontier = start.select("uri").distinct()
    seen, found = frontier, None
    for level in range(1, max(depth, 1) + 1):
        steps = frontier.withColumnRenamed("uri", "via").join(own, "via").join(seen, "uri", "left_anti")
        best = F.min_by(F.struct("kind", "confidence", "via"), F.struct(kinds[F.col("kind")].alias("p"), (-F.col("confidence")).alias("c"), F.col("via").alias("v")))
        new = stored(steps.groupBy("uri").agg(best.alias("best")).select("uri", F.lit(level).alias("depth"), F.col("best.kind").alias("edge_kind"), F.col("best.confidence").alias("confidence"), F.col("best.via").alias("via")))
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        frontier = new.select("uri")
        seen = seen.unionByName(frontier)
    if found is not None:
        return found
    return start.select("uri").limit(0).select("uri", F.lit(0).alias("depth"), F.lit("").alias("edge_kind"), F.lit(0.0).alias("confidence"), F.lit("").alias("via"))


def impact_all(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, uri, depth): who depends on each of many ``starts`` (uri), at its least depth; starts of their own
    are left out. A depth of 0 counts as 1.

    Sixty-four starts share a word: a row of the frontier is a node and a word, its bits the starts that
    reached the node on this level. A level is one join with the edges; bits that meet in a node are or-ed
    by an aggregate that begins before anything moves, and what earlier levels reached is taken off in the
    same aggregate. Starts and nodes become pairs only in the result. Edges are stored once, and repeated ones stay,
    since a bit set twice is the same bit; nodes nobody depends on leave the frontier before it meets them.
    """
    own = edges.filter(F.col("kind").isin(*DEPENDENCY_KINDS)).select(F.col("to_uri").alias("uri"), F.col("from_uri").alias("next"))
    number = F.monotonically_increasing_id()
    named = stored(starts.select("uri").distinct().withColumn("number", number))
    named = named.select(F.col("uri").alias("start"), F.shiftright("number", 6).alias("word"), F.col("number").bitwiseAND(63).cast("int").alias("bit"))
    mask = F.expr("shiftleft(1L, bit)")
    frontier = stored(named.select(F.col("start").alias("uri"), "word", mask.alias("bits")).groupBy("uri", "word").agg(F.bit_or("bits").alias("bits")))
    seen, found = frontier, None
    own = stored(own)
    heads = stored(own.select("uri").distinct())
    for level in range(1, max(depth, 1) + 1):
        if level > 1:
            frontier = stored(frontier.join(heads, "uri", "left_semi"))
        steps = frontier.join(own, "uri").select(F.col("next").alias("uri"), "word", "bits", F.lit(0).cast("bigint").alias("old"))
        both = steps.unionByName(seen.select("uri", "word", F.lit(0).cast("bigint").alias("bits"), F.col("bits").alias("old")))
        met = both.groupBy("uri", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old"))
        new = stored(met.select("uri", "word", F.col("bits").bitwiseAND(F.bitwise_not("old")).alias("bits")).filter("bits <> 0"))
        if new.isEmpty():
            break
        rows = new.withColumn("depth", F.lit(level))
        found = rows if found is None else found.unionByName(rows)
        seen, frontier = seen.unionByName(new), new
    if found is None:
        return named.limit(0).select("start", F.col("start").alias("uri"), F.lit(0).alias("depth"))
    return found.select("uri", "word", "depth", F.explode(F.expr("filter(sequence(0, 63), i -> shiftright(bits, i) & 1 = 1)")).alias("bit")).join(named, ["word", "bit"]).select("start", "uri", "depth")


def impact_report(symbols: DataFrame, edges: DataFrame, uri: str, depth: int = 3) -> DataFrame:
    start = symbols.sparkSession.createDataFrame([(uri,)], "uri string")
    found = impact(edges, start, depth).join(symbols, "uri")
    return found.withColumn("is_direct", F.col("depth") == 1).withColumn("is_high_confidence", is_high_confidence(F.col("confidence"))).withColumn("label", impact_label(F.col("depth"))).orderBy("depth", F.desc("confidence"), "uri")


def trace(symbols: DataFrame, edges: DataFrame, uri: str, depth: int = 1) -> DataFrame:
    up = callers(symbols, edges, uri, depth).withColumn("direction", F.lit("callers"))
    return up.unionByName(callees(symbols, edges, uri, depth).withColumn("direction", F.lit("callees")))


def analyze(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees, importance, role and a summary of every symbol."""
    into = edges.groupBy(F.col("to_uri").alias("uri")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("from_uri").alias("uri")).agg(F.count("*").alias("out_degree"))
    found = symbols.join(into, "uri", "left").join(out, "uri", "left").fillna(0, ["in_degree", "out_degree"])
    i, o, kind = F.col("in_degree"), F.col("out_degree"), F.col("kind")
    # Texts of roles.
    role = (
        F.when(kind == "namespace", "Component/Module")
        .when(kind == "container", "Data Structure/Type")
        .when(kind == "value", "State/Constant")
        .when(kind == "document", "Documentation/Data")
        .when((i == 0) & (o > 0), "Entry Point/High-level Logic")
        .when((i > 0) & (o == 0), "Utility/Leaf Function")
        .otherwise("Intermediate Logic")
    )
    found = found.withColumn("importance", F.least(F.lit(10.0), 0.5 * i + 1)).withColumn("role", role)
    return found.withColumn("summary", F.format_string("%s %s: %d in, %d out", "kind", "name", "in_degree", "out_degree"))


def explore(symbols: DataFrame, edges: DataFrame, uri: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, kind, val) and links (source, target) around a symbol."""
    around = trace(symbols, edges, uri, depth)
    own = symbols.filter(F.col("uri") == uri).withColumn("direction", F.lit(None).cast("string"))
    nodes = around.select(*symbols.columns).unionByName(own.select(*symbols.columns)).dropDuplicates(["uri"])
    nodes = nodes.select(F.col("uri").alias("id"), "name", "kind", F.when(F.col("kind") == "callable", 2).otherwise(1).alias("val"))
    links = around.select(F.when(F.col("direction") == "callers", F.col("uri")).otherwise(F.lit(uri)).alias("source"), F.when(F.col("direction") == "callers", F.lit(uri)).otherwise(F.col("uri")).alias("target")).distinct()
    return nodes, links


def scope_chain(scopes: DataFrame) -> DataFrame:
    """(scope_id, ancestor, distance) for every scope, itself at distance 0, however deep the chain.

    What is known of the chain doubles with every round: ancestors within 2^k steps, joined with
    themselves, are those within 2^(k+1). A scope that is its own ancestor is an error.
    """
    known = stored(scopes.select("scope_id", F.col("scope_id").alias("ancestor"), F.lit(0).alias("distance")).unionByName(scopes.filter("parent_id is not null").select("scope_id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance"))))
    reach = 1
    while True:
        if not known.filter("distance > 0 and scope_id = ancestor").isEmpty():
            raise ValueError("scopes contain each other")
        top = known.filter(F.col("distance") == reach).select("scope_id", F.col("ancestor").alias("via"))
        further = known.filter("distance > 0").select(F.col("scope_id").alias("via"), "ancestor", "distance")
        new = stored(top.join(further, "via").select("scope_id", "ancestor", (F.col("distance") + reach).cast("int").alias("distance")))
        if new.isEmpty():
            return known
        known, reach = known.unionByName(new), 2 * reach


def lexical_lookup(scopes: DataFrame, definitions: DataFrame, wanted: DataFrame) -> DataFrame:
    """For (scope_id, name) rows, the definition nearest up the chain: adds uri and distance."""
    chain = scope_chain(scopes)
    held = definitions.select(F.col("scope_id").alias("ancestor"), "name", "uri")
    hits = wanted.select("scope_id", "name").distinct().join(chain, "scope_id").join(held, ["ancestor", "name"])
    near = Window.partitionBy("scope_id", "name").orderBy("distance", "uri")
    return hits.withColumn("r", F.row_number().over(near)).filter("r = 1").select("scope_id", "name", "uri", "distance")


def definitions_in(definitions: DataFrame, scope_id: int) -> DataFrame:
    return definitions.filter(F.col("scope_id") == scope_id)
