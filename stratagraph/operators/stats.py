"""Counts over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import is_deterministic


def db_stats(symbols: DataFrame, edges: DataFrame, embeddings: DataFrame, references: DataFrame, imports: DataFrame, callsites: DataFrame) -> DataFrame:
    """One row of six counts; references marked external are not unresolved."""
    parts = [
        symbols.agg(F.count("*").alias("symbols")),
        edges.agg(F.count("*").alias("edges")),
        embeddings.agg(F.count("*").alias("embeddings")),
        references.agg(F.count_if(~F.col("is_external")).alias("unresolved")),
        imports.agg(F.count("*").alias("imports")),
        callsites.agg(F.count("*").alias("callsite_embeddings")),
    ]
    out = parts[0]
    for one_row in parts[1:]:
        out = out.crossJoin(one_row)
    return out


def graph_stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    sure = is_deterministic(F.col("confidence"))
    return symbols.agg(F.count("*").alias("symbols"), F.countDistinct("path").alias("files")).crossJoin(edges.agg(F.count("*").alias("edges"), F.count_if(sure).alias("deterministic"), F.count_if(~sure).alias("probabilistic")))


def outcome_counts(resolved: DataFrame, column: str = "outcome") -> DataFrame:
    total = resolved.agg(F.count("*").alias("total"))
    return resolved.groupBy(column).agg(F.count("*").alias("n")).crossJoin(total).withColumn("percent", F.round(F.col("n") * 100.0 / F.col("total"), 6)).drop("total")


def degrees(edges: DataFrame) -> DataFrame:
    # Edges are read once; both ends of each leave it together.
    end = lambda column, o, i: F.struct(F.col(column).alias("uri"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = edges.select(F.explode(F.array(end("from_uri", 1, 0), end("to_uri", 0, 1))).alias("e")).select("e.*")
    return ends.groupBy("uri").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
