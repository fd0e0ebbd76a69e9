"""Lookups over the fixed-schema tables: each takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import like, short_description


def by_uri(symbols: DataFrame, uri: str) -> DataFrame:
    return symbols.filter(F.col("uri") == uri)


def by_file(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.filter(F.col("path") == path)


def in_file_order(symbols: DataFrame, path: str) -> DataFrame:
    return by_file(symbols, path).orderBy("line_start", "uri")


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter(F.col("name") == name)


def by_name_like(symbols: DataFrame, pattern: str) -> DataFrame:
    return symbols.filter(like(F.col("name"), pattern))


def by_kind(symbols: DataFrame, kind: str) -> DataFrame:
    return symbols.filter(F.col("kind") == kind)


def by_name_and_file(symbols: DataFrame, name: str, path: str) -> DataFrame:
    return symbols.filter((F.col("name") == name) & (F.col("path") == path))


def by_name_and_namespace(symbols: DataFrame, name: str, namespace: str) -> DataFrame:
    return symbols.filter((F.col("name") == name) & like(F.col("uri"), f"%/{namespace}%"))


def without_embedding(symbols: DataFrame, embeddings: DataFrame) -> DataFrame:
    return symbols.join(embeddings.select("uri").distinct(), "uri", "left_anti")


def recent(symbols: DataFrame, limit: int) -> DataFrame:
    return symbols.orderBy("path", "line_start", "uri").limit(limit)


def edges_from(edges: DataFrame, uri: str, kind: str | None = None) -> DataFrame:
    found = edges.filter(F.col("from_uri") == uri)
    return found if kind is None else found.filter(F.col("kind") == kind)


def edges_to(edges: DataFrame, uri: str, kind: str | None = None) -> DataFrame:
    found = edges.filter(F.col("to_uri") == uri)
    return found if kind is None else found.filter(F.col("kind") == kind)


def edges_of_kind(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("kind") == kind)


def imports_of(imports: DataFrame, path: str) -> DataFrame:
    return imports.filter(F.col("file_path") == path).orderBy("id")


def references_named(references: DataFrame, name: str) -> DataFrame:
    return references.filter(F.col("name") == name)


def references_in(references: DataFrame, path: str) -> DataFrame:
    return references.filter(F.col("file_path") == path)


def mark_external(references: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select(F.col("id").alias("hit_id")).distinct()
    return references.join(hit, references["id"] == hit["hit_id"], "left").withColumn("is_external", F.col("is_external") | F.col("hit_id").isNotNull()).drop("hit_id")


def delete_references(references: DataFrame, ids: DataFrame) -> DataFrame:
    return references.join(ids.select("id"), "id", "left_anti")


def primary_embedding(embeddings: DataFrame, uri: str) -> DataFrame:
    return embeddings.filter((F.col("uri") == uri) & (F.col("id") == 0))


def all_embeddings(embeddings: DataFrame) -> DataFrame:
    return embeddings.orderBy("uri", "id")


def symbol_ref(symbols: DataFrame, short: bool = False) -> DataFrame:
    names = {"uri": "u", "kind": "k", "name": "n", "path": "p", "line_start": "s", "line_end": "e", "signature": "g"}
    return symbols.select(*[F.col(c).alias(s if short else c) for c, s in names.items()])


def describe(symbols: DataFrame) -> DataFrame:
    return symbols.select("uri", short_description(F.col("kind"), F.col("name"), F.col("signature")).alias("description"))


def edge_flags(edges: DataFrame) -> DataFrame:
    sure = scoring.is_deterministic(F.col("confidence"))
    return edges.select("from_uri", "to_uri", "kind", sure.alias("deterministic"), (~sure).alias("probabilistic"), scoring.is_dependency(F.col("kind")).alias("dependency"), scoring.is_high_confidence(F.col("confidence")).alias("high_confidence"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("to_uri").alias("from_uri"), F.col("from_uri").alias("to_uri"), "kind", "confidence", "resolution_mode")
