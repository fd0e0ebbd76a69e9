"""Text and vector search."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import SYMBOL_KIND_NAMES
from ..functions.scoring import cosine, cosine_to, file_boost
from ..functions.text import has_all_words, like
from .lookup import recent


def search_content(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 10) -> DataFrame:
    """All words in content, name or doc; best file boost first. A blank query lists recent symbols."""
    if not query.split():
        return recent(symbols if kind is None else symbols.filter(F.col("kind") == kind), limit)
    found = symbols.filter(has_all_words(query, F.col("content"), F.col("name"), F.col("doc")))
    found = found if kind is None else found.filter(F.col("kind") == kind)
    return found.orderBy(file_boost(F.col("path")).desc(), "path", "line_start", "uri").limit(limit)


def search_vector(symbols: DataFrame, embeddings: DataFrame, vector: list[float] | Column, limit: int = 10) -> DataFrame:
    """Best embedding row of each symbol by cosine times file boost."""
    cos = cosine(F.col("vector"), vector) if isinstance(vector, Column) else cosine_to(F.col("vector"), vector)
    scored = embeddings.select("uri", cos.alias("cos"))
    # The score of a symbol's best row does not change with the factor's order: the factor is positive.
    best = scored.groupBy("uri").agg(F.max("cos").alias("cos")).join(symbols, "uri")
    return best.withColumn("score", F.col("cos") * file_boost(F.col("path"))).drop("cos").orderBy(F.desc("score"), "uri").limit(limit)


def search_name(symbols: DataFrame, pattern: str, limit: int = 10) -> DataFrame:
    wrapped = pattern if "%" in pattern else f"%{pattern}%"
    score = F.when(F.lower("name") == pattern.lower(), F.lit(1.0)).otherwise(F.lit(0.5))
    return symbols.filter(like(F.col("name"), wrapped)).withColumn("score", score).orderBy(F.desc("score"), "name", "uri").limit(limit)


def search_kind(symbols: DataFrame, kind: str, part: str | None = None, limit: int = 10) -> DataFrame:
    found = symbols.filter(F.col("kind") == kind)
    if part is not None:
        found = found.filter(F.lower("name").contains(part.lower()))
    return found.orderBy("name", "uri").limit(limit)


def search(symbols: DataFrame, embeddings: DataFrame | None, query: str, embed=None, kind: str | None = None, exact: bool = False, limit: int = 10, fill: Callable[[], DataFrame] | None = None) -> tuple[str, DataFrame]:
    """(mode, results): vector search unless exact words are asked for.

    Where there are no vectors ``fill`` makes them. Without a query vector (none can be made, or
    making it fails) or without any vectors the search is by words: ``fallback_exact``.
    """
    vector = None
    if not exact and query.strip() and embed is not None:
        try:
            vector = embed(query)
        except Exception as problem:  # a model that cannot be reached must not end a search
            warnings.warn(f"search by words, since embedding failed: {problem}", stacklevel=2)
    if vector is not None:
        held = embeddings
        if (held is None or held.isEmpty()) and fill is not None:
            held = fill()
        if held is not None and not held.isEmpty():
            return "vector", search_vector(symbols, held, vector, limit)
    mode = "exact" if exact or not query.strip() else "fallback_exact"
    return mode, search_content(symbols, query, kind, limit).withColumn("score", F.lit(1.0))


def search_web(symbols: DataFrame, embeddings: DataFrame, query: str, embed, kind: str | None = None, vector: bool = False, limit: int = 10) -> DataFrame:
    """Search as the web server answers it: by words unless ``vector`` is asked for; symbols without
    scores; a kind that is not known counts as none given, and vector search takes no kind."""
    if vector and query.strip():
        return search_vector(symbols, embeddings, embed(query), limit).select(*symbols.columns)
    return search_content(symbols, query, known_kind(kind), limit)


def known_kind(kind: str | None) -> str | None:
    """A kind by any of its names; one that is not known counts as none."""
    found = [k for k, others in SYMBOL_KIND_NAMES.items() if kind and kind.strip().lower() in others]
    return found[0] if found else None


def search_text(symbols: DataFrame, embeddings: DataFrame, query: str, embed, limit: int = 10) -> DataFrame:
    """Search as the tool server answers it, by vectors alone: (place, score, line), a piece of text for
    each result, best first."""
    found = search_vector(symbols, embeddings, embed(query), limit)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "uri"))  # of at most ``limit`` rows
    signature = F.coalesce(F.concat(F.lit("  Sig: "), "signature", F.lit("\n")), F.lit(""))
    line = F.concat(F.format_string("- %s (%s) [score: %.2f]\n  %s\n", "name", "kind", "score", "uri"), signature)
    return found.select("uri", place.alias("place"), "score", line.alias("line"))


def as_text(found: DataFrame) -> str:
    """One text of the few rows of ``search_text``."""
    return "".join(r["line"] for r in found.orderBy("place").collect()) or "No results found."


def rag_top_k(chunks: DataFrame, vector: list[float], k: int = 5) -> DataFrame:
    """Chunks (chunk_id, vector, ...) by cosine alone."""
    return chunks.withColumn("score", cosine_to(F.col("vector"), vector)).orderBy(F.desc("score"), "chunk_id").limit(k)


def best_per_symbol(embeddings: DataFrame, vector: list[float]) -> DataFrame:
    """(uri, best): the cosine of each symbol's best vector."""
    return embeddings.groupBy("uri").agg(F.max(cosine_to(F.col("vector"), vector)).alias("best"))
