"""Scores: cosine, file boost, edge predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import DEPENDENCY_KINDS

# Suffixes of lower-cased paths and the factor a hit in such a file gets, first match first.
BOOSTS = (
    (1.2, (".rs", ".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".c", ".cpp", ".h"), ()),
    (0.9, (".md", ".txt"), ("readme",)),
    (0.7, (".json", ".yaml", ".yml", ".toml"), ()),
    (0.5, (".svg", ".png", ".lock", ".sum"), ("node_modules", "target/")),
)


def file_boost(path: Column) -> Column:
    lower = F.lower(path)
    out = F.lit(1.0)
    for factor, suffixes, parts in reversed(BOOSTS):
        hit = F.lit(False)
        for s in suffixes:
            hit = hit | lower.endswith(s)
        for s in parts:
            hit = hit | lower.contains(s)
        out = F.when(hit, F.lit(factor)).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty or has no length. One pass over both vectors."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    start = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    add = lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"))
    ratio = lambda s: F.when((s["xx"] > 0) & (s["yy"] > 0), s["xy"] / (F.sqrt(s["xx"]) * F.sqrt(s["yy"])))
    return F.coalesce(F.when(F.size(a) == F.size(b), F.aggregate(pairs, start, add, ratio)), F.lit(0.0))


def cosine_to(a: Column, vector: list[float]) -> Column:
    """Cosine to one given vector, whose norm is worked out once and not for every row."""
    given = [float(x) for x in vector]
    length = sum(x * x for x in given) ** 0.5
    if not length:
        return F.lit(0.0)
    pairs = F.zip_with(a, F.array(*[F.lit(x) for x in given]), lambda x, y: F.struct(x.cast("double").alias("x"), y.alias("y")))
    start = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"))
    add = lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"))
    ratio = lambda s: F.when(s["xx"] > 0, s["xy"] / (F.sqrt(s["xx"]) * F.lit(length)))
    return F.coalesce(F.when(F.size(a) == len(given), F.aggregate(pairs, start, add, ratio)), F.lit(0.0))


def clamp(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def is_deterministic(confidence: Column) -> Column:
    return F.abs(confidence - 1.0) < 1.2e-7


def is_dependency(kind: Column) -> Column:
    return kind.isin(*DEPENDENCY_KINDS)


def is_high_confidence(confidence: Column) -> Column:
    return confidence >= 0.9


def impact_label(depth: Column) -> Column:
    return F.when(depth == 1, "[DIRECT]").otherwise("[INDIRECT]")
