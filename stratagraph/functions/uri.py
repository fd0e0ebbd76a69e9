"""Symbol addresses ``codescope://repo/path#kind:name@line`` and kind names, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import EDGE_KIND_NAMES, SYMBOL_KIND_NAMES

SCHEME = "codescope://"
# The first # ends the path, the first / of the rest ends the repository, the first : after the #
# ends the kind, and the last @ begins the line.
PATTERN = r"(?s)^codescope://([^/#]*)/([^#]*)#([^:]*):(.*)@([0-9]+)$"
LARGEST_LINE = 2**32 - 1


def build(repo: Column | str, path: Column, kind: Column, name: Column, line: Column) -> Column:
    repo = F.lit(repo) if isinstance(repo, str) else repo
    return F.concat(F.lit(SCHEME), repo, F.lit("/"), path, F.lit("#"), kind, F.lit(":"), name, F.lit("@"), line.cast("string"))


def parse_kind(text: Column, names: dict[str, tuple[str, ...]] = SYMBOL_KIND_NAMES) -> Column:
    """The kind a name stands for, whatever its case; null for unknown names."""
    lower = F.lower(text)
    return reduce(lambda rest, item: F.when(lower.isin(*item[1]), F.lit(item[0])).otherwise(rest), names.items(), F.lit(None).cast("string"))


def parse_edge_kind(text: Column) -> Column:
    return parse_kind(text, EDGE_KIND_NAMES)


def parse(uri: Column) -> Column:
    """struct(repo, path, kind, name, line), or null where the address is malformed."""
    part = [F.regexp_extract(uri, PATTERN, k) for k in range(1, 6)]
    line = part[4].try_cast("bigint")
    kind = parse_kind(part[2])
    good = uri.rlike(PATTERN) & kind.isNotNull() & (line <= LARGEST_LINE)
    return F.when(good, F.struct(part[0].alias("repo"), part[1].alias("path"), kind.alias("kind"), part[3].alias("name"), line.alias("line")))


def is_valid(uri: Column) -> Column:
    return F.coalesce(parse(uri).isNotNull(), F.lit(False))
