"""The default registry, and extraction of a table of files into rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import ARROW_BYTES, SCHEMAS, bounded_batches, release, stored
from . import braces, chunker, python_source
from .model import Extraction, Registry


def chunk_file(repo: str, path: str, content: str) -> Extraction:
    """A document as chunks."""
    out = Extraction(repo, path)
    found = chunker.split(content)
    for name, c in zip(chunker.names(path, found), found):
        out.symbol("document", name, c.line_start, c.line_end, c.content)
    return out


def default_registry() -> Registry:
    registry = Registry()
    registry.register("python", ("py", "pyi"), python_source.parse)
    registry.register("javascript", ("js", "jsx", "mjs", "cjs"), partial(braces.parse, "js"))
    registry.register("rust", ("rs",), partial(braces.parse, "rust"))
    registry.register("go", ("go",), partial(braces.parse, "go"))
    return registry


def extract(files: DataFrame, repo: str, registry: Registry | None = None) -> dict[str, DataFrame]:
    """symbols, edges, references and imports of files (path, content). Each file is parsed once,
    on an executor; rows of one symbol written twice are one."""
    registry = registry or default_registry()
    bounded_batches(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = lambda rows: pd.DataFrame(rows, columns=["tab", "row"])
        for frame in frames:
            rows, size = [], 0
            for path, content in zip(frame["path"], frame["content"]):
                found = registry.parse(repo, path, content or "", chunk_file)
                for table in ("symbols", "edges", "references", "imports"):
                    for r in getattr(found, table):
                        rows.append((table, json.dumps(r)))
                        size += len(rows[-1][1])
                        if size >= ARROW_BYTES:
                            yield made(rows)
                            rows, size = [], 0
            yield made(rows)
        release()

    # Stored, since four tables are read from it.
    rows = stored(files.select("path", "content").mapInPandas(run, "tab string, row string"))
    out = {}
    for table in ("symbols", "edges", "references", "imports"):
        schema = SCHEMAS[table]
        out[table] = rows.filter(F.col("tab") == table).select(F.from_json("row", schema).alias("r")).select("r.*")
    out["symbols"] = out["symbols"].dropDuplicates(["uri"])
    out["edges"] = out["edges"].dropDuplicates(["from_uri", "to_uri", "kind"])
    for table in ("references", "imports"):
        columns = [c for c in out[table].columns if c != "id"]
        out[table] = out[table].withColumn("id", F.xxhash64(*columns)).dropDuplicates(["id"])
    return out
