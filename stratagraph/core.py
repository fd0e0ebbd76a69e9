"""Schemas, kinds and the stored-table helper every module uses."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The names of kinds, and the other names each is known by.
SYMBOL_KINDS = ("namespace", "container", "callable", "value", "document")
SYMBOL_KIND_NAMES = {
    "namespace": ("namespace", "ns", "module", "package", "file"),
    "container": ("container", "class", "struct", "trait", "interface"),
    "callable": ("callable", "function", "method", "fn", "def"),
    "value": ("value", "field", "variable", "var", "const", "let"),
    "document": ("document", "doc", "chunk", "text"),
}
EDGE_KINDS = ("defines", "contains", "calls", "references", "inherits", "exports")
EDGE_KIND_NAMES = {
    "defines": ("defines", "define"),
    "contains": ("contains", "contain"),
    "calls": ("calls", "call"),
    "references": ("references", "reference", "ref"),
    "inherits": ("inherits", "inherit", "extends"),
    "exports": ("exports", "export"),
}
DEPENDENCY_KINDS = ("calls", "references", "inherits")  # in order of priority

SCHEMAS = {
    "symbols": "uri string, kind string, name string, path string, line_start int, line_end int, doc string, signature string, content string",
    "edges": "from_uri string, to_uri string, kind string, confidence double, resolution_mode string",
    "embeddings": "uri string, id int, vector array<float>",
    "references": "id bigint, from_uri string, name string, receiver string, scope_id bigint, file_path string, line int, ref_kind string, is_external boolean",
    "imports": "id bigint, file_path string, alias string, target_namespace string, line int",
    "ambiguous_references": "id bigint, reference_id bigint, candidate_uri string, score double",
    "callsite_embeddings": "id bigint, reference_id bigint, vector array<float>",
    "file_hash": "path string, hash string, last_modified timestamp",
}
KEYS = {"symbols": ["uri"], "edges": ["from_uri", "to_uri", "kind"], "embeddings": ["uri", "id"], "file_hash": ["path"]}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder executors share; set only where a session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="stratagraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what iterations stand on."""
    path = f"{shared_dir(df.sparkSession)}/stratagraph-core/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that reach a Python worker at a time.
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows reach Python by their bytes, not ten thousand at a time however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def release() -> None:
    """Give the memory back that a worker's allocators hold but nothing uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])
