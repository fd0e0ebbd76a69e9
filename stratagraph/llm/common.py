"""Shared plumbing of the training-data operators: folders, tables, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a session names none (unit tests on one machine) a temporary folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="stratagraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stratagraph/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it read back: lineage ends here,
    so a lost executor never causes what stands above to be computed again."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows Spark hands to Python at a time. Its own 64 MB, held on both sides by every worker, is
#: more than an executor with a few hundred MB for Python can spare.
ARROW_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = 2048, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that Python holds about ``size`` bytes of text at a time."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            n = min(rows, batch.num_rows - start)
            if text in batch.schema.names:
                while n > 1 and batch.column(text).slice(start, n).nbytes > size:
                    n //= 2
            yield batch.slice(start, n)
            start += n


_HELD: dict[Hashable, object] = {}


def held(name: Hashable, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: one thing at a time.

    Workers outlive jobs. When another operator asks, what the last one kept is given back first, so
    a worker's memory is that of its largest operator, not of all it has ever run.
    """
    if name not in _HELD:
        if _HELD:
            release()
        _HELD[name] = make()
    return _HELD[name]


def trim() -> None:
    """Give the memory back that allocators hold but nothing uses."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release() -> None:
    """Give back what a worker keeps, and the memory its allocators hold."""
    _HELD.clear()
    gc.collect()
    trim()


def afresh() -> None:
    """At the start of a task that keeps nothing: what tasks of other operators kept goes."""
    if _HELD:
        release()


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch]], schema: str, text: str = "text", rows: int = 2048, size: int = 8 << 20, keep: bool = False) -> DataFrame:
    """``mapInArrow`` over bounded slices. ``keep``: what the worker remembers (``held``) outlasts the task."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            afresh()
        for part in slices(batches, text, rows, size):
            out = f(part)
            yield from out if isinstance(out, list) else [out]
        if keep:
            trim()
        else:
            release()

    return df.mapInArrow(run, schema)


def folded(rows: DataFrame, first: str, combine: Callable[[np.ndarray | None, bytes], np.ndarray], width: int) -> DataFrame:
    """(chunk, ``first``): the compressed values of each chunk (chunk, ``first``) combined, as a stream: a task holds one
    result for each chunk it has, whatever the number of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column(first)):
                total[chunk] = combine(total.get(chunk), zlib.decompress(data.as_buffer()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", first])

    return rows.repartition(width, "chunk").mapInArrow(run, f"chunk int, {first} binary")
