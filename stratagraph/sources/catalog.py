"""The tables of an index as folders of Parquet files, replaced by whole versions.

A write goes to a new folder; a small pointer file is then swapped in one rename, so readers see
the old or the new version and a failed batch leaves the old one (commit and rollback). All of it
goes through Hadoop's file systems, so the folder may lie on any that driver and executors share.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..core import SCHEMAS, empty


#: Files a task may have open at a time while it writes; with more kinds than that the rest is sorted.
OPEN_FILES = 16


@contextlib.contextmanager
def session_conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` of the session is ``value`` inside, and what it was afterwards."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


class Pointer:
    """A small JSON file that is replaced in one step."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.path = spark._jvm, spark._jsc.hadoopConfiguration(), path

    def _place(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.conf)

    def read(self) -> dict:
        place, files = self._place(self.path)
        if not files.exists(place):
            return {}
        stream = files.open(place)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, value: dict) -> None:
        draft, files = self._place(f"{self.path}.{uuid.uuid4().hex}")
        stream = files.create(draft)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        target = files.makeQualified(self._place(self.path)[0])
        over = self.jvm.java.lang.reflect.Array.newInstance(fs.Options.Rename.OVERWRITE.getClass(), 1)
        over[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(target.toUri(), self.conf).rename(files.makeQualified(draft), target, over)


class Catalog:
    """``root``: a folder on a file system all share; tables are laid out by kind for pruning."""

    LAYOUT = {"symbols": "kind", "edges": "kind"}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.pointer = Pointer(spark, f"{self.root}/current.json")

    def load(self, name: str) -> DataFrame:
        place = self.pointer.read().get(name)
        if place is None:
            return empty(self.spark, name)
        columns = empty(self.spark, name).columns
        return self.spark.read.parquet(f"{self.root}/{place}").select(*columns)

    def load_all(self) -> dict[str, DataFrame]:
        return {name: self.load(name) for name in SCHEMAS}

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Write all of ``tables``, then make them current together."""
        new = {}
        for name, df in tables.items():
            place = f"{name}-{uuid.uuid4().hex}"
            writer = df.select(*empty(self.spark, name).columns).write
            if name in self.LAYOUT:
                writer = writer.partitionBy(self.LAYOUT[name])
            # Kinds are few, so a task keeps a file of each open in place of sorting its rows by kind.
            with session_conf(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
                writer.parquet(f"{self.root}/{place}")
            new[name] = place
        self.pointer.write(self.pointer.read() | new)

    def register_views(self, prefix: str = "") -> None:
        for name, df in self.load_all().items():
            df.createOrReplaceTempView(f"{prefix}{name}")
