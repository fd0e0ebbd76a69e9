"""Incremental indexing: a stream of changed files keeps the tables current.

A batch is ordered by (ts, event_id), the last event of each path is taken, events older than the
state are dropped, and the rest replaces the state of their paths. Old state is read from one
folder and new state written to another, so a batch that is repeated after a failure gives the
same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import shared_dir, stored
from ..sources.catalog import Pointer

STATE = "path string, hash string, ts timestamp, event_id bigint"


def latest(events: DataFrame) -> DataFrame:
    last = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth")


def apply_batch(state: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, changes): changes has path and status of the paths whose content differs.

    ``events``: path, hash (null: removed), ts, event_id. Removed paths stay in the state with a
    null hash, so that a late older event cannot bring them back.
    """
    new = latest(events.select("path", "hash", "ts", "event_id"))
    old = state.select("path", F.col("hash").alias("was"), F.col("ts").alias("was_ts"), F.col("event_id").alias("was_id"), F.lit(True).alias("known"))
    both = old.join(new, "path", "full_outer")
    newer = F.col("event_id").isNotNull() & (F.col("was_id").isNull() | (F.struct("ts", "event_id") > F.struct(F.col("was_ts").alias("ts"), F.col("was_id").alias("event_id"))))
    both = both.withColumn("newer", newer)
    pick = lambda a, b: F.when(F.col("newer"), F.col(a)).otherwise(F.col(b))
    kept = both.select("path", pick("hash", "was").alias("hash"), pick("ts", "was_ts").alias("ts"), pick("event_id", "was_id").alias("event_id"))
    status = F.when(F.col("hash").isNull() & F.col("was").isNotNull(), "removed").when(F.col("hash").isNotNull() & F.col("was").isNull(), "new").when(F.col("hash") != F.col("was"), "modified")
    return kept, both.filter("newer").select("path", status.alias("status")).filter("status is not null")


class IncrementalIndex:
    """State held as stored tables; ``on_changes`` gets each batch's changes (parse, link, embed).

    With a ``folder`` on the shared file system the state outlives the session: a small file there
    names the state before and after the last batch, so a batch that comes again after a failure
    starts from the same state. Without one the state ends with this object.
    """

    def __init__(self, spark: SparkSession, on_changes: Callable[[DataFrame, int], None] | None = None, folder: str | None = None):
        self.spark, self.on_changes, self.folder = spark, on_changes, folder
        self.pointer = None if folder is None else Pointer(spark, f"{folder.rstrip('/')}/state.json")
        known = {} if self.pointer is None else self.pointer.read()
        self.state = self._read(known["after"]) if known else spark.createDataFrame([], STATE)

    def _read(self, place: str | None) -> DataFrame:
        return self.spark.createDataFrame([], STATE) if place is None else self.spark.read.schema(STATE).parquet(place)

    def process(self, events: DataFrame, batch: int = 0) -> None:
        known = {} if self.pointer is None else self.pointer.read()
        again = known.get("batch") == batch
        state, changes = apply_batch(self._read(known["before"]) if again else self.state, stored(events))
        if self.pointer is None:
            state, place = stored(state), None
        else:
            place = f"{self.folder.rstrip('/')}/state-{uuid.uuid4().hex}"
            state.write.parquet(place)
            state = self._read(place)
        if self.on_changes is not None:
            self.on_changes(changes, batch)
        if self.pointer is not None:
            self.pointer.write({"batch": batch, "before": known.get("before") if again else known.get("after"), "after": place})
        self.state = state

    def files(self) -> DataFrame:
        return self.state.filter("hash is not null").select("path", "hash")

    def watch(self, stream: DataFrame, checkpoint: str):
        """Start following a stream of events; the query can be asked for status and stopped."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).start()


def follow(spark: SparkSession, refresh: Callable[[], None], checkpoint: str, seconds: float = 1.0):
    """A streaming query that calls ``refresh`` once a trigger; file systems report no removed files, so
    what changed is found by comparing with what is stored. It can be asked for status and stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: refresh()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def as_changes(events: DataFrame) -> DataFrame:
    """Rows of the test stream as change events."""
    return events.select(F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") != "error", F.floor(F.col("value") / 50).cast("bigint").cast("string")).alias("hash"), "ts", "event_id")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stored table of events as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    one_file = name.endswith(".parquet") and not _is_folder(spark, path)
    return spark.readStream.schema(schema).option("pathGlobFilter", name if one_file else "*.parquet").parquet(folder if one_file else path)


def replay_keyed(spark: SparkSession, path: str) -> DataFrame:
    """Status of every event of a stored table, by the keyed state, run to its end."""
    out = f"{shared_dir(spark)}/stratagraph-core/{uuid.uuid4().hex}"
    found = KeyedState.statuses(as_changes(event_stream(spark, path)))
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(KeyedState.OUTPUT).parquet(out)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Run a stored table of events through the stream machinery to its end; the files then held."""
    stream = event_stream(spark, path)
    index = IncrementalIndex(spark)
    query = as_changes(stream).writeStream.foreachBatch(index.process).option("checkpointLocation", f"{shared_dir(spark)}/stratagraph-core/{uuid.uuid4().hex}").trigger(availableNow=True).start()
    query.awaitTermination()
    return index.files()


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


class KeyedState:
    """The same state kept by Spark: the last hash of each path in a keyed state store."""

    OUTPUT = "path string, status string, event_id bigint"
    STATE = "hash string, ts timestamp, event_id bigint"

    @staticmethod
    def update(key, frames, state):
        import pandas as pd

        was = state.get if state.exists else (None, None, None)
        rows = sorted((r for f in frames for r in f[["ts", "event_id", "hash"]].itertuples(index=False)), key=lambda r: (r[0], r[1]))
        out = []
        for ts, event_id, value in rows:
            value = value if isinstance(value, str) else None
            if was[1] is not None and (ts, event_id) <= (pd.Timestamp(was[1]), was[2]):
                continue
            status = "removed" if value is None else "new" if was[0] is None else "unchanged" if was[0] == value else "modified"
            out.append((key[0], status, event_id))
            was = (value, ts.to_pydatetime(), event_id)
        state.update(was)
        yield pd.DataFrame(out, columns=["path", "status", "event_id"])

    @classmethod
    def statuses(cls, stream: DataFrame) -> DataFrame:
        """Status of every event of a stream (path, hash, ts, event_id), as ``applyInPandasWithState``."""
        return stream.groupBy("path").applyInPandasWithState(cls.update, cls.OUTPUT, cls.STATE, "append", "NoTimeout")
