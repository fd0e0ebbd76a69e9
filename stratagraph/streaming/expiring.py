"""The state of changing files with a watermark and timers: ordered, bounded, and forgotten in time.

Events (path, hash or null where removed, ts, event_id) may come late by up to ``delay``. Until the
watermark passes an event's time it waits in the state store, under its millisecond; a timer then takes
just the events of that millisecond, so a path of very many events is never one list. Events are applied
in order of (ts, event_id), however they came in. An event whose time the watermark had passed before its
batch is dropped. What is remembered of a removed file goes ``keep`` after it was removed, by another
timer, unless the file has come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "path string, status string, ts timestamp, event_id bigint"
_EVENTS = "events array<struct<ts bigint, event_id bigint, hash string>>"
#: State lives in this store; the default one has no timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _micros(ts) -> int:
    return int(pd.Timestamp(ts).value // 1000)


class Paths(StatefulProcessor):
    """One path: what it holds now, the events that wait, and timers for both."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "hash string, ts bigint, event_id bigint")
        self.waiting = handle.getMapState("waiting", "ms bigint", _EVENTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            micros = [_micros(t) for t in frame["ts"]]
            for ts, event_id, value in zip(micros, frame["event_id"], frame["hash"]):
                ms = ts // 1000
                if ms < passed:
                    continue
                held = [tuple(x) for x in self.waiting.getValue((ms,))[0]] if self.waiting.containsKey((ms,)) else []
                if not held:
                    self.handle.registerTimer(ms)
                self.waiting.updateValue((ms,), ([*held, (ts, int(event_id), value if isinstance(value, str) else None)],))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        was = self.now.get() if self.now.exists() else (None, None, None)
        if self.waiting.containsKey((ms,)):
            for ts, event_id, value in sorted((tuple(x) for x in self.waiting.getValue((ms,))[0]), key=lambda e: e[:2]):
                status = "removed" if value is None else "new" if was[0] is None else "unchanged" if was[0] == value else "modified"
                out.append((key[0], status, pd.Timestamp(ts, unit="us"), event_id))
                was = (value, ts, event_id)
            self.waiting.removeKey((ms,))
            self.now.update(was)
            if was[0] is None:
                self.handle.registerTimer(was[1] // 1000 + self.keep_ms)
        if was[1] is not None and was[0] is None and was[1] // 1000 + self.keep_ms <= ms:
            self.now.clear()
        if out:
            yield pd.DataFrame(out, columns=["path", "status", "ts", "event_id"]).astype({"path": object, "status": object, "event_id": "int64"})

    def close(self) -> None:
        pass


def statuses(stream: DataFrame, delay: str = "1 hour", keep_seconds: int = 7 * 24 * 3600) -> DataFrame:
    """Status of every event of a stream, given once the watermark has passed it."""
    use_store(stream.sparkSession)
    held = stream.withWatermark("ts", delay).groupBy("path")
    return held.transformWithStateInPandas(Paths(1000 * keep_seconds), OUTPUT, "Append", "EventTime")
