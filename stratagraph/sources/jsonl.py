"""Line-delimited JSON as a store of chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..core import shared_dir


def write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def round_trip(rows: DataFrame) -> DataFrame:
    path = f"{shared_dir(rows.sparkSession)}/stratagraph-core/{uuid.uuid4().hex}.jsonl"
    write(rows, path)
    return read(rows.sparkSession, path, rows.schema)
