"""Table upkeep as pure functions: upsert, append, cascade delete, change status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import KEYS, SCHEMAS, empty


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows replace those of equal key; of several new rows of a key the last by ``order`` stays."""
    seq = F.lit(0) if order is None else F.col(order)
    both = table.withColumn("nth_table", F.lit(0)).unionByName(rows.withColumn("nth_table", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("nth_table"), seq.desc(), *[F.col(c).cast("string") for c in table.columns])
    return both.withColumn("nth_row", F.row_number().over(last)).filter("nth_row = 1").drop("nth_table", "nth_row")


def upsert_named(name: str, table: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(table, rows, KEYS[name])


def number_chunks(rows: DataFrame, order: str) -> DataFrame:
    """Running chunk number of each uri's vectors, from 0."""
    return rows.withColumn("id", F.row_number().over(Window.partitionBy("uri").orderBy(order)) - 1)


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def cleared(spark, name: str) -> DataFrame:
    if name not in SCHEMAS:
        raise KeyError(name)
    return empty(spark, name)


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """All tables without what belongs to the files in ``paths`` (path): their symbols, edges from and
    to them, their vectors, references with candidates and callsites, imports and hashes."""
    gone = paths.select("path").distinct()
    uris = tables["symbols"].join(gone, "path", "left_semi").select("uri")
    refs = tables["references"].join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select(F.col("id").alias("reference_id"))
    out = dict(tables)
    out["symbols"] = tables["symbols"].join(gone, "path", "left_anti")
    out["edges"] = tables["edges"].join(uris.withColumnRenamed("uri", "from_uri"), "from_uri", "left_anti").join(uris.withColumnRenamed("uri", "to_uri"), "to_uri", "left_anti").select(*tables["edges"].columns)
    out["embeddings"] = tables["embeddings"].join(uris, "uri", "left_anti")
    for name in ("references", "imports"):
        out[name] = tables[name].join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select(*tables[name].columns)
    for name in ("ambiguous_references", "callsite_embeddings"):
        out[name] = tables[name].join(refs, "reference_id", "left_anti").select(*tables[name].columns)
    out["file_hash"] = tables["file_hash"].join(gone, "path", "left_anti")
    return out


def change_status(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status) of files now (path, hash) against hashes known: new, modified, unchanged, deleted."""
    both = seen.select("path", F.col("hash").alias("now")).join(known.select("path", F.col("hash").alias("then")), "path", "full_outer")
    status = F.when(F.col("now").isNull(), "deleted").when(F.col("then").isNull(), "new").when(F.col("now") == F.col("then"), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def deleted_paths(known: DataFrame, present: DataFrame) -> DataFrame:
    """(path) of files that are known (path) but not present any more (path)."""
    return known.select("path").distinct().join(present.select("path"), "path", "left_anti")


def held_hashes(states: DataFrame) -> DataFrame:
    """(path, hash) of files that have a hash; removed ones (null) are left out."""
    return states.filter("hash is not null").select("path", "hash")


def event_status(events: DataFrame) -> DataFrame:
    """Status of each change event (path, seq..., hash, removed) against the event just before it.

    ``events`` has path, ts, event_id, hash (null: removed).
    """
    before = Window.partitionBy("path").orderBy("ts", "event_id")
    was = F.lag("hash").over(before)
    status = F.when(F.col("hash").isNull(), "removed").when(was.isNull(), "new").when(was == F.col("hash"), "unchanged").otherwise("modified")
    return events.select("event_id", "path", status.alias("status"))
