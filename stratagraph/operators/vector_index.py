"""Stored vectors in clusters, searched exactly: whole clusters are left out where no member can count.

Vectors are stored with their lengths, one folder a cluster. A cluster has a centre and a radius, the
largest angle between the centre and a member. By the triangle inequality for angles a member's angle
to the query is at least the centre's less the radius, so its score is at most the cosine of that times
the largest factor in the cluster. A search reads the most promising clusters first, until they hold
enough rows, and then those whose bound still reaches the k-th best score; the others are not read. The
result is that of a full scan.

Centres are a stated number of the vectors themselves, those of smallest hash, moved once or more to the
mean of what lies nearest. Each assignment is one pass of block products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import cosine_to

#: Centres are held by every task; moves of the centres; rows (of the k asked for) to begin with.
MOST_CENTRES, MOVES, FIRST = 4096, 2, 4
#: Allowance for rounding of angles and scores.
SLACK = 1e-7


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


@dataclass
class Found:
    """A search's rows, and how many of the stored vectors were read for it."""

    rows: DataFrame
    read: int
    total: int


class VectorIndex:
    """``folder`` on a file system all share; rows are (key, vector, factor), each score is cosine times factor."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, rows: DataFrame, key: str, vector: str = "vector", factor: Column | None = None, centres: int = 64) -> VectorIndex:
        """Store ``rows``. Vectors that are null, of another length than most, zero or not finite lie in a cluster
        of their own that every search reads."""
        named = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"), (F.lit(1.0) if factor is None else factor.cast("double")).alias("factor"))
        width = next((r[0] for r in named.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()), 0) or 0
        whole = (F.size("vector") == width) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists("vector", lambda x: F.abs(x) > 1e-30)
        good = F.coalesce(whole, F.lit(False)) if width > 0 else F.lit(False)
        first = named.filter(good).orderBy(F.xxhash64("key"), "key").limit(min(centres, MOST_CENTRES)).select("vector").collect()
        middle = _unit(np.array([r[0] for r in first], np.float64).reshape(-1, max(width, 1)))
        for _ in range(MOVES if len(middle) else 0):
            middle = self._moved(named.filter(good).select("vector"), middle, width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                usable = batch.column("good").to_numpy(zero_copy_only=False)
                own, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
                if usable.any():
                    product = _unit(_matrix(batch.column("vector").filter(batch.column("good")), width)) @ middle.T
                    own[usable], angle[usable] = product.argmax(axis=1), np.arccos(np.clip(product.max(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vector"), batch.column("factor"), pa.array(angle), pa.array(own, pa.int32())], names=["key", "vector", "factor", "angle", "cluster"])

        kinds = {f.name: f.dataType.simpleString() for f in named.schema}
        placed = named.withColumn("good", good).mapInArrow(run, f"key {kinds['key']}, vector {kinds['vector']}, factor double, angle double, cluster int")
        placed.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "cluster", F.pmod(F.xxhash64("key"), F.lit(4))).write.partitionBy("cluster").parquet(f"{self.folder}/vectors")
        named.select("key", "vector", "factor", F.lit(0.0).alias("angle"), F.lit(0).alias("cluster")).limit(0).write.parquet(f"{self.folder}/kinds")
        told = self.vectors().groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.max("factor").alias("most"), F.min("factor").alias("least"))
        centre = self.spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(middle)], "cluster int, centre array<double>")
        told.join(F.broadcast(centre), "cluster", "left").write.parquet(f"{self.folder}/clusters")
        return self

    def _moved(self, rows: DataFrame, middle: np.ndarray, width: int) -> np.ndarray:
        """Each centre at the mean direction of the vectors nearest to it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(middle)
            for batch in batches:
                if batch.num_rows:
                    v = _unit(_matrix(batch.column("vector"), width))
                    np.add.at(total, (v @ middle.T).argmax(axis=1), v)
            used = np.flatnonzero((total != 0).any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.float64()))], names=["cluster", "total"])

        sums = rows.mapInArrow(run, "cluster int, total array<double>").select("cluster", F.posexplode("total").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"))
        out = middle.copy()
        for r in sums.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v")).collect():
            out[r["cluster"]] = [p["x"] for p in r["v"]]
        return np.where((out != 0).any(axis=1, keepdims=True), _unit(out), middle)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.folder}/kinds").schema).parquet(f"{self.folder}/vectors")

    def _scored(self, clusters: list[int], vector: list[float]) -> DataFrame:
        """(key, score): the best row of each key in some clusters."""
        held = self.vectors().filter(F.col("cluster").isin(clusters))
        return held.select("key", (cosine_to(F.col("vector"), vector) * F.col("factor")).alias("score")).groupBy("key").agg(F.max("score").alias("score"))

    def top(self, vector: list[float], k: int = 10) -> Found:
        """(key, score) of the ``k`` best keys, best first, ties to the smaller key."""
        given = np.array([float(x) for x in vector])
        length = float(np.sqrt((given * given).sum()))
        told = self.spark.read.parquet(f"{self.folder}/clusters").collect()
        bounds = []
        for r in told:
            bound = 1.0
            if r["centre"] is not None and length and len(r["centre"]) == len(given):
                angle = math.acos(max(-1.0, min(1.0, float(np.dot(given, r["centre"])) / length)))
                bound = math.cos(max(0.0, angle - r["radius"] - SLACK))
            bounds.append((max(bound * r["most"], bound * r["least"]) + SLACK, r["cluster"], r["n"]))
        bounds.sort(key=lambda b: (b[1] >= 0, -b[0], b[1]))  # the cluster without a centre is always read
        total, first, rows = sum(n for _, _, n in bounds), [], 0
        for _, cluster, n in bounds:
            if rows >= FIRST * k and first:
                break
            first.append(cluster)
            rows += n
        best = self._scored(first, vector).orderBy(F.desc("score"), "key").limit(k).collect()
        bar = best[-1]["score"] if len(best) == k else -math.inf
        more = [cluster for bound, cluster, _ in bounds if cluster not in first and bound >= bar]
        read = sum(n for _, cluster, n in bounds if cluster in first or cluster in more)
        if more or not first:
            found = self._scored(first + more, vector).orderBy(F.desc("score"), "key").limit(k)
        else:
            kind = self.vectors().schema["key"].dataType.simpleString()
            found = self.spark.createDataFrame([(r["key"], r["score"]) for r in best], f"key {kind}, score double").orderBy(F.desc("score"), "key")
        return Found(found, read, total)
