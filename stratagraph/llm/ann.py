"""Nearest neighbours by a block matrix join on int8 tiles (operator 4).

Vectors are scaled to length one and quantised to int8 by blocks. A tile multiplies a block of
queries with a block of candidates. The quantisation errors of both sides bound how far a tile's
product can be from the true cosine, so a candidate whose upper bound lies below the k-th best
score or lower bound so far cannot be among the k nearest and is dropped; the survivors, and no
others, are recomputed in double precision from the original vectors. A task keeps k rows a query;
heaps merge those of all tasks. The result is exact.

Groups of query blocks meet groups of candidate blocks in the cells of a grid (``grid``). A task
holds the queries of its cell, up to a fixed number of bytes, and candidates pass by block after block,
so memory stays bounded, copies are few and no pair of vectors is ever a row.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different
length have no cosine: each query meets the candidates of its own length. Ties in score go to the smaller id. Repeated ids are separate vectors
(a query skips every candidate of its own id), as candidates and as queries: each query row has k
results of its own. Null ids take no part. An empty table gives an empty result; further columns are
ignored whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import afresh, map_arrow, materialize, shuffle_width, table

#: Vectors in a block. A tile of one query block and one candidate block is the unit of work.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 2048
#: Pairs of a query and a candidate that make a cell, and how many cells there are at most, or as shuffles have partitions.
CELL_PAIRS, CELLS = 1 << 22, 96
#: Bytes of queries a task holds, about, and pairs it scores exactly at a time; only memory and copies depend on them.
HELD_BYTES, SURVIVORS = 128 << 20, 1 << 15
#: What stands where a query has met fewer than k candidates.
LAST = np.iinfo(np.int64).max


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite, not all zero."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(value.isNotNull() & (F.size(value) > 0) & finite & F.exists(value, lambda x: x != 0), F.lit(False))


def quantise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale of each row, and a bound on the length of each row's rounding error."""
    unit = matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def blocks(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Pack (``key``, ``vector``) into blocks (width, ids, vectors): ids and components of up to ``size``
    vectors of one length as binary, in four bytes where the table has floats.

    Blocks form inside partitions, so packing moves nothing.
    """
    component, kind = ("double", "<f8") if rows.schema[vector].dataType.elementType.simpleString() != "float" else ("float", "<f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        held: dict[int, pa.Table] = {}

        def packed(width: int, part: pa.Table) -> pa.RecordBatch:
            ids = part.column("key").to_numpy().astype("<i8")
            flat = pc.list_flatten(part.column("vector")).to_numpy().astype(kind)
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], names=["width", "ids", "vectors"])

        for batch in batches:
            lengths = pc.list_value_length(batch.column("vector"))
            for width in pc.unique(lengths).to_pylist():
                own = pa.Table.from_batches([batch.filter(pc.equal(lengths, width))])
                whole = pa.concat_tables([held[width], own]) if width in held else own
                while whole.num_rows >= size:
                    yield packed(width, whole.slice(0, size))
                    whole = whole.slice(size)
                held[width] = whole
        for width, whole in held.items():
            if whole.num_rows:
                yield packed(width, whole)

    return rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(f"array<{component}>").alias("vector")).mapInArrow(run, "width int, ids binary, vectors binary")


class Asked:
    """A block of queries in a task, and the k best candidates that each of them has met."""

    def __init__(self, block: int, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.first, self.ids, self.vectors, self.k = block * QUERY_BLOCK, ids, vectors, k
        self.codes, self.scale, self.error = quantise(vectors.astype(np.float64))
        self.found, self.scores = np.full((len(ids), k), LAST), np.full((len(ids), k), -np.inf)

    def meet(self, c_ids: np.ndarray, c: np.ndarray, c_units: np.ndarray, c_error: float) -> None:
        """One tile: ``c_units`` are the candidates' codes by their scales, ``c_error`` the largest of their errors."""
        product = self.codes.astype(np.float32) @ c_units.T
        # |cos - product| <= |q| e_c + |c'| e_q with |q| = 1 and |c'| <= 1 + e_c; the sum in float32 adds its own roundings.
        bound = c_error + self.error * (1 + c_error) + (c.shape[1] + 4) * 2.0**-22
        least = self.scores[:, -1]
        if np.isneginf(least).any() and len(c_ids) > self.k:
            product[self.ids[:, None] == c_ids[None, :]] = -np.inf
            least = np.maximum(least, np.partition(product, -self.k, axis=1)[:, -self.k] * self.scale - bound)
        i, j = np.divmod(np.flatnonzero(product >= ((least - bound) / self.scale).astype(np.float32)[:, None]), len(c_ids))
        other = self.ids[i] != c_ids[j]
        i, j = i[other], j[other]
        for at in range(0, len(i), SURVIVORS):
            self._keep(i[at : at + SURVIVORS], j[at : at + SURVIVORS], c_ids, c)

    def _keep(self, i: np.ndarray, j: np.ndarray, c_ids: np.ndarray, c: np.ndarray) -> None:
        """Exact scores of query ``i`` and candidate ``j`` go among the best."""
        x, y = self.vectors[i].astype(np.float64), c[j].astype(np.float64)
        score = (y * x).sum(axis=1) / (np.sqrt((y * y).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))
        rows = np.unique(i)
        row, found, scores = (np.concatenate(z) for z in ((np.repeat(rows, self.k), i), (self.found[rows].ravel(), c_ids[j]), (self.scores[rows].ravel(), score)))
        order = np.lexsort((found, -scores, row))
        starts = np.searchsorted(row[order], rows)
        best = order[(starts[:, None] + np.arange(self.k)).ravel()]
        self.found[rows], self.scores[rows] = found[best].reshape(-1, self.k), scores[best].reshape(-1, self.k)

    def result(self, key: str) -> pa.RecordBatch:
        i, j = np.nonzero(~np.isneginf(self.scores))
        columns = [self.first + i.astype(np.int64), self.ids[i], self.found[i, j], self.scores[i, j]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["place", "query_id", key, "score"])


def grid(n_queries: int, n_candidates: int, tasks: int) -> tuple[int, int]:
    """Into how many groups queries and candidates are dealt; each pair of groups is a cell. Every group of one
    side is copied to all groups of the other, so queries stay together while their copies are no more than
    twice the candidates; else both sides have groups, in the proportion that makes copies fewest."""
    queries, candidates = max(1, n_queries), max(1, n_candidates)
    cells = min(-(-queries * candidates // CELL_PAIRS), max(CELLS, tasks))
    alone = min(cells, max(1, 2 * candidates // queries))
    if alone >= min(cells, CELLS):
        return 1, alone
    cells = min(cells, CELLS)
    parts = min(cells, max(1, round((cells * candidates / queries) ** 0.5)))
    return -(-cells // parts), parts


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` to each row of ``queries`` by cosine, its own id aside:
    query_id, rank (from 1), ``key``, score."""
    spark = vectors.sparkSession
    rows, asked = (df.filter(usable(vector) & F.col(key).isNotNull()) for df in (vectors, queries))
    kinds = ["<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8" for df in (queries, vectors)]
    groups = max(1, shuffle_width(spark))
    # Query rows are told apart by block and place, since ids may repeat.
    wanted = materialize(blocks(asked.coalesce(max(1, groups // 4)), key, vector, QUERY_BLOCK).withColumn("block", F.monotonically_increasing_id()), "query_blocks")
    size = wanted.agg(F.sum(F.length("ids") / 8).cast("long"), F.sum(F.length("vectors")).cast("long")).first()
    a, b = grid(size[0] or 0, vectors.count(), groups)
    a = max(a, -(-(size[1] or 0) // HELD_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda number, partition, n: F.pmod(number + partition, F.lit(n)).cast("int")
    own = wanted.withColumn("row", dealt(F.col("block"), F.shiftright("block", 33), a)).withColumn("part", every(b))
    candidates = blocks(rows, key, vector, CANDIDATE_BLOCK).withColumn("part", dealt(F.monotonically_increasing_id(), F.spark_partition_id(), b)).withColumn("block", F.lit(-1).cast("long")).withColumn("row", every(a))
    cell = (F.col("row") * b + F.col("part")).cast("int").alias("cell")
    both = [df.select(cell, "block", "width", "ids", "vectors") for df in (own, candidates)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        at, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                where, block, width = (batch.column(name)[r].as_py() for name in ("cell", "block", "width"))
                if where != at:
                    yield from (x.result(key) for x in held)
                    at, held = where, []
                ids = np.frombuffer(batch.column("ids")[r].as_buffer(), "<i8")
                flat = np.frombuffer(batch.column("vectors")[r].as_buffer(), kinds[0 if block >= 0 else 1]).reshape(len(ids), width)
                if block >= 0:
                    held.append(Asked(block, ids.copy(), flat.copy(), k))
                    continue
                codes, scale, error = quantise(flat.astype(np.float64))
                units = codes.astype(np.float32) * scale.astype(np.float32)[:, None]
                for x in held:
                    if x.vectors.shape[1] == width:
                        x.meet(ids, flat, units, float(error.max()))
        yield from (x.result(key) for x in held)

    # No join: its estimate of a side would leave out the copies, and Spark could send them all to every task.
    met = both[0].union(both[1]).repartition(a * b, "cell").sortWithinPartitions("cell", F.desc("block")).mapInArrow(run, f"place long, query_id long, {key} long, score double")
    return merged(met, k, key)


def merged(rows: DataFrame, k: int, key: str) -> DataFrame:
    """The k best rows of every query row (place), by one bounded heap each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for batch in batches:
            for p, q, c, s in zip(*(batch.column(i).to_pylist() for i in range(4))):
                heap = best.setdefault((p, q), [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -c))
                elif (s, -c) > heap[0]:
                    heapq.heapreplace(heap, (s, -c))
        out = [(q, rank, -c, s) for (_, q), heap in best.items() for rank, (s, c) in enumerate(sorted(heap, reverse=True), 1)]
        q, rank, c, s = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(rank, pa.int32()), pa.array(c, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "rank", key, "score"])

    return rows.repartition(shuffle_width(rows.sparkSession), "place").mapInArrow(run, f"query_id long, rank int, {key} long, score double")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)
