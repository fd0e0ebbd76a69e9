"""Centroid clustering in exact integers, screened in float32 (operator 13).

Vectors of exactly ``WIDTH`` finite components become integers floor(1024 x). Centroids start as the
vectors whose ids hash smallest, and each round assigns every vector to its nearest centroid (ties to
the lower number) and moves every non-empty centroid to the exact floor of its vectors' mean.

A round is one pass over stored blocks of vectors. A float32 matrix product gives v.c for a whole
block at once; |c|^2 / 2 - v.c ranks centroids like the distance. Its rounding error is at most
``ERROR`` |v| |c|: both factors are rounded once, and a sum of 64 products, in whatever order and
with or without fused steps, adds 64 more roundings, 66 in all; the bound takes 80. So each centroid
has an interval that holds its true value. Where all other intervals lie above that of the lowest
one the assignment is proven; wherever intervals overlap, the distances of just these centroids are
computed again in integers and the smallest, then the lowest number, wins. The result is that of
integer arithmetic throughout.

Sums stay exact: a task adds its vectors in integers, Spark adds the tasks' sums as decimals, and the
driver gets one number for each centroid and component. Rounds read the same stored table, so there
is no lineage to cut, and a lost executor costs its own tasks only.

Integers beyond ``LARGE`` (their squares would leave 64 bits) are computed with Python's unlimited ones.

Defined results: vectors that are null, of another length, or hold a null or a non-finite component,
or one whose integer does not fit a long, take no part. A null id takes part but names no start; of
repeated ids each row is a vector of its own, equal hashes are ordered by their components. With fewer
vectors than centroids there are as many centroids as vectors. A distance or inertia too large for a
long is null. An empty table gives an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import afresh, materialize, table

#: Components of a vector, and what they are multiplied by.
WIDTH, SCALE = 64, 1024
#: Bound on the relative rounding error of a float32 product of two vectors, see above.
ERROR = 80 * 2.0**-24
#: Largest integer whose squared distances are sure to fit 64 bits.
LARGE = 1 << 27
LIMIT = float(1 << 63)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    scaled = lambda x: F.floor(x.cast("double") * SCALE)
    fits = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) < LIMIT) & scaled(x).isNotNull()
    return F.coalesce((F.size(vector) == WIDTH) & F.forall(vector, fits), F.lit(False))


def integers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v array<long>) of the vectors that take part."""
    value = F.col(vector)
    return vectors.filter(usable(value)).select(F.col(key).cast("long").alias("key"), F.transform(value, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The first centroids: those of the smallest hashes of ``seed``:id."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = rows.filter("key is not null").select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()
    return np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, WIDTH)


def exact(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to one centroid, in 64 bits where they fit, else unlimited."""
    small = max(abs(int(m)) for side in (rows, centre) for m in (side.min(), side.max())) <= LARGE if rows.size else True
    kind = np.int64 if small else object
    d = rows.astype(kind) - centre.astype(kind)
    return (d * d).sum(axis=1)


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For integer rows: the number of the nearest centroid, and whether float32 could not prove it."""
    out, open_ = np.zeros(len(rows), np.int32), np.zeros(len(rows), bool)
    plain = (np.abs(rows.astype(np.float64)) <= LARGE).all(axis=1)
    if (np.abs(centres.astype(np.float64)) > LARGE).any():
        plain[:] = False
    if plain.any():
        v, c = rows[plain].astype(np.float64), centres.astype(np.float64)
        product = (v.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
        v_norm, c_norm = np.sqrt((v * v).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
        half = (c_norm * c_norm)[None, :] / 2 - product
        # A little more than the bound, for the double precision of norms and of this line itself.
        width = ERROR * v_norm[:, None] * c_norm[None, :] + 1e-12 * (c_norm * c_norm)[None, :] + 1e-6
        lowest = (half + width).min(axis=1)
        near = half - width <= lowest[:, None]
        out[plain] = np.where(near, half, np.inf).argmin(axis=1)
        open_[plain] = near.sum(axis=1) > 1
        unsure = np.flatnonzero(plain)[near.sum(axis=1) > 1]
        wanted = near[near.sum(axis=1) > 1]
    else:
        unsure, wanted = np.empty(0, np.int64), np.empty((0, len(centres)), bool)
    far = np.flatnonzero(~plain)
    open_[far] = True
    for at, among, kind in ((unsure, wanted, np.int64), (far, np.ones((len(far), len(centres)), bool), object)):
        if not len(at):
            continue
        best = np.full(len(at), None, object) if kind is object else np.full(len(at), np.iinfo(np.int64).max)
        for j in range(len(centres)):
            own = np.flatnonzero(among[:, j])
            d = exact(rows[at[own]], centres[j]) if len(own) else np.empty(0, np.int64)
            closer = np.array([best[r] is None or x < best[r] for r, x in zip(own, d)], bool) if kind is object else d < best[own]
            best[own[closer]] = d[closer]
            out[at[own[closer]]] = j
    return out, open_


def _matrix(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def moved(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, int]:
    """Centroids after one round, and how many rows float32 could not decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        total, count, unsure = np.zeros(centres.shape, object), np.zeros(len(centres), np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            own, open_ = nearest(v, centres)
            unsure += int(open_.sum())
            for j in np.unique(own):
                part = v[own == j]
                # 64-bit sums of a batch hold below 2^43; larger integers are added without limit.
                total[j] += part.sum(axis=0) if np.abs(part.astype(np.float64)).max() < 2.0**43 else part.astype(object).sum(axis=0)
                count[j] += len(part)
        # ``open`` counts once a task, on its first row.
        c, d = (x.ravel() for x in np.indices(centres.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array([str(int(x)) for x in total.ravel()], pa.string()), pa.array(np.repeat(count, WIDTH)), pa.array(np.where(np.arange(centres.size) == 0, unsure, 0), pa.int64())],
            names=["c", "d", "total", "n", "open"],
        )

    sums = rows.select("v").mapInArrow(run, "c int, d int, total string, n long, open long")
    found = sums.groupBy("c", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.sum("open").alias("open")).collect()
    new = centres.copy()
    for r in found:
        if r["n"]:
            new[r["c"], r["d"]] = int(r["total"]) // r["n"]
    return new, sum(r["open"] for r in found)


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(key, cluster, distance) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"))
            own, _ = nearest(v, centres)
            distance = np.zeros(len(v), object)
            for j in np.unique(own):
                distance[own == j] = exact(v[own == j], centres[j])
            fits = [int(x) if x < 1 << 63 else None for x in distance]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own, pa.int32()), pa.array(fits, pa.int64())], names=["key", "cluster", "distance"])

    return rows.select("key", "v").mapInArrow(run, "key long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = materialize(integers(vectors, key, vector), "vectors")
    centres = starts(rows, k, seed)
    if not len(centres):
        return spark.createDataFrame([], f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centres, _ = moved(rows, centres)
    found = materialize(assigned(rows, centres), "assigned")
    own = found.groupBy("cluster").agg(F.when(F.count_if(F.col("distance").isNull()) == 0, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()
    total = None if any(r["s"] is None for r in own) else sum(int(r["s"]) for r in own)
    fits = lambda x: int(x) if x is not None and x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    told = spark.createDataFrame([(r["cluster"], fits(r["s"]), fits(total), digest[r["cluster"]]) for r in own], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row a centroid.
    return found.join(F.broadcast(told), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The rounds written out: one step assigns, the next moves."""
    near = "select vec_id, arg_min(c, (dist, c)) as c, min(dist) as dist from (select v.vec_id, m.c, sum((v.x - m.x) * (v.x - m.x)) as dist from v join {m} m using (d) group by v.vec_id, m.c) group by vec_id"
    steps = [
        f"kept as materialized (select vec_id, embedding as e from embeddings where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {WIDTH})",
        f"v as materialized (select vec_id, d, cast(floor({SCALE} * cast(e[d] as double)) as hugeint) as x from (select vec_id, e, unnest(range(1, {WIDTH + 1})) as d from kept))",
        f"first as (select vec_id, row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c from kept qualify c < {k})",
        "m0 as materialized (select c, d, x from v join first using (vec_id))",
    ]
    for r in range(rounds):
        steps.append(f"a{r} as materialized ({near.format(m=f'm{r}')})")
        mean = "cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) as hugeint) // count(*)"
        steps.append(f"m{r + 1} as materialized (select m.c, m.d, coalesce(n.x, m.x) as x from m{r} m left join (select c, d, {mean} as x from v join a{r} using (vec_id) group by c, d) n using (c, d))")
    steps.append(f"a{rounds} as materialized ({near.format(m=f'm{rounds}')})")
    steps.append(f"digest as (select c, sha256(string_agg(cast(x as varchar), ',' order by d)) as h from m{rounds} group by c)")
    return f"with {', '.join(steps)} select vec_id, cast(c as integer) as cluster, cast(dist as bigint) as distance, cast(sum(dist) over (partition by c) as bigint) as cluster_inertia, cast(sum(dist) over () as bigint) as inertia, h as centroid_sha256 from a{rounds} join digest using (c)"


ORACLE_SQL = {"op13_centroids": _sql()}
