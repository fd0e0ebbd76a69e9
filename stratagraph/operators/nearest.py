"""The most alike pairs of two sets of vectors, as a block product.

Both sides are dealt into groups by hash, every group of one side meets every group of the other
in one cell of a grid, and cells are sized so that both groups fit a task. A cell is a matrix
product of normalised vectors, worked off in strips; only its best pairs leave it, so no pair of vectors is ever a row
of a table. Candidates are picked with a margin for rounding and their scores are then worked out
pair by pair, so a score does not depend on the cell it was found in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of either side that are worth a cell, about.
LEFT_ROWS, RIGHT_ROWS = 2048, 8192
#: Vectors of either side in a cell at most, about, and scores of it that are held at a time.
KEY_ROWS, STRIP = 16 * LEFT_ROWS, 1 << 22
#: Pieces a side is cut into for the sake of tasks alone.
PIECES = 4
MARGIN = 1e-9


def pieces(rows: int, least: int) -> int:
    """Pieces of a side. Each of one side is copied to each of the other, so they are as large as a task can hold."""
    return max(1, -(-rows // KEY_ROWS), min(PIECES, -(-rows // least)))


def _matrix(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows in double precision (all of one length), and their norms."""
    rows = np.stack([np.asarray(v, np.float64) for v in column])
    return rows, np.sqrt((rows * rows).sum(axis=1))


def _cell(left: pd.DataFrame, right: pd.DataFrame, most: int, threshold: float) -> pd.DataFrame:
    out = []
    if len(left) and len(right):
        a, a_norm = _matrix(left["left_vector"])
        b, b_norm = _matrix(right["right_vector"])
        a_unit, b_unit = a / a_norm[:, None], (b / b_norm[:, None]).T
        uri, chunk = right["uri"].to_numpy(), right["chunk"].to_numpy()
        name_rank = np.lexsort((chunk, uri)).argsort()
        step = max(1, STRIP // len(b))
        for i, key in enumerate(left["id"]):
            if i % step == 0:
                strip = a_unit[i : i + step] @ b_unit
            row = strip[i % step]
            near = np.flatnonzero(row >= threshold - MARGIN)
            if len(near) > most:
                near = near[row[near] >= max(threshold, np.partition(row[near], -most)[-most]) - MARGIN]
            score = (b[near] * a[i]).sum(axis=1) / (b_norm[near] * a_norm[i])
            near, score = near[score >= threshold], score[score >= threshold]
            best = np.lexsort((name_rank[near], -score))[:most]
            out += [(key, uri[near[k]], chunk[near[k]], score[k]) for k in best]
    return pd.DataFrame(out, columns=["id", "uri", "chunk", "score"])


def top_pairs(left: DataFrame, right: DataFrame, most: int, threshold: float) -> DataFrame:
    """(id, uri, chunk, score): for each row of ``left`` (id, vector) its ``most`` rows of ``right``
    (uri, chunk, vector) of largest cosine, none under ``threshold`` (above 0); ties to the smaller
    uri, then chunk. Vectors that are null or zero, or of another length, pair with nothing.
    """
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = F.col("vector").isNotNull() & (length > 0)
    a = left.filter(good).select("id", F.col("vector").alias("left_vector"), F.size("vector").alias("width"))
    b = right.filter(good).select("uri", "chunk", F.col("vector").alias("right_vector"), F.size("vector").alias("width"))
    rows, columns = (pieces(side.count(), size) for side, size in ((a, LEFT_ROWS), (b, RIGHT_ROWS)))
    a = a.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(rows))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    b = b.withColumn("j", F.pmod(F.xxhash64("uri", "chunk"), F.lit(columns))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    cell = lambda df: df.groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "width")
    kinds = {f.name: f.dataType.simpleString() for f in (*a.schema, *b.schema)}
    found = cell(a).cogroup(cell(b)).applyInPandas(lambda x, y: _cell(x, y, most, threshold), f"id {kinds['id']}, uri string, chunk {kinds['chunk']}, score double")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "uri", "chunk")
    return found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= most).drop("nth")


#: Rows of both sides, about, that share a cell of light keys.
CELL_ROWS = 16_384


def _by_width(column: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Where vectors of each length stand, the vectors and their norms; null and empty ones are left out."""
    widths = np.array([-1 if v is None else len(v) for v in column])
    return {w: (np.flatnonzero(widths == w), *_matrix(column[widths == w])) for w in set(widths) - {-1, 0}}


def _cosines(a: pd.Series, b: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    """Cosine of every row of ``a`` with every row of ``b``, some rows of ``a`` at a time (from which row on, and the
    scores); 0 where there is none. Vectors of each length apart."""
    left, right = _by_width(a), _by_width(b)
    step = max(1, STRIP // max(1, len(b)))
    for first in range(0, len(a), step):
        out = np.zeros((min(step, len(a) - first), len(b)))
        for w in left.keys() & right.keys():
            (i, x, x_norm), (j, y, y_norm) = left[w], right[w]
            own = slice(*np.searchsorted(i, (first, first + len(out))))
            both = x_norm[own, None] * y_norm[None, :]
            out[np.ix_(i[own] - first, j)] = np.divide(x[own] @ y.T, both, out=np.zeros_like(both), where=both > 0)
        yield first, out


def _best_of_cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    out = []
    names = right.groupby("key").indices
    for key, own in left.groupby("key").indices.items():
        if key not in names:
            continue
        others = right.iloc[names[key]].sort_values("uri")
        uri, ids = others["uri"].to_numpy(), left["id"].to_numpy()[own]
        for first, score in _cosines(left["left_vector"].iloc[own], others["right_vector"]):
            # Equal up to rounding counts as equal, and the first uri wins.
            best = (score >= score.max(axis=1, keepdims=True) - MARGIN).argmax(axis=1)
            out.append(pd.DataFrame({"id": ids[first : first + len(best)], "uri": uri[best], "score": score[np.arange(len(best)), best]}))
    return pd.concat(out) if out else pd.DataFrame([], columns=["id", "uri", "score"])


def best_by_key(left: DataFrame, right: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(id, uri, score): for each row of ``left`` (key, id, vector) the row of ``right`` (key, uri, vector) of its key
    with the largest cosine, ties to the smaller uri.

    Candidates are held once for each key, never once for each row that may take them: a cell holds many
    keys with few rows or a part of one with many, both sides cut into pieces that meet in a grid. Scores
    are a block product for each key of a cell, and one row for each id leaves it. Where rows share vectors,
    ``left`` is (key, id, site) and ``vectors`` (site, vector); these meet when the rows are dealt already.
    """
    sizes = left.groupBy("key").agg(F.count("*").alias("n")).join(right.groupBy("key").agg(F.count("*").alias("m")), "key")
    cut = sizes.select("key", "n", "m", F.ceil(F.col("n") / KEY_ROWS).cast("int").alias("rows"), F.ceil(F.col("m") / KEY_ROWS).cast("int").alias("columns"))
    cells = max(1, -(-(left.count() + right.count()) // CELL_ROWS))
    place = F.when(F.col("n") + F.col("m") <= CELL_ROWS, F.pmod(F.xxhash64("key"), F.lit(cells))).otherwise(F.xxhash64("key", F.lit("own")))
    what = F.col("vector").alias("left_vector") if vectors is None else F.col("site")
    a = left.select("key", "id", what).join(cut, "key").withColumn("cell", place)
    b = right.select("key", "uri", F.col("vector").alias("right_vector")).join(cut, "key").withColumn("cell", place)
    a = a.withColumn("i", F.pmod(F.xxhash64("id"), F.col("rows"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("columns").cast("bigint") - 1)))
    b = b.withColumn("j", F.pmod(F.xxhash64("uri"), F.col("columns"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows").cast("bigint") - 1)))
    if vectors is not None:
        a = a.join(vectors.select("site", F.col("vector").alias("left_vector")), "site").drop("site")
    cell = lambda df: df.drop("rows", "columns", "n", "m").groupBy("cell", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    kind = left.schema["id"].dataType.simpleString()
    found = cell(a).cogroup(cell(b)).applyInPandas(_best_of_cell, f"id {kind}, uri string, score double")
    return found.groupBy("id").agg(F.min_by(F.struct("uri", "score"), F.struct((-F.col("score")).alias("s"), F.col("uri").alias("u"))).alias("b")).select("id", "b.uri", "b.score")
