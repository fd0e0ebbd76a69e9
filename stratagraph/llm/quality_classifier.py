"""Quality classifier by co-training (operator 3).

Two views of a document are learned apart: its text (character pairs, and rates of symbols,
capitals, repeated words) and its page metadata (source, language, size, layout of lines). Both
start from the labelled rows. In each round a view labels the unlabelled rows it is sure of, and
the other view learns from them; how sure is sure enough is read from labelled rows held out, so a
view that cannot tell (its held-out precision stays low) teaches nothing. At the end each view is
calibrated on the held-out rows, a small logistic model combines the two, and every document is
scored.

The labelled rows a view is fitted on are a bounded sample: ``labelled_rows``, those with the
smallest hash of their id, so the sample is the same on every run. The exchange of pseudo-labels
covers all other rows: executors sum gradient and curvature of the log loss over every row a view
is sure of, and the other view takes one Newton step from its last fit. The sums have a fixed size
whatever the corpus. They count as much as the labelled rows times ``PSEUDO_WEIGHT``, so labels are
not drowned however many documents there are. Every text is read once, for its features, which are
stored as a table; rounds and scores read that.

A document without words (null, empty, white space) scores 0 and is rejected. Without labels of
both kinds, all documents with words are kept with a score of 1. Several labels of one document are
averaged, ties count as good; null labels are ignored; of several rows with the id of a label the
one with the smallest features is learned from. Null metadata counts as the empty string or 0. Rows
with a null id are scored like any other, repeated rows each by themselves. Texts of any length are
read whole, an empty table gives an empty result, and further columns are ignored (``keep_good``:
kept) whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import afresh, folded, map_arrow, materialize, shuffle_width, table

LABELLED_ROWS = 5000
ROUNDS = 2
#: Held-out precision a view must reach on the rows it calls sure.
SURE = 0.98
#: Weight of all pseudo-labelled rows of a class beside that of its labelled ones.
PSEUDO_WEIGHT = 0.5
THRESHOLD = 0.5
#: Weight of the squared coefficients beside the mean loss.
RIDGE = 1e-3

PAIRS, SOURCES, LANGUAGES = 256, 64, 16
RATES = 9
TEXT_WIDTH, META_WIDTH = PAIRS + RATES, SOURCES + LANGUAGES + 5

_KIND = np.zeros(256, np.int64)  # 1 upper, 2 lower, 3 digit, 4 white space, 5 . and , 6 other ASCII, 7 not ASCII
_KIND[33:127] = 6
_KIND[[46, 44]] = 5
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def features(text: str, source: str | None, language: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    n = max(len(raw), 1)
    words = data.split()
    kinds = np.bincount(_KIND[raw], minlength=8)
    wide = raw.astype(np.uint32)
    pairs = np.bincount(((wide[:-1] * 31 + wide[1:] * 7) ^ (wide[:-1] >> 3)) % PAIRS, minlength=PAIRS) if len(raw) > 1 else np.zeros(PAIRS)
    text_row = np.empty(TEXT_WIDTH, np.float32)
    text_row[:PAIRS] = np.sqrt(pairs / n)
    half = words[: len(words) // 2 * 2]
    text_row[PAIRS:] = [*(kinds[k] / n for k in (1, 3, 4, 5, 6, 7)), len(set(words)) / max(len(words), 1), len(set(zip(half[::2], half[1::2]))) / max(len(half) // 2, 1), min(len(words), 200) / 200]
    meta_row = np.zeros(META_WIDTH, np.float32)
    meta_row[zlib.crc32((source or "").encode()) % SOURCES] = 1
    meta_row[SOURCES + zlib.crc32((language or "").encode()) % LANGUAGES] = 1
    lines = data.split(b"\n")
    longest = max(map(len, lines))
    meta_row[SOURCES + LANGUAGES :] = [np.log1p(max(n_chars or 0, 0)) / 10, np.log1p(len(lines)) / 5, np.log1p(n / len(lines)) / 10, np.log1p(longest) / 10, len(set(lines)) / len(lines)]
    return text_row, meta_row


@dataclass
class View:
    """Logistic regression on standardised columns, with Platt calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights + self.bias

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -30, 30)

    def sums(self, x: np.ndarray, y: float) -> np.ndarray:
        """Over rows of one label: a bound on the curvature of the log loss (a quarter of the second
        moments) with the gradient as last column, and, in a last row, the number of rows (columns
        and rows: features, then bias)."""
        z = np.column_stack([self.standard(x), np.ones(len(x))])
        out = np.zeros((z.shape[1] + 1, z.shape[1] + 1))
        out[:-1, :-1] = 0.25 * (z.T @ z)
        out[:-1, -1] = z.T @ (y - sigmoid(self.raw(x)))
        out[-1, 0] = len(x)
        return out

    def step(self, parts: list[np.ndarray]) -> View:
        """One Newton step on sums scaled by class. Since the curvature is bounded from above, no step
        makes the loss worse, however few or well separated the rows are."""
        total = sum(parts)
        theta = np.append(self.weights, self.bias)
        penalty = np.append(np.full(len(self.weights), RIDGE), 0.0)
        theta = theta + np.linalg.solve(total[:-1, :-1] + np.diag(penalty + 1e-9), total[:-1, -1] - penalty * theta)
        return View(self.mean, self.scale, theta[:-1], float(theta[-1]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on weighted log loss."""
    n, d = x.shape
    w = w / w.sum()
    # The largest curvature, by power iteration on the weighted second moments (bias included).
    v, most = np.ones(d + 1) / np.sqrt(d + 1), 1.0
    for _ in range(20):
        u = w * (x @ v[:d] + v[d])
        v = np.append(x.T @ u, u.sum())
        most = float(np.linalg.norm(v)) or 1.0
        v /= most
    size = 1 / (0.25 * 1.2 * most + ridge)
    theta, before, bias, bias_before = np.zeros(d), np.zeros(d), 0.0, 0.0
    for k in range(steps):
        m = k / (k + 3)
        t, b = theta + m * (theta - before), bias + m * (bias - bias_before)
        g = w * (sigmoid(x @ t + b) - y)
        before, bias_before = theta, bias
        theta, bias = t - size * (x.T @ g + ridge * t), b - size * float(g.sum())
    return theta, bias


def fit(x: np.ndarray, y: np.ndarray, steps: int = 150) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = ((x - mean) / scale).astype(np.float32)
    # Both classes weigh alike, whatever their share of the sample; calibration restores the share.
    balance = np.where(y > 0.5, 1 / max((y > 0.5).sum(), 1e-9), 1 / max((y <= 0.5).sum(), 1e-9))
    theta, bias = descend(z, y, balance, RIDGE, steps)
    return View(mean, scale, theta, bias)


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    z = view.raw(x)
    spread = max(float(z.std()), 1e-6)
    theta, bias = descend((z / spread)[:, None], y, np.ones(len(y)), 1e-3, 500)
    view.slope, view.shift = max(float(theta[0]) / spread, 0.0), bias


def bars(view: View, held: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logits from which on (label 1), and down from which (label 0), the held-out rows are right often
    enough; infinite where a view is never sure."""
    known, found = view.logit(held), []
    for label, sign in ((1, 1), (0, -1)):
        order = np.argsort(-sign * known)
        right = np.cumsum(y[order] == label) / np.arange(1, len(y) + 1)
        good = np.flatnonzero((right >= SURE) & (np.arange(1, len(y) + 1) >= 20))
        found.append(float(known[order[good[-1]]]) if len(good) else sign * np.inf)
    return found[0], found[1]


def lessons(views: list[View], limits: list[tuple[float, float]], xs: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Sums (by 2 * learner + label) over the rows of ``xs`` (text, metadata) that the other view is
    sure of. A view is not sure of a row that lies beyond both its bars."""
    out = {}
    for learner in (0, 1):
        teacher = 1 - learner
        logit, (high, low) = views[teacher].logit(xs[teacher]), limits[teacher]
        for label, hit in ((1, (logit >= high) & ~(logit <= low)), (0, (logit <= low) & ~(logit >= high))):
            out[2 * learner + label] = views[learner].sums(xs[learner][hit], label)
    return out


def newton(view: View, x: np.ndarray, y: np.ndarray, pseudo: dict[int, np.ndarray], learner: int) -> View:
    """The view after a step on its labelled rows and the pseudo-labelled sums, by class alike."""
    parts = []
    for label in (0, 1):
        own, more = view.sums(x[y == label], label), pseudo[2 * learner + label]
        parts.append(own / max(own[-1, 0], 1.0))
        if more[-1, 0]:
            parts.append(PSEUDO_WEIGHT * more / more[-1, 0])
    return view.step(parts)


@dataclass
class Model:
    text: View
    meta: View
    weights: np.ndarray  # of the two calibrated logits
    bias: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text), self.meta.logit(meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.weights[0] * a + self.weights[1] * b + self.bias)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool, rounds: int = ROUNDS) -> Model:
    """Fit both views, let them teach each other, calibrate, combine. Every fourth labelled row of each
    class is held out. ``pool(views, limits)`` gives ``lessons`` summed over all unlabelled rows."""
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        held[np.flatnonzero(y == label)[::4]] = True
    xs = [text, meta]
    views = [fit(x[~held], y[~held]) for x in xs]
    for number in range(rounds + 1):
        for view, x in zip(views, xs):
            calibrate(view, x[held], y[held])
        if number < rounds:
            pseudo = pool(views, [bars(v, x[held], y[held]) for v, x in zip(views, xs)])
            views = [newton(v, x[~held], y[~held], pseudo, k) for k, (v, x) in enumerate(zip(views, xs))]
    logits = np.stack([v.logit(x[held]) for v, x in zip(views, xs)], axis=1)
    spread = np.maximum(logits.std(axis=0), 1e-6)
    theta, bias = descend(logits / spread, y[held], np.ones(int(held.sum())), 1e-3, 500)
    return Model(views[0], views[1], np.maximum(theta / spread, 0), bias)


def matrices(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both views from their stored form."""
    text = np.frombuffer(b"".join(a.to_pylist()), np.float16).reshape(-1, TEXT_WIDTH).astype(np.float32)
    return text, np.frombuffer(b"".join(b.to_pylist()), np.float32).reshape(-1, META_WIDTH)


def stored_rows(texts: list[str | None], *metadata: list) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Whether each text has words, and features of both views, as stored."""
    rows = [features(t or "", *x) for t, *x in zip(texts, *metadata)]
    some = pa.array([bool(t) and not t.isspace() for t in texts], pa.bool_())
    return some, pa.array([a.astype(np.float16).tobytes() for a, _ in rows], pa.binary()), pa.array([b.tobytes() for _, b in rows], pa.binary())


def featured(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, some, a, b) of every row, stored: features of both views, and whether there are words."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("key"), *stored_rows(*(batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")))], names=["key", "some", "a", "b"])

    return materialize(map_arrow(docs.select(F.col(key).alias("key"), "text", "source", "lang", "n_chars"), run, f"key {kind}, some boolean, a binary, b binary", rows=1024, size=4 << 20), "features")


def taught(rows: DataFrame, views: list[View], limits: list[tuple[float, float]], without: set) -> dict[int, np.ndarray]:
    """``lessons`` over all ``rows`` (key, a, b) but those whose key is in ``without`` (the sample)."""
    widths = (TEXT_WIDTH + 2, META_WIDTH + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        total = {2 * k + label: np.zeros((w, w)) for k, w in enumerate(widths) for label in (0, 1)}
        for batch in batches:
            batch = batch.filter(pa.array([k not in without for k in batch.column("key").to_pylist()], pa.bool_()))
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for k, own in lessons(views, limits, list(matrices(part.column("a"), part.column("b")))).items():
                    total[k] += own
        rows = [(k * 1024 + i, zlib.compress(row.tobytes(), 1)) for k, x in total.items() if x[-1, 0] for i, row in enumerate(x)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", "sums"])

    def add(total: np.ndarray | None, data: bytes) -> np.ndarray:
        own = np.frombuffer(data, np.float64)
        return own if total is None else total + own

    out = {2 * k + label: np.zeros((w, w)) for k, w in enumerate(widths) for label in (0, 1)}
    for r in folded(rows.select("key", "a", "b").mapInArrow(run, "chunk int, sums binary"), "sums", add, shuffle_width(rows.sparkSession)).collect():
        out[r["chunk"] // 1024][r["chunk"] % 1024] = np.frombuffer(r["sums"], np.float64)
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", labelled_rows: int = LABELLED_ROWS, rows: DataFrame | None = None) -> Model | None:
    """Fit on at most ``labelled_rows`` labelled rows and all unlabelled ones; None without labels of
    both kinds. ``rows``: ``featured(docs)``, where it is at hand."""
    known = labels.dropna(subset=[key, label]).groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    if rows is None:
        rows = featured(docs, key)
    first = rows.select("key").dropna().distinct().join(known, "key").orderBy(F.xxhash64("key"), "key").limit(labelled_rows)
    # Bounded by labelled_rows, so it may be broadcast and, with features, come to the driver.
    chosen = rows.join(F.broadcast(first), "key").groupBy("key").agg(F.first("label").alias("label"), F.min(F.struct("a", "b")).alias("x"))
    sample = chosen.select("key", "label", "x.a", "x.b").toArrow().sort_by("key")
    truth = np.array(sample.column("label").to_pylist(), float)
    if len(truth) < 8 or truth.min() == truth.max():
        return None
    without = set(sample.column("key").to_pylist())
    text, meta = matrices(sample.column("a"), sample.column("b"))
    return co_train(text, meta, truth, lambda views, limits: taught(rows, views, limits, without))


def judged(some: pa.Array, a: pa.Array, b: pa.Array, model: Model | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """p_text, p_meta, score and kept of rows with these features."""
    words = some.to_numpy(zero_copy_only=False)
    if model is None or not len(words):
        p = q = s = words.astype(float)
    else:
        p, q, s = model.scores(*matrices(a, b))
        s = np.where(words, s, 0.0)
    return np.asarray(p, float), np.asarray(q, float), np.asarray(s, float), (s >= threshold) & words


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, key: str = "doc_id", rows: DataFrame | None = None) -> DataFrame:
    """``key``, p_text, p_meta, score, kept for every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, q, s, kept = judged(batch.column("some"), batch.column("a"), batch.column("b"), model, threshold)
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(p), pa.array(q), pa.array(s), pa.array(kept)], names=["key", "p_text", "p_meta", "score", "kept"])

    found = map_arrow(featured(docs, key) if rows is None else rows, run, f"key {kind}, p_text double, p_meta double, score double, kept boolean")
    return found.withColumnRenamed("key", key)


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows the classifier rejects, in one pass that moves nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = judged(*stored_rows(*(batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars"))), model, threshold)[3]
        return batch.filter(pa.array(kept))

    return map_arrow(docs, run, docs.schema, rows=1024, size=4 << 20)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = featured(docs)
    return score(docs, train(docs, table(spark, sf_dir, "labels"), rows=rows), rows=rows)
