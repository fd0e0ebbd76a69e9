"""Ranked lexical search over a two-level quantised index (operator 11).

The index is cut by documents: a task packs its own texts into segments, so building it moves nothing
between tasks. A segment is one row. Its first level holds terms, postings (places of documents) and an
*impact byte* for each posting: what the term adds to the document's score per unit of weight, divided
by ``STEP`` and rounded up. Its second level holds exact counts of terms and lengths of documents.

Weights depend on the corpus and come with the query. With byte q and weight w a term adds at most
w q STEP and more than w (q - 1) STEP, so the first level alone gives an upper and a lower bound for
every document. A search reads the index up to three times, each time a part of its columns:

1. terms and posting ends, to count in how many documents each term asked for occurs;
2. the first level: the k largest lower bounds of each item, and the largest upper bound of each item
   in each segment;
3. both levels of those segments where some upper bound reaches an item's k-th lower bound: every
   document that reaches it is scored again in integers from the second level.

Documents whose upper bound lies below the k-th lower bound cannot be among the k best, so the result
is exact. A task hands on at most k rows an item, whatever the number of documents that tie.

Items are taken in blocks of about ``PAIRS`` different terms (one item's terms stay together); a
block's terms and weights are all that is broadcast.

Defined results: null and empty texts have no terms; such documents are never found and such items
find nothing. A row with a null id counts in the statistics but is never returned. Where a document's id
repeats each row is a document of its own; rows of items that share an id are one item with the terms
of all; items without an id are left out. Equal scores rank by smaller id. Texts are read whole. Empty
tables give empty results; further columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import afresh, bounded_batches, map_arrow, materialize, release, slices, table

#: A term is a run of bytes other than these: ASCII letters, digits, and all that is not ASCII.
_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_IN_TERM = np.ones(256, bool)
_IN_TERM[_SEPARATORS] = False
_PLAIN = bytes(b" "[0] if b in set(_SEPARATORS) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Impacts are below 10^6; 255 steps of this size reach over them.
STEP = 3922
#: Bytes of text and rows of a segment.
SEGMENT_BYTES, SEGMENT_ROWS = 24 << 20, 60_000
#: Bytes of a long text that are cut into terms at a time.
PIECE = 4 << 20
#: Pairs of an item and a term in a block of items, about.
PAIRS = 200_000
#: Rows up to which the list of segments to read is broadcast; beyond it all segments are read.
BROADCAST_ROWS = 500_000

INDEX = "segment long, size int, terms array<string>, ends binary, places binary, impacts binary, ids array<long>, counts binary, lengths binary"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded number at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(texts: pa.Array) -> np.ndarray:
    """How many terms each text has, from the bytes of the whole column."""
    texts = pc.fill_null(texts, "")
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(len(texts), np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    inside = _IN_TERM[np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]]
    at -= at[0]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = at[:-1][at[:-1] < len(inside)]
    first[opens] = inside[opens]
    return np.diff(np.concatenate([[0], np.cumsum(first)])[at])


@dataclass
class Index:
    """Stored segments, and how many documents and terms the corpus has."""

    segments: DataFrame
    documents: int
    terms: int


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term that occurs ``tf`` times adds, per unit of weight, in documents of ``n`` terms."""
    kind = np.int64 if 50 * int(n.max(initial=0)) * documents < 1 << 62 else object
    m = (50 + (50 * n.astype(kind) * documents) // max(total, 1)).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _Codes(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = found = len(self)
        return found


class _Segment:
    """Documents of a task, until there are enough for a row."""

    def __init__(self):
        self.codes, self.found, self.ids, self.bytes = _Codes(), [], [], 0

    def add(self, key: int | None, text: str | None) -> None:
        parts = [np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)) for words in terms(text)]
        self.found.append(parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.int32), *parts]))
        self.ids.append(key)
        self.bytes += len(text or "")

    def full(self) -> bool:
        return self.bytes >= SEGMENT_BYTES or len(self.ids) >= SEGMENT_ROWS

    def packed(self, number: int, documents: int, total: int) -> pa.RecordBatch:
        size = len(self.ids)
        lengths = np.array([len(x) for x in self.found], np.int64)
        pairs = np.concatenate([np.empty(0, np.int32), *self.found]).astype(np.int64) * size + np.repeat(np.arange(size), lengths)
        pairs, counts = np.unique(pairs, return_counts=True)
        code, place = pairs // size, pairs % size
        ends = np.searchsorted(code, np.arange(1, len(self.codes) + 1)).astype("<i4")
        bytes_ = -(-impact(counts, lengths[place], documents, total) // STEP)
        counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
        row = [number, size, [t.decode("utf-8", "replace") for t in self.codes], ends.tobytes(), place.astype("<u2").tobytes(), bytes_.astype(np.uint8).tobytes(), self.ids, counts.tobytes(), lengths.astype("<i8").tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names=[c.split()[0] for c in INDEX.split(", ")])


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows: one pass over the bytes for the two numbers every impact needs, one to write."""
    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bounded_batches(docs.sparkSession)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = term_counts(batch.column("text"))
        return pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["documents", "terms"])

    sums = map_arrow(named.select("text"), counted, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, total = (int(x or 0) for x in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        held, nth = _Segment(), TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                held.add(k, t)
                if held.full():
                    yield held.packed(nth, documents, total)
                    held, nth = _Segment(), nth + 1
        if held.ids:
            yield held.packed(nth, documents, total)
        release()

    return Index(materialize(named.mapInArrow(run, INDEX), "lexical_index"), documents, total)


class _Block:
    """Items asked together: their terms, and later the weights of these."""

    def __init__(self, pairs: list[tuple[int, str]]):
        self.terms = sorted({t for _, t in pairs})
        at = {t: k for k, t in enumerate(self.terms)}
        self.items = sorted({i for i, _ in pairs})
        of: dict[int, list[int]] = {i: [] for i in self.items}
        for i, t in pairs:
            of[i].append(at[t])
        self.of = [np.array(of[i], np.int64) for i in self.items]
        self.weights = np.zeros(len(self.terms), np.int64)

    def here(self, held: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term of the block, where its postings start and end in a segment (0 and 0: nowhere)."""
        found = pc.index_in(held, value_set=pa.array(self.terms, pa.string()))
        own = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        code = found.take(pa.array(own)).to_numpy(zero_copy_only=False).astype(np.int64)
        start, end = np.zeros(len(self.terms), np.int64), np.zeros(len(self.terms), np.int64)
        start[code], end[code] = np.where(own > 0, ends[own - 1], 0), ends[own]
        return start, end


def _of(row: pa.RecordBatch, name: str, r: int, kind: str) -> np.ndarray:
    return np.frombuffer(row.column(name)[r].as_buffer(), kind)


class _Bounds:
    """Upper and lower bounds of all documents of one segment, item by item."""

    def __init__(self, block: _Block, batch: pa.RecordBatch, r: int):
        self.block, self.size = block, batch.column("size")[r].as_py()
        self.ids = batch.column("ids")[r].values
        self.known = self.ids.is_valid().to_numpy(zero_copy_only=False)
        self.places, self.impacts = _of(batch, "places", r, "<u2"), _of(batch, "impacts", r, np.uint8)
        self.start, self.end = block.here(batch.column("terms")[r].values, _of(batch, "ends", r, "<i4"))

    def held(self, item: int) -> np.ndarray:
        """The item's terms that occur here and weigh something."""
        own = self.block.of[item]
        return own[(self.end[own] > self.start[own]) & (self.block.weights[own] > 0)]

    def of(self, item: int) -> tuple[np.ndarray, np.ndarray] | None:
        own = self.held(item)
        if not len(own):
            return None
        parts = [slice(a, b) for a, b in zip(self.start[own], self.end[own])]
        at = np.concatenate([self.places[p] for p in parts])
        w = np.repeat(self.block.weights[own].astype(np.float64), self.end[own] - self.start[own])
        upper = np.bincount(at, weights=w * np.concatenate([self.impacts[p] for p in parts]), minlength=self.size)
        lower = upper - np.bincount(at, weights=w, minlength=self.size)
        # Documents without an id are no candidates.
        return np.where(self.known, upper, 0) * STEP, np.where(self.known, lower, -1) * STEP


def _weigh(block: _Block, index: Index, spark: SparkSession) -> None:
    """Count each term's documents and set its weight."""
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        total = np.zeros(len(sent.value.terms), np.int64)
        for batch in batches:
            for r in range(batch.num_rows):
                start, end = sent.value.here(batch.column("terms")[r].values, _of(batch, "ends", r, "<i4"))
                total += end - start
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], names=["term", "df"])

    for r in index.segments.select("terms", "ends").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        block.weights[r["term"]] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * r["df"] + 1)))
    sent.unpersist()


def _best(rows: DataFrame, k: int, item: str, *order) -> DataFrame:
    """The k first rows of each item; Spark limits the groups inside tasks before it moves them."""
    place = F.row_number().over(Window.partitionBy(item).orderBy(*order))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def _bounded(block: _Block, index: Index, k: int, spark: SparkSession) -> tuple[np.ndarray, DataFrame]:
    """The k-th largest lower bound of each item (0: fewer documents), and (segment, item, value): the
    largest upper bound of each item in each segment that may reach it."""
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        block = sent.value
        most: list[np.ndarray] = [np.empty(0) for _ in block.items]
        out: list[tuple[int, int, float]] = []
        for batch in batches:
            for r in range(batch.num_rows):
                bounds, segment = _Bounds(block, batch, r), batch.column("segment")[r].as_py()
                for item in range(len(block.items)):
                    found = bounds.of(item)
                    if found is None:
                        continue
                    upper, lower = found
                    top = upper.max(initial=0)
                    bar = most[item].min() if len(most[item]) == k else 0
                    if top <= 0 or top < bar:
                        continue
                    out.append((segment, item, top))
                    low = lower[(upper > 0) & (lower >= bar)]
                    low = np.concatenate([most[item], low])
                    most[item] = np.partition(low, -k)[-k:] if len(low) > k else low
                if len(out) > 100_000:
                    yield rows(out)
                    out = []
        yield rows(out + [(-1, item, x) for item, found in enumerate(most) for x in found])

    def rows(out: list) -> pa.RecordBatch:
        s, i, v = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(i, pa.int32()), pa.array([int(x) for x in v], pa.int64())], names=["segment", "item", "value"])

    first = index.segments.select("segment", "size", "terms", "ends", "places", "impacts", "ids")
    found = materialize(first.mapInArrow(run, "segment long, item int, value long"), "bounds")
    least = np.zeros(len(block.items), np.int64)
    for r in _best(found.filter("segment < 0"), k, "item", F.desc("value")).groupBy("item").agg(F.count("*").alias("n"), F.min("value").alias("v")).collect():
        least[r["item"]] = r["v"] if r["n"] == k else 0
    bars = spark.createDataFrame([(k, int(x)) for k, x in enumerate(least)], "item int, bar long")
    # One row an item of the block.
    return least, found.filter("segment >= 0").join(F.broadcast(bars), "item").filter("value >= bar").select("segment", "item")


def _rescored(block: _Block, index: Index, least: np.ndarray, reach: DataFrame, k: int, spark: SparkSession) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block."""
    sent, bars = spark.sparkContext.broadcast(block), spark.sparkContext.broadcast(least)
    documents, total = index.documents, index.terms
    wanted = materialize(reach.groupBy("segment").agg(F.collect_list("item").alias("items")), "reach")
    if wanted.count() <= BROADCAST_ROWS:
        segments = index.segments.join(F.broadcast(wanted), "segment")
    else:
        segments = index.segments.withColumn("items", F.lit(None).cast("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        block, bar = sent.value, bars.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                bounds = _Bounds(block, batch, r)
                n = _of(batch, "lengths", r, "<i8")
                counts = _of(batch, "counts", r, f"<u{max(1, len(batch.column('counts')[r].as_buffer()) // max(1, len(bounds.places)))}")
                place = np.full(bounds.size, -1, np.int64)
                ids = bounds.ids.fill_null(0).to_numpy()
                for item in batch.column("items")[r].as_py() or range(len(block.items)):
                    found = bounds.of(item)
                    if found is None:
                        continue
                    left = np.flatnonzero((found[0] > 0) & (found[0] >= bar[item]))
                    if not len(left):
                        continue
                    place[left] = np.arange(len(left))
                    score = np.zeros(len(left), np.int64)
                    for term in bounds.held(item):
                        part = slice(bounds.start[term], bounds.end[term])
                        own = place[bounds.places[part]]
                        hit = own >= 0
                        own = own[hit]
                        # A document stands once in a term's postings.
                        score[own] += block.weights[term] * impact(counts[part][hit].astype(np.int64), n[left[own]], documents, total)
                    place[left] = -1
                    some = score > 0
                    s, d = score[some], ids[left[some]]
                    if item in held:
                        s, d = np.concatenate([held[item][0], s]), np.concatenate([held[item][1], d])
                    best = np.lexsort((d, -s))[:k]
                    held[item] = s[best], d[best]
        of = [np.full(len(s), block.items[item], np.int64) for item, (s, _) in held.items()]
        s, d = ([x[c] for x in held.values()] for c in (0, 1))
        none = [np.empty(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(none + x)) for x in (of, d, s)], names=["item_id", "doc_id", "score"])

    return _best(segments.mapInArrow(run, "item_id long, doc_id long, score long"), k, "item_id", F.desc("score"), "doc_id").select("item_id", "rank", "doc_id", "score")


def search(index: Index, items: DataFrame, k: int = 50, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = items.sparkSession

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted({t.decode("utf-8", "replace") for part in terms(x) for t in part}) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.string()))], names=["item", "terms"])

    named = items.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item"), F.col(text).alias("text"))
    pairs = materialize(map_arrow(named, split, "item long, terms array<string>").select("item", F.explode("terms").alias("term")).distinct(), "asked")
    blocks = max(1, -(-pairs.count() // PAIRS))
    found: DataFrame | None = None
    for b in range(blocks):
        own = pairs if blocks == 1 else pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        block = _Block([(r["item"], r["term"]) for r in own.collect()])
        if not block.items or not index.terms:
            continue
        _weigh(block, index, spark)
        least, reach = _bounded(block, index, k, spark)
        best = materialize(_rescored(block, index, least, reach, k, spark), "found")
        found = best if found is None else found.unionByName(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


ORACLE_SQL = {"op11_lexical": r"""
with t as materialized (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
), tf as materialized (select doc_id, term, count(*) as tf from t group by doc_id, term),
n as materialized (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
totals as (select count(*) as docs, sum(n)::bigint as terms from n),
w as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::double))::bigint as w from tf, totals group by term, docs),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
m as (select doc_id, 50 + (50 * n * docs) // terms as m from n, totals),
scored as (
    select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
    from asked join w using (term) join tf using (term) join m using (doc_id) group by item_id, doc_id
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score
from scored where score > 0 qualify rank <= 50
"""}


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), 50)
