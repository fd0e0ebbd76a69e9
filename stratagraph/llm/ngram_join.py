"""N-gram Jaccard self-join by a size-aware heavy-light split (operator 1).

A document is the set of its distinct word n-grams (64-bit hashes). Equal sets fall together by
their fingerprint at once, so copies, however many, are one node. Two nodes link when
``100 * intersection >= percent * union``.

* Light nodes (at most ``boundary`` n-grams) list every subset they could share with a linked
  partner: all subsets without at most ``size * (100 - percent) / 100`` elements. Two light nodes
  that link hold the very same subset (their intersection).
* Heavy nodes meet in inverted lists of n-grams. In an order of all n-grams from rare to frequent,
  two sets that link share one of their first ``size - ceil(size * percent / 100) + 1``, so only
  those are listed. How frequent an n-gram is comes from counts of all n-grams of all documents, so
  passages that many documents share make no long lists; near-equal sets do. Light nodes within
  reach of the boundary are listed too, so heavy-light pairs are found.
* The boundary is chosen by cost: entries listed either way, over the counted sizes.

Lists are not expanded into pairs. Lists with the same or mostly the same members become one. Each is
compared with its hub, the member found in most lists; verified links give connected components, and a list that still holds different components
is compared in full, in tiles of bounded size from which only links come out. A pair is left out only
if both are known to be in one component. Components are therefore exact, and a group of n near
copies of one text costs about n comparisons.

Before a set is fetched for a comparison, sketches decide whether it can succeed at all: a sketch
counts the set's elements in ``BLOCKS`` ranges of the hash space, and the sum of the smaller counts
bounds the intersection from above. Texts that only share a passage are told apart so, at a
hundredth of the volume.

Documents without words have an empty set and link with nothing; those with fewer words than an
n-gram are one n-gram. Null texts are empty. Rows with a null id take no part and get a null
component. Repeated rows are copies of each other; where an id repeats with different texts each row
gets the component of its own text. Texts of any length are read whole, an empty table gives an empty
result, ties (equal smallest ids) cannot arise, and other columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import afresh, folded, held, materialize, release, shuffle_width, slices, table, trim
from .components import connected_components

#: Sizes up to which a boundary is considered.
MOST_LIGHT = 40
#: A list entry of a heavy node is written and then scanned, with the sets that share only this
#: n-gram among those found; a subset of a light node is written, and found only by true partners.
SCAN_COST = 4.0
#: Words one worker remembers the hash of.
CACHE_ENTRIES = 300_000
#: Counters of n-grams, the same at every size of the corpus, and the parts they are summed in.
COUNTERS, CHUNKS = 1 << 21, 256
#: Ranges of the hash space a sketch counts elements in; a byte each.
BLOCKS = 128
#: Bits of the filter that tells which texts to read again. It is used for up to an eighth as many
#: texts; beyond that the texts are found by a shuffled semi-join.
FILTER_BITS = 1 << 23
#: Nodes in a chunk; two chunks are compared at a time.
TILE = 512
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word ``n``-grams; A-Z lower-cased, words cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=7)], np.uint64)
    codes = np.fromiter(map(held("words", _Words).__getitem__, words), np.uint64, len(words))
    last = len(codes) - n + 1
    found = codes[:last]
    for k in range(1, n):
        found = mix(found * GOLDEN + codes[k : last + k])
    return np.unique(found)


class Plan:
    """Which lists a set belongs to, for one similarity and boundary."""

    def __init__(self, percent: int, boundary: int = 0, counts: np.ndarray | None = None):
        self.percent, self.boundary = percent, boundary
        self.counts = np.zeros(1, np.uint32) if counts is None else counts
        self.shift = np.uint64(64 - int(len(self.counts)).bit_length() + 1)
    def misses(self, size: int) -> int:
        """Most elements of a set that a linked partner can lack."""
        return size * (100 - self.percent) // 100

    def subsets(self, size: int) -> int:
        return sum(comb(size, m) for m in range(self.misses(size) + 1))

    def is_light(self, size: int) -> bool:
        return size <= self.boundary

    def is_listed(self, size: int) -> bool:
        """Whether some partner can be heavy."""
        return size * 100 >= (self.boundary + 1) * self.percent

    def entries(self, size: int) -> int:
        return self.misses(size) + 1

    def cost(self, sizes: dict[int, int]) -> float:
        return sum(n * (self.subsets(s) * self.is_light(s) + (1 + SCAN_COST) * self.entries(s) * self.is_listed(s)) for s, n in sizes.items())

    def keys(self, items: np.ndarray) -> np.ndarray:
        """The lists a set belongs to."""
        size, found = len(items), []
        if self.is_light(size):
            spread = mix(items + GOLDEN)
            total = spread.sum(dtype=np.uint64)
            for m in range(self.misses(size) + 1):
                without = np.array([spread[list(c)].sum(dtype=np.uint64) for c in combinations(range(size), m)], np.uint64) if m != 1 else spread
                found.append(mix(total - without + np.uint64(size - m)))
        if self.is_listed(size):
            often = self.counts[items >> self.shift] if len(self.counts) > 1 else np.zeros(size, np.uint32)
            first = np.lexsort((items, often))[: self.entries(size)]
            found.append(items[first])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def frequencies(docs: DataFrame, n: int, text: str = "text") -> np.ndarray:
    """How often the n-grams of each hash range occur in all documents, as 64 log2(1 + count): tasks
    count, chunks are summed, and the driver gets ``COUNTERS`` numbers of two bytes."""
    shift, part = np.uint64(64 - COUNTERS.bit_length() + 1), COUNTERS // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint64)
        for batch in slices(batches, text):
            found = [shingles(t, n) >> shift for t in batch.column(text).to_pylist()]
            counts += np.bincount(np.concatenate([np.empty(0, np.uint64), *found]).astype(np.int64), minlength=COUNTERS).astype(np.uint64)
        release()
        rows = []
        for k in range(CHUNKS):
            own = counts[k * part : (k + 1) * part]
            if own.any():
                rows.append((k, zlib.compress(own.astype(np.min_scalar_type(own.max())).tobytes(), 1)))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", "counts"])

    def add(total: np.ndarray | None, data: bytes) -> np.ndarray:
        own = np.frombuffer(data, f"<u{len(data) // part}").astype(np.float64)
        return own if total is None else total + own

    out = np.zeros((CHUNKS, part), np.uint16)
    for r in folded(docs.select(text).mapInArrow(run, "chunk int, counts binary"), "counts", add, shuffle_width(docs.sparkSession)).collect():
        out[r["chunk"]] = np.rint(64 * np.log2(1 + np.frombuffer(r["counts"], np.float64)))
    return out.ravel()


def small_sizes(docs: DataFrame, n: int, text: str = "text") -> dict[int, int]:
    """About how many sets there are of each small size; only the choice of the boundary rests on it."""
    words = F.size(F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")) - (n - 1)
    short = docs.filter(F.length(text) < 40 * MOST_LIGHT).select(F.greatest(words, F.lit(1)).alias("size")).filter(F.col("size") <= MOST_LIGHT)
    return {r[0]: r[1] for r in short.groupBy("size").count().collect()}


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    return min(range(MOST_LIGHT + 1), key=lambda b: (Plan(percent, b).cost(sizes), b))


def sketch(items: np.ndarray) -> bytes:
    """Elements in each of ``BLOCKS`` ranges of the hash space, up to 255."""
    return np.minimum(np.bincount((items >> np.uint64(64 - BLOCKS.bit_length() + 1)).astype(np.int64), minlength=BLOCKS), 255).astype(np.uint8).tobytes()


def may_link(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with these sketches (rows of ``a`` and ``b``, broadcast together) can link."""
    shared = np.minimum(a, b).sum(axis=-1, dtype=np.int64)
    # What sketches do not count (more than 255 in a range) may all be shared.
    shared += np.minimum(a_size - a.sum(axis=-1, dtype=np.int64), b_size - b.sum(axis=-1, dtype=np.int64))
    return 100 * shared >= percent * (a_size + b_size - shared)


def marks_of(data: bytes, bits: int = 64) -> tuple[int, int]:
    """Two fingerprints of a set, the first of ``bits`` bits."""
    return xxhash.xxh3_64_intdigest(data) & ((1 << bits) - 1), xxhash.xxh3_64_intdigest(data, seed=1)


def told_apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """Rows (sig, sig2, ...) in which different sets of one first fingerprint, should there be any (``clashes``: sig
    and its smallest sig2), have nodes of their own."""
    if clashes is None:
        return rows
    own = F.col("least").isNotNull() & (F.col("sig2") != F.col("least"))
    return rows.join(clashes, "sig", "left").withColumn("sig", F.when(own, F.xxhash64("sig", "sig2")).otherwise(F.col("sig"))).select(rows.columns)


def nodes_of(docs: DataFrame, plan: Plan, n: int, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """(``key``, n_shingles, sig, sig2, text_hash, lists, sketch): lists and sketch are given once a task for
    equal sets, by a row whose key is not null."""
    kind = docs.schema[key].dataType.simpleString()
    counts = docs.sparkSession.sparkContext.broadcast(plan.counts)
    percent, boundary = plan.percent, plan.boundary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(percent, boundary, counts.value)
        seen: set[tuple[int, int] | None] = set()
        for batch in slices(batches, "text"):
            sizes, marks, checks, lists, sketches = [], [], [], [], []
            for known, t in zip(batch.column("key").is_valid().to_pylist(), batch.column("text").to_pylist()):
                items = shingles(t, n)
                data = items.tobytes()
                mark = marks_of(data, bits) if len(items) else None
                fresh = known and len(items) and mark not in seen
                sizes.append(len(items))
                marks.append(mark and mark[0])
                checks.append(mark and mark[1])
                lists.append(plan.keys(items).view(np.int64) if fresh else np.empty(0, np.int64))
                sketches.append(sketch(items) if fresh else None)
                if known:
                    seen.add(mark)
            at = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int64), *lists])))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), signed(marks), signed(checks), batch.column("text_hash"), held, pa.array(sketches, pa.binary())], names=["key", "n_shingles", "sig", "sig2", "text_hash", "lists", "sketch"])
        release()

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return named.mapInArrow(run, f"key {kind}, n_shingles long, sig long, sig2 long, text_hash long, lists array<long>, sketch binary")


def signed(values: list[int | None]) -> pa.Array:
    return pa.array([None if v is None else v - (1 << 64) if v >> 63 else v for v in values], pa.int64())


def scan(entries: DataFrame, width: int, percent: int) -> DataFrame:
    """(list, pivot, member) for every list with two nodes or more: its first node and each other.

    A list is sorted by size and cut wherever the next set is too large for any before the cut to link
    with any after it; the parts are lists of their own. Sorted by Spark, then streamed: of the list in
    hand only its pivot and latest member are remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        carry = None  # list, size and node of the latest row; pivot and name of its list
        for batch in batches:
            if not batch.num_rows:
                continue
            k, size, s = (batch.column(c).to_numpy() for c in ("list", "size", "sig"))
            if carry is not None:
                k, size, s = np.concatenate([[carry[0]], k]), np.concatenate([[carry[1]], size]), np.concatenate([[carry[2]], s])
            fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
            k, size, s = k[fresh], size[fresh], s[fresh]
            start = np.concatenate([[True], (k[1:] != k[:-1]) | (100 * size[:-1] < percent * size[1:])])
            first = np.flatnonzero(start)[np.cumsum(start) - 1]
            pivot, name = s[first], mix(k[first].view(np.uint64) + mix(s[first].view(np.uint64))).view(np.int64)
            if carry is not None:
                pivot, name = np.where(first == 0, carry[3], pivot), np.where(first == 0, carry[4], name)
            own = ~start
            carry = (k[-1], size[-1], s[-1], pivot[-1], name[-1])
            yield pa.RecordBatch.from_arrays([pa.array(name[own]), pa.array(pivot[own]), pa.array(s[own])], names=["list", "pivot", "member"])
        trim()

    return entries.select("list", "size", "sig").repartition(width, "list").sortWithinPartitions("list", "size", "sig").mapInArrow(run, "list long, pivot long, member long")


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of hashed ids, of a fixed size: made by tasks, joined by chunk."""
    chunk = FILTER_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy()] = True
        used = [k for k in range(64) if bits[k * chunk : (k + 1) * chunk].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(np.packbits(bits[k * chunk : (k + 1) * chunk]).tobytes(), 1) for k in used], pa.binary())], names=["chunk", "bits"])

    def join(total: np.ndarray | None, data: bytes) -> np.ndarray:
        own = np.frombuffer(data, np.uint8)
        return own if total is None else total | own

    placed = ids.select(F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).alias("at"))
    out = np.zeros((64, chunk // 8), np.uint8)
    for r in folded(placed.mapInArrow(run, "chunk int, bits binary"), "bits", join, shuffle_width(ids.sparkSession)).collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, key: str, text: str, clashes: DataFrame | None = None, bits: int = 64) -> DataFrame:
    """(sig, items): the sets of the nodes in ``wanted`` (sig, rep), read again from their texts. Up to
    ``FILTER_BITS`` / 8 of them pass by a filter of fixed size, a few others with them, for which no
    join asks; more are found by a semi-join that moves texts."""
    spark = docs.sparkSession
    known = docs.filter(F.col(key).isNotNull()).select(F.col(text).alias("text"), F.col(key).alias("key"))
    few = wanted.count() <= FILTER_BITS // 8
    passing = spark.sparkContext.broadcast(id_filter(wanted, "rep") if few else None)
    placed = known.select("text", F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)).alias("at")) if few else known.join(wanted.select(F.col("rep").alias("key")), "key", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if few:
                at = batch.column("at").to_numpy()
                batch = batch.take(pa.array(np.flatnonzero(passing.value[at >> 3] >> (7 - (at & 7)) & 1)))
            for part in slices([batch]):
                data = [shingles(t, n).tobytes() for t in part.column("text").to_pylist()]
                first, second = zip(*(marks_of(x, bits) for x in data)) if data else ((), ())
                yield pa.RecordBatch.from_arrays([signed(list(first)), signed(list(second)), pa.array(data, pa.binary())], names=["sig", "sig2", "items"])
        release()

    return told_apart(placed.mapInArrow(run, "sig long, sig2 long, items binary"), clashes).select("sig", "items")


def compatible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BLOCKS) for c in ("x", "y"))
            ok = may_link(x, batch.column("x_size").to_numpy(), y, batch.column("y_size").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))
        trim()

    of = lambda node, name: sketches.select(F.col("sig").alias(node), F.col("size").alias(f"{name}_size"), F.col("sketch").alias(name))
    return pairs.join(of("b", "y"), "b").join(of("a", "x"), "a").select("a", "b", "x", "x_size", "y", "y_size").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        for batch in batches:
            ok = []
            x_old, x = None, None
            for k, (i, j) in enumerate(zip(batch.column("x"), batch.column("y"))):
                a, b = np.frombuffer(i.as_buffer(), np.uint64), np.frombuffer(j.as_buffer(), np.uint64)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                at = np.searchsorted(a, b)
                shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    ok.append(k)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(ok, pa.int64())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])
        trim()

    one = pairs.join(sets.select(F.col("sig").alias("b"), F.col("items").alias("y")), "b")
    both = one.join(sets.select(F.col("sig").alias("a"), F.col("items").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def tiles_of(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Rows (list, node, component, n) with columns of ``more`` (sig, ...), dealt into tiles (list, i, j): a
    list of n nodes is cut into chunks of about ``TILE``, and each pair of chunks is a tile."""
    dealt = rows.withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    spread = dealt.join(more.withColumnRenamed("sig", "node"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = spread.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("n", "chunks", "other")
    # Tiles are few bytes and much work, so their number of tasks is not left to their size.
    return tiles.repartition(shuffle_width(rows.sparkSession), "list", "i", "j")


def tile_partners(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(list, node): nodes that, by sketches, can link with one of another component in their list."""

    def compare(pdf):
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        pdf = pdf.drop_duplicates("node")
        marks, size, comp = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(-1, BLOCKS), pdf["size"].to_numpy(), pdf["component"].to_numpy()
        left, right = np.flatnonzero(pdf["chunk"] == i), np.flatnonzero(pdf["chunk"] == j)
        good = np.zeros(len(pdf), bool)
        for x in left:
            near = right[(comp[right] != comp[x]) & (100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x]))]
            near = near[may_link(marks[near], size[near], marks[x], size[x], percent)]
            good[near] = True
            good[x] |= len(near) > 0
        if len(pdf) > TILE:
            trim()
        return pd.DataFrame({"list": pdf["list"].to_numpy()[good], "node": pdf["node"].to_numpy()[good]})

    return tiles_of(rows, sketches).groupBy("list", "i", "j").applyInPandas(compare, "list long, node long").distinct()


def tile_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of different components that share a list, enough of them to
    connect what is connected: every list (list, node, component, n) is compared in full, in tiles of
    bounded size from which only links come out."""
    tiles = tiles_of(rows, sets.select("sig", "items"))

    def compare(pdf):
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        pdf = pdf.drop_duplicates("node").sort_values("node")
        sets_ = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        size = np.array([len(x) for x in sets_])
        items, code, often = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets_)), size)
        keep = often[code] > 1
        code, owner = (np.cumsum(often > 1) - 1)[code[keep]], owner[keep]
        left, right = np.flatnonzero(pdf["chunk"] == i), np.flatnonzero(pdf["chunk"] == j)
        shared = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            part = slice(*np.searchsorted(code, [low, low + 4096]))
            m = np.zeros((len(sets_), 4096), np.float32)
            m[owner[part], code[part] - low] = 1
            shared += m[left] @ m[right].T
        comp = pdf["component"].to_numpy()
        ok = (100 * shared >= percent * (size[left][:, None] + size[right][None, :] - shared)) & (comp[left][:, None] != comp[right][None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        node, out = pdf["node"].to_numpy(), []
        for x, y in zip(*np.nonzero(ok)):
            x, y = left[x], right[y]
            u, v = root(comp[x]), root(comp[y])
            if u != v:
                parent[max(u, v)] = min(u, v)
                out.append((node[x], node[y]))
        if len(pdf) > TILE:
            del pdf, sets_, items, code, owner, shared, ok
            trim()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return tiles.groupBy("list", "i", "j").applyInPandas(compare, "a long, b long")


def members_of(lists: DataFrame) -> DataFrame:
    """(list, node) from (list, pivot, member)."""
    return lists.select("list", F.col("member").alias("node")).unionByName(lists.select("list", F.col("pivot").alias("node")).distinct())


def merged_lists(rows: DataFrame) -> DataFrame:
    """(list, node) with lists of the same members, and lists that share most members, made one.

    Near copies share nearly all their lists, each list without the few copies edited there; in place
    of hundreds of lists their union is compared once. Every list lies within the one it went into,
    so no pair is lost. A list goes where two thirds of its members have their longest list.
    """
    marks = rows.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("mark2"))
    one = marks.groupBy("n", "mark", "mark2").agg(F.min("list").alias("list")).select("list", "n")
    kept = materialize(rows.join(one, "list"), "lists")
    longest = kept.groupBy("node").agg(F.max(F.struct("n", "list")).alias("m")).select("node", F.col("m.list").alias("longest"))
    votes = kept.join(longest, "node").groupBy("list", "longest").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    into = votes.filter("list <> longest and 3 * c >= 2 * n").select("list", "longest")
    unions = connected_components(into, "list", "longest").select(F.col("node").alias("list"), "component")
    return kept.join(unions, "list", "left").select(F.coalesce("component", "list").alias("list"), "node").distinct()


def linked_components(docs: DataFrame, lists: DataFrame, places: DataFrame, sketches: DataFrame, reps: DataFrame, n: int, percent: int, key: str, text: str, clashes: DataFrame | None = None, bits: int = 64) -> DataFrame:
    """(sig, component) of all nodes with a link, from the lists (list, node).

    ``places`` (node, n) tells how many lists found a node; the hub of a list is its member with most:
    of near copies that is the text they all come from, or the one nearest to it. ``reps`` (sig, rep)
    names a document of each set, from whose text the set is made again where it is needed.
    """

    def sets(nodes: DataFrame) -> DataFrame:
        wanted = materialize(nodes.select(F.col("node").alias("sig")).distinct().join(reps, "sig"), "wanted")
        return materialize(sets_of(docs, wanted, n, key, text, clashes, bits), "sets")

    hubs = lists.join(places.withColumnRenamed("n", "w"), "node").groupBy("list").agg(F.max(F.struct("w", "node")).alias("hub")).select("list", F.col("hub.node").alias("hub"))
    met = materialize(lists.join(hubs, "list").filter("node <> hub"), "met")
    pairs = materialize(compatible(met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), sketches, percent), "pairs")
    of_pairs = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    links = materialize(verified(pairs, of_pairs, percent), "links")
    named = materialize(connected_components(links, "a", "b"), "components")
    # The hub has met all; what is left is how the others stand to each other.
    left = materialize(met.join(named, "node", "left").select("list", "node", F.coalesce("component", "node").alias("component")), "left")
    open_ = left.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("list", "n")
    rows = materialize(left.join(open_, "list"), "open")
    able = tile_partners(rows, sketches, percent)
    some = materialize(rows.drop("n").join(able, ["list", "node"], "left_semi"), "able")
    if some.isEmpty():
        return named.withColumnRenamed("node", "sig")
    counted = some.join(some.groupBy("list").agg(F.count("*").alias("n")), "list")
    more = materialize(tile_links(counted, sets(some), percent), "links")
    return connected_components(links.unionByName(more), "a", "b").withColumnRenamed("node", "sig")


def components_of(docs: DataFrame, n: int, percent: int, key: str, text: str, boundary: int | None, bits: int = 64) -> DataFrame:
    """(key, n_shingles, sig, text_hash, group, component_id) of every row; a group is null for empty sets.

    Sets are known by a fingerprint of ``bits`` bits; where two different sets share one (a second fingerprint
    shows it), they get nodes of their own.
    """
    spark = docs.sparkSession
    if boundary is None:
        boundary = choose_boundary(small_sizes(docs, n, text), percent)
    nodes = materialize(nodes_of(docs, Plan(percent, boundary, frequencies(docs, n, text)), n, key, text, bits), "nodes")
    held = nodes.filter(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("sig2").alias("least"), F.max("sig2").alias("most"))
    clashes: DataFrame | None = materialize(held.filter("least <> most").select("sig", "least"), "clashes")
    if clashes.isEmpty():
        clashes = None
    nodes = told_apart(nodes, clashes)
    known = nodes.filter(F.col("key").isNotNull() & F.col("sig").isNotNull())
    entries = known.select("sig", F.col("n_shingles").cast("int").alias("size"), F.explode("lists").alias("list"))
    members = members_of(materialize(scan(entries, shuffle_width(spark), percent), "scanned"))
    lists = materialize(merged_lists(members), "lists")
    places = members.groupBy("node").agg(F.count("*").alias("n"))
    reps = materialize(known.groupBy("sig").agg(F.min("key").alias("rep")), "reps")
    in_lists = lists.select(F.col("node").alias("sig")).distinct()
    sketches = materialize(known.filter("sketch is not null").select("sig", F.col("n_shingles").alias("size"), "sketch").join(in_lists, "sig", "left_semi").groupBy("sig").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch")), "sketches")
    parts = materialize(linked_components(docs, lists, places, sketches, reps, n, percent, key, text, clashes, bits), "parts")
    named = parts.join(reps, "sig")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = reps.join(named.join(least, "component").select("sig", "component", "component_id"), "sig", "left").select("sig", F.coalesce("component", "sig").alias("group"), F.coalesce("component_id", "rep").alias("component_id"))
    return nodes.select("key", "n_shingles", "sig", "text_hash").join(of, "sig", "left").withColumn("component_id", F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")))


def join(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", boundary: int | None = None, bits: int = 64) -> DataFrame:
    """``key``, n_shingles, component_id (smallest key reachable by links) for every row."""
    return components_of(docs, n, percent, key, text, boundary, bits).select(F.col("key").alias(key), "n_shingles", "component_id")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: of those with the key the group is named by, the one of the
    smallest fingerprint. Decided by row, not by key: where a key repeats with different texts, each
    text belongs to its own group. Rows with a null key all stay; of empty texts one stays for each key.
    """
    found = components_of(docs, n, percent, key, text, None).filter("component_id = key")
    mark, nth = unused(docs, "text_hash"), unused(docs, "nth_row")
    kept = found.groupBy("key", "group").agg(F.min(F.struct("sig", "text_hash")).alias("m")).select(F.col("key").alias(key), F.col("m.text_hash").alias(mark))
    known = docs.filter(F.col(key).isNotNull()).withColumn(mark, F.xxhash64(text))
    first = Window.partitionBy(key, mark).orderBy(F.lit(0))
    one = known.join(kept, [key, mark], "left_semi").withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).select(docs.columns)
    return one.unionByName(docs.filter(F.col(key).isNull()))


ORACLE_SQL = {"op1_ngram_join": """
with recursive words as materialized (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), grams as (
    select doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3)
    union select doc_id, array_to_string(w, ' ') from words where len(w) between 1 and 2
), sets as materialized (select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as mark from grams group by doc_id),
nodes as materialized (select mark, min(doc_id) as rep, min(n) as n from sets group by mark),
held as materialized (select rep, g from grams join nodes on doc_id = rep),
links as materialized (
    select x.rep as a, y.rep as b from held x join held y on x.g = y.g and x.rep < y.rep
    join nodes p on p.rep = x.rep join nodes q on q.rep = y.rep
    where 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n)
    group by x.rep, y.rep, p.n, q.n having 100 * count(*) >= 90 * (p.n + q.n - count(*))
), edges as materialized (select a, b from links union all select b, a from links),
reach(a, b) as (select rep, rep from nodes union select reach.a, edges.b from reach join edges on edges.a = reach.b),
least_of as (select a as rep, min(b) as component_id from reach group by a)
select words.doc_id, coalesce(sets.n, 0) as n_shingles, coalesce(component_id, words.doc_id) as component_id
from words left join sets using (doc_id) left join nodes using (mark) left join least_of using (rep)
"""}


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)
