"""SimHash near-duplicates by pigeonring filtering (operator 12).

A text's words (A-Z lower-cased, cut at ASCII white space) give n-word shingles, repeats included;
a bit of the 64-bit fingerprint is set where over half of the shingles' XXH64 (seed 42) have it.
Fingerprints link where at most ``DISTANCE`` (3) bits differ.

Cut a fingerprint into four segments on a ring. If two fingerprints differ in at most 3 bits, there
is a segment from which the differences of 1, 2, 3 and 4 consecutive segments add up to no more than
1, 2, 3 and 4 quarters of 3, rounded down: 0, 1, 2 and 3 (the pigeonring principle, stronger than the
pigeonhole principle, which speaks of one segment). So only pairs are looked at that agree in a whole
segment, and of those only such whose chain stays within its budgets reach the full check.

The chain also keeps buckets small, whatever the data. Fingerprints are first put by their starting
segment (4 keys each). A bucket of more than ``BUCKET`` different fingerprints is not compared: its
members are put again by two segments, each listing every second segment within the chain's budget
(17 keys), and where that is still too much by three (409 keys). Beyond, at most 65 536 fingerprints
can share a key. Copies of one fingerprint, however many, are one node, so neither copies nor near
copies make a task that grows with their number, no pair is ever a row, and no pair is left out.

Defined results: null and empty texts have fingerprint zero, linked like any other. Rows with a null
id get a fingerprint and a null component, and link nothing. Repeated rows are copies of each other;
where an id repeats with different texts each row gets the component of its own fingerprint. Texts are
read whole at any length. An empty table gives an empty result; further columns are ignored whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import afresh, map_arrow, materialize, shuffle_width, table
from .components import connected_components

#: Bits in which linked fingerprints may differ; segments of the ring and their bits.
DISTANCE, SEGMENTS, WIDTH = 3, 4, 16
#: Different fingerprints of one key that are compared with each other; a larger bucket takes a longer chain.
BUCKET = 8192
#: Rows of shorter runs are compared along diagonals, those of longer ones in tiles of so many rows.
SHORT, TILE = 48, 1024
#: Rows up to which the table of large buckets is broadcast; beyond it is joined by shuffling.
BROADCAST_ROWS = 200_000

#: Contribution of each value of each of a hash's eight bytes to the counts of the 64 bits.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, n: int = 3) -> int:
    """The 64-bit fingerprint of a text's ``n``-word shingles; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(line, 42)
    start = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a : b - 1], 42) for a, b in zip(start, start[n:])], "<u8")
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, fp): a fingerprint for every row, as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, n) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found.view(np.int64))], names=[key, "fp"])

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_arrow(named, run, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


def budgets(distance: int = DISTANCE) -> list[int]:
    """Most differing bits in the first 1, 2, ... segments of a chain."""
    return [distance * k // SEGMENTS for k in range(1, SEGMENTS + 1)]


def variants(length: int) -> list[int]:
    """Differences (as turned fingerprints) that a partner may show in the first ``length`` segments of
    a chain that keeps its budgets, the empty one first."""
    found = [(0, 0)]
    for k, most in enumerate(budgets()[:length]):
        bits = [1 << (64 - WIDTH * (k + 1) + b) for b in range(WIDTH)]
        grown = found
        for _ in range(most):
            grown = list({(mask | bit, used + 1) for mask, used in grown for bit in bits if not mask & bit and used < most} | set(grown))
        found = grown
    return [m if m < 1 << 63 else m - (1 << 64) for m, _ in sorted(found, key=lambda x: (x[1], x[0]))]


def in_chain(difference: np.ndarray) -> np.ndarray:
    """Which differences of turned fingerprints keep the budgets of a whole chain, the last of which is
    the full check; each step only looks at what the one before left."""
    left = np.flatnonzero(difference >> np.uint64(64 - WIDTH) == 0)
    for k, most in list(enumerate(budgets(), 1))[1:]:
        left = left[np.bitwise_count(difference[left] >> np.uint64(64 - WIDTH * k)) <= most]
    return left


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node of the links (a, b) to the smallest of its component: as many as nodes at most."""
    node, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(node))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        label = new[label]
        keep = label[x] != label[y]
        x, y = x[keep], y[keep]
    while (label[label] != label).any():
        label = label[label]
    own = np.flatnonzero(label != np.arange(len(node)))
    return node[own], node[label[own]]


def compared(turned: np.ndarray, run: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) within runs of one key whose rows start with their members: members with members
    and with guests."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.concatenate([start, [len(run)]]))
    last = np.repeat(start + size, size)
    short = np.flatnonzero(np.repeat(size <= SHORT, size) & ~guest)
    for d in range(1, SHORT):
        short = short[short + d < last[short]]
        if not len(short):
            break
        hit = short[in_chain(turned[short] ^ turned[short + d])]
        left.append(hit)
        right.append(hit + d)
    for at in np.flatnonzero(size > SHORT):
        begin, end = start[at], start[at] + size[at]
        members = begin + int((~guest[begin:end]).sum())
        for i in range(begin, members, TILE):
            upto = min(i + TILE, members)
            # A tile of rows against all behind its first: what lies before the diagonal is skipped.
            for j in range(i, end, 4 * TILE):
                part = turned[j : min(j + 4 * TILE, end)]
                flat = in_chain((turned[i:upto, None] ^ part[None, :]).ravel())
                x, y = i + flat // len(part), j + flat % len(part)
                x, y = x[x < y], y[x < y]
                if len(x):
                    x, y = forest(x, y)
                    left.append(x)
                    right.append(y)
    return np.concatenate(left), np.concatenate(right)


def links_of(rows: DataFrame) -> DataFrame:
    """(a, b): enough links to connect what is connected, from rows (start, key, guest, turned) that meet by
    key. Sorted by Spark and streamed: of the run in hand a task holds its members, and guests a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()

        def found(part: list[np.ndarray]) -> pa.RecordBatch:
            start, key, guest, turned = part
            fresh = np.concatenate([[True], (start[1:] != start[:-1]) | (key[1:] != key[:-1])])
            x, y = compared(turned, np.cumsum(fresh), guest)
            if len(x):
                by = (start * WIDTH).astype(np.uint64)
                plain = (turned >> by) | (turned << ((np.uint64(64) - by) % np.uint64(64)))
                x, y = forest(plain[x], plain[y])
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64)), pa.array(y.astype(np.uint64).view(np.int64))], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("start", "key", "guest", "turned")]
            part[3] = part[3].view(np.uint64)
            part = part if held is None else [np.concatenate(c) for c in zip(held, part)]
            own = (part[0] == part[0][-1]) & (part[1] == part[1][-1])
            cut = len(own) - int(own.sum())
            if cut:
                yield found([c[:cut] for c in part])
                part = [c[cut:] for c in part]
            if part[2][-1]:  # guests have begun: compared now, and only the members stay for the next ones
                yield found(part)
                part = [c[~part[2]] for c in part]
                if not len(part[0]):
                    held = None
                    continue
            held = part
        if held is not None:
            yield found(held)

    width = shuffle_width(rows.sparkSession)
    sorted_ = rows.select("start", "key", "guest", "turned").repartition(width, "start", "key").sortWithinPartitions("start", "key", "guest", "turned")
    return sorted_.mapInArrow(run, "a long, b long")


def _key(turned, length: int):
    return F.shiftright(turned, 64 - WIDTH * length)


def linked_pairs(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) between different fingerprints of ``nodes`` (fp, distinct) that connect all that links connect."""
    turns = [F.shiftleft("fp", WIDTH * k).bitwiseOR(F.shiftrightunsigned("fp", 64 - WIDTH * k)) if k else F.col("fp") for k in range(SEGMENTS)]
    starts = F.array(*[F.struct(F.lit(k).alias("start"), t.alias("turned")) for k, t in enumerate(turns)])
    level = nodes.select(F.explode(starts).alias("s")).select("s.start", "s.turned")
    found: DataFrame | None = None
    for length in range(1, SEGMENTS):
        own = level.withColumn("key", _key(F.col("turned"), length))
        large = None
        if length < SEGMENTS - 1:
            large = materialize(own.groupBy("start", "key").count().filter(F.col("count") > bucket).select("start", "key"), "large")
            few = large.count()
            if not few:
                large = None
            elif few <= BROADCAST_ROWS:
                large = F.broadcast(large)
        probes = variants(length)[1:]
        guests = None
        if probes:
            masks = F.explode(F.array(*[F.lit(m) for m in probes]))
            guests = own.select("start", "turned", F.col("key").alias("home"), masks.alias("mask")).select("start", "turned", "home", _key(F.col("turned").bitwiseXOR(F.col("mask")), length).alias("key"))
            # A pair meets once: in the bucket of the larger key.
            guests = guests.filter("key > home").select("start", "home", "key", F.lit(True).alias("guest"), "turned")
        if large is None:
            members = own.select("start", "key", F.lit(False).alias("guest"), "turned")
            rows = members if guests is None else members.unionByName(guests.drop("home"))
            more = materialize(links_of(rows), "links")
            return more if found is None else found.unionByName(more)
        if guests is None:
            light = own.join(large, ["start", "key"], "left_anti")
            more = materialize(links_of(light.select("start", "key", F.lit(False).alias("guest"), "turned")), "links")
            found = more if found is None else found.unionByName(more)
            level = materialize(own.join(large, ["start", "key"], "left_semi").select("start", "turned"), "level")
            continue
        # Rows near a large bucket take the longer chain as well, so that every pair with one of its members
        # meets there; pairs of which neither end lies in a large bucket meet here.
        near = own.select("start", F.col("turned"), F.explode(F.array(*[F.lit(m) for m in variants(length)])).alias("mask")).select("start", "turned", _key(F.col("turned").bitwiseXOR(F.col("mask")), length).alias("key"))
        level = materialize(near.join(large, ["start", "key"], "left_semi").select("start", "turned").distinct(), "level")
        light = own.join(large, ["start", "key"], "left_anti").select("start", "key", F.lit(False).alias("guest"), "turned")
        homes = large.withColumnRenamed("key", "home")
        outside = guests.join(large, ["start", "key"], "left_anti").join(F.broadcast(homes) if few <= BROADCAST_ROWS else homes, ["start", "home"], "left_anti")
        light = light.unionByName(outside.select("start", "key", "guest", "turned"))
        found = found.unionByName(materialize(links_of(light), "links"))
    return found


def components(docs: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(``key``, fp, component_id) of every row; component_id is the smallest ``key`` reachable by links."""
    marked = materialize(fingerprints(docs, n, key, text), "fingerprints")
    # Copies become one node before anything is compared.
    nodes = materialize(marked.filter(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("rep")), "nodes")
    named = connected_components(linked_pairs(nodes, bucket), "a", "b").withColumnRenamed("node", "fp")
    parts = materialize(nodes.join(named, "fp"), "parts")
    least = parts.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = materialize(nodes.join(parts.join(least, "component").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "named")
    found = marked.join(of, "fp", "left")
    return found.select(F.col(key).alias(key), "fp", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
