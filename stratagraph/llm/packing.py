"""Best-fit packing after Martello-Toth reduction (operator 10).

Documents become pieces of at most ``capacity`` tokens, and pieces are put into as few sequences
of that capacity as can be found. The packing problem has only as many different sizes as the
capacity has tokens, so it is solved on counts: the histogram of piece lengths, at most
``capacity`` rows whatever the size of the corpus.

1. Reduction. Take the largest size left. If some set of one, two or three pieces that holds it
   dominates every other set that could share its sequence, such a sequence is part of some best
   packing: it is fixed, as often as the counts allow, and its pieces leave the instance.
   A set dominates where no second piece fits; where the largest piece that fits fills the
   sequence exactly; where at most one more piece fits (the largest that does); and where at most
   two more fit (the largest that fits, with the largest beside it, if no other pair holds a
   larger second piece, or alone if no pair is larger in sum and size).
   Without a dominating set the size is set aside and the next one is tried; after a pass that fixed
   anything all are tried again, and what is left then goes to step 2.
2. The rest is packed best-fit decreasing: each piece goes where the least room is left.

The result is a list of patterns (what a sequence holds, and how many sequences are like it); its
length is bounded by a multiple of the capacity. Pieces are then numbered within their length and
find sequence and offset by arithmetic. Numbering a length with very many pieces is dealt over
many tasks by a salt, with offsets from counts, so a length that holds a third of all rows is no
bottleneck. Null texts are empty documents: just the end id. Ties and repeated rows are numbered
by (key, piece, checksum), equal rows in any order. Null keys come first; an empty table packs into
nothing; texts of any length are cut whole; further columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, table
from .tokens import vocabulary, with_end, worker_tokenizer

CAPACITY = 2048
#: Pieces of one length numbered in one task.
PER_TASK = 100_000

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, pieces), ...) longest first; sequences


def reduce(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences fixed by dominance, and the counts left."""
    left = {k: n for k, n in counts.items() if n}
    sizes = sorted(left)  # those still in the instance
    fixed: list[Pattern] = []

    def largest_upto(room: int, spare: dict[int, int]) -> int:
        """Largest size <= room with a piece beyond those in ``spare``; 0 if none."""
        k = bisect_right(sizes, room) - 1
        while k >= 0:
            if left[sizes[k]] > spare.get(sizes[k], 0):
                return sizes[k]
            k -= 1
        return 0

    def fix(items: list[int]) -> None:
        """As often as the counts allow: taking pieces away never lets more pieces fit, so the
        same set goes on dominating until one of its sizes runs out."""
        need: dict[int, int] = {}
        for x in items:
            need[x] = need.get(x, 0) + 1
        times = min(left[x] // n for x, n in need.items())
        fixed.append((tuple(sorted(need.items(), reverse=True)), times))
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
                sizes.pop(bisect_left(sizes, x))

    def smallest(spare: dict[int, int], n: int) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(n - len(out), left[s] - spare.get(s, 0))
            if len(out) >= n:
                break
        return out

    done: set[int] = set()
    before = 0
    while True:
        at = len(sizes) - 1
        while at >= 0 and sizes[at] in done:
            at -= 1
        if at < 0:
            if len(fixed) == before:
                return fixed, left
            # Sizes set aside may be decided now that the instance is smaller.
            done.clear()
            before = len(fixed)
            continue
        big = sizes[at]
        room = capacity - big
        one = largest_upto(room, {big: 1})
        if not one:
            fix([big])
            continue
        if one == room:
            fix([big, one])
            continue
        few = smallest({big: 1}, 3)
        if len(few) < 2 or few[0] + few[1] > room:
            fix([big, one])
            continue
        if len(few) < 3 or sum(few) > room:
            # At most two more fit: pairs (a >= b) compete with ``one`` alone.
            spare = {big: 1, one: 1} if one != big else {big: 2}
            second = largest_upto(room - one, spare)
            # The smaller piece of any pair is at most this.
            half = largest_upto(room // 2, spare)
            if second and second >= half:
                fix([big, one, second])
                continue
            if one >= best_pair(sizes, left, big, room):
                fix([big, one])
                continue
        done.add(big)


def best_pair(sizes: list[int], left: dict[int, int], big: int, room: int) -> int:
    """Largest sum <= room of two pieces other than one of ``big``; 0 if no pair fits."""
    have = lambda s: left[s] - (s == big)
    usable = [s for s in sizes if s <= room and have(s) > 0]
    lo, hi, best = 0, len(usable) - 1, 0
    while lo <= hi:
        total = usable[lo] + usable[hi]
        if total > room or lo == hi and have(usable[lo]) < 2:
            hi -= 1
        else:
            best = max(best, total)
            lo += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: like pieces and like sequences move together."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # room -> [(pieces, sequences)]
    rooms: list[int] = []

    def put(room: int, pieces: tuple[tuple[int, int], ...], n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((pieces, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        # Filled sequences may have room for no more of this size, so rooms only ever get smaller.
        while n and (k := bisect_left(rooms, size)) < len(rooms):
            room = rooms[k]
            pieces, m = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            each = room // size
            full = min(m, n // each)
            put(room - each * size, (*pieces, (size, each)), full)
            n -= full * each
            m -= full
            if m and n < each and n:
                put(room - n * size, (*pieces, (size, n)), 1)
                n, m = 0, m - 1
            put(room, pieces, m)
        each = capacity // size
        put(capacity - each * size, ((size, each),), n // each)
        if n % each:
            put(capacity - n % each * size, ((size, n % each),), 1)
    return [p for found in open_.values() for p in found]


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every piece of ``counts`` (length -> pieces; lengths 1 to capacity)."""
    fixed, rest = reduce(counts, capacity)
    return fixed + best_fit(rest, capacity)


def pieces(docs: DataFrame, path: str, end_id: int, mode: str = "leading", capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key``, piece, start, length, ids_crc32 (and ids): a document's ids with the end id, cut into
    pieces of ``capacity`` tokens where it is longer; the first piece takes what is left over."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = with_end(*worker_tokenizer(path, mode).flat(batch.column(text)), end_id)
        row, piece, start, end = cut(np.diff(at), capacity)
        data = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
        bounds = ((at[:-1][row] + start) * 4).tolist(), ((at[:-1][row] + end) * 4).tolist()
        crc = [zlib.crc32(data[a:b]) for a, b in zip(*bounds)]
        columns = [batch.column(key).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array((end - start).astype(np.int32)), pa.array(crc, pa.int64())]
        ids = [pa.array([bytes(data[a:b]) for a, b in zip(*bounds)], pa.binary())] if with_ids else []
        return pa.RecordBatch.from_arrays(columns + ids, names=[key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return map_arrow(docs.select(key, text), run, schema, text, size=4 << 20, keep=True)


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, piece number, start and end (in ids of the document) of every piece: ``capacity``
    ids each but for the first, which takes what is left over."""
    pieces_of = -(-lengths // capacity)
    row = np.repeat(np.arange(len(lengths)), pieces_of)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
    end = (lengths[row] - 1) % capacity + 1 + piece * capacity
    return row, piece, np.maximum(end - capacity, 0), end


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, each, sequence, offset, last) for every pattern and length in it: pieces
    ``first`` .. ``last`` of that length fill sequences from ``sequence`` on, ``each`` to one."""
    out, used, sequence = [], {}, 0
    for held, times in patterns:
        offset = 0
        for length, each in held:
            first = used.get(length, 0)
            used[length] = first + each * times
            out.append((length, first, each, sequence, offset, used[length] - 1))
            offset += length * each
        sequence += times
    return out


def assign(found: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to rows of ``pieces`` (which should be a stored table)."""
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}
    patterns = pack(counts, capacity)
    salts = F.create_map(*[F.lit(x) for k, n in counts.items() if n > PER_TASK for x in (k, -(-n // PER_TASK))]) if any(n > PER_TASK for n in counts.values()) else None
    salt = F.lit(0) if salts is None else F.pmod(F.xxhash64(key, "piece"), F.coalesce(salts[F.col("length")], F.lit(1))).cast("int")
    salted = found.withColumn("salt", salt)
    before = salted.groupBy("length", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    numbered = salted.withColumn("n", F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.col(key).asc_nulls_first(), "piece", "ids_crc32")) - 1)
    ranked = numbered.join(before, ["length", "salt"]).withColumn("rank", F.col("n") + F.col("before")).drop("n", "before", "salt")
    return place(ranked, slots(patterns))


def place(ranked: DataFrame, rows: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Find each piece's slot by binary search among those of its length, in Arrow batches."""
    lists: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for length, first, each, sequence, offset, last in rows:
        lists.setdefault(length, []).append((last, first, each, sequence, offset))
    # Bounded by the capacity, whatever the size of the corpus.
    shared = ranked.sparkSession.sparkContext.broadcast({k: np.array(sorted(v), dtype=np.int64) for k, v in lists.items()})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            slot = shared.value[int(size)]
            s = slot[np.searchsorted(slot[:, 0], rank[own])]
            within = rank[own] - s[:, 1]
            sequence[own] = s[:, 3] + within // s[:, 2]
            offset[own] = s[:, 4] + within % s[:, 2] * int(size)
        at = batch.schema.get_field_index("rank")
        return batch.remove_column(at).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return map_arrow(ranked, run, schema + ", sequence_id long, offset long", rows=1 << 16)


def packed(docs: DataFrame, path: str, end_id: int, mode: str = "leading", capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key``, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return assign(materialize(pieces(docs, path, end_id, mode, capacity, key, text, with_ids), "pieces"), capacity, key)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0)
    return found.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
