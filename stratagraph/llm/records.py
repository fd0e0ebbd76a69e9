"""Length-delimited binary records of token ids (operator 7).

A shard file is a run of frames; a frame is

    length      unsigned 64-bit, little-endian
    check       masked CRC-32 of those 8 bytes, unsigned 32-bit
    data        ``length`` bytes: token ids, unsigned little-endian of 2 or 4 bytes each
                (``id_width`` chooses by the vocabulary's size)
    check       masked CRC-32 of the data, unsigned 32-bit

Beside each shard stands its offset index, one 24-byte entry a record: byte place of the frame,
ids in all earlier records of the shard, length in ids (three unsigned 64-bit integers). It lets
a reader take records in any order with one seek each.

Shards hold documents in ascending order of the key over the whole data set (nulls first, ties by
the ids, repeated rows each a record). An empty table writes no shard; further columns are ignored
whatever their names; texts of any length are one record each. Files are written under a name of the task attempt and then renamed, so a repeated or
speculative attempt leaves the same file. A null text is an empty document: just the end id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import afresh, fresh_dir, map_arrow, materialize, shuffle_width, table, trim
from .tokens import vocabulary, with_end, worker_tokenizer

HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
ENTRY = np.dtype([("place", "<u8"), ("before", "<u8"), ("length", "<u8")])
#: Entries of the index and bytes of records a reader takes at a time.
READ_ENTRIES, READ_BYTES = 1 << 14, 4 << 20
#: Fixed value added to a rotated checksum, so that checksums of data holding checksums differ.
MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return length + TAIL.pack(masked(length)) + data + TAIL.pack(masked(data))


def unframe(buffer: bytes | memoryview, place: int = 0) -> tuple[bytes, int]:
    """The record at ``place`` and the place after it; raises ValueError on damage."""
    length, check = HEAD.unpack_from(buffer, place)
    if check != masked(bytes(buffer[place : place + 8])):
        raise ValueError(f"damaged length at byte {place}")
    start = place + HEAD.size
    data = bytes(buffer[start : start + length])
    if len(data) != length or TAIL.unpack_from(buffer, start + length)[0] != masked(data):
        raise ValueError(f"damaged record at byte {place}")
    return data, start + length + TAIL.size


def id_width(path: str) -> int:
    """Bytes an id of this vocabulary takes."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def tokenize(docs: DataFrame, path: str, end_id: int, mode: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, ids (binary, little-endian of ``id_width`` bytes, with the end id)."""
    width = id_width(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = with_end(*worker_tokenizer(path, mode).flat(batch.column(text)), end_id)
        data, places = flat.astype(f"<u{width}"), (at * width).astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(places), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(at), pa.int64()), ids], names=[key, "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"{key} {kind}, n_tokens long, ids binary", text, size=4 << 20, keep=True)


def shard_bounds(keys: DataFrame, shards: int, key: str = "doc_id") -> list[int]:
    """Keys that cut the key's range into about equal shards; reads the key column only."""
    if shards < 2:
        return []
    found = keys.agg(F.percentile_approx(key, [k / shards for k in range(1, shards)], 20 * shards)).first()[0]
    return sorted(set(found or []))


def shard_of(key: str, bounds: list[int]) -> Column:
    """Shard number of a key: how many bounds it exceeds; nulls go to the first."""
    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) > bounds[mid], below(mid + 1, hi)).otherwise(below(lo, mid))

    return below(0, len(bounds))


def write_shards(tokens: DataFrame, path: str, bounds: list[int], key: str = "doc_id") -> DataFrame:
    """Write ``tokens`` (``key``, ids) as shards under ``path`` (any URI pyarrow can open).

    Returns the manifest, one row a record: ``key``, shard, record (its number there), n_tokens.
    """
    kind = tokens.schema[key].dataType.simpleString()
    shards = len(bounds) + 1
    # Each record names its shard, so the range shuffle samples keys alone and tokenizes once.
    named = tokens.select(key, "n_tokens", "ids", shard_of(key, bounds).alias("to"))
    ordered = named.repartitionById(shards, F.col("to")).drop("to").sortWithinPartitions(F.col(key).asc_nulls_first(), "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        afresh()
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, root = pafs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        name, place, before, records = f"{root}/shard-{shard:06d}", 0, 0, 0
        out = index = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out, index = files.open_output_stream(f"{name}.{attempt}.tmp"), files.open_output_stream(f"{name}.{attempt}.idx.tmp")
            data, lengths = batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist()
            entries = np.empty(len(data), ENTRY)
            for k, x in enumerate(data):
                framed = frame(x)
                entries[k] = place, before, lengths[k]
                out.write(framed)
                place, before = place + len(framed), before + lengths[k]
            index.write(entries.tobytes())
            records += len(data)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.full(len(data), shard), pa.int32()), pa.array(np.arange(records - len(data), records), pa.int64()), pa.array(entries["length"].astype(np.int64))], names=[key, "shard", "record", "n_tokens"])
        if out is not None:
            out.close()
            index.close()
            files.move(f"{name}.{attempt}.tmp", f"{name}.bin")
            files.move(f"{name}.{attempt}.idx.tmp", f"{name}.idx")

    return materialize(ordered.mapInArrow(write, f"{key} {kind}, shard int, record long, n_tokens long"), "records")


def shard_starts(written: DataFrame) -> dict[int, int]:
    """Ids in all shards before each one. The driver gets one row a shard, never a record."""
    rows = sorted(written.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    return dict(zip([r[0] for r in rows], [0, *accumulate(r[1] for r in rows)]))


class ShardReader:
    """Records of one shard in any order, by the offset index. Both files are opened once, and only
    the asked entries of the index are read; records that follow one another are read together."""

    def __init__(self, path: str, shard: int):
        files, root = pafs.FileSystem.from_uri(path)
        self.index, self.data = (files.open_input_file(f"{root}/shard-{shard:06d}.{kind}") for kind in ("idx", "bin"))
        self.count, self.size = self.index.size() // ENTRY.itemsize, self.data.size()

    def __enter__(self) -> ShardReader:
        return self

    def __exit__(self, *_) -> None:
        self.index.close()
        self.data.close()

    def run(self, first: int, last: int) -> Iterator[tuple[int, int, bytes]]:
        """Records ``first`` to ``last`` - 1: (record, ids before it in the shard, ids as unsigned
        32-bit little-endian bytes), about ``READ_BYTES`` of file at a time."""
        for low in range(first, last, READ_ENTRIES):
            high = min(last, low + READ_ENTRIES)
            entries = np.frombuffer(self.index.read_at((min(high + 1, self.count) - low) * ENTRY.itemsize, low * ENTRY.itemsize), ENTRY)
            places = entries["place"].astype(np.int64)
            if high == self.count:
                places = np.append(places, self.size)
            at = 0
            while at < high - low:
                to = max(at + 1, int(np.searchsorted(places, places[at] + READ_BYTES, side="right")) - 1)
                buffer = memoryview(self.data.read_at(int(places[to] - places[at]), int(places[at])))
                for k in range(at, to):
                    data, n = unframe(buffer, int(places[k] - places[at]))[0], int(entries["length"][k])
                    width = len(data) // n if n else 4
                    yield low + k, int(entries["before"][k]), np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
                at = to

    def records(self, wanted: Iterable[int]) -> Iterator[tuple[int, int, bytes]]:
        """``run`` for records in the order asked for."""
        asked = np.fromiter(wanted, np.int64)
        for part in np.split(asked, np.flatnonzero(np.diff(asked) != 1) + 1):
            if len(part):
                yield from self.run(int(part[0]), int(part[-1]) + 1)


def read_records(path: str, shard: int, records: list[int] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(record, ids before it in the shard, ids as unsigned 32-bit little-endian bytes) in the order
    asked for (all, if None), by the offset index."""
    with ShardReader(path, shard) as reader:
        yield from reader.records(range(reader.count) if records is None else records)


def read_back(written: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Read every record again from the files: ``key``, start, n_tokens, ids_crc32, ids.

    ``written`` is what ``write_shards`` returned; it says which key each record belongs to.
    A shard is opened once a batch and read in ranges, so each part of index and data is read once
    and memory stays bounded.
    """
    starts = shard_starts(written)
    kind = written.schema[key].dataType.simpleString()
    columns = [key, "start", "n_tokens", "ids_crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        for batch in batches:
            shards, records = batch.column("shard").to_numpy(), batch.column("record").to_numpy()
            for shard in np.unique(shards):
                rows = np.flatnonzero(shards == shard)
                with ShardReader(path, int(shard)) as reader:
                    found, held_bytes, at = [], 0, 0
                    for place, (_, before, data) in enumerate(reader.records(records[rows]), 1):
                        found.append((starts[int(shard)] + before, len(data) // 4, zlib.crc32(data), data))
                        held_bytes += len(data)
                        if held_bytes > READ_BYTES or place == len(rows):
                            own = [pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows[at:place])), *own], names=columns)
                            found, held_bytes, at = [], 0, place
        trim()

    return written.select(key, "shard", "record").mapInArrow(run, f"{key} {kind}, start long, n_tokens long, ids_crc32 long, ids binary")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word_bpe_49k ids with end id 1, written as shards in order of doc_id and read back."""
    path = fresh_dir(spark, "shards")
    docs = table(spark, sf_dir, "documents")
    tokens = tokenize(docs, vocabulary("word_bpe_49k.json"), 1, "dropped")
    written = write_shards(tokens, path, shard_bounds(docs, shuffle_width(spark)))
    return read_back(written, path).select("doc_id", "start", "n_tokens", "ids_crc32")
