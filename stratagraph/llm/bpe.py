"""Byte-level BPE by prefix dynamic programming (operator 9).

For every prefix of a byte string there is exactly one token that can end its encoding. Going
left to right, the token that ends prefix ``i`` is the one token ``t`` ending there whose
predecessor (the stored last token of prefix ``i - len(t)``) forms a pair with ``t`` that BPE
would leave unmerged. Storing the last token of every prefix therefore encodes in linear time,
lets text be appended exactly, and lets an edit be re-encoded from the edit onward only.

Nulls and empty texts encode to no tokens. Texts of any length are encoded whole. Rows are
independent: null ids, repeated rows and ties need no care, an empty table gives an empty result, and
further columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import held, map_arrow, table
from .tokens import PieceCache, gather, vocabulary

#: Pieces one worker remembers; beyond it the memory starts again.
CACHE_ENTRIES = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def laid_out(data: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values in one array, and start and length of each by its number."""
    length = np.zeros(max(data, default=-1) + 1, np.int64)
    length[list(data)] = [len(x) for x in data.values()]
    flat = b"".join(data[k] for k in sorted(data))
    return np.frombuffer(flat, np.uint8), np.cumsum(length) - length, length


class PrefixBPE(PieceCache):
    """Encoder of single pieces (what the splitting pattern matches) and whole texts."""

    def __init__(self, path: str, pattern: str):
        super().__init__(leading=True)
        self.ranks = load_ranks(path)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        white = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(white)
        self.valid: dict[int, bool] = {}
        self._derive()
        self.longest = max(map(len, self.ranks))
        self.pieces: dict[str, bytes] = {}
        # By id: its bytes, and its decimal digits with a comma.
        self.spelt = laid_out(self.bytes_of)
        self.numbered = laid_out({i: b"%d," % i for i in self.bytes_of})

    def _derive(self) -> None:
        """For each token the pair BPE merges last to make it; tokens BPE never makes have none."""
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        unreachable = set()
        for token, data in sorted(self.bytes_of.items()):
            if len(data) == 1:
                continue
            for cut in range(1, len(data)):
                a, b = self.ranks.get(data[:cut]), self.ranks.get(data[cut:])
                if a is not None and b is not None and a not in unreachable and b not in unreachable and max(a if cut > 1 else -1, b if len(data) - cut > 1 else -1) < token and self._unmerged(a, b):
                    self.halves[token] = (a, b)
                    self.merged[a, b] = token
                    break
            else:
                unreachable.add(token)
        self.valid.clear()
        self.automaton = ahocorasick.Automaton()
        for token, data in self.bytes_of.items():
            if token not in unreachable:
                self.automaton.add_word(data.decode("latin-1"), (token, len(data)))
        self.automaton.make_automaton()

    def _unmerged(self, left: int, right: int) -> bool:
        """Whether BPE, given the bytes of both tokens in a row, ends with exactly these two.

        Undo the merges nearest to the seam in reverse order of rank; a merge across the seam
        that would have come before the merge undone shows that BPE crosses the seam.
        """
        undone = 1 << 62  # rank of the last merge undone; merges across the seam must not be below
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < undone:
                return False
            split_left, split_right = self.halves.get(left), self.halves.get(right)
            if split_left is None and split_right is None:
                return True
            a = left if split_left is not None else -1
            b = right if split_right is not None else -1
            # Of two equal merges the left one is made first, so the right one is undone first.
            if a > b:
                undone, left = a, split_left[1]
            else:
                undone, right = b + 1, split_right[0]

    def last_tokens(self, data: bytes, before: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """(token, length) ending each prefix of ``data``; ``before`` holds those already known."""
        last = list(before or [])
        known = len(last)
        valid, seen = self.valid, -1
        start = max(0, known - self.longest)  # a token ending later begins after this
        for end, (token, size) in self.automaton.iter(data.decode("latin-1"), start):
            if end < known or end == seen:
                continue
            if size == end + 1:
                ok = True
            else:
                previous = last[end - size][0]
                key = previous << 32 | token
                ok = valid.get(key)
                if ok is None:
                    ok = valid[key] = self._unmerged(previous, token)
            if ok:
                last.append((token, size))
                seen = end
        return last

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return self.walk_back(self.last_tokens(data))

    @staticmethod
    def walk_back(last: list[tuple[int, int]]) -> list[int]:
        out, at = [], len(last)
        while at:
            token, size = last[at - 1]
            out.append(token)
            at -= size
        return out[::-1]

    def _piece(self, piece: str) -> bytes:
        if (found := self.pieces.get(piece)) is None:
            if len(self.pieces) > CACHE_ENTRIES:
                self.pieces.clear()
            if len(self.valid) > 2 * CACHE_ENTRIES:
                self.valid.clear()
            found = np.array(self.encode_piece(piece.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
            self.pieces[piece] = found
        return found

    def _spelling(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.pattern.findall(text)))

    def _whole(self, text: str) -> np.ndarray:
        return np.frombuffer(self._spelling(text), "<u4")

    def _encode(self, new: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self._spelling, new.to_pylist()))
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.flat(pa.array([text], pa.string()))[0].tobytes()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class AppendableEncoding:
    """The state of one piece under edits: the last token of every prefix.

    ``append`` extends it exactly; ``edit`` replaces bytes and recomputes from the edit onward,
    stopping as soon as the stored tokens of the old text fit again.
    """

    def __init__(self, encoder: PrefixBPE, data: bytes = b""):
        self.encoder, self.data = encoder, data
        self.last = encoder.last_tokens(data)

    def append(self, more: bytes) -> AppendableEncoding:
        self.data += more
        self.last = self.encoder.last_tokens(self.data, self.last)
        return self

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace ``data[start:end]``; returns how many prefixes were computed anew."""
        longest = self.encoder.longest
        tail, shift = self.last[end:], start + len(new)
        data = self.data[:start] + new + self.data[end:]
        last, at = self.last[:start], shift
        last = self.encoder.last_tokens(data[:at], last)
        agreed, done = 0, at - start
        # A token reaches back over at most ``longest`` bytes. Once so many prefixes in a row end
        # in the same token as before, and none of them reaches over the seam, the rest is equal.
        while at < len(data):
            step = min(len(data), at + longest)
            last = self.encoder.last_tokens(data[:step], last)
            for k in range(at, step):
                same = last[k] == tail[k - shift] and last[k][1] <= k - shift + 1
                agreed = agreed + 1 if same else 0
            done, at = done + step - at, step
            if agreed >= longest:
                last += tail[at - shift :]
                break
        self.data, self.last = data, last
        return done

    def ids(self) -> list[int]:
        return self.encoder.walk_back(self.last)


def worker_encoder(path: str, pattern: str) -> PrefixBPE:
    return held(("bpe", path, pattern), lambda: PrefixBPE(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids and decoded bytes of every text: ``key``, ids array<int>, decoded binary."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = worker_encoder(path, pattern)
        flat, at = encoder.flat(batch.column(text))
        ids = [flat[a:b].astype(np.int32) for a, b in zip(at, at[1:])]
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([encoder.decode(x.tolist()) for x in ids], pa.binary())], names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"{key} {kind}, ids array<int>, decoded binary", text, keep=True)


def round_trip_digest(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode and digest: ``key``, n_tokens, ids_sha256, decoded_sha256. No shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = worker_encoder(path, pattern)
        ids, at = encoder.flat(batch.column(text))
        digests = []
        for values, starts, lengths in (encoder.numbered, encoder.spelt):
            of = lengths[ids]
            data = memoryview(gather(values, starts[ids], of))
            digests.append((data, np.concatenate([[0], np.cumsum(of)])[at].tolist()))
        (numbers, n), (decoded, d) = digests
        of_ids = [hashlib.sha256(numbers[a : max(a, b - 1)]).hexdigest() for a, b in zip(n, n[1:])]
        of_text = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(d, d[1:])]
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(at), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(key, text), run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", text, keep=True)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digest(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def encode_iter(texts: Iterator[str], path: str, pattern: str) -> Iterator[list[int]]:
    """Driver-side convenience for small inputs."""
    encoder = worker_encoder(path, pattern)
    for t in texts:
        yield np.frombuffer(encoder.encode(t or ""), "<u4").tolist()
