"""Word-cached encoding with tokenizers of the ``tokenizers`` library.

Real text repeats its words, and the library spends nearly all its time on merging words it has
merged before. A text is cut at places where the tokenizer's own splitter always cuts, and each
piece is a word of letters with the marks after it. Every distinct piece goes through the library
once, and a document's ids are the joined ids of its pieces. Splitting, finding distinct pieces,
looking them up and putting ids together are array operations; Python sees new pieces only.

Texts that hold the string of an added token (like ``<|endoftext|>``) go to the library whole, so
they get whatever the library gives them. ``tests/llm`` compares whole texts with the library's
own result.
"""

from __future__ import annotations

import os
import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: Bytes of pieces and of their ids that one worker remembers, and the share of them, first seen
#: first (the frequent ones), that it keeps when they are reached. Results do not depend on either.
CACHE_BYTES, CACHE_KEPT = 24 << 20, 0.4
#: Never part of a cut text: marks the cuts. Texts that hold it are cut by plain Python.
CUT = "\x1f"
#: Strings given to the library at once.
BATCH = 8192
#: A run of these after a word of letters is always split from it, and not further by the splitter.
MARKS = string.punctuation


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[starts[0] : starts[0] + lengths[0]]``, then those of 1, and so on, in one array."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return values[:0]
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.ones(total, kind)
    some = lengths > 0
    first, n = starts[some], lengths[some]
    at[0] = first[0]
    at[np.cumsum(n)[:-1]] = first[1:] - (first[:-1] + n[:-1] - 1)
    return values[np.cumsum(at, dtype=kind)]


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.StringArray:
    """Strings of ``lengths`` bytes that lie one after another in ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def tails(whole: pa.StringArray, head: pa.StringArray) -> pa.StringArray:
    """What follows ``head`` in each string that begins with it."""
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    cut = pc.binary_length(head).to_numpy().astype(np.int64)
    lengths = np.diff(offsets) - cut
    return strings(gather(data, offsets[:-1] + cut, lengths), lengths)


def chunks_of(text: str) -> list[str]:
    """Chunks of a text for a splitter that lets one space lead a token: cuts at spaces and line ends."""
    out: list[str] = []
    lines = text.split("\n")
    run = -1  # line ends since the last line with text
    for k, line in enumerate(lines):
        run += 1
        if not line and k + 1 < len(lines):
            continue
        if run:
            # Before other text the last line end of a run stands alone; else the run is one.
            if run > 1 and line and line[0] != " ":
                out.append("\n" * (run - 1))
                run = 1
            out.append("\n" * run)
            run = 0
        first, *rest = line.split(" ")
        out.append(first)
        out += [" " + x for x in rest]
    return out


def stands_alone(chunk: str) -> bool:
    """Whether such a chunk is split by itself as it is inside any text."""
    if not chunk.strip("\n"):
        return True
    return not (chunk[-1].isspace() or chunk[chunk[0] == " "].isspace())


class PieceCache:
    """Ids of texts by way of their distinct pieces. Subclasses say how new pieces and whole texts
    are encoded.

    ``leading``: one space may lead a piece, and a cut is a space or a line end between two other
    characters; a text with other runs of white space is cut by rules of its own or encoded whole.
    Else any ASCII white space is a cut and belongs to no piece, and words of ASCII letters are the
    same in any case. Texts that match ``added`` are encoded whole.
    """

    def __init__(self, leading: bool, added: str | None = None):
        self.leading, self.added = leading, added
        self._forget()

    def _encode(self, new: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, each by itself, and how many each has."""
        raise NotImplementedError

    def _whole(self, text: str) -> np.ndarray:
        """Ids of one text as it stands."""
        raise NotImplementedError

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = np.empty(0, "<u4")
        self.lengths = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)

    def _room(self) -> None:
        """Forget all but the pieces seen first where there are too many bytes of them."""
        if self.known.nbytes + self.ids.nbytes + 16 * len(self.known) > CACHE_BYTES:
            n = int(len(self.known) * CACHE_KEPT)
            used = int(self.lengths[:n].sum())
            self.known = pa.concat_arrays([self.known.slice(0, n)])
            self.ids, self.lengths, self.starts = self.ids[:used].copy(), self.lengths[:n].copy(), self.starts[:n].copy()

    def _unspaced(self, pieces: pa.StringArray) -> pa.StringArray:
        """Without the one space that may lead a piece."""
        return pc.if_else(pc.starts_with(pieces, " "), pc.utf8_slice_codeunits(pieces, 1), pieces) if self.leading else pieces

    def _of_letters(self, pieces: pa.StringArray) -> pa.BooleanArray:
        letters = pc.utf8_is_alpha(self._unspaced(pieces))
        # The one letter that becomes two characters, not both letters, in lower case.
        return letters if self.leading else pc.and_not(letters, pc.match_substring(pieces, "İ"))

    def _places(self, pieces: pa.StringArray) -> np.ndarray:
        """Row of each piece in what is remembered; new ones are encoded first."""
        coded = pc.dictionary_encode(pieces)
        distinct = coded.dictionary
        at = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = distinct.take(pa.array(missing))
            ids, lengths = self._encode(new)
            at[missing] = len(self.known) + np.arange(len(missing))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
            self.known = pa.concat_arrays([self.known, new])
        return at[coded.indices.to_numpy()]

    def _cut_up(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """For distinct chunks: the remembered rows of the word and of the marks after it (two for a
        chunk), and whether the chunk can be encoded apart from its text at all."""
        self._room()
        base = pc.utf8_rtrim(chunks, characters=MARKS)
        letters = self._of_letters(base)
        apart = np.ones(len(chunks), bool)
        if self.leading:
            for k in np.flatnonzero(~letters.to_numpy(zero_copy_only=False)):
                apart[k] = stands_alone(chunks[int(k)].as_py())
            plain = base
        else:
            plain = pc.if_else(pc.string_is_ascii(base), pc.ascii_lower(base), base)
        words = pc.if_else(letters, plain, pc.if_else(pa.array(apart), chunks, ""))
        marks = pc.if_else(letters, tails(chunks, base), "")
        both = self._places(pa.concat_arrays([words, marks]))
        return np.stack([both[: len(chunks)], both[len(chunks) :]], axis=1), apart

    def _split(self, texts: pa.Array) -> pa.ListArray:
        if not self.leading:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        cut = pc.replace_substring(pc.replace_substring(texts, " ", CUT + " "), "\n", CUT + "\n" + CUT)
        return pc.split_pattern(cut, CUT)

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Texts not to be cut by array operations: those in which spaces and line ends touch, and
        those with added tokens."""
        odd = np.zeros(len(texts), bool)
        if self.leading:
            odd |= pc.match_substring_regex(texts, r"[ \n][ \n]|\x1f|[ \n]\z").to_numpy(zero_copy_only=False)
        return odd | self._special(texts)

    def _special(self, texts: pa.Array) -> np.ndarray:
        return pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (null: empty), and where each text's begin and the last end."""
        texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        odd = self._odd(texts)
        split = self._split(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        coded = pc.dictionary_encode(split.flatten())
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        del split
        pairs, apart = self._cut_up(coded.dictionary)
        indices = coded.indices.to_numpy()
        if not apart.all():
            held_in = np.repeat(np.arange(len(texts)), np.diff(bounds))
            odd[held_in[~apart[indices]]] = True
        at = pairs[indices].ravel()
        lengths = self.lengths[at]
        ids = gather(self.ids, self.starts[at], lengths)
        sums = np.concatenate([[0], np.cumsum(lengths)])[2 * bounds]
        if not odd.any():
            return ids, sums
        parts = [ids[sums[k] : sums[k + 1]] for k in range(len(texts))]
        for k in np.flatnonzero(odd):
            parts[k] = self._odd_text(texts[int(k)].as_py())
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _odd_text(self, text: str) -> np.ndarray:
        if not self.leading or self.added and re.search(self.added, text):
            return self._whole(text)
        coded = pc.dictionary_encode(pa.array(chunks_of(text), pa.string()))
        pairs, apart = self._cut_up(coded.dictionary)
        if not apart.all():
            return self._whole(text)
        at = pairs[coded.indices.to_numpy()].ravel()
        return gather(self.ids, self.starts[at], self.lengths[at])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, at = self.flat(pa.array(texts, pa.string()))
        data, at = ids.tobytes(), (at * 4).tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]


class WordCachedTokenizer(PieceCache):
    """``mode`` "dropped": white space never belongs to a token, letters are lower-cased, and the
    last token of each word ends in ``</w>``. ``mode`` "leading": one space may lead a token
    (byte-level splitters, that token starts with ``Ġ``).
    """

    def __init__(self, path: str, mode: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # Added tokens may be looked for in normalized text, so case is left open.
        super().__init__(mode == "leading", f"(?i){'|'.join(added)}" if added else None)
        vocabulary = self.tokenizer.get_vocab()
        self.bound = np.zeros(max(vocabulary.values()) + 1, bool)
        self.bound[[i for token, i in vocabulary.items() if (token.startswith("Ġ") if self.leading else token.endswith("</w>"))]] = True
        self.line_end = vocabulary.get("Ċ")

    def _whole(self, text: str) -> np.ndarray:
        return self._library([text])[0]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        ids, lengths = [], []
        for at in range(0, len(texts), BATCH):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + BATCH], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), "<u4"))
        return np.concatenate([np.empty(0, "<u4"), *ids]), np.concatenate([np.empty(0, np.int64), *lengths])

    def _words(self, words: list[str], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only: many go to the library in one string, cut apart by their bounds.
        ``bare``: words of a "leading" tokenizer without a space before them, joined by line ends."""
        ids, lengths = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        between = "\n" if bare else "" if self.leading else " "
        for at in range(0, len(words), BATCH):
            part = words[at : at + BATCH]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([between.join(part[k : k + 64]) for k in range(0, len(part), 64)], add_special_tokens=False)]
            if bare:
                found = [[*x, self.line_end] for x in found]
            flat = np.fromiter(chain.from_iterable(found), "<u4")
            if bare:
                bounds = np.flatnonzero(flat == self.line_end)
                ends = bounds - np.arange(len(bounds))
                flat = np.delete(flat, bounds)
            else:
                bounds = np.flatnonzero(self.bound[flat])
                ends = np.append(bounds[1:], len(flat)) if self.leading else bounds + 1
            own = np.diff(ends, prepend=0)
            if len(own) != len(part):
                flat, own = self._library(part)
            ids.append(flat)
            lengths.append(own)
        return np.concatenate(ids), np.concatenate(lengths)

    def _encode(self, new: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, each by itself, and how many each has."""
        letters = self._of_letters(new).to_numpy(zero_copy_only=False)
        first = (pc.starts_with(new, " ") if self.leading else pc.string_is_ascii(new)).to_numpy(zero_copy_only=False)
        parts: list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]] = []

        def add(rows: np.ndarray, f, **more) -> None:
            at = np.flatnonzero(rows)
            parts.append((at, f(new.take(pa.array(at)).to_pylist(), **more)))

        if self.leading:
            add(letters & first, self._words)
            add(letters & ~first, self._words, bare=True)
        else:
            # On words of ASCII letters in lower case the normalizer does nothing.
            normalizer, self.tokenizer.normalizer = self.tokenizer.normalizer, None
            try:
                add(letters & first, self._words)
            finally:
                self.tokenizer.normalizer = normalizer
            add(letters & ~first, self._words)
        add(~letters, self._library)
        lengths = np.zeros(len(new), np.int64)
        starts = np.zeros(len(new), np.int64)
        used = 0
        for at, (_, own) in parts:
            lengths[at] = own
            starts[at] = used + np.cumsum(own) - own
            used += int(own.sum())
        return gather(np.concatenate([x for _, (x, _) in parts]), starts, lengths), lengths


def with_end(flat: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each text's ids: the new ids and bounds."""
    return np.insert(flat, at[1:], end_id), at + np.arange(len(at))


def worker_tokenizer(path: str, mode: str) -> WordCachedTokenizer:
    """One per Python worker, kept from task to task."""
    return held(("tokenizer", path, mode), lambda: WordCachedTokenizer(path, mode))


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; callers may pass any other path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)
