"""Language of text and of its spans (operator 8).

A word's script (from fixed code point ranges) narrows the languages it can be in to those seen
in that script when learning. Each remaining language scores the word by its letter pairs and
triples. A Viterbi pass over the words of a text then finds the sequence of languages with the
best total, where every change of language costs ``switch_penalty``; its runs are the spans. A
document's language is the one with most letters, its score that language's share of letters.

Learning counts letter pairs and triples on the executors, over a sample of about
``rows_per_language`` rows of each language, taken by a hash of the key (all rows, where there
are fewer); the model has a fixed number of buckets for each language.

Rows with a null id are learned from and predicted like any other; repeated rows count each, and an
empty table gives an empty result and a model without languages, for which every text is ``und``.
Texts of any length are read whole; further columns are ignored (``keep_named``: kept) whatever their
names. The model takes 256 KB a language.

A text that is null or has no letter is ``und`` with score 0. Words in a script no language was
learned in favour no language. Ties go to the language first in alphabetical order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import afresh, held, map_arrow, slices, table

BUCKETS = 1 << 16
ROWS_PER_LANGUAGE = 1500
SWITCH_PENALTY = 12.0
CACHE_ENTRIES = 300_000
UND = "und"

# First code points of ranges, and the script each range is in ("" for others).
SCRIPT_RANGES = (
    (0x0000, ""), (0x0041, "Latin"), (0x0250, "Latin"), (0x02B0, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, ""), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, ""), (0x0E00, "Thai"), (0x0E80, ""), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, ""),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD800, ""),
    (0xF900, "Han"), (0xFB00, ""), (0x20000, "Han"), (0x30000, ""),
)
STARTS = np.array([a for a, _ in SCRIPT_RANGES], dtype=np.uint32)
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])

WORD = re.compile(r"[^\W\d_]+")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the letter pairs and triples of ``words``, the word each belongs to, and each
    word's script. Word ends take part as a letter of their own."""
    code = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = code == 10
    word = np.cumsum(ends) - 1
    pair = (code[:-1] * np.uint64(0x9E3779B1) + code[1:] * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D27D4EB4F)
    triple = (code[:-2] * np.uint64(0x27D4EB2F) + code[1:-1] * np.uint64(0x165667B1) + code[2:] * np.uint64(0x9E3779B9)) * np.uint64(0xD6E8FEB86659FD93)
    # A pair belongs to the word of its first place; one that starts at a word's end is the next word's first.
    keep = ~ends[1:-1]
    buckets = np.concatenate([(pair >> np.uint64(48))[:-1], (triple >> np.uint64(48))[keep]]).astype(np.int64) % BUCKETS
    owner = np.concatenate([word[:-2], word[:-2][keep]])
    first = code[np.flatnonzero(ends)[:-1] + 1].astype(np.uint32)
    return buckets, owner, SCRIPT_OF[np.searchsorted(STARTS, first, side="right") - 1]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages: log probabilities
    scripts: np.ndarray  # scripts x languages: whether the language is written so

    def score(self, words: list[str]) -> np.ndarray:
        """Words x languages. A row of zeros favours none; languages ruled out get -1e4."""
        if not words or not self.languages:
            return np.zeros((len(words), max(1, len(self.languages))), np.float32)
        buckets, owner, script = grams(words)
        out = np.empty((len(words), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, self.weights[buckets, k], len(words))
        out -= out.max(axis=1, keepdims=True)
        allowed = self.scripts[script]
        out[~allowed] = -1e4
        out[~allowed.any(axis=1)] = 0
        return out


def train(docs: DataFrame, language: str = "lang", key: str = "doc_id", text: str = "text", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from rows whose text and language are not null."""
    known = docs.select(key, language, text).dropna(subset=[language, text])
    counts = {r[0]: r[1] for r in known.groupBy(language).count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros((len(SCRIPTS), 1), bool))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows_per_language / counts[k]))])
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(8), F.when(F.col(key).isNull(), F.xxhash64(text))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.filter(draw < share[F.col(language)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        afresh()
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, text):
            for lang, t in zip(batch.column(language).to_pylist(), batch.column(text).to_pylist()):
                if words := WORD.findall(t.lower()):
                    buckets, _, script = grams(words)
                    own = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    own[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(script, minlength=len(SCRIPTS))
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])

    summed = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    place = {k: n for n, k in enumerate(languages)}
    total[summed.column("bucket").to_numpy(), [place[x] for x in summed.column("lang").to_pylist()]] = summed.column("n").to_numpy()
    grams_, scripts = total[:BUCKETS] + 0.05, total[BUCKETS:]
    return Model(languages, np.log(grams_ / grams_.sum(axis=0)).astype(np.float32), scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word. ``scores`` holds the words of all texts one after another,
    ``lengths`` the words of each. All texts advance together, a word at a time, longest first."""
    n, k = scores.shape
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), side="right")
    kind = np.min_scalar_type(-k)  # the smallest signed type that holds every language number
    came = np.empty((n, k), kind)  # the language before, for each language of a word
    now = np.zeros((len(sizes), k), np.float32)
    same = np.arange(k, dtype=kind)
    for t, m in enumerate(active):
        at = begin[:m] + t
        before = now[:m]
        best = before.argmax(axis=1)
        top = before[np.arange(m), best] - penalty
        stay = before >= top[:, None]
        came[at] = np.where(stay, same, best[:, None])
        fresh = np.where(stay, before, top[:, None]) + scores[at]
        now[:m] = fresh - fresh.max(axis=1, keepdims=True)
    out = np.empty(n, kind)
    state = now.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        out[at] = state[:m]
        state[:m] = came[at, state[:m]]
    return out


class Labeller:
    """Scores of distinct words, kept from batch to batch in one worker."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, max(1, len(model.languages))), np.float32)
        self.used = 0

    def of(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if len(self.place) + len(new) > CACHE_ENTRIES:
            self.place.clear()
            self.used = 0
            new = list(dict.fromkeys(words))
        if new:
            if self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.used], np.zeros((max(len(new), CACHE_ENTRIES // 4), self.rows.shape[1]), np.float32)])
            self.rows[self.used : self.used + len(new)] = self.model.score(new)
            self.place.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words, how many each text has, and the language number of every word."""
        split = [[w for w in found if w.isalpha() or any(map(str.isalpha, w))] if not t.isascii() else found for t, found in ((t, WORD.findall(t.lower())) for t in texts)]
        lengths = np.array([len(x) for x in split], np.int64)
        flat = [w for x in split for w in x]
        return split, lengths, viterbi(self.rows_of(flat), lengths, self.penalty)

    def rows_of(self, flat: list[str]) -> np.ndarray:
        at = self.of(flat)
        return self.rows[at]


def _labeller(model: Model, penalty: float) -> Labeller:
    mark = model.weights[:64].tobytes() + repr((model.languages, penalty, float(model.weights.sum()))).encode()
    return held(("languages", mark), lambda: Labeller(model, penalty))


def predict(docs: DataFrame, model: Model, switch_penalty: float = SWITCH_PENALTY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred, score for every row. Reads the text alone."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, score = judged(batch, model, switch_penalty, text)
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    return map_arrow(docs.select(key, text), run, f"{key} {kind}, lang_pred string, score double", text, size=4 << 20)


def judged(batch: pa.RecordBatch, model: Model, switch_penalty: float, text: str) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a batch."""
    labeller, names = _labeller(model, switch_penalty), model.languages or [UND]
    split, lengths, labels = labeller.label([t or "" for t in batch.column(text).to_pylist()])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    letters = np.fromiter((len(w) for x in split for w in x), np.int64, len(labels))
    share = np.bincount(doc * len(names) + labels, letters, len(lengths) * len(names)).reshape(-1, len(names))
    total, best = share.sum(axis=1), share.argmax(axis=1)
    score = share.max(axis=1) / np.maximum(total, 1) if model.languages else np.zeros(len(total))
    return [names[b] if n else UND for b, n in zip(best, total)], score


def keep_named(docs: DataFrame, model: Model, least: float = 0.5, switch_penalty: float = SWITCH_PENALTY, text: str = "text") -> DataFrame:
    """``docs`` without texts that are ``und`` or of which no language holds ``least`` of the letters."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, score = judged(batch, model, switch_penalty, text)
        return batch.filter(pa.array((np.array(found, object) != UND) & (score >= least), pa.bool_()))

    return map_arrow(docs, run, docs.schema, text, size=4 << 20)


def label_spans(docs: DataFrame, model: Model, switch_penalty: float = SWITCH_PENALTY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, spans array<struct<start, end, lang>>: runs of words in one language, in code points."""
    kind = docs.schema[key].dataType.simpleString()
    of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        labeller, out = _labeller(model, switch_penalty), []
        for t in batch.column(text).to_pylist():
            found = [m for m in WORD.finditer(t or "") if any(map(str.isalpha, m[0]))] if model.languages else []
            labels = viterbi(labeller.rows_of([m[0].lower() for m in found]), np.array([len(found)]), switch_penalty)
            spans: list[dict] = []
            for m, k in zip(found, labels):
                if spans and spans[-1]["lang"] == model.languages[k]:
                    spans[-1]["end"] = m.end()
                else:
                    spans.append({"start": m.start(), "end": m.end(), "lang": model.languages[k]})
            out.append(spans)
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, of)], names=[key, "spans"])

    return map_arrow(docs.select(key, text), run, f"{key} {kind}, spans array<struct<start int, end int, lang string>>", text)


def fold(key: str = "doc_id") -> Column:
    """The fold of a row; rows with a null id are in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4, F.lit(0))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold() != 2))
    return predict(docs, model).select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")
