"""Personal data by anchor expansion (operator 6).

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, ``://``, digits and words
that announce an identifier. Only there do small deterministic parsers run; they grow the match
to both sides, check it (parts of an address, Luhn, ISO 7064 mod 97, digit counts) and give its
bounds in code points. The parsers look at each character a bounded number of times, so texts of
any length are read whole in linear time.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``. The method adds ``credential`` (user and
password of a URL), ``iban``, ``ssn``, ``account`` and ``secret``, the last four only beside a cue
or under a check, so clean text stays clean. A null text is empty and has no spans; rows are
independent, so null ids, ties, repeated rows and empty tables need no care. Further columns are
ignored (``redacted``: kept) whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import held, map_arrow, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("credential", "iban", "ssn", "account", "secret")
KINDS = BASE + ADDED

# Cue words, each in lower case, with a capital, and in capitals.
SSN_CUES = ("ssn", "social security")
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "routing")
SECRET_CUES = ("AKIA", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "-----BEGIN ")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
USERINFO = re.compile(r"[^\s/?#@:]++:[^\s/?#@]++(?=@)")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"[^0-9\n]{0,20}?(?<![0-9])([0-9]{3}([- ]?)[0-9]{2}\2[0-9]{4})(?![0-9])")
ACCOUNT = re.compile(r"(?:\x20?(?:number|numéro|número|nummer|no\.?|nr\.?|id|#))?\x20?[:=#]?\x20?([0-9][0-9-]{4,18}[0-9])(?![0-9])", re.IGNORECASE)
SECRET = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[po]_[0-9A-Za-z]{36}(?![0-9A-Za-z])|github_pat_[0-9A-Za-z_]{22,}|xox[bp]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{24,}|-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for kind, cues in (("ssn", SSN_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.title(), cue.upper()}:
                found.add_word(form, (kind, len(form)))
    for cue in SECRET_CUES:
        found.add_word(cue, ("secret", len(cue)))
    found.make_automaton()
    return found


def digits_of(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def emails(text: str, ats: list[int]) -> Iterator[Span]:
    over = 0
    for at in ats:
        start = at
        while start > over and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            over = m.end()
            yield "email", start, over


def numbers(text: str, starts: list[int], pattern: re.Pattern, kind: str) -> Iterator[Span]:
    """Leftmost matches that do not overlap; those that fail their check are dropped for good."""
    over = 0
    for start in starts:
        if start >= over and (m := pattern.match(text, start)):
            over = m.end()
            if kind == "ip":
                good = all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.groups())
            elif kind == "card":
                good = 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)
            else:
                good = 8 <= len(digits_of(m[0])) <= 15
            if good:
                yield kind, start, over


def spans(text: str) -> list[Span]:
    """All spans of a text, by kind as in ``KINDS``, then start."""
    at: dict[str, list[int]] = {}
    for end, (kind, size) in held("cues", automaton).iter(text):
        at.setdefault(kind, []).append(end + 1 - size)
    if not at:
        return []
    digits = at.get("digit", [])
    runs = [i for k, i in enumerate(digits) if not k or digits[k - 1] != i - 1]
    found = [*emails(text, at.get("at", [])), *numbers(text, runs, IP, "ip"), *numbers(text, runs, CARD, "card"), *numbers(text, at.get("plus", []), PHONE, "phone")]
    added: set[Span] = set()
    for i in at.get("scheme", ()):
        if m := USERINFO.match(text, i + 3):
            added.add(("credential", m.start(), m.end()))
    for i in runs:
        if i >= 2 and text[i - 2 : i].isascii() and text[i - 2 : i].isupper() and (i == 2 or not text[i - 3].isalnum()) and (m := IBAN.match(text, i - 2)):
            if 15 <= len(bare := m[0].replace(" ", "")) <= 34 and mod97(bare):
                added.add(("iban", m.start(), m.end()))
    for kind, pattern in (("ssn", SSN), ("account", ACCOUNT)):
        for i in at.get(kind, ()):
            if i and text[i - 1].isalpha():
                continue  # in the middle of a word, whose run of letters is walked from its start if at all
            end = i
            while end < len(text) and (text[end].isalpha() or kind == "ssn" and text[end] == " " and end - i < 16):
                end += 1
            if m := pattern.match(text, end):
                added.add((kind, m.start(1), m.end(1)))
    over = 0
    for i in at.get("secret", ()):
        if i >= over and (m := SECRET.match(text, i)):
            over = m.end()
            added.add(("secret", i, over))
    order = {k: n for n, k in enumerate(KINDS)}
    return found + sorted(added, key=lambda s: (order[s[0]], s[1], s[2]))


def redact(text: str, found: list[Span]) -> str:
    """Replace every span by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in found):
        end = -end
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, spans array<struct<kind, start, end>> in code points, end exclusive."""
    kind = docs.schema[key].dataType.simpleString()
    of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t or "")] for t in batch.column(text).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, of)], names=[key, "spans"])

    return map_arrow(docs.select(key, text), run, f"{key} {kind}, spans array<struct<kind string, start int, end int>>", text)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind; null texts stay null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [None if t is None else redact(t, f) if (f := spans(t)) else t for t in batch.column(text).to_pylist()]
        place = batch.schema.get_field_index(text)
        return batch.set_column(place, pa.field(text, pa.string()), pa.array(new, pa.string()))

    return map_arrow(docs, run, docs.schema, text)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, SHA-256 of the base spans, all spans as one string, then counts of the
    added kinds and of all spans."""
    kind = docs.schema[key].dataType.simpleString()
    empty = hashlib.sha256(b"").hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, all_spans, total = {k: [] for k in KINDS}, [], [], []
        for t in batch.column(text).to_pylist():
            found = spans(t or "")
            base = [s for s in found if s[0] in BASE]
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in found))
            total.append(len(found))
            hashes.append(hashlib.sha256(written(base).encode()).hexdigest() if base else empty)
            all_spans.append(written(found))
        return pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(hashes, pa.string()), pa.array(all_spans, pa.string()), *(pa.array(counts[k], pa.int64()) for k in ADDED), pa.array(total, pa.int64())], names=[key, *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in ADDED), "n_spans"])

    return map_arrow(docs.select(key, text), run, f"{key} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, " + ", ".join(f"n_{k} long" for k in ADDED) + ", n_spans long", text)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
