"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra
columns with clashing names: every operator has a defined result for each."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import ann, bpe, langid, ngram_join, packing, pii, quality_classifier, quality_rules, records, url_filter
from stratagraph.llm.common import fresh_dir
from stratagraph.llm.tokens import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word another third " * 40_000
PROSE = "the quick brown fox jumps over the lazy dog and runs away from every other animal it meets on the road "
ROWS = [
    (1, "Hello world this is text", "en", "a", 24),
    (2, None, "en", None, None),
    (3, "", None, "a", 0),
    (4, LONG, "en", "a", len(LONG)),
    (5, "Hello world this is text", "en", "a", 24),
    (5, "Hello world this is text", "en", "a", 24),
    (None, "Hello world this is text", None, None, None),
    (7, "   \n\t ", "fr", "b", 6),
    (8, "é \U0001f600 x@y.zz 日本", "fr", "b", 12),
    (9, "Word", "en", "b", 4),
    (10, PROSE * 4, "en", "b", 0),
]
#: Names operators use inside.
CLASH = ["score", "length", "sig", "rank", "kept", "row", "ids", "start", "component", "list", "n", "at", "salt", "spans", "bucket", "label", "piece", "node", "part"]


@pytest.fixture(scope="module")
def docs(spark):
    found = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        found = found.withColumn(c, F.lit("clash"))
    return found.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return sorted(([r["doc_id"], *(r[c] for c in columns)] for r in df.collect()), key=repr)


def test_join(docs, empty):
    got = by_id(ngram_join.join(docs, 3, 90), "n_shingles", "component_id")
    want = [[1, 3, 1], [2, 0, 2], [3, 0, 3], [4, 3, 4], [5, 3, 1], [5, 3, 1], [None, 3, None], [7, 0, 7], [8, 2, 8], [9, 1, 9], [10, 21, 10]]
    assert got == sorted(want, key=repr)
    assert ngram_join.join(empty, 3, 90).count() == 0
    kept = by_id(ngram_join.keep_one(docs), "text")
    assert [r[0] for r in kept] == [1, 10, 2, 3, 4, 7, 8, 9, None] and ngram_join.keep_one(docs).columns == docs.columns
    assert ngram_join.keep_one(empty).count() == 0


def test_quality_rules(docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert (got[2]["n_words"], got[2]["base_failed"], got[2]["kept"]) == (0, True, False)
    assert got[4]["n_words"] == 120_000 and got[4]["n_repeat_words"] == 120_000 and got[4]["base_failed"]
    assert got[10]["n_words"] == 84 and got[10]["n_repeat_words"] == 84
    assert quality_rules.judge(docs).count() == len(ROWS) and quality_rules.judge(empty).count() == 0


def test_classifier(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.train(docs, labels) is None
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.score(docs, None).collect()}
    assert got[1] and not got[2] and not got[3] and not got[7]
    assert quality_classifier.score(empty, None).count() == 0
    good = [(k, PROSE * (1 + k % 3) + str(k), "en", "a", 100) for k in range(60)]
    bad = [(100 + k, "### *** %%% " * (5 + k % 7), "en", "b", 100) for k in range(60)]
    both = spark.createDataFrame(good + bad + ROWS, SCHEMA)
    labels = spark.createDataFrame([(k, 1) for k in range(0, 60, 2)] + [(100 + k, 0) for k in range(0, 60, 2)] + [(0, 1), (3, None)], "doc_id long, quality int")
    model = quality_classifier.train(both, labels)
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.score(both, model).collect()}
    assert all(got[k] for k in range(11, 60)) and not any(got[100 + k] for k in range(60))
    assert quality_classifier.keep_good(both, model).columns == both.columns


def test_nearest(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0]), (9, [0.0, 1.0]), (50, [2.0, 0.0]), (100, [0.0, 0.0]), (10, [1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit("x")).withColumn("score", F.lit(1))
    got = sorted(map(tuple, ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect()))
    assert got == [(50, 1, 1, 1.0), (50, 2, 2, 1.0), (50, 3, 8, 1.0), (50, 4, 8, 1.0), (50, 5, 9, 0.0)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, none, 5).count() == 0


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 64)
    rng = np.random.default_rng(1)
    m = np.repeat(rng.normal(size=(150, 16)), 3, axis=0).astype(np.float32)
    m[::3] += rng.normal(size=m[::3].shape).astype(np.float32) * 1e-3
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(5)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(vectors, vectors.filter("vec_id % 10 = 0"), 7).collect()}
    d = m.astype(float)
    norm = np.sqrt((d * d).sum(axis=1))
    for q in range(0, len(m), 10):
        s = (d * d[q]).sum(axis=1) / (norm * norm[q])
        s[q] = -9
        want = np.lexsort((np.arange(len(m)), -s))[:7]
        assert [got[q, k + 1] for k in range(7)] == want.tolist()


def test_urls(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://Sub.Example.NET/x?q", "<link rel='canonical' href='https://alias.org/a'>"),
            (2, "https://alias.org/a#frag", None),
            (3, "http://third.org/b", '<meta http-equiv="refresh" content="0; URL=http://alias.org/a">'),
            (4, None, "<html>"),
            (5, "no scheme", ""),
            (6, "http://", None),
            (7, "http://example.net/en/page", "<LINK href=/x REL=canonical>"),
            (8, "http://example.net/x", None),
            (9, "http://free.org/fr/", "<link rel=canonical href=http://other.com/z>"),
            (10, "http://other.com/z", "<link rel=canonical href='http://bad.net/'>"),
            (11, "http://bad.net/", None),
            (1, "http://Sub.Example.NET/x?q", None),
        ],
        "page_id long, url string, html string",
    ).withColumn("node", F.lit(1))
    got = [tuple(r) for r in url_filter.judge(pages, url_filter.RULES).collect()]
    verdicts = {(r[0], r[3], r[4], r[5]) for r in got}
    assert len(got) == 12 and (1, "sub.example.net", "/x", "net/", "block", "rule") in got
    assert {(2, None, "block", "alias"), (3, None, "block", "alias"), (4, None, "allow", "none"), (5, None, "allow", "none"), (6, None, "allow", "none")} <= verdicts
    assert (7, "example.net/en/", "allow", "rule") in verdicts and (8, "net/", "block", "rule") in verdicts
    # An explicitly allowed member keeps its component open; ruled pages keep their rule.
    assert {(9, "org/fr/", "allow", "rule"), (10, None, "allow", "none"), (11, "net/", "block", "rule")} <= verdicts
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0


def test_pii(docs, empty):
    got = {r["doc_id"]: r for r in pii.digest(docs).collect()}
    assert got[8]["spans"] == "email:4:10" and got[8]["base_sha256"] == hashlib.sha256(b"email:4:10").hexdigest()
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert clean[8] == "é \U0001f600 <EMAIL> 日本" and clean[2] is None
    assert pii.find(empty).count() == 0 and pii.redacted(docs).columns == docs.columns


def test_records(spark, docs, empty):
    path = fresh_dir(spark, "test")
    tokens = records.tokenize(docs, vocabulary("word_bpe_49k.json"), 1, "dropped")
    written = records.write_shards(tokens, path, records.shard_bounds(docs, 3))
    rows = sorted(records.read_back(written, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 7, 8, 9, 10]
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"] and r["ids_crc32"] == zlib.crc32(r["ids"]) and r["ids"][-4:] == b"\1\0\0\0"
        at += r["n_tokens"]
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 7)] == [1, 1, 1]
    # Shuffled reads by the index, and damage is noticed.
    some = list(records.read_records(path, 0, [1, 0]))
    assert [k for k, _, _ in some] == [1, 0]
    framed = bytearray(records.frame(b"abcdefgh"))
    assert records.unframe(bytes(framed)) == (b"abcdefgh", len(framed))
    for k in range(len(framed)):
        broken = bytearray(framed)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))
    nothing = records.write_shards(records.tokenize(empty, vocabulary("word_bpe_49k.json"), 1, "dropped"), path + "-empty", records.shard_bounds(empty, 3))
    assert records.read_back(nothing, path).count() == 0


def test_language(spark, docs, empty):
    english, french = PROSE, "le renard brun saute par dessus le chien paresseux et il court encore sur la route avec ses amis "
    rows = [(k, (english if k % 2 else french) * 3, "en" if k % 2 else "fr", None, None) for k in range(20)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert got[2] == ("und", 0.0) and got[3] == ("und", 0.0) and got[7] == ("und", 0.0) and got[10][0] == "en" and got[10][1] > 0.9
    mixed = spark.createDataFrame([(1, english + "\n" + french)], "doc_id long, text string")
    spans = langid.label_spans(mixed, model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "fr"] and abs(spans[0]["end"] - len(english)) < 8
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(empty)).collect()} == {"und"}
    assert langid.keep_named(docs, model).columns == docs.columns


def test_byte_bpe(docs, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = {r["doc_id"]: r for r in bpe.round_trip_digest(docs, path, P.PATTERN).collect()}
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    for k, text, *_ in ROWS:
        assert got[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip_digest(empty, path, P.PATTERN).count() == 0
    assert {bytes(r["decoded"]).decode() for r in bpe.encode_documents(docs, path, P.PATTERN).collect()} == {t or "" for _, t, *_ in ROWS}


def test_packing(docs, empty):
    rows = packing.packed(docs, vocabulary("byte_bpe_50k.json"), 0, capacity=64, with_ids=True).collect()
    taken = {}
    for r in rows:
        assert 0 < r["length"] <= 64 and r["offset"] + r["length"] <= 64 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in taken.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
    assert sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 2) == [(0, 1)]
    assert sum(r["doc_id"] == 5 for r in rows) == 2
    assert packing.packed(empty, vocabulary("byte_bpe_50k.json"), 0).count() == 0
