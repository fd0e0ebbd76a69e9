"""The registered queries of the subpackage: those with SQL against DuckDB, all others against plain
versions of their contracts, over the whole smallest tables."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from stratagraph.llm import queries

from .test_join import plain as plain_join
from .test_pii import plain as plain_spans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages labels".split():
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return duck.sql("select doc_id, text from documents order by doc_id").fetchall()


def rows(spark, name):
    return queries.queries()[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(repr, want.select(*columns).fetchall()))


def test_op1(spark, texts):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op1_ngram_join")} == plain_join(texts, 3, 90)


def test_op4(spark, duck):
    ids, vectors = zip(*duck.sql("select vec_id, embedding from embeddings order by vec_id").fetchall())
    m = np.array(vectors, np.float64)
    norm = np.sqrt((m * m).sum(axis=1))
    want = {}
    for q in (k for k in ids if k % 50 == 0):
        i = ids.index(q)
        score = (m * m[i]).sum(axis=1) / (norm * norm[i])
        score[i] = -9
        for rank, j in enumerate(np.lexsort((np.array(ids), -score))[:5], 1):
            want[q, rank] = (ids[j], float(score[j]))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows(spark, "op4_nearest")}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_op6(spark, texts):
    got = {r["doc_id"]: r for r in rows(spark, "op6_pii")}
    for k, text in texts:
        spans = plain_spans(text or "")
        assert [got[k][f"n_{kind}"] for kind in ("email", "ip", "card", "phone")] == [sum(s[0] == kind for s in spans) for kind in ("email", "ip", "card", "phone")]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in spans).encode()).hexdigest()
        assert got[k]["n_spans"] == len([x for x in got[k]["spans"].split(",") if x]) >= len(spans)


def test_op7(spark, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got, at = {r["doc_id"]: r for r in rows(spark, "op7_token_records")}, 0
    for k, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op9(spark, texts):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in rows(spark, "op9_byte_bpe")}
    for k, text in texts:
        ids = library.encode_ordinary(text or "")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_op10(spark, texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, taken, total = {(r["doc_id"], r["piece"]): r for r in rows(spark, "op10_packing")}, {}, 0
    for k, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            r = got.pop((k, piece))
            assert (r["start"], r["length"], r["ids_crc32"]) == (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            taken.setdefault(r["sequence_id"], []).append((r["offset"], b - a))
    assert not got
    for held in taken.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 2048
    assert len(taken) <= -(-total // 2048) + 1


def test_op8_held_out(spark, duck):
    truth = dict(duck.sql("select doc_id, lang from documents where lang is not null and regexp_matches(text, '\\p{L}')").fetchall())
    got = rows(spark, "op8_language_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_op3_agrees_with_labels(spark, duck):
    truth = dict(duck.sql("select doc_id, min(quality) from labels where quality is not null group by 1 having count(distinct quality) = 1").fetchall())
    got = rows(spark, "op3_quality_classifier")
    known = [r for r in got if r["doc_id"] in truth]
    assert sum(r["kept"] == bool(truth[r["doc_id"]]) for r in known) >= 0.95 * len(known)
    assert all(r["kept"] == (r["score"] >= 0.5) for r in got)


def test_planted_personal_data_is_found(spark, duck):
    """Recall over the documents that hold, by plain patterns, data of any kind."""
    planted = {r[0] for r in duck.sql(r"select doc_id from documents where regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]{2,}|AKIA[0-9A-Z]{16}|gh[po]_[0-9A-Za-z]{36}|\b[A-Z]{2}[0-9]{2}( [A-Z0-9]{4}){3,}|\+[0-9][0-9 ().-]{7,}[0-9]')").fetchall()}
    found = {r["doc_id"] for r in rows(spark, "op6_pii") if r["n_spans"]}
    assert not planted or len(planted & found) >= 0.95 * len(planted)
