"""Texts of documents agree with their SQL where a text is null or empty, and whatever the document's number."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
OTHERS = "region nation customer supplier part orders lineitem events embeddings".split()
TEXTS = ["plain", "", None, " ", "\n", "é" * 600, "x" * 1000, "x" * 1001, "a\u0301" * 900]
ODD = [*((k, t, "web") for k, t in enumerate(TEXTS)), (20, "no source", None), (None, "no number", "web"), (2**31 - 1, "large", "web"), (5 * 10**9, "larger", "web")]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", ["t03_head_text", "t06_embedding_text"])
def test_odd_documents(spark, tmp_path, name):
    spark.createDataFrame(ODD, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in OTHERS:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(entry.oracle_sql()[name])
    assert want.columns == got.columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want.fetchall()))
