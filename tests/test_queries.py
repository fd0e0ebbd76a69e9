"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline"))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    assert rows == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_entry(spark):
    assert entry.entry(spark).columns == ["uri", "depth", "edge_kind", "confidence", "via"]


def test_import_without_the_optional_subpackage(tmp_path):
    """The rest imports and registers its queries where the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/stratagraph", tmp_path / "stratagraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and not any(n.startswith('op') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
