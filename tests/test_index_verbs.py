"""The index followed over time: ignore files, settings, call sites, a watched folder, restarts."""

import json
import time

import pytest
from pyspark.sql import functions as F

from stratagraph import api
from stratagraph.core import SCHEMAS
from stratagraph.operators import link, search, traverse
from stratagraph.sources import config, envelope, files
from stratagraph.sources.catalog import Catalog, Pointer
from stratagraph.streaming import incremental


def test_ignore_files_of_the_tree(spark, tmp_path):
    root = tmp_path / "proj"
    for path, text in {
        ".gitignore": "gen/\n*.log\n", "gen/a.py": "x", "app/x.log": "x", "app/.gitignore": "!keep.log\n/only.py\n", "app/keep.log": "x", "app/only.py": "x",
        "app/sub/only.py": "x", "app/__init__.py": "x", "app/.cursorignore": "secret*\n", "app/secret.txt": "x", "secret.txt": "x", ".hidden/z.py": "x",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    walked = lambda **more: sorted(r["path"] for r in files.walk(spark, str(root), **more).collect())
    assert walked() == ["app/__init__.py", "app/keep.log", "app/sub/only.py", "secret.txt"]
    assert "gen/a.py" in walked(ignore_files=False) and walked(ignore="secret.txt\n") == ["app/__init__.py", "app/keep.log", "app/sub/only.py"]
    assert files.walk(spark, f"file://{root}").count() == 4


def test_settings_and_call_sites(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "src/main.py").write_text("import os as o\n\n\ndef main():\n    foo(1)\n    nothing()\n    return helper(2)\n")
    (root / "src/a.py").write_text("def foo(x):\n    return x\n")
    (root / "src/b.py").write_text("def foo(x):\n    return x\n\n\ndef helper(x):\n    return x\n")
    (root / "left.py").write_text("x = 1\n")
    config.write(config.default_path(str(root)), config.Config(repo="mine", include=["src/*"]))
    index = api.Index.open(spark, str(root))
    assert index.repo == "mine" and index.index(str(root)).collect()[0]["n"] == 3
    index.resolve(0.95)
    by_name = {r["name"]: r for r in index.references.collect()}
    assert by_name["nothing"]["is_external"] and not by_name["foo"]["is_external"] and not by_name["helper"]["is_external"]
    assert index.ambiguous_references.filter(F.col("reference_id") == by_name["foo"]["id"]).count() == 2
    assert {r["reference_id"] for r in index.callsite_embeddings.collect()} == {by_name["foo"]["id"], by_name["nothing"]["id"]}
    text = {r["id"]: r["text"] for r in api.callsites(index.references, index.symbols, index.imports).collect()}
    assert text[by_name["foo"]["id"]].startswith("Caller: main\nContext: def main():\n    foo(1)\n") and "Imports: os as o" in text[by_name["foo"]["id"]]
    assert tuple(index.stats().select("unresolved", "callsite_embeddings").first()) == (1, 2)
    assert json.loads(config.mcp_entry("run", ["serve"], '{"other": 1}')) == {"other": 1, "mcpServers": {"stratagraph": {"command": "run", "args": ["serve"]}}}


def test_search_falls_back_and_fills(spark):
    rows = [("codescope://r/a.py#callable:run@1", "callable", "run", "a.py", 1, 1, None, "(x)", "run it")]
    s, none = spark.createDataFrame(rows, SCHEMAS["symbols"]), spark.createDataFrame([], SCHEMAS["embeddings"])
    some = spark.createDataFrame([(rows[0][0], 0, [1.0, 0.0])], SCHEMAS["embeddings"])
    with pytest.warns(UserWarning):
        assert search.search(s, some, "run", lambda q: 1 / 0)[0] == "fallback_exact"
    assert search.search(s, none, "run", lambda q: [1.0, 0.0])[0] == "fallback_exact"
    assert search.search(s, none, "run", lambda q: [1.0, 0.0], fill=lambda: some)[0] == "vector"
    assert search.search(s, some, "run", lambda q: [1.0, 0.0], exact=True)[0] == "exact"
    assert search.search_web(s, some, "run", lambda q: [], kind="Function").count() == 1 and search.search_web(s, some, "run", lambda q: [], kind="class").count() == 0
    assert search.search_web(s, some, "run", lambda q: [1.0, 0.0], vector=True).columns == s.columns
    assert search.as_text(search.search_text(s, some, "x", lambda q: [1.0, 0.0])) == f"- run (callable) [score: 1.20]\n  {rows[0][0]}\n  Sig: (x)\n"
    assert search.as_text(search.search_text(s, none, "x", lambda q: [1.0, 0.0])) == "No results found."


def test_no_answer_is_cut_unsaid(spark):
    assert len(json.loads(envelope.success("x", spark.range(1500)))["data"]) == 1500
    cut = json.loads(envelope.success("x", spark.range(5), limit=3))
    assert len(cut["data"]) == 3 and cut["truncated"] and "t" not in json.loads(envelope.success("x", spark.range(3), "compact", 3))


def test_chains_of_any_depth(spark):
    scopes = spark.createDataFrame([(k, k - 1 if k else None) for k in range(150)], "scope_id bigint, parent_id bigint")
    chain = {(r["scope_id"], r["ancestor"]): r["distance"] for r in traverse.scope_chain(scopes).collect()}
    assert chain == {(a, b): a - b for a in range(150) for b in range(a + 1)}
    with pytest.raises(ValueError):
        traverse.scope_chain(spark.createDataFrame([(1, 2), (2, 1)], "scope_id bigint, parent_id bigint"))


def test_receivers_and_likeness(spark):
    uri = lambda kind, name, path="a.py": f"codescope://r/{path}#{kind}:{name}@1"
    row = lambda kind, name, path="a.py": (uri(kind, name, path), kind, name, path, 1, 1, None, None, "")
    s = spark.createDataFrame([row("container", "Box"), row("callable", "open"), row("callable", "open", "b.py")], SCHEMAS["symbols"])
    e = spark.createDataFrame([(uri("container", "Box"), uri("callable", "open"), "contains", 1.0, "static")], SCHEMAS["edges"])
    refs = spark.createDataFrame([(1, "u", "Box.open", None, 0, "z.py", 1, "call", False), (2, "u", "open", None, 0, "z.py", 1, "call", False)], SCHEMAS["references"])
    assert sorted((r["id"], r["strategy"], r["uri"]) for r in link.resolve_basic(refs, s, e).collect()) == [(1, "receiver", uri("callable", "open")), (2, "ambiguous", None)]
    vectors = spark.createDataFrame([(uri("callable", "open"), 0, [1.0, 0.1]), (uri("callable", "open", "b.py"), 0, [0.0, 1.0]), ("wide", 0, [1.0, 0.0, 0.0]), ("none", 0, None)], SCHEMAS["embeddings"])
    sites = spark.createDataFrame([(1, "u", [2.0, 0.0]), (2, "v", [0.0, 0.0])], "id bigint, from_uri string, vector array<float>")
    assert [(r["from_uri"], r["to_uri"]) for r in link.semantic_link(sites, vectors, e, 0.5).collect()] == [("u", uri("callable", "open"))]


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "idx"))
    edges = spark.createDataFrame([("a", "b", "calls", 1.0, "static")], SCHEMAS["edges"])
    catalog.commit({"edges": edges})
    with pytest.raises(Exception, match="stop"):
        catalog.commit({"edges": edges.limit(0), "symbols": spark.range(1).select(*[F.raise_error(F.lit("stop")).cast("string").alias(c) for c in catalog.load("symbols").columns])})
    assert catalog.load("edges").count() == 1 and catalog.load("symbols").count() == 0
    catalog.register_views("t_")
    assert spark.sql("select count(*) from t_edges").first()[0] == 1
    assert Pointer(spark, str(tmp_path / "none.json")).read() == {}


def test_state_outlives_the_session(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    rows = [("a", "1", 1, 1), ("b", "1", 1, 2), ("a", "2", 2, 3), ("b", None, 3, 4)]
    batch = lambda *k: spark.createDataFrame([rows[i] for i in k], "path string, hash string, s int, event_id bigint").withColumn("ts", F.timestamp_seconds("s"))
    seen = []
    note = lambda changes, n: seen.append((n, sorted(map(tuple, changes.collect()))))
    incremental.IncrementalIndex(spark, note, folder).process(batch(0, 1), 0)
    second = incremental.IncrementalIndex(spark, note, folder)
    second.process(batch(2, 3), 1)
    incremental.IncrementalIndex(spark, note, folder).process(batch(2, 3), 1)  # the same batch after a failure
    assert seen == [(0, [("a", "new"), ("b", "new")]), (1, [("a", "modified"), ("b", "removed")]), (1, [("a", "modified"), ("b", "removed")])]
    assert sorted(map(tuple, incremental.IncrementalIndex(spark, folder=folder).files().collect())) == [("a", "2")]


def test_a_watched_folder(spark, tmp_path):
    root = tmp_path / "proj"
    root.mkdir()
    (root / "a.py").write_text("def one():\n    return 1\n")

    def until(wanted):
        for _ in range(240):
            if names() == wanted:
                return True
            assert query.exception() is None
            time.sleep(0.5)
        return False

    names = lambda: sorted(r["name"] for r in api.Index(spark, str(tmp_path / "idx"), "p").symbols.filter("kind = 'callable'").collect())
    query = api.Index(spark, str(tmp_path / "idx"), "p").watch(str(root), f"file://{tmp_path}/check")
    try:
        assert query.isActive and until(["one"])
        (root / "b.py").write_text("def two():\n    return one()\n")
        assert until(["one", "two"])
    finally:
        query.stop()
    (root / "a.py").unlink()
    query = api.Index(spark, str(tmp_path / "idx"), "p").watch(str(root), f"file://{tmp_path}/check")
    try:
        assert until(["two"])
    finally:
        query.stop()
    assert not query.isActive
