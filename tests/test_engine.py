"""The engine's behaviours on tiny inputs."""

import json

import pytest
from pyspark.sql import functions as F

from stratagraph import api
from stratagraph.core import SCHEMAS
from stratagraph.extract import adapters, braces, chunker, python_source
from stratagraph.functions import scoring, text, uri
from stratagraph.functions.embed import hash_embed
from stratagraph.operators import link, lookup, search, tables, traverse
from stratagraph.sources import config, envelope, files, jsonl
from stratagraph.streaming import incremental


def sym(name, path="a.py", kind="callable", content="", line=1):
    return (f"codescope://r/{path}#{kind}:{name}@{line}", kind, name, path, line, line, None, None, content)


def symbols(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMAS["symbols"])


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, k, float(c), "static") for a, b, k, c in rows], SCHEMAS["edges"])


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_addresses(spark):
    good = ["codescope://repo/src/a b.py#callable:run@12", "codescope://r/x#Function:a@b@3", "codescope://r/x#value:n:m@1"]
    bad = ["invalid", "http://r/x#callable:f@1", "codescope://r/x", "codescope://r/x#nothing:f@1", "codescope://r/x#callable:f@4294967296", "codescope://r/x#callable:f@"]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string").select("u", uri.parse(F.col("u")).alias("p"), uri.is_valid(F.col("u")).alias("ok"))
    got = {r["u"]: r for r in df.collect()}
    assert [got[u]["ok"] for u in good] == [True] * 3 and not any(got[u]["ok"] for u in bad)
    assert tuple(got[good[0]]["p"]) == ("repo", "src/a b.py", "callable", "run", 12)
    assert tuple(got[good[1]]["p"]) == ("r", "x", "callable", "a@b", 3)
    built = spark.range(1).select(uri.build("r", F.lit("p/q.rs"), F.lit("value"), F.lit("X"), F.lit(7)).alias("u"))
    assert built.first()["u"] == "codescope://r/p/q.rs#value:X@7"


def test_kinds_and_edges(spark):
    df = spark.createDataFrame([("class",), ("Function",), ("MODULE",), ("const",), ("chunk",), ("?",)], "k string").select(uri.parse_kind(F.col("k")).alias("k"))
    assert [r["k"] for r in df.collect()] == ["container", "callable", "namespace", "value", "document", None]
    e = edges(spark, ("a", "b", "calls", 1.0), ("a", "c", "contains", 0.75))
    flags = {r["to_uri"]: r for r in lookup.edge_flags(e).collect()}
    assert flags["b"]["deterministic"] and flags["b"]["dependency"] and flags["c"]["probabilistic"] and not flags["c"]["dependency"]
    assert [tuple(r)[:2] for r in lookup.reversed_edges(e).collect()] == [("b", "a"), ("c", "a")]
    assert spark.range(1).select(scoring.clamp(F.lit(1.7)), scoring.clamp(F.lit(-1.0))).first()[:] == (1.0, 0.0)


def test_name_search_and_content_search(spark):
    s = symbols(spark, sym("authenticate"), sym("authorize", line=2), sym("validate", line=3))
    assert search.search_name(s, "auth").count() == 2 and search.search_name(s, "VALIDATE").first()["score"] == 1.0
    c = symbols(spark, sym("PostgresEngine"), sym("MyClass", content="the engine", line=2))
    assert names(search.search_content(c, "postgre engine")) == ["PostgresEngine"]
    assert search.search_content(c, "myclass missing").count() == 0 and search.search_content(c, "  ").count() == 2
    b = symbols(spark, sym("main", "README.md"), sym("main", "src/main.rs"))
    assert search.search_content(b, "main").first()["path"] == "src/main.rs"
    assert search.search_content(symbols(spark, sym("a\\b")), "a\\b").count() == 1


def test_vectors(spark):
    s = symbols(spark, sym("a"), sym("b", "b.md", line=2))
    e = spark.createDataFrame([(r["uri"], k, v) for r, k, v in zip(s.collect() * 2, [0, 0, 1, 1], [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [2.0, 0.0]])], SCHEMAS["embeddings"])
    got = [(r["name"], round(r["score"], 3)) for r in search.search_vector(s, e, [1.0, 0.0]).collect()]
    assert got == [("a", 1.2), ("b", 0.9)]
    odd = spark.createDataFrame([([1.0], [1.0, 2.0]), ([], []), ([0.0], [1.0])], "a array<float>, b array<float>").select(scoring.cosine(F.col("a"), F.col("b")).alias("c"))
    assert [r["c"] for r in odd.collect()] == [0.0, 0.0, 0.0]
    v = hash_embed(["parse the file", "parse the file", "something else", ""])
    assert (v[0] == v[1]).all() and abs((v[0] ** 2).sum() - 1) < 1e-5 and v[3].sum() == 0 and v[0] @ v[2] < 0.9


def test_traversal(spark):
    s = symbols(spark, sym("a"), sym("b", line=2), sym("c", line=3))
    u = {r["name"]: r["uri"] for r in s.collect()}
    e = edges(spark, (u["a"], u["b"], "calls", 1), (u["b"], u["c"], "calls", 1), (u["c"], u["a"], "calls", 1))
    assert names(traverse.callers(s, e, u["b"])) == ["a"] and names(traverse.callees(s, e, u["b"])) == ["c"]
    assert names(traverse.callers(s, e, u["b"], 5)) == ["a", "c"] and traverse.callers(s, e, u["b"], 0).count() == 0
    chain = edges(spark, (u["a"], u["b"], "calls", 1), (u["b"], u["c"], "references", 0.8))
    report = traverse.impact_report(s, chain, u["c"], 3).collect()
    assert [(r["name"], r["depth"], r["is_direct"], r["label"]) for r in report] == [("b", 1, True, "[DIRECT]"), ("a", 2, False, "[INDIRECT]")]
    assert [r["name"] for r in traverse.impact_report(s, chain, u["c"], 0).collect()] == ["b"]
    roles = {r["name"]: (r["role"], r["importance"]) for r in traverse.analyze(s, chain).collect()}
    assert roles == {"a": ("Entry Point/High-level Logic", 1.0), "b": ("Intermediate Logic", 1.5), "c": ("Utility/Leaf Function", 1.5)}
    nodes, links = traverse.explore(s, e, u["b"])
    assert nodes.count() == 3 and links.count() == 2
    assert traverse.impact(chain, s.filter("name = 'a'").select("uri"), 2).count() == 0


def test_scopes(spark):
    scopes = spark.createDataFrame([(0, None, "Module"), (1, 0, "Class"), (2, 1, "Function"), (3, 2, "Block")], "scope_id bigint, parent_id bigint, kind string")
    chain = traverse.scope_chain(scopes).filter("scope_id = 3").orderBy("distance")
    assert [r["ancestor"] for r in chain.collect()] == [3, 2, 1, 0]
    defs = spark.createDataFrame([(0, "x", "outer"), (2, "x", "inner"), (0, "y", "top")], "scope_id bigint, name string, uri string")
    wanted = spark.createDataFrame([(3, "x"), (1, "x"), (3, "y"), (3, "path"), (3, "dup"), (3, "none")], "scope_id bigint, name string")
    imports = spark.createDataFrame([(0, "os", ["path"], None, 1)], "scope_id bigint, namespace string, symbols array<string>, alias string, line int")
    externals = spark.createDataFrame([("os.path", "u:os.path", 0), ("dup", "d1", 0), ("dup", "d2", 1)], "name string, uri string, ordinal int")
    got = {(r["scope_id"], r["name"]): (r["uri"], r["confidence"]) for r in link.resolve_scoped(scopes, defs, imports, externals, wanted).collect()}
    assert got == {(3, "x"): ("inner", 1.0), (1, "x"): ("outer", 1.0), (3, "y"): ("top", 1.0), (3, "path"): ("u:os.path", 1.0), (3, "dup"): ("d1", 0.5)}


def test_linking(spark):
    s = symbols(spark, sym("foo", "math.rs"), sym("foo", "string.rs"), sym("bar", "math.rs", line=5), sym("Box", "math.rs", "container", line=9), sym("main", "main.rs"))
    u = {(r["name"], r["path"]): r["uri"] for r in s.collect()}
    e = edges(spark, (u["Box", "math.rs"], u["foo", "math.rs"], "contains", 1))
    ref = lambda i, name, receiver=None, path="main.rs", kind="call": (i, u["main", "main.rs"], name, receiver, 0, path, 1, kind, False)
    refs = spark.createDataFrame([ref(1, "foo"), ref(2, "foo", "Box"), ref(3, "bar", kind="inherits"), ref(4, "nothing"), ref(5, "foo", None, "math.rs"), ref(6, "foo", "s")], SCHEMAS["references"])
    imports = spark.createDataFrame([(1, "main.rs", "s", "string", 1)], SCHEMAS["imports"])
    linked = link.link(refs, s, e, imports)
    got = {r["id"]: (r["outcome"], r["rule"], r["uri"]) for r in linked.collect()}
    assert got[1] == ("ambiguous", "global", None) and got[2] == ("resolved", "receiver", u["foo", "math.rs"]) and got[3][0] == "resolved" and got[4][0] == "external"
    assert got[5] == ("resolved", "local", u["foo", "math.rs"]) and got[6] == ("resolved", "import", u["foo", "string.rs"])
    assert {r["candidate_uri"] for r in link.ambiguous_rows(linked, refs, s, e).collect()} == {u["foo", "math.rs"], u["foo", "string.rs"]}
    assert {r["kind"] for r in link.linked_edges(linked).collect()} == {"calls", "inherits"}
    basic = {r["id"]: (r["strategy"], r["confidence"]) for r in link.resolve_basic(refs.withColumn("name", F.when(F.col("id") == 2, "Box.foo").otherwise(F.col("name"))), s, e).collect()}
    assert basic[1] == ("ambiguous", None) and basic[2] == ("receiver", 0.9) and basic[3] == ("global", 0.7) and basic[4] == ("unresolved", None) and basic[5] == ("same_file", 1.0)


def test_names_and_texts(spark):
    df = spark.createDataFrame([("func",), ("self.method",), ("module.submodule.func",)], "n string").select(text.simple_name(F.col("n")), text.first_receiver(F.col("n")), text.split_reference(F.col("n")))
    assert [(r[0], r[1], tuple(r[2])) for r in df.collect()] == [("func", None, (None, "func")), ("method", "self", ("self", "method")), ("func", "module", ("module.submodule", "func"))]
    body = "".join(f"line {k}\n" for k in range(1, 8))
    got = spark.createDataFrame([(body, k) for k in (1, 4, 7, 9)], "c string, l int").select(text.callsite_context(F.col("c"), F.col("l"))).collect()
    assert [r[0].count("line") for r in got] == [3, 5, 3, 0]
    starts = spark.createDataFrame([("x" * n,) for n in (10, 2000, 2001, 3801)], "c string").select(text.fixed_starts(F.col("c"))).collect()
    assert [r[0] for r in starts] == [[0], [0], [0, 1800], [0, 1800, 3600]]


def test_chunker():
    assert len(chunker.split("select 1;\nselect 2;\n")) == 1 and chunker.split(" \n") == []
    many = chunker.split("\n".join(f"line number {k} with words" for k in range(50)), 100, 20)
    assert len(many) > 1 and all(c.line_start <= c.line_end for c in many)
    long = chunker.split("é" * 5000 + "\n" + "wörd " * 3000)
    assert len(long) > 10 and all("�" not in c.content for c in long)
    assert chunker.names("a/b.md", many)[:2] == ["b.md#chunk_1", "b.md#chunk_2"]


PYTHON = '''"""Module doc."""
import os.path as p
from sys import argv

LIMIT = 3

class Base:
    size = 1

class Child(Base):
    """Child doc."""
    def run(self, x: int) -> int:
        """Run doc."""
        return helper(x)

def helper(y):
    return p.join(y)

helper(1)
'''


def test_python_extraction():
    found = python_source.parse("r", "pkg/mod.py", PYTHON)
    by = {(s["kind"], s["name"]): s for s in found.symbols}
    assert {("namespace", "mod"), ("container", "Base"), ("container", "Child"), ("callable", "run"), ("callable", "helper"), ("value", "LIMIT"), ("value", "size")} == set(by)
    assert by["callable", "run"]["signature"] == "(self, x: int) -> int" and by["callable", "run"]["doc"] == "Run doc." and by["container", "Child"]["doc"] == "Child doc."
    assert {(e["kind"], e["to_uri"].split(":")[-1].split("@")[0]) for e in found.edges} >= {("contains", "run"), ("defines", "helper"), ("defines", "Child")}
    refs = {(r["name"], r["receiver"], r["ref_kind"], r["from_uri"].split(":")[-1].split("@")[0]) for r in found.references}
    assert refs == {("Base", None, "inherits", "Child"), ("helper", None, "call", "run"), ("join", "p", "call", "helper"), ("helper", None, "call", "mod")}
    assert {(i["target_namespace"], i["alias"]) for i in found.imports} == {("os.path", "p"), ("sys.argv", "argv")}


def test_brace_languages():
    js = braces.parse("js", "r", "a.js", "import {x as y} from 'lib';\nexport function go(a) { return y(a); } // no(1)\nclass A extends B { run() { this.go(); } }\nconst f = (z) => z;\nconst N = 3;\n")
    kinds = {(s["kind"], s["name"]) for s in js.symbols}
    assert {("callable", "go"), ("container", "A"), ("callable", "run"), ("callable", "f"), ("value", "N")} <= kinds
    assert {(r["name"], r["ref_kind"]) for r in js.references} >= {("y", "call"), ("B", "inherits"), ("go", "call")} and "no" not in {r["name"] for r in js.references}
    assert [(i["target_namespace"], i["alias"]) for i in js.imports] == [("lib", "y")]
    rust = braces.parse("rust", "r", "a.rs", 'use std::io::{Read, Write as W};\nstruct P { x: i32 }\nimpl Show for P { fn show(&self) -> String { render("}") } }\nfn main() { math::foo(1); }\nfn other() {}\n')
    assert {("container", "P"), ("callable", "show"), ("callable", "main"), ("callable", "other")} <= {(s["kind"], s["name"]) for s in rust.symbols}
    assert {(r["name"], r["receiver"]) for r in rust.references} >= {("foo", "math"), ("render", None), ("Show", None)}
    assert ("contains", "show") in {(e["kind"], e["to_uri"].split(":")[-1].split("@")[0]) for e in rust.edges}
    assert {(i["target_namespace"], i["alias"]) for i in rust.imports} == {("std.io.Read", None), ("std.io.Write", "W")}
    go = braces.parse("go", "r", "a.go", 'package m\nimport (\n  "fmt"\n  j "encoding/json"\n)\ntype T struct { n int }\nfunc (t *T) Run() int { fmt.Println(t.n); return 1 }\nfunc main() { new(T).Run() }\n')
    assert {("container", "T"), ("callable", "Run"), ("callable", "main")} <= {(s["kind"], s["name"]) for s in go.symbols}
    assert {(i["target_namespace"], i["alias"]) for i in go.imports} == {("fmt", None), ("encoding.json", "j")}


def test_paths_and_settings(spark, tmp_path):
    paths = ["src/a.rs", "target/x/b.rs", "img/p.PNG", "node_modules/q.js", "docs/readme.md", ".git/c.py", "gen/out.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = lambda c: [r["path"] for r in df.filter(c).collect()]
    assert "img/p.PNG" not in kept(files.has_text_extension(F.col("path")))
    assert kept(files.keep(F.col("path"), ["**/*.rs"], ["target/"])) == ["src/a.rs"]
    assert kept(files.keep(F.col("path"), [], ["/^gen|^docs/"])) == [p for p in paths if not p.startswith(("gen", "docs"))]
    assert kept(files.not_ignored(F.col("path"), "# c\nnode_modules/\n*.py\n!gen/out.py\n/target\n")) == ["src/a.rs", "img/p.PNG", "docs/readme.md", "gen/out.py"]
    assert ".git/c.py" not in kept(files.not_hidden(F.col("path")))
    place = config.default_path(str(tmp_path))
    assert config.load(place) == config.Config() and config.write(place, config.Config(repo='a"b', include=["x/*"])) and not config.write(place, config.Config())
    assert config.load(place).repo == 'a"b' and config.keep_out_of_git(str(tmp_path)) and not config.keep_out_of_git(str(tmp_path))
    said = json.loads(envelope.success("stats", spark.range(2), "compact"))
    assert said == {"f": "compact", "c": "stats", "o": True, "d": [{"id": 0}, {"id": 1}]} and json.loads(envelope.error("x", "no"))["ok"] is False
    assert sorted(r["path"] for r in jsonl.round_trip(df).collect()) == sorted(paths)


def test_table_upkeep(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert sorted(map(tuple, tables.change_status(new, old).collect())) == [("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "new")]
    assert sorted(map(tuple, tables.upsert(old, new, ["path"]).collect())) == [("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")]
    assert tables.cleared(spark, "edges").count() == 0
    with pytest.raises(KeyError):
        tables.cleared(spark, "nothing")


def test_batches_in_any_order(spark):
    rows = [("a", "1", 1, 1), ("a", "2", 2, 2), ("b", "1", 1, 3), ("b", None, 3, 4), ("c", "1", 5, 5)]
    schema = "path string, hash string, s int, event_id bigint"
    batch = lambda *k: spark.createDataFrame([rows[i] for i in k], schema).withColumn("ts", F.timestamp_seconds("s"))
    seen = []
    index = incremental.IncrementalIndex(spark, lambda changes, n: seen.append(sorted(map(tuple, changes.collect()))))
    index.process(batch(1, 3))
    index.process(batch(0, 2, 4))  # late and older events change nothing
    index.process(batch(0, 2, 4))  # nor does a batch that comes twice
    assert sorted(map(tuple, index.files().collect())) == [("a", "2"), ("c", "1")] and seen == [[("a", "new")], [("c", "new")], []]


def test_index_of_a_folder(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "src/main.rs").write_text("fn main() { foo(); helper(); }\n")
    (root / "src/math.rs").write_text("fn foo() {}\n")
    (root / "src/string.rs").write_text("fn foo() {}\nfn helper() {}\n")
    (root / "hello.py").write_text("def hello():\n    return 1\n")
    (root / "bad.py").write_text("def broken(:\n")
    (root / "notes.md").write_text("Some notes about foo.\n")
    (root / "x.png").write_bytes(b"\xff\xfe")
    (root / "latin.txt").write_bytes(b"\xe9\xe8")
    index = api.Index(spark, str(tmp_path / "idx"), "proj")
    counts = {r["status"]: r["n"] for r in index.index(str(root)).collect()}
    assert counts == {"new": 6}
    got = {(s["kind"], s["name"]) for s in index.symbols.collect()}
    assert {("callable", "hello"), ("callable", "main"), ("callable", "helper"), ("document", "notes.md"), ("document", "bad.py")} <= got
    outcome = {r["name"]: r["outcome"] for r in index.linked().join(index.references.select("id", "name"), "id").collect()}
    assert outcome == {"foo": "ambiguous", "helper": "resolved"}
    helper = index.symbols.filter("name = 'helper'").first()["uri"]
    assert names(index.callers(helper)) == ["main"] and [r["name"] for r in index.impact(helper).collect()] == ["main"]
    assert "helper" in names(index.search("helper", 3)) and names(index.search("notes", exact=True)) == ["notes.md"]
    assert index.stats().first()["symbols"] == index.symbols.count() and index.analyze(helper).first()["in_degree"] == 2
    (root / "src/string.rs").write_text("fn foo() {}\n")
    (root / "hello.py").unlink()
    counts = {r["status"]: r["n"] for r in index.index(str(root)).collect()}
    assert counts == {"unchanged": 4, "modified": 1, "deleted": 1}
    left = {(s["kind"], s["name"]) for s in index.symbols.collect()}
    assert ("callable", "hello") not in left and ("callable", "helper") not in left and ("callable", "main") in left
    assert index.callers(helper).count() == 0
    index.resolve(0.9)
    with pytest.raises(LookupError):
        index.analyze("codescope://proj/none#value:x@1")


def test_adapters_pick_by_extension():
    registry = adapters.default_registry()
    assert registry.find("a/b.py") is python_source.parse and registry.find("a.PY") is None and registry.find("noext") is None
    assert [s["kind"] for s in registry.parse("r", "x.yaml", "a: 1\n", adapters.chunk_file).symbols] == ["document"]
    assert registry.parse("r", "x.yaml", "a: 1\n") is None
