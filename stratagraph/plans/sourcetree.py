"""Source files written from the test tables, and queries of the sources, parsers and searches over
them. A file's text is a template filled from a row, so what a parser must find follows in SQL."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import shared_dir, stored
from ..extract import adapters, chunker
from ..functions import scoring
from ..operators import search, tables, traverse
from ..sources import files
from ..sources.catalog import Catalog
from ..streaming import incremental
from .project import SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PYTHON = '''import os
from lib.r{n} import base as b{k}


class C{k}(B{n}):
    """About {t}."""

    def m{k}(self, x):
        return h{k}(x)


def h{k}(x):
    b{k}.run(x)
    return x
'''
RUST = """use std::io::Write as W{k};
struct S{k} { x: i32 }
impl S{k} {
    fn show{k}(&self) { W{k}::emit(); }
}
fn main{k}() { show{k}(); }
"""
SCRIPT = """import { a{k} } from './lib{n}';
class K{k} extends Base{n} {
  go{k}() { a{k}(); }
}
function f{k}(x) { return g{k}(x); }
"""
GO = """package p{n}
import "fmt"
type T{k} struct { n int }
func (t *T{k}) Run{k}() int { fmt.Println(t.n); return 1 }
func main{k}() { helper{k}() }
"""


def _fill(template: str, k: str, n: str, t: str) -> Column:
    out = F.lit(template)
    for name, column in (("{k}", k), ("{n}", n), ("{t}", t)):
        out = F.replace(out, F.lit(name), F.col(column).cast("string"))
    return out


def _fill_sql(template: str, k: str, n: str, t: str) -> str:
    quoted = "'" + template.replace("'", "''") + "'"
    for name, column in (("{k}", k), ("{n}", n), ("{t}", t)):
        quoted = f"replace({quoted}, '{name}', cast({column} as varchar))"
    return quoted


def python_files(t: Tables) -> DataFrame:
    """(path, content): a Python file for every supplier."""
    return t("supplier").select(F.concat(F.lit("src/s"), "s_suppkey", F.lit(".py")).alias("path"), _fill(PYTHON, "s_suppkey", "s_nationkey", "s_name").alias("content"))


def brace_files(t: Tables) -> DataFrame:
    """(path, content): a Rust, a JavaScript and a Go file for every nation."""
    out = None
    for template, ending in ((RUST, "rs"), (SCRIPT, "js"), (GO, "go")):
        own = t("nation").select(F.concat(F.lit("src/n"), "n_nationkey", F.lit(f".{ending}")).alias("path"), _fill(template, "n_nationkey", "n_regionkey", "n_name").alias("content"))
        out = own if out is None else out.unionByName(own)
    return out


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLE[f.__name__] = sql
        return f

    return add


# Files --------------------------------------------------------------------------------------------


def write_tree(rows: DataFrame, root: str) -> None:
    """Write (path, content binary) as files below ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, base = files._open(root)
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                out.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with out.open_output_stream(f"{base}/{path}") as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def source_tree(t: Tables) -> str:
    """A folder of files, some of which a walk must leave out."""
    n = t("nation")
    key = F.col("n_nationkey").cast("string")
    odd = {
        "img/p{}.png": F.lit("x"), ".hidden/x{}.py": F.lit("x = 1\n"), "gen/g{}.py": F.lit("x = 1\n"), "node_modules/q{}.js": F.lit("x()\n"),
        "pkg/n{}/__init__.py": F.concat(F.lit("# "), "n_name", F.lit("\n")), "pkg/n{}/.ignore": F.lit("skip*.py\n!skip_not.py\n"),
        "pkg/n{}/skip_1.py": F.lit("x = 1\n"), "pkg/n{}/skip_not.py": F.concat(F.lit("y = "), key, F.lit("\n")),
    }
    rows = python_files(t).select("path", F.col("content").cast("binary").alias("content"))
    for pattern, content in odd.items():
        head, tail = pattern.split("{}")
        rows = rows.unionByName(n.select(F.concat(F.lit(head), key, F.lit(tail)).alias("path"), content.cast("binary").alias("content")))
    rows = rows.unionByName(n.select(F.concat(F.lit("bin/l"), key, F.lit(".txt")).alias("path"), F.unhex(F.lit("E9E8")).alias("content")))
    rows = rows.unionByName(t.spark.createDataFrame([(".gitignore", bytearray(b"# made\ngen/\n"))], "path string, content binary"))
    root = f"{shared_dir(t.spark)}/stratagraph-core/tree-{uuid.uuid4().hex}"
    write_tree(rows, root)
    return root


_PYTHON_SQL = f"select s_suppkey as k, s_nationkey as n, s_name as t, 'src/s' || s_suppkey || '.py' as path, {_fill_sql(PYTHON, 's_suppkey', 's_nationkey', 's_name')} as content from supplier"


@query(f"select path, sha256(content) as hash from ({_PYTHON_SQL}) union all select 'pkg/n' || n_nationkey || '/__init__.py', sha256('# ' || n_name || chr(10)) from nation union all select 'pkg/n' || n_nationkey || '/skip_not.py', sha256('y = ' || n_nationkey || chr(10)) from nation")
def s01_walk(t):
    """A walk with extension, pattern, hidden and ignore filters, decoding and hashes."""
    return files.walk(t.spark, source_tree(t), exclude=["node_modules/"]).select("path", "hash")


@query("with was as (select cast(user_id as varchar) as path, max(value) as hash from events where event_type = 'view' group by 1), now as (select cast(user_id as varchar) as path, max(value) as hash from events where event_type <> 'error' group by 1) select path, case when now.hash is null then 'deleted' when was.hash is null then 'new' when now.hash = was.hash then 'unchanged' else 'modified' end as status from now full join was using (path)")
def s07_folder_status(t):
    held = lambda rows: rows.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max("value").cast("string").alias("hash"))
    return tables.change_status(held(t("events").filter("event_type <> 'error'")), held(t("events").filter("event_type = 'view'")))


@query(SQL + "select 'symbols' as tab, kind, count(*) as n from symbols group by kind union all select 'edges', kind, count(*) from edges group by kind")
def s15_commit_and_rollback(t):
    """Tables committed together; a commit that fails, and clearing a copy, change nothing."""
    catalog = Catalog(t.spark, f"{shared_dir(t.spark)}/stratagraph-core/catalog-{uuid.uuid4().hex}")
    catalog.commit({"symbols": t.symbols(), "edges": t.edges()})
    # The second table lacks a column, so this fails after the first one is written.
    with contextlib.suppress(AnalysisException):
        catalog.commit({"edges": tables.cleared(t.spark, "edges"), "symbols": t.symbols().drop("uri")})
    count = lambda name: catalog.load(name).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "kind", "n")
    return count("symbols").unionByName(count("edges"))


# Extraction ---------------------------------------------------------------------------------------

_AT = "'codescope://tpch/' || path || '#"


@query("select 'f' || p_partkey || '.' || e as path, case when e in ('py', 'pyi') then 'python' when e in ('js', 'mjs') then 'javascript' when e = 'rs' then 'rust' when e = 'go' then 'go' end as language from (select p_partkey, list_extract(['py', 'pyi', 'js', 'mjs', 'rs', 'go', 'PY', 'md'], cast(p_partkey % 8 + 1 as integer)) as e from part)")
def x01_registry(t):
    endings = F.array(*[F.lit(x) for x in ("py", "pyi", "js", "mjs", "rs", "go", "PY", "md")])
    paths = t("part").select(F.concat(F.lit("f"), "p_partkey", F.lit("."), F.element_at(endings, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("path"))
    return paths.select("path", adapters.default_registry().language(F.col("path")).alias("language"))


@query(f"with f as ({_PYTHON_SQL}) select path, 'namespace' as kind, 's' || k as name, 1 as line_start, 15 as line_end, null as doc, null as signature from f union all select path, 'container', 'C' || k, 5, 9, 'About ' || t || '.', null from f union all select path, 'callable', 'm' || k, 8, 9, null, '(self, x)' from f union all select path, 'callable', 'h' || k, 12, 14, null, '(x)' from f")
def x03_python_symbols(t):
    """Namespaces, callables, methods, containers, docstrings."""
    return adapters.extract(python_files(t), "tpch")["symbols"].select("path", "kind", "name", "line_start", "line_end", "doc", "signature")


@query(f"with f as ({_PYTHON_SQL}) select {_AT}namespace:s' || k || '@1' as from_uri, {_AT}container:C' || k || '@5' as to_uri, 'defines' as kind from f union all select {_AT}container:C' || k || '@5', {_AT}callable:m' || k || '@8', 'contains' from f union all select {_AT}namespace:s' || k || '@1', {_AT}callable:h' || k || '@12', 'defines' from f")
def x04_python_edges(t):
    return adapters.extract(python_files(t), "tpch")["edges"].select("from_uri", "to_uri", "kind")


@query(f"with f as ({_PYTHON_SQL}) select {_AT}container:C' || k || '@5' as from_uri, 'B' || n as name, null as receiver, 5 as line, 'inherits' as ref_kind from f union all select {_AT}callable:m' || k || '@8', 'h' || k, null, 9, 'call' from f union all select {_AT}callable:h' || k || '@12', 'run', 'b' || k, 13, 'call' from f")
def x06_python_references(t):
    """Calls, base classes, and names split at the last dot."""
    return adapters.extract(python_files(t), "tpch")["references"].select("from_uri", "name", "receiver", "line", "ref_kind")


@query(f"with f as ({_PYTHON_SQL}) select path as file_path, null as alias, 'os' as target_namespace, 1 as line from f union all select path, 'b' || k, 'lib.r' || n || '.base', 2 from f")
def x08_python_imports(t):
    return adapters.extract(python_files(t), "tpch")["imports"].select("file_path", "alias", "target_namespace", "line")


def _brace(select: str) -> str:
    return f"with f as (select n_nationkey as k, n_regionkey as n from nation) {select}"


@query(_brace("select 'src/n' || k || e as path, kind, name || case when kind = 'namespace' then k || e else cast(k as varchar) end as name, a as line_start, b as line_end, sig as signature from f, (values ('.rs', 'namespace', 'n', 1, 7, null), ('.rs', 'container', 'S', 2, 2, null), ('.rs', 'callable', 'show', 4, 4, '(&self)'), ('.rs', 'callable', 'main', 6, 6, '()'), ('.js', 'namespace', 'n', 1, 6, null), ('.js', 'container', 'K', 2, 4, null), ('.js', 'callable', 'go', 3, 3, '()'), ('.js', 'callable', 'f', 5, 5, '(x)'), ('.go', 'namespace', 'n', 1, 6, null), ('.go', 'container', 'T', 3, 3, null), ('.go', 'callable', 'Run', 4, 4, '() int'), ('.go', 'callable', 'main', 5, 5, '()')) v(e, kind, name, a, b, sig)"))
def x10_brace_symbols(t):
    return adapters.extract(brace_files(t), "tpch")["symbols"].select("path", "kind", "name", "line_start", "line_end", "signature")


@query(_brace("select 'src/n' || k || e as file_path, case when own then name || k when base then name || n else name end as name, case when receiver = 'W' then 'W' || k else receiver end as receiver, line, ref_kind from f, (values ('.rs', 'emit', 'W', 4, 'call', false, false), ('.rs', 'show', null, 6, 'call', true, false), ('.js', 'Base', null, 2, 'inherits', false, true), ('.js', 'a', null, 3, 'call', true, false), ('.js', 'g', null, 5, 'call', true, false), ('.go', 'Println', 'fmt', 4, 'call', false, false), ('.go', 'helper', null, 5, 'call', true, false)) v(e, name, receiver, line, ref_kind, own, base)"))
def x10_brace_references(t):
    return adapters.extract(brace_files(t), "tpch")["references"].select("file_path", "name", "receiver", "line", "ref_kind")


@query(_brace("select 'src/n' || k || '.rs' as file_path, 'W' || k as alias, 'std.io.Write' as target_namespace, 1 as line from f union all select 'src/n' || k || '.js', 'a' || k, './lib' || n, 1 from f union all select 'src/n' || k || '.go', null, 'fmt', 2 from f"))
def x10_brace_imports(t):
    return adapters.extract(brace_files(t), "tpch")["imports"].select("file_path", "alias", "target_namespace", "line")


@query("select 'd/' || doc_id as path, 1 as first_line, case when strlen(text) <= 1000 then 1::bigint end as pieces, case when strlen(text) <= 1000 then cast(1 + length(text) - length(replace(text, chr(10), '')) as integer) end as last_line from documents where regexp_matches(text, '[^\\s]')")
def x12_documents(t):
    """Documents without an adapter are chunked, whole; those up to the chunk size are one chunk, and SQL
    can say so (how longer ones are cut is tested by itself)."""
    d = t("documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.col("text").alias("content"))
    found = adapters.extract(d, "tpch")["symbols"].groupBy("path").agg(F.min("line_start").alias("first_line"), F.count("*").alias("n"), F.max("line_end").alias("last"))
    # Of the texts only their size is joined.
    sizes = d.select("path", (F.octet_length("content") <= 1000).alias("small"))
    return sizes.join(found, "path").select("path", "first_line", F.when(F.col("small"), F.col("n")).alias("pieces"), F.when(F.col("small"), F.col("last")).alias("last_line"))


@query("select path, e in ('yaml', 'sql', 'md', 'TF', 'env', 'Gradle') as document from (select 'a.b/f' || p_partkey || '.' || e as path, e from (select p_partkey, list_extract(['yaml', 'sql', 'md', 'TF', 'env', 'Gradle', 'py', 'css'], cast(p_partkey % 8 + 1 as integer)) as e from part))")
def t09_chunk_extensions(t):
    endings = F.array(*[F.lit(x) for x in ("yaml", "sql", "md", "TF", "env", "Gradle", "py", "css")])
    paths = t("part").select(F.concat(F.lit("a.b/f"), "p_partkey", F.lit("."), F.element_at(endings, (F.col("p_partkey") % 8 + 1).cast("int"))).alias("path"))
    return paths.select("path", chunker.is_document(F.col("path")).alias("document"))


# Searches and resolution --------------------------------------------------------------------------

_BOOST = "case when regexp_matches(lower(path), '\\.(rs|py|js|ts|tsx|jsx|go|c|cpp|h)$') then 1.2 when regexp_matches(lower(path), '\\.(md|txt)$') or lower(path) like '%readme%' then 0.9 when regexp_matches(lower(path), '\\.(json|yaml|yml|toml)$') then 0.7 else 1.0 end"
_CONTENT = f"from symbols where content ilike '%nation%' or name ilike '%nation%' order by {_BOOST} desc, path, line_start, uri limit 10"
_VECTOR = "list_cosine_similarity(cast(vector as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0))"


def _first_vector(t: Tables) -> list[float]:
    return t("embeddings").filter("vec_id = 0").first()["embedding"]


@query(SQL + f"select uri, 'fallback_exact' as mode, 1.0::double as score {_CONTENT}")
def q07_search_fallback(t):
    """Where embedding the query fails, words are searched."""

    def broken(_: str) -> list[float]:
        raise RuntimeError("no model")

    mode, found = search.search(t.symbols(), t.embeddings(), "nation", broken)
    return found.select("uri", F.lit(mode).alias("mode"), "score")


@query(SQL + f"select uri, kind, name {_CONTENT}")
def q08_web_search(t):
    """A kind that is not known counts as none."""
    return search.search_web(t.symbols(), t.embeddings(), "nation", lambda q: [], "no such kind").select("uri", "kind", "name")


@query(SQL + f"select uri, row_number() over (order by score desc, uri)::integer as place, printf('- %s (%s) [score: %.2f]', name, kind, score) || chr(10) || '  ' || uri || chr(10) as line from (select uri, any_value(name) as name, any_value(kind) as kind, max({_VECTOR}) * any_value({_BOOST}) as score from vectors join symbols using (uri) group by uri) order by score desc, uri limit 10")
def q09_text_search(t):
    vector = _first_vector(t)
    return search.search_text(t.symbols(), t.embeddings(), "any", lambda q: vector).select("uri", "place", "line")


@query(
    SQL.replace("with keyed", "with recursive keyed", 1)
    + ", w(uri, depth) as (select uri, 0 from keyed where t = 'supplier' and key = 0 union select e.from_uri, w.depth + 1 from w join edges e on e.to_uri = w.uri where w.depth < 3 and e.kind in ('calls', 'references', 'inherits')) select uri, case when min(depth) = 1 then '[DIRECT]' else '[INDIRECT]' end as label from w group by uri having min(depth) > 0"
)
def p03_impact_labels(t):
    start = t._keyed().filter("t = 'supplier' and key = 0").select("uri")
    return traverse.impact(stored(t.edges()), start, 3).select("uri", scoring.impact_label(F.col("depth")).alias("label"))


@query(
    "with scopes as (select r_regionkey + 1 as scope_id from region union all select 0 union all select n_nationkey + 100 from nation), wanted as (select * from scopes, (values ('here'), ('wide'), ('deepest'), ('nowhere')) v(name))"
    " select scope_id::bigint as scope_id, name, case when name = 'here' then 'here@' || scope_id when name = 'wide' then 'wide@0' else 'lib@0' end as uri, case when name = 'deepest' then 0.2 else 1.0 end::double as confidence from wanted where (name = 'here' and scope_id >= 100) or name in ('wide', 'deepest')"
    " union all select scope_id, (select p_name from part where p_partkey = 0), 'part@0', 1.0 / (select count(*) from part where p_name = (select p_name from part where p_partkey = 0)) from scopes"
)
def l08_name_resolver(t):
    """By the chain of scopes, by the imports along it, by name anywhere."""
    from ..operators import link

    spark = t.spark
    root = spark.createDataFrame([(0, None)], "scope_id bigint, parent_id bigint")
    regions = t("region").select((F.col("r_regionkey") + 1).cast("bigint"), F.lit(0).cast("bigint"))
    scopes = root.union(regions).union(t("nation").select((F.col("n_nationkey") + 100).cast("bigint"), (F.col("n_regionkey") + 1).cast("bigint")))
    here = scopes.filter("scope_id >= 100").select("scope_id", F.lit("here").alias("name"), F.concat(F.lit("here@"), "scope_id").alias("uri"))
    definitions = here.union(spark.createDataFrame([(0, "wide", "wide@0")], "scope_id bigint, name string, uri string"))
    imports = spark.createDataFrame([(0, "lib", [], None, 1)], "scope_id bigint, namespace string, symbols array<string>, alias string, line int")
    externals = t("part").select(F.col("p_name").alias("name"), F.concat(F.lit("part@"), "p_partkey").alias("uri"), F.col("p_partkey").alias("ordinal"))
    externals = externals.union(t("region").select(F.lit("lib.deepest"), F.concat(F.lit("lib@"), "r_regionkey"), F.col("r_regionkey").cast("bigint")))
    names = spark.createDataFrame([("here",), ("wide",), ("deepest",), ("nowhere",)], "name string").union(t("part").filter("p_partkey = 0").select("p_name"))
    return link.resolve_scoped(scopes, definitions, imports, externals, scopes.select("scope_id").crossJoin(names))


# Streaming ----------------------------------------------------------------------------------------


@query("select event_id, path, case when hash is null then 'removed' when was is null then 'new' when was = hash then 'unchanged' else 'modified' end as status from (select *, lag(hash) over (partition by path order by ts, event_id) as was from (select event_id, ts, cast(user_id as varchar) as path, case when event_type <> 'error' then cast(cast(floor(value / 50) as bigint) as varchar) end as hash from events))")
def r02_keyed_state(t):
    """R2 and R3 with the state kept by Spark, keyed by path."""
    return incremental.replay_keyed(t.spark, f"{t.sf_dir}/events.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

