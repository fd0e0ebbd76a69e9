"""Files of a source tree as rows: listed and read by tasks, filtered by path before they are read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import stored

# Extensions of files that are not text.
SKIPPED = ("png", "jpg", "jpeg", "gif", "ico", "exe", "dll", "so", "o", "a", "lib", "bin", "pdf", "zip", "tar", "gz", "wasm", "node", "db", "sqlite", "lock", "pyc", "svg")
# Files of ignore rules, the later ones overrule the earlier ones of a folder.
IGNORE_FILES = (".gitignore", ".ignore", ".cursorignore")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def has_text_extension(path: Column) -> Column:
    return ~F.lower(extension(path)).isin(*SKIPPED)


def glob_regex(pattern: str) -> str:
    """A glob as a regex over whole relative paths; ``dir/`` stands for everything below."""
    if pattern.endswith("/"):
        return rf"(^|.*/){re.escape(pattern)}.*"
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k):
            out, k = out + "(.*/)?", k + 3
            continue
        if pattern.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "[" and "]" in pattern[k + 1 :]:
            end = pattern.index("]", k + 1)
            body = pattern[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body.startswith("!") else body) + "]", end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        k += 1
    return out


def matches(path: Column, pattern: str) -> Column:
    """``/regex/`` searches the path; anything else is a glob for all of it."""
    if len(pattern) > 2 and pattern[0] == pattern[-1] == "/":
        return path.rlike(pattern[1:-1])
    return path.rlike(f"^(?:{glob_regex(pattern)})$")


def keep(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Any exclude hit drops a path; where includes are given, one must hit."""
    out = F.lit(True)
    for pattern in exclude:
        out = out & ~matches(path, pattern)
    if include:
        hit = F.lit(False)
        for pattern in include:
            hit = hit | matches(path, pattern)
        out = out & hit
    return out


#: Columns of a rule: where it holds, how it is looked up, and its place among all rules. A hit of a
#: ``only_below`` rule must be a folder on the path, not the path's own end.
RULES = "folder string, kind string, key string, only_below boolean, hit boolean, place struct<depth:int,folder:string,source:int,line:int>"


def ignore_rules(text: str, folder: str = "", source: int = 0, depth: int | None = None) -> list[tuple]:
    """Lines of an ignore file in ``folder`` as rows of ``RULES``: comments, ``!`` exceptions, anchored and
    directory patterns. Plain names, plain paths and ``*.ending`` are keys for an equi-join (kinds name,
    path and ending); only other globs are regexes (kind glob)."""
    folder = folder.strip("/")
    base, out = f"{folder}/" if folder else "", []
    depth = (folder.count("/") + 1 if folder else 0) if depth is None else depth
    for at, line in enumerate(text.splitlines()):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!")
        body, below = line.strip("/"), line.endswith("/")
        fixed, plain = line.startswith("/") or "/" in body, not set(body) & set("*?[")
        if plain:
            kind, key = ("path", base + body) if fixed else ("name", body)
        elif not fixed and body.startswith("*.") and not set(body[1:]) & set("*?["):
            kind, key = "ending", body[1:]
        else:
            kind, key = "glob", f"^{re.escape(base)}" + ("" if fixed else "(.*/)?") + glob_regex(body) + ("/.*" if below else "(/.*)?") + "$"
        out.append((folder, kind, key, below, not back, (depth, folder, source, at)))
    return out


def rule_regex(rule: tuple) -> str:
    """What a rule matches, as one regex over whole paths."""
    folder, kind, key, below = rule[:4]
    if kind == "glob":
        return key
    base = re.escape(f"{folder}/" if folder else "")
    head = {"path": "", "name": f"{base}(.*/)?", "ending": f"{base}(.*/)?[^/]*"}[kind]
    return f"^{head}{re.escape(key)}" + ("/.*" if below else "(/.*)?") + "$"


def not_ignored(path: Column, rules: str) -> Column:
    """By the few lines of one ignore text, as a column; the last match wins."""
    hits = [F.when(path.rlike(rule_regex(r)), F.lit(r[4])) for r in ignore_rules(rules)]
    last = F.element_at(F.filter(F.array(F.lit(False), *hits), lambda x: x.isNotNull()), -1)
    return ~last


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path) of the paths (path) that rules (``RULES``) ignore: of all that match, the last one decides.

    A path meets rules by the folders it lies in and by its own parts, so what is compared does not grow
    with the number of rules; regexes alone are tried one by one, in their own folder.
    """
    parts = F.split("path", "/")
    steps = paths.select("path", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("i"))
    upto = lambda n: F.array_join(F.slice("parts", 1, n), "/")
    steps = steps.select("path", "parts", "i", (F.col("i") == F.size("parts")).alias("end"), F.element_at("parts", F.col("i")).alias("part"), upto(F.col("i")).alias("whole"))
    inside = steps.select("path", "end", "part", F.explode(F.transform(F.sequence(F.lit(0), F.col("i") - 1), upto)).alias("folder"))
    dots = F.filter(F.transform(F.sequence(F.lit(1), F.length("part")), lambda k: F.when(F.substr("part", k, F.lit(1)) == ".", F.substr("part", k))), lambda x: x.isNotNull())
    of = lambda kind: rules.filter(F.col("kind") == kind).drop("kind")
    used = {r[0] for r in rules.select("kind").distinct().collect()}
    lower = ~F.col("only_below") | ~F.col("end")
    hits = {
        "name": inside.withColumnRenamed("part", "key").join(of("name"), ["folder", "key"]).filter(lower),
        "ending": inside.filter(F.col("part").contains(".")).select("path", "end", "folder", F.explode(dots).alias("key")).join(of("ending"), ["folder", "key"]).filter(lower),
        "path": steps.select("path", "end", F.col("whole").alias("key")).join(of("path").drop("folder"), "key").filter(lower),
        "glob": inside.filter("end").select("path", "folder").join(of("glob"), "folder").filter(F.expr("path rlike key")),
    }
    found = None
    for own in (h.select("path", "hit", "place") for kind, h in hits.items() if kind in used):
        found = own if found is None else found.unionByName(own)
    if found is None:
        return paths.select("path").limit(0)
    return found.groupBy("path").agg(F.max_by("hit", "place").alias("hit")).filter("hit").select("path")


def not_hidden(path: Column) -> Column:
    return ~path.rlike(r"(^|/)\.")


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        files, base = pafs.FileSystem.from_uri(root.replace("file:/", "file:///", 1) if re.match(r"file:/[^/]", root) else root)
        return files, base.rstrip("/")
    return pafs.LocalFileSystem(), root.rstrip("/")


#: Folders a task lists, about, before a level is dealt to more tasks.
FOLDERS = 32


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, last_modified) of all files under ``root``, hidden ones too; path is relative.

    Level by level: tasks list the folders of one level, and the folders they find are dealt anew to all
    tasks, so a single deep folder is no single task. A level is stored before the next one stands on it.
    """
    schema = "path string, last_modified timestamp, is_folder boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                held = files.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/")))
                held = [x for x in held if x.type in (pafs.FileType.File, pafs.FileType.Directory)]
                yield pa.RecordBatch.from_arrays([pa.array([x.path[len(base) :].lstrip("/") for x in held], pa.string()), pa.array([x.mtime for x in held], pa.timestamp("us", "UTC")), pa.array([not x.is_file for x in held], pa.bool_())], names=["path", "last_modified", "is_folder"])

    level, rows = spark.createDataFrame([("",)], "path string"), None
    count = 1
    while count:
        tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, count // FOLDERS)))
        new = stored(level.repartition(tasks, "path").mapInArrow(run, schema))
        own = new.filter("not is_folder").drop("is_folder")
        rows = own if rows is None else rows.unionByName(own)
        level = new.filter("is_folder").select("path")
        count = level.count()
    return rows


def contents(paths: DataFrame, root: str) -> DataFrame:
    """``paths`` (path, last_modified) with content (null where a file is not UTF-8) and hash of the bytes."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        for batch in batches:
            for k in range(batch.num_rows):
                with files.open_input_file(f"{base}/{batch.column('path')[k].as_py()}") as f:
                    data = f.read()
                try:
                    text = data.decode()
                except UnicodeDecodeError:
                    text = None
                yield pa.RecordBatch.from_arrays([batch.column("path").slice(k, 1), pa.array([text], pa.string()), pa.array([hashlib.sha256(data).hexdigest()]), batch.column("last_modified").slice(k, 1)], names=["path", "content", "hash", "last_modified"])

    return paths.select("path", "last_modified").mapInArrow(run, "path string, content string, hash string, last_modified timestamp")


def tree_rules(files: DataFrame, root: str) -> DataFrame:
    """Rules (``RULES``) of all ignore files of a listing. Inner folders come after outer ones, and overrule
    them; files are read and parsed by tasks."""
    name = F.regexp_extract("path", r"[^/]*$", 0)
    held = contents(files.filter(name.isin(*IGNORE_FILES)), root).filter("content is not null").select("path", "content")
    names = ["folder", "kind", "key", "only_below", "hit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                folder, _, own = path.rpartition("/")
                rows = ignore_rules(text, folder, IGNORE_FILES.index(own))
                place = [dict(zip(("depth", "folder", "source", "line"), r[5])) for r in rows]
                kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                columns.append(pa.array(place, pa.struct([("depth", pa.int32()), ("folder", pa.string()), ("source", pa.int32()), ("line", pa.int32())])))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "place"])

    return held.mapInArrow(run, RULES)


def found(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), ignore: str = "", ignore_files: bool = True) -> DataFrame:
    """(path, last_modified) of the files under ``root`` that are to be read; path is relative.

    Ignore files found in the tree count for their folder and all below (``ignore_files``), ``ignore``
    holds further rules for all of it, which come last.
    """
    every = listed(spark, root)
    rules = spark.createDataFrame(ignore_rules(ignore, depth=1 << 30), RULES)
    if ignore_files:
        rules = rules.unionByName(tree_rules(every, root))
    kept = every.filter(has_text_extension(F.col("path")) & not_hidden(F.col("path")) & keep(F.col("path"), include, exclude))
    return kept.join(ignored(kept.select("path"), stored(rules)), "path", "left_anti")


def walk(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), ignore: str = "", ignore_files: bool = True) -> DataFrame:
    """(path, content, hash, last_modified) of the text files ``found`` under ``root``. Filters run on paths
    before a file is read; files that are not UTF-8 are left out."""
    return contents(found(spark, root, include, exclude, ignore, ignore_files), root).filter("content is not null")
