"""The tables of an index as base and delta files in hash buckets, under a numbered commit log.

Every row belongs to an *owner*, the file it was made from (or whatever else is replaced as a whole).
A change of some owners writes their new rows and a mark for each of them, in the owners' buckets and
nowhere else; a read takes, for each owner, the rows of the latest commit that marked it. What a change
costs depends on what changed, not on what the tables hold. ``compact`` merges the buckets that have
gathered many deltas.

Each commit is one file ``log/<number>.json`` that names all live folders. It appears under its number
only if no other file has that number, so of two writers one is first; the other looks at what was
committed since it began. Where nobody wrote a bucket it read or wrote its commit goes to the next
number, else it fails with ``Conflict`` and leaves no trace: no update is ever lost. Readers see one
commit or another, never half of one.

All of it goes through Hadoop's file systems; Spark reads, joins and writes the rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import SCHEMAS, stored

#: Buckets of a table; a change of one owner writes one of them. A few for each executor core is enough.
BUCKETS = 16
#: Tables replaced together: one mark of an owner counts for all of a group, so whoever replaces an owner's
#: rows in one of them gives those of all. A table of no group is one by itself.
GROUPS = {name: "files" for name in ("symbols", "edges", "references", "imports", "file_hash")}
#: Folders of one bucket from which ``compact`` merges it.
MANY = 8
#: Attempts of a commit that only ever meets changes elsewhere.
ATTEMPTS = 100


def owner_of(name: str) -> Column:
    """The file a row of each table comes from."""
    of_uri = lambda c: F.regexp_extract(c, r"^[a-z]+://[^/#]*/([^#]*)#", 1)
    column = {"symbols": F.col("path"), "edges": of_uri("from_uri"), "alike": of_uri("from_uri"), "embeddings": of_uri("uri"), "references": F.col("file_path"), "imports": F.col("file_path"), "file_hash": F.col("path"), "ambiguous_references": F.col("reference_id").cast("string"), "callsite_embeddings": F.col("reference_id").cast("string")}
    return column[name]


class Conflict(Exception):
    """Another writer has committed to the same buckets."""


class Log:
    """Small JSON files with running numbers, each made in one step and only where its number is free."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root

    def _place(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        place, files = self._place(folder)
        return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names(self.root) if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> int:
        return max(self.numbers(), default=0)

    def remove(self, path: str) -> None:
        place, files = self._place(path)
        files.delete(place, True)

    def path(self, number: int) -> str:
        return f"{self.root}/{number:012d}.json"

    def read(self, number: int) -> dict:
        place, files = self._place(self.path(number))
        stream = files.open(place)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, number: int, value: dict) -> bool:
        """Whether the number was free and is now taken by ``value``."""
        draft, files = self._place(f"{self.root}/.{uuid.uuid4().hex}")
        stream = files.create(draft)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        draft, target = files.makeQualified(draft), files.makeQualified(self._place(self.path(number))[0])
        try:
            if target.toUri().getScheme() == "file":
                # A rename on a local disk replaces what is there; a hard link does not.
                local = self.jvm.java.nio.file.Paths
                self.jvm.java.nio.file.Files.createLink(local.get(target.toUri()), local.get(draft.toUri()))
                return True
            return files.rename(draft, target)
        except Exception:
            if not files.exists(target):
                raise
            return False
        finally:
            files.delete(draft, False)


@dataclass
class Change:
    """What one writer is about to commit, against the version it began at."""

    store: VersionedTables
    began: int
    state: dict
    added: dict[str, dict[str, list[int]]] = field(default_factory=dict)
    dropped: dict[str, list[int] | None] = field(default_factory=dict)
    read: dict[str, list[int]] = field(default_factory=dict)
    notes: dict[str, int] = field(default_factory=dict)

    def _write(self, name: str, rows: DataFrame) -> None:
        """Rows with their owner, in a new folder of this change."""
        spark, tx = self.store.spark, uuid.uuid4().hex
        folder = f"{self.store.root}/{name}/tx={tx}"
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64("owner"), F.lit(self.state["buckets"])).cast("int"))
        # One task writes a bucket, so a change makes one file in each bucket it touches.
        placed.repartition(min(self.state["buckets"], int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").write.partitionBy("bucket").parquet(folder)
        made = [int(n.removeprefix("bucket=")) for n in self.store.log.names(folder) if n.startswith("bucket=")]
        if made:
            self.added.setdefault(name, {})[tx] = sorted(made)

    def _rows(self, name: str, rows: DataFrame) -> None:
        rows = rows if "owner" in rows.columns else rows.withColumn("owner", owner_of(name))
        self._write(name, rows.select(*self.store.columns(name), F.col("owner").cast("string").alias("owner")))

    def replace(self, owners: DataFrame, **rows: DataFrame) -> Change:
        """All rows of ``owners`` (owner) in the groups of the tables given are replaced by these rows, which may
        bring an owner column, else the table's own counts. Owners without new rows have none any more."""
        for marks in sorted({self.store.marks(name) for name in rows}):
            self._write(marks, owners.select(F.col("owner").cast("string").alias("owner")).distinct())
        for name, df in rows.items():
            self._rows(name, df)
        return self

    def overwrite(self, name: str, rows: DataFrame) -> Change:
        """The whole table is replaced."""
        self._rows(name, rows)
        self.dropped[name] = None
        return self

    def touched(self) -> dict[str, set[int] | None]:
        """Buckets of each table this change writes or rests on; None: all of them."""
        out: dict[str, set[int] | None] = {}
        for name in self.store.schemas:
            marks = self.store.marks(name)
            found: set[int] = set(self.dropped.get(name) or ()) | set(self.read.get(name, ()))
            for part in (name, marks):
                for buckets in self.added.get(part, {}).values():
                    found |= set(buckets)
            if name in self.dropped and self.dropped[name] is None:
                out[name] = None
            elif found:
                out[name] = found
        return out

    def commit(self) -> int:
        """The version this change became."""
        own = self.touched()
        seen, state = self.began, self.state
        for _ in range(ATTEMPTS):
            for number in range(seen + 1, self.store.log.last() + 1):
                state = self.store.log.read(number)
                for name, buckets in state["touched"].items():
                    if name in own and (buckets is None or own[name] is None or set(buckets) & own[name]):
                        raise Conflict(f"version {number} wrote to {name} as well")
                seen = number
            new = {"buckets": state["buckets"], "tables": {}, "order": dict(state["order"]), "touched": {n: None if b is None else sorted(b) for n, b in own.items()}, "notes": state.get("notes", {}) | self.notes}
            for name in {*state["tables"], *self.added}:
                gone = self.dropped.get(name, [])
                kept = {} if gone is None else {tx: left for tx, held in state["tables"].get(name, {}).items() if (left := [b for b in held if b not in gone])}
                new["tables"][name] = kept | self.added.get(name, {})
            for held in self.added.values():
                new["order"] |= {tx: seen + 1 for tx in held}
            live = {tx for held in new["tables"].values() for tx in held}
            cut = {tx for name, held in new["tables"].items() for tx, own in held.items() if tx in state["tables"].get(name, {}) and len(own) < len(state["tables"][name][tx])}
            new["partial"] = sorted((cut | set(state.get("partial", []))) & live)
            new["order"] = {tx: n for tx, n in new["order"].items() if tx in live}
            if self.store.log.add(seen + 1, new):
                return seen + 1
        raise Conflict("too many writers")


class VersionedTables:
    """``root``: a folder on a file system all share; ``schemas``: further tables by name."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, schemas: dict[str, str] | None = None, groups: dict[str, str] | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.schemas = {**SCHEMAS, **(schemas or {})}
        self.groups = GROUPS if groups is None else groups
        self.log = Log(spark, f"{self.root}/log")

    def marks(self, name: str) -> str:
        return f"{self.groups.get(name, name)}.marks"

    def columns(self, name: str) -> list[str]:
        return self._empty(name).columns

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.schemas[name])

    def state(self, version: int | None = None) -> tuple[int, dict]:
        number = self.log.last() if version is None else version
        return number, self.log.read(number) if number else {"buckets": self.buckets, "tables": {}, "order": {}, "touched": {}}

    def begin(self) -> Change:
        return Change(self, *self.state())

    def _folders(self, name: str, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of all live folders, each with its version, bucket and owner."""
        held = state["tables"].get(name, {})
        # A folder that lives as a whole is listed as one.
        whole = lambda tx: buckets is None and tx not in state.get("partial", [])
        paths = [f"{self.root}/{name}/tx={tx}{end}" for tx, own in held.items() for end in ([""] if whole(tx) else [f"/bucket={b}" for b in own if buckets is None or b in buckets])]
        if not paths:
            return None
        schema = "owner string" if name.endswith(".marks") else self.schemas[name] + ", owner string"
        rows = self.spark.read.schema(schema + ", tx string, bucket int").option("basePath", f"{self.root}/{name}").parquet(*paths)
        order = F.create_map(*[F.lit(x) for tx in held for x in (tx, state["order"][tx])])
        return rows.withColumn("version", order[F.col("tx")]).drop("tx")

    def rows(self, name: str, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """Live rows with their owner. Marks are those since the last merge of a bucket; owners without one
        keep what their bucket holds."""
        found = self._folders(name, state, buckets)
        marks = self._folders(self.marks(name), state, buckets)
        if found is None or marks is None:
            return found
        latest = marks.groupBy("bucket", "owner").agg(F.max("version").alias("since"))
        return found.join(latest, ["bucket", "owner"], "left").filter("since is null or version >= since").drop("since")

    def load(self, name: str, version: int | None = None) -> DataFrame:
        found = self.rows(name, self.state(version)[1])
        return self._empty(name) if found is None else found.select(*self.columns(name))

    def load_owned(self, name: str, owners: list[str]) -> DataFrame:
        """Rows of a few owners: only their buckets are read."""
        _, state = self.state()
        at = F.pmod(F.xxhash64("owner"), F.lit(state["buckets"])).cast("int")
        frame = self.spark.createDataFrame([(x,) for x in owners], "owner string")
        found = self.rows(name, state, sorted({r[0] for r in frame.select(at).collect()}))
        return self._empty(name) if found is None else found.filter(F.col("owner").isin(owners)).select(*self.columns(name))

    def changed(self, names: list[str], since: int) -> DataFrame | None:
        """(owner) of what commits after version ``since`` replaced in any of the tables; None where one of
        them was replaced as a whole."""
        now, _ = self.state()
        paths: list[DataFrame] = []
        if max(since, 1) < min(self.log.numbers(), default=1):
            return None
        for number in range(since + 1, now + 1):
            state = self.log.read(number)
            if any(state["touched"].get(name, ()) is None for name in names):
                return None
            for marks in sorted({self.marks(name) for name in names}):
                held = {tx: own for tx, own in state["tables"].get(marks, {}).items() if state["order"][tx] == number}
                if held:
                    paths.append(self._folders(marks, {"tables": {marks: held}, "order": state["order"]}).select("owner"))
        out = self.spark.createDataFrame([], "owner string")
        for p in paths:
            out = out.unionByName(p)
        return out.distinct()

    def buckets_of(self, owners: DataFrame) -> list[int]:
        """Buckets of the owners (owner): a number each at most."""
        _, state = self.state()
        return sorted(r[0] for r in owners.select(F.pmod(F.xxhash64("owner"), F.lit(state["buckets"])).cast("int")).distinct().collect())

    def load_changed(self, name: str, owners: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of the owners (owner), at some version; other buckets are not read."""
        found = self.rows(name, self.state(version)[1], self.buckets_of(owners))
        return self._empty(name) if found is None else found.join(owners, "owner", "left_semi").select(*self.columns(name))

    def load_all(self) -> dict[str, DataFrame]:
        return {name: self.load(name) for name in self.schemas}

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Whole tables become current together."""
        change = self.begin()
        for name, df in tables.items():
            change.overwrite(name, df)
        return change.commit()

    def compact(self, many: int = MANY) -> int:
        """Merge every bucket of which a table has ``many`` folders or more; how many buckets were merged."""
        change = self.begin()
        merged, held = 0, change.state["tables"]
        for marks in sorted({self.marks(name) for name in held if not name.endswith(".marks")}):
            names = [n for n in held if not n.endswith(".marks") and self.marks(n) == marks]
            most: dict[int, int] = {}
            for part in (*names, marks):
                count: dict[int, int] = {}
                for own in held.get(part, {}).values():
                    for b in own:
                        count[b] = count.get(b, 0) + 1
                most |= {b: max(n, most.get(b, 0)) for b, n in count.items()}
            full = sorted(b for b, n in most.items() if n >= many)
            if not full:
                continue
            merged += len(full)
            for name in names:
                live = self.rows(name, change.state, full)
                if live is not None:
                    change._write(name, live.select(*self.columns(name), "owner"))
                change.dropped[name] = full
            change.dropped[marks] = full
        if merged:
            change.commit()
        return merged

    def vacuum(self, keep: int = 10) -> int:
        """Remove what only versions before the last ``keep`` hold; how many folders went. Those versions can no
        longer be read. What writers have not committed yet is named by no version and stays."""
        now = self.log.last()
        old = [n for n in self.log.numbers() if n <= now - max(keep, 1)]
        held = lambda n: {(name, tx) for name, own in self.log.read(n)["tables"].items() for tx in own}
        gone = set().union(*map(held, old)) - set().union(*map(held, range(max(now - max(keep, 1), 0) + 1, now + 1))) if old else set()
        # Versions go first, so that no reader finds one whose folders are gone.
        for n in old:
            self.log.remove(self.log.path(n))
        for name, tx in gone:
            self.log.remove(f"{self.root}/{name}/tx={tx}")
        return len(gone)

    def written(self, version: int) -> dict[str, list[str]]:
        """Folders that a version brought, by table."""
        state = self.log.read(version)
        return {name: [f"tx={tx}/bucket={b}" for tx, own in held.items() if state["order"][tx] == version for b in own] for name, held in state["tables"].items()}

    def register_views(self, prefix: str = "") -> None:
        for name, df in self.load_all().items():
            df.createOrReplaceTempView(f"{prefix}{name}")


def apply(store: VersionedTables, owners: DataFrame, rows: dict[str, DataFrame]) -> int:
    """Replace all rows of ``owners`` (owner) in the tables of ``rows``, in one commit."""
    return store.begin().replace(stored(owners), **rows).commit()
