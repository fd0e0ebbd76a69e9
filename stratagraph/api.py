"""An index of a source tree: the verbs of the engine as one class over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import SCHEMAS, stored
from .extract.adapters import extract
from .functions.embed import embed_column, embed_query
from .functions.text import callsite_context, callsite_text, head_text, window_starts, window_text
from .operators import link, lookup, maintain, search, stats, tables, traverse
from .sources import config as settings
from .sources import files
from .sources.versioned import VersionedTables, owner_of
from .streaming import incremental


def embed_symbols(symbols: DataFrame) -> DataFrame:
    """(uri, id, vector): the head text of each symbol, and the windows of long contents."""
    head = symbols.select("uri", F.lit(0).alias("at"), head_text(F.col("name"), F.col("kind"), F.col("signature"), F.col("content")).alias("text"))
    body = symbols.select("uri", "name", "content", F.explode(window_starts(F.col("content"))).alias("at"))
    body = body.select("uri", "at", window_text(F.col("content"), F.col("at")).alias("part"), "name").filter(F.trim("part") != "").select("uri", "at", F.concat(F.lit("Context from "), "name", F.lit(": "), "part", F.lit("\n")).alias("text"))
    return tables.number_chunks(head.unionByName(body), "at").select("uri", F.col("id").cast("int").alias("id"), embed_column("text").alias("vector"))


def callsites(references: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(id, from_uri, text) of references: the caller, the lines around the call in the caller's own
    content, and the imports of its file."""
    callers = symbols.select(F.col("uri").alias("from_uri"), F.col("name").alias("caller"), F.coalesce("content", F.lit("")).alias("content"), "line_start")
    entry = F.concat("target_namespace", F.lit(" as "), F.coalesce("alias", F.lit("*")))
    lists = imports.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", entry.alias("e")))), lambda x: x["e"]).alias("imports"))
    found = references.select("id", "from_uri", "file_path", "line").join(callers, "from_uri").join(lists, "file_path", "left")
    context = callsite_context(F.col("content"), F.col("line") - F.col("line_start") + 1)
    return found.select("id", "from_uri", callsite_text(F.col("caller"), context, F.coalesce("imports", F.array().cast("array<string>"))).alias("text"))


class Index:
    """``root`` holds the tables; references stay as parsed and edges are derived from them.

    Indexing replaces what belongs to changed files, linking decides again the references whose names gained
    or lost a symbol since the last time, so both cost what changed.
    """

    def __init__(self, spark: SparkSession, root: str, repo: str = "repo"):
        self.spark, self.repo, self.config = spark, repo, settings.Config()
        self.catalog = VersionedTables(spark, root, schemas={"links": maintain.LINKS, "alike": SCHEMAS["edges"]})

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.catalog.load(name)
        raise AttributeError(name)

    @property
    def references(self) -> DataFrame:
        """References, marked external where the last linking found no symbol for them."""
        outside = self.catalog.load("links").filter("outcome = 'external'")
        return lookup.mark_external(self.catalog.load("references").withColumn("is_external", F.lit(False)), outside)

    @property
    def edges(self) -> DataFrame:
        """Edges from parsing, with those of the last linking merged in."""
        return link.merge_edges(link.merge_edges(self.catalog.load("edges"), link.linked_edges(self.catalog.load("links"))), self.catalog.load("alike"), by_confidence=True)

    @classmethod
    def open(cls, spark: SparkSession, base: str, database: str | None = None, repo: str | None = None) -> Index:
        """The index of the folder ``base``, by its settings file where it has one."""
        found = settings.load(settings.default_path(base))
        index = cls(spark, settings.resolve_database(database, found, base), settings.resolve_repo(repo, found, base))
        index.config = found
        return index

    def index(self, path: str, include: list[str] | None = None, exclude: list[str] | None = None, ignore: str = "", force: bool = False) -> DataFrame:
        """Bring the tables up to date with a folder; (status, n, percent) of its files. Without
        ``include`` or ``exclude`` the settings' patterns count. Files are read where their time of change
        is not the known one, or with ``force``."""
        include, exclude = self.config.include if include is None else include, self.config.exclude if exclude is None else exclude
        listing = stored(files.found(self.spark, path, list(include), list(exclude), ignore))
        change = self.catalog.begin()
        known = self.catalog.load("file_hash", change.began)
        same = listing.join(known.limit(0) if force else known, ["path", "last_modified"], "left_semi")
        read = stored(files.contents(listing.join(same.select("path"), "path", "left_anti"), path).filter("content is not null"))
        seen = known.join(same.select("path"), "path", "left_semi").select("path", "hash").unionByName(read.select("path", "hash"))
        status = stored(tables.change_status(seen, known.limit(0) if force else known))
        new = read.join(status.filter("status in ('new', 'modified')").select("path"), "path", "left_semi")
        touched = stored((known.select("path").unionByName(new.select("path")) if force else status.filter("status <> 'unchanged'").select("path")).select(F.col("path").alias("owner")).distinct())
        if not touched.isEmpty():
            rows = extract(new, self.repo)
            rows["embeddings"] = embed_symbols(rows["symbols"])
            rows["file_hash"] = new.select("path", "hash", "last_modified")
            change.replace(touched, **{name: rows[name] for name in maintain.OF_FILES}).commit()
            self.catalog.compact()
        return stats.outcome_counts(status, "status")

    def link(self) -> int:
        """Bring ``links`` up to date; how many references were decided."""
        return maintain.link_changes(self.catalog)

    def linked(self) -> DataFrame:
        self.link()
        return self.catalog.load("links")

    def resolved_edges(self) -> DataFrame:
        """Edges with all linkable references merged in."""
        self.link()
        return link.merge_edges(self.catalog.load("edges"), link.linked_edges(self.catalog.load("links")))

    def resolve(self, threshold: float = 0.6) -> DataFrame:
        """Link by rules, then by likeness of call sites; returns outcome counts.

        Stores how references were linked, the edges by likeness, the candidates of ambiguous references and
        the vectors of call sites.
        """
        self.link()
        linked, references, symbols, parsed = (self.catalog.load(name) for name in ("links", "references", "symbols", "edges"))
        edges = stored(link.merge_edges(parsed, link.linked_edges(linked)))
        open_ = linked.filter("outcome <> 'resolved'").select("id").join(references, "id")
        sites = stored(callsites(open_, symbols, self.imports).select("id", "from_uri", embed_column("text").alias("vector")))
        ambiguous = link.ambiguous_rows(linked, references, symbols, parsed)
        self.catalog.commit(
            {
                "alike": link.semantic_link(sites, self.embeddings, edges, threshold),
                "ambiguous_references": ambiguous.withColumn("id", F.xxhash64("reference_id", "candidate_uri")),
                "callsite_embeddings": sites.select(F.xxhash64("id").alias("id"), F.col("id").alias("reference_id"), "vector"),
            }
        )
        return stats.outcome_counts(linked)

    def search(self, query: str, limit: int = 10, kind: str | None = None, exact: bool = False) -> DataFrame:
        return search.search(self.symbols, self.embeddings, query, embed_query, kind, exact, limit, fill=self.embed)[1]

    def embed(self) -> DataFrame:
        """Vectors for symbols without any; only the files these are in are written."""
        change = self.catalog.begin()
        held = self.catalog.load("embeddings", change.began)
        new = stored(embed_symbols(lookup.without_embedding(self.symbols, held)).withColumn("owner", owner_of("embeddings")))
        touched = stored(new.select("owner").distinct())
        if not touched.isEmpty():
            old = self.catalog.load_changed("embeddings", touched, change.began).withColumn("owner", owner_of("embeddings"))
            change.replace(touched, embeddings=old.unionByName(new)).commit()
        return self.embeddings

    def callers(self, uri: str, depth: int = 1) -> DataFrame:
        return traverse.callers(self.symbols, stored(self.resolved_edges()), uri, depth)

    def callees(self, uri: str, depth: int = 1) -> DataFrame:
        return traverse.callees(self.symbols, stored(self.resolved_edges()), uri, depth)

    def trace(self, uri: str, depth: int = 1) -> DataFrame:
        return traverse.trace(self.symbols, stored(self.resolved_edges()), uri, depth)

    def impact(self, uri: str, depth: int = 3) -> DataFrame:
        return traverse.impact_report(self.symbols, stored(self.resolved_edges()), uri, depth)

    def analyze(self, uri: str) -> DataFrame:
        found = traverse.analyze(self.symbols, self.resolved_edges()).filter(F.col("uri") == uri)
        if found.isEmpty():
            raise LookupError(uri)
        return found

    def stats(self) -> DataFrame:
        """Counts of all tables; a reference is unresolved while no rule resolves it and it is not external."""
        resolved = self.linked().filter("outcome = 'resolved'").select("id")
        return stats.db_stats(self.symbols, self.edges, self.embeddings, lookup.delete_references(self.references, resolved), self.imports, self.callsite_embeddings)

    def watch(self, path: str, checkpoint: str, seconds: float = 1.0):
        """Follow a folder: files made, changed and removed there come into the tables, linked and
        embedded, until the returned streaming query is stopped. What is known of the files is
        stored with the tables, so a watch goes on where the last one ended."""
        return incremental.follow(self.spark, lambda: self._follow(path), checkpoint, seconds)

    def _follow(self, path: str) -> None:
        changed = {r["status"] for r in self.index(path).collect()} - {"unchanged"}
        if changed:
            self.resolve()
