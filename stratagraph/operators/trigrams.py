"""Substring search by an index of trigrams: posting lists narrow the texts, the scan's own test decides.

Texts lie in parts of about ``part_rows`` rows, one folder each, so reading some parts leaves the others
alone. For every run of three characters in a lower-cased text there are postings (gram, part, rows),
laid out in slots by the gram's hash. A query reads the slots of its own grams only: from the word's
pieces between wildcards come grams, the rarest few are intersected part by part, and only parts with a
row that has them all are read. Each such row is tested like in a full scan, so the rows found are the
same; words too short for a gram do not narrow, and where no word does all parts are read.

Building deals texts as they lie and moves nothing but the postings of the slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import stored
from ..functions.scoring import file_boost
from ..functions.text import has_all_words, like
from .lookup import recent

#: Rows of a part, slots of postings, grams of one word that are intersected.
PART_ROWS, SLOTS, RAREST = 100_000, 64, 4
#: Between the fields of a text; no gram across it says anything, and none is missed.
BETWEEN = "\x00"
#: Postings of a part a task holds before it gives them on, about.
HELD_GRAMS = 1 << 21


def grams_of(text: str) -> np.ndarray:
    """The distinct trigrams of a lower-cased text, each as one number."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(points[:-2] | points[1:-1] << 21 | points[2:] << 42) if len(points) > 2 else np.empty(0, np.int64)


def pieces(word: str) -> list[str]:
    """What stands between the wildcards of a word."""
    return [p for p in word.replace("_", "%").split("%") if p]


def _postings(texts: DataFrame) -> DataFrame:
    """(gram, part, rows) from (part, row, text); one part at a time, or a piece of it, is held by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, grams, rows, held = None, [], [], 0

        def flushed() -> pa.RecordBatch:
            g, r = np.concatenate(grams), np.concatenate(rows)
            order = np.lexsort((r, g))
            g, r = g[order], r[order]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            at = np.concatenate([first, [len(g)]]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(np.full(len(first), part)), pa.ListArray.from_arrays(pa.array(at), pa.array(r.astype(np.int32)))], names=["gram", "part", "rows"])

        for batch in batches:
            for p, row, text in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "text"))):
                if p != part or held > HELD_GRAMS:
                    if held:
                        yield flushed()
                    part, grams, rows, held = p, [], [], 0
                own = grams_of(text)
                grams.append(own)
                rows.append(np.full(len(own), row, np.int32))
                held += len(own)
        if held:
            yield flushed()

    return texts.select("part", "row", "text").mapInArrow(run, "gram long, part long, rows array<int>")


class TrigramIndex:
    """``folder`` on a file system all share holds the texts, their postings and how many rows each gram has."""

    def __init__(self, spark: SparkSession, folder: str, fields: tuple[str, ...] = ("content", "name", "doc"), slots: int = SLOTS):
        self.spark, self.folder, self.fields, self.slots = spark, folder.rstrip("/"), fields, slots

    def build(self, symbols: DataFrame, part_rows: int = PART_ROWS) -> TrigramIndex:
        """Index all rows. What each row is numbered by is where it lies, so nothing is sorted or counted."""
        at = F.monotonically_increasing_id()
        slots, number = self.slots, symbols.withColumn("at", at)
        place = F.shiftright("at", 33) * (1 << 20) + F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / part_rows)
        number.withColumn("part", place.cast("long")).withColumn("row", (F.col("at").bitwiseAND((1 << 33) - 1) % part_rows).cast("int")).drop("at").write.partitionBy("part").parquet(f"{self.folder}/texts")
        texts = self.texts()
        text = F.lower(F.concat_ws(BETWEEN, *[F.coalesce(c, F.lit("")) for c in self.fields]))
        found = _postings(texts.select("part", "row", text.alias("text"))).withColumn("slot", F.pmod(F.xxhash64("gram"), F.lit(slots)).cast("int"))
        # A slot may go to several tasks, so that there are as many as shuffles have.
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        found.repartition(tasks, "slot", F.pmod("part", F.lit(max(1, tasks // slots)))).sortWithinPartitions("slot", "gram", "part").write.partitionBy("slot").parquet(f"{self.folder}/postings")
        postings = self.postings()
        postings.groupBy("slot", "gram").agg(F.sum(F.size("rows")).alias("n")).repartition(min(slots, 8), "slot").sortWithinPartitions("slot", "gram").write.partitionBy("slot").parquet(f"{self.folder}/counts")
        return self

    def texts(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/texts").parquet(f"{self.folder}/texts").withColumn("part", F.col("part").cast("long"))

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")

    def _narrowing(self, words: list[str]) -> list[int] | None:
        """The rarest grams of each word; None: some gram occurs nowhere."""
        wanted: list[set[int]] = [{int(g) for p in pieces(w) for g in grams_of(p)} for w in words]
        every = sorted(set().union(*wanted)) if wanted else []
        if not every:
            return []
        rows = self.spark.createDataFrame([(g,) for g in every], "gram long").select("gram", F.pmod(F.xxhash64("gram"), F.lit(self.slots)).cast("int").alias("slot"))
        self._slots = {r["gram"]: r["slot"] for r in rows.collect()}
        counts = self.spark.read.parquet(f"{self.folder}/counts").filter(F.col("slot").isin(sorted(set(self._slots.values()))) & F.col("gram").isin(every))
        known = {r["gram"]: r["n"] for r in counts.select("gram", "n").collect()}
        if len(known) < len(every):
            return None
        return sorted({g for own in wanted for g in sorted(own, key=lambda g: (known[g], g))[:RAREST]})

    def candidates(self, words: list[str]) -> DataFrame | None:
        """(part, rows) of texts that have the grams of all words (lower-cased); None: the words do not narrow."""
        grams = self._narrowing(words)
        if grams == []:
            return None
        if grams is None:
            return self.spark.createDataFrame([], "part long, rows array<int>")
        own = self.postings().filter(F.col("slot").isin(sorted({self._slots[g] for g in grams})) & F.col("gram").isin(grams))
        # A part that was read in pieces has a row for each of them.
        whole = own.groupBy("part", "gram").agg(F.flatten(F.collect_list("rows")).alias("rows"))
        met = whole.groupBy("part").agg(F.collect_list("rows").alias("lists")).filter(F.size("lists") == len(grams))
        both = F.aggregate(F.slice("lists", 2, len(grams)), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
        return met.select(F.col("part").cast("long").alias("part"), both.alias("rows")).filter(F.size("rows") > 0)

    def narrowed(self, words: list[str]) -> DataFrame:
        """The texts that may hold all words; only their parts are read."""
        words = [r[0] for r in self.spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").orderBy("k").select(F.lower("w")).collect()] if words else []
        found = self.candidates(words)
        texts = self.texts()
        if found is None:
            return texts.drop("part", "row")
        # One number a part, at most as many as the table has folders.
        found = stored(found)
        held = found.select("part", F.explode("rows").alias("row"))
        parts = sorted(r[0] for r in found.select("part").collect())
        if not parts:
            return texts.limit(0).drop("part", "row")
        return texts.filter(F.col("part").isin(parts)).join(held, ["part", "row"], "left_semi").drop("part", "row")

    def search_content(self, query: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        """What ``search.search_content`` finds."""
        words = query.split()
        if not words:
            found = self.texts().drop("part", "row")
            return recent(found if kind is None else found.filter(F.col("kind") == kind), limit)
        found = self.narrowed(words).filter(has_all_words(query, *[F.col(c) for c in self.fields]))
        found = found if kind is None else found.filter(F.col("kind") == kind)
        return found.orderBy(file_boost(F.col("path")).desc(), "path", "line_start", "uri").limit(limit)

    def search_name(self, pattern: str, limit: int = 10) -> DataFrame:
        """What ``search.search_name`` finds."""
        wrapped = pattern if "%" in pattern else f"%{pattern}%"
        score = F.when(F.lower("name") == pattern.lower(), F.lit(1.0)).otherwise(F.lit(0.5))
        return self.narrowed([wrapped]).filter(like(F.col("name"), wrapped)).withColumn("score", score).orderBy(F.desc("score"), "name", "uri").limit(limit)
