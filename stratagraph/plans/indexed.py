"""Searches of the test tables through stored indexes; the SQL is that of a full scan."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import shared_dir, stored
from ..functions.scoring import file_boost
from ..operators.trigrams import TrigramIndex
from ..operators.vector_index import VectorIndex
from .project import SQL, Tables

#: Rows of a part, so that the smallest tables have many.
PART_ROWS = 256
#: Parts (folders), about, of a larger table: its parts grow, not their number.
PARTS = 1024

_BOOST = "case when regexp_matches(lower(path), '\\.(rs|py|js|ts|tsx|jsx|go|c|cpp|h)$') then 1.2 when regexp_matches(lower(path), '\\.(md|txt)$') or lower(path) like '%readme%' then 0.9 when regexp_matches(lower(path), '\\.(json|yaml|yml|toml)$') then 0.7 else 1.0 end"
_COS = "list_cosine_similarity(cast({} as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 0))"


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/stratagraph-core/{name}-{uuid.uuid4().hex}"


def _texts(t: Tables) -> TrigramIndex:
    rows = stored(t.symbols().unionByName(t.documents()))
    return TrigramIndex(t.spark, _folder(t, "trigrams"), slots=16).build(rows, max(PART_ROWS, -(-rows.count() // PARTS)))


def q01_indexed_search(t: Tables) -> DataFrame:
    """Q1 by trigrams: all symbols and documents are indexed, the parts that can hold both words are read."""
    return _texts(t).search_content("00007 supplier#", None, 20).select("uri", "path")


def q05_indexed_name(t: Tables) -> DataFrame:
    """Q5 by trigrams, with a wildcard inside."""
    return _texts(t).search_name("customer#%0042", 12).select("uri", "score")


def q02_indexed_vectors(t: Tables) -> DataFrame:
    """Q2 by clusters of vectors."""
    rows = t.embeddings().join(t._keyed().select("uri", "path"), "uri")
    index = VectorIndex(t.spark, _folder(t, "vectors")).build(stored(rows), "uri", factor=file_boost(F.col("path")), centres=32)
    return index.top(_first(t), 10).rows.select(F.col("key").alias("uri"), F.round("score", 6).alias("score"))


def q10_indexed_chunks(t: Tables) -> DataFrame:
    """Q10 by clusters of vectors."""
    index = VectorIndex(t.spark, _folder(t, "vectors")).build(t("embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id", centres=32)
    return index.top(_first(t), 5).rows.select(F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


def _first(t: Tables) -> list[float]:
    return t("embeddings").filter("vec_id = 0").first()["embedding"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for f in (q01_indexed_search, q05_indexed_name, q02_indexed_vectors, q10_indexed_chunks)}


def oracle_sql() -> dict[str, str]:
    return {
        "q01_indexed_search": SQL + f"select uri, path from (select * from symbols union all select * from docs) where (content ilike '%00007%' or name ilike '%00007%') and (content ilike '%supplier#%' or name ilike '%supplier#%') order by {_BOOST} desc, path, line_start, uri limit 20",
        "q05_indexed_name": SQL + "select uri, 0.5::double as score from (select * from symbols union all select * from docs) where name ilike 'customer#%0042' order by name, uri limit 12",
        "q02_indexed_vectors": SQL + f"select uri, round(score, 6) as score from (select uri, max({_COS.format('vector')}) * any_value({_BOOST}) as score from vectors join symbols using (uri) group by uri) order by score desc, uri limit 10",
        "q10_indexed_chunks": f"select vec_id, round({_COS.format('embedding')}, 6) as score from embeddings order by {_COS.format('embedding')} desc, vec_id limit 5",
    }
