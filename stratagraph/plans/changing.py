"""The event table as files that change: versioned tables and incremental linking, held against what one
pass over the last state gives."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import shared_dir, stored
from ..functions.uri import build
from ..operators import maintain
from ..sources import versioned
from ..sources.versioned import VersionedTables
from ..streaming import incremental
from .project import Tables

#: Steps in which the events arrive, by equal spans of time.
STEPS = 3

#: The files after all events, and what is in a file of user u with content h: a container with one
#: callable, and another callable; six references of which most can be found by some rule; an import.
FILES_SQL = """
with state as (
  select user_id as u, path, hash, cast(hash as bigint) as h from (select user_id, path, hash, row_number() over (partition by path order by ts desc, event_id desc) as r
    from (select event_id, ts, user_id, cast(user_id as varchar) as path, case when event_type <> 'error' then cast(cast(floor(value / 50) as bigint) as varchar) end as hash from events)) where r = 1 and hash is not null
), rows as (
  select u, h, 'u' || u || '.py' as file, 'codescope://ev/u' || u || '.py#' as base from state
), symbols as (
  select base || 'container:C' || u || '@1' as uri, 'container' as kind, 'C' || u as name, file as path from rows
  union all select base || 'callable:f' || (u + h) || '@2', 'callable', 'f' || (u + h), file from rows
  union all select base || 'callable:g' || h || '@3', 'callable', 'g' || h, file from rows
), edges as (
  select base || 'container:C' || u || '@1' as from_uri, base || 'callable:f' || (u + h) || '@2' as to_uri, 'contains' as kind from rows
), refs as (
  select u * 10 + k as id, base || 'callable:g' || h || '@3' as from_uri, 'call' as ref_kind, file as file_path,
    case k when 0 then 'f' || (u + 2 * h) when 1 then 'g' || h when 2 then 'f' || (u + h) when 3 then 'x' || h when 4 then 'f' || (u + h + 1) else 'g' || (h + 1) end as name,
    case k when 4 then 'C' || (u + 1) when 5 then 'm' end as receiver
  from rows, (select unnest(range(6)) as k)
), imports as (
  select u as id, file as file_path, 'm' as alias, 'u' || (u + 2) || '.py' as target_namespace from rows
)"""


def contents(state: DataFrame) -> dict[str, DataFrame]:
    """The tables of files (path, hash), as an extractor would give them."""
    u, h = F.col("path").cast("bigint"), F.col("hash").cast("bigint")
    named = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    file = F.concat(F.lit("u"), "path", F.lit(".py"))
    rows = stored(state.select(u.alias("u"), h.alias("h"), file.alias("file")))
    u, h, file = F.col("u"), F.col("h"), F.col("file")
    at = lambda kind, name, line: build("ev", file, F.lit(kind), name, F.lit(line))
    box, inner, outer = named("C", u), named("f", u + h), named("g", h)
    symbol = lambda kind, name, line: rows.select(at(kind, name, line).alias("uri"), F.lit(kind).alias("kind"), name.alias("name"), file.alias("path"), F.lit(line).alias("line_start"), F.lit(line).alias("line_end"), *[F.lit(None).cast("string").alias(c) for c in ("doc", "signature", "content")])
    pairs = [(named("f", u + 2 * h), None), (outer, None), (inner, None), (named("x", h), None), (named("f", u + h + 1), named("C", u + 1)), (named("g", h + 1), F.lit("m"))]
    calls = F.array(*[F.struct(F.lit(k).alias("k"), name.alias("name"), (F.lit(None).cast("string") if receiver is None else receiver).alias("receiver")) for k, (name, receiver) in enumerate(pairs)])
    refs = rows.select("u", at("callable", outer, 3).alias("from_uri"), file.alias("file_path"), F.explode(calls).alias("c"))
    return {
        "symbols": symbol("container", box, 1).unionByName(symbol("callable", inner, 2)).unionByName(symbol("callable", outer, 3)),
        "edges": rows.select(at("container", box, 1).alias("from_uri"), at("callable", inner, 2).alias("to_uri"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"), F.lit("static").alias("resolution_mode")),
        "references": refs.select((F.col("u") * 10 + F.col("c.k")).alias("id"), "from_uri", "c.name", "c.receiver", F.lit(0).cast("bigint").alias("scope_id"), "file_path", F.lit(3).alias("line"), F.lit("call").alias("ref_kind"), F.lit(False).alias("is_external")),
        "imports": rows.select(F.col("u").alias("id"), file.alias("file_path"), F.lit("m").alias("alias"), F.concat(F.lit("u"), (u + 2).cast("string"), F.lit(".py")).alias("target_namespace"), F.lit(1).alias("line")),
    }


def steps_of(events: DataFrame, steps: int = STEPS) -> list[DataFrame]:
    """The last event of each path in each of ``steps`` equal spans of time: (path, hash or null)."""
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        return []
    cuts = [lo + (hi - lo) * k / steps for k in range(steps + 1)]
    inside = lambda a, b: events.filter((F.col("ts") >= F.lit(a) if a == lo else F.col("ts") > F.lit(a)) & (F.col("ts") <= F.lit(b)))
    return [incremental.latest(inside(a, b)).select("path", "hash") for a, b in zip(cuts, [*cuts[1:-1], hi])]


def followed(t: Tables, link: bool) -> VersionedTables:
    """Versioned tables brought through all steps, linked after each one."""
    store = VersionedTables(t.spark, f"{shared_dir(t.spark)}/stratagraph-core/versioned-{uuid.uuid4().hex}", schemas={"links": maintain.LINKS})
    for step in steps_of(stored(t.events())):
        step = stored(step)
        versioned.apply(store, step.select(F.concat(F.lit("u"), "path", F.lit(".py")).alias("owner")), contents(step.filter("hash is not null")))
        if link:
            maintain.link_changes(store)
    return store


def s10_delta_tables(t: Tables) -> DataFrame:
    """Rows of all tables after the changes, some buckets merged on the way."""
    store = followed(t, False)
    store.compact(4)
    symbols = store.load("symbols").select(F.lit("symbols").alias("tab"), "uri", F.col("name").alias("value"))
    refs = store.load("references").select(F.lit("references").alias("tab"), F.col("from_uri").alias("uri"), F.concat_ws(":", "id", "name").alias("value"))
    return symbols.unionByName(refs)


def l11_incremental_links(t: Tables) -> DataFrame:
    """The outcome of every reference, decided again only where a change can matter."""
    return followed(t, True).load("links").select("id", "from_uri", "rule", "n", "uri", "outcome")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for f in (s10_delta_tables, l11_incremental_links)}


def oracle_sql(link_sql: str) -> dict[str, str]:
    """``link_sql``: the rules over symbols, edges, refs and imports."""
    return {
        "s10_delta_tables": FILES_SQL + " select 'symbols' as tab, uri, name as value from symbols union all select 'references', from_uri, id || ':' || name from refs",
        "l11_incremental_links": FILES_SQL + link_sql.replace("with held", ", held", 1) + "select id, from_uri, rule, n, uri, outcome from linked",
    }
