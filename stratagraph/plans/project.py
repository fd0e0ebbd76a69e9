"""The star-schema test tables seen as a code graph: symbols, edges, references, imports, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.uri import build

REPO = "tpch"

#: Line items a task takes, about, and rows up to which a side of addresses is sent to all.
TASK_ROWS, SENT_ROWS = 500_000, 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nation(t) -> DataFrame:
    return t("nation").select("n_nationkey", "n_name", F.concat(F.lit("geo/"), "n_name", F.lit(".rs")).alias("path"))


class Tables:
    """The projection of one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._line_items = spark, sf_dir, None

    def __call__(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    def _keyed(self) -> DataFrame:
        """All symbols but documents, with table and key they come from."""
        nation = _nation(self)
        geo = lambda df, key: df.join(nation, F.col(key) == F.col("n_nationkey"))
        rows = [
            self("region").select(F.lit("region").alias("t"), F.col("r_regionkey").cast("bigint").alias("key"), F.lit("namespace").alias("kind"), F.col("r_name").alias("name"), F.concat(F.lit("geo/"), "r_name", F.lit(".md")).alias("path"), F.lit(1).alias("line")),
            nation.select(F.lit("nation"), F.col("n_nationkey").cast("bigint"), F.lit("container"), "n_name", "path", F.col("n_nationkey") + 1),
            geo(self("supplier"), "s_nationkey").select(F.lit("supplier"), "s_suppkey", F.lit("callable"), "s_name", "path", F.col("s_suppkey") + 100),
            geo(self("customer"), "c_nationkey").select(F.lit("customer"), "c_custkey", F.lit("callable"), "c_name", "path", F.col("c_custkey") + 100000),
            self("part").select(F.lit("part"), "p_partkey", F.lit("value"), "p_name", F.concat(F.lit("part/"), "p_brand", F.lit(".json")), F.col("p_partkey") + 1),
        ]
        out = rows[0]
        for r in rows[1:]:
            out = out.union(r)
        return out.withColumn("line", F.col("line").cast("int")).withColumn("uri", build(REPO, F.col("path"), F.col("kind"), F.col("name"), F.col("line")))

    def symbols(self) -> DataFrame:
        return self._keyed().select("uri", "kind", "name", "path", F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.lit(None).cast("string").alias("doc"), F.lit(None).cast("string").alias("signature"), F.col("name").alias("content"))

    def documents(self) -> DataFrame:
        name, path, line = F.concat(F.lit("doc_"), F.col("doc_id")), F.concat(F.lit("docs/"), "source", F.lit(".md")), F.col("doc_id") + 1
        d = self("documents").select(name.alias("name"), path.alias("path"), line.alias("line"), F.col("text").alias("content"))
        return d.select(build(REPO, F.col("path"), F.lit("document"), F.col("name"), F.col("line")).alias("uri"), F.lit("document").alias("kind"), "name", "path", F.col("line").cast("int").alias("line_start"), F.col("line").cast("int").alias("line_end"), F.lit(None).cast("string").alias("doc"), F.lit(None).cast("string").alias("signature"), "content")

    def _dealt(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Rows that grow with the line items, dealt by ``columns`` to as many tasks as these need, where shuffles
        have fewer, so that what a task holds does not grow with the tables."""
        if self._line_items is None:
            self._line_items = self("lineitem").count()
        tasks = -(-self._line_items // TASK_ROWS)
        return rows.repartition(tasks, *columns) if tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else rows

    def _items(self) -> DataFrame:
        return self("orders").join(self._dealt(self("lineitem"), "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))

    def edges(self) -> DataFrame:
        k = self._keyed().select("t", "key", "uri")
        of = lambda t, name: k.filter(F.col("t") == t).select(F.col("key").alias(f"{name}_key"), F.col("uri").alias(name))
        link = lambda df, a, b, side=lambda s: s: df.join(of(a[0], "from_uri"), F.col(a[1]) == F.col("from_uri_key")).join(side(of(b[0], "to_uri")), F.col(b[1]) == F.col("to_uri_key"))
        row = lambda df, kind, confidence: df.select("from_uri", "to_uri", F.lit(kind).alias("kind"), confidence.cast("double").alias("confidence"), F.lit("static").alias("resolution_mode"))
        one = F.lit(1.0)
        items = self._items()
        status = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.9).otherwise(0.7)
        # By customer alone, so that the pairs lie as the customers' addresses are joined.
        ordered = self._dealt(items.select("o_custkey", "l_suppkey", status.alias("c")), "o_custkey").groupBy("o_custkey", "l_suppkey").agg(F.max("c").alias("c"))
        supplier = self("supplier")
        sent = F.broadcast if supplier.count() <= SENT_ROWS else lambda df: df
        count = supplier.agg(F.count("*").alias("n"))
        ring = supplier.select("s_suppkey").crossJoin(count).select("s_suppkey", ((F.col("s_suppkey") * 7 + 3) % F.col("n")).alias("target")).filter("s_suppkey <> target")
        returned = self._dealt(items.filter("l_returnflag = 'R'").select("o_custkey", "l_partkey"), "o_custkey").distinct()
        parts = self("part").filter("p_partkey > 0").select("p_partkey", F.floor(F.col("p_partkey") / 2).alias("half"))
        rows = [
            row(link(self("nation"), ("region", "n_regionkey"), ("nation", "n_nationkey")), "defines", one),
            row(link(supplier, ("nation", "s_nationkey"), ("supplier", "s_suppkey")), "contains", one),
            row(link(self("customer"), ("nation", "c_nationkey"), ("customer", "c_custkey")), "contains", one),
            row(link(ordered, ("customer", "o_custkey"), ("supplier", "l_suppkey"), sent), "calls", F.col("c")),
            row(link(ring, ("supplier", "s_suppkey"), ("supplier", "target")), "calls", one),
            row(link(returned, ("customer", "o_custkey"), ("part", "l_partkey")), "references", F.lit(0.8)),
            row(link(parts, ("part", "p_partkey"), ("part", "half")), "inherits", one),
        ]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def references(self) -> DataFrame:
        """One reference an order: to its supplier (with or without receiver), its part or its priority."""
        least = self("lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("i"))
        nation = _nation(self)
        supplier = self("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", F.col("n_name").alias("s_nation"))
        customer = self._keyed().filter("t = 'customer'").select(F.col("key").alias("o_custkey"), F.col("uri").alias("from_uri"), F.col("path").alias("file_path"))
        rows = self("orders").join(least, F.col("o_orderkey") == F.col("l_orderkey")).join(supplier, F.col("i.l_suppkey") == F.col("s_suppkey")).join(self("part").select("p_partkey", "p_name"), F.col("i.l_partkey") == F.col("p_partkey")).join(customer, "o_custkey")
        third = F.col("o_orderkey") % 3
        name = F.when(third == 0, F.col("s_name")).when(third == 1, F.col("p_name")).otherwise(F.col("o_orderpriority"))
        receiver = F.when((third == 0) & (F.col("o_orderkey") % 2 == 0), F.col("s_nation"))
        return rows.select(F.col("o_orderkey").alias("id"), "from_uri", name.alias("name"), receiver.alias("receiver"), F.lit(0).cast("bigint").alias("scope_id"), "file_path", F.lit(1).alias("line"), F.lit("call").alias("ref_kind"), F.lit(False).alias("is_external"))

    def imports(self) -> DataFrame:
        """Each nation's file imports the next nation, plainly and under the name of a supplier."""
        a = _nation(self)
        b = self("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("target_namespace"))
        s = self("supplier").select(F.col("s_suppkey").alias("sk"), "s_name")
        both = a.join(b, (F.col("n_nationkey") + 1) % 25 == F.col("k")).join(s, F.col("n_nationkey") == F.col("sk"), "left")
        plain = both.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("alias"), "target_namespace", F.lit(1).alias("line"))
        return plain.unionByName(both.filter("s_name is not null").select((F.col("n_nationkey") + 1000).cast("bigint").alias("id"), F.col("path").alias("file_path"), F.col("s_name").alias("alias"), "target_namespace", F.lit(2).alias("line")))

    def embeddings(self) -> DataFrame:
        """Vectors of suppliers: vec_id counts on as chunks of the supplier it meets modulo their number."""
        s = self._keyed().filter("t = 'supplier'").select("key", "uri")
        n = s.agg(F.count("*").alias("n"))
        e = self("embeddings").crossJoin(n).select("vec_id", F.col("embedding").alias("vector"), (F.col("vec_id") % F.col("n")).alias("key"), F.floor(F.col("vec_id") / F.col("n")).cast("int").alias("id"))
        return e.join(s, "key").select("uri", "id", "vector", "vec_id")

    def events(self) -> DataFrame:
        """Change events: path, hash (null: removed)."""
        return self("events").select("event_id", "ts", F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") != "error", F.floor(F.col("value") / 50).cast("bigint").cast("string")).alias("hash"))

    def file_states(self) -> DataFrame:
        last = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("event_id"))
        return self.events().withColumn("r", F.row_number().over(last)).filter("r = 1").select("path", "hash")


#: The same projection for DuckDB.
SQL = """
with keyed as (
  select *, 'codescope://tpch/' || path || '#' || kind || ':' || name || '@' || line as uri from (
    select 'region' as t, cast(r_regionkey as bigint) as key, 'namespace' as kind, r_name as name, 'geo/' || r_name || '.md' as path, 1 as line from region
    union all select 'nation', n_nationkey, 'container', n_name, 'geo/' || n_name || '.rs', n_nationkey + 1 from nation
    union all select 'supplier', s_suppkey, 'callable', s_name, 'geo/' || n_name || '.rs', s_suppkey + 100 from supplier join nation on s_nationkey = n_nationkey
    union all select 'customer', c_custkey, 'callable', c_name, 'geo/' || n_name || '.rs', c_custkey + 100000 from customer join nation on c_nationkey = n_nationkey
    union all select 'part', p_partkey, 'value', p_name, 'part/' || p_brand || '.json', p_partkey + 1 from part)
), symbols as (
  select uri, kind, name, path, cast(line as integer) as line_start, cast(line as integer) as line_end, cast(null as varchar) as doc, cast(null as varchar) as signature, name as content from keyed
), docs as (
  select 'codescope://tpch/docs/' || source || '.md#document:doc_' || doc_id || '@' || (doc_id + 1) as uri, 'document' as kind, 'doc_' || doc_id as name, 'docs/' || source || '.md' as path,
         cast(doc_id + 1 as integer) as line_start, cast(doc_id + 1 as integer) as line_end, cast(null as varchar) as doc, cast(null as varchar) as signature, text as content from documents
), items as (select * from orders join lineitem on o_orderkey = l_orderkey),
edges as (
  select f.uri as from_uri, g.uri as to_uri, e.kind, cast(e.c as double) as confidence, 'static' as resolution_mode from (
    select 'region' as a, n_regionkey as x, 'nation' as b, n_nationkey as y, 'defines' as kind, 1.0 as c from nation
    union all select 'nation', s_nationkey, 'supplier', s_suppkey, 'contains', 1.0 from supplier
    union all select 'nation', c_nationkey, 'customer', c_custkey, 'contains', 1.0 from customer
    union all select 'customer', o_custkey, 'supplier', l_suppkey, 'calls', max(case o_orderstatus when 'F' then 1.0 when 'O' then 0.9 else 0.7 end) from items group by o_custkey, l_suppkey
    union all select 'supplier', s_suppkey, 'supplier', (7 * s_suppkey + 3) % (select count(*) from supplier), 'calls', 1.0 from supplier where s_suppkey <> (7 * s_suppkey + 3) % (select count(*) from supplier)
    union all (select distinct 'customer', o_custkey, 'part', l_partkey, 'references', 0.8 from items where l_returnflag = 'R')
    union all select 'part', p_partkey, 'part', p_partkey // 2, 'inherits', 1.0 from part where p_partkey > 0
  ) e join keyed f on f.t = e.a and f.key = e.x join keyed g on g.t = e.b and g.key = e.y
), refs as (
  select o_orderkey as id, c.uri as from_uri, case o_orderkey % 3 when 0 then s_name when 1 then p_name else o_orderpriority end as name,
         case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then n_name end as receiver, cast(0 as bigint) as scope_id, c.path as file_path, 1 as line, 'call' as ref_kind, false as is_external
  from orders join (select l_orderkey, min(row(l_linenumber, l_partkey, l_suppkey)) as i from (select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem) group by l_orderkey) on o_orderkey = l_orderkey
  join supplier on s_suppkey = i[3] join nation on s_nationkey = n_nationkey join part on p_partkey = i[2] join keyed c on c.t = 'customer' and c.key = o_custkey
), imports as (
  select cast(a.n_nationkey as bigint) as id, 'geo/' || a.n_name || '.rs' as file_path, cast(null as varchar) as alias, b.n_name as target_namespace, 1 as line from nation a join nation b on (a.n_nationkey + 1) % 25 = b.n_nationkey
  union all select a.n_nationkey + 1000, 'geo/' || a.n_name || '.rs', s_name, b.n_name, 2 from nation a join nation b on (a.n_nationkey + 1) % 25 = b.n_nationkey join supplier on s_suppkey = a.n_nationkey
), vectors as (
  select uri, cast(vec_id // n as integer) as id, embedding as vector, vec_id from embeddings, (select count(*) as n from supplier) join keyed on t = 'supplier' and key = vec_id % n
), changes as (
  select event_id, ts, cast(user_id as varchar) as path, case when event_type <> 'error' then cast(cast(floor(value / 50) as bigint) as varchar) end as hash from events
)
"""
