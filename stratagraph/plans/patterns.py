"""Relational constructs an application on such an index needs, on the star schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import stored
from .project import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Reader:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    def view(self, *names: str) -> SparkSession:
        for name in names:
            read(self.spark, self.sf_dir, name).createOrReplaceTempView(name)
        return self.spark


def pattern(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Reader(spark, sf_dir))
        ORACLE[f.__name__] = sql
        return f

    return add


@pattern("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') as finished from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def c01_exists(r):
    big = r.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    done = r.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("finished", F.lit(True))
    return r.customer.join(big, "c_custkey", "left_anti").join(done, "c_custkey", "left").select("c_custkey", F.coalesce("finished", F.lit(False)).alias("finished"))


def optional_filters(name: str | None = None, segment: str | None = None, least: float | None = None, most: float | None = None) -> Column:
    """AND of the filters given; a missing balance passes ``most``."""
    parts = []
    if name is not None:
        parts.append(F.col("c_name").ilike(f"%{name}%"))
    if segment is not None:
        parts.append(F.col("c_mktsegment") == segment)
    if least is not None:
        parts.append(F.col("c_acctbal") >= least)
    if most is not None:
        parts.append(F.col("c_acctbal").isNull() | (F.col("c_acctbal") <= most))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


@pattern("select c_custkey from customer where c_name ilike '%1%' and c_acctbal >= 0 and (c_acctbal is null or c_acctbal <= 5000)")
def c02_optional_filters(r):
    return r.customer.filter(optional_filters(name="1", least=0.0, most=5000.0)).select("c_custkey")


_CODE = "concat_ws('.', 'C', p_partkey % 5, p_partkey % 25, p_partkey)"


@pattern(f"select p_partkey from part where {_CODE} = 'C.1' or {_CODE} like 'C.1.%'")
def c03_hierarchical_code(r):
    code = F.concat_ws(".", F.lit("C"), F.col("p_partkey") % 5, F.col("p_partkey") % 25, "p_partkey")
    return r.part.filter((code == "C.1") | code.startswith("C.1.")).select("p_partkey")


@pattern("select o_custkey, list_contains(list(distinct o_orderpriority), '1-URGENT') as urgent from orders group by o_custkey")
def c04_any_of_array(r):
    return r.orders.groupBy("o_custkey").agg(F.array_contains(F.collect_set("o_orderpriority"), "1-URGENT").alias("urgent"))


@pattern("select event_id, cast(json_extract(props, '$.k') as bigint) = 3 as holds from events")
def c05_json_containment(r):
    return r.events.select("event_id", (F.from_json("props", "k bigint")["k"] == 3).alias("holds"))


_ARRAY = "'[{\"k\":' || o_orderkey || '},{\"k\":' || (o_orderkey + 1) || '}]'"


@pattern("select o_orderkey, o_orderkey + i as k from orders, (values (0), (1)) v(i) where o_orderkey % 3 <> 0")
def c06_json_elements(r):
    text = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit('[{"k":'), "o_orderkey", F.lit('},{"k":'), F.col("o_orderkey") + 1, F.lit("}]"))).otherwise(F.lit('{"k":1}'))
    kept = F.when(text.startswith("["), F.from_json(text, "array<struct<k: bigint>>"))
    return r.orders.select("o_orderkey", F.explode(kept).alias("e")).select("o_orderkey", "e.k")


@pattern("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def c07_json_field(r):
    return r.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@pattern("select o_custkey, max(case when o_orderstatus = 'F' then o_totalprice end) as f, max(case when o_orderstatus = 'O' then o_totalprice end) as o from orders group by o_custkey")
def c08_pivot(r):
    of = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return r.orders.groupBy("o_custkey").agg(of("F").alias("f"), of("O").alias("o"))


@pattern("select c_nationkey, array_to_string(list_sort(list(distinct c_mktsegment)), ',') as segments from customer group by c_nationkey")
def c09_distinct_array(r):
    return r.customer.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"))


@pattern("select l_suppkey, count(distinct l_partkey) as parts from lineitem group by l_suppkey")
def c10_count_distinct(r):
    return r.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


@pattern("select l_orderkey, case when bool_or(l_returnflag = 'R') then 'returned' when bool_or(l_returnflag = 'A') then 'accepted' else 'new' end as state from lineitem group by l_orderkey")
def c11_bool_or_priority(r):
    any_ = lambda f: F.bool_or(F.col("l_returnflag") == f)
    return r.lineitem.groupBy("l_orderkey").agg(F.when(any_("R"), "returned").when(any_("A"), "accepted").otherwise("new").alias("state"))


@pattern("select n_regionkey, '[' || string_agg('{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}', ',' order by n_nationkey) || ']' as nations from nation group by n_regionkey")
def c12_json_aggregate(r):
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))
    return r.nation.groupBy("n_regionkey").agg(F.to_json(rows).alias("nations"))


@pattern("with recursive t(key, depth) as (select 0::bigint, 0 union all select p_partkey, depth + 1 from part join t on p_partkey // 2 = key and p_partkey > 0) select key, depth::integer as depth from t")
def c13_recursive_hierarchy(r):
    """Level by level: each is one join of the level before with the rows, and is stored. Of a row that stands
    twice both stay, as in a union of all."""
    rows = stored(r.part.filter("p_partkey > 0").select(F.col("p_partkey").cast("bigint").alias("next"), F.expr("p_partkey div 2").alias("key")))
    level = r.spark.range(1).select(F.col("id").alias("key"), F.lit(0).alias("depth"))
    found, depth = level, 0
    while True:
        depth += 1
        level = stored(level.select("key").join(rows, "key").select(F.col("next").alias("key"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            return found
        found = found.unionByName(level)


@pattern("select distinct on (o_custkey) o_custkey, o_orderkey from orders order by o_custkey, o_orderdate desc, o_orderkey desc")
def c14_distinct_on(r):
    last = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return r.orders.withColumn("r", F.row_number().over(last)).filter("r = 1").select("o_custkey", "o_orderkey")


@pattern("select c_custkey, x.o_orderkey from customer left join lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey desc limit 1) x on true")
def c15_latest_row(r):
    latest = r.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return r.customer.select("c_custkey").join(latest, "c_custkey", "left")


@pattern("select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey or c_custkey = s_suppkey")
def c16_or_join(r):
    """Two equi-joins that have no pair in common, in place of a nested loop over both sides. The pairs are never
    shuffled or held; since nations are few, each one's customers are dealt to sixteen parts, which suppliers all
    meet, and parts to a fixed number of tasks, which what little goes in would not call for."""
    n = int(r.spark.conf.get("spark.sql.shuffle.partitions"))
    c, s = r.customer.select("c_custkey", "c_nationkey"), r.supplier.select("s_suppkey", "s_nationkey")
    a = c.select("c_custkey", F.col("c_nationkey").alias("nation"), F.pmod(F.xxhash64("c_custkey"), F.lit(16)).cast("int").alias("part"))
    b = s.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part"))
    one = a.repartition(n, "nation", "part").join(b.repartition(n, "nation", "part"), ["nation", "part"]).select("c_custkey", "s_suppkey")
    both = F.coalesce(F.col("c_nationkey") == F.col("s_nationkey"), F.lit(False))
    two = c.join(s, F.col("c_custkey") == F.col("s_suppkey")).filter(~both).select("c_custkey", "s_suppkey")
    return one.unionAll(two)


@pattern("with top as (select max(o_totalprice) as m from orders where o_orderstatus = 'X') select r_regionkey, m from region left join top on true")
def c17_one_row_join(r):
    top = r.orders.filter("o_orderstatus = 'X'").agg(F.max("o_totalprice").alias("m"))
    return r.region.select("r_regionkey").join(F.broadcast(top), how="left", on=F.lit(True))


@pattern("select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) as items from orders where o_totalprice > (select avg(o_totalprice) from orders)")
def c18_scalar_subquery(r):
    return r.view("orders", "lineitem").sql("select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) as items from orders where o_totalprice > (select avg(o_totalprice) from orders)")


@pattern("select o_orderkey, case when o_orderstatus = 'F' then 'closed' when o_totalprice > 200000 then 'large' when o_orderpriority like '1%' then 'urgent' else 'open' end as state from orders")
def c19_case_ladder(r):
    return r.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_totalprice") > 200000, "large").when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("open").alias("state"))


@pattern("select c_custkey, coalesce(nullif(trim(concat(case when c_custkey % 2 = 0 then c_name end, ' ', c_mktsegment)), ''), '-') as label from customer")
def c20_coalesce_concat(r):
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    joined = F.trim(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce("c_mktsegment", F.lit(""))))
    return r.customer.select("c_custkey", F.coalesce(F.nullif(joined, F.lit("")), F.lit("-")).alias("label"))


@pattern("select o_orderkey, o_orderdate + interval 1 day * cast(o_orderkey % 30 as integer) as due from orders")
def c21_interval(r):
    return r.orders.select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 30).cast("int"))).alias("due"))


@pattern("select l_returnflag, l_linestatus, l_linenumber, count(*) as n, sum(coalesce(cast(l_quantity as bigint), 0))::bigint as quantity from lineitem group by 1, 2, 3")
def c22_wide_group_by(r):
    return r.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("l_quantity").cast("bigint"), F.lit(0))).alias("quantity"))


@pattern("select p_brand, count(case when p_size > 45 then 1 end) > 0 as has_large from part group by p_brand")
def c23_count_positive(r):
    return r.part.groupBy("p_brand").agg((F.count(F.when(F.col("p_size") > 45, 1)) > 0).alias("has_large"))


@pattern("select p_partkey, (select count(*) from part) as total_count, (select count(*) from part) > 60 as has_more, greatest((select count(*) from part) - 60, 0) as remaining from part order by p_retailprice desc, p_partkey limit 20 offset 40")
def c24_paging(r):
    total = r.part.agg(F.count("*").alias("total_count"))
    page = r.part.orderBy(F.desc("p_retailprice"), "p_partkey").offset(40).limit(20).select("p_partkey")
    return page.crossJoin(total).withColumn("has_more", F.col("total_count") > 60).withColumn("remaining", F.greatest(F.col("total_count") - 60, F.lit(0)))


@pattern(f"with t as (select p_partkey, case when {_CODE} = 'C.2.7.99999999' then 0 when {_CODE} like 'C.2.7.%' then 1 when {_CODE} like 'C.2.%' then 2 end as tier from part) select p_partkey, tier from t where tier = (select min(tier) from t)")
def c25_tiered_fallback(r):
    code = F.concat_ws(".", F.lit("C"), F.col("p_partkey") % 5, F.col("p_partkey") % 25, "p_partkey")
    tier = F.when(code == "C.2.7.99999999", 0).when(code.startswith("C.2.7."), 1).when(code.startswith("C.2."), 2)
    tiers = r.part.select("p_partkey", tier.alias("tier")).filter("tier is not null")
    return tiers.join(tiers.agg(F.min("tier").alias("tier")), "tier").select("p_partkey", "tier")


@pattern("select o_orderkey, case when o_orderkey % 3 <> 0 then 2 else 0 end as n from orders")
def c26_json_array_length(r):
    text = F.when(F.col("o_orderkey") % 3 != 0, F.lit("[1,2]")).otherwise(F.lit('{"a":1}'))
    return r.orders.select("o_orderkey", F.when(text.startswith("["), F.size(F.from_json(text, "array<bigint>"))).otherwise(0).alias("n"))


@pattern("select c_nationkey, array_to_string(list_append(list_sort(list(distinct c_mktsegment)), 'NEW') || ['A', 'B'], ',') as tags, case when count(*) > 60 then 'big' else 'small' end as size from customer group by c_nationkey")
def c27_array_rewrite(r):
    tags = F.concat(F.array_append(F.sort_array(F.collect_set("c_mktsegment")), F.lit("NEW")), F.array(F.lit("A"), F.lit("B")))
    return r.customer.groupBy("c_nationkey").agg(F.array_join(tags, ",").alias("tags"), F.when(F.count("*") > 60, "big").otherwise("small").alias("size"))


@pattern("select a.p_partkey, a.p_name, b.p_name as parent_name from part a left join part b on a.p_partkey // 2 = b.p_partkey and a.p_partkey > 0")
def c28_self_join(r):
    a, b = r.part.alias("a"), r.part.alias("b")
    return a.join(b, (F.floor(F.col("a.p_partkey") / 2) == F.col("b.p_partkey")) & (F.col("a.p_partkey") > 0), "left").select("a.p_partkey", "a.p_name", F.col("b.p_name").alias("parent_name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
