"""Patterns over more rows, and rows that stand twice, than the test tables have."""

from pyspark.sql import functions as F

from stratagraph.plans import patterns


def write(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_hierarchy_of_more_than_a_million(spark, tmp_path):
    n = 1_100_000
    write(spark.range(n).select(F.col("id").alias("p_partkey")), tmp_path, "part")
    found = patterns.QUERIES["c13_recursive_hierarchy"](spark, str(tmp_path))
    want = F.when(F.col("key") == 0, 0).otherwise(F.floor(F.log2(F.greatest("key", F.lit(1))) + 1e-9) + 1)
    assert found.count() == n and found.select("key").distinct().count() == n
    assert found.filter(F.col("depth") != want).isEmpty()


def test_hierarchy_with_repeated_and_lost_rows(spark, tmp_path):
    write(spark.createDataFrame([(1,), (1,), (2,), (3,), (9,), (0,), (-1,), (None,)], "p_partkey bigint"), tmp_path, "part")
    found = patterns.QUERIES["c13_recursive_hierarchy"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(0, 0), (1, 1), (1, 1), (2, 2), (2, 2), (3, 2), (3, 2)]


def test_or_join_keeps_rows_that_stand_twice(spark, tmp_path):
    write(spark.createDataFrame([(1, 5), (1, 5), (2, 6), (3, None), (4, 7)], "c_custkey bigint, c_nationkey int"), tmp_path, "customer")
    write(spark.createDataFrame([(1, 5), (9, 5), (3, 6), (3, None), (4, None)], "s_suppkey bigint, s_nationkey int"), tmp_path, "supplier")
    found = patterns.QUERIES["c16_or_join"](spark, str(tmp_path))
    c, s = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("customer", "supplier"))
    want = c.join(s, (c["c_nationkey"] == s["s_nationkey"]) | (c["c_custkey"] == s["s_suppkey"])).select("c_custkey", "s_suppkey")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
