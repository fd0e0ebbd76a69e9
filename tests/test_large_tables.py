"""What a task holds does not grow with the tables: more tasks for edges, open files by kind."""

from stratagraph.plans import project
from stratagraph.plans.project import Tables
from stratagraph.sources import catalog

DATA = "/root/testdata/sf0.001"


def test_edges_are_dealt_to_more_tasks(spark, monkeypatch):
    want = sorted(map(tuple, Tables(spark, DATA).edges().collect()), key=str)
    monkeypatch.setattr(project, "TASK_ROWS", 600)
    many = Tables(spark, DATA).edges()
    assert sorted(map(tuple, many.collect()), key=str) == want
    assert "RepartitionByExpression" in many._jdf.queryExecution().optimizedPlan().toString()


def test_tables_are_written_without_a_sort_by_kind(spark, tmp_path, monkeypatch):
    key, seen, was = "spark.sql.maxConcurrentOutputFileWriters", [], spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    held = Tables(spark, DATA).edges()
    writer = type(held.write)
    put = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path, **more: seen.append(spark.conf.get(key)) or put(self, path, **more))
    kept = catalog.Catalog(spark, f"file://{tmp_path}/index")
    kept.commit({"edges": held})
    assert seen == ["16"] and spark.conf.get(key, None) == was
    assert sorted(map(tuple, kept.load("edges").collect()), key=str) == sorted(map(tuple, held.collect()), key=str)
