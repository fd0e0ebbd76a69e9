"""The pipeline on null and repeated ids, empty tables and columns with clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOX = "the quick brown fox jumps over the lazy dog and runs away from every other animal it meets on the road near "
SEA = "a small boat left the harbour before sunrise while heavy waves rolled slowly towards the old stone wall of "
ROWS = [
    (1, FOX + "alpha", "en", "s", 100),
    (5, FOX + "alpha", "en", "s", 100),
    (5, SEA + "beta", "en", "s", 100),
    (5, SEA + "beta", "en", "s", 100),
    (None, FOX + "alpha", "en", None, None),
    (7, None, None, None, None),
    (8, "", "en", "s", 0),
    (9, " \n ", "en", "s", 3),
    (10, SEA * 300 + "mail me at bob@example.com", "en", "s", 1),
]


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, labels=()):
        docs = spark.createDataFrame(rows, SCHEMA)
        for c in ("score", "key", "sig", "kept", "group", "nth_row", "text_hash", "some"):
            docs = docs.withColumn(c, F.lit("clash"))
        docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_odd_rows(spark, folder):
    place = folder(ROWS)
    docs, kept = spark.read.parquet(f"{place}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, place).cache()
        assert after.columns == docs.columns and all(r["score"] == "clash" for r in after.collect())
        docs, kept[name] = after, sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in after.collect())
    assert kept["quality classifier"] == kept["language id"] == [(0, "the q"), (1, "the q"), (5, "a sma"), (5, "a sma"), (5, "the q"), (10, "a sma")]
    assert kept["n-gram jaccard join"] == kept["pii"] == [(0, "the q"), (1, "the q"), (5, "a sma"), (10, "a sma")]
    assert "@" not in {r["doc_id"]: r["text"] for r in docs.collect()}[10]
    packed = corpus_pipeline.run(spark, place).collect()
    assert {r["doc_id"] for r in packed} == {None, 1, 5, 10} and sum(r["doc_id"] == 10 for r in packed) > 2


def test_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0
