"""Rows reach Python workers by their bytes, and leave them in pieces."""

from pyspark.sql import functions as F

from stratagraph.core import ARROW_BYTES
from stratagraph.extract import adapters
from stratagraph.extract.model import Registry
from stratagraph.functions import embed


def texts(spark):
    return spark.range(400, numPartitions=1).select(F.format_string("d/%d", "id").alias("path"), F.concat("id", F.lit(" "), F.repeat(F.lit("word "), 20_000)).alias("content"))


def test_texts_of_an_embedding(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")

    def provider(values):
        assert sum(map(len, values)) <= 2 * ARROW_BYTES
        return embed.hash_embed([v[:20] for v in values])

    assert texts(spark).select(embed.embed_column("content", provider).alias("v")).filter(F.size("v") == embed.WIDTH).count() == 400


def test_files_of_an_extraction(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    sizes = []
    frames = [texts(spark).limit(100).toPandas()]

    class Files:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            sizes.extend(int(f["row"].str.len().sum()) for f in run(iter(frames)))
            return spark.createDataFrame([], schema)

    adapters.extract(Files(), "r", Registry())
    assert sum(sizes) > 2 * ARROW_BYTES and max(sizes) < 2 * ARROW_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(ARROW_BYTES)
