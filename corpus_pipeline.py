"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept. All but the
last return the columns of ``documents``, and further ones ``documents`` may have, whatever their
names. Stages decide row by row: repeated rows share their fate but for the join, which keeps one
row of each group; where an id repeats with different texts each text is judged for itself. Rows
with a null id pass every stage like others and are no copies of anything. Null and empty texts go
with the first stage, since they have no words. Texts of any length are read whole. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import langid, ngram_join, packing, pii, quality_classifier
from stratagraph.llm.common import materialize, table
from stratagraph.llm.tokens import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the co-trained classifier rejects go. Null metadata counts as empty; without labels of
    both kinds all documents with words stay."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or in which no language holds half of the letters, go. Rows with a
    null language are not learned from; without any known language all go."""
    return langid.keep_named(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: that of the smallest
    id. Ties (one id with several texts of a group) go to the smallest fingerprint."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows the text."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Equal rows are packed each."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), 0)


STAGES = [
    ("quality classifier", quality),
    ("language id", language),
    ("n-gram jaccard join", near_duplicates),
    ("pii", personal_data),
    ("best-fit packing", pack),
]

#: No stage but the join is within reach of SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
