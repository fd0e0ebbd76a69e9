"""Different sets of one fingerprint are told apart by the second one."""

from stratagraph.llm import ngram_join

from .test_join import corpus, plain


def test_few_bits(spark):
    rows = corpus(9)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame, 3, 90, bits=5).collect()}
    assert got == plain(rows, 3, 90)
