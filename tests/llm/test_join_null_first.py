"""A row with a null id ahead of its copy takes no lists from it."""

from stratagraph.llm import ngram_join


def test_null_id_ahead_of_its_copy_and_a_near_copy(spark):
    words = [f"w{k}" for k in range(60)]
    text, near = " ".join(words), " ".join([*words, "more"])
    rows = [(None, text), (2, text), (1, near), (None, near), (3, "quite another text of some other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for n, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs, n, percent).collect()}
        assert got == {None: None, 1: 1, 2: 1, 3: 3}
        assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs, n, percent).collect() if r["doc_id"] is not None) == [1, 3]
