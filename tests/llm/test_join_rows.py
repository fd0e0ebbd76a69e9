"""One row of each group, decided by row; hot lists; both ways to find texts again."""

import random

import pytest
from pyspark.sql import functions as F

from stratagraph.llm import ngram_join

from .test_join import corpus, plain

A = " ".join(f"a{k}" for k in range(40))
Z = " ".join(f"z{k}" for k in range(40))


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, A), (5, A), (5, Z)], [(1, A), (5, Z)]),
        ([(5, A), (5, Z)], [(5, A), (5, Z)]),
        ([(5, A), (5, A + " more"), (6, A)], [(5, None)]),
        ([(7, A), (7, A), (None, A), (None, None), (8, ""), (8, None), (9, "")], [(7, A), (8, ""), (9, ""), (None, A), (None, "")]),
    ],
)
def test_one_row_of_each_group(spark, rows, want):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("nth_of_key", F.lit(1)).withColumn("nth_row", F.lit(1)).withColumn("TEXT_HASH", F.lit(1)).repartition(2)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=repr)
    if want[0][1] is None:
        assert [k for k, _ in got] == [5]
    else:
        assert got == sorted(want, key=repr)


def test_one_group_of_many_near_copies(spark, monkeypatch):
    """Lists with hundreds of members, and one passage in all texts, compared in small tiles."""
    monkeypatch.setattr(ngram_join, "TILE", 50)
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    base, passage = [rnd.choice(words) for _ in range(60)], " ".join(rnd.choice(words) for _ in range(50))
    rows = []
    for k in range(300):
        copy = list(base)
        copy[rnd.randrange(len(copy))] = f"x{k}"
        rows.append((k, " ".join(copy)))
    rows += [(300 + k, passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60)))) for k in range(150)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 90).collect()}
    assert got == plain(rows, 3, 90)


def test_texts_found_again_by_a_semi_join(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 64)
    rows = corpus(9)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90).collect()}
    assert got == plain(rows, 3, 90)


def test_sketches_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (5, 300, 40_000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 2**63, size // 20).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            x, y = (np.frombuffer(ngram_join.sketch(s), np.uint8)[None, :] for s in (a, b))
            may = bool(ngram_join.may_link(x, np.array([len(a)]), y, np.array([len(b)]), 90)[0])
            assert may or 100 * shared < 90 * (len(a) + len(b) - shared)
    x = np.frombuffer(ngram_join.sketch(np.sort(rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2))), np.uint8)[None, :]
    y = np.frombuffer(ngram_join.sketch(np.sort(rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2))), np.uint8)[None, :]
    assert not ngram_join.may_link(x, np.array([400]), y, np.array([400]), 80)[0]
