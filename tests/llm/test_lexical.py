"""Ranked search against the formula written out in plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratagraph.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def plain(docs, items, k=50):
    counts = [(key, Counter(plain_terms(text))) for key, text in docs]
    counts = [(key, c, sum(c.values())) for key, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        found = []
        for key, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0 and key is not None:
                found.append((-score, key))
        out += [(item, rank, key, -s) for rank, (s, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    words = ["Alpha", "beta2", "Gamma", "été", "ÉTÉ", "日本", "x", "\U0001f600", *(f"w{k}" for k in range(60))]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda size: "".join(rnd.choices(words, weights)[0] + rnd.choice([" ", ", ", "\n", "-", "_", "\x00", "\x7f"]) for _ in range(size))
    docs = [(k, text(rnd.choice([0, 1, 3, 10, 40, 300]))) for k in range(n)]
    docs += [(n + k, docs[7 + k % 5][1]) for k in range(150)]
    return docs, [(k, text(rnd.choice([1, 2, 5, 12]))) for k in range(12)]


@pytest.mark.parametrize(("k", "rows", "pairs", "most"), [(50, 60_000, 200_000, 500_000), (5, 37, 10, 500_000), (3, 20, 200_000, 0)])
def test_search_equals_the_formula(spark, monkeypatch, k, rows, pairs, most):
    """Large and small segments, one and several blocks of items, with and without a list of segments to read."""
    for name, value in (("SEGMENT_ROWS", rows), ("PAIRS", pairs), ("BROADCAST_ROWS", most), ("PIECE", 50)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus(k)
    random.Random(1).shuffle(docs)
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(docs, items, k)


def test_bytes_bound_the_impact_from_above():
    import numpy as np

    rng = np.random.default_rng(4)
    tf, n = rng.integers(1, 1000, 5000), rng.integers(1, 10**6, 5000)
    f = lexical.impact(tf, n, 10**6, 10**9)
    q = -(-f // lexical.STEP)
    assert (q * lexical.STEP >= f).all() and ((q - 1) * lexical.STEP < f).all() and q.max() <= 255
    assert (lexical.impact(tf, n * 10**6, 10**13, 10**19 - 1) >= 0).all()


def test_edge_cases(spark):
    long = "needle " + "hay " * 300_000
    docs = [(1, None), (2, ""), (3, "..."), (4, long), (5, "Needle"), (5, "needle"), (None, "needle"), (7, "needle hay"), (8, "needle hay"), (9, "other")]
    items = [(1, "NEEDLE needle"), (2, None), (3, "?"), (4, "hay"), (4, "other"), (None, "needle"), (5, "absent")]
    frame = spark.createDataFrame([(*r, *["clash"] * 5) for r in docs], "doc_id long, text string, term string, score string, item string, segment string, key string").repartition(3)
    asked = spark.createDataFrame([(*r, "clash", "clash") for r in items], "item_id long, text string, rank string, doc_id string")
    got = sorted(map(tuple, lexical.search(lexical.build(frame), asked).collect()))
    assert got == plain(docs, items) and {r[0] for r in got} == {1, 4}
    none = lexical.build(frame.limit(0))
    assert (none.documents, none.terms) == (0, 0) and lexical.search(none, asked).count() == 0
    assert lexical.search(lexical.build(frame), asked.limit(0)).count() == 0


def test_counts_from_bytes():
    import pyarrow as pa

    texts = ["a b", None, "", "é,é;x1", " lead", "trail ", "ab", "cd"]
    want = [len(plain_terms(t)) for t in texts]
    assert lexical.term_counts(pa.array(texts, pa.string())).tolist() == want
    assert lexical.term_counts(pa.array(texts, pa.string()).slice(3, 4)).tolist() == want[3:7]


def test_ties_of_many_copies(spark):
    """A third of all rows reach the bound of an item: none is lost and no task hands on more than k."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 1, F.lit("same words here")).otherwise(F.concat(F.lit("other "), F.col("id").cast("string"))).alias("text"))
    got = lexical.search(lexical.build(docs.repartition(7)), spark.createDataFrame([(1, "same here")], "item_id long, text string"), 50).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [3 * k + 1 for k in range(50)] and len({r["score"] for r in got}) == 1
