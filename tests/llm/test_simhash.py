"""SimHash components against brute force: all pairs of fingerprints, in one process."""

import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratagraph.llm import simhash

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """{key: smallest key reachable} of {key: fingerprint}."""
    keys = sorted(marks)
    values = np.array([marks[k] for k in keys], np.uint64)
    label = list(range(len(keys)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return {k: keys[root(i)] for i, k in enumerate(keys)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    marks = {k: plain_fingerprint(t) for k, t in texts.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op12_simhash(spark, DATA).collect()}
    want = plain_components(marks)
    assert got == {k: (f"{marks[k]:016x}", want[k]) for k in marks}


def families(seed, n=1200):
    """Fingerprints around centres, with bits turned anywhere, in one segment, or in neighbouring ones."""
    rnd = random.Random(seed)
    found = {0, (1 << 64) - 1}
    while len(found) < n:
        centre = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 5, 120])):
            width, low = rnd.choice([(64, 0), (16, 16 * rnd.randrange(4)), (20, rnd.randrange(44))])
            mask = 0
            for _ in range(rnd.randrange(5)):
                mask |= 1 << (low + rnd.randrange(width))
            found.add(centre ^ mask)
    return sorted(found)


@pytest.mark.parametrize("bucket", [8192, 40, 3])
def test_links_whatever_the_chain(spark, monkeypatch, bucket):
    """One, two or three segments to a key: the same components, in every one of them those of brute force."""
    monkeypatch.setattr(simhash, "SHORT", 8)
    monkeypatch.setattr(simhash, "TILE", 16)
    values = families(5)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    links = simhash.linked_pairs(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(5), bucket).collect()
    at = {v: k for k, v in enumerate(signed)}
    label = list(range(len(values)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = root(at[a]), root(at[b])
        label[max(x, y)] = min(x, y)
    want = plain_components(dict(enumerate(values)))
    assert {k: root(k) for k in range(len(values))} == want
    assert len(set(want.values())) < 0.7 * len(values)


def test_principle():
    """Every difference of up to three bits keeps the budgets from some segment on; a chain never passes four."""
    rnd = np.random.default_rng(2)
    for bits in range(6):
        masks = np.array([sum(1 << int(b) for b in rnd.choice(64, bits, replace=False)) for _ in range(3000)], np.uint64)
        hit = np.zeros(len(masks), bool)
        for k in range(4):
            turned = (masks << np.uint64(16 * k)) | (masks >> np.uint64((64 - 16 * k) % 64)) if k else masks
            hit[simhash.in_chain(turned)] = True
        assert hit.all() == (bits <= 3) and hit.any() == (bits <= 3)
    assert [len(simhash.variants(k)) for k in (1, 2, 3)] == [1, 17, 409]


def test_edge_cases(spark):
    schema = "doc_id long, text string, fp string, rep string, component string, start string, key string"
    long = "word another third " * 40_000
    rows = [(4, None), (2, ""), (9, " \n\t "), (3, "One two"), (5, "one TWO"), (6, "one two three"), (None, "one two"), (7, long), (8, long + "x"), (5, "xé y"), (1, "中")]
    docs = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], schema).repartition(3)
    got = sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.components(docs).collect()), key=repr)
    marks = [(k, plain_fingerprint(t)) for k, t in rows]
    least = {}
    for k, m in marks:
        if k is not None:
            least[m] = min(k, least.get(m, k))
    near = plain_components({k: m for m, k in least.items()})
    assert got == sorted(((k, m, None if k is None else near[least[m]]) for k, m in marks), key=repr)
    assert {k: c for k, _, c in got}[9] == 2
    assert simhash.components(docs.limit(0)).count() == 0
    assert simhash.components(docs.filter("doc_id is null")).collect()[0]["component_id"] is None


def test_a_third_of_all_rows_alike(spark):
    """A hot group of copies is one node; near copies of one centre are compared without a row for each pair."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text in all of these")).otherwise(F.concat(F.lit("own words "), F.col("id").cast("string"), F.lit(" "), F.sha1(F.col("id").cast("string")))).alias("text"))
    found = simhash.components(docs)
    assert found.filter("doc_id % 3 = 0 and component_id = 0").count() == 10_000
