"""Thresholds follow the group: what a clean source rejects a noisy one keeps."""

import random

from stratagraph.llm import quality_rules


def prose(rnd, n=80, marks=0):
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.choice([3, 4, 5, 6, 7]))) for _ in range(n)]
    for k in rnd.sample(range(n), marks):
        words[k] = "#" + words[k]
    return " ".join(words)


def test_a_noisy_source_keeps_what_a_clean_one_rejects(spark):
    rnd = random.Random(4)
    rows = [(k, prose(rnd, marks=1 if k % 10 == 0 else 0), "en", "prose") for k in range(300)]
    rows += [(1000 + k, prose(rnd, marks=rnd.choice([8, 10, 12])), "en", "code") for k in range(300)]
    rows += [(5000, prose(rnd, marks=10), "en", "prose"), (5001, prose(rnd, marks=10), "en", "code"), (5002, prose(rnd, marks=80), "en", "code"), (5003, prose(rnd), "xx", "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert (kept[5000], kept[5001], kept[5002], kept[5003]) == (False, True, False, True)
    assert sum(kept[k] for k in range(300)) >= 295 and sum(kept[1000 + k] for k in range(300)) >= 295
    limits = {r["source"]: r for r in quality_rules.thresholds(quality_rules.measures(docs)).collect()}
    assert limits["code"]["high_symbols"] > 10 * limits["prose"]["high_symbols"] > 0
    assert limits["prose"]["high_dup_lines"] is None and limits["alone"]["low_word_length"] < limits["alone"]["high_word_length"]


def test_groups_have_limits_of_their_own(spark):
    """Over the larger test tables most groups differ in every ratio that counts something odd."""
    import os

    data = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(data):
        return
    limits = quality_rules.thresholds(quality_rules.measures(spark.read.parquet(data).select("doc_id", "text", "lang", "source"))).collect()
    for ratio in quality_rules.SEVERITY:
        assert len({r[f"high_{ratio}"] for r in limits}) > len(limits) / 2
    assert len({(r["low_word_length"], r["high_word_length"]) for r in limits}) > 4
