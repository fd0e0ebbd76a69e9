"""Learned operators against plain versions: language by naive Viterbi, co-training in one process,
thresholds of groups of any size."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import langid, quality_classifier, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def naive(words, model, penalty):
    """Best sequence of languages by trying all of them."""
    score = model.score(words)
    best = max(product(range(len(model.languages)), repeat=len(words)), key=lambda s: sum(score[i, k] for i, k in enumerate(s)) - penalty * sum(a != b for a, b in zip(s, s[1:])))
    return best


def test_language_equals_naive_viterbi(spark):
    rnd = random.Random(4)
    lines = {"en": "the quick brown fox jumps over a lazy dog while it rains", "fr": "le renard brun saute par dessus un chien qui dort dehors", "de": "der schnelle braune fuchs springt über den faulen hund im garten"}
    rows = [(k, " ".join(rnd.sample(lines[x].split(), 8)), x, None, None) for k, x in enumerate(list(lines) * 20)]
    docs = spark.createDataFrame([*rows, (None, "the dog", "en", None, None)], SCHEMA)
    model = langid.train(docs)
    mixed = [(100 + k, " ".join(rnd.choice(lines[rnd.choice(list(lines))].split()) for _ in range(rnd.randint(1, 6)))) for k in range(40)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(mixed, "doc_id long, text string"), model, 3.0).collect()}
    for k, text in mixed:
        words = text.split()
        letters = dict.fromkeys(model.languages, 0)
        best = naive(words, model, 3.0)
        for word, place in zip(words, best):
            letters[model.languages[place]] += len(word)
        top = max(letters.values())
        assert letters[got[k][0]] == pytest.approx(top) and got[k][1] == pytest.approx(top / sum(letters.values()))
    assert docs.filter("doc_id is null").select(langid.fold().alias("f")).first()["f"] == 0


def corpus(n=400):
    rnd = random.Random(2)
    words = [a + b for a in ("ka", "to", "mi", "re") for b in ("ren", "tal", "mos", "vig", "dun")]
    rows = []
    for k in range(n):
        good = k % 3 > 0
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(30, 80))) if good else " ".join(rnd.choice(["###", "$$$", "buy", "NOW", "!!!", "ka"]) for _ in range(rnd.randint(30, 80)))
        rows.append((k, text, "en", "site" if good else f"spam{k % 2}", len(text)))
    return rows


def test_co_training_equals_one_process(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 400, 4)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    made = {k: quality_classifier.features(t, s, g, c) for k, t, g, s, c in rows}
    both = lambda keys: [np.stack([made[k][0] for k in keys]).astype(np.float16).astype(np.float32), np.stack([made[k][1] for k in keys])]
    known, rest = [k for k in made if k % 4 == 0], [k for k in made if k % 4]
    text, meta = both(known)
    plain = quality_classifier.co_train(text, meta, np.array([float(k % 3 > 0) for k in known]), lambda views, limits: quality_classifier.lessons(views, limits, both(rest)))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    want = plain.scores(*both(sorted(made)))[2]
    assert max(abs(got[k] - w) for k, w in zip(sorted(made), want)) < 1e-6
    assert sum((got[k] >= 0.5) == (k % 3 > 0) for k in made) >= 0.97 * len(made)


def test_pseudo_labels_of_all_rows_count():
    """More unlabelled rows change the sums, not their weight: doubling every row changes nothing."""
    rows = corpus(120)
    xs = [np.stack(x) for x in zip(*(quality_classifier.features(t, s, g, c) for _, t, g, s, c in rows))]
    y = np.array([float(k % 3 > 0) for k, *_ in rows])
    once = lambda views, limits: quality_classifier.lessons(views, limits, xs)
    twice = lambda views, limits: quality_classifier.lessons(views, limits, [np.concatenate([x, x]) for x in xs])
    one, two = (quality_classifier.co_train(*xs, y, pool) for pool in (once, twice))
    assert np.allclose(one.scores(*xs)[2], two.scores(*xs)[2], atol=1e-9)


def test_small_groups_have_thresholds_of_their_own(spark):
    """Two sources of a language, one small: its limits lie between its own and its language's."""
    rnd = random.Random(5)
    words = ["lorem", "ipsum", "dolor", "amet", "sit", "elit", "sed", "do"]
    long = ["extraordinarily", "internationalisation", "characteristically"]
    text = lambda pool, k: " ".join(f"{rnd.choice(pool)}{rnd.randrange(10**6)}" for _ in range(80 + k % 3))
    rows = [(k, text(words, k), "en", "big", 1) for k in range(300)] + [(1000 + k, text(long, k), "en", "small", 1) for k in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("salt", F.lit(1))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    measured = quality_rules.measures(docs.select("doc_id", "text", "lang", "source")).withColumn("base_failed", F.lit(False))
    limits = {r["source"]: r for r in quality_rules.thresholds(measured).collect()}
    assert limits["big"]["high_word_length"] < limits["small"]["high_word_length"]
    assert all(kept[k] for k in range(300))


def test_thresholds_join_by_salt(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(80), SCHEMA)
    by_broadcast = sorted(map(tuple, quality_rules.judge(docs).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, quality_rules.judge(docs).collect())) == by_broadcast
