"""The pipeline, stage by stage, against plain versions of what each stage should keep or change."""

import random

import corpus_pipeline
from stratagraph.llm import langid, pii, quality_classifier

from .test_join import plain


def documents(spark, folder):
    rnd = random.Random(8)
    words = [a + b for a in ("ka", "to", "mi", "re", "su", "lo") for b in ("ren", "tal", "mos", "vig", "dun", "pel", "qua")]
    rows = []
    for k in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randint(40, 90))]
        for c in range(1 + (k % 3 == 0)):
            copy = list(base)
            if c:
                copy[rnd.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy) + (f" mail bob{k}@example.com now" if k % 5 == 0 else ""), "xx", "s", 10))
    rows += [(len(rows) + k, "### *** %%% $$$ " * rnd.randint(20, 40), "xx", "t", 10) for k in range(30)]
    rows += [(len(rows), None, None, None, None), (len(rows) + 1, "12345 67890 " * 30, "xx", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("###" not in (t or "")), 0) for i, t, *_ in rows if i % 2 == 0 and t]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    documents(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r["doc_id"] for r in quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect() if r["kept"]}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality classifier"](spark, docs, folder).cache()
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == kept and len(kept) >= 80
    named = {r["doc_id"] for r in langid.predict(one, langid.train(one)).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    two = stages["language id"](spark, one, folder).cache()
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == named
    groups = plain([(r["doc_id"], r["text"]) for r in two.collect()], 5, 80)
    three = stages["n-gram jaccard join"](spark, two, folder).cache()
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == {c for _, c in groups.values()} and three.count() < two.count()
    four = stages["pii"](spark, three, folder).cache()
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    assert {r["doc_id"]: r["text"] for r in four.collect()} == {k: pii.redact(t, pii.spans(t)) for k, t in before.items()}
    assert four.columns == columns and not any("@" in r["text"] for r in four.collect()) and all(r["n_chars"] == len(r["text"]) for r in four.collect())
    five = stages["best-fit packing"](spark, four, folder).collect()
    assert {r["doc_id"] for r in five} == set(before)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in whole} == {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in five}
