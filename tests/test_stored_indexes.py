"""Indexes for search give what a scan gives, and read a part."""

import random
import re

import numpy as np

from stratagraph.core import SCHEMAS
from stratagraph.functions.scoring import file_boost
from stratagraph.operators import search
from stratagraph.operators.trigrams import TrigramIndex
from stratagraph.operators.vector_index import VectorIndex
from pyspark.sql import functions as F


def symbols(spark, n=3000):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9)))
    rows = []
    for k in range(n):
        name = word().title() + rnd.choice(["", "_X", "%y", "É"])
        text = " ".join(word() for _ in range(rnd.choice([0, 3, 30]))) + (" Needle-Wörd in hay" if k % 1000 == 7 else "")
        path = f"p{k % 7}/{word()}.{rnd.choice(['py', 'md', 'json'])}"
        rows.append((f"codescope://r/{path}#callable:{name}@{k}", rnd.choice(["callable", "value"]), name, path, k, k, rnd.choice([None, word()]), None, rnd.choice([text, text, text, None]) if k % 1000 != 7 else text))
    return spark.createDataFrame(rows, SCHEMAS["symbols"])


def test_substring_search(spark, tmp_path):
    s = symbols(spark).repartition(3)
    index = TrigramIndex(spark, f"{tmp_path}/tri", slots=16).build(s, part_rows=50)
    held = index.texts()
    assert held.count() == 3000
    for query, kind in (("needle-wörd hay", None), ("NEEDLE", "value"), ("ab", None), ("abc de", "callable"), ("zzzz", None), ("nee%wörd", None), ("n_edle", None), ("", None), ("_x abc", None), ("%", None)):
        want = [r["uri"] for r in search.search_content(held.drop("part", "row"), query, kind, 40).collect()]
        assert [r["uri"] for r in index.search_content(query, kind, 40).collect()] == want, query
    for pattern in ("abc", "a%b", "%_X", "\\", "É"):
        want = [tuple(r) for r in search.search_name(held.drop("part", "row"), pattern, 30).select("uri", "score").collect()]
        assert [tuple(r) for r in index.search_name(pattern, 30).select("uri", "score").collect()] == want, pattern
    narrow = index.narrowed(["needle-wörd"])
    parts = [r["part"] for r in index.candidates(["needle-wörd"]).collect()]
    read = held.filter(F.col("part").isin(parts)).count()
    assert narrow.count() == 3 and len(parts) == 3 and 3 <= read <= 0.05 * 3000
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", narrow._jdf.queryExecution().explainString(narrow.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert any(all(str(p) in f for p in parts) for f in filters)


def test_vector_search(spark, tmp_path):
    rng = np.random.default_rng(5)
    around = rng.normal(size=(20, 16))
    m = (around[rng.integers(0, 20, 2000)] + 0.05 * rng.normal(size=(2000, 16))).astype(np.float32)
    rows = [(f"u{k % 700}", [float(x) for x in v], f"f{k % 5}.{'py' if k % 3 else 'json'}") for k, v in enumerate(m)]
    rows += [("none", None, "a.py"), ("zero", [0.0] * 16, "a.py"), ("short", [1.0, 2.0], "a.py"), ("nan", [float("nan")] * 16, "a.py")]
    frame = spark.createDataFrame(rows, "uri string, vector array<float>, path string").repartition(4)
    frame = frame.filter("uri <> 'nan'")
    index = VectorIndex(spark, f"{tmp_path}/vec").build(frame, "uri", factor=file_boost(F.col("path")), centres=24)
    for q in (m[3], -m[3], rng.normal(size=16), np.zeros(16), m[3][:5]):
        found = index.top([float(x) for x in q], 8)
        scored = frame.select("uri", (search.cosine_to(F.col("vector"), [float(x) for x in q]) * file_boost(F.col("path"))).alias("s")).groupBy("uri").agg(F.max("s").alias("s")).orderBy(F.desc("s"), "uri").limit(8)
        assert [(r[0], round(r[1], 9)) for r in found.rows.collect()] == [(r[0], round(r[1], 9)) for r in scored.collect()]
        assert found.total == 2003 and found.read <= found.total
    assert index.top([float(x) for x in m[3]], 8).read < 0.35 * 2003
    none = VectorIndex(spark, f"{tmp_path}/none").build(frame.limit(0), "uri")
    assert none.top([1.0], 3).rows.count() == 0
