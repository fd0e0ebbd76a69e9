"""Versioned tables: what a change writes, what readers see, and what two writers may do to each other."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from stratagraph.sources import versioned
from stratagraph.sources.versioned import Conflict, VersionedTables

SCHEMA = {"t": "path string, v long"}


def rows(spark, lo, hi, v):
    return spark.range(lo, hi).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("owner"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit(v).cast("long").alias("v"))


def files_of(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def held(store, version=None):
    return {r["path"]: r["v"] for r in store.load("t", version).collect()}


def test_one_changed_file_of_ten_thousand(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path), schemas=SCHEMA)
    store.begin().overwrite("t", rows(spark, 0, 10_000, 1)).commit()
    before = files_of(tmp_path)
    version = versioned.apply(store, rows(spark, 77, 78, 0).select("owner"), {"t": rows(spark, 77, 78, 2)})
    new = files_of(tmp_path) - before
    assert len(new) == 2 and len({f.split("bucket=")[1].split("/")[0] for f in new}) == 1
    assert sum(len(x) for x in store.written(version).values()) == 2
    assert held(store) == {f"f{k}": 2 if k == 77 else 1 for k in range(10_000)}
    plan = store.load_owned("t", ["f77"])
    assert [r["v"] for r in plan.collect()] == [2]
    assert len({f.split("bucket=")[1].split("/")[0] for f in plan.inputFiles()}) == 1


def test_removed_changed_and_older_versions(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path), 8, SCHEMA)
    assert store.load("t").count() == 0
    versioned.apply(store, rows(spark, 0, 20, 0).select("owner"), {"t": rows(spark, 0, 20, 1)})
    two = rows(spark, 0, 5, 2)
    versioned.apply(store, rows(spark, 0, 10, 0).select("owner"), {"t": two.union(two)})
    versioned.apply(store, rows(spark, 3, 4, 0).select("owner"), {"t": rows(spark, 3, 4, 3)})
    want = {f"f{k}": 3 if k == 3 else 2 if k < 5 else 1 for k in range(20) if not 5 <= k < 10}
    assert held(store) == want and store.load("t").count() == 15 + 4
    assert len(held(store, 1)) == 20 and set(held(store, 1).values()) == {1}
    assert store.compact(2) > 0 and held(store) == want and store.load("t").count() == 19
    assert store.compact(2) == 0
    versioned.apply(store, rows(spark, 19, 21, 0).select("owner"), {"t": rows(spark, 20, 21, 9)})
    del want["f19"]
    assert held(store) == want | {"f20": 9}
    store.commit({"t": rows(spark, 50, 51, 4)})
    assert held(store) == {"f50": 4}


def test_a_failed_change_leaves_no_trace(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path), 8, SCHEMA)
    store.commit({"t": rows(spark, 0, 5, 1)})
    broken = rows(spark, 0, 1, 2).withColumn("v", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        versioned.apply(store, rows(spark, 0, 1, 0).select("owner"), {"t": broken})
    assert held(store) == {f"f{k}": 1 for k in range(5)} and store.log.last() == 1


def test_two_writers(spark, tmp_path):
    """Changes of different buckets both land, whoever is first; of one bucket the second one raises."""
    store = VersionedTables(spark, str(tmp_path), 64, SCHEMA)
    store.commit({"t": rows(spark, 0, 100, 1)})
    bucket = {k: r[0] for k in range(10) for r in rows(spark, k, k + 1, 0).select(F.pmod(F.xxhash64("owner"), F.lit(64))).collect()}
    other = next(k for k in bucket if bucket[k] != bucket[0])
    a, b, c = store.begin(), store.begin(), store.begin()
    for change, k, v in ((a, 0, 2), (b, other, 3), (c, 0, 4)):
        change.replace(rows(spark, k, k + 1, 0).select("owner"), t=rows(spark, k, k + 1, v))
    assert (b.commit(), a.commit()) == (2, 3)
    with pytest.raises(Conflict):
        c.commit()
    assert held(store) == {f"f{k}": {0: 2, other: 3}.get(k, 1) for k in range(100)}
    whole, part = store.begin(), store.begin()
    whole.overwrite("t", rows(spark, 0, 1, 7))
    part.replace(rows(spark, 5, 6, 0).select("owner"), t=rows(spark, 5, 6, 8)).commit()
    with pytest.raises(Conflict):
        whole.commit()
    assert held(store)["f5"] == 8


def test_threads_never_lose_a_commit(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path), 64, SCHEMA)
    landed, lost = [], []

    def write(k):
        change = store.begin()
        change.replace(rows(spark, k, k + 1, 0).select("owner"), t=rows(spark, k, k + 1, k))
        try:
            landed.append((change.commit(), k))
        except Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(landed) + len(lost) == 6 and len({v for v, _ in landed}) == len(landed)
    assert held(store) == {f"f{k}": k for _, k in landed}


def test_numbers_are_given_once(spark, tmp_path):
    log = versioned.Log(spark, str(tmp_path / "log"))
    assert log.last() == 0 and log.add(1, {"a": 1}) and not log.add(1, {"a": 2}) and log.read(1) == {"a": 1} and log.last() == 1


def test_tables_of_a_group(spark, tmp_path):
    """One mark replaces an owner's rows in all tables of its group, also where one of them is merged or replaced."""
    store = VersionedTables(spark, str(tmp_path), 8, {"t": "path string, v long", "u": "path string, v long", "w": "path string, v long"}, {"t": "g", "u": "g"})
    one = store.begin().replace(rows(spark, 0, 4, 0).select("owner"), t=rows(spark, 0, 4, 1), u=rows(spark, 0, 4, 1), w=rows(spark, 0, 4, 1)).commit()
    store.begin().replace(rows(spark, 1, 3, 0).select("owner"), t=rows(spark, 1, 2, 2)).commit()
    got = lambda name: {r["path"]: r["v"] for r in store.load(name).collect()}
    want = {"t": {"f0": 1, "f1": 2, "f3": 1}, "u": {"f0": 1, "f3": 1}, "w": {f"f{k}": 1 for k in range(4)}}
    assert {name: got(name) for name in "tuw"} == want
    assert sorted(r[0] for r in store.changed(["u"], one).collect()) == ["f1", "f2"] and store.changed(["w"], one).count() == 0
    assert store.compact(2) and {name: got(name) for name in "tuw"} == want
    store.begin().overwrite("u", rows(spark, 7, 8, 5)).commit()
    assert got("u") == {"f7": 5} and got("t") == want["t"] and store.changed(["t", "u"], one) is None
    assert sorted(r[0] for r in store.changed(["t"], one).collect()) == ["f1", "f2"]


def test_old_versions_go(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path), 8, SCHEMA)
    for v in range(5):
        store.begin().replace(rows(spark, v, v + 2, 0).select("owner"), t=rows(spark, v, v + 2, v)).commit()
    pending = store.begin().replace(rows(spark, 9, 10, 0).select("owner"), t=rows(spark, 9, 10, 9))
    store.compact(2)
    before, want = len(files_of(tmp_path)), held(store)
    assert store.vacuum(1) > 0 and len(files_of(tmp_path)) < before and held(store) == want == {f"f{k}": min(k, 4) for k in range(6)}
    assert store.vacuum(1) == 0 and store.changed(["t"], 2) is None and store.changed(["t"], store.log.last()).count() == 0
    with pytest.raises(Exception):
        store.load("t", 2)
    if store.log.last() == 5:
        pending.commit()
        assert held(store)["f9"] == 9
