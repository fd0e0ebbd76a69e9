"""Order, late events, and a state that shrinks, of the stream of changing files."""

import json

from pyspark.sql import functions as F

from stratagraph.streaming import expiring


def test_order_lateness_and_forgetting(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    batches = [
        [("a", "1", 100, 1), ("a", "2", 90, 2), ("b", "1", 95, 3), ("c", None, 96, 4)],
        [("a", "2", 101, 5), ("z", "1", 300, 6)],
        [("a", "9", 50, 7), ("b", None, 310, 8), ("a", "1", 300, 9), ("a", "1", 300, 10)],
        [("z", "2", 2000, 11)],
        [("z", None, 9000, 12)],
        [("z", "3", 9001, 13)],
        [("end", "1", 20_000, 14)],
    ]
    schema = "path string, hash string, s long, event_id long"
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keys = []
    try:
        for k, rows in enumerate(batches):
            (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("path", "hash", "s", "event_id"), r))) for r in rows))
            stream = spark.readStream.schema(schema).json(str(source)).withColumn("ts", F.timestamp_seconds("s")).select("path", "hash", "ts", "event_id")
            found = expiring.statuses(stream, "20 seconds", 1000)
            query = found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            keys.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    got = {r["event_id"]: r["status"] for r in spark.read.parquet(str(out)).collect()}
    want = {2: "new", 3: "new", 4: "removed", 1: "modified", 5: "modified", 6: "new", 9: "modified", 10: "unchanged", 8: "removed", 11: "modified", 12: "removed", 13: "new"}
    assert got == want  # 7 came too late and 14 still waits
    assert keys[-1] < max(keys)
