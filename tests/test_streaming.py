"""Streaming results equal batch results; repeated batches change nothing."""

from __future__ import annotations

import random

from brooklog.operators import log as L
from brooklog.streaming import leases, publishing

REQ = "seq long, stream string, key string, payload string, request_id string"


def _requests(n):
    rnd = random.Random(9)
    return [(i, rnd.choice("st"), rnd.choice([None, "", "k"]), rnd.choice("ab"), rnd.choice([None, "1", "2", "3", "4"])) for i in range(n)]


def test_publishing_in_micro_batches(spark, tmp_path):
    data = _requests(90)
    for k in range(3):
        spark.createDataFrame(data[k * 30 : k * 30 + 30], REQ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    req = spark.readStream.schema(REQ).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    publishing.start(req, str(tmp_path / "log"), str(tmp_path / "ckpt")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).select("seq", "stream", "outcome", "offset").collect())
    want = sorted(tuple(r) for r in L.publish(spark.createDataFrame(data, REQ)).select("seq", "stream", "outcome", "offset").collect())
    assert got == want


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    path, data = str(tmp_path / "log"), _requests(40)
    for batch_id, part in ((0, data[:20]), (1, data[20:]), (1, data[20:])):
        out = publishing.publish_onto(spark.createDataFrame(part, REQ), publishing.history(spark, path, batch_id))
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    assert spark.read.parquet(path).count() == 40


def test_leases_expire_lazily(spark, tmp_path):
    rows = [("s", "c", 0, "deliver", 1, 100), ("s", "c", 50, "deliver", 1, 100), ("s", "c", 100, "ack", 1, 0), ("s", "c", 110, "deliver", 1, 100), ("s", "c", 90, "ack", 1, 0)]
    kind = "stream string, consumer string, t_ms long, action string, offset long, timeout_ms long"
    for r in rows:
        spark.createDataFrame([r], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    q = leases.track(src).writeStream.format("memory").queryName("lease_events").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["event"], r["attempt"]) for r in spark.table("lease_events").collect()]
    # rows of one batch are taken by time: deliver 0, deliver 50, ack 90, ack 100, deliver 110
    assert got == [("delivered", 1), ("held", 1), ("acknowledged", 1), ("stale", 0), ("delivered", 1)]


def test_leases_expire_by_the_watermark(spark, tmp_path):
    kind = "stream string, consumer string, t_ms long, action string, offset long, timeout_ms long"
    for r in [("s", "c", 0, "deliver", 1, 100), ("s", "other", 5000, "deliver", 9, 100), ("s", "third", 5001, "deliver", 9, 100)]:
        spark.createDataFrame([r], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = leases.track(src).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r["consumer"], r["event"], r["t_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("c", "delivered", 0) in got and ("c", "expired", 5000) in got  # consumer c has no further row


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    path, data = str(tmp_path / "log"), _requests(60)
    for k in range(2):
        spark.createDataFrame(data[k * 30 : k * 30 + 30], REQ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    req = spark.readStream.schema(REQ).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    publishing.start(req, path, str(tmp_path / "ckpt")).awaitTermination()
    plan = publishing.history(spark, path, 2, [3])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    ends = {r["stream"]: r["next_offset"] for r in publishing.heads(spark, path, 2).collect()}
    log = spark.read.parquet(path).filter("outcome = 'appended'").groupBy("stream").count().collect()
    assert ends == {r["stream"]: r["count"] for r in log}


def test_lease_steps():
    class Row:
        def __init__(self, t_ms, action, offset, timeout_ms=100):
            self.t_ms, self.action, self.offset, self.timeout_ms = t_ms, action, offset, timeout_ms

    live, tried, now, out = {}, {}, 0, []
    for r in (Row(0, "deliver", 1), Row(100, "ack", 1), Row(110, "deliver", 1), Row(5, "ack", 1)):
        now, e = leases.step(now, live, tried, r)
        out += [(x[1], x[2]) for x in e]
    assert out == [("delivered", 1), ("expired", 1), ("stale", 1), ("delivered", 2), ("acknowledged", 2)]
    assert now == 110
