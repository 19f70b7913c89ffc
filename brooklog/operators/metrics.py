"""Operational metrics: counters, histograms, lag, guarded deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed bounds of the latency histogram, in seconds.
BOUNDS = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0)
#: Fixed labels of operations, and the operations that share one.
LABELS = ("create_stream", "publish", "poll", "poll_batch", "replay", "poll_group", "configure_consumer", "inspect_consumer", "ack", "ack_batch", "ack_group", "health", "invalid_request")
SHARED = {"publish_bytes": "publish", "publish_batch": "publish", "poll_group_batch": "poll_batch", "ack_group_batch": "ack_batch"}


def latency_histogram(samples: DataFrame, seconds: Column, group: str) -> DataFrame:
    """(group, le, count): cumulative counts at each bound and +Inf."""
    counts = samples.groupBy(group).agg(*[F.count_if(seconds <= b).alias(f"_{i}") for i, b in enumerate(BOUNDS)], F.count(seconds).alias("_n"))
    rows = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_{i}").alias("count")) for i, b in enumerate(BOUNDS)] + [F.struct(F.lit("+Inf").alias("le"), F.col("_n").alias("count"))]
    return counts.select(group, F.inline(F.array(*rows)))


def latency_totals(samples: DataFrame, seconds: Column, group: str) -> DataFrame:
    """(group, count, sum_seconds): what goes with a histogram's buckets."""
    return samples.groupBy(group).agg(F.count(seconds).alias("count"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("sum_seconds"))


def operation_counters(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """(operation, requests, failures) of requests (request, failed), with zero rows for labels not seen; a request that is none of
    the operations is an invalid one."""
    mapped = F.create_map(*[F.lit(x) for kv in SHARED.items() for x in kv])
    label = F.coalesce(mapped[F.col("request")], F.when(F.col("request").isin(*LABELS), F.col("request")), F.lit("invalid_request"))
    counted = requests.groupBy(label.alias("operation")).agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("failures"))
    labels = spark.createDataFrame([(x,) for x in LABELS], "operation string")
    zero = F.lit(0).cast("long")
    return labels.join(counted, "operation", "left").select("operation", F.coalesce("requests", zero).alias("requests"), F.coalesce("failures", zero).alias("failures"))


def traffic(records: DataFrame, deliveries: DataFrame, acks: DataFrame) -> DataFrame:
    """(stream, published_bytes, deliveries, delivered_bytes, acknowledged); acks (stream, outcome) count if acknowledged."""
    size = F.octet_length("payload") + F.coalesce(F.octet_length("key"), F.lit(0))
    p = records.groupBy("stream").agg(F.sum(size).alias("published_bytes"))
    d = deliveries.groupBy("stream").agg(F.count(F.lit(1)).alias("deliveries"), F.sum(size).alias("delivered_bytes"))
    a = acks.groupBy("stream").agg(F.count_if(F.col("outcome") == "acknowledged").alias("acknowledged"))
    zero = F.lit(0).cast("long")
    return p.join(d, "stream", "left").join(a, "stream", "left").select("stream", "published_bytes", *[F.coalesce(c, zero).alias(c) for c in ("deliveries", "delivered_bytes", "acknowledged")])


def health(records: DataFrame, leases: DataFrame, attempts: DataFrame, most_attempts: int) -> DataFrame:
    """One row: streams, stored bytes, in flight, redeliveries, dead letters."""
    size = F.octet_length("payload") + F.coalesce(F.octet_length("key"), F.lit(0))
    a = records.agg(F.count_distinct("stream").alias("streams"), F.sum(size).alias("bytes"))
    b = leases.agg(F.count(F.lit(1)).alias("in_flight"))
    c = attempts.agg(F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).cast("long").alias("redeliveries"), F.count_if(F.col("attempts") >= most_attempts).alias("dead_letters"))
    return a.join(b).join(c)  # one row each


def replication_lag(progress: DataFrame) -> DataFrame:
    """(peer, lag): the largest of last+1 less matched+1 over a peer's groups, never below 0; null positions are 0."""
    zero = F.lit(0)
    lag = F.greatest(F.coalesce(F.col("last") + 1, zero) - F.coalesce(F.col("matched") + 1, zero), zero)
    return progress.groupBy("peer").agg(F.max(lag).cast("long").alias("lag"))


def sample_page(groups: DataFrame, cursor: int, most: int) -> DataFrame:
    """The next `most` group ids after cursor, going on from the smallest at the end."""
    order = F.struct((F.col("group_id") <= cursor).cast("int").alias("wrapped"), "group_id")
    return groups.select("group_id").distinct().orderBy(order).limit(most)


def write_counters(writes: DataFrame) -> DataFrame:
    """(role, operation, attempts, failures, bytes_offered, bytes_completed), and elapsed_ns where writes have it."""
    more = [F.sum("elapsed_ns").alias("elapsed_ns")] if "elapsed_ns" in writes.columns else []
    return writes.groupBy("role", "operation").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("failed").alias("failures"), F.sum("bytes").alias("bytes_offered"), F.coalesce(F.sum(F.when(~F.col("failed"), F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_completed"), *more)


#: Fixed labels of what writes to disk, and of its steps.
WRITE_ROLES = ("raft_log_rewrite", "state_machine_journal_append", "state_machine_journal_compaction", "state_machine_checkpoint", "state_machine_snapshot", "raft_log_segment_append", "raft_log_control_state")
WRITE_STEPS = ("serialize", "snapshot_state_serialize", "write_all", "sync_data", "sync_all", "rename", "directory_sync")


def write_matrix(spark: SparkSession, writes: DataFrame) -> DataFrame:
    """write_counters for every role and step, zeros where nothing was written; other roles and steps are left out."""
    labels = spark.createDataFrame([(r, o) for r in WRITE_ROLES for o in WRITE_STEPS], "role string, operation string")
    counted = write_counters(writes)
    return labels.join(counted, ["role", "operation"], "left").na.fill(0)


def build_metrics(builds: DataFrame) -> DataFrame:
    """(node, started, completed, failed, in_progress, total_ms, longest_ms) of snapshot builds (node, status, ms)."""
    done = F.col("status") == "completed"
    g = builds.groupBy("node").agg(F.count(F.lit(1)).alias("started"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.when(done, F.col("ms"))).alias("total_ms"), F.max(F.when(done, F.col("ms"))).alias("longest_ms"))
    return g.select("node", "started", "completed", "failed", (F.col("started") - F.col("completed") - F.col("failed")).alias("in_progress"), "total_ms", "longest_ms")


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, delta) of metrics in both snapshots (name, value); resets give negative deltas."""
    return after.select("name", F.col("value").alias("_a")).join(before.select("name", F.col("value").alias("_b")), "name").select("name", (F.col("_a") - F.col("_b")).alias("delta"))


def restart_deltas(snapshots: DataFrame) -> DataFrame:
    """(phase, name, delta) of snapshots (phase, name, value) in the phases initial, before_restart and after_restart.

    same_process compares initial with before_restart, restart the latter with after_restart, whose counters may have
    begun anew; a metric that either lacks is left out, and so is all of a pair with a missing snapshot.
    """
    of = lambda p: snapshots.filter(F.col("phase") == p)
    within = metric_delta(of("initial"), of("before_restart")).select(F.lit("same_process").alias("phase"), "name", "delta")
    return within.unionByName(metric_delta(of("before_restart"), of("after_restart")).select(F.lit("restart").alias("phase"), "name", "delta"))


def guarded_delta(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """(group, count_delta, sum_delta, mean, available): if any counter of a group fell, nothing is available."""
    j = after.select(group, F.col("count").alias("_c1"), F.col("sum").alias("_s1")).join(before.select(group, F.col("count").alias("_c0"), F.col("sum").alias("_s0")), group)
    ok = (F.col("_c1") >= F.col("_c0")) & (F.col("_s1") >= F.col("_s0"))
    c, s = F.when(ok, F.col("_c1") - F.col("_c0")), F.when(ok, F.col("_s1") - F.col("_s0"))
    return j.select(group, c.alias("count_delta"), s.alias("sum_delta"), (s / F.nullif(c, F.lit(0))).alias("mean"), ok.alias("available"))


def exposition(metrics: DataFrame) -> DataFrame:
    """One text line for each sample (name, labels, value), in Prometheus' text format; null values give no line."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ",")
    line = F.concat(F.col("name"), F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    return metrics.filter(F.col("value").isNotNull()).select(line.alias("line"))


def exposition_headers(kinds: DataFrame) -> DataFrame:
    """The two lines (name, place, line) before a metric's samples, from (name, help, kind); line ends and backslashes of the help are escaped."""
    text = F.replace(F.replace(F.coalesce("help", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    lines = F.array(F.struct(F.lit(0).alias("place"), F.concat(F.lit("# HELP "), "name", F.lit(" "), text).alias("line")), F.struct(F.lit(1).alias("place"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind").alias("line")))
    return kinds.select("name", F.inline(lines))
