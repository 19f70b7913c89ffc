"""Benchmark results as nested JSON: loading, normalising, unpivoting to points, identities and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCENARIO = """struct<operation:string,messages:bigint,message_size_bytes:bigint,elapsed_seconds:double,throughput_messages_per_second:double,
latency_microseconds:struct<p50:double,p99:double,p999:double,max:double>,
resource_samples:struct<samples:bigint,cpu_seconds:double,cpu_percent_max:double,memory_bytes_max:double,memory_bytes_avg:double,storage_bytes_max:double>,
metadata:map<string,string>>"""
_BACKEND = f"""struct<image:string,runtime:string,acknowledgement:string,replication:string,measurement_boundary:string,
resource_samples:struct<samples:bigint,cpu_percent_max:double,memory_bytes_max:double>,scenarios:array<{_SCENARIO}>>"""
SCHEMA = f"""schema_version int, run_id string, started_at string, generated_at string, status string, comparison_mode string, benchmark_suite string,
resource_limits map<string,string>, source struct<revision:string,profile:string>, workload struct<messages:bigint,warmup:bigint,concurrency:bigint,nodes:bigint>,
backends map<string,{_BACKEND}>, container {_BACKEND}, scenarios array<{_SCENARIO}>"""


def load(spark: SparkSession, path: str, default_backend: str = "local") -> DataFrame:
    """Results of a folder, one JSON object a file; what can't be read, or has neither run nor scenarios, is left out.

    An old result with `container` and `scenarios` at the top becomes one with a single backend.
    """
    raw = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    old = F.when(F.col("scenarios").isNotNull(), F.create_map(F.lit(default_backend), F.struct(*[F.col(f"container.{c}").alias(c) for c in ("image", "runtime", "acknowledgement", "replication", "measurement_boundary", "resource_samples")], F.col("scenarios").alias("scenarios"))))
    return raw.withColumn("backends", F.coalesce("backends", old)).drop("container", "scenarios").filter(F.col("backends").isNotNull() & F.coalesce("generated_at", "started_at").isNotNull())


def suite(name: Column, mode: Column, nodes: Column) -> Column:
    """The suite of a run: its own, else by comparison mode and node count."""
    return F.coalesce(name, F.when(mode == "external", "external-comparison").when(nodes > 1, "cluster").otherwise("local"))


def normalise(results: DataFrame) -> DataFrame:
    """Allow-listed columns with defaults."""
    return results.select(
        F.coalesce("run_id", F.sha2(F.to_json(F.struct("started_at", "generated_at", "source")), 256)).alias("run_id"),
        F.coalesce("generated_at", "started_at").alias("run_at"),
        F.coalesce("status", F.lit("complete")).alias("status"),
        F.coalesce("comparison_mode", F.lit("none")).alias("comparison_mode"),
        suite(F.col("benchmark_suite"), F.col("comparison_mode"), F.col("workload.nodes")).alias("suite"),
        F.coalesce("source.profile", F.lit("default")).alias("profile"),
        "resource_limits", "workload", "backends",
    )


def canonical(pairs: Column) -> Column:
    """A map as JSON with sorted keys: equal maps give equal texts; null is {}."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(pairs, F.create_map().cast("map<string,string>"))))))


def comparison_identity(results: DataFrame) -> DataFrame:
    """Adds identity: what two runs must share to be compared, over all their backends."""
    fields = ("runtime", "acknowledgement", "replication", "measurement_boundary")
    backends = F.array_sort(F.transform(F.map_entries("backends"), lambda e: F.to_json(F.struct(e["key"].alias("name"), *[e["value"][f].alias(f) for f in fields]))))
    return results.withColumn("identity", F.to_json(F.struct("suite", "comparison_mode", canonical(F.col("resource_limits")).alias("limits"), "workload", backends.alias("backends"))))


def first_known(*columns: str | Column) -> Column:
    """The first value that isn't null."""
    return F.coalesce(*columns)


def points(results: DataFrame) -> DataFrame:
    """(run_id, run_at, suite, profile, backend, operation, message_size_bytes, metric, value).

    A row for each scenario metric, and rows of operation `broker` without a size for each backend's own; nulls give none.
    """
    base = results.select("run_id", "run_at", "suite", "profile", F.explode("backends").alias("backend", "b"))
    ids = ["run_id", "run_at", "suite", "profile", "backend"]
    s = base.select(*ids, F.explode("b.scenarios").alias("s"))
    cpu = F.col("s.resource_samples.cpu_seconds")
    scenario = s.select(
        *ids, F.col("s.operation").alias("operation"), F.col("s.message_size_bytes").alias("message_size_bytes"),
        F.col("s.throughput_messages_per_second").alias("throughput"), F.col("s.latency_microseconds.p50").alias("p50"), F.col("s.latency_microseconds.p99").alias("p99"), F.col("s.latency_microseconds.p999").alias("p999"),
        first_known("s.resource_samples.memory_bytes_max", "s.resource_samples.memory_bytes_avg").alias("memory"), F.col("s.resource_samples.storage_bytes_max").alias("storage"),
        F.when((F.col("s.messages") > 0) & (cpu > 0), F.col("s.messages") / cpu).alias("messages_per_cpu_second"),
    )
    broker = base.select(*ids, F.lit("broker").alias("operation"), F.lit(None).cast("long").alias("message_size_bytes"), F.col("b.resource_samples.cpu_percent_max").alias("cpu_percent"), F.col("b.resource_samples.memory_bytes_max").alias("memory"))
    keys = [*ids, "operation", "message_size_bytes"]
    long = lambda df: df.unpivot(keys, [c for c in df.columns if c not in keys], "metric", "value")
    return long(scenario).unionByName(long(broker)).filter(F.col("value").isNotNull())


def multiset_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, columns...) of rows that one side has more often than the other."""
    return left.exceptAll(right).select(F.lit("left").alias("side"), "*").unionByName(right.exceptAll(left).select(F.lit("right").alias("side"), "*"))


def interval_max(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, interval_max): a lifetime maximum belongs to the interval only if it grew in it."""
    j = after.select(key, F.col("value").alias("_a")).join(before.select(key, F.col("value").alias("_b")), key)
    return j.select(key, F.when(F.col("_a") > F.col("_b"), F.col("_a")).alias("interval_max"))


def evidence(values: DataFrame, group: list[str], value: str, repetitions: str) -> DataFrame:
    """(group, low, high, sample_coverage_percent)."""
    return values.groupBy(*group).agg(F.min(value).alias("low"), F.max(value).alias("high"), (F.count(value) / F.max(repetitions) * 100).alias("sample_coverage_percent"))
