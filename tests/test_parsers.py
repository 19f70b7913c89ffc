"""Parsers of tool output and manifests on literal texts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from brooklog.operators import stats as S
from brooklog.sources import parsers as P
from brooklog.sources import sinks


def one(spark, text, f):
    r = spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("o")).first()["o"]
    return r and r.asDict()


def test_producer_output_takes_the_last_summary(spark):
    line = "{} records sent, {} records/sec (0.1 MB/sec), 1.5 ms avg latency, 9.0 ms max latency, 1 ms 50th, 2 ms 95th, 3 ms 99th, 4.25 ms 99.9th."
    got = one(spark, line.format("5", "1.0") + "\n" + line.format("12,345", "99.5") + "\n", P.producer_output)
    assert got == {"messages": 12345, "messages_per_second": 99.5, "avg_us": 1500.0, "max_us": 9000.0, "p50_us": 1000.0, "p95_us": 2000.0, "p99_us": 3000.0, "p999_us": 4250.0}
    assert one(spark, "nothing", P.producer_output) is None and one(spark, None, P.producer_output) is None


def test_consumer_output_takes_the_last_row(spark):
    row = "2024-01-01 10:00:00:{}, 2024-01-01 10:00:01:250, 3.0, 2.5, 1000, 800.5, 1, 2"
    got = one(spark, "start.time, end.time\n" + row.format("000") + "\n " + row.format("500") + "\n\n", P.consumer_output)
    assert got == {"messages": 1000, "elapsed_ms": 750.0, "messages_per_second": 800.5, "megabytes_per_second": 2.5}
    assert one(spark, row.format("000").replace("1000,", "many,"), P.consumer_output) is None and one(spark, "", P.consumer_output) is None


def test_stats_output(spark):
    text = "Pub Stats: 1,234.5 msgs/sec ~ 2 MB/sec min: 1us avg: 2.5us max: 1,000us P50: 3us P90: 4us P99: 5us P99.9: 6us"
    got = one(spark, text, P.stats_output)
    assert (got["messages_per_second"], got["max_us"], got["p999_us"]) == (1234.5, 1000.0, 6.0)
    assert one(spark, "sub stats: 77 msgs/sec ~ 1 MB/sec", P.stats_output) == {"messages_per_second": 77.0} | dict.fromkeys(["min_us", "avg_us", "max_us", "p50_us", "p90_us", "p99_us", "p999_us"])
    assert one(spark, "x", P.stats_output) is None


def test_container_stats(spark):
    assert one(spark, '{"CPUPerc":"12.5%","MemUsage":"1.5MiB / 2GiB","MemPerc":"0.1%"}', P.container_stats) == {"cpu_percent": 12.5, "memory_bytes": 1572864.0, "memory_percent": 0.1}
    assert one(spark, '{"CPUPerc":"--","MemUsage":"1MiB / 2GiB","MemPerc":"0.1%"}', P.container_stats) is None and one(spark, "no json", P.container_stats) is None


def manifest(**change):
    seen = {"metric": "in_flight", "scope": "all", "held_delivery_count": 2, "expected_metric_value": 2}
    m = {"schema_version": 1, "workloads": {"background_work": {"messages": 20, "budgets": {"p99": 5}, "registered_observations": {"in_flight_deliveries_while_two_held": seen}}, "events_replay": {"budgets": {"p99": 5}}}}
    for path, v in change.items():
        at = m
        *ups, last = path.split("__")
        for u in ups:
            at = at[u]
        at[last] = v
    return json.dumps(m)


SEEN = "workloads__background_work__registered_observations__in_flight_deliveries_while_two_held"


@pytest.mark.parametrize(
    "change, said",
    [
        ({}, []),
        ({"schema_version": 2}, ["schema_version must be 1"]),
        ({"workloads__events_replay__budgets": {"p99": 0, "a": 1}}, ["budget events_replay.p99 must be positive"]),
        ({"workloads__events_replay__budgets": None}, ["workload events_replay has no budgets"]),
        ({f"{SEEN}__held_delivery_count": 3}, ["exactly two deliveries must be held", "the expected value must equal the held count"]),
        ({f"{SEEN}__metric": "other"}, ["the observation must use in_flight"]),
        ({f"{SEEN}__scope": " "}, ["the observation has no scope"]),
        ({"workloads__background_work__messages": 1}, ["too few messages"]),
    ],
)
def test_manifests(spark, change, said):
    df = spark.createDataFrame([(manifest(**change),)], "text string")
    assert [r["violation"] for r in P.manifest_violations(df, "in_flight").collect()] == said


def test_broken_manifests_break_rules(spark):
    df = spark.createDataFrame([("no json",), ("{}",)], "text string")
    assert {r["text"] for r in P.manifest_violations(df, "in_flight").collect()} == {"no json", "{}"}


def test_pairs_with_outliers_are_dropped(spark):
    side = lambda values: spark.createDataFrame([("x", i * 10, float(v)) for i, v in enumerate(values)], "g string, i long, v double")
    now, old = side([10, 11, 10, 11, 900, 7]), side([10, 10, 10, 10, 10])
    got = sorted((r["place"], r["outlier"]) for r in S.paired_samples(now, old, "g", "i", "v").collect())
    assert got == [(0, False), (1, False), (2, False), (3, False), (4, True)]
    r = S.paired_direction(now, old, "g", "i", "v", True).first()
    assert (r["status"], r["direction"], r["scenarios"], r["paired_samples"], r["improved"]) == ("available", "generally improved", 1, 4, 1) and abs(r["median_delta_percent"] - 5) < 1e-9
    assert S.paired_direction(now, old, "g", "i", "v", False).first()["direction"] == "generally worsened"
    none = S.paired_direction(now, old.limit(0), "g", "i", "v", True).first()
    assert (none["status"], none["direction"], none["scenarios"]) == ("unavailable", None, 0)


def test_cells_are_bounded_and_escaped(spark):
    got = one(spark, " a<b>&|\\\r\n" + "x" * 200, lambda t: F.struct(S.bound_text(t).alias("c")))["c"]
    assert got.startswith("a&lt;b&gt;&amp;\\|\\\\  xx") and got.endswith("x…")


def test_exact_budgets_and_ledger(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3), (None, 9.0, 4)], "a double, b double, c long")
    assert [r["passed"] for r in S.budget_checks(df, {"a": 1.0}, {"b": 2.0}, {"c": 3}).collect()] == [True, False]
    for n in range(2):
        sinks.append_ledger(df, str(tmp_path / "ledger"), F.lit(n).cast("long"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 4
