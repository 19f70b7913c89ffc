"""Nested results: loading, points, identity."""

from __future__ import annotations

import json

from brooklog.operators import history as H

SCENARIO = {"operation": "publish", "messages": 100, "message_size_bytes": 10, "throughput_messages_per_second": 50.0, "latency_microseconds": {"p50": 1.0, "p99": 2.0}, "resource_samples": {"cpu_seconds": 4.0, "memory_bytes_avg": 7.0}}
NEW = {"run_id": "r1", "generated_at": "2026-01-01", "resource_limits": {"b": "2", "a": "1"}, "workload": {"nodes": 3}, "backends": {"x": {"runtime": "native", "resource_samples": {"cpu_percent_max": 9.0}, "scenarios": [SCENARIO]}}}
OLD = {"run_id": "r0", "started_at": "2025-01-01", "container": {"runtime": "native"}, "scenarios": [SCENARIO]}


def test_results(spark, tmp_path):
    for name, text in (("a", json.dumps(NEW)), ("b", json.dumps(OLD)), ("c", "no json"), ("d", "[]"), ("e", "{}")):
        (tmp_path / f"{name}.json").write_text(text)
    runs = H.normalise(H.load(spark, str(tmp_path)))
    assert sorted((r["run_id"], r["suite"], list(r["backends"])) for r in runs.collect()) == [("r0", "local", ["local"]), ("r1", "cluster", ["x"])]
    got = {(r["backend"], r["operation"], r["metric"]): r["value"] for r in H.points(runs).collect()}
    assert got["x", "publish", "messages_per_cpu_second"] == 25.0 and got["x", "publish", "memory"] == 7.0
    assert got["x", "broker", "cpu_percent"] == 9.0 and ("local", "broker", "cpu_percent") not in got and ("x", "publish", "p999") not in got


def test_identity_ignores_the_order_of_keys(spark, tmp_path):
    other = NEW | {"run_id": "r2", "resource_limits": {"a": "1", "b": "2"}}
    third = NEW | {"run_id": "r3", "resource_limits": {"a": "1"}}
    for r in (NEW, other, third):
        (tmp_path / f"{r['run_id']}.json").write_text(json.dumps(r))
    ids = {r["run_id"]: r["identity"] for r in H.comparison_identity(H.normalise(H.load(spark, str(tmp_path)))).collect()}
    assert ids["r1"] == ids["r2"] != ids["r3"]
