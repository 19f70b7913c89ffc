"""Statistics, metrics, parsers and checks on hand-checked inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from brooklog.functions.checksum import crc32c, crc32c_column
from brooklog.operators import metrics as M
from brooklog.operators import stats as S
from brooklog.operators import verify as V
from brooklog.sources import parsers as P
from brooklog.sources import sinks


def test_repetition_summary(spark):
    df = spark.createDataFrame([("s", 1000.0), ("s", 2000.0), ("one", 5.0)], "g string, v double")
    r = {x["g"]: x for x in S.repetition_summary(df, ["g"], "v").collect()}
    assert (r["s"]["median"], r["s"]["minimum"], round(r["s"]["relative_range_percent"], 3), r["s"]["stdev"]) == (1500, 1000, 66.667, 500)
    assert r["one"]["stdev"] == 0


def test_empty_percentile_is_zero(spark):
    df = spark.createDataFrame([("s", None)], "g string, v double")
    assert S.percentiles(df, ["g"], "v", {"p50": 50}).first()["p50"] == 0.0


def test_tukey_needs_four_values(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", float(v)) for v in (1, 2, 900)], "g string, v double")
    assert [(r["g"], r["v"]) for r in S.tukey_outliers(df, "g", "v", ["g", "v"]).collect()] == [("a", 100.0)]


def test_delta_vs_previous(spark):
    df = spark.createDataFrame([("s", "1", 0.0), ("s", "2", 5.0), ("s", "3", 5.0)], "s string, run string, v double")
    got = [(r["previous"], r["delta"], r["delta_percent"], r["improved"]) for r in S.delta_vs_previous(df, "s", "run", "v", True).orderBy("run").collect()]
    assert got == [(None, None, None, None), (0.0, 5.0, None, True), (5.0, 0.0, 0.0, False)]


def test_baseline_first_wins_and_nulls_match(spark):
    now = spark.createDataFrame([(None, 4.0), ("k", 6.0)], "k string, v double")
    old = spark.createDataFrame([(None, 1, -2.0), (None, 2, 9.0), ("k", 1, 0.0)], "k string, n int, v double")
    got = {r["k"]: (r["baseline"], r["delta_percent"]) for r in S.baseline_delta(now, old, ["k"], "n", "v").collect()}
    assert got == {None: (-2.0, 300.0), "k": (0.0, None)}


def test_median_or_first(spark):
    df = spark.createDataFrame([("a", 1, "1"), ("a", 2, "4"), ("b", 1, "x"), ("b", 2, "4")], "g string, n int, v string")
    got = {r["g"]: (r["number"], r["text"]) for r in S.median_or_first(df, ["g"], "v", "n").collect()}
    assert got == {"a": (2.5, None), "b": (None, "x")}


def test_stability(spark):
    df = spark.createDataFrame([("s", 100.0, 5.0), ("s", 101.0, 5.5), ("s", 102.0, 5.2), ("u", 100.0, 5.0), ("u", 150.0, 9.0)], "g string, t double, p double")
    got = {r["g"]: (r["status"], r["reasons"]) for r in S.stability(df, "g", "t", "p").collect()}
    assert got == {"s": ("stable", ""), "u": ("inconclusive", "too few repetitions; throughput varies; p99 varies")}


def test_guarded_delta(spark):
    k = "g string, count long, sum long"
    got = {r["g"]: (r["count_delta"], r["mean"], r["available"]) for r in M.guarded_delta(spark.createDataFrame([("a", 1, 10), ("b", 5, 10)], k), spark.createDataFrame([("a", 3, 20), ("b", 4, 30)], k), "g").collect()}
    assert got == {"a": (2, 5.0, True), "b": (None, None, False)}


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", 0.0001), ("a", 0.5), ("a", 99.0)], "g string, s double")
    got = {r["le"]: r["count"] for r in M.latency_histogram(df, F.col("s"), "g").collect()}
    assert got == {"0.0001": 1, "0.001": 1, "0.01": 1, "0.1": 1, "1": 2, "10": 2, "+Inf": 3}


def test_sample_page_wraps(spark):
    df = spark.createDataFrame([(n,) for n in range(5)], "group_id long")
    assert sorted(r[0] for r in M.sample_page(df, 3, 3).collect()) == [0, 1, 4]


def test_exposition(spark):
    df = spark.createDataFrame([("up", {}, 1.0), ("x", {"b": 'q"', "a": "1"}, 2.5), ("gone", {}, None)], "name string, labels map<string,string>, value double")
    assert sorted(r[0] for r in M.exposition(df).collect()) == ["up 1.0", 'x{a="1",b="q\\""} 2.5']


def test_schedule_and_matrix(spark):
    s = V.hot_cold_schedule(spark).orderBy("offset").collect()
    assert [r["offset"] for r in s] == list(range(64 + 4 * 8))
    assert [r["key"] for r in s[:6]] == ["hot", "cold-1", "cold-2", "cold-3", "cold-4", "hot"]
    assert V.case_matrix(spark, {"a": [1, 2], "b": ["x"]}, 3).count() == 6
    with pytest.raises(ValueError):
        V.case_matrix(spark, {"a": [1, 2]}, 3, most=5)


def test_per_key_ordering(spark):
    df = spark.createDataFrame([("k", 0, 0, 5), ("k", 2, 6, 9), ("k", 1, 8, 10)], "key string, offset long, a long, b long")
    r = V.per_key_ordering(df, "key", "offset", "a", "b").first()
    assert (r["deliveries"], r["out_of_order"], r["most_in_flight"]) == (3, 1, 2)


def test_parsers(spark):
    lines = spark.createDataFrame([("metric 2",), ('metric{operation="publish"} 3',), ("# HELP",), ("",), ("bad x",), ("alone",)], "value string")
    assert sorted((r["name"], r["value"]) for r in P.prometheus(lines).collect()) == [("metric", 2.0), ('metric{operation="publish"}', 3.0)]
    t = spark.createDataFrame([("stage=apply elapsed_us=12",), ("stage=apply",), ("noise",)], "value string")
    assert [tuple(r) for r in P.timings(t).collect()] == [("apply", 12)]
    sizes = spark.createDataFrame([("12.5MiB / 2GiB",), ("5kB",), ("7",), ("x",)], "t string")
    assert [r[0] for r in sizes.select(P.size_bytes(F.col("t"))).collect()] == [12.5 * 2**20, 5000.0, 7.0, None]
    assert P.cpu_seconds(spark.createDataFrame([("usage_usec 1500000",), ("user_usec 3",)], "value string")).first()[0] == 1.5
    assert P.cpu_seconds(spark.createDataFrame([("2500000000",)], "value string")).first()[0] == 2.5


def test_crc32c(spark):
    assert crc32c([b"123456789", b"", None, b"a" * 1000, b"123456789"])[:3] == [0xE3069283, 0, None]
    df = spark.createDataFrame([(b"123456789",), (None,)], "b binary")
    assert [r[0] for r in df.select(crc32c_column(F.col("b"))).collect()] == [0xE3069283, None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(n, "a|b" * 60) for n in range(40)], "n long, t string")
    sinks.write_snapshot(df.limit(3), str(tmp_path / "snap"))
    sinks.write_snapshot(df, str(tmp_path / "snap"))
    assert sinks.read_snapshot(spark, str(tmp_path / "snap")).count() == 40
    text = sinks.markdown(df, ["n", "t"], ["n"])
    assert text.count("\n") == 34 and "a\\|b" in text and "…" in text
    sinks.write_json(df, str(tmp_path / "json"), ["n"])
    assert spark.read.json(str(tmp_path / "json")).columns == ["n"]


def test_percentiles_by_rank_equal_those_of_whole_groups(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("abc"), float(rnd.randrange(40)) if rnd.random() < 0.9 else None) for _ in range(500)] + [("d", None), ("e", 7.5), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = {"p0": 0, "p50": 50, "p95": 95, "p999": 99.9, "p100": 100}
    key = lambda r: str(r["g"])
    got, want = (sorted(f.collect(), key=key) for f in (S.percentiles_by_rank(df, "g", "v", ps), S.percentiles(df, ["g"], "v", ps)))
    assert len(got) == 6
    for a, b in zip(got, want):
        assert a["g"] == b["g"] and a["samples"] == b["samples"] and all(abs(a[p] - b[p]) < 1e-9 for p in ps)
