"""Stream-log operators on small literal inputs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from brooklog.operators import log as L

REQ = "seq long, stream string, key string, payload string, request_id string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_offsets_are_dense_across_spans(spark):
    df = spark.createDataFrame([(n * 7, "ab"[n % 3 == 0]) for n in range(100)], "seq long, stream string")
    got = L.assign_offsets(df, "stream", "seq", "offset", span=50)
    for stream in "ab":
        own = [r["offset"] for r in got.filter(F.col("stream") == stream).orderBy("seq").collect()]
        assert own == list(range(len(own)))


def test_offsets_of_an_empty_table(spark):
    assert L.assign_offsets(spark.createDataFrame([], REQ), "stream", "seq", "offset").count() == 0


def test_publish_outcomes(spark):
    data = [(0, "s", None, "a", "id"), (1, "s", "", "a", "id"), (2, "s", None, "b", "id"), (3, "s", "k", "a", "id"), (4, "s", None, "c", None), (5, "s", None, "c", None), (6, "t", None, "a", "id")]
    got = rows(L.publish(spark.createDataFrame(data, REQ)), "seq", "outcome", "offset")
    assert got == [(0, "appended", 0), (1, "duplicate", 0), (2, "conflict", None), (3, "conflict", None), (4, "appended", 1), (5, "appended", 2), (6, "appended", 0)]


def test_retired_ids_append_again(spark):
    data = [(0, "s", None, "a", "id"), (9, "s", None, "b", "id"), (10, "s", None, "b", "id")]
    floor = spark.createDataFrame([("s", 5)], "stream string, floor_seq long")
    assert rows(L.publish(spark.createDataFrame(data, REQ), floor), "seq", "outcome", "offset") == [(0, "appended", 0), (9, "appended", 1), (10, "duplicate", 1)]


def test_publish_matches_a_sequential_model(spark):
    rnd = random.Random(5)
    data = [(n, rnd.choice("st"), rnd.choice([None, "", "k"]), rnd.choice("ab"), rnd.choice([None, "1", "2", "3"])) for n in range(200)]
    seen, nxt, want = {}, {}, []
    for seq, stream, key, payload, rid in data:
        content = (key or None, payload)
        if rid is not None and (stream, rid) in seen:
            offset, old = seen[stream, rid]
            want.append((seq, "duplicate", offset) if old == content else (seq, "conflict", None))
            continue
        offset = nxt.get(stream, 0)
        nxt[stream] = offset + 1
        want.append((seq, "appended", offset))
        if rid is not None:
            seen[stream, rid] = (offset, content)
    assert rows(L.publish(spark.createDataFrame(data, REQ)), "seq", "outcome", "offset") == sorted(want, key=lambda x: x[0])


def test_repeated_offsets_are_not_contiguous(spark):
    df = spark.createDataFrame([("a", n) for n in (0, 0, 3, 3)] + [("b", n) for n in range(4)] + [("c", 1)], "stream string, offset long")
    assert rows(L.contiguity_audit(df), "stream", "contiguous") == [("a", False), ("b", True), ("c", False)]


def test_names(spark):
    names = ["a.b-c_9", "", "a\n", "a b", "é", "x" * 128, "x" * 129, None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = df.select(L.valid_name(F.col("name")).alias("v"), L.name_error("member", F.col("name")).alias("e")).collect()
    assert [r["v"] for r in got] == [True, False, False, False, False, True, False, False]
    assert got[3]["e"] == "invalid member name 'a b'; use 1-128 ASCII letters, digits, '.', '_', or '-'" and got[0]["e"] is None


def test_identity_namespaces_never_meet(spark):
    data = [(0, "s", "k", "a", "id", "public"), (1, "s", "k", "b", "id", "dead_letter_move"), (2, "s", "k", "b", "id", "dead_letter_move"), (3, "s", "k", "c", "id", "dead_letter_move"), (4, "s", "k", "c", "id", "public")]
    got = rows(L.publish(spark.createDataFrame(data, REQ + ", identity_kind string")), "seq", "outcome", "offset")
    assert got == [(0, "appended", 0), (1, "appended", 1), (2, "duplicate", 1), (3, "corrupt", None), (4, "conflict", None)]


def test_moves_with_another_content_are_corrupt(spark):
    kind = "seq long, move_id string, key string, payload string"
    moves = spark.createDataFrame([(1, "a", "k", "x"), (2, "a", "k", "x"), (3, "a", "k", "y"), (4, "b", None, "x"), (5, "b", None, "z"), (6, "c", None, "x")], kind)
    done = spark.createDataFrame([(0, "b", None, "x")], kind)
    assert rows(L.append_moves(moves, done), "seq", "outcome") == [(1, "appended"), (2, "duplicate"), (3, "corrupt"), (4, "duplicate"), (5, "corrupt"), (6, "appended")]
    assert rows(L.new_moves(moves, done), "seq") == [(1,), (6,)]


def test_batch_shapes_and_lifecycle(spark):
    got = L.batch_shape(spark.range(3).withColumnRenamed("id", "b"), spark.createDataFrame([(0,), (2,), (2,), (2,)], "b long"), "b", 2)
    assert rows(got, "b", "records", "status") == [(0, 1, "ok"), (1, 0, "empty"), (2, 3, "too_many")]
    changes = spark.createDataFrame([("a", 1, "creating"), ("a", 2, "active"), ("a", 3, "creating"), ("b", 4, "creating")], "stream string, seq long, status string")
    assert rows(L.stream_status(changes), "stream", "status", "since") == [("a", "active", 2), ("b", "creating", 4)]


def test_selecting_by_time_matches_a_scan(spark):
    rnd = random.Random(2)
    data = [(s, n, rnd.randrange(100)) for s in "ab" for n in range(40)]
    rec = spark.createDataFrame(data, "stream string, offset long, published_at_ms long")
    asked = [(s, t) for s in "abz" for t in (0, 17, 50, 99, 100)]
    got = {(r["stream"], r["since_ms"]): (r["offset"], r["status"]) for r in L.time_selector(rec, spark.createDataFrame(asked, "stream string, since_ms long"), block=4).collect()}
    for s, t in asked:
        first = min((n for x, n, p in data if x == s and p >= t), default=None)
        assert got[s, t] == (first, "history_unavailable" if s == "z" else "no_match" if first is None else "found")


def test_a_stored_log_is_read_by_pushed_filters(spark, tmp_path):
    from brooklog.session import shared_table

    rec = spark.createDataFrame([("ab"[n % 2], n // 2, "k", f"p{n}") for n in range(100)], "stream string, offset long, key string, payload string")
    log = shared_table(rec, "test-log", ["stream", "offset"])
    asked = spark.createDataFrame([("a", 3), ("b", 49), ("b", 50)], "stream string, requested long")
    df = L.replay(log, asked)
    assert rows(df, "stream", "requested", "status", "payload") == [("a", 3, "ok", "p6"), ("b", 49, "ok", "p99"), ("b", 50, "history_unavailable", None)]
    assert "In(offset, [3,49,50])" in df._jdf.queryExecution().executedPlan().toString()


def test_rejected_records_use_no_offset(spark):
    data = [(0, "s", "k" * 128, "a", None), (1, "s", "k" * 129, "a", None), (2, "s", None, "a", None)]
    df = spark.createDataFrame(data, REQ).withColumn("batch", F.lit(0))
    got = L.publish_batch(df, "batch", L.limits_error(F.col("key"), F.col("payload"), F.col("request_id")))
    assert rows(got, "seq", "outcome", "offset") == [(0, "ok", 0), (1, "key_too_large", None), (2, "ok", 1)]


def test_names(spark):
    names = [("a.b-c_D9", True), ("", False), ("x" * 128, True), ("x" * 129, False), ("a b", False), ("é", False), (None, False)]
    df = spark.createDataFrame([(n,) for n, _ in names], "n string")
    assert [r[0] for r in df.select(L.valid_name(F.col("n"))).collect()] == [v for _, v in names]


def test_replay(spark):
    rec = spark.createDataFrame([("s", 0, "first"), ("s", 1, "second")], "stream string, offset long, payload string")
    asked = spark.createDataFrame([("s", 0), ("s", 2)], "stream string, requested long")
    assert rows(L.replay(rec, asked), "requested", "status", "payload", "earliest", "next_offset") == [(0, "ok", "first", 0, 2), (2, "history_unavailable", None, 0, 2)]


def test_replay_page_always_takes_its_first_record(spark):
    rec = spark.createDataFrame([("s", n, None, "x" * 10) for n in range(5)], "stream string, offset long, key string, payload string")
    assert rows(L.replay_page(rec, 1, 10, 3), "offset") == [(1,)]
    assert rows(L.replay_page(rec, 1, 10, 20), "offset") == [(1,), (2,)]
    assert rows(L.replay_page(rec, 1, 1, 99), "offset") == [(1,)]


def test_fnv1a64(spark):
    def fnv(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    words = ["", "a", "foobar", "é" * 40, "x" * 200]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(L.fnv1a64(F.col("w"))).collect()] == [fnv(w) for w in words]


def test_time_selector_with_clock_regression(spark):
    times = [5, 9, 3, 12, 11, 20]
    rec = spark.createDataFrame([("s", n, t) for n, t in enumerate(times)], "stream string, offset long, published_at_ms long")
    asked = spark.createDataFrame([("s", t) for t in range(0, 23)], "stream string, since_ms long")
    want = [(t, next((n for n, x in enumerate(times) if x >= t), None)) for t in range(0, 23)]
    assert rows(L.time_selector(rec, asked, block=2), "since_ms", "offset") == want


def test_retention_never_passes_a_cursor(spark):
    rec = spark.createDataFrame([("s", n, n * 10) for n in range(10)], "stream string, offset long, published_at_ms long")
    cur = spark.createDataFrame([("s", 3), ("s", 8)], "stream string, committed_offset long")
    assert rows(L.retention_floor(rec, cur, F.lit(70)), "floor") == [(3,)]
    assert rows(L.retention_floor(rec, cur, F.lit(10)), "floor") == [(1,)]


def test_migration_differences(spark):
    kind = "stream string, offset long, key string, payload string"
    a = spark.createDataFrame([("s", 0, None, "a"), ("s", 1, "k", "b"), ("s", 2, None, "c")], kind)
    b = spark.createDataFrame([("s", 0, None, "a"), ("s", 1, None, "b"), ("s", 3, None, "c")], kind)
    assert rows(L.migration_differences(a, b), "offset", "problem") == [(1, "changed"), (2, "missing"), (3, "extra")]
