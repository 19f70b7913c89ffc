"""Delivery operators, with a sequential model as the judge."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from brooklog.operators import delivery as D

REC = "stream string, offset long, key string, payload string, published_at_ms long"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_cursor_absorbs_parked_acks(spark):
    rec = frame(spark, [("s", n, None, "x", 0) for n in range(3)], REC)
    cur = lambda acks: D.consumer_cursor(rec, frame(spark, [("s", a) for a in acks], "stream string, offset long")).first()["committed_offset"]
    assert [cur([]), cur([1]), cur([0, 1]), cur([0, 1, 2])] == [0, 0, 2, 3]


def test_batch_matches_a_sequential_model(spark):
    rnd = random.Random(2)
    for _ in range(3):
        recs = [("s", n, rnd.choice([None, "a", "b", "c", "d"]), "x" * rnd.randrange(9), 0) for n in range(60)]
        acked = [("s", n) for n in range(60) if rnd.random() < 0.3]
        leases = [("s", r[1], r[2], rnd.randrange(200)) for r in recs if rnd.random() < 0.05]
        retries = [("s", r[1], r[2], rnd.randrange(200)) for r in recs if rnd.random() < 0.05]
        now = 100
        held = [(o, k) for _, o, k, t in leases + retries if t > now]
        out = {o for _, o in acked} | {o for o, _ in held}
        keys = {k for _, k in held if k is not None}
        want, used = [], set()
        for _, o, k, _, _ in recs:
            if o in out or (k is not None and (k in keys or k in used)):
                continue
            want.append(o)
            used.add(k)
        cand = D.eligible(frame(spark, recs, REC), frame(spark, acked, "stream string, offset long"), frame(spark, leases, "stream string, offset long, key string, deadline_ms long"), frame(spark, retries, "stream string, offset long, key string, retry_not_before_ms long"), F.lit(now))
        got = [r["offset"] for r in D.batch(cand, 7, 10_000).orderBy("offset").collect()]
        assert got == want[:7]


def test_byte_budget_stops_at_the_first_that_does_not_fit(spark):
    rec = frame(spark, [("s", 0, None, "x" * 10, 0), ("s", 1, None, "x" * 100, 0), ("s", 2, None, "x", 0)], REC)
    first = D.batch(rec, 10, 1000).filter("offset = 0").first()["batch_bytes"]
    assert [r["offset"] for r in D.batch(rec, 10, first + 20).collect()] == [0]


def varint(n):
    return 1 if n < 128 else 1 + varint(n >> 7)


def field(n):
    return 1 + varint(n) + n


def test_reply_sizes_follow_the_wire(spark):
    rnd = random.Random(3)
    rows = [("stream" * rnd.randrange(1, 30), rnd.choice([0, 127, 128, 2**40]), rnd.choice([None, "", "é" * rnd.randrange(200)]), "x" * rnd.randrange(40_000), rnd.choice([0, 1_705_000_000_000]), rnd.choice([None, 1, 300])) for _ in range(60)]
    df = frame(spark, rows, "stream string, offset long, key string, payload string, published_at_ms long, attempt int")
    got = df.select("*", D.item_bytes("cé", "m", D.token_of("seed"), F.col("attempt")).alias("item"), D.empty_batch_bytes("cé").alias("empty"), D.poll_bytes("cé", None, F.lit(None).cast("string"), F.col("attempt")).alias("poll")).collect()
    for r in got:
        names = field(len(r["stream"])) + field(3)
        body = names + 1 + varint(r["offset"]) + field(len(r["payload"])) + 1 + varint(r["published_at_ms"])
        body += 0 if r["key"] is None else field(len(r["key"].encode()))
        body += 0 if r["attempt"] is None else 1 + varint(r["attempt"])
        full = body + field(1) + field(len(f"seed-{r['offset']:x}"))
        assert r["item"] == field(4 + field(full)) and r["poll"] == field(4 + field(body)) and r["empty"] == field(field(names))


def test_a_first_record_that_does_not_fit_is_an_error(spark):
    rec = frame(spark, [("s", 0, None, "x" * 500, 5), ("s", 1, None, "x", 5), ("t", 0, None, "x", 5)], REC)
    got = {(r["stream"], r["offset"]): (r["status"], r["delivery_token"]) for r in D.batch(rec, 10, 200).collect()}
    assert got == {("s", 0): ("ConsumeBatchRecordTooLarge", None), ("t", 0): ("ok", "seed-0")}
    assert {r["status"] for r in D.batch(rec, 10, 5).collect()} == {"InvalidBatchRequest"}


def test_poll_step(spark):
    rec = frame(spark, [("s", n, k, "x", 5) for n, k in enumerate(["a", "a", "b", None])] + [("t", 0, None, "x", 5), ("u", 0, None, "x" * 900, 5)], REC)
    lease = "stream string, offset long, key string, member string, deadline_ms long"
    pairs = "stream string, offset long"

    def run(leases, acked=(), attempts=(), most=100, policy=(0, 3)):
        out = D.poll_step(rec, frame(spark, list(acked), pairs), frame(spark, leases, lease), frame(spark, [], pairs + ", key string, retry_not_before_ms long"), frame(spark, list(attempts), pairs + ", attempts int"), F.lit(100), "m", most, policy)
        return {(r["stream"], r["action"], r["offset"], r["attempt"]) for r in out.collect()}

    rest = {("t", "deliver", 0, 1), ("u", "too_large", 0, 1)}
    assert run([]) == {("s", "deliver", 0, 1)} | rest
    assert run([("s", 0, "a", "n", 200)]) == {("s", "deliver", 2, 1)} | rest  # offset 1 shares the key
    assert run([("s", 0, "a", "m", 200)], attempts=[("s", 0, 2)]) == {("s", "existing", 0, 2)} | rest
    assert run([("s", 0, "a", "n", 100)], attempts=[("s", 0, 1)]) == {("s", "retry", 0, 1), ("s", "deliver", 0, 2)} | rest  # expired, no delay
    assert run([("s", 0, "a", "n", 100)], attempts=[("s", 0, 1)], policy=(50, 3)) == {("s", "retry", 0, 1), ("s", "deliver", 2, 1)} | rest
    assert run([("s", 0, "a", "n", 100)], attempts=[("s", 0, 3)]) == {("s", "dead_letter", 0, 3), ("s", "deliver", 1, 1)} | rest
    assert run([], acked=[("t", 0)]) == {("s", "deliver", 0, 1), ("t", "empty", None, None), ("u", "too_large", 0, 1)}
    # a reply that is too large leaves the stream as it is: its expired lease is not changed
    assert ("u", "retry", 0, 1) not in run([("u", 0, None, "n", 100)], attempts=[("u", 0, 1)]) and ("u", "retry", 0, 1) in run([("u", 0, None, "n", 100)], attempts=[("u", 0, 1)], most=2000)


def test_limits_and_attempts(spark):
    df = frame(spark, [(1, 1), (0, 1), (1025, 1), (1024, 65 << 20), (5, (65 << 20) + 1), (None, 1), (1, None)], "r long, b long")
    said = [r[0] for r in df.select(D.consume_limits_error(F.col("r"), F.col("b"))).collect()]
    assert [x and x.split()[0] for x in said] == [None, "max_records", "max_records", None, "max_bytes", "max_records", "max_bytes"]
    df = frame(spark, [("Connect", False, None), ("InvalidHello", False, None), ("Other", False, None), (None, True, "Confirmed"), ("Connect", True, None)], "f string, replied boolean, said string")
    assert [r[0] for r in df.select(D.attempt_outcome(F.col("f"), F.col("replied"), F.col("said"))).collect()] == ["Retryable", "Rejected", "Unknown", "Confirmed", "Unknown"]


def test_clock_and_cursor_over_spans(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("st"), n, rnd.randrange(1000)) for n in range(200)]
    got = {(r["stream"], r["seq"]): r["now_ms"] for r in D.clock_floor(frame(spark, rows, "stream string, seq long, observed_ms long"), span=16).collect()}
    for s, n, _ in rows:
        assert got[s, n] == max(t for x, m, t in rows if x == s and m <= n)


def test_varint_bytes(spark):
    values = [0, 1, 127, 128, 16383, 16384, 2**31]
    df = frame(spark, [(v,) for v in values], "n long")
    assert [r[0] for r in df.select(D.varint_bytes(F.col("n"))).collect()] == [1, 1, 1, 2, 2, 3, 5]


def test_folds(spark):
    kind = "stream string, consumer string, seq long, event_type string, offset long, attempt int, retry_not_before_ms long, policy struct<ack_timeout_ms:long,max_attempts:int,retry_delay_ms:long>"
    p, q = (1, 2, 3), (4, 5, 6)
    ev = [(1, "delivery_attempt", 0, 3, None, p), (2, "delivery_attempt", 0, 2, None, q), (3, "retry_schedule", 0, None, 50, None), (4, "retry_schedule", 0, None, 60, None), (5, "retry_schedule", 1, None, 70, None), (6, "acknowledge", 1, None, None, None), (7, "acknowledge", 2, None, None, None), (8, "policy_configured", None, None, None, p), (9, "policy_configured", None, None, None, p), (10, "policy_configured", None, None, None, q)]
    df = frame(spark, [("s", "c", *e) for e in ev], kind)
    a = D.fold_attempts(df).first()
    assert (a["attempts"], a["first_policy"]["max_attempts"]) == (3, 2)
    assert [(r["offset"], r["retry_not_before_ms"]) for r in D.fold_retries(df).collect()] == [(0, 50)]
    c = D.fold_cursor(df).first()
    assert (c["committed_offset"], c["parked"]) == (0, 2)
    assert [r["version"] for r in D.policy_versions(df).orderBy("seq").collect()] == [1, 1, 2]
    assert D.current_policy(df, df).first()["max_attempts"] == 5


def test_ack_ladder(spark):
    leases = frame(spark, [("s", 5, "m", "t5", 100)], "stream string, offset long, member string, delivery_token string, deadline_ms long")
    acked = frame(spark, [("s", 7)], "stream string, offset long")
    tried = frame(spark, [("s", 5, 1), ("s", 6, 1)], "stream string, offset long, attempts int")
    cur = frame(spark, [("s", 3)], "stream string, committed_offset long")
    asks = [(1, "m", "x"), (7, "m", ""), (6, "m", "t"), (6, "m", ""), (5, "n", "t5"), (5, "m", "bad"), (5, "m", "t5"), (5, "m", ""), (9, "m", "t"), (9, "m", None)]
    rc = frame(spark, [(i, "s", o, m, t) for i, (o, m, t) in enumerate(asks)], "pos long, stream string, offset long, member string, token string")
    run = lambda batch: [r["outcome"] for r in D.ack_outcomes(rc, cur, acked, leases, tried, F.lit(50), batch).orderBy("pos").collect()]
    assert run(False) == ["already_acknowledged", "already_acknowledged", "stale", "not_in_flight", "stale", "stale", "acknowledged", "acknowledged", "stale", "not_in_flight"]
    assert run(True) == ["already_acknowledged", "already_acknowledged", "stale", "stale", "stale", "stale", "acknowledged", "stale", "not_in_flight", "stale"]


def test_dead_letters_take_no_place(spark):
    rec = frame(spark, [("s", n, None, "x", 0) for n in range(6)] + [("s.dead-letter", 0, None, "x", 0)], REC)
    tries = frame(spark, [("s", 1, 3), ("s", 4, 3), ("s.dead-letter", 0, 9)], "stream string, offset long, attempts int")
    got = sorted((r["stream"], r["offset"], r["action"]) for r in D.dead_letters(rec, tries, 3, 3).collect())
    assert got == [("s", 0, "deliver"), ("s", 1, "dead_letter"), ("s", 2, "deliver"), ("s", 3, "deliver"), ("s.dead-letter", 0, "deliver")]


def test_lag_is_unknown_without_a_stream(spark):
    rec = frame(spark, [("s", n, None, "x", 0) for n in range(5)], REC)
    cur = frame(spark, [("s", "a", 2), ("s", "b", 9), ("t", "a", 0)], "stream string, consumer string, committed_offset long")
    assert sorted((r["stream"], r["consumer"], r["lag"]) for r in D.consumer_lag(rec, cur).collect()) == [("s", "a", 3), ("s", "b", None), ("t", "a", None)]
