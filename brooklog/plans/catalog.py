"""All queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brooklog.functions.checksum import crc32c_column
from brooklog.operators import delivery as D
from brooklog.operators import history as H
from brooklog.operators import log as L
from brooklog.operators import metrics as M
from brooklog.operators import stats as S
from brooklog.operators import verify as V
from brooklog.session import shared_dir, table
from brooklog.sources import adapters as A
from brooklog.sources import parsers as P
from brooklog.streaming import publishing

#: The clock of time-dependent queries, inside the events' month.
NOW = 1_705_000_000_000
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Pieces of SQL that the twins share; each stands for an adapter.
REQ = """req AS (SELECT event_id AS seq, event_type AS stream, CAST(user_id AS VARCHAR) AS key, props AS payload,
  epoch_us(ts) // 1000 AS published_at_ms, CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS request_id, value FROM events)"""
REC = REQ + """, rec AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS "offset" FROM req)"""
STATE = REC + f""", acked AS (SELECT stream, "offset" FROM rec WHERE seq % 7 <> 0),
 leases AS (SELECT stream, "offset", key, 'm' || (seq % 3) AS member, published_at_ms + 30000 AS deadline_ms, 'seed-' || lower(to_hex("offset")) AS delivery_token FROM rec WHERE seq % 17 = 0),
 retries AS (SELECT stream, "offset", key, published_at_ms + 60000 AS retry_not_before_ms FROM rec WHERE seq % 23 = 0 AND seq % 17 <> 0),
 attempts AS (SELECT stream, "offset", CAST(seq % 5 AS INTEGER) AS attempts FROM rec WHERE seq % 5 > 0),
 held AS (SELECT stream, "offset", key FROM leases WHERE deadline_ms > {NOW} UNION ALL SELECT stream, "offset", key FROM retries WHERE retry_not_before_ms > {NOW}),
 cand AS (SELECT r.* FROM rec r WHERE NOT EXISTS (SELECT 1 FROM acked a WHERE a.stream = r.stream AND a."offset" = r."offset")
  AND NOT EXISTS (SELECT 1 FROM held h WHERE h.stream = r.stream AND (h."offset" = r."offset" OR h.key = r.key))),
 hol AS (SELECT * FROM cand QUALIFY key IS NULL OR row_number() OVER (PARTITION BY stream, key ORDER BY "offset") = 1)"""
CONSUMER = REC + """, ev AS (SELECT 'log' AS stream, CAST(CAST(key AS BIGINT) % 10 AS VARCHAR) AS consumer, seq,
  CASE stream WHEN 'view' THEN 'delivery_attempt' WHEN 'click' THEN 'delivery_attempt' WHEN 'error' THEN 'retry_schedule' WHEN 'purchase' THEN 'acknowledge' ELSE 'policy_configured' END AS event_type,
  seq * 7 % 97 AS "offset", CAST(seq % 4 + 1 AS INTEGER) AS attempt, published_at_ms + 1000 AS retry_not_before_ms,
  seq % 3 * 10000 + 10000 AS p_timeout, CAST(seq % 4 + 2 AS INTEGER) AS p_attempts, seq % 2 * 500 AS p_delay FROM rec)"""
SAMPLES = """s AS (SELECT l_returnflag || '-' || l_linestatus AS scenario, CAST(l_suppkey % 7 AS INTEGER) AS repetition, l_extendedprice AS latency_us, l_quantity AS messages,
  l_discount AS cpu_seconds, l_tax AS elapsed_share, year(l_shipdate) AS year, l_orderkey AS order_key, l_linenumber AS line FROM lineitem)"""
HISTORY = """h AS (SELECT strftime(o_orderdate, '%Y-%m') AS run, o_orderpriority AS series, round(avg(o_totalprice), 4) AS value, count(*) AS samples FROM orders GROUP BY 1, 2)"""
SIZE = "(octet_length(encode(payload)) + coalesce(octet_length(encode(key)), 0))"


def rounded_to(df, column, digits):
    return df.withColumn(column, F.round(column, digits))


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def state(s, d):
    rec = A.stored_log(s, d)
    return rec, A.acked(rec), A.leases(rec), A.retries(rec), A.attempts(rec)


def candidates(s, d):
    rec, acked, leases, retries, _ = state(s, d)
    return D.eligible(rec, acked, leases, retries, F.lit(NOW))


# --- stream log ---------------------------------------------------------------------------------


@query("stream_catalog", f"WITH {REC} SELECT stream, count(*) AS records, max(\"offset\") + 1 AS next_offset, CAST(sum({SIZE}) AS BIGINT) AS bytes FROM rec GROUP BY stream")
def _(s, d):
    return L.stream_catalog(A.records(s, d))


@query("assign_offsets", f'WITH {REC} SELECT seq, stream, "offset" FROM rec')
def _(s, d):
    return A.records(s, d).select("seq", "stream", "offset")


@query("contiguity_audit", f'WITH {REC} SELECT stream, count(*) AS records, min("offset") AS first, max("offset") AS last, min("offset") = 0 AND max("offset") = count(*) - 1 AND count(DISTINCT "offset") = count(*) AS contiguous FROM rec GROUP BY stream')
def _(s, d):
    return L.contiguity_audit(A.records(s, d))


@query("create_streams", "SELECT source AS stream, NOT EXISTS (SELECT 1 FROM events WHERE event_type = source) AS created FROM (SELECT DISTINCT source FROM documents UNION SELECT event_type FROM events WHERE event_type < 'd')")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("stream"))
    wanted = table(s, d, "documents").select(F.col("source").alias("stream")).unionByName(e.filter("stream < 'd'"))
    return L.create_streams(wanted, e)


PUBLISH = (
    REQ
    + """, m AS (SELECT *, row_number() OVER w AS n, first_value(seq) OVER w AS first_seq, first_value(key) OVER w AS k1, first_value(payload) OVER w AS p1 FROM req WINDOW w AS (PARTITION BY stream, request_id ORDER BY seq)),
 o AS (SELECT seq, stream, first_seq, CASE WHEN n = 1 THEN 'appended' WHEN key IS NOT DISTINCT FROM k1 AND payload IS NOT DISTINCT FROM p1 THEN 'duplicate' ELSE 'conflict' END AS outcome FROM m),
 a AS (SELECT seq, row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS "offset" FROM o WHERE outcome = 'appended'),
 pub AS (SELECT o.seq, o.stream, outcome, CASE WHEN outcome <> 'conflict' THEN a."offset" END AS "offset" FROM o LEFT JOIN a ON a.seq = o.first_seq)"""
)


@query("publish_dedup", f'WITH {PUBLISH} SELECT seq, stream, outcome, "offset" FROM pub')
def _(s, d):
    return L.publish(A.requests(s, d))


@query("publish_conflicts", f"WITH {PUBLISH} SELECT stream, outcome, count(*) AS requests FROM pub GROUP BY ALL")
def _(s, d):
    return L.publish(A.requests(s, d)).groupBy("stream", "outcome").agg(F.count(F.lit(1)).alias("requests"))


@query(
    "request_id_retirement",
    "WITH " + REQ
    + """, m AS (SELECT *, seq >= 5000 AS era FROM req), o AS (SELECT seq, stream, era, request_id, key, payload, row_number() OVER w AS n, first_value(payload) OVER w AS p1, first_value(key) OVER w AS k1 FROM m WINDOW w AS (PARTITION BY stream, request_id, era ORDER BY seq))
 SELECT stream, CASE WHEN n = 1 THEN 'appended' WHEN key = k1 AND payload = p1 THEN 'duplicate' ELSE 'conflict' END AS outcome, count(*) AS requests FROM o GROUP BY ALL""",
)
def _(s, d):
    req = A.requests(s, d)
    floor = req.select("stream").distinct().withColumn("floor_seq", F.lit(5000))
    return L.publish(req, floor).groupBy("stream", "outcome").agg(F.count(F.lit(1)).alias("requests"))


@query(
    "publish_batch_outcomes",
    f"""WITH {REQ}, m AS (SELECT seq // 1024 AS batch, seq, stream, CASE WHEN octet_length(encode(key)) > 2 THEN 'key_too_large' WHEN octet_length(encode(payload)) > 8 THEN 'payload_too_large' END AS err FROM req)
 SELECT batch, seq, stream, coalesce(err, 'ok') AS outcome, CASE WHEN err IS NULL THEN count(*) FILTER (WHERE err IS NULL) OVER (PARTITION BY stream ORDER BY seq) - 1 END AS "offset" FROM m""",
)
def _(s, d):
    req = A.requests(s, d).withColumn("batch", F.floor(F.col("seq") / 1024))
    return L.publish_batch(req, "batch", L.limits_error(F.col("key"), F.col("payload"), F.col("request_id"), 2, 8))


@query("record_limits", "SELECT doc_id, CASE WHEN octet_length(encode(lang)) > 128 THEN 'key_too_large' WHEN octet_length(encode(text)) > 4096 THEN 'payload_too_large' WHEN octet_length(encode(source)) > 1024 THEN 'request_id_too_large' ELSE 'ok' END AS outcome FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.coalesce(L.limits_error(F.col("lang"), F.col("text"), F.col("source"), payload_bytes=4096), F.lit("ok")).alias("outcome"))


@query("name_validation", "SELECT name, regexp_full_match(name, '[A-Za-z0-9._-]{1,128}') AS valid FROM (SELECT n_name AS name FROM nation UNION SELECT source FROM documents UNION SELECT p_name FROM part)")
def _(s, d):
    names = table(s, d, "nation").select(F.col("n_name").alias("name")).union(table(s, d, "documents").select("source")).union(table(s, d, "part").select("p_name"))
    return names.distinct().select("name", L.valid_name(F.col("name")).alias("valid"))


@query("name_errors", """WITH n AS (SELECT n_name AS name FROM nation UNION SELECT n_name || chr(10) FROM nation UNION SELECT n_name || '.' || n_nationkey FROM nation UNION SELECT repeat(n_name, 20) FROM nation UNION SELECT substr('x', 2)),
 k AS (SELECT unnest(['stream', 'consumer', 'member']) AS kind) SELECT kind, name, CASE WHEN NOT regexp_full_match(name, '[A-Za-z0-9._-]{1,128}') THEN 'invalid ' || kind || ' name ' || chr(39) || name || chr(39) || '; use 1-128 ASCII letters, digits, ' || chr(39) || '.' || chr(39) || ', ' || chr(39) || '_' || chr(39) || ', or ' || chr(39) || '-' || chr(39) END AS error FROM n, k""")
def _(s, d):
    n = F.col("n_name")
    kinds = F.array(n, F.concat(n, F.lit("\n")), F.concat_ws(".", n, F.col("n_nationkey").cast("string")), F.repeat(n, F.lit(20)), F.lit(""))
    names = table(s, d, "nation").select(F.explode(kinds).alias("name")).distinct()
    return names.select("name", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), L.name_error(k, F.col("name")).alias("error")) for k in ("stream", "consumer", "member")])))


@query("batch_shapes", f"WITH {REQ}, r AS (SELECT seq // 700 + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS batch FROM req), b AS (SELECT unnest(range(0, (SELECT max(batch) + 3 FROM r))) AS batch), c AS (SELECT batch, count(*) AS n FROM r GROUP BY 1) SELECT batch, coalesce(n, 0) AS records, CASE WHEN n IS NULL THEN 'empty' WHEN n > 600 THEN 'too_many' ELSE 'ok' END AS status FROM b LEFT JOIN c USING (batch)")
def _(s, d):
    r = A.requests(s, d).select((F.floor(F.col("seq") / 700) + F.when(F.col("seq") % 3 == 0, 1).otherwise(0)).alias("batch"))
    declared = r.agg(F.max("batch").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") + 2)).alias("batch"))
    return L.batch_shape(declared, r, "batch", 600)


@query("publish_two_namespaces", "WITH " + REQ + """, k AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'public' ELSE 'dead_letter_move' END AS kind FROM req),
 m AS (SELECT *, row_number() OVER w AS n, first_value(key) OVER w AS k1, first_value(payload) OVER w AS p1 FROM k WINDOW w AS (PARTITION BY stream, kind, request_id ORDER BY seq))
 SELECT stream, kind, CASE WHEN n = 1 THEN 'appended' WHEN key IS NOT DISTINCT FROM k1 AND payload IS NOT DISTINCT FROM p1 THEN 'duplicate' WHEN kind = 'public' THEN 'conflict' ELSE 'corrupt' END AS outcome, count(*) AS requests FROM m GROUP BY ALL""")
def _(s, d):
    req = A.requests(s, d).withColumn("identity_kind", F.when(F.col("seq") % 2 == 0, "public").otherwise("dead_letter_move"))
    out = L.publish(req).withColumn("kind", F.when(F.col("seq") % 2 == 0, "public").otherwise("dead_letter_move"))
    return out.groupBy("stream", "kind", "outcome").agg(F.count(F.lit(1)).alias("requests"))


@query("stream_lifecycle", """WITH c AS (SELECT event_type || '-' || user_id AS stream, event_id AS seq, CASE WHEN value > 60 THEN 'active' ELSE 'creating' END AS status FROM events),
 g AS (SELECT stream, min(seq) AS f, min(seq) FILTER (WHERE status = 'active') AS a FROM c GROUP BY 1) SELECT stream, CASE WHEN a IS NULL THEN 'creating' ELSE 'active' END AS status, coalesce(a, f) AS since FROM g""")
def _(s, d):
    e = table(s, d, "events")
    name = F.concat_ws("-", "event_type", F.col("user_id").cast("string"))
    return L.stream_status(e.select(name.alias("stream"), F.col("event_id").alias("seq"), F.when(F.col("value") > 60, "active").otherwise("creating").alias("status")))


@query("name_lengths_by_kind", "SELECT lang AS kind, count(*) AS names, count(*) FILTER (WHERE length(source) BETWEEN 1 AND 128) AS bounded FROM documents GROUP BY lang")
def _(s, d):
    return table(s, d, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count(F.lit(1)).alias("names"), F.count_if(F.length("source").between(1, 128)).alias("bounded"))


ASKED = """asked AS (SELECT stream, n * 700 AS requested FROM (SELECT DISTINCT stream FROM rec), (SELECT unnest(range(0, 5)) AS n)),
 b AS (SELECT stream, min("offset") AS earliest, max("offset") + 1 AS next_offset FROM rec GROUP BY stream)"""


def _asked(rec):
    return rec.select("stream").distinct().select("stream", F.explode(F.array(*[F.lit(n * 700).cast("long") for n in range(5)])).alias("requested"))


@query("replay_point", f'WITH {REC}, {ASKED} SELECT a.stream, requested, CASE WHEN r."offset" IS NULL THEN \'history_unavailable\' ELSE \'ok\' END AS status, r.payload, earliest, next_offset FROM asked a JOIN b USING (stream) LEFT JOIN rec r ON r.stream = a.stream AND r."offset" = requested')
def _(s, d):
    rec = A.stored_log(s, d)
    return L.replay(rec, _asked(rec))


@query("replay_unavailable", f"WITH {REC}, {ASKED} SELECT a.stream, count(*) AS asked, count(*) FILTER (WHERE requested >= next_offset) AS unavailable FROM asked a JOIN b USING (stream) GROUP BY a.stream")
def _(s, d):
    rec = A.stored_log(s, d)
    return L.replay(rec, _asked(rec)).groupBy("stream").agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("status") != "ok").alias("unavailable"))


@query("replay_page", f"""WITH {REC}, p AS (SELECT stream, "offset", CAST(sum({SIZE}) OVER (PARTITION BY stream ORDER BY "offset") AS BIGINT) AS running_bytes FROM rec WHERE "offset" >= 100 AND "offset" < 200) SELECT * FROM p WHERE running_bytes <= 900 OR "offset" = 100""")
def _(s, d):
    return L.replay_page(A.stored_log(s, d), 100, 100, 900)


@query("replay_continuation", f"""WITH {REC}, p AS (SELECT stream, "offset", CAST(sum({SIZE}) OVER (PARTITION BY stream ORDER BY "offset") AS BIGINT) AS used FROM rec WHERE "offset" >= 100 AND "offset" < 200), e AS (SELECT stream, max("offset") + 1 AS nx FROM p WHERE used <= 900 OR "offset" = 100 GROUP BY 1),
 b AS (SELECT stream, min("offset") AS earliest, max("offset") + 1 AS next_offset FROM rec GROUP BY 1) SELECT stream, earliest, next_offset, coalesce(nx, least(100, next_offset)) AS continue_at, coalesce(nx, least(100, next_offset)) >= next_offset AS done FROM b LEFT JOIN e USING (stream)""")
def _(s, d):
    log = A.stored_log(s, d)
    return L.replay_continuation(L.replay_page(log, 100, 100, 900), log, 100)


@query("retention_by_size", f"""WITH {STATE}, c AS (SELECT r.stream, coalesce(min(r."offset") FILTER (WHERE a."offset" IS NULL), max(r."offset") + 1) + 500 AS cur FROM rec r LEFT JOIN acked a USING (stream, "offset") GROUP BY 1),
 l AS (SELECT stream, min("offset") AS lease FROM leases WHERE deadline_ms > {NOW} GROUP BY 1), t AS (SELECT stream, "offset", sum({SIZE}) OVER (PARTITION BY stream ORDER BY "offset" DESC) AS suffix FROM rec), f AS (SELECT stream, min("offset") FILTER (WHERE suffix <= 2000) AS fits, max("offset") + 1 AS nxt FROM t GROUP BY 1)
 SELECT stream, greatest(least(coalesce(fits, nxt), cur, coalesce(lease, nxt)), 7) AS floor FROM f JOIN c USING (stream) LEFT JOIN l USING (stream)""")
def _(s, d):
    rec, acked, leases, *_ = state(s, d)
    cursors = D.consumer_cursor(rec, acked).withColumn("committed_offset", F.col("committed_offset") + 500)
    before = rec.select("stream").distinct().withColumn("floor", F.lit(7).cast("long"))
    return L.retention_floor_by_size(rec, cursors, leases.filter(F.col("deadline_ms") > NOW), 2000, before)


@query("time_selector", f"""WITH {REC}, asked AS (SELECT stream, {NOW} + n * 600000000 AS since_ms FROM (SELECT DISTINCT stream FROM rec), (SELECT unnest(range(-1, 4)) AS n))
 SELECT a.stream, since_ms, min(r."offset") AS "offset", CASE WHEN min(r."offset") IS NULL THEN 'no_match' ELSE 'found' END AS status FROM asked a LEFT JOIN rec r ON r.stream = a.stream AND published_at_ms - seq % 13 * 3600000 >= since_ms GROUP BY ALL""")
def _(s, d):
    rec = A.records(s, d).withColumn("published_at_ms", F.col("published_at_ms") - F.col("seq") % 13 * 3600000)
    asked = rec.select("stream").distinct().select("stream", F.explode(F.array(*[F.lit(NOW + n * 600_000_000) for n in range(-1, 4)])).alias("since_ms"))
    return L.time_selector(rec, asked)


@query("prefix_max_blocks", f"""WITH {REC}, b AS (SELECT stream, "offset" // 256 AS block, max(published_at_ms - seq % 13 * 3600000) AS max_ms FROM rec GROUP BY ALL) SELECT *, max(max_ms) OVER (PARTITION BY stream ORDER BY block) AS prefix_max_ms FROM b""")
def _(s, d):
    return L.prefix_max_blocks(A.records(s, d).withColumn("published_at_ms", F.col("published_at_ms") - F.col("seq") % 13 * 3600000))


@query("retention_floor", f"""WITH {STATE}, c AS (SELECT r.stream, min(CASE WHEN a."offset" IS NULL THEN r."offset" END) AS cur FROM rec r LEFT JOIN acked a USING (stream, "offset") GROUP BY r.stream),
 y AS (SELECT stream, coalesce(min("offset") FILTER (WHERE published_at_ms >= {NOW}), max("offset") + 1) AS young, max("offset") + 1 AS nxt FROM rec GROUP BY stream)
 SELECT stream, least(young, coalesce(cur, nxt) + 500) AS floor FROM y JOIN c USING (stream)""")
def _(s, d):
    rec, acked, *_ = state(s, d)
    cursors = D.consumer_cursor(rec, acked).withColumn("committed_offset", F.col("committed_offset") + 500)
    return L.retention_floor(rec, cursors, F.lit(NOW))


@query("migration_differences", f"""WITH {REC}, t AS (SELECT stream, "offset" + CASE WHEN seq % 997 = 0 THEN 1000000 ELSE 0 END AS o2, key, CASE WHEN seq % 501 = 0 THEN 'x' ELSE payload END AS p2 FROM rec)
 SELECT coalesce(r.stream, t.stream) AS stream, coalesce(r."offset", t.o2) AS "offset", CASE WHEN t.stream IS NULL THEN 'missing' WHEN r.stream IS NULL THEN 'extra' ELSE 'changed' END AS problem
 FROM rec r FULL JOIN t ON r.stream = t.stream AND r."offset" = t.o2 WHERE t.stream IS NULL OR r.stream IS NULL OR p2 <> r.payload""")
def _(s, d):
    rec = A.records(s, d)
    moved = rec.withColumn("offset", F.col("offset") + F.when(F.col("seq") % 997 == 0, 1_000_000).otherwise(0)).withColumn("payload", F.when(F.col("seq") % 501 == 0, "x").otherwise(F.col("payload")))
    return L.migration_differences(rec, moved)


@query("migration_inventory", f"""WITH {REC} SELECT stream, count(*) AS records, min("offset") AS first, max("offset") AS last, CAST(sum(CAST('0x' || substr(md5(CAST("offset" AS VARCHAR) || '|' || coalesce(key, '') || '|' || coalesce(payload, '')), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM rec GROUP BY stream""")
def _(s, d):
    return L.inventory(A.records(s, d))


@query("dead_letter_names", """WITH RECURSIVE n AS (SELECT DISTINCT n_name || repeat('x', n_nationkey * 6) AS stream FROM nation),
 f(stream, i, h) AS (SELECT stream, 0, 14695981039346656037::HUGEINT FROM n UNION ALL SELECT stream, i + 1, (xor(h, ascii(substr(stream, i + 1, 1))::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT FROM f WHERE i < length(stream))
 SELECT stream, CASE WHEN length(stream) + 12 <= 128 THEN stream || '.dead-letter' ELSE 'log.dead-letter.' || lpad(lower(to_hex(h::UBIGINT)), 16, '0') END AS target FROM f WHERE i = length(stream)""")
def _(s, d):
    n = table(s, d, "nation").select(F.concat(F.col("n_name"), F.repeat(F.lit("x"), F.col("n_nationkey") * 6)).alias("stream")).distinct()
    return n.select("stream", L.dead_letter_name(F.col("stream"), "log").alias("target"))


MOVES = STATE + """, mv AS (SELECT seq, 'move/v1/' || length(stream) || ':' || stream || '/' || length(key) || ':' || key || '/' || ("offset" // 2) AS move_id, key, payload FROM rec),
 old AS (SELECT move_id, min(payload) AS p0 FROM mv WHERE seq % 7 = 4 GROUP BY 1), w AS (SELECT mv.*, row_number() OVER x AS n, first_value(payload) OVER x AS p1 FROM mv WINDOW x AS (PARTITION BY move_id ORDER BY seq)),
 o AS (SELECT seq, w.move_id, CASE WHEN p0 IS NULL AND n = 1 THEN 'appended' WHEN payload = coalesce(p0, p1) THEN 'duplicate' ELSE 'corrupt' END AS outcome FROM w LEFT JOIN old USING (move_id))"""


def _moves(s, d):
    rec = A.records(s, d)
    moves = rec.select("seq", L.move_id(F.col("stream"), F.col("key"), F.floor(F.col("offset") / 2), "move").alias("move_id"), "key", "payload")
    return moves, moves.filter(F.col("seq") % 7 == 4)


@query("dead_letter_moves", f"WITH {MOVES} SELECT seq, move_id, outcome FROM o")
def _(s, d):
    return L.append_moves(*_moves(s, d))


@query("dead_letter_dedup", f"WITH {MOVES} SELECT move_id FROM o WHERE outcome = 'appended'")
def _(s, d):
    return L.new_moves(*_moves(s, d)).select("move_id")


# --- delivery -----------------------------------------------------------------------------------


@query("consumer_cursor", f'WITH {STATE} SELECT r.stream, coalesce(min(r."offset") FILTER (WHERE a."offset" IS NULL), max(r."offset") + 1) AS committed_offset FROM rec r LEFT JOIN acked a USING (stream, "offset") GROUP BY r.stream')
def _(s, d):
    rec, acked, *_ = state(s, d)
    return D.consumer_cursor(rec, acked)


@query("eligible_candidates", f'WITH {STATE} SELECT stream, "offset", key FROM cand')
def _(s, d):
    return candidates(s, d).select("stream", "offset", "key")


@query("next_per_stream", f'WITH {STATE} SELECT stream, min("offset") AS "offset" FROM cand GROUP BY stream')
def _(s, d):
    return D.next_per_stream(candidates(s, d))


@query("batch_head_of_line", f'WITH {STATE} SELECT stream, "offset", key FROM hol')
def _(s, d):
    return D.head_of_line(candidates(s, d)).select("stream", "offset", "key")


VARINT = "greatest(1, CAST(ceil(length(bin({0})) / 7.0) AS INTEGER))"
_F = "(1 + " + VARINT + " + {0})"
_P, _K, _S = "octet_length(encode(payload))", "octet_length(encode(key))", "octet_length(encode(stream))"
_T = "octet_length(encode('seed-' || lower(to_hex(\"offset\"))))"
#: Bytes of a message to 'consumer', of the item around it, and of an empty reply, over columns of a record and its attempt.
SIZED = f"""SELECT *, 1 + {VARINT.format("item0")} + item0 AS item, {_F.format("empty0")} AS empty FROM (SELECT *, 4 + {_F.format("msg")} AS item0, {_F.format("names")} AS empty0 FROM (SELECT *, {_F.format(_S)} + 10 AS names,
  {_F.format(_S)} + 10 + 1 + {VARINT.format(chr(34) + "offset" + chr(34))} + 1 + {VARINT.format("published_at_ms")} + {_F.format(_P)} + CASE WHEN key IS NULL THEN 0 ELSE {_F.format(_K)} END + {_F.format(_T)} + 1 + {VARINT.format("attempt")} AS msg FROM """
ATTEMPT = """(SELECT c.*, coalesce(a.attempts, 0) + 1 AS attempt FROM {0} c LEFT JOIN attempts a USING (stream, "offset"))"""
BATCH = STATE + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY "offset") AS rk FROM {ATTEMPT.format("hol")} QUALIFY rk <= 32), sized AS ({SIZED} ranked))),
 used AS (SELECT *, CAST(empty + sum(item) OVER (PARTITION BY stream ORDER BY "offset") AS BIGINT) AS batch_bytes FROM sized)"""


def _batch_sql(most):
    return f"""WITH {BATCH} SELECT stream, "offset", key, attempt, batch_bytes, CASE WHEN batch_bytes <= {most} THEN 'seed-' || lower(to_hex("offset")) END AS delivery_token,
 CASE WHEN empty > {most} THEN 'InvalidBatchRequest' WHEN batch_bytes > {most} THEN 'ConsumeBatchRecordTooLarge' ELSE 'ok' END AS status FROM used WHERE batch_bytes <= {most} OR rk = 1"""


@query("batch_byte_budget", _batch_sql(800))
def _(s, d):
    return D.batch(candidates(s, d), 32, 800, attempts=A.attempts(A.records(s, d)))


@query("batch_too_large", _batch_sql(70))
def _(s, d):
    return D.batch(candidates(s, d), 32, 70, attempts=A.attempts(A.records(s, d)))


@query("batch_no_room", _batch_sql(20))
def _(s, d):
    return D.batch(candidates(s, d), 32, 20, attempts=A.attempts(A.records(s, d)))


@query("response_sizes", f"WITH {STATE}, z AS ({SIZED} {ATTEMPT.format('rec')}))) SELECT stream, CAST(sum(item) AS BIGINT) AS bytes, CAST(max(item) AS BIGINT) AS largest, CAST(max(empty) AS BIGINT) AS empty FROM z GROUP BY stream")
def _(s, d):
    rec = A.records(s, d)
    sized = D.next_attempt(rec, A.attempts(rec)).withColumn("_i", D.item_bytes("consumer", None, D.token_of("seed"), F.col("attempt"))).withColumn("_e", D.empty_batch_bytes("consumer"))
    return sized.groupBy("stream").agg(F.sum("_i").alias("bytes"), F.max("_i").alias("largest"), F.max("_e").alias("empty"))


POLL = STATE + f""", ret AS (SELECT l.stream, l."offset", l.key, l.published_at_ms, coalesce(a.attempts, 1) >= 3 AS term, coalesce(a.attempts, 0) AS tries FROM (SELECT leases.*, rec.published_at_ms FROM leases JOIN rec USING (stream, "offset") WHERE deadline_ms <= {NOW}) l LEFT JOIN attempts a USING (stream, "offset")),
 live AS (SELECT * FROM leases WHERE deadline_ms > {NOW}), busy AS (SELECT stream, "offset", key FROM live UNION ALL SELECT stream, "offset", key FROM retries WHERE retry_not_before_ms > {NOW} UNION ALL SELECT stream, "offset", key FROM ret WHERE NOT term),
 gone AS (SELECT stream, "offset" FROM acked UNION ALL SELECT stream, "offset" FROM ret WHERE term),
 free AS (SELECT * FROM rec r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.stream = r.stream AND g."offset" = r."offset") AND NOT EXISTS (SELECT 1 FROM busy b WHERE b.stream = r.stream AND (b."offset" = r."offset" OR b.key = r.key))),
 own AS (SELECT stream, min("offset") AS "offset" FROM live WHERE member = 'm1' GROUP BY 1),
 pick AS (SELECT r.*, 'existing' AS act, greatest(coalesce(a.attempts, 0), 1) AS attempt FROM rec r JOIN own USING (stream, "offset") LEFT JOIN attempts a USING (stream, "offset")
  UNION ALL SELECT f.*, 'deliver', coalesce(a.attempts, 0) + 1 FROM (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY stream ORDER BY "offset") = 1) f LEFT JOIN attempts a USING (stream, "offset") WHERE f.stream NOT IN (SELECT stream FROM own)),
 z AS (SELECT *, CAST({_F.format("(4 + " + _F.format("(msg + 4)") + ")")} AS BIGINT) AS bytes FROM ({SIZED} pick)))), r AS (SELECT stream, CASE WHEN bytes > 66 THEN 'too_large' ELSE act END AS action, "offset", attempt, bytes AS response_bytes FROM z)
 SELECT * FROM r UNION ALL SELECT stream, 'empty', NULL, NULL, NULL FROM (SELECT DISTINCT stream FROM rec) WHERE stream NOT IN (SELECT stream FROM r)
 UNION ALL SELECT stream, CASE WHEN term THEN 'dead_letter' ELSE 'retry' END, "offset", tries, NULL FROM ret WHERE stream NOT IN (SELECT stream FROM r WHERE action = 'too_large')"""


@query("poll_step", "WITH " + POLL)
def _(s, d):
    rec, acked, leases, retries, attempts = state(s, d)
    # member m1 is named in the reply; a message has four bytes more by it
    return D.poll_step(rec, acked, leases, retries, attempts, F.lit(NOW), "m1", 66, (500, 3))


@query("consume_limits", "SELECT l_orderkey % 1100 AS records, l_partkey * 1000 % 70000001 AS bytes, CASE WHEN l_orderkey % 1100 NOT BETWEEN 1 AND 1024 THEN 'max_records must be between 1 and 1024' WHEN l_partkey * 1000 % 70000001 NOT BETWEEN 1 AND 68157440 THEN 'max_bytes must be between 1 and 68157440' END AS error, count(*) AS requests FROM lineitem GROUP BY ALL")
def _(s, d):
    r = table(s, d, "lineitem").select((F.col("l_orderkey") % 1100).alias("records"), (F.col("l_partkey") * 1000 % 70_000_001).alias("bytes"))
    return r.groupBy("records", "bytes", D.consume_limits_error(F.col("records"), F.col("bytes")).alias("error")).agg(F.count(F.lit(1)).alias("requests"))


@query("lease_expiry", f'WITH {STATE} SELECT stream, "offset", member, deadline_ms FROM leases WHERE deadline_ms <= {NOW}')
def _(s, d):
    return D.expired(A.leases(A.records(s, d)), F.lit(NOW)).select("stream", "offset", "member", "deadline_ms")


@query("member_active_set", f'WITH {STATE} SELECT stream, member, count(*) AS held, min("offset") AS first FROM leases WHERE deadline_ms > {NOW} GROUP BY ALL')
def _(s, d):
    live = A.leases(A.records(s, d)).filter(F.col("deadline_ms") > NOW)
    return live.groupBy("stream", "member").agg(F.count(F.lit(1)).alias("held"), F.min("offset").alias("first"))


@query("retry_schedule", f'WITH {STATE} SELECT l.stream, l."offset", CASE WHEN coalesce(attempts, 1) < 3 THEN {NOW + 500} END AS retry_not_before_ms, coalesce(attempts, 1) >= 3 AS terminal FROM leases l LEFT JOIN attempts a USING (stream, "offset") WHERE deadline_ms <= {NOW}')
def _(s, d):
    _, _, leases, _, attempts = state(s, d)
    return D.retry_schedule(D.expired(leases, F.lit(NOW)), attempts, F.lit(NOW), 500, 3)


@query("next_wake", f"WITH {STATE} SELECT stream, min(t) AS wake_ms FROM (SELECT stream, deadline_ms AS t FROM leases UNION ALL SELECT stream, retry_not_before_ms FROM retries) WHERE t > {NOW} GROUP BY stream")
def _(s, d):
    _, _, leases, retries, _ = state(s, d)
    return D.next_wake(leases, retries, F.lit(NOW))


@query("orphan_retries", f'WITH {STATE} SELECT stream, "offset", attempts FROM attempts WHERE (stream, "offset") NOT IN (SELECT (stream, "offset") FROM acked UNION ALL SELECT (stream, "offset") FROM leases UNION ALL SELECT (stream, "offset") FROM retries)')
def _(s, d):
    _, acked, leases, retries, attempts = state(s, d)
    return D.orphans(attempts, acked, leases, retries)


@query("dead_letter_split", f"""WITH {STATE}, m AS (SELECT c.stream, c."offset", c.key, coalesce(attempts, 0) >= 3 AS term FROM cand c LEFT JOIN attempts USING (stream, "offset")),
 k AS (SELECT * FROM m WHERE NOT term QUALIFY row_number() OVER (PARTITION BY stream, key ORDER BY "offset") = 1), ch AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY stream ORDER BY "offset") <= 32),
 la AS (SELECT stream, max("offset") AS lo, count(*) AS n FROM ch GROUP BY stream)
 SELECT stream, "offset", 'deliver' AS action FROM ch UNION ALL SELECT m.stream, m."offset", 'dead_letter' FROM m LEFT JOIN la USING (stream) WHERE term AND (coalesce(n, 0) < 32 OR m."offset" < lo)""")
def _(s, d):
    rec, acked, leases, retries, attempts = state(s, d)
    return D.dead_letters(D.eligible(rec, acked, leases, retries, F.lit(NOW)), attempts, 3, 32)


@query("redeliveries", f"WITH {STATE} SELECT stream, count(*) FILTER (WHERE attempts > 1) AS redelivered, CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS redeliveries FROM attempts GROUP BY stream")
def _(s, d):
    a = A.attempts(A.records(s, d))
    return a.groupBy("stream").agg(F.count_if(F.col("attempts") > 1).alias("redelivered"), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).cast("long").alias("redeliveries"))


@query("fold_attempts", f"""WITH {CONSUMER} SELECT stream, consumer, "offset", max(attempt) AS attempts, arg_min(p_attempts, seq) AS first_max_attempts FROM ev WHERE event_type = 'delivery_attempt' GROUP BY ALL""")
def _(s, d):
    return D.fold_attempts(A.consumer_events(A.records(s, d))).select("stream", "consumer", "offset", "attempts", F.col("first_policy.max_attempts").alias("first_max_attempts"))


@query("fold_retry", f"""WITH {CONSUMER}, l AS (SELECT stream, consumer, "offset", max(seq) FILTER (WHERE event_type = 'delivery_attempt') AS last, bool_or(event_type = 'acknowledge') AS done FROM ev GROUP BY ALL)
 SELECT e.stream, e.consumer, e."offset", arg_min(retry_not_before_ms, seq) AS retry_not_before_ms FROM ev e JOIN l USING (stream, consumer, "offset") WHERE event_type = 'retry_schedule' AND seq > last AND NOT done GROUP BY ALL""".replace("FROM ev GROUP BY ALL)", "FROM ev WHERE event_type <> 'policy_configured' GROUP BY ALL)"))
def _(s, d):
    return D.fold_retries(A.consumer_events(A.records(s, d)))


@query("fold_cursor", f"""WITH {CONSUMER}, a AS (SELECT DISTINCT stream, consumer, "offset" FROM ev WHERE event_type = 'acknowledge'), r AS (SELECT *, row_number() OVER (PARTITION BY stream, consumer ORDER BY "offset") - 1 = "offset" AS ok FROM a),
 g AS (SELECT stream, consumer, coalesce(max("offset") FILTER (WHERE ok) + 1, 0) AS committed_offset, count(*) AS n FROM r GROUP BY ALL) SELECT stream, consumer, committed_offset, n - committed_offset AS parked FROM g""")
def _(s, d):
    return D.fold_cursor(A.consumer_events(A.records(s, d)))


POLICY = CONSUMER + """, p AS (SELECT *, (p_timeout, p_attempts, p_delay) IS DISTINCT FROM lag((p_timeout, p_attempts, p_delay)) OVER (PARTITION BY stream, consumer ORDER BY seq) AS changed FROM ev WHERE event_type = 'policy_configured')"""


@query("policy_versions", f"WITH {POLICY} SELECT stream, consumer, seq, CAST(sum(CAST(changed AS INTEGER)) OVER (PARTITION BY stream, consumer ORDER BY seq) AS BIGINT) AS version, changed FROM p")
def _(s, d):
    return D.policy_versions(A.consumer_events(A.records(s, d)))


@query("fold_policy", f"WITH {POLICY}, c AS (SELECT DISTINCT stream, consumer FROM ev UNION SELECT 'log', 'never configured'), l AS (SELECT stream, consumer, arg_max(p_timeout, seq) AS t, arg_max(p_attempts, seq) AS a, arg_max(p_delay, seq) AS y FROM p GROUP BY ALL) SELECT stream, consumer, t IS NOT NULL AS configured, coalesce(t, 30000) AS ack_timeout_ms, a AS max_attempts, coalesce(y, 0) AS retry_delay_ms FROM c LEFT JOIN l USING (stream, consumer)")
def _(s, d):
    ev = A.consumer_events(A.records(s, d))
    return D.current_policy(ev, ev.select("stream", "consumer").union(s.createDataFrame([("log", "never configured")], "stream string, consumer string")))


@query("inspect_consumer", f"""WITH {POLICY}, c AS (SELECT DISTINCT stream, consumer FROM ev UNION SELECT 'log', 'never configured'), l AS (SELECT stream, consumer, arg_max(p_timeout, seq) AS t, arg_max(p_attempts, seq) AS a, arg_max(p_delay, seq) AS y, count(*) FILTER (WHERE changed) AS v FROM p GROUP BY ALL)
 SELECT stream, consumer, t IS NOT NULL AS configured, coalesce(t, 30000) AS ack_timeout_ms, a AS max_attempts, coalesce(y, 0) AS retry_delay_ms, coalesce(v, 0) AS version FROM c LEFT JOIN l USING (stream, consumer)""")
def _(s, d):
    ev = A.consumer_events(A.stored_log(s, d))
    return D.inspect_consumer(ev, ev.select("stream", "consumer").union(s.createDataFrame([("log", "never configured")], "stream string, consumer string")))


@query("state_violations", f"""WITH {REC}, a AS (SELECT stream, "offset", CAST(seq % 5 AS INTEGER) AS attempts FROM rec WHERE seq % 3 = 0), p AS (SELECT stream, "offset" FROM rec WHERE seq % 3 = 0 AND seq % 4 <> 0 OR seq % 97 = 0), l AS (SELECT stream, "offset", CAST(seq % 5 + CASE WHEN seq % 33 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempt FROM rec WHERE seq % 11 = 0), r AS (SELECT stream, "offset" FROM rec WHERE seq % 13 = 0),
 j AS (SELECT stream, "offset", attempts, p."offset" IS NOT NULL AS pinned, attempt, r."offset" IS NOT NULL AS waits FROM a FULL JOIN p USING (stream, "offset") FULL JOIN l USING (stream, "offset") FULL JOIN r USING (stream, "offset")),
 v AS (SELECT stream, unnest([CASE WHEN (attempts IS NOT NULL) <> pinned THEN 'attempts and pinned policies have the same offsets' END, CASE WHEN attempts = 0 THEN 'attempts are positive' END, CASE WHEN attempt IS NOT NULL AND attempt IS DISTINCT FROM attempts THEN 'a lease has its offset''s attempt' END,
  CASE WHEN waits AND (attempts IS NULL OR attempt IS NOT NULL) THEN 'a retry belongs to an attempted offset without a lease' END, CASE WHEN (attempts IS NOT NULL OR attempt IS NOT NULL) AND "offset" < 5 THEN 'leases and attempts are at or after the cursor' END]) AS rule FROM j) SELECT stream, rule, count(*) AS offsets FROM v WHERE rule IS NOT NULL GROUP BY ALL""")
def _(s, d):
    rec, q = A.stored_log(s, d), F.col("seq")
    of = lambda when, *more: rec.filter(when).select("stream", "offset", *more)
    cursor = rec.select("stream").distinct().withColumn("committed_offset", F.lit(5).cast("long"))
    leases = of(q % 11 == 0, (q % 5 + F.when(q % 33 == 0, 1).otherwise(0)).cast("int").alias("attempt"))
    return D.state_violations(cursor, of(q % 3 == 0, (q % 5).cast("int").alias("attempts")), of((q % 3 == 0) & (q % 4 != 0) | (q % 97 == 0)), leases, of(q % 13 == 0))


@query("dead_letter_streams", """WITH RECURSIVE n AS (SELECT DISTINCT n_name || repeat('x', n_nationkey * 6) AS stream FROM nation),
 f(stream, i, h) AS (SELECT stream, 0, 14695981039346656037::HUGEINT FROM n UNION ALL SELECT stream, i + 1, (xor(h, ascii(substr(stream, i + 1, 1))::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT FROM f WHERE i < length(stream)),
 t AS (SELECT stream, CASE WHEN length(stream) + 12 <= 128 THEN stream || '.dead-letter' ELSE 'log.dead-letter.' || lpad(lower(to_hex(h::UBIGINT)), 16, '0') END AS target FROM f WHERE i = length(stream))
 SELECT stream, false AS dead_letter FROM t UNION ALL SELECT target, true FROM t UNION ALL SELECT 'log.dead-letter.' || stream, false FROM t""")
def _(s, d):
    n = table(s, d, "nation").select(F.concat(F.col("n_name"), F.repeat(F.lit("x"), F.col("n_nationkey") * 6)).alias("stream")).distinct()
    every = n.union(n.select(L.dead_letter_name(F.col("stream"), "log"))).union(n.select(F.concat(F.lit("log.dead-letter."), "stream")))
    return D.dead_letter_streams(every, "log")


@query("authorization", """SELECT role, request, role = 'operator' OR (role = 'application' AND request NOT IN ('create_stream', 'configure_consumer', 'health')) AS authorized, count(*) AS requests FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'operator' WHEN 1 THEN 'application' ELSE 'nobody' END AS role, CASE event_id % 5 WHEN 0 THEN 'create_stream' WHEN 1 THEN 'publish' WHEN 2 THEN 'health' WHEN 3 THEN 'ack_group' ELSE 'configure_consumer' END AS request FROM events) GROUP BY ALL""")
def _(s, d):
    of = lambda names, c: F.get(F.array(*[F.lit(x) for x in names]), (F.col(c) % len(names)).cast("int"))
    role, request = of(("operator", "application", "nobody"), "user_id"), of(("create_stream", "publish", "health", "ack_group", "configure_consumer"), "event_id")
    return table(s, d, "events").groupBy(role.alias("role"), request.alias("request"), D.authorized(role, request).alias("authorized")).agg(F.count(F.lit(1)).alias("requests"))


@query("reconciled_leases", f"""WITH {CONSUMER}, a AS (SELECT DISTINCT stream, consumer, "offset" FROM ev WHERE event_type = 'acknowledge'), r AS (SELECT *, row_number() OVER (PARTITION BY stream, consumer ORDER BY "offset") - 1 = "offset" AS ok FROM a), g AS (SELECT stream, consumer, coalesce(max("offset") FILTER (WHERE ok) + 1, 0) AS c FROM r GROUP BY ALL),
 l AS (SELECT DISTINCT stream, consumer, "offset" FROM ev WHERE event_type = 'delivery_attempt') SELECT l.* FROM l LEFT JOIN g USING (stream, consumer) WHERE (c IS NULL OR "offset" >= c) AND (l.stream, l.consumer, l."offset") NOT IN (SELECT (stream, consumer, "offset") FROM a)""")
def _(s, d):
    ev = A.consumer_events(A.stored_log(s, d))
    return D.reconcile(ev.filter(F.col("event_type") == "delivery_attempt").select("stream", "consumer", "offset").distinct(), ev)


@query("cache_evictions", """WITH c AS (SELECT DISTINCT event_type AS stream, CAST(user_id AS VARCHAR) AS consumer FROM events), a AS (SELECT DISTINCT event_type AS stream, CAST(user_id AS VARCHAR) AS consumer FROM events WHERE value > 90), j AS (SELECT c.*, a.consumer IS NOT NULL AS active, count(*) OVER (PARTITION BY c.stream) - 12 AS extra FROM c LEFT JOIN a USING (stream, consumer))
 SELECT stream, consumer, active FROM j QUALIFY row_number() OVER (PARTITION BY stream ORDER BY active, consumer) <= extra""")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("stream"), F.col("user_id").cast("string").alias("consumer"), "value")
    return D.cache_evictions(e, e.filter(F.col("value") > 90), 12)


@query("poll_wakes", f"""WITH {REC}, w AS (SELECT stream, key AS consumer, max(published_at_ms) + 500 AS since FROM rec WHERE seq % 3 = 0 GROUP BY ALL), c AS (SELECT stream, published_at_ms AS at_ms, min(CASE WHEN seq % 2 = 0 THEN 'publish' ELSE 'acknowledge' END) AS reason FROM rec GROUP BY ALL)
 SELECT w.stream, w.consumer, w.since, c.at_ms AS wake_ms, c.reason FROM w ASOF LEFT JOIN c ON w.stream = c.stream AND w.since < c.at_ms""")
def _(s, d):
    rec = A.stored_log(s, d)
    waiters = rec.filter(F.col("seq") % 3 == 0).groupBy("stream", F.col("key").alias("consumer")).agg((F.max("published_at_ms") + 500).alias("since"))
    return D.wakes(waiters, rec.select("stream", F.col("published_at_ms").alias("at_ms"), F.when(F.col("seq") % 2 == 0, "publish").otherwise("acknowledge").alias("reason")))


@query("append_outcomes", f"""WITH {CONSUMER}, f AS (SELECT seq, stream, consumer, CASE WHEN seq % 41 = 0 THEN 'BeforeAppend' WHEN seq % 997 = 0 THEN 'Append' WHEN seq % 1009 = 0 THEN 'Sync' END AS failed FROM ev), d AS (SELECT *, min(seq) FILTER (WHERE failed IN ('Append', 'Sync')) OVER (PARTITION BY stream, consumer) AS doubt FROM f)
 SELECT seq, stream, consumer, failed IS NULL AND NOT coalesce(seq > doubt, false) AS durable, CASE WHEN seq > doubt THEN 'NeedsReconcile' WHEN failed IS NULL THEN 'Confirmed' WHEN failed = 'BeforeAppend' THEN 'Retryable' ELSE 'Unknown' END AS outcome FROM d""")
def _(s, d):
    q = F.col("seq")
    stage = F.when(q % 41 == 0, "BeforeAppend").when(q % 997 == 0, "Append").when(q % 1009 == 0, "Sync")
    return D.append_outcomes(A.consumer_events(A.stored_log(s, d)).withColumn("failed_stage", stage))


@query("untorn_frames", """WITH f AS (SELECT event_type AS stream, event_id AS seq, NOT (event_id > 900 AND event_id % 53 = 0) AS whole FROM events), t AS (SELECT stream, min(seq) AS torn FROM f WHERE NOT whole GROUP BY 1) SELECT stream, seq, whole FROM f LEFT JOIN t USING (stream) WHERE torn IS NULL OR seq < torn""")
def _(s, d):
    seq = F.col("event_id")
    return L.untorn(table(s, d, "events").select(F.col("event_type").alias("stream"), seq.alias("seq"), (~((seq > 900) & (seq % 53 == 0))).alias("whole")))


@query("pinned_policy", f"""WITH {CONSUMER}, f AS (SELECT stream, consumer, "offset", CASE WHEN seq % 6 <> 0 THEN p_attempts END AS p FROM ev WHERE event_type = 'delivery_attempt' QUALIFY row_number() OVER (PARTITION BY stream, consumer, "offset" ORDER BY seq) = 1),
 c AS (SELECT stream, consumer, arg_max(p_attempts, seq) AS q FROM ev WHERE event_type = 'policy_configured' AND consumer < '8' GROUP BY ALL) SELECT stream, consumer, "offset", coalesce(p, q) AS max_attempts, CASE WHEN p IS NOT NULL THEN 'pinned' WHEN q IS NOT NULL THEN 'current' ELSE 'legacy' END AS source FROM f LEFT JOIN c USING (stream, consumer)""")
def _(s, d):
    # some first attempts are from before policies, and two consumers were never configured
    ev = A.consumer_events(A.records(s, d)).withColumn("policy", F.when((F.col("event_type") != "delivery_attempt") | (F.col("seq") % 6 != 0), F.col("policy")))
    return D.pinned_policy(ev.withColumn("event_type", F.when((F.col("event_type") == "policy_configured") & (F.col("consumer") >= "8"), "none").otherwise(F.col("event_type"))))


@query("policy_validation", f"WITH {CONSUMER} SELECT p_timeout > 0 AND p_timeout <= 20000 AS in_range, count(*) AS policies FROM ev GROUP BY ALL")
def _(s, d):
    ev = A.consumer_events(A.records(s, d))
    ok = D.valid_policy(F.col("policy.ack_timeout_ms"), F.col("policy.max_attempts"), F.col("policy.retry_delay_ms")) & (F.col("policy.ack_timeout_ms") <= 20000)
    return ev.groupBy(ok.alias("in_range")).agg(F.count(F.lit(1)).alias("policies"))


@query("clock_floor", f"WITH {REC}, o AS (SELECT stream, seq, published_at_ms - seq % 13 * 3600000 AS observed_ms FROM rec) SELECT *, max(observed_ms) OVER (PARTITION BY stream ORDER BY seq) AS now_ms FROM o")
def _(s, d):
    return D.clock_floor(A.records(s, d).withColumn("observed_ms", F.col("published_at_ms") - F.col("seq") % 13 * 3600000))


RECEIPTS = STATE + """, cur AS (SELECT r.stream, min(r."offset") FILTER (WHERE a."offset" IS NULL) AS committed_offset FROM rec r LEFT JOIN acked a USING (stream, "offset") GROUP BY r.stream),
 rc AS (SELECT seq AS pos, stream, "offset", 'm' || (seq % 3) AS member, CASE WHEN seq % 4 = 0 THEN '' WHEN seq % 3 = 0 THEN 'stale' ELSE 'seed-' || lower(to_hex("offset")) END AS token FROM rec),
 j AS (SELECT rc.*, (rc."offset" < committed_offset OR a."offset" IS NOT NULL) AS done, l.member AS lm, l.delivery_token AS lt, t.attempts IS NOT NULL AS tried FROM rc JOIN cur USING (stream)
  LEFT JOIN acked a ON a.stream = rc.stream AND a."offset" = rc."offset" LEFT JOIN leases l ON l.stream = rc.stream AND l."offset" = rc."offset" AND l.deadline_ms > 1704500000000 LEFT JOIN attempts t ON t.stream = rc.stream AND t."offset" = rc."offset")"""


def _receipts(s, d, batch_rules):
    rec, acked, leases, _, attempts = state(s, d)
    token = F.when(F.col("seq") % 4 == 0, "").when(F.col("seq") % 3 == 0, "stale").otherwise(F.concat(F.lit("seed-"), F.lower(F.hex("offset"))))
    rc = rec.select(F.col("seq").alias("pos"), "stream", "offset", F.concat(F.lit("m"), (F.col("seq") % 3).cast("string")).alias("member"), token.alias("token"))
    return D.ack_outcomes(rc, D.consumer_cursor(rec, acked), acked, leases, attempts, F.lit(1_704_500_000_000), batch_rules)


@query("ack_outcomes", f"""WITH {RECEIPTS} SELECT pos, stream, "offset", CASE WHEN done THEN 'already_acknowledged' WHEN lm IS NULL AND token <> '' THEN 'stale' WHEN lm IS NULL THEN 'not_in_flight' WHEN lm <> member THEN 'stale' WHEN token <> '' AND token <> lt THEN 'stale' ELSE 'acknowledged' END AS outcome FROM j""")
def _(s, d):
    return _receipts(s, d, False)


@query("ack_batch_ordered", f"""WITH {RECEIPTS} SELECT pos, stream, "offset", CASE WHEN done THEN 'already_acknowledged' WHEN token = '' THEN 'stale' WHEN lm IS NOT NULL AND lm = member AND lt = token THEN 'acknowledged' WHEN lm IS NOT NULL OR tried THEN 'stale' ELSE 'not_in_flight' END AS outcome FROM j""")
def _(s, d):
    return _receipts(s, d, True)


@query("receipt_vectors", f"""WITH {REC}, r AS (SELECT seq // 64 AS batch, stream, "offset" % 40 AS o FROM rec) SELECT batch, count(*) = count(DISTINCT (stream, o)) AND count(*) <= 1024 AS valid FROM r GROUP BY batch""")
def _(s, d):
    return D.valid_receipts(A.records(s, d).select(F.floor(F.col("seq") / 64).alias("batch"), "stream", (F.col("offset") % 40).alias("offset")))


@query("independent_consumers", f"""WITH {REC}, c AS (SELECT stream, 'c' || n AS consumer, count(*) FILTER (WHERE seq % 7 <> 0 AND seq % (n + 2) <> 0) AS acknowledged, min("offset") FILTER (WHERE NOT (seq % 7 <> 0 AND seq % (n + 2) <> 0)) AS committed_offset FROM rec, (SELECT unnest(range(0, 3)) AS n) GROUP BY ALL) SELECT * FROM c""")
def _(s, d):
    rec = A.records(s, d).select("stream", "seq", "offset", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
    done = (F.col("seq") % 7 != 0) & (F.col("seq") % (F.col("n") + 2) != 0)
    return rec.groupBy("stream", F.concat(F.lit("c"), F.col("n").cast("string")).alias("consumer")).agg(F.count_if(done).alias("acknowledged"), F.min(F.when(~done, F.col("offset"))).alias("committed_offset"))


@query("shared_members_disjoint", f"""WITH {STATE} SELECT stream, 'member-' || row_number() OVER (PARTITION BY stream ORDER BY "offset") AS member, "offset" FROM hol QUALIFY row_number() OVER (PARTITION BY stream ORDER BY "offset") <= 4""")
def _(s, d):
    return D.shared_members(candidates(s, d), 4)


@query("consumer_lag", f"""WITH {STATE}, c AS (SELECT stream, 'c' || n AS consumer, n * 900 AS committed_offset FROM (SELECT DISTINCT stream FROM rec), (SELECT unnest(range(0, 4)) AS n)), h AS (SELECT stream, max("offset") + 1 AS head FROM rec GROUP BY stream)
 SELECT stream, consumer, CASE WHEN head >= committed_offset THEN head - committed_offset END AS lag, CASE WHEN head >= committed_offset THEN 'known' ELSE 'unknown' END AS status FROM c JOIN h USING (stream)""")
def _(s, d):
    rec = A.records(s, d)
    cursors = rec.select("stream").distinct().select("stream", F.explode(F.array(*[F.lit(n) for n in range(4)])).alias("n")).select("stream", F.concat(F.lit("c"), F.col("n").cast("string")).alias("consumer"), (F.col("n") * 900).cast("long").alias("committed_offset"))
    return D.consumer_lag(rec, cursors)


_ERR = """('InvalidName', 'InvalidRequest', 'Rejected'), ('InvalidRecord', 'InvalidRequest', 'Rejected'), ('InvalidBatchRequest', 'InvalidRequest', 'Rejected'), ('ConsumeBatchRecordTooLarge', 'InvalidRequest', 'Rejected'),
 ('ResponseTooLarge', 'InvalidRequest', 'Rejected'), ('StreamNotFound', 'ResourceNotFound', 'Rejected'), ('StreamNotReady', 'ResourceNotReady', 'Retryable'), ('AckNotInFlight', 'DeliveryRejected', 'Rejected'),
 ('StaleDelivery', 'DeliveryRejected', 'Rejected'), ('OutOfOrderAck', 'DeliveryRejected', 'Rejected'), ('RequestIdContentConflict', 'RequestIdContentConflict', 'Rejected'), ('HistoryUnavailable', 'HistoryUnavailable', 'Rejected'),
 ('Configuration', 'Configuration', 'Rejected'), ('CorruptRecord', 'CorruptData', 'Unknown'), ('Io', 'Storage', 'Unknown'), ('State', 'State', 'Unknown'), ('ConsumerStatePersistence:BeforeAppend', 'State', 'Retryable'),
 ('ConsumerStatePersistence:Append', 'State', 'Unknown'), ('ConsumerStatePersistence:Sync', 'State', 'Unknown'), ('LockPoisoned', 'Internal', 'Unknown'), ('NotLeader', 'Routing', 'Retryable'), ('Cluster', 'Cluster', 'Unknown')"""


@query("error_outcome_map", f"WITH t(error_code, kind, outcome) AS (VALUES {_ERR}), f AS (SELECT CASE WHEN event_type = 'error' THEN 'Io' WHEN event_type = 'click' THEN 'NotLeader' WHEN event_type = 'view' THEN 'ConsumerStatePersistence:BeforeAppend' ELSE 'StaleDelivery' END AS error_code FROM events) SELECT t.error_code, kind, outcome, count(f.error_code) AS failures FROM t LEFT JOIN f USING (error_code) GROUP BY ALL")
def _(s, d):
    code = F.when(F.col("event_type") == "error", "Io").when(F.col("event_type") == "click", "NotLeader").when(F.col("event_type") == "view", "ConsumerStatePersistence:BeforeAppend").otherwise("StaleDelivery")
    return D.error_outcomes(s, table(s, d, "events").select(code.alias("error_code")))


@query("attempt_outcomes", """WITH t(failure, outcome) AS (VALUES ('ConnectTimeout', 'Retryable'), ('Connect', 'Retryable'), ('ConnectionUnavailable', 'Retryable'), ('RequestEncoding', 'Rejected'), ('InvalidBatch', 'Rejected'), ('InvalidResponseLimit', 'Rejected'),
 ('InvalidSecurityConfiguration', 'Rejected'), ('CredentialFile', 'Rejected'), ('InvalidTrustRoots', 'Rejected'), ('InvalidServerName', 'Rejected'), ('HandshakeRefused', 'Rejected'), ('InvalidHello', 'Rejected'), ('AuthenticationRequired', 'Rejected'),
 ('AuthenticationFailed', 'Rejected'), ('SecurityMismatch', 'Rejected'), ('RequestTooLarge', 'Rejected'), ('ReadTimeout', 'Unknown')), n AS (SELECT *, row_number() OVER (ORDER BY failure) - 1 AS i FROM t),
 a AS (SELECT event_id % 18 AS i, user_id % 4 = 0 AS replied, CASE WHEN event_id % 5 = 0 THEN 'Confirmed' WHEN event_id % 5 < 3 THEN 'Rejected' END AS said FROM events)
 SELECT failure, replied, CASE WHEN replied THEN coalesce(said, 'Unknown') ELSE coalesce(n.outcome, 'Unknown') END AS outcome, count(*) AS attempts FROM a LEFT JOIN n USING (i) GROUP BY ALL""")
def _(s, d):
    names = sorted([*sum(D.ATTEMPTS.values(), []), "ReadTimeout"])
    failure = F.get(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 18).cast("int"))
    a = table(s, d, "events").select(failure.alias("failure"), (F.col("user_id") % 4 == 0).alias("replied"), F.when(F.col("event_id") % 5 == 0, "Confirmed").when(F.col("event_id") % 5 < 3, "Rejected").alias("said"))
    return a.groupBy("failure", "replied", D.attempt_outcome(F.col("failure"), F.col("replied"), F.col("said")).alias("outcome")).agg(F.count(F.lit(1)).alias("attempts"))


# --- metrics ------------------------------------------------------------------------------------

_BOUNDS = ", ".join(f"('{b:g}', {b!r})" for b in M.BOUNDS)


@query("latency_histogram", f"WITH b(le, x) AS (VALUES {_BOUNDS}, ('+Inf', 1e300)) SELECT event_type, le, count(*) FILTER (WHERE value / 100 <= x) AS count FROM events, b GROUP BY ALL")
def _(s, d):
    return M.latency_histogram(table(s, d, "events"), F.col("value") / 100, "event_type")


_LABELS = "('create_stream'), ('publish'), ('poll'), ('poll_batch'), ('replay'), ('poll_group'), ('configure_consumer'), ('inspect_consumer'), ('ack'), ('ack_batch'), ('ack_group'), ('health'), ('invalid_request')"


@query("latency_totals", "SELECT event_type, count(value) AS count, round(sum(value / 100), 4) AS sum_seconds FROM events GROUP BY 1")
def _(s, d):
    return rounded_to(M.latency_totals(table(s, d, "events"), F.col("value") / 100, "event_type"), "sum_seconds", 4)


@query("op_counters", f"WITH l(operation) AS (VALUES {_LABELS}), r AS (SELECT CASE event_type WHEN 'click' THEN 'publish' WHEN 'view' THEN 'poll_batch' WHEN 'purchase' THEN 'ack_group' WHEN 'signup' THEN 'ack_batch' ELSE 'invalid_request' END AS operation, value > 50 AS failed FROM events) SELECT l.operation, count(r.operation) AS requests, count(*) FILTER (WHERE failed) AS failures FROM l LEFT JOIN r USING (operation) GROUP BY ALL")
def _(s, d):
    t = F.col("event_type")
    name = F.when(t == "click", "publish_batch").when(t == "view", "poll_group_batch").when(t == "purchase", "ack_group").when(t == "signup", "ack_group_batch").otherwise(t)
    return M.operation_counters(s, table(s, d, "events").select(name.alias("request"), (F.col("value") > 50).alias("failed")))


@query("traffic_sums", f"WITH {RECEIPTS}, o AS (SELECT stream, done, lm, lt, member, token FROM j), p AS (SELECT stream, CAST(sum({SIZE}) AS BIGINT) AS published_bytes, count(*) FILTER (WHERE seq % 5 > 0) AS deliveries, CAST(coalesce(sum({SIZE}) FILTER (WHERE seq % 5 > 0), 0) AS BIGINT) AS delivered_bytes FROM rec GROUP BY stream) SELECT p.*, (SELECT count(*) FROM o WHERE o.stream = p.stream AND NOT done AND token <> '' AND lm = member AND lt = token) AS acknowledged FROM p")
def _(s, d):
    rec = A.records(s, d)
    return M.traffic(rec, rec.filter(F.col("seq") % 5 > 0), _receipts(s, d, True))


@query("health_aggregate", f"WITH {STATE} SELECT (SELECT count(DISTINCT stream) FROM rec) AS streams, (SELECT CAST(sum({SIZE}) AS BIGINT) FROM rec) AS bytes, (SELECT count(*) FROM leases) AS in_flight, (SELECT CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) FROM attempts) AS redeliveries, (SELECT count(*) FROM attempts WHERE attempts >= 4) AS dead_letters")
def _(s, d):
    rec, _, leases, _, attempts = state(s, d)
    return M.health(rec, leases, attempts, 4)


@query("replication_lag_max", "SELECT l_linenumber AS peer, CAST(max(greatest(CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_orderkey + 1 END - (l_partkey + 1), 0)) AS BIGINT) AS lag FROM lineitem GROUP BY 1")
def _(s, d):
    li = table(s, d, "lineitem")
    return M.replication_lag(li.select(F.col("l_linenumber").alias("peer"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_orderkey")).alias("last"), F.col("l_partkey").alias("matched")))


@query("lag_sample_page", "SELECT group_id FROM (SELECT DISTINCT l_suppkey AS group_id FROM lineitem) ORDER BY group_id <= 90, group_id LIMIT 32")
def _(s, d):
    return M.sample_page(table(s, d, "lineitem").select(F.col("l_suppkey").alias("group_id")), 90, 32)


@query("write_counters", "SELECT o_orderpriority AS role, o_orderstatus AS operation, count(*) AS attempts, count(*) FILTER (WHERE o_custkey % 9 = 0) AS failures, CAST(sum(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS bytes_offered, CAST(coalesce(sum(CAST(o_totalprice AS BIGINT)) FILTER (WHERE o_custkey % 9 <> 0), 0) AS BIGINT) AS bytes_completed FROM (SELECT o_orderpriority, o_orderstatus, o_custkey, floor(o_totalprice) AS o_totalprice FROM orders) GROUP BY 1, 2")
def _(s, d):
    o = table(s, d, "orders")
    return M.write_counters(o.select(F.col("o_orderpriority").alias("role"), F.col("o_orderstatus").alias("operation"), (F.col("o_custkey") % 9 == 0).alias("failed"), F.floor("o_totalprice").alias("bytes")))


@query("write_matrix", """WITH r(role) AS (VALUES ('raft_log_rewrite'), ('state_machine_journal_append'), ('state_machine_journal_compaction'), ('state_machine_checkpoint'), ('state_machine_snapshot'), ('raft_log_segment_append'), ('raft_log_control_state')),
 o(operation) AS (VALUES ('serialize'), ('snapshot_state_serialize'), ('write_all'), ('sync_data'), ('sync_all'), ('rename'), ('directory_sync')), w AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'raft_log_rewrite' WHEN 1 THEN 'state_machine_snapshot' ELSE 'other' END AS role, CASE o_orderkey % 2 WHEN 0 THEN 'write_all' ELSE 'sync_all' END AS operation, o_custkey % 9 = 0 AS failed, o_orderkey AS b, o_custkey AS ns FROM orders)
 SELECT r.role, o.operation, count(w.b) AS attempts, count(*) FILTER (WHERE failed) AS failures, CAST(coalesce(sum(b), 0) AS BIGINT) AS bytes_offered, CAST(coalesce(sum(b) FILTER (WHERE NOT failed), 0) AS BIGINT) AS bytes_completed, CAST(coalesce(sum(ns), 0) AS BIGINT) AS elapsed_ns FROM r CROSS JOIN o LEFT JOIN w ON w.role = r.role AND w.operation = o.operation GROUP BY ALL""")
def _(s, d):
    o = table(s, d, "orders")
    role = F.get(F.array(*[F.lit(x) for x in ("raft_log_rewrite", "state_machine_snapshot", "other")]), (F.col("o_custkey") % 3).cast("int"))
    step = F.when(F.col("o_orderkey") % 2 == 0, "write_all").otherwise("sync_all")
    return M.write_matrix(s, o.select(role.alias("role"), step.alias("operation"), (F.col("o_custkey") % 9 == 0).alias("failed"), F.col("o_orderkey").alias("bytes"), F.col("o_custkey").alias("elapsed_ns")))


@query("snapshot_builds", "SELECT o_orderpriority AS node, count(*) AS started, count(*) FILTER (WHERE o_custkey % 10 > 1) AS completed, count(*) FILTER (WHERE o_custkey % 10 = 1) AS failed, count(*) FILTER (WHERE o_custkey % 10 = 0) AS in_progress, CAST(sum(o_orderkey) FILTER (WHERE o_custkey % 10 > 1) AS BIGINT) AS total_ms, max(o_orderkey) FILTER (WHERE o_custkey % 10 > 1) AS longest_ms FROM orders GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders")
    status = F.when(F.col("o_custkey") % 10 == 0, "running").when(F.col("o_custkey") % 10 == 1, "failed").otherwise("completed")
    return M.build_metrics(o.select(F.col("o_orderpriority").alias("node"), status.alias("status"), F.col("o_orderkey").alias("ms")))


@query("metric_delta", "WITH a AS (SELECT o_orderpriority || ':' || o_orderstatus AS name, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1), b AS (SELECT o_orderpriority || ':' || o_orderstatus AS name, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) SELECT name, a.value - b.value AS delta FROM a JOIN b USING (name)")
def _(s, d):
    o = table(s, d, "orders")
    snap = lambda y: o.filter(F.year("o_orderdate") == y).groupBy(F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return M.metric_delta(snap(1996), snap(1997))


@query("restart_deltas", """WITH s AS (SELECT CASE year(o_orderdate) WHEN 1995 THEN 'initial' WHEN 1996 THEN 'before_restart' ELSE 'after_restart' END AS phase, o_orderpriority AS name, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997 AND NOT (year(o_orderdate) = 1995 AND o_orderpriority = '5-LOW') GROUP BY ALL),
 p(phase, a, b) AS (VALUES ('same_process', 'initial', 'before_restart'), ('restart', 'before_restart', 'after_restart')) SELECT p.phase, x.name, y.value - x.value AS delta FROM p JOIN s x ON x.phase = a JOIN s y ON y.phase = b AND y.name = x.name""")
def _(s, d):
    year = F.year("o_orderdate")
    o = table(s, d, "orders").filter(year.between(1995, 1997) & ~((year == 1995) & (F.col("o_orderpriority") == "5-LOW")))
    phase = F.when(year == 1995, "initial").when(year == 1996, "before_restart").otherwise("after_restart")
    return M.restart_deltas(o.groupBy(phase.alias("phase"), F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")))


@query("counter_delta_guarded", "WITH g AS (SELECT o_orderpriority AS series, year(o_orderdate) AS y, count(*) AS count, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS sum FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ALL), j AS (SELECT a.series, a.count AS c1, a.sum AS s1, b.count AS c0, b.sum AS s0, a.count >= b.count AND a.sum >= b.sum AS ok FROM g a JOIN g b ON a.series = b.series AND a.y = 1997 AND b.y = 1996) SELECT series, CASE WHEN ok THEN c1 - c0 END AS count_delta, CASE WHEN ok THEN s1 - s0 END AS sum_delta, CASE WHEN ok THEN (s1 - s0) / nullif(c1 - c0, 0) END AS mean, ok AS available FROM j")
def _(s, d):
    o = table(s, d, "orders")
    snap = lambda y: o.filter(F.year("o_orderdate") == y).groupBy(F.col("o_orderpriority").alias("series")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.floor("o_totalprice")).alias("sum"))
    return M.guarded_delta(snap(1996), snap(1997), "series")


# --- statistics ---------------------------------------------------------------------------------


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("percentiles_by_scenario", f"WITH {SAMPLES} SELECT scenario, count(*) AS samples, round(quantile_cont(latency_us, 0.5), 6) AS p50, round(quantile_cont(latency_us, 0.95), 6) AS p95, round(quantile_cont(latency_us, 0.99), 6) AS p99, round(quantile_cont(latency_us, 0.999), 6) AS p999 FROM s GROUP BY scenario")
def _(s, d):
    return rounded(S.percentiles_by_rank(A.scenario_samples(s, d), "scenario", "latency_us", {"p50": 50, "p95": 95, "p99": 99, "p999": 99.9}), "p50", "p95", "p99", "p999")


@query("scenario_metric", f"WITH {SAMPLES}, g AS (SELECT scenario, count(*) AS n, sum(messages) / 1000 AS e, quantile_cont(latency_us, 0.5) AS a, quantile_cont(latency_us, 0.99) AS b, quantile_cont(latency_us, 0.999) AS c, max(latency_us) AS m FROM s GROUP BY scenario) SELECT scenario, n AS messages, round(e * 1000, 4) AS elapsed_ms, round(n / e, 6) AS messages_per_second, round(n * 100 / e / 1e6, 6) AS megabytes_per_second, round(a, 6) AS p50_us, round(b, 6) AS p99_us, round(c, 6) AS p999_us, m AS max_us FROM g")
def _(s, d):
    out = S.scenario_metric(A.scenario_samples(s, d), ["scenario"], "latency_us", F.sum("messages") / 1000, 100)
    return rounded(rounded(out, "messages_per_second", "megabytes_per_second", "p50_us", "p99_us", "p999_us"), "elapsed_ms", digits=4)


@query("batch_metric", "WITH b AS (SELECT l_orderkey, l_returnflag, max(l_extendedprice) AS latency, count(*) AS size FROM lineitem GROUP BY ALL) SELECT l_returnflag AS scenario, count(*) AS batches, CAST(sum(size) AS BIGINT) AS records, round(sum(size) / (sum(latency) / 1e6), 6) AS records_per_second, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.99), 6) AS p99 FROM b GROUP BY 1")
def _(s, d):
    b = table(s, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("scenario")).agg(F.max("l_extendedprice").alias("latency"), F.count(F.lit(1)).alias("size"))
    return rounded(S.batch_metric(b, ["scenario"], "latency", "size", F.sum("latency") / 1e6), "records_per_second", "p50", "p99")


@query("summarize_stats", f"WITH {SAMPLES}, n AS (SELECT scenario, cpu_seconds, CASE WHEN scenario <> 'R-F' OR order_key % 2 = 0 THEN elapsed_share END AS memory FROM s) SELECT scenario, count(*) AS samples, CASE WHEN count(cpu_seconds) = count(*) THEN round(avg(cpu_seconds), 6) END AS cpu_seconds_avg, CASE WHEN count(cpu_seconds) = count(*) THEN max(cpu_seconds) END AS cpu_seconds_max, CASE WHEN count(memory) = count(*) THEN round(avg(memory), 6) END AS memory_avg, CASE WHEN count(memory) = count(*) THEN max(memory) END AS memory_max FROM n GROUP BY scenario")
def _(s, d):
    n = A.scenario_samples(s, d).withColumn("memory", F.when((F.col("scenario") != "R-F") | (F.col("order_key") % 2 == 0), F.col("elapsed_share")))
    return rounded(S.summarize_stats(n, ["scenario"], ["cpu_seconds", "memory"]), "cpu_seconds_avg", "memory_avg")


@query("per_node_resources", "SELECT user_id AS node, greatest(arg_max(value, event_id) - arg_min(value, event_id), 0.0) AS cpu_seconds, round(avg(value), 6) AS memory_avg, max(value) AS memory_max FROM events GROUP BY 1")
def _(s, d):
    return rounded(S.per_node(table(s, d, "events").withColumnRenamed("user_id", "node"), "node", "event_id", "value", "value"), "memory_avg")


@query("conditional_max", "SELECT event_type, count(*) FILTER (WHERE user_id % 3 = 0) AS matching, max(value) FILTER (WHERE user_id % 3 = 0) AS value_max FROM events GROUP BY 1")
def _(s, d):
    return S.conditional_max(table(s, d, "events"), "event_type", "value", F.col("user_id") % 3 == 0)


REPS = SAMPLES + ", r AS (SELECT scenario, repetition, sum(messages) AS throughput, quantile_cont(latency_us, 0.99) AS p99 FROM s GROUP BY ALL)"


def _repetitions(s, d):
    return A.scenario_samples(s, d).groupBy("scenario", "repetition").agg(F.sum("messages").alias("throughput"), S.pct("latency_us", 99).alias("p99"))


@query("repetition_summary", f"WITH {REPS} SELECT scenario, count(*) AS count, min(throughput) AS minimum, round(quantile_cont(throughput, 0.5), 6) AS median, max(throughput) AS maximum, round(stddev_pop(throughput), 4) AS stdev, round((max(throughput) - min(throughput)) / abs(quantile_cont(throughput, 0.5)) * 100, 4) AS relative_range_percent, round(stddev_pop(throughput) / abs(quantile_cont(throughput, 0.5)) * 100, 4) AS relative_stdev_percent, list(throughput ORDER BY repetition) AS samples FROM r GROUP BY scenario")
def _(s, d):
    return rounded(rounded(S.repetition_summary(_repetitions(s, d), ["scenario"], "throughput", "repetition"), "median"), "stdev", "relative_range_percent", "relative_stdev_percent", digits=4)


@query("scenario_summary", f"""WITH {SAMPLES}, r AS (SELECT scenario, repetition, sum(messages) AS messages, CAST(count(*) AS DOUBLE) AS samples, round(sum(elapsed_share), 6) AS elapsed, round(sum(cpu_seconds), 6) AS cpu_seconds, max(messages) AS cpu_percent_max, quantile_cont(latency_us, 0.5) AS latency_p50, quantile_cont(latency_us, 0.95) AS latency_p95,
  quantile_cont(latency_us, 0.99) AS latency_p99, quantile_cont(latency_us, 0.999) AS latency_p999, CASE WHEN repetition <> 2 AND sum(messages) > 0 AND sum(cpu_seconds) > 0 THEN sum(messages) / sum(cpu_seconds) END AS cpu_efficiency FROM s GROUP BY scenario, repetition),
 u AS (UNPIVOT r ON messages, samples, elapsed, cpu_seconds, cpu_percent_max, latency_p50, latency_p95, latency_p99, latency_p999, cpu_efficiency INTO NAME metric VALUE v)
 SELECT scenario, metric, count(*) AS count, round(min(v), 6) AS minimum, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS maximum, round(stddev_pop(v), 2) AS stdev, round((max(v) - min(v)) / abs(quantile_cont(v, 0.5)) * 100, 2) AS relative_range_percent FROM u GROUP BY ALL""")
def _(s, d):
    m, c = F.sum("messages"), F.sum("cpu_seconds")
    r = A.scenario_samples(s, d).groupBy("scenario", "repetition").agg(
        m.alias("messages"), F.count(F.lit(1)).cast("double").alias("samples"), F.round(F.sum("elapsed_share"), 6).alias("elapsed"), F.round(c, 6).alias("cpu_seconds"), F.max("messages").alias("cpu_percent_max"),
        *[S.pct("latency_us", p).alias(f"latency_p{str(p).replace('.', '')}") for p in (50, 95, 99, 99.9)], F.when((m > 0) & (c > 0), m / c).alias("cpu_efficiency"),
    )
    r = r.withColumn("cpu_efficiency", F.when(F.col("repetition") != 2, F.col("cpu_efficiency")))
    out = S.scenario_summary(r, ["scenario"], [x for x in r.columns if x not in ("scenario", "repetition")], "repetition").drop("samples", "relative_stdev_percent")
    return rounded(rounded(out, "minimum", "median", "maximum"), "stdev", "relative_range_percent", digits=2)


@query("latency_summary", f"WITH {SAMPLES} SELECT scenario, count(*) AS sample_count, round(quantile_cont(latency_us, 0.5), 6) AS p50, round(quantile_cont(latency_us, 0.95), 6) AS p95, round(quantile_cont(latency_us, 0.99), 6) AS p99, max(latency_us) AS max FROM s GROUP BY scenario")
def _(s, d):
    return rounded(S.latency_summary(A.scenario_samples(s, d), ["scenario"], "latency_us"), "p50", "p95", "p99")


@query("comparison_classes", "SELECT operation, class, count(*) AS scenarios FROM (SELECT CASE o_custkey % 4 WHEN 0 THEN 'publish' WHEN 1 THEN 'consume_ack' WHEN 2 THEN 'consume' ELSE 'mixed' END AS operation, CASE o_custkey % 4 WHEN 0 THEN 'publish-only' WHEN 1 THEN 'consume-with-ack' WHEN 2 THEN 'consume-without-ack' END AS class FROM orders) GROUP BY ALL")
def _(s, d):
    op = F.get(F.array(*[F.lit(x) for x in ("publish", "consume_ack", "consume", "mixed")]), (F.col("o_custkey") % 4).cast("int"))
    return table(s, d, "orders").groupBy(op.alias("operation"), S.comparison_class(op).alias("class")).agg(F.count(F.lit(1)).alias("scenarios"))


@query("median_or_first", "WITH v AS (SELECT event_type, event_id, CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS v FROM events) SELECT event_type, CASE WHEN count(TRY_CAST(v AS DOUBLE)) = count(*) THEN median(TRY_CAST(v AS DOUBLE)) END AS number, CASE WHEN count(TRY_CAST(v AS DOUBLE)) <> count(*) THEN arg_min(v, event_id) END AS text FROM v GROUP BY 1")
def _(s, d):
    v = table(s, d, "events").select("event_type", "event_id", F.when((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0), "n/a").otherwise(F.col("user_id").cast("string")).alias("v"))
    return S.median_or_first(v, ["event_type"], "v", "event_id")


@query("cpu_efficiency", f"WITH {SAMPLES} SELECT scenario, round(CASE WHEN sum(messages) > 0 AND sum(cpu_seconds) > 0 THEN sum(messages) / sum(cpu_seconds) END, 4) AS messages_per_cpu_second FROM s GROUP BY scenario")
def _(s, d):
    return rounded(S.cpu_efficiency(A.scenario_samples(s, d), ["scenario"], "messages", "cpu_seconds"), "messages_per_cpu_second", digits=4)


@query("aggregate_scenarios", f"WITH {REPS} SELECT scenario, count(*) AS repetitions, median(throughput) AS throughput, round(median(p99), 6) AS p99 FROM r GROUP BY scenario")
def _(s, d):
    return rounded(_repetitions(s, d).groupBy("scenario").agg(F.count(F.lit(1)).alias("repetitions"), S.pct("throughput", 50).alias("throughput"), S.pct("p99", 50).alias("p99")), "p99")


@query("consistency_violations", "WITH g AS (SELECT o_custkey % 50 AS run_group, o_orderstatus, o_orderpriority, 'x' AS fixed FROM orders), u AS (SELECT run_group, 'o_orderstatus' AS field, count(DISTINCT o_orderstatus) AS values FROM g GROUP BY 1 UNION ALL SELECT run_group, 'o_orderpriority', count(DISTINCT o_orderpriority) FROM g GROUP BY 1 UNION ALL SELECT run_group, 'fixed', count(DISTINCT fixed) FROM g GROUP BY 1) SELECT * FROM u WHERE values > 1")
def _(s, d):
    o = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("run_group"), "o_orderstatus", "o_orderpriority", F.lit("x").alias("fixed"))
    return S.consistency_violations(o, "run_group", ["o_orderstatus", "o_orderpriority", "fixed"])


@query("run_rollup", "SELECT o_custkey % 50 AS run_group, min(o_orderdate) AS started, max(o_orderdate) AS finished, list_sort(list(DISTINCT o_orderpriority)) AS parts FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy((F.col("o_custkey") % 50).alias("run_group")).agg(F.min("o_orderdate").alias("started"), F.max("o_orderdate").alias("finished"), F.array_sort(F.collect_set("o_orderpriority")).alias("parts"))


@query("unpivot_points", f"WITH {REPS} SELECT scenario, repetition, 'throughput' AS metric, throughput AS value FROM r UNION ALL SELECT scenario, repetition, 'p99', round(p99, 6) FROM r")
def _(s, d):
    return S.unpivot_points(rounded(_repetitions(s, d), "p99"), ["scenario", "repetition"], ["throughput", "p99"])


@query("delta_vs_previous", f"WITH {HISTORY}, p AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY run) AS previous FROM h) SELECT run, series, value, samples, previous, round(value - previous, 4) AS delta, round((value - previous) / nullif(previous, 0) * 100, 4) AS delta_percent, round(value - previous, 4) > 0 AS improved FROM p")
def _(s, d):
    return rounded(S.delta_vs_previous(A.history(s, d), "series", "run", "value", True), "delta", "delta_percent", digits=4)


BASE = SAMPLES + ", c AS (SELECT scenario, repetition, sum(messages) AS v FROM s WHERE year = 1996 GROUP BY ALL), b AS (SELECT scenario, repetition, sum(messages) AS v FROM s WHERE year = 1995 AND repetition <> 3 GROUP BY ALL)"


def _years(s, d):
    x = A.scenario_samples(s, d)
    total = lambda f: x.filter(f).groupBy("scenario", "repetition").agg(F.sum("messages").alias("v"))
    return total(F.col("year") == 1996), total((F.col("year") == 1995) & (F.col("repetition") != 3))


@query("baseline_delta_join", f"WITH {BASE} SELECT c.scenario, c.repetition, c.v AS current, b.v AS baseline, round((c.v - b.v) / abs(b.v) * 100, 6) AS delta_percent FROM c LEFT JOIN b USING (scenario, repetition)")
def _(s, d):
    now, old = _years(s, d)
    return rounded(S.baseline_delta(now, old, ["scenario", "repetition"], "repetition", "v"), "delta_percent")


PAIRS = BASE + """, x AS (SELECT scenario, v, row_number() OVER (PARTITION BY scenario ORDER BY repetition) AS i FROM c), y AS (SELECT scenario, v, row_number() OVER (PARTITION BY scenario ORDER BY repetition) AS i FROM b),
 p AS (SELECT x.scenario, i - 1 AS place, x.v AS c, y.v AS b FROM x JOIN y USING (scenario, i)), q AS (SELECT scenario, count(*) AS n, quantile_cont(c, 0.25) AS c1, quantile_cont(c, 0.75) AS c3, quantile_cont(b, 0.25) AS b1, quantile_cont(b, 0.75) AS b3 FROM p GROUP BY 1),
 f AS (SELECT scenario, place, c, b, n >= 4 AND (c < c1 - 1.5 * (c3 - c1) OR c > c3 + 1.5 * (c3 - c1) OR b < b1 - 1.5 * (b3 - b1) OR b > b3 + 1.5 * (b3 - b1)) AS outlier FROM p JOIN q USING (scenario))"""


def _direction_sql(better):
    return f"""WITH {PAIRS}, m AS (SELECT scenario, count(*) AS n, median(c) AS c, median(b) AS b FROM f WHERE NOT outlier GROUP BY 1 HAVING median(b) <> 0), d AS (SELECT n, (c - b) / abs(b) * 100 AS x FROM m),
 g AS (SELECT count(*) FILTER (WHERE x {better} 0) AS improved, count(*) FILTER (WHERE x <> 0 AND NOT x {better} 0) AS worsened, count(*) FILTER (WHERE x = 0) AS neutral, count(*) AS scenarios, CAST(coalesce(sum(n), 0) AS BIGINT) AS paired_samples, round(median(x), 6) AS median_delta_percent FROM d)
 SELECT CASE WHEN scenarios > 0 THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN scenarios = 0 THEN NULL WHEN improved > worsened THEN 'generally improved' WHEN worsened > improved THEN 'generally worsened' ELSE 'mixed/unclear' END AS direction, * FROM g"""


@query("paired_samples", f"WITH {PAIRS} SELECT scenario, place, c AS current, b AS baseline, outlier FROM f")
def _(s, d):
    return S.paired_samples(*_years(s, d), "scenario", "repetition", "v")


@query("paired_direction", _direction_sql(">"))
def _(s, d):
    return rounded(S.paired_direction(*_years(s, d), "scenario", "repetition", "v", True), "median_delta_percent")


@query("paired_direction_lower", _direction_sql("<"))
def _(s, d):
    return rounded(S.paired_direction(*_years(s, d), "scenario", "repetition", "v", False), "median_delta_percent")


@query("tukey_outliers", "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id, event_type, value, round(a - 1.5 * (b - a), 6) AS low, round(b + 1.5 * (b - a), 6) AS high FROM events JOIN q USING (event_type) WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)")
def _(s, d):
    return rounded(S.tukey_outliers(table(s, d, "events"), "event_type", "value", ["event_id", "event_type", "value"]), "low", "high")


@query("relative_range", f"WITH {REPS} SELECT scenario, round((max(throughput) - min(throughput)) / abs(median(throughput)) * 100, 6) AS relative_range FROM r GROUP BY scenario")
def _(s, d):
    return rounded(S.relative_range(_repetitions(s, d), ["scenario"], "throughput"), "relative_range")


@query("stability_status", f"WITH {REPS}, g AS (SELECT scenario, count(*) AS repetitions, round((max(throughput) - min(throughput)) / abs(median(throughput)) * 100, 6) AS throughput_range, round((max(p99) - min(p99)) / abs(median(p99)) * 100, 6) AS p99_range FROM r GROUP BY scenario), x AS (SELECT *, concat_ws('; ', CASE WHEN repetitions < 3 THEN 'too few repetitions' END, CASE WHEN throughput_range > 10 THEN 'throughput varies' END, CASE WHEN p99_range > 20 THEN 'p99 varies' END) AS reasons FROM g) SELECT *, CASE WHEN reasons = '' THEN 'stable' ELSE 'inconclusive' END AS status FROM x")
def _(s, d):
    return rounded(S.stability(_repetitions(s, d), "scenario", "throughput", "p99"), "throughput_range", "p99_range")


@query("first_stable_attempt", f"WITH {HISTORY}, a AS (SELECT substr(run, 1, 4) || ' ' || series AS series, CAST(substr(run, 6, 2) AS INTEGER) AS attempt, samples % 7 = 0 AS stable, samples % 11 = 0 AS hard FROM h), g AS (SELECT series, min(attempt) FILTER (WHERE stable OR hard) AS e, max(attempt) AS l, arg_min(CASE WHEN stable THEN 'stable' ELSE 'failed' END, attempt) FILTER (WHERE stable OR hard) AS w FROM a GROUP BY 1) SELECT series, coalesce(e, l) AS stopped_at, coalesce(w, 'inconclusive') AS result FROM g")
def _(s, d):
    h = A.history(s, d).withColumn("series", F.concat_ws(" ", F.substring("run", 1, 4), "series")).withColumn("attempt", F.substring("run", 6, 2).cast("int"))
    return S.first_stable_attempt(h, "series", "attempt", F.col("samples") % 7 == 0, F.col("samples") % 11 == 0)


@query("rolling_median_5", f"WITH {HISTORY} SELECT *, round(quantile_cont(value, 0.5) OVER (PARTITION BY series ORDER BY run ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling_median FROM h")
def _(s, d):
    return rounded(S.rolling_median(A.history(s, d), "series", "run", "value"), "rolling_median")


@query("latest_changes", f"WITH {HISTORY}, p AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY run) AS previous FROM h) SELECT run, series, value, previous, CASE WHEN value > previous THEN 'Improved' ELSE 'Regressed' END AS change FROM p WHERE run = (SELECT max(run) FROM h) AND previous IS NOT NULL")
def _(s, d):
    points = S.delta_vs_previous(A.history(s, d), "series", "run", "value", True)
    return S.latest_changes(points, "run", "previous", "improved").select("run", "series", "value", "previous", "change")


@query("top_scenarios", "SELECT l_partkey, count(*) AS samples, round(max(l_extendedprice), 2) AS longest FROM lineitem GROUP BY 1 ORDER BY samples DESC, l_partkey LIMIT 32")
def _(s, d):
    g = table(s, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("samples"), F.round(F.max("l_extendedprice"), 2).alias("longest"))
    return g.orderBy(F.desc("samples"), "l_partkey").limit(32)


@query("facets", "SELECT DISTINCT 'l_returnflag' AS facet, l_returnflag AS value FROM lineitem UNION SELECT 'l_linestatus', l_linestatus FROM lineitem UNION SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem")
def _(s, d):
    return S.facets(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("series_filter", f"WITH {HISTORY} SELECT series, count(*) AS points, round(avg(value), 2) AS mean FROM h WHERE run >= '1997' AND series <> '5-LOW' AND samples > 1 GROUP BY 1")
def _(s, d):
    h = A.history(s, d).filter((F.col("run") >= "1997") & (F.col("series") != "5-LOW") & (F.col("samples") > 1))
    return h.groupBy("series").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg("value"), 2).alias("mean"))


@query("purge_transitions", "WITH l AS (SELECT user_id AS node, event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events), p AS (SELECT node, v > last_value(v IGNORE NULLS) OVER (PARTITION BY node ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM l) SELECT node, count(*) FILTER (WHERE up) AS increases FROM p GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("node"), "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return S.increases(e, "node", "event_id", "v")


@query("budget_checks", f"WITH {SAMPLES}, g AS (SELECT scenario, round(quantile_cont(latency_us, 0.99), 6) AS p99, sum(messages) AS messages FROM s GROUP BY 1) SELECT *, p99 <= 100000 AS p99_ok, messages >= 300000 AS messages_ok, p99 <= 100000 AND messages >= 300000 AS passed FROM g")
def _(s, d):
    g = A.scenario_samples(s, d).groupBy("scenario").agg(F.round(S.pct("latency_us", 99), 6).alias("p99"), F.sum("messages").alias("messages"))
    return S.budget_checks(g, {"p99": 100000}, {"messages": 300000})


def _number_sql(x, digits):
    return f"CASE WHEN {x} = floor({x}) THEN format('{{:,}}', CAST({x} AS BIGINT)) ELSE regexp_replace(format('{{:,.{digits}f}}', {x}), '\\.?0+$', '') END"


_SIZES = " ".join(f"WHEN b >= {1024**k} THEN {_number_sql(f'(b / {1024**k})', 1)} || ' {u}'" for k, u in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB")))


@query("formatters", f"""SELECT p_partkey, {_number_sql("b", 1)} AS number, CASE {_SIZES} ELSE {_number_sql("b", 1)} || ' B' END AS size, CASE WHEN b >= 1000000 THEN {_number_sql("(b / 1e6)", 2)} || ' s' WHEN b >= 1000 THEN {_number_sql("(b / 1e3)", 2)} || ' ms' ELSE {_number_sql("b", 2)} || ' µs' END AS duration,
 {_number_sql("(p_size * 1.25)", 1)} || '%' AS percent, CASE WHEN p_size >= 20 THEN '+' ELSE '-' END || format('{{:.1f}}', abs((p_size - 20) / 8.0)) || '%' AS change FROM (SELECT p_partkey, p_size, CAST(p_partkey * p_size AS DOUBLE) * p_partkey * 8.25 AS b FROM part)""")
def _(s, d):
    b = (F.col("p_partkey") * F.col("p_size")).cast("double") * F.col("p_partkey") * 8.25
    size = F.col("p_size")
    return table(s, d, "part").select("p_partkey", S.format_number(b).alias("number"), S.format_bytes(b).alias("size"), S.format_duration(b).alias("duration"), S.format_percent(size * 1.25).alias("percent"), S.format_percent((size - 20) / 8, True).alias("change"))


@query("assess_stability", f"""WITH {SAMPLES}, r AS (SELECT year, scenario, repetition, sum(messages) AS throughput, quantile_cont(latency_us, 0.99) AS p99 FROM s WHERE year IN (1995, 1996) GROUP BY ALL),
 g AS (SELECT year, scenario, count(*) AS n, (max(throughput) - min(throughput)) / abs(median(throughput)) * 100 AS t, (max(p99) - min(p99)) / abs(median(p99)) * 100 AS p FROM r GROUP BY ALL), m AS (SELECT min(n) AS repetitions, round(max(t) FILTER (WHERE n > 1), 6) AS throughput_range, round(max(p) FILTER (WHERE n > 1), 6) AS p99_range FROM g)
 SELECT CASE WHEN repetitions >= 3 AND throughput_range <= 10 AND p99_range <= 20 THEN 'stable' ELSE 'inconclusive' END AS status, *, concat_ws('; ', CASE WHEN repetitions < 3 THEN 'minimum repetitions were not reached' END, CASE WHEN throughput_range > 10 THEN 'throughput range exceeded its limit' END, CASE WHEN p99_range > 20 THEN 'p99 range exceeded its limit' END) AS reasons FROM m""")
def _(s, d):
    x = A.scenario_samples(s, d)
    own = lambda y: x.filter(F.col("year") == y).groupBy("scenario", "repetition").agg(F.sum("messages").alias("throughput"), S.pct("latency_us", 99).alias("p99"))
    return rounded(S.assess_stability(own(1996), own(1995), "scenario", "throughput", "p99"), "throughput_range", "p99_range")


@query("growth_summary", """WITH l AS (SELECT user_id AS node, event_id, value, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS purged, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
 p AS (SELECT *, last_value(purged IGNORE NULLS) OVER (PARTITION BY node ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l) SELECT node, max(value) AS peak_retained, count(*) FILTER (WHERE i > 1 AND purged IS NOT NULL AND (before IS NULL OR purged > before)) AS purge_transitions, max(event_id) - min(event_id) AS file_bytes_delta FROM p GROUP BY node""")
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("node"), "event_id", "value", F.when(F.col("event_type") != "error", F.floor("value")).alias("purged"), F.col("event_id").alias("bytes"))
    return S.growth_summary(e, "node", "event_id", "value", "purged", "bytes")


@query("per_node_medians", """WITH v AS (SELECT event_type, user_id % 5 AS node, event_id, CAST(user_id AS VARCHAR) AS a, CASE WHEN user_id % 5 = 2 AND event_id % 9 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS b FROM events), u AS (SELECT event_type, node, event_id, 'a' AS field, a AS v FROM v UNION ALL SELECT event_type, node, event_id, 'b', b FROM v)
 SELECT event_type, node, field, CASE WHEN count(TRY_CAST(v AS DOUBLE)) = count(*) THEN median(TRY_CAST(v AS DOUBLE)) END AS number, CASE WHEN count(TRY_CAST(v AS DOUBLE)) <> count(*) THEN arg_min(v, event_id) END AS text FROM u GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY event_type, node, field"))
def _(s, d):
    node = F.col("user_id") % 5
    v = table(s, d, "events").select("event_type", node.alias("node"), "event_id", F.col("user_id").cast("string").alias("a"), F.when((node == 2) & (F.col("event_id") % 9 == 0), "n/a").otherwise(F.col("event_id").cast("string")).alias("b"))
    return S.aggregate_per_node(v, ["event_type"], "node", ["a", "b"], "event_id")


@query("percent_deltas", """WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 7 = 0 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS a, CASE o_custkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE o_custkey - 100.0 END AS b FROM orders)
 SELECT o_orderkey, round(CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND b <> 0 THEN (a - b) / abs(b) * 100 END, 6) AS delta FROM v""")
def _(s, d):
    k = F.col("o_orderkey")
    a = F.when(k % 5 == 0, float("nan")).when(k % 7 == 0, float("inf")).otherwise(F.col("o_totalprice"))
    b = F.when(F.col("o_custkey") % 4 == 0, 0.0).when(F.col("o_custkey") % 4 != 1, F.col("o_custkey") - 100.0)
    return table(s, d, "orders").select("o_orderkey", F.round(S.percent_delta(a, b), 6).alias("delta"))


@query("history_series", """SELECT suite, backend, CASE WHEN backend = 'log' AND suite = 'log' THEN 'log' WHEN backend = 'log' AND suite = 'native-comparison' THEN 'log-native-comparison' ELSE suite END AS series, count(*) AS runs FROM (SELECT CASE o_custkey % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'native-comparison' ELSE 'clustered' END AS suite, CASE WHEN o_orderkey % 2 = 0 THEN 'log' ELSE 'other' END AS backend FROM orders) GROUP BY ALL""")
def _(s, d):
    suite = F.get(F.array(*[F.lit(x) for x in ("log", "native-comparison", "clustered")]), (F.col("o_custkey") % 3).cast("int"))
    backend = F.when(F.col("o_orderkey") % 2 == 0, "log").otherwise("other")
    return table(s, d, "orders").groupBy(suite.alias("suite"), backend.alias("backend"), S.series_of(suite, backend, "log").alias("series")).agg(F.count(F.lit(1)).alias("runs"))


@query("time_ticks", "WITH t AS (SELECT DISTINCT o_orderdate AS tick_at FROM orders), r AS (SELECT tick_at, row_number() OVER (ORDER BY tick_at) - 1 AS i, count(*) OVER () AS n FROM t) SELECT tick_at FROM r WHERE i IN (SELECT floor(k * ((SELECT max(n) FROM r) - 1) / 4.0 + 0.5) FROM (SELECT unnest(range(0, 5)) AS k))")
def _(s, d):
    return S.time_ticks(table(s, d, "orders").withColumnRenamed("o_orderdate", "tick_at"), "tick_at")


@query("log_ticks", """WITH e AS (SELECT event_type, min(value) + 0.5 AS low, max(value) * 40 AS high FROM events GROUP BY 1), t AS (SELECT event_type, low AS tick FROM e UNION SELECT event_type, high FROM e UNION SELECT event_type, p FROM e, (SELECT CAST(10 AS DOUBLE) ** unnest(range(-2, 9)) AS p) WHERE p > low AND p < high) SELECT event_type, round(tick, 6) AS tick FROM t""")
def _(s, d):
    e = table(s, d, "events").groupBy("event_type").agg((F.min("value") + 0.5).alias("low"), (F.max("value") * 40).alias("high"))
    return e.select("event_type", F.explode(S.log_ticks(F.col("low"), F.col("high"))).alias("tick")).withColumn("tick", F.round("tick", 6))


@query("bounded_text", r"""WITH f AS (SELECT doc_id, trim(translate(text, chr(13) || chr(10), '  '), ' ') AS t FROM documents), c AS (SELECT doc_id, CASE WHEN length(t) > 120 THEN rtrim(substr(t, 1, 119), ' ') || '…' ELSE t END AS t FROM f)
 SELECT doc_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\', '\\\\'), '|', '\\|') AS cell FROM c""".replace("\\\\", "\\"))
def _(s, d):
    return table(s, d, "documents").select("doc_id", S.bound_text(F.col("text")).alias("cell"))


# --- schedules and checks -----------------------------------------------------------------------


@query("case_matrix", "SELECT r AS repetition, runtime, size, delay, runtime || '-' || size || '-' || delay || '-' || lpad(CAST(r AS VARCHAR), 3, '0') AS case_id FROM (SELECT unnest(range(1, 4)) AS r), (SELECT unnest(['native', 'container']) AS runtime), (SELECT unnest([100, 1024]) AS size), (SELECT unnest([0, 10]) AS delay)")
def _(s, d):
    return V.case_matrix(s, {"runtime": ["native", "container"], "size": [100, 1024], "delay": [0, 10]}, 3).withColumn("repetition", F.col("repetition").cast("long"))


@query("scenario_matrix", """WITH d AS (SELECT * FROM (VALUES ('publish', 100, 0, 1), ('publish', 1024, 0, 1), ('publish', 100, 0, 8), ('publish', 1024, 0, 8), ('drain', 100, 0, 1), ('drain', 100, 10, 1), ('restart', 100, 0, 1)) AS t(scenario, size, delay, batch)), r AS (SELECT unnest([1, 2]) AS repetition)
 SELECT scenario, size, delay, batch, repetition, scenario || '-' || size || '-' || delay || '-' || batch || '-' || lpad(CAST(repetition AS VARCHAR), 3, '0') AS case_id FROM d, r""")
def _(s, d):
    return V.scenario_matrix(s, {"size": [100, 1024], "delay": [0, 10], "batch": [1, 8]}, {"publish": ["size", "batch"], "drain": ["delay"], "restart": []}, 2)


@query("hot_cold_schedule", """WITH r AS (SELECT unnest(range(0, 64)) AS round), p AS (SELECT unnest(range(0, 5)) AS place), x AS (SELECT round, place FROM r, p WHERE place = 0 OR round < 8) SELECT row_number() OVER (ORDER BY round, place) - 1 AS "offset", CASE WHEN place = 0 THEN 'hot' ELSE 'cold-' || place END AS key FROM x""")
def _(s, d):
    return V.hot_cold_schedule(s)


ORDERING = """dl AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS "offset", event_id + CASE WHEN event_id % 11 = 0 THEN 500 ELSE 0 END AS delivered, event_id + CASE WHEN event_id % 11 = 0 THEN 500 ELSE 0 END + CAST(floor(value) AS BIGINT) AS completed FROM events)"""


@query("per_key_ordering", f"""WITH {ORDERING}, o AS (SELECT key, "offset" < lag("offset") OVER (PARTITION BY key ORDER BY delivered, "offset") AS late FROM dl), e AS (SELECT key, delivered AS t, 1 AS x FROM dl UNION ALL SELECT key, completed, -1 FROM dl), g AS (SELECT key, t, x, sum(x) AS sx FROM e GROUP BY ALL),
 r AS (SELECT key, sum(sx) OVER (PARTITION BY key ORDER BY t, x) AS c FROM g), m AS (SELECT key, CAST(max(c) AS BIGINT) AS most_in_flight FROM r GROUP BY 1) SELECT key, count(*) AS deliveries, count(*) FILTER (WHERE late) AS out_of_order, any_value(most_in_flight) AS most_in_flight FROM o JOIN m USING (key) GROUP BY key""")
def _(s, d):
    delivered = F.col("event_id") + F.when(F.col("event_id") % 11 == 0, 500).otherwise(0)
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("offset"), delivered.alias("delivered"), (delivered + F.floor("value")).alias("completed"))
    return V.per_key_ordering(e, "key", "offset", "delivered", "completed")


@query("hot_backlog", """WITH e AS (SELECT event_type AS stream, event_id AS seq, user_id % 3 = 0 AS hot FROM events), t AS (SELECT *, sum(CAST(hot AS INTEGER)) OVER (PARTITION BY stream) - sum(CAST(hot AS INTEGER)) OVER (PARTITION BY stream ORDER BY seq) AS lft FROM e) SELECT stream, count(*) FILTER (WHERE NOT hot AND lft > 0) AS cold_while_hot, CAST(max(lft) AS BIGINT) AS most_backlog FROM t GROUP BY stream""")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), "user_id")
    return V.hot_backlog(e, "stream", "seq", F.col("user_id") % 3 == 0)


@query("cold_fairness", "WITH k AS (SELECT event_type AS stream, user_id, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY ALL) SELECT stream, count(*) AS keys, max(a) - min(a) AS first_spread, max(b) - min(b) AS last_spread FROM k GROUP BY 1")
def _(s, d):
    return V.cold_fairness(table(s, d, "events").withColumnRenamed("event_type", "stream"), "stream", "user_id", "event_id")


@query("matrix_status", "SELECT o_orderpriority AS scenario, count(*) AS planned, count(*) FILTER (WHERE o_custkey % 4 <> 0) AS attempted, count(*) FILTER (WHERE o_custkey % 4 = 1) AS completed, count(*) FILTER (WHERE o_custkey % 4 > 1) AS failed FROM orders GROUP BY 1")
def _(s, d):
    m = F.col("o_custkey") % 4
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("scenario"), F.when(m == 0, "planned").when(m == 1, "completed").otherwise("failed").alias("status"))
    return V.matrix_status(o, "scenario", "status")


@query("repeated_polls", f"""WITH {REC}, p AS (SELECT stream, seq, key AS member, "offset" // 500 AS o, seq % 2 AS a FROM rec), w AS (SELECT stream, row_number() OVER x > 1 AND o = first_value(o) OVER x AND a = first_value(a) OVER x AS same FROM p WINDOW x AS (PARTITION BY stream, member ORDER BY seq)) SELECT stream, count(*) AS polls, count(*) FILTER (WHERE same) AS matching FROM w GROUP BY 1""")
def _(s, d):
    p = A.records(s, d).select("stream", "seq", F.col("key").alias("member"), F.floor(F.col("offset") / 500).alias("offset"), (F.col("seq") % 2).alias("attempt"))
    return V.repeated_polls(p)


@query("rule_violations", "SELECT o_orderkey, 'price' AS rule FROM orders WHERE NOT o_totalprice > 1000 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE NOT o_orderstatus IN ('F', 'O')")
def _(s, d):
    o = table(s, d, "orders")
    return V.rule_violations(o, {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O")}).select("o_orderkey", "rule")


def flagship(s, d):
    """The next byte-bounded batch of each stream, from raw events."""
    return D.batch(candidates(s, d), 32, 800, attempts=A.attempts(A.records(s, d)))


# --- text sources, checksums, streaming ---------------------------------------------------------


@query("parse_prometheus", """WITH l AS (SELECT CASE WHEN event_id % 5 = 0 THEN '# HELP x' ELSE 'm_' || event_type || '{user="' || user_id || '"} ' || CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE CAST(event_id AS VARCHAR) END END AS v FROM events)
 SELECT split_part(v, ' ', 1) AS name, TRY_CAST(split_part(v, ' ', 2) AS DOUBLE) AS value FROM l WHERE NOT starts_with(v, '#') AND TRY_CAST(split_part(v, ' ', 2) AS DOUBLE) IS NOT NULL""")
def _(s, d):
    e = table(s, d, "events")
    number = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("event_id").cast("string"))
    line = F.when(F.col("event_id") % 5 == 0, "# HELP x").otherwise(F.concat(F.lit("m_"), "event_type", F.lit('{user="'), F.col("user_id").cast("string"), F.lit('"} '), number))
    return P.prometheus(e.select(line.alias("value")))


@query("parse_timing_logs", "SELECT event_type AS stage, count(*) AS count, quantile_cont(event_id, 0.5) AS p50_us, round(quantile_cont(event_id, 0.99), 6) AS p99_us, max(event_id) AS max_us FROM events WHERE event_id % 9 <> 0 GROUP BY 1")
def _(s, d):
    e = table(s, d, "events")
    line = F.when(F.col("event_id") % 9 == 0, "noise").otherwise(F.concat(F.lit("node-1 stage="), "event_type", F.lit(" elapsed_us="), F.col("event_id").cast("string"), F.lit(" ok")))
    return rounded(P.stage_summary(P.timings(e.select(line.alias("value")))), "p99_us")


@query("parse_tool_output", """SELECT p_partkey, CAST(p_size * 1000 AS DOUBLE) AS records_per_second, CAST(p_partkey AS DOUBLE) * 1048576 AS memory_bytes FROM part""")
def _(s, d):
    p = table(s, d, "part")
    text = F.concat(F.lit("1 records sent, 5.0 records/sec\n9 records sent, "), F.format_number(F.col("p_size") * 1000, 0), F.lit(" records/sec"))
    memory = F.concat(F.col("p_partkey").cast("string"), F.lit("MiB / 2GiB"))
    return p.select("p_partkey", P.last_number(text, r"([0-9.,]+) records/sec").alias("records_per_second"), P.size_bytes(memory).alias("memory_bytes"))


@query("parse_producer_output", """SELECT p_partkey, CAST(p_size * 1000 AS BIGINT) AS messages, p_size * 2.5 AS messages_per_second, CAST(p_size AS DOUBLE) * 1000 AS avg_us, CAST(p_size * 9 AS DOUBLE) * 1000 AS p999_us FROM part""")
def _(s, d):
    p = table(s, d, "part")
    n = lambda c: c.cast("string")
    tail = F.concat(F.lit(" records/sec (1 MB/sec), "), n(F.col("p_size")), F.lit(" ms avg latency, 99 ms max latency, 1 ms 50th, 2 ms 95th, 3 ms 99th, "), n(F.col("p_size") * 9), F.lit(" ms 99.9th."))
    text = F.concat(F.lit("5 records sent, 1.0"), tail, F.lit("\n"), F.format_number(F.col("p_size") * 1000, 0), F.lit(" records sent, "), n(F.col("p_size") * 2.5), tail)
    out = p.select("p_partkey", P.producer_output(text).alias("o"))
    return out.select("p_partkey", "o.messages", "o.messages_per_second", "o.avg_us", "o.p999_us")


@query("parse_consumer_output", """SELECT p_partkey, CAST(p_size AS BIGINT) AS messages, CAST(p_size * 100 AS DOUBLE) AS elapsed_ms, p_size * 1.5 AS messages_per_second, CAST(p_size AS DOUBLE) AS megabytes_per_second FROM part""")
def _(s, d):
    p = table(s, d, "part")
    size = F.col("p_size")
    end = F.date_format(F.timestamp_millis(F.lit(1_700_000_000_000) + size * 100), "yyyy-MM-dd HH:mm:ss:SSS")
    text = F.concat(F.lit("start.time, end.time, ...\n 2023-11-14 22:13:20:000, "), end, F.lit(", 3.0, "), size.cast("string"), F.lit(", "), size.cast("string"), F.lit(", "), (size * 1.5).cast("string"), F.lit(", 1, 2\nbye\n"))
    return p.select("p_partkey", P.consumer_output(text).alias("o")).select("p_partkey", "o.*")


@query("parse_stats_output", """SELECT p_partkey, CAST(p_size * 1000 AS DOUBLE) AS messages_per_second, CAST(p_size AS DOUBLE) AS p99_us, p_size * 1.5 AS p999_us FROM part""")
def _(s, d):
    size = F.col("p_size")
    text = F.concat(F.lit("Pub STATS: "), F.format_number(size * 1000, 0), F.lit(" msgs/sec ~ 1 MB/sec min: 1us avg: 2us max: 3us P50: 4us P90: 5us P99: "), size.cast("string"), F.lit("us P99.9: "), (size * 1.5).cast("string"), F.lit("us"))
    return table(s, d, "part").select("p_partkey", P.stats_output(text).alias("o")).select("p_partkey", "o.messages_per_second", "o.p99_us", "o.p999_us")


@query("parse_container_stats", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS cpu_percent, CAST(p_size AS DOUBLE) * 1048576 AS memory_bytes, 0.5 AS memory_percent FROM part""")
def _(s, d):
    row = F.concat(F.lit('{"Name":"x","CPUPerc":"'), F.col("p_size").cast("string"), F.lit('%","MemUsage":"'), F.col("p_size").cast("string"), F.lit('MiB / 2GiB","MemPerc":"0.50%"}'))
    return table(s, d, "part").select("p_partkey", P.container_stats(row).alias("o")).select("p_partkey", "o.*")


@query("manifest_violations", """SELECT n_nationkey, v AS violation FROM (SELECT n_nationkey, unnest([CASE WHEN n_nationkey % 5 = 0 THEN 'schema_version must be 1' END, CASE WHEN n_nationkey % 3 = 0 THEN 'budget events_replay.p99 must be positive' END, CASE WHEN n_nationkey % 7 = 0 THEN 'too few messages' END]) AS v FROM nation) WHERE v IS NOT NULL""")
def _(s, d):
    k = F.col("n_nationkey")
    n = lambda c: c.cast("string")
    seen = '"registered_observations":{"in_flight_deliveries_while_two_held":{"metric":"in_flight","scope":"here","held_delivery_count":2,"expected_metric_value":2}}'
    text = F.concat(F.lit('{"schema_version":'), n(F.when(k % 5 == 0, 2).otherwise(1)), F.lit(',"workloads":{"background_work":{"messages":'), n(F.when(k % 7 == 0, 1).otherwise(20)), F.lit(f',"budgets":{{"p99":250}},{seen}}},"events_replay":{{"budgets":{{"p99":'), n(F.when(k % 3 == 0, 0).otherwise(9)), F.lit("}}}}"))
    return P.manifest_violations(table(s, d, "nation").select("n_nationkey", text.alias("text")), "in_flight").select("n_nationkey", "violation")


@query("parse_journal", """SELECT CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN 'torn' WHEN event_id % 10 = 0 THEN 'corrupt' ELSE 'ok' END AS status, count(*) AS lines, CAST(coalesce(sum(user_id) FILTER (WHERE event_id % 10 <> 0 AND event_id <> (SELECT max(event_id) FROM events)), 0) AS BIGINT) AS users FROM events GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1"))
def _(s, d):
    e = table(s, d, "events")
    last = e.agg(F.max("event_id").alias("m"))
    whole = F.concat(F.lit('{"offset":'), F.col("event_id").cast("string"), F.lit(',"user":'), F.col("user_id").cast("string"), F.lit("}"))
    cut = F.when((F.col("event_id") == F.col("m")) | (F.col("event_id") % 10 == 0), F.substring(whole, 1, 9)).otherwise(whole)
    out = P.journal(e.join(last).select(F.col("event_id").alias("line"), cut.alias("value")), "offset long, user long")
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum("entry.user"), F.lit(0)).cast("long").alias("users"))


@query("crc32c_by_stream")
def _(s, d):
    rec = A.records(s, d).select("stream", crc32c_column(F.encode("payload", "UTF-8")).alias("crc"))
    return rec.groupBy("stream").agg(F.count(F.lit(1)).alias("records"), F.sum("crc").alias("crc_sum"))


@query("streaming_publish", f'WITH {PUBLISH} SELECT seq, stream, outcome, "offset" FROM pub')
def _(s, d):
    e = table(s, d, "events")
    raw = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events*.parquet")
    req = raw.select(F.col("event_id").alias("seq"), F.col("event_type").alias("stream"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"), F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("request_id"))
    root = f"{shared_dir(s)}/streaming-{uuid.uuid4().hex}"
    publishing.start(req, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return s.read.parquet(f"{root}/log").select("seq", "stream", "outcome", "offset")


# --- nested results -----------------------------------------------------------------------------


@query("scenario_keys", """SELECT l_returnflag AS operation, '{"a":"' || l_linestatus || '","z":"' || l_linenumber || '"}' AS key, count(*) AS repetitions FROM lineitem GROUP BY ALL""")
def _(s, d):
    pairs = F.create_map(F.lit("z"), F.col("l_linenumber").cast("string"), F.lit("a"), F.col("l_linestatus"))
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("operation"), H.canonical(pairs).alias("key")).agg(F.count(F.lit(1)).alias("repetitions"))


@query("interval_max", "WITH a AS (SELECT o_orderpriority AS node, max(o_orderkey % 1000) AS value FROM orders WHERE o_orderkey < 3000 GROUP BY 1), b AS (SELECT o_orderpriority AS node, max(o_orderkey % 1000 + o_custkey % 3) AS value FROM orders GROUP BY 1) SELECT node, CASE WHEN b.value > a.value THEN b.value END AS interval_max FROM a JOIN b USING (node)")
def _(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_orderpriority", "node")
    before = o.filter("o_orderkey < 3000").groupBy("node").agg(F.max(F.col("o_orderkey") % 1000).alias("value"))
    return H.interval_max(before, o.groupBy("node").agg(F.max(F.col("o_orderkey") % 1000 + F.col("o_custkey") % 3).alias("value")), "node")


@query("scenario_multiset", "WITH l AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_suppkey % 2 = 1), r AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_suppkey % 2 = 0) SELECT 'left' AS side, * FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT 'right', * FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)")
def _(s, d):
    # the two sides together are the whole table
    own = lambda k: table(s, d, "lineitem").filter(F.col("l_suppkey") % 2 == k).select(F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n"))
    return H.multiset_differences(own(1), own(0))


@query("evidence_ranges", f"WITH {SAMPLES} SELECT scenario, min(latency_us) AS low, max(latency_us) AS high, round(count(CASE WHEN order_key % 4 > 0 THEN latency_us END) / max(line) * 100, 4) AS sample_coverage_percent FROM (SELECT * REPLACE (CASE WHEN order_key % 4 > 0 THEN latency_us END AS latency_us) FROM s) GROUP BY scenario")
def _(s, d):
    x = A.scenario_samples(s, d).withColumn("latency_us", F.when(F.col("order_key") % 4 > 0, F.col("latency_us")))
    return rounded(H.evidence(x, ["scenario"], "latency_us", "line"), "sample_coverage_percent", digits=4)


@query("poll_within_limit", f"""WITH {STATE}, f AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY stream ORDER BY "offset") = 1), z AS (SELECT *, CAST({_F.format("(4 + " + _F.format("msg") + ")")} AS BIGINT) AS bytes FROM ({SIZED} {ATTEMPT.format("f")}))))
 SELECT stream, "offset", bytes AS response_bytes, CASE WHEN bytes > 58 THEN 'ResponseTooLarge' ELSE 'ok' END AS status FROM z""")
def _(s, d):
    rec, acked, leases, retries, attempts = state(s, d)
    return D.poll_within(D.eligible(rec, acked, leases, retries, F.lit(NOW)), 58, attempts)


@query("reply_outcomes", """WITH r AS (SELECT CASE user_id % 7 WHEN 0 THEN 'publish_item' WHEN 1 THEN 'poll_item' WHEN 2 THEN 'ack_item' WHEN 3 THEN 'change' WHEN 4 THEN 'read' WHEN 5 THEN 'error' ELSE 'shape_failure' END AS kind, event_id % 2 = 0 AS ok, CASE WHEN event_id % 3 = 0 THEN 'Retryable' ELSE 'Unknown' END AS err FROM events),
 o AS (SELECT kind, CASE WHEN kind = 'shape_failure' OR (kind = 'ack_item' AND NOT ok) THEN 'Rejected' WHEN kind = 'error' OR (kind = 'publish_item' AND NOT ok) THEN err ELSE 'Confirmed' END AS outcome,
  CASE WHEN kind = 'shape_failure' THEN 'Validated' WHEN kind = 'error' OR (kind IN ('publish_item', 'ack_item') AND NOT ok) THEN 'ExecutionStarted' WHEN kind = 'read' OR (kind = 'poll_item' AND NOT ok) THEN 'Completed' ELSE 'Durable' END AS stage FROM r) SELECT *, count(*) AS replies FROM o GROUP BY ALL""")
def _(s, d):
    names = F.array(*[F.lit(k) for k in ("publish_item", "poll_item", "ack_item", "change", "read", "error", "shape_failure")])
    kind = F.get(names, (F.col("user_id") % 7).cast("int"))
    r = table(s, d, "events").select(kind.alias("kind"), D.reply(kind, F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 3 == 0, "Retryable").otherwise("Unknown")).alias("r"))
    return r.groupBy("kind", F.col("r.outcome").alias("outcome"), F.col("r.stage").alias("stage")).agg(F.count(F.lit(1)).alias("replies"))
