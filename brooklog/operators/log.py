"""Stream-log operators: offsets, publishing, validation, replay, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed limits of the record format
KEY_BYTES, PAYLOAD_BYTES, REQUEST_ID_BYTES, NAME_CHARS, BATCH_RECORDS = 128, 64 << 20, 1024, 128, 1024
#: Distinct offsets of point reads that are pushed into the scan.
POINTS = 1000
#: Consecutive sequence numbers that one numbering task handles.
SPAN = 1 << 16


def running_count(df: DataFrame, group: str, seq: str, out: str, when: Column | None = None, span: int = SPAN) -> DataFrame:
    """Adds out: how many rows of the group (that satisfy `when`) precede the row by seq, itself left out."""
    return running_total(df, group, seq, out, F.lit(1) if when is None else F.when(when, 1).otherwise(0), span)


def running_total(df: DataFrame, group: str, seq: str, out: str, one: Column, span: int = SPAN) -> DataFrame:
    """Adds out: the sum of `one` over the rows of the group that precede the row by seq, itself left out.

    Each group is cut into spans of seq; sums of the spans before a row's own come from a small
    aggregate, so that one hot stream is numbered by many tasks.
    """
    cut = df.withColumn("_span", F.floor(F.col(seq) / span)).withColumn("_one", one)
    sums = cut.groupBy(F.col(group).alias("_g"), F.col("_span").alias("_s")).agg(F.sum("_one").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_g", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_span").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("_in", F.coalesce(F.sum("_one").over(inside), F.lit(0)))
    joined = ranked.join(bases, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_span") == F.col("_s")))
    return joined.withColumn(out, (F.col("_base") + F.col("_in")).cast("long")).drop("_span", "_one", "_g", "_s", "_base", "_in")


def assign_offsets(df: DataFrame, stream: str, seq: str, out: str, span: int = SPAN) -> DataFrame:
    """Dense offsets from 0 in each stream in order of seq, which is unique."""
    return running_count(df, stream, seq, out, span=span)


def stream_catalog(records: DataFrame) -> DataFrame:
    """Records, next offset and stored bytes of each stream."""
    size = F.octet_length("payload") + F.coalesce(F.octet_length("key"), F.lit(0))
    return records.groupBy("stream").agg(F.count(F.lit(1)).alias("records"), (F.max("offset") + 1).alias("next_offset"), F.sum(size).alias("bytes"))


def contiguity_audit(records: DataFrame) -> DataFrame:
    """Whether the offsets of each stream are 0..n-1, each once.

    Rows are counted by offset first, which spreads a hot stream, so that repeats are seen.
    """
    each = records.groupBy("stream", "offset").agg(F.count(F.lit(1)).alias("_n"))
    g = each.groupBy("stream").agg(F.sum("_n").alias("records"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.count(F.lit(1)).alias("_distinct"))
    n = F.col("records")
    return g.select("stream", "records", "first", "last", ((F.col("first") == 0) & (F.col("last") == n - 1) & (F.col("_distinct") == n)).alias("contiguous"))


def untorn(frames: DataFrame) -> DataFrame:
    """frames (stream, seq, whole) before each stream's first one that isn't whole: a crash tears the end of a log only."""
    torn = frames.filter(~F.coalesce("whole", F.lit(False))).groupBy(F.col("stream").alias("_s")).agg(F.min("seq").alias("_torn"))
    j = frames.join(torn, F.col("stream") == F.col("_s"), "left")
    return j.filter(F.col("_torn").isNull() | (F.col("seq") < F.col("_torn"))).select(*frames.columns)


def create_streams(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(stream, created): whether each wanted name is new."""
    known = existing.select(F.col("stream").alias("_s"), F.lit(False).alias("_old")).distinct()
    return wanted.select("stream").distinct().join(known, F.col("stream") == F.col("_s"), "left").select("stream", F.coalesce("_old", F.lit(True)).alias("created"))


def publish(requests: DataFrame, floor: DataFrame | None = None) -> DataFrame:
    """(seq, stream, outcome, offset) of publish requests in order of seq.

    The first request with an id appends; a later one with the same key and payload is a duplicate and gets the
    first one's offset; with another content it is a conflict and gets none. Requests without an id
    always append. An empty key equals a null one. Where requests have a column identity_kind, ids of different kinds never
    meet, and a `dead_letter_move` id with another content is `corrupt`: the content belongs to a move's identity. floor (stream, floor_seq): ids whose first record is below it
    are forgotten, and the next request with that id appends.
    """
    key = F.when(F.col("key") != "", F.col("key"))
    live = requests.withColumn("_k", key)
    if floor is not None:
        live = live.join(floor.select(F.col("stream").alias("_fs"), "floor_seq"), F.col("stream") == F.col("_fs"), "left").withColumn("_era", F.when(F.col("seq") < F.col("floor_seq"), 0).otherwise(1)).drop("_fs", "floor_seq")
    else:
        live = live.withColumn("_era", F.lit(1))
    own = live.withColumn("_id", F.when(F.col("request_id").isNotNull(), F.col("request_id")).otherwise(F.concat(F.lit("\u0000"), F.col("seq").cast("string"))))
    own = own.withColumn("_kind", F.coalesce("identity_kind", F.lit("public")) if "identity_kind" in requests.columns else F.lit("public"))
    w = Window.partitionBy("stream", "_kind", "_id", "_era").orderBy("seq")
    first = F.first(F.struct("seq", "_k", "payload")).over(w)
    marked = own.withColumn("_f", first).select(
        "seq", "stream", F.col("_f.seq").alias("_first"),
        F.when(F.col("_f.seq") == F.col("seq"), "appended").when(F.col("_f._k").eqNullSafe(F.col("_k")) & F.col("_f.payload").eqNullSafe(F.col("payload")), "duplicate").when(F.col("_kind") == "dead_letter_move", "corrupt").otherwise("conflict").alias("outcome"),
    )
    numbered = running_count(marked, "stream", "seq", "_next", F.col("outcome") == "appended")
    offsets = numbered.filter(F.col("outcome") == "appended").select(F.col("seq").alias("_aseq"), F.col("_next").alias("offset"))
    found = numbered.join(offsets, F.col("_first") == F.col("_aseq"), "left")
    return found.select("seq", "stream", "outcome", F.when(F.col("outcome").isin("appended", "duplicate"), F.col("offset")).alias("offset"))


def limits_error(key: Column, payload: Column, request_id: Column, key_bytes: int = KEY_BYTES, payload_bytes: int = PAYLOAD_BYTES) -> Column:
    """The first limit that a record breaks; null if it is valid."""
    return F.when(F.octet_length(key) > key_bytes, "key_too_large").when(F.octet_length(payload) > payload_bytes, "payload_too_large").when(F.octet_length(request_id) > REQUEST_ID_BYTES, "request_id_too_large")


def valid_name(name: Column) -> Column:
    """Whether a stream, consumer or member name is well formed."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9._-]{1,128}\z"), F.lit(False))


def name_error(kind: str, name: Column) -> Column:
    """What is said of a malformed name of a kind (stream, consumer or member); null if it is well formed."""
    shown = F.coalesce(name, F.lit(""))
    said = F.concat(F.lit(f"invalid {kind} name '"), shown, F.lit("'; use 1-128 ASCII letters, digits, '.', '_', or '-'"))
    return F.when(~valid_name(name), said)


def batch_shape(batches: DataFrame, records: DataFrame, batch: str, most: int = BATCH_RECORDS) -> DataFrame:
    """(batch, records, status) of declared batches: 1 to `most` records are ok; an empty batch has no rows in records."""
    sizes = records.groupBy(F.col(batch).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    j = batches.select(batch).distinct().join(sizes, F.col(batch) == F.col("_b"), "left")
    return j.select(batch, n.cast("long").alias("records"), F.when(n == 0, "empty").when(n > most, "too_many").otherwise("ok").alias("status"))


def stream_status(changes: DataFrame) -> DataFrame:
    """(stream, status, since): the last state of each stream from changes (stream, seq, status).

    A stream is creating until its first active change; creating it again changes nothing once it is active.
    """
    active = F.min(F.when(F.col("status") == "active", F.col("seq")))
    g = changes.groupBy("stream").agg(active.alias("_active"), F.min("seq").alias("_first"))
    return g.select("stream", F.when(F.col("_active").isNull(), "creating").otherwise("active").alias("status"), F.coalesce("_active", "_first").alias("since"))


def publish_batch(requests: DataFrame, batch: str, error: Column) -> DataFrame:
    """(batch, seq, stream, outcome, offset): in each batch an invalid record is rejected and uses up no offset."""
    marked = requests.withColumn("_error", error)
    numbered = running_count(marked, "stream", "seq", "_next", F.col("_error").isNull())
    return numbered.select(batch, "seq", "stream", F.coalesce("_error", F.lit("ok")).alias("outcome"), F.when(F.col("_error").isNull(), F.col("_next")).alias("offset"))


def replay(records: DataFrame, asked: DataFrame) -> DataFrame:
    """(stream, requested, status, payload, earliest, next_offset) of point reads (stream, requested).

    A read at or past the next offset, or below the earliest one, is history_unavailable. asked is a request: its distinct
    offsets, where they are few, become a filter that a stored log's scan gets.
    """
    few = [r[0] for r in asked.select("requested").distinct().limit(POINTS + 1).collect()]
    bounds = records.groupBy("stream").agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("next_offset"))
    hit = (records.filter(F.col("offset").isin(few)) if len(few) <= POINTS else records).select(F.col("stream").alias("_s"), F.col("offset").alias("_o"), "payload")
    joined = asked.join(bounds, "stream").join(hit, (F.col("stream") == F.col("_s")) & (F.col("requested") == F.col("_o")), "left")
    return joined.select("stream", "requested", F.when(F.col("_o").isNull(), "history_unavailable").otherwise("ok").alias("status"), "payload", "earliest", "next_offset")


def replay_page(records: DataFrame, start: int, most_records: int, most_bytes: int) -> DataFrame:
    """(stream, offset, running_bytes): the page of each stream from start, by count and by bytes; the first always fits.

    Offsets are dense, so the count bound is a filter on the offset, which the scan of a stored log gets, and windows see a page at most.
    """
    size = (F.octet_length("payload") + F.coalesce(F.octet_length("key"), F.lit(0))).cast("long")
    page = records.filter((F.col("offset") >= start) & (F.col("offset") < start + most_records))
    w = Window.partitionBy("stream").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return page.withColumn("running_bytes", F.sum(size).over(w)).filter((F.col("running_bytes") <= most_bytes) | (F.col("offset") == start)).select("stream", "offset", "running_bytes")


def move_id(stream: Column, consumer: Column, offset: Column, space: str) -> Column:
    """The identity of one dead-letter move."""
    return F.concat(F.lit(f"{space}/v1/"), F.length(stream), F.lit(":"), stream, F.lit("/"), F.length(consumer), F.lit(":"), consumer, F.lit("/"), offset.cast("string"))


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the text's UTF-8 bytes, as 16 hex digits; exact in decimals, for short names."""

    def step(state: Column, byte: Column) -> Column:
        # the state is (high, low) 32-bit halves: xor touches the low byte, the product is taken by halves
        low = state["lo"].bitwiseXOR(byte)
        lo = low * F.lit(435)  # 1099511628211 = 2**40 + 435
        hi = state["hi"] * F.lit(435) + F.shiftright(lo, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(hi.bitwiseAND(F.lit(0xFFFFFFFF)).alias("hi"), lo.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))

    digits = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.when(F.length(digits) > 0, F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    end = F.aggregate(bytes_, start, step)
    return F.concat(F.lpad(F.lower(F.hex(end["hi"])), 8, "0"), F.lpad(F.lower(F.hex(end["lo"])), 8, "0"))


def dead_letter_name(stream: Column, prefix: str, most: int = NAME_CHARS) -> Column:
    """The stream's dead-letter stream: a suffix, or a hash where that name would be too long."""
    plain = F.concat(stream, F.lit(".dead-letter"))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.lit(f"{prefix}.dead-letter."), fnv1a64(stream)))


def append_moves(moves: DataFrame, done: DataFrame) -> DataFrame:
    """(seq, move_id, outcome) of moves (seq, move_id, key, payload) onto those done (move_id, key, payload).

    The first move of an id appends unless the id is done; a later one of the same key and payload is a duplicate, of
    another one corrupt, since the content is part of a move's identity.
    """
    content = F.struct("key", "payload")
    old = done.groupBy("move_id").agg(F.min(content).alias("_old"))
    first = F.first(content).over(Window.partitionBy("move_id").orderBy("seq"))
    n = F.row_number().over(Window.partitionBy("move_id").orderBy("seq"))
    j = moves.withColumn("_first", first).withColumn("_n", n).join(old, "move_id", "left")
    known = F.coalesce("_old", "_first")
    fresh = F.col("_old").isNull() & (F.col("_n") == 1)
    return j.select("seq", "move_id", F.when(fresh, "appended").when(known.eqNullSafe(content), "duplicate").otherwise("corrupt").alias("outcome"))


def new_moves(moves: DataFrame, done: DataFrame) -> DataFrame:
    """The moves (seq, move_id, key, payload) that append; see append_moves."""
    fresh = append_moves(moves, done).filter(F.col("outcome") == "appended").select("seq", "move_id")
    return moves.join(fresh, ["seq", "move_id"], "left_semi")


def time_selector(records: DataFrame, asked: DataFrame, block: int = 256) -> DataFrame:
    """(stream, since_ms, offset, status): the lowest offset published at or after each asked time.

    Prefix maxima of blocks rise, so the first block that reaches the time holds the answer; records are joined
    on that block alone. Blocks whose maximum is new are sorted with the asked times, latest first, and the last
    block at or past a time is its answer, so each block and time is one row of one pass. A time past all records is `no_match`; a
    stream without records is `history_unavailable`.
    """
    blocks = prefix_max_blocks(records, block)
    rises = blocks.groupBy("stream", F.col("prefix_max_ms").alias("t")).agg(F.min("block").alias("block")).withColumn("since_ms", F.lit(None).cast("long"))
    rows = rises.unionByName(asked.select("stream", F.col("since_ms").cast("long").alias("t"), F.lit(None).cast("long").alias("block"), F.col("since_ms").cast("long").alias("since_ms")).distinct())
    later = Window.partitionBy("stream").orderBy(F.desc("t"), F.col("since_ms").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    first = rows.withColumn("_first", F.last("block", ignorenulls=True).over(later)).filter(F.col("since_ms").isNotNull()).select("stream", "since_ms", F.col("_first").alias("block"))
    known = records.select(F.col("stream").alias("_k")).distinct()
    own = records.select(F.col("stream").alias("_s"), F.floor(F.col("offset") / block).alias("_b"), "offset", "published_at_ms")
    hit = first.join(own, (F.col("stream") == F.col("_s")) & (F.col("block") == F.col("_b")) & (F.col("published_at_ms") >= F.col("since_ms")), "left")
    found = hit.groupBy("stream", "since_ms").agg(F.min("offset").alias("offset")).join(known, F.col("stream") == F.col("_k"), "left")
    status = F.when(F.col("_k").isNull(), "history_unavailable").when(F.col("offset").isNull(), "no_match").otherwise("found")
    return found.select("stream", "since_ms", "offset", status.alias("status"))


def prefix_max_blocks(records: DataFrame, block: int = 256) -> DataFrame:
    """(stream, block, max_ms, prefix_max_ms): latest publish time in each block and up to it."""
    blocks = records.groupBy("stream", F.floor(F.col("offset") / block).alias("block")).agg(F.max("published_at_ms").alias("max_ms"))
    w = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("prefix_max_ms", F.max("max_ms").over(w))


def retention_floor_by_size(records: DataFrame, cursors: DataFrame, leases: DataFrame, most_bytes: int, previous: DataFrame) -> DataFrame:
    """(stream, floor): the first offset to keep so that keys and payloads of the kept suffix take at most most_bytes.

    Nothing at or past the lowest cursor or a live lease goes, and the floor never falls below the previous one (stream, floor).
    """
    size = (F.octet_length("payload") + F.coalesce(F.octet_length("key"), F.lit(0))).cast("long")
    total = records.groupBy(F.col("stream").alias("_t")).agg(F.sum(size).alias("_total"), (F.max("offset") + 1).alias("_next"))
    before = running_total(records, "stream", "offset", "_before", size).join(total, F.col("stream") == F.col("_t"))
    fits = before.groupBy("stream").agg(F.min(F.when(F.col("_total") - F.col("_before") <= most_bytes, F.col("offset"))).alias("_fits"), F.max("_next").alias("_next"))
    low = cursors.groupBy("stream").agg(F.min("committed_offset").alias("_cursor")).join(leases.groupBy("stream").agg(F.min("offset").alias("_lease")), "stream", "left")
    j = fits.join(low, "stream", "left").join(previous.select("stream", F.col("floor").alias("_old")), "stream", "left")
    wanted = F.least(F.coalesce("_fits", "_next"), F.coalesce("_cursor", F.lit(0)), F.coalesce("_lease", "_next"))
    return j.select("stream", F.greatest(wanted, F.coalesce("_old", F.lit(0))).alias("floor"))


def replay_continuation(page: DataFrame, records: DataFrame, start: int) -> DataFrame:
    """(stream, earliest, next_offset, continue_at, done) after a page (stream, offset) from start: where the next page begins."""
    bounds = records.groupBy("stream").agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).alias("next_offset"))
    at = page.groupBy(F.col("stream").alias("_s")).agg((F.max("offset") + 1).alias("_at"))
    j = bounds.join(at, F.col("stream") == F.col("_s"), "left").withColumn("continue_at", F.coalesce("_at", F.least(F.lit(start).cast("long"), F.col("next_offset"))))
    return j.select("stream", "earliest", "next_offset", "continue_at", (F.col("continue_at") >= F.col("next_offset")).alias("done"))


def retention_floor(records: DataFrame, cursors: DataFrame, cutoff_ms: Column) -> DataFrame:
    """(stream, floor): the first offset to keep. Only a contiguous prefix strictly older than the cutoff goes, and nothing at or past the lowest cursor."""
    young = records.groupBy("stream").agg(F.min(F.when(F.col("published_at_ms") >= cutoff_ms, F.col("offset"))).alias("_young"), (F.max("offset") + 1).alias("_next"))
    low = cursors.groupBy("stream").agg(F.min("committed_offset").alias("_cursor"))
    joined = young.join(low, "stream", "left")
    return joined.select("stream", F.least(F.coalesce("_young", "_next"), F.coalesce("_cursor", F.lit(0))).alias("floor"))


def inventory(records: DataFrame) -> DataFrame:
    """Counts, range and an order-free digest of each stream, to compare before and after a migration: the sum of the first 32 bits of each record's MD5."""
    whole = F.md5(F.concat_ws("|", F.col("offset").cast("string"), F.coalesce("key", F.lit("")), F.coalesce("payload", F.lit(""))))
    digest = F.conv(F.substring(whole, 1, 8), 16, 10).cast("long")
    return records.groupBy("stream").agg(F.count(F.lit(1)).alias("records"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.sum(digest).alias("digest"))


def migration_differences(source: DataFrame, target: DataFrame) -> DataFrame:
    """(stream, offset, problem) of rows that are missing, extra or changed."""
    a = source.select("stream", "offset", F.struct("key", "payload").alias("_a"), F.lit(1).alias("_ha"))
    b = target.select("stream", "offset", F.struct("key", "payload").alias("_b"), F.lit(1).alias("_hb"))
    j = a.join(b, ["stream", "offset"], "full")
    problem = F.when(F.col("_hb").isNull(), "missing").when(F.col("_ha").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select("stream", "offset", "problem")
