"""Delivery operators: cursors, candidates, batches, leases, retries, dead letters, acknowledgements, policies.

State is a set of small frames: records (stream, offset, key, payload, ...), acked (stream, offset), leases,
retries and attempts. Every function is a query over them; the clock is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brooklog.operators.log import SPAN, dead_letter_name

ACK_TIMEOUT_MS, MAX_POLICY_MS = 30_000, 604_800_000
#: Fixed limits of one consume request.
MOST_RECORDS, MOST_BYTES = 1024, 65 << 20
PAIR = ["stream", "offset"]


def consumer_cursor(records: DataFrame, acked: DataFrame) -> DataFrame:
    """(stream, committed_offset): the smallest offset that isn't acknowledged, or the next offset."""
    open_ = records.join(acked.select(*PAIR).withColumn("_acked", F.lit(True)), PAIR, "left")
    g = open_.groupBy("stream").agg(F.min(F.when(F.col("_acked").isNull(), F.col("offset"))).alias("_gap"), (F.max("offset") + 1).alias("_next"))
    return g.select("stream", F.coalesce("_gap", "_next").alias("committed_offset"))


def eligible(records: DataFrame, acked: DataFrame, leases: DataFrame, retries: DataFrame, now_ms: Column) -> DataFrame:
    """Records that may be delivered: neither acknowledged, leased nor waiting, and with a key that isn't reserved.

    Leases past their deadline and retries past their delay no longer hold a record. Null keys are never reserved.
    """
    held = leases.filter(F.col("deadline_ms") > now_ms).select(*PAIR, "key").unionByName(retries.filter(F.col("retry_not_before_ms") > now_ms).select(*PAIR, "key"))
    out = acked.select(*PAIR).unionByName(held.select(*PAIR)).distinct()
    reserved = held.select("stream", "key").filter(F.col("key").isNotNull()).distinct()
    return records.join(out, PAIR, "left_anti").join(reserved, ["stream", "key"], "left_anti")


def head_of_line(candidates: DataFrame) -> DataFrame:
    """The lowest offset of each key, and every record without a key."""
    keyed = candidates.filter(F.col("key").isNotNull())
    first = keyed.groupBy("stream", "key").agg(F.min("offset").alias("offset"))
    return keyed.join(first, ["stream", "key", "offset"]).unionByName(candidates.filter(F.col("key").isNull()).select("stream", "key", "offset", *[c for c in candidates.columns if c not in ("stream", "key", "offset")]))


def varint_bytes(n: Column) -> Column:
    """Bytes of an unsigned number in the wire's base-128 form."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def field_bytes(size: Column) -> Column:
    """Bytes of a field with `size` bytes of content: tag, length and content."""
    return F.lit(1) + varint_bytes(size) + size


def text_bytes(text: Column) -> Column:
    """Bytes of a text field; a null one isn't sent."""
    return F.when(text.isNull(), 0).otherwise(field_bytes(F.octet_length(text).cast("long"))).cast("long")


def message_bytes(consumer: str, member: str | None, token: Column, attempt: Column) -> Column:
    """Upper bound of an encoded message (columns stream, offset, key, payload, published_at_ms); null token and attempt aren't sent."""
    numbers = F.lit(2) + varint_bytes(F.col("offset")) + varint_bytes(F.col("published_at_ms"))
    tried = F.when(attempt.isNull(), 0).otherwise(F.lit(1) + varint_bytes(attempt))
    named = text_bytes(F.col("stream")) + text_bytes(F.lit(consumer)) + (text_bytes(F.lit(member)) if member is not None else F.lit(0))
    return (named + numbers + field_bytes(F.octet_length("payload").cast("long")) + text_bytes(F.col("key")) + text_bytes(token) + tried).cast("long")


def item_bytes(consumer: str, member: str | None, token: Column, attempt: Column) -> Column:
    """Upper bound of one item of a batch reply: the message inside an item with outcome and stage, inside the reply."""
    return field_bytes(F.lit(4) + field_bytes(message_bytes(consumer, member, token, attempt))).cast("long")


def empty_batch_bytes(consumer: str) -> Column:
    """Bytes of a batch reply without items: stream and consumer inside the result, the reply and the frame."""
    return field_bytes(field_bytes(text_bytes(F.col("stream")) + text_bytes(F.lit(consumer)))).cast("long")


def poll_bytes(consumer: str, member: str | None, token: Column, attempt: Column) -> Column:
    """Upper bound of a single message's reply."""
    return field_bytes(F.lit(4) + field_bytes(message_bytes(consumer, member, token, attempt))).cast("long")


def consume_limits_error(most_records: Column, most_bytes: Column) -> Column:
    """What is wrong with the limits of a consume request; null if nothing is."""
    records = F.when(~F.coalesce(most_records.between(1, MOST_RECORDS), F.lit(False)), f"max_records must be between 1 and {MOST_RECORDS}")
    return F.coalesce(records, F.when(~F.coalesce(most_bytes.between(1, MOST_BYTES), F.lit(False)), f"max_bytes must be between 1 and {MOST_BYTES}"))


def token_of(seed: str) -> Column:
    return F.concat(F.lit(f"{seed}-"), F.lower(F.hex("offset")))


def next_attempt(candidates: DataFrame, attempts: DataFrame | None) -> DataFrame:
    """Adds attempt, the number of the delivery to come: one more than those made (stream, offset, attempts)."""
    if attempts is None:
        return candidates.withColumn("attempt", F.lit(1).cast("long"))
    tried = attempts.select(F.col("stream").alias("_as"), F.col("offset").alias("_ao"), F.col("attempts").alias("_tries"))
    j = candidates.join(tried, (F.col("stream") == F.col("_as")) & (F.col("offset") == F.col("_ao")), "left")
    return j.withColumn("attempt", (F.coalesce("_tries", F.lit(0)) + 1).cast("long")).drop("_as", "_ao", "_tries")


def batch(candidates: DataFrame, most_records: int, most_bytes: int, token_seed: str = "seed", consumer: str = "consumer", member: str | None = None, attempts: DataFrame | None = None) -> DataFrame:
    """(stream, offset, key, attempt, batch_bytes, delivery_token, status): the next batch of each stream.

    Head-of-line records by offset, cut at the first that exceeds a limit; batch_bytes bounds the whole reply up to and
    with the record. Where the first record alone is too large, its row says ConsumeBatchRecordTooLarge and has no
    token; where even an empty reply is, the row says InvalidBatchRequest. A count limit first keeps the most_records lowest
    offsets of each stream, with partial top-k in Spark's window group limit, so the byte window sees no more than that.
    """
    w = Window.partitionBy("stream").orderBy("offset")
    ranked = head_of_line(candidates).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most_records)
    token = token_of(token_seed)
    sized = next_attempt(ranked, attempts).withColumn("_empty", empty_batch_bytes(consumer)).withColumn("_item", item_bytes(consumer, member, token, F.col("attempt")))
    used = sized.withColumn("batch_bytes", (F.col("_empty") + F.sum("_item").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    fits = F.col("batch_bytes") <= most_bytes
    status = F.when(F.col("_empty") > most_bytes, "InvalidBatchRequest").when(~fits, "ConsumeBatchRecordTooLarge").otherwise("ok")
    return used.filter(fits | (F.col("_rank") == 1)).select("stream", "offset", "key", "attempt", "batch_bytes", F.when(fits, token).alias("delivery_token"), status.alias("status"))


def poll_step(records: DataFrame, acked: DataFrame, leases: DataFrame, retries: DataFrame, attempts: DataFrame, now_ms: Column, member: str, most_bytes: int, policy: tuple[int, int], consumer: str = "consumer", token_seed: str = "seed") -> DataFrame:
    """(stream, action, offset, attempt, response_bytes): all that one poll of a member does in each stream, before any change.

    policy: (retry delay in ms, most attempts). In order: leases past their deadline expire (`retry`, or `dead_letter` if their
    attempts are used up) and no longer hold a record or key, except that an expired record with a delay waits for it; the member's own live
    lease is given again (`existing`); else the next candidate is delivered. A reply above most_bytes is `too_large`: then nothing of
    the stream changes, so its expiries are left out. A stream with nothing to give has `empty`.
    """
    delay_ms, most_attempts = policy
    over = retry_schedule(expired(leases, now_ms), attempts, now_ms, delay_ms, most_attempts)
    changes = over.select(*PAIR, F.when(F.col("terminal"), "dead_letter").otherwise("retry").alias("action"))
    waiting = over.filter(F.col("retry_not_before_ms").isNotNull()).select(*PAIR, "retry_not_before_ms").join(leases.select(*PAIR, "key"), PAIR)
    moved = over.filter("terminal").select(*PAIR)
    live = leases.filter(F.col("deadline_ms") > now_ms)
    free = eligible(records, acked.select(*PAIR).unionByName(moved), live, retries.select(*PAIR, "key", "retry_not_before_ms").unionByName(waiting), now_ms)
    own = live.filter(F.col("member") == member).groupBy("stream").agg(F.min("offset").alias("offset"))
    held = next_attempt(records.join(own, PAIR, "left_semi"), attempts).withColumn("attempt", F.greatest(F.col("attempt") - 1, F.lit(1))).withColumn("action", F.lit("existing"))
    first = next_attempt(free.join(next_per_stream(free), PAIR, "left_semi").join(own.select("stream"), "stream", "left_anti"), attempts).withColumn("action", F.lit("deliver"))
    size = poll_bytes(consumer, member, token_of(token_seed), F.col("attempt"))
    columns = ["stream", "action", "offset", "attempt", "response_bytes"]
    given = held.withColumn("response_bytes", size).select(*columns).unionByName(first.withColumn("response_bytes", size).select(*columns))
    given = given.withColumn("action", F.when(F.col("response_bytes") > most_bytes, "too_large").otherwise(F.col("action")))
    idle = records.select("stream").distinct().join(given.select("stream"), "stream", "left_anti").select("stream", F.lit("empty").alias("action"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("attempt"), F.lit(None).cast("long").alias("response_bytes"))
    stuck = given.filter(F.col("action") == "too_large").select("stream")
    kept = next_attempt(changes.join(stuck, "stream", "left_anti"), attempts).withColumn("attempt", F.col("attempt") - 1).withColumn("response_bytes", F.lit(None).cast("long"))
    return given.unionByName(idle).unionByName(kept.select(*columns))


def next_per_stream(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("stream").agg(F.min("offset").alias("offset"))


def expired(leases: DataFrame, now_ms: Column) -> DataFrame:
    return leases.filter(F.col("deadline_ms") <= now_ms)


def retry_schedule(expired_leases: DataFrame, attempts: DataFrame, now_ms: Column, delay_ms: int, most_attempts: int) -> DataFrame:
    """(stream, offset, retry_not_before_ms, terminal) of expired leases; terminal ones aren't scheduled."""
    joined = expired_leases.join(attempts, PAIR, "left").withColumn("terminal", F.coalesce("attempts", F.lit(1)) >= most_attempts)
    return joined.select(*PAIR, F.when(~F.col("terminal") & F.lit(delay_ms > 0), now_ms + delay_ms).alias("retry_not_before_ms"), "terminal")


def next_wake(leases: DataFrame, retries: DataFrame, now_ms: Column) -> DataFrame:
    """(stream, wake_ms): the earliest deadline or retry time after now."""
    times = leases.select("stream", F.col("deadline_ms").alias("t")).unionByName(retries.select("stream", F.col("retry_not_before_ms").alias("t")))
    return times.filter(F.col("t") > now_ms).groupBy("stream").agg(F.min("t").alias("wake_ms"))


def orphans(attempts: DataFrame, acked: DataFrame, leases: DataFrame, retries: DataFrame) -> DataFrame:
    """Attempted records that are neither acknowledged, leased nor scheduled."""
    rest = acked.select(*PAIR).unionByName(leases.select(*PAIR)).unionByName(retries.select(*PAIR)).distinct()
    return attempts.join(rest, PAIR, "left_anti").select(*PAIR, "attempts")


def dead_letters(candidates: DataFrame, attempts: DataFrame, most_attempts: int, most_records: int) -> DataFrame:
    """(stream, offset, action): what a poll does with the candidates that it visits before its batch is full.

    Terminal records (attempts used up, stream itself no dead-letter stream) move and take no place and no key.
    """
    joined = candidates.join(attempts, PAIR, "left")
    terminal = (F.coalesce("attempts", F.lit(0)) >= most_attempts) & ~F.col("stream").endswith(".dead-letter")
    marked = joined.withColumn("_terminal", terminal)
    kept = head_of_line(marked.filter(~F.col("_terminal")).select("stream", "key", "offset"))
    w = Window.partitionBy("stream").orderBy("offset")
    chosen = kept.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most_records)
    last = chosen.groupBy("stream").agg(F.max("offset").alias("_last"), F.count(F.lit(1)).alias("_n"))
    moved = marked.filter("_terminal").join(last, "stream", "left").filter(F.coalesce(F.col("_n") < most_records, F.lit(True)) | (F.col("offset") < F.col("_last")))
    return chosen.select("stream", "offset", F.lit("deliver").alias("action")).unionByName(moved.select("stream", "offset", F.lit("dead_letter").alias("action")))


def dead_letter_streams(streams: DataFrame, prefix: str) -> DataFrame:
    """(stream, dead_letter): a stream is one of dead letters by its suffix, or if its hashed name is that of a stream there is."""
    hashed = streams.select(dead_letter_name(F.col("stream"), prefix).alias("_target")).distinct().withColumn("_known", F.lit(True))
    own = F.col("stream").startswith(f"{prefix}.dead-letter.")
    j = streams.select("stream").distinct().join(hashed, (F.col("stream") == F.col("_target")) & own, "left")
    return j.select("stream", (F.col("stream").endswith(".dead-letter") | F.col("_known").isNotNull()).alias("dead_letter"))


def state_violations(cursor: DataFrame, attempts: DataFrame, policies: DataFrame, leases: DataFrame, retries: DataFrame) -> DataFrame:
    """(stream, rule, offsets): what breaks a loaded consumer state's rules, counted by offset.

    cursor (stream, committed_offset); attempts (stream, offset, attempts); policies, leases with their attempt, and retries by (stream, offset).
    """
    mark = lambda df, name, value=F.lit(True): df.select(*PAIR, value.alias(name)).dropDuplicates(PAIR)
    every = mark(attempts, "_a", F.col("attempts"))
    for other in (mark(policies, "_p"), mark(leases, "_l", F.col("attempt")), mark(retries, "_r")):
        every = every.join(other, PAIR, "full")
    j = every.join(cursor, "stream", "left")
    tried, held, waits = F.col("_a").isNotNull(), F.col("_l").isNotNull(), F.col("_r").isNotNull()
    rules = {
        "attempts and pinned policies have the same offsets": tried == F.col("_p").isNotNull(),
        "attempts are positive": ~tried | (F.col("_a") > 0),
        "a lease has its offset's attempt": ~held | F.coalesce(F.col("_l") == F.col("_a"), F.lit(False)),
        "a retry belongs to an attempted offset without a lease": ~waits | (tried & ~held),
        "leases and attempts are at or after the cursor": ~(tried | held) | F.coalesce(F.col("offset") >= F.col("committed_offset"), F.lit(True)),
    }
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return j.select("stream", F.explode(broken).alias("rule")).groupBy("stream", "rule").agg(F.count(F.lit(1)).alias("offsets"))


GROUP = ["stream", "consumer"]


#: Fixed list: the requests that only an operator may send; all others need an application.
OPERATOR_ONLY = ("create_stream", "configure_consumer", "health")


def authorized(role: Column, request: Column) -> Column:
    """Whether a role (operator or application) may send a request."""
    return (role == "operator") | ((role == "application") & ~request.isin(*OPERATOR_ONLY))


def reconcile(leases: DataFrame, events: DataFrame) -> DataFrame:
    """leases (stream, consumer, offset, ...) that still stand after the journal is read again: those below the consumer's cursor and
    those acknowledged past it go."""
    cursor = fold_cursor(events).select(*[F.col(c).alias(f"_{c}") for c in GROUP], "committed_offset")
    acks = events.filter(F.col("event_type") == "acknowledge").select(*GROUP, "offset").distinct()
    j = leases.join(acks, [*GROUP, "offset"], "left_anti").join(cursor, (F.col("stream") == F.col("_stream")) & (F.col("consumer") == F.col("_consumer")), "left")
    return j.filter(F.col("committed_offset").isNull() | (F.col("offset") >= F.col("committed_offset"))).select(*leases.columns)


def cache_evictions(states: DataFrame, active: DataFrame, most: int = 1024) -> DataFrame:
    """(stream, consumer, active) of the states (stream, consumer) that each stream's cache gives up when it holds more than `most`.

    Inactive consumers go first, by name, then active ones; only the states beyond the bound go.
    """
    busy = active.select(*GROUP).distinct().withColumn("active", F.lit(True))
    j = states.select(*GROUP).distinct().join(busy, GROUP, "left").withColumn("active", F.coalesce("active", F.lit(False)))
    total = j.groupBy(F.col("stream").alias("_s")).agg((F.count(F.lit(1)) - most).alias("_over")).filter("_over > 0")
    place = F.row_number().over(Window.partitionBy("stream").orderBy("active", "consumer"))
    return j.withColumn("_place", place).join(total, F.col("stream") == F.col("_s")).filter(F.col("_place") <= F.col("_over")).select(*GROUP, "active")


def wakes(waiters: DataFrame, changes: DataFrame) -> DataFrame:
    """(stream, consumer, since, wake_ms, reason): the first change of its stream after each waiting poll began; null if there is none yet.

    waiters (stream, consumer, since); changes (stream, at_ms, reason) are publishes, acks, policies and expiries. Both are sorted by time in
    one pass, latest first, so no pair of them is made.
    """
    rows = waiters.select("stream", F.col("since").alias("_t"), "consumer", F.lit(None).cast("struct<at:bigint,reason:string>").alias("_c"))
    first = changes.groupBy("stream", F.col("at_ms").alias("_t")).agg(F.min("reason").alias("_r")).select("stream", "_t", F.lit(None).cast("string").alias("consumer"), F.struct(F.col("_t").alias("at"), F.col("_r").alias("reason")).alias("_c"))
    w = Window.partitionBy("stream").orderBy(F.desc("_t"), F.col("_c").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.unionByName(first).withColumn("_next", F.last("_c", ignorenulls=True).over(w)).filter(F.col("_c").isNull())
    return marked.select("stream", "consumer", F.col("_t").alias("since"), F.col("_next.at").alias("wake_ms"), F.col("_next.reason").alias("reason"))


def append_outcomes(events: DataFrame) -> DataFrame:
    """(seq, durable, outcome) of consumer events (seq, failed_stage) that a journal takes: an event that failed before its append may be
    sent again, one that failed in the append or its sync is in doubt, and every later event of the consumer is refused until that is settled."""
    doubt = F.min(F.when(F.col("failed_stage").isin("Append", "Sync"), F.col("seq"))).over(Window.partitionBy(*GROUP))
    blocked = doubt.isNotNull() & (F.col("seq") > doubt)
    outcome = F.when(blocked, "NeedsReconcile").when(F.col("failed_stage").isNull(), "Confirmed").when(F.col("failed_stage") == "BeforeAppend", "Retryable").otherwise("Unknown")
    return events.select("seq", *GROUP, (F.col("failed_stage").isNull() & ~blocked).alias("durable"), outcome.alias("outcome"))


def fold_attempts(events: DataFrame) -> DataFrame:
    """(stream, consumer, offset, attempts, first_policy): the most attempts, and the policy of the first one."""
    tries = events.filter(F.col("event_type") == "delivery_attempt")
    return tries.groupBy(*GROUP, "offset").agg(F.max("attempt").alias("attempts"), F.min_by("policy", "seq").alias("first_policy"))


def fold_retries(events: DataFrame) -> DataFrame:
    """(stream, consumer, offset, retry_not_before_ms): the first schedule after the latest attempt, if not acknowledged."""
    own = events.filter(F.col("event_type").isin("delivery_attempt", "retry_schedule", "acknowledge"))
    latest = own.groupBy(*GROUP, "offset").agg(F.max(F.when(F.col("event_type") == "delivery_attempt", F.col("seq"))).alias("_last"), F.max(F.col("event_type") == "acknowledge").alias("_acked"))
    plans = own.filter(F.col("event_type") == "retry_schedule").join(latest, [*GROUP, "offset"]).filter((F.col("seq") > F.col("_last")) & ~F.col("_acked"))
    return plans.groupBy(*GROUP, "offset").agg(F.min_by("retry_not_before_ms", "seq").alias("retry_not_before_ms"))


def fold_cursor(events: DataFrame) -> DataFrame:
    """(stream, consumer, committed_offset, parked): the end of the gapless run from 0, and how many acks are past it."""
    acks = events.filter(F.col("event_type") == "acknowledge").select(*GROUP, "offset").distinct()
    # the run ends at the smallest acknowledged offset, or -1, that has no successor: an offset and its successor meet in one small group
    ends = F.explode(F.array(F.struct(F.col("offset").alias("at"), F.lit(True).alias("own")), F.struct((F.col("offset") - 1).alias("at"), F.lit(False).alias("own"))))
    marks = acks.select(*GROUP, ends.alias("e")).select(*GROUP, "e.at", "e.own").unionByName(acks.select(*GROUP).distinct().select("*", F.lit(-1).cast("long").alias("at"), F.lit(True).alias("own")))
    last = marks.groupBy(*GROUP, "at").agg(F.max("own").alias("_own"), F.max(~F.col("own")).alias("_next"))
    g = last.groupBy(*GROUP).agg(F.min(F.when(F.col("_own") & ~F.col("_next"), F.col("at") + 1)).cast("long").alias("committed_offset"), F.count_if(F.col("_own") & (F.col("at") >= 0)).alias("_n"))
    return g.select(*GROUP, "committed_offset", (F.col("_n") - F.col("committed_offset")).alias("parked"))


def policy_versions(events: DataFrame) -> DataFrame:
    """(stream, consumer, seq, version, changed): a configuration equal to the one before it changes nothing."""
    own = events.filter(F.col("event_type") == "policy_configured")
    w = Window.partitionBy(*GROUP).orderBy("seq")
    changed = own.withColumn("changed", ~F.col("policy").eqNullSafe(F.lag("policy").over(w)))
    return changed.withColumn("version", F.sum(F.col("changed").cast("int")).over(w)).select(*GROUP, "seq", "version", "changed")


def current_policy(events: DataFrame, consumers: DataFrame) -> DataFrame:
    """(stream, consumer, configured, ack_timeout_ms, max_attempts, retry_delay_ms): the last configuration, or the broker's default."""
    last = events.filter(F.col("event_type") == "policy_configured").groupBy(*GROUP).agg(F.max_by("policy", "seq").alias("_p"))
    j = consumers.select(*GROUP).distinct().join(last, GROUP, "left")
    return j.select(*GROUP, F.col("_p").isNotNull().alias("configured"), F.coalesce("_p.ack_timeout_ms", F.lit(ACK_TIMEOUT_MS)).cast("long").alias("ack_timeout_ms"), F.col("_p.max_attempts").alias("max_attempts"), F.coalesce("_p.retry_delay_ms", F.lit(0)).cast("long").alias("retry_delay_ms"))


def inspect_consumer(events: DataFrame, consumers: DataFrame) -> DataFrame:
    """current_policy with version: how often the configuration changed; 0 where the broker's default holds."""
    versions = policy_versions(events).groupBy(*[F.col(c).alias(f"_{c}") for c in GROUP]).agg(F.max("version").alias("_v"))
    j = current_policy(events, consumers).join(versions, (F.col("stream") == F.col("_stream")) & (F.col("consumer") == F.col("_consumer")), "left")
    return j.withColumn("version", F.coalesce("_v", F.lit(0)).cast("long")).drop("_stream", "_consumer", "_v")


def pinned_policy(events: DataFrame) -> DataFrame:
    """(stream, consumer, offset, max_attempts, source): a delivered offset keeps its first attempt's policy (pinned); one
    delivered without a policy has the consumer's current one, else the broker's own (legacy), which has no limit."""
    current = events.filter(F.col("event_type") == "policy_configured").groupBy(*[F.col(c).alias(f"_{c}") for c in GROUP]).agg(F.max_by("policy", "seq").alias("_p"))
    j = fold_attempts(events).join(current, (F.col("stream") == F.col("_stream")) & (F.col("consumer") == F.col("_consumer")), "left")
    source = F.when(F.col("first_policy").isNotNull(), "pinned").when(F.col("_p").isNotNull(), "current").otherwise("legacy")
    return j.select(*GROUP, "offset", F.coalesce("first_policy", "_p")["max_attempts"].alias("max_attempts"), source.alias("source"))


def valid_policy(timeout_ms: Column, attempts: Column, delay_ms: Column) -> Column:
    return (timeout_ms > 0) & (timeout_ms <= MAX_POLICY_MS) & (attempts > 0) & (delay_ms >= 0) & (delay_ms <= MAX_POLICY_MS)


def clock_floor(observed: DataFrame, span: int = SPAN) -> DataFrame:
    """(stream, seq, observed_ms, now_ms): time never runs back along a stream.

    Each stream is cut into spans of seq; the largest time before a span is a maximum over span maxima, so that
    no task sees a whole stream.
    """
    cut = observed.select("stream", "seq", "observed_ms", F.floor(F.col("seq") / span).alias("_span"))
    sums = cut.groupBy(F.col("stream").alias("_g"), F.col("_span").alias("_s")).agg(F.max("observed_ms").alias("_m"))
    before = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_g", "_s", F.max("_m").over(before).alias("_base"))
    inside = Window.partitionBy("stream", "_span").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    j = cut.withColumn("_in", F.max("observed_ms").over(inside)).join(bases, (F.col("stream") == F.col("_g")) & (F.col("_span") == F.col("_s")))
    return j.select("stream", "seq", "observed_ms", F.greatest("_in", "_base").alias("now_ms"))


def ack_outcomes(receipts: DataFrame, cursor: DataFrame, acked: DataFrame, leases: DataFrame, attempts: DataFrame, now_ms: Column, batch_rules: bool) -> DataFrame:
    """(pos, stream, offset, outcome) of receipts (pos, stream, offset, member, token), by the first rule that holds.

    batch_rules: an empty token is stale in a batch; alone it acknowledges a lease of its member.
    """
    live = leases.filter(F.col("deadline_ms") > now_ms).select(*PAIR, F.col("member").alias("_member"), F.col("delivery_token").alias("_token"))
    j = receipts.join(cursor, "stream", "left").join(acked.select(*PAIR).withColumn("_acked", F.lit(True)), PAIR, "left")
    j = j.join(live, PAIR, "left").join(attempts.select(*PAIR, F.lit(True).alias("_tried")), PAIR, "left")
    token = F.coalesce("token", F.lit(""))
    done = (F.col("offset") < F.col("committed_offset")) | F.col("_acked").isNotNull()
    leased = F.col("_member").isNotNull()
    ladder = F.when(done, "already_acknowledged")
    if batch_rules:
        ladder = ladder.when(token == "", "stale").when(leased & (F.col("_member") == F.col("member")) & (F.col("_token") == token), "acknowledged").when(leased, "stale").when(F.col("_tried").isNotNull(), "stale").otherwise("not_in_flight")
    else:
        ladder = ladder.when(~leased & (token != ""), "stale").when(~leased, "not_in_flight").when(F.col("_member") != F.col("member"), "stale").when((token != "") & (token != F.col("_token")), "stale").otherwise("acknowledged")
    return j.select("pos", *PAIR, ladder.alias("outcome"))


def valid_receipts(receipts: DataFrame, most: int = 1024) -> DataFrame:
    """(batch, valid): a vector has 1 to `most` receipts, and no offset of a stream twice."""
    g = receipts.groupBy("batch", "stream", "offset").agg(F.count(F.lit(1)).alias("_n")).groupBy("batch").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("d"))
    return g.select("batch", ((F.col("n") == F.col("d")) & (F.col("n") <= most)).alias("valid"))


def shared_members(candidates: DataFrame, members: int) -> DataFrame:
    """(stream, member, offset): one head-of-line record for each of `members` members of a stream, disjoint."""
    w = Window.partitionBy("stream").orderBy("offset")
    ranked = head_of_line(candidates).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= members)
    return ranked.select("stream", F.concat(F.lit("member-"), F.col("_r").cast("string")).alias("member"), "offset")


def consumer_lag(records: DataFrame, cursors: DataFrame) -> DataFrame:
    """(stream, consumer, lag, status): next offset less the durable cursor; unknown is not 0."""
    heads = records.groupBy("stream").agg((F.max("offset") + 1).alias("_head"), F.min("offset").alias("_floor"))
    j = cursors.join(heads, "stream", "left")
    known = F.col("_head").isNotNull() & (F.col("_head") >= F.col("committed_offset")) & (F.col("committed_offset") >= F.col("_floor"))
    return j.select("stream", "consumer", F.when(known, F.col("_head") - F.col("committed_offset")).alias("lag"), F.when(known, "known").otherwise("unknown").alias("status"))


#: Fixed table: error variant, with its stage where that matters, its kind, and what a client may do.
ERRORS = [
    ("InvalidName", "InvalidRequest", "Rejected"), ("InvalidRecord", "InvalidRequest", "Rejected"), ("InvalidBatchRequest", "InvalidRequest", "Rejected"),
    ("ConsumeBatchRecordTooLarge", "InvalidRequest", "Rejected"), ("ResponseTooLarge", "InvalidRequest", "Rejected"), ("StreamNotFound", "ResourceNotFound", "Rejected"),
    ("StreamNotReady", "ResourceNotReady", "Retryable"), ("AckNotInFlight", "DeliveryRejected", "Rejected"), ("StaleDelivery", "DeliveryRejected", "Rejected"),
    ("OutOfOrderAck", "DeliveryRejected", "Rejected"), ("RequestIdContentConflict", "RequestIdContentConflict", "Rejected"), ("HistoryUnavailable", "HistoryUnavailable", "Rejected"),
    ("Configuration", "Configuration", "Rejected"), ("CorruptRecord", "CorruptData", "Unknown"), ("Io", "Storage", "Unknown"), ("State", "State", "Unknown"), ("ConsumerStatePersistence:BeforeAppend", "State", "Retryable"),
    ("ConsumerStatePersistence:Append", "State", "Unknown"), ("ConsumerStatePersistence:Sync", "State", "Unknown"),
    ("LockPoisoned", "Internal", "Unknown"), ("NotLeader", "Routing", "Retryable"), ("Cluster", "Cluster", "Unknown"),
]


def error_outcomes(spark: SparkSession, failures: DataFrame) -> DataFrame:
    """(error_code, kind, outcome, failures): counts of failures (error_code) with kind and outcome."""
    known = spark.createDataFrame(ERRORS, "error_code string, kind string, outcome string")
    counted = failures.groupBy("error_code").agg(F.count(F.lit(1)).alias("failures"))
    return known.join(counted, "error_code", "left").select("error_code", "kind", "outcome", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))


#: Fixed table: failures of a client before or while it sent a request, and what it may do; any other is Unknown.
ATTEMPTS = {
    "Retryable": ["ConnectTimeout", "Connect", "ConnectionUnavailable"],
    "Rejected": [
        "RequestEncoding", "InvalidBatch", "InvalidResponseLimit", "InvalidSecurityConfiguration", "CredentialFile", "InvalidTrustRoots", "InvalidServerName",
        "HandshakeRefused", "InvalidHello", "AuthenticationRequired", "AuthenticationFailed", "SecurityMismatch", "RequestTooLarge",
    ],
}


def attempt_outcome(failure: Column, replied: Column, reply_outcome: Column) -> Column:
    """What a client may infer from an attempt: a reply says it itself, a client failure by its name; no failure and no reply is Unknown."""
    local = F.lit("Unknown")
    for outcome, names in ATTEMPTS.items():
        local = F.when(failure.isin(*names), outcome).otherwise(local)
    return F.when(replied, F.coalesce(reply_outcome, F.lit("Unknown"))).otherwise(F.coalesce(local, F.lit("Unknown")))


def poll_within(candidates: DataFrame, most_bytes: int, attempts: DataFrame | None = None, consumer: str = "consumer", token_seed: str = "seed") -> DataFrame:
    """(stream, offset, response_bytes, status): the next candidate of each stream, refused before any change if its reply's bound exceeds the limit."""
    first = next_per_stream(candidates).select(F.col("stream").alias("_s"), F.col("offset").alias("_o"))
    own = candidates.join(first, (F.col("stream") == F.col("_s")) & (F.col("offset") == F.col("_o")))
    sized = next_attempt(own, attempts).withColumn("response_bytes", poll_bytes(consumer, None, token_of(token_seed), F.col("attempt")))
    return sized.select("stream", "offset", "response_bytes", F.when(F.col("response_bytes") > most_bytes, "ResponseTooLarge").otherwise("ok").alias("status"))


def reply(kind: Column, ok: Column, error_outcome: Column) -> Column:
    """struct(outcome, stage) of a reply; kind is publish_item, poll_item, ack_item, change, read, error or shape_failure.

    ok: the item succeeded, or for poll_item has a token.
    """

    def is_(outcome: Column | str, stage: str) -> Column:
        return F.struct((F.lit(outcome) if isinstance(outcome, str) else outcome).alias("outcome"), F.lit(stage).alias("stage"))

    done, started = is_("Confirmed", "Durable"), is_(error_outcome, "ExecutionStarted")
    return (
        F.when(kind == "shape_failure", is_("Rejected", "Validated"))
        .when(kind == "error", started)
        .when(kind == "publish_item", F.when(ok, done).otherwise(started))
        .when(kind == "poll_item", F.when(ok, done).otherwise(is_("Confirmed", "Completed")))
        .when(kind == "ack_item", F.when(ok, done).otherwise(is_("Rejected", "ExecutionStarted")))
        .when(kind == "change", done)
        .otherwise(is_("Confirmed", "Completed"))
    )
