"""The driver's tables in the shapes that the operators take.

events become records of a stream log: one stream for each event type, a dense offset in order of
event_id, the user as key. Delivery state (acknowledged, leased, waiting) is derived from event_id by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklog.operators.log import assign_offsets
from brooklog.session import shared_table, table


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish requests in order of seq; offsets aren't assigned yet."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("stream"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("payload"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("published_at_ms"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("request_id"),
        "value",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with dense offsets."""
    return assign_offsets(requests(spark, sf_dir), "stream", "seq", "offset")


_stored: dict[tuple[str, str], DataFrame] = {}


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of records, written once in a session and sorted by stream and offset; point and page reads skip its row groups."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _stored:
        _stored[at] = shared_table(records(spark, sf_dir), "log", ["stream", "offset"])
    return _stored[at]


def acked(rec: DataFrame) -> DataFrame:
    return rec.filter(F.col("seq") % 7 != 0).select("stream", "offset")


def leases(rec: DataFrame) -> DataFrame:
    """Live leases of a tenth-like share of records, with deadline and token."""
    own = rec.filter(F.col("seq") % 17 == 0)
    return own.select(
        "stream", "offset", "key",
        F.concat(F.lit("m"), (F.col("seq") % 3).cast("string")).alias("member"),
        (F.col("published_at_ms") + 30000).alias("deadline_ms"),
        F.concat(F.lit("seed-"), F.lower(F.hex("offset"))).alias("delivery_token"),
    )


def retries(rec: DataFrame) -> DataFrame:
    """Records that wait for a retry delay to pass."""
    own = rec.filter((F.col("seq") % 23 == 0) & (F.col("seq") % 17 != 0))
    return own.select("stream", "offset", "key", (F.col("published_at_ms") + 60000).alias("retry_not_before_ms"))


def attempts(rec: DataFrame) -> DataFrame:
    return rec.filter(F.col("seq") % 5 > 0).select("stream", "offset", (F.col("seq") % 5).cast("int").alias("attempts"))


def consumer_events(rec: DataFrame) -> DataFrame:
    """A consumer's journal made of events: the stream is always 'log', the consumer the user's last digit."""
    kind = F.create_map(*[F.lit(x) for x in ("view", "delivery_attempt", "error", "retry_schedule", "purchase", "acknowledge", "signup", "policy_configured", "click", "delivery_attempt")])
    return rec.select(
        F.lit("log").alias("stream"),
        (F.col("key").cast("long") % 10).cast("string").alias("consumer"),
        "seq",
        kind[F.col("stream")].alias("event_type"),
        (F.col("seq") * 7 % 97).alias("offset"),
        (F.col("seq") % 4 + 1).cast("int").alias("attempt"),
        (F.col("published_at_ms") + 1000).alias("retry_not_before_ms"),
        F.struct((F.col("seq") % 3 * 10000 + 10000).alias("ack_timeout_ms"), (F.col("seq") % 4 + 2).cast("int").alias("max_attempts"), (F.col("seq") % 2 * 500).alias("retry_delay_ms")).alias("policy"),
    )


def scenario_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated measurements: a scenario is (return flag, line status), a repetition the supplier mod 7."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("scenario"),
        (F.col("l_suppkey") % 7).cast("int").alias("repetition"),
        F.col("l_extendedprice").alias("latency_us"),
        F.col("l_quantity").alias("messages"),
        F.col("l_discount").alias("cpu_seconds"),
        F.col("l_tax").alias("elapsed_share"),
        F.year("l_shipdate").alias("year"),
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a history: each month is a run, each order priority a series."""
    o = table(spark, sf_dir, "orders")
    grouped = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run"), F.col("o_orderpriority").alias("series"))
    return grouped.agg(F.round(F.avg("o_totalprice"), 4).alias("value"), F.count(F.lit(1)).alias("samples"))
