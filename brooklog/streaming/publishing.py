"""Publishing from a stream: each micro-batch is appended once, with dense offsets and request-id outcomes.

A batch is written to its own partition, batch=<id>, which a repeated batch overwrites; only earlier
partitions count as history. So a restart neither loses nor repeats a record. All work is DataFrame operators.

Inside its partition a batch is cut into buckets by the request id's hash, and a table of heads beside the log has every stream's
next offset after each batch. So a batch reads the last heads and, of the log, the buckets that its own ids fall into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brooklog.operators.log import running_count

COLUMNS = ["seq", "stream", "key", "payload", "request_id", "outcome", "offset"]
#: Buckets of request ids in a batch's partition.
BUCKETS = 64


def bucket() -> Column:
    """The bucket of a request, by stream and id; requests without an id are in bucket 0 and never looked up."""
    return F.when(F.col("request_id").isNull(), 0).otherwise(F.pmod(F.xxhash64("stream", "request_id"), F.lit(BUCKETS))).cast("int")


def batches(spark: SparkSession, path: str, before: int) -> list[int]:
    """Ids below `before` of the batches written at path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    return sorted(n for n in (int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")) if n < before)


def history(spark: SparkSession, path: str, before: int, buckets: list[int] | None = None) -> DataFrame | None:
    """What earlier batches wrote, or the given buckets of it; None if there is nothing."""
    if not batches(spark, path, before):
        return None
    rows = spark.read.parquet(path).filter(F.col("batch") < before)
    return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))


def heads(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """(stream, next_offset) after the last batch below `before`; None at the start."""
    found = batches(spark, f"{path}-heads", before)
    return spark.read.schema("stream string, next_offset long").parquet(f"{path}-heads/batch={found[-1]}") if found else None


def publish_onto(requests: DataFrame, old: DataFrame | None, ends: DataFrame | None = None) -> DataFrame:
    """Outcomes of a batch's requests, after the history `old` of the same columns; as log.publish over both.

    With ends (stream, next_offset), old needs to have only the rows whose ids come in requests.
    """
    new = requests.select("seq", "stream", F.when(F.col("key") != "", F.col("key")).alias("key"), "payload", "request_id")
    ids = F.when(F.col("request_id").isNotNull(), F.col("request_id")).otherwise(F.concat(F.lit("\u0000"), F.col("seq").cast("string")))
    new = new.withColumn("_id", ids)
    if old is None:
        old = new.limit(0).withColumn("outcome", F.lit("")).withColumn("offset", F.lit(0).cast("long"))
    kept = old.filter(F.col("outcome") == "appended")
    base = kept.groupBy(F.col("stream").alias("_bs")).agg((F.max("offset") + 1).alias("_base")) if ends is None else ends.select(F.col("stream").alias("_bs"), F.col("next_offset").alias("_base"))
    known = kept.filter(F.col("request_id").isNotNull()).select(F.col("stream").alias("_os"), F.col("request_id").alias("_oid"), F.struct("offset", "key", "payload").alias("_old"))
    joined = new.join(known, (F.col("stream") == F.col("_os")) & (F.col("_id") == F.col("_oid")), "left")
    first = F.first(F.struct("seq", "key", "payload")).over(Window.partitionBy("stream", "_id").orderBy("seq"))
    marked = joined.withColumn("_first", first)
    seen = F.col("_old").isNotNull()
    same = F.when(seen, F.col("_old.key").eqNullSafe(F.col("key")) & F.col("_old.payload").eqNullSafe(F.col("payload"))).otherwise(F.col("_first.key").eqNullSafe(F.col("key")) & F.col("_first.payload").eqNullSafe(F.col("payload")))
    marked = marked.withColumn("outcome", F.when(~seen & (F.col("_first.seq") == F.col("seq")), "appended").when(same, "duplicate").otherwise("conflict"))
    counted = running_count(marked, "stream", "seq", "_next", F.col("outcome") == "appended").join(base, F.col("stream") == F.col("_bs"), "left")
    counted = counted.withColumn("_own", F.coalesce("_base", F.lit(0)) + F.col("_next"))
    fresh = counted.filter(F.col("outcome") == "appended").select(F.col("seq").alias("_aseq"), F.col("_own").alias("_aoff"))
    out = counted.join(fresh, F.col("_first.seq") == F.col("_aseq"), "left")
    offset = F.when(F.col("outcome") == "appended", F.col("_own")).when(F.col("outcome") == "duplicate", F.coalesce("_old.offset", "_aoff"))
    return out.withColumn("offset", offset.cast("long")).select(*COLUMNS)


def start(requests: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts publishing a streaming frame (seq, stream, key, payload, request_id) onto the log at path."""

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        asked = [r[0] for r in batch.filter(F.col("request_id").isNotNull()).select(bucket().alias("b")).distinct().collect()]  # BUCKETS at most
        ends = heads(spark, path, batch_id)
        out = publish_onto(batch, history(spark, path, batch_id, asked), ends)
        out.withColumn("bucket", bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")
        own = spark.read.parquet(f"{path}/batch={batch_id}").filter(F.col("outcome") == "appended").groupBy("stream").agg((F.max("offset") + 1).alias("next_offset"))
        both = own if ends is None else own.unionByName(ends).groupBy("stream").agg(F.max("next_offset").alias("next_offset"))
        both.write.mode("overwrite").parquet(f"{path}-heads/batch={batch_id}")

    return requests.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
