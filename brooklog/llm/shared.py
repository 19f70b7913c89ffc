"""What the training-data operators share: whole-table reads, shared folders, gapless numbering."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brooklog.session import shared_dir, table


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table; Spark's reader opens the path, so any Hadoop store works."""
    return table(spark, sf_dir, name)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back, which cuts its lineage.

    A lost executor costs only the tasks it ran, since later stages read the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brooklog/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that Python takes at once, and the most rows of an Arrow batch, a session setting that map_arrow lowers to this.
ROWS_AT_ONCE, ARROW_ROWS, ARROW_ROWS_SETTING = 512, 1024, "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int | None = ROWS_AT_ONCE) -> DataFrame:
    """df.mapInArrow(f, schema) with bounded memory: f gets slices of `rows` rows, and a worker gives memory back after each task.

    Workers are reused, so what one task leaves allocated would be held through all later stages of an executor.
    """

    # whole texts in the default of 10,000 rows are large buffers outside the executors' heap
    session = df.sparkSession
    if int(session.conf.get(ARROW_ROWS_SETTING)) > ARROW_ROWS:
        session.conf.set(ARROW_ROWS_SETTING, ARROW_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches if rows is None else (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)))
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Returns this process's free memory to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes up to which the smaller side of a join is broadcast, counted first.
MOST_BYTES = 32 << 20
#: Rows of a key that make it hot, as a share of all rows and at least; parts that a hot key's rows are dealt into.
HOT_SHARE, HOT_LEAST, SALTS = 200, 1000, 32


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, broadcast if its counted rows of about row_bytes (as a hash table takes them) fit MOST_BYTES; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= MOST_BYTES else df


def join_spread(rows: DataFrame, other: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """rows joined with other (unique in key, a column of either); sizes (key, n) counts the rows of each key.

    Rows of the few hot keys are dealt over SALTS parts, to each of which their row of other is copied.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in sizes.filter(F.col("n") > max(HOT_LEAST, total // HOT_SHARE)).select(key).collect()]  # HOT_SHARE keys at most
    if not hot:
        return rows.join(other, key)
    dealt = rows.withColumn("_salt", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(other.withColumn("_salt", F.explode(salts)), [key, "_salt"]).drop("_salt")


def id_text(column: str) -> Column:
    """The id as text; a null id is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text, mod 3, is 1."""
    return (F.crc32(id_text(id_column)) % 3) == 1


#: As many group sizes as bounded_sample sends to the driver.
FEW_GROUPS = 1000


def bounded_sample(df: DataFrame, keys: list[str], bound: int, by: str | None = None) -> DataFrame:
    """About bound rows of df, and at most twice as many, or of each value of column by, picked by a hash of the keys.

    All rows where there are no more than bound. Needs one count over the key columns, no sort. The
    values of by must not be null.
    """
    if by is None:
        n = df.count()
        return df if n <= bound else df.filter(F.pmod(F.xxhash64(*keys), F.lit(n)) < bound).limit(2 * bound)  # a repeated key comes whole
    counts = df.groupBy(by).count().filter(F.col("count") > bound).limit(FEW_GROUPS + 1).collect()
    if len(counts) > FEW_GROUPS:  # too many large groups for a literal: a join, at the price of a shuffle
        sizes = df.groupBy(by).count().withColumnRenamed(by, "_by").withColumnRenamed("count", "_n")
        joined = df.join(sizes, F.col(by) == F.col("_by"))
        return joined.filter(F.pmod(F.xxhash64(*keys), F.col("_n")) < bound).drop("_by", "_n")
    if not counts:
        return df
    large = F.create_map(*[F.lit(x) for r in counts for x in (r[0], r["count"])])
    return df.filter(F.pmod(F.xxhash64(*keys), F.coalesce(large[F.col(by)], F.lit(1))) < bound)


#: Rows in a numbering bucket: at most, and at least unless a group has fewer.
BUCKET_MOST, BUCKET_LEAST = 20_000, 500


def number_rows(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Adds out: 0, 1, 2, ... without gaps in each value of group (not null), of which there are few.

    A group is spread over hash buckets, as many as its own count asks for; each bucket is numbered by itself
    and starts at the sum of the counts of the buckets before it. No task sees a large group whole, so a
    group may hold any share of all rows. The order inside a group is by bucket, then by the order
    columns; rows equal in all of them may swap places, which changes no (row, number) multiset.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_bucket = max(BUCKET_LEAST, min(BUCKET_MOST, df.count() // (4 * parts)))
    sizes = df.groupBy(F.col(group).alias("_s")).agg(F.ceil(F.count(F.lit(1)) / per_bucket).alias("_buckets"))
    spread = df.join(F.broadcast(sizes) if sizes.count() <= FEW_GROUPS * 10 else sizes, F.col(group) == F.col("_s")).drop("_s")
    spread = spread.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_buckets")).cast("int")).drop("_buckets")
    counts = spread.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_g", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = spread.withColumn("_rank", F.row_number().over(inside))
    joined = ranked.join(bases, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(out, (F.col("_base") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_g", "_b", "_base", "_rank")
