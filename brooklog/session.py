"""Session defaults that every entry point shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, or that only help; none is machine specific.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "brooklog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf overrides them (dots in names written as in Spark)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_table(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back; sort orders the files by ranges, so that row groups can be skipped."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brooklog/{name}-{uuid.uuid4().hex}"
    (df.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what spark.checkpoint.dir names.

    Where that is unset, a local master gets a temporary folder (tests) and a cluster a folder in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        made = "file://" + tempfile.mkdtemp(prefix="brooklog-")
    else:
        made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_brooklog_shared"
    spark.sparkContext.setCheckpointDir(made)
    return made
