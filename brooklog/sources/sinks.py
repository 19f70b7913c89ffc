"""Sinks: snapshots that readers never see half written, JSON lines, bounded Markdown tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklog.operators.stats import bound_text

MOST_ROWS = 32


def write_snapshot(df: DataFrame, path: str) -> str:
    """Writes df to a new version folder, and then a marker that names it; returns the version."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/version={version}")
    spark = df.sparkSession
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/_versions")
    return version


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last version that was written whole."""
    last = spark.read.parquet(f"{path}/_versions").orderBy(F.desc("at")).first()["version"]
    return spark.read.parquet(f"{path}/version={last}")


def write_json(df: DataFrame, path: str, columns: list[str]) -> None:
    """The allow-listed columns as JSON lines."""
    df.select(*columns).write.mode("overwrite").json(path)


def append_ledger(df: DataFrame, path: str, at_ms) -> None:
    """Adds the rows, with the time at_ms of the run, to the ledger's JSON lines at path; a ledger is only ever added to."""
    df.withColumn("at_ms", at_ms).write.mode("append").json(path)


def markdown(df: DataFrame, columns: list[str], order: list[str]) -> str:
    """A Markdown table of the first MOST_ROWS rows; cells are bounded and escaped. The limit is the report's own."""
    cells = df.orderBy(*order).limit(MOST_ROWS).select(*[bound_text(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(r) + " |" for r in cells.collect()]
    return "\n".join(lines) + "\n"
