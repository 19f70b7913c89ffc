"""Sharding by jump consistent hashing (law `key`), with gapless slots inside each shard.

The shard of a row depends on its id and the number of shards alone; when one shard is appended,
only about 1/(n+1) of the rows move, all into the new shard. No ring table is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklog.llm.shared import number_rows, write_table

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of unsigned 64-bit keys (Lamping and Veach), for all keys at once."""
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = ahead[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = np.floor((at[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def jump_column(key: Column, shards: int) -> Column:
    """jump() of a long column, batch by batch."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard(key)


def assign(rows: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """Adds shard and grown_shard (with one shard more). A null key is one key like any other.

    The key is hashed first (XXH64), so that ids in a row don't meet in one shard.
    """
    hashed = F.xxhash64(F.col(key))
    return rows.withColumn("shard", jump_column(hashed, shards)).withColumn("grown_shard", jump_column(hashed, shards + 1))


def op5_sharding(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The contract's columns for every document; equal rows and null texts are kept as they are."""
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = write_table(assign(rows, "doc_id", shards), "shards")  # the texts are read once; what follows reads five numbers a row
    numbered = number_rows(placed, "shard", ["doc_id", "size", "text_crc32"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
