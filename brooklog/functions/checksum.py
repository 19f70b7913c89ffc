"""CRC-32C (Castagnoli) of binary columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POLYNOMIAL = 0x82F63B78
_made: list[np.ndarray] = []


def table() -> np.ndarray:
    """The byte table, from the polynomial."""
    if not _made:
        t = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
        _made.append(t)
    return _made[0]


def crc32c(values: list[bytes | None]) -> list[int | None]:
    """Checksums of many values at once: one step for each byte place, over all values that reach it."""
    t = table()
    known = [v for v in values if v is not None]
    order = np.argsort([-len(v) for v in known], kind="stable")
    lengths = np.array([len(known[i]) for i in order], dtype=np.int64)
    crc = np.full(len(known), 0xFFFFFFFF, dtype=np.uint32)
    if len(known):
        data = np.frombuffer(b"".join(known[i] for i in order), dtype=np.uint8)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        for k in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -k, side="left"))
            crc[:n] = t[(crc[:n] ^ data[starts[:n] + k]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out = np.zeros(len(known), dtype=np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    found = iter(out.tolist())
    return [None if v is None else next(found) for v in values]


def crc32c_column(value: Column) -> Column:
    """CRC-32C of a binary column, as an unsigned number in a long; null stays null."""

    @F.pandas_udf("long")
    def checksum(values: pd.Series) -> pd.Series:
        return pd.Series(crc32c([None if v is None else bytes(v) for v in values]), dtype="Int64")

    return checksum(value)
