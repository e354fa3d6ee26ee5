"""Clock, rate, table-scale, size-category and checksum columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

CLOCK_HZ = 90_000.0
RATE_UNIT = 50


def timecode_seconds(h: Column, m: Column, s: Column, pictures: Column, rate: float) -> Column:
    """Seconds of an h:m:s:pictures time code at `rate` pictures a second."""
    return h * 3600 + m * 60 + s + pictures / F.lit(float(rate))


def clock_ticks(high_bit: Column, low_word: Column) -> Column:
    """33-bit clock reference from its high bit and low 32 bits."""
    return F.shiftleft(high_bit.cast("bigint"), 32) + low_word.cast("bigint")


def clock_seconds(ticks: Column) -> Column:
    return ticks / F.lit(CLOCK_HZ)


def mux_bytes_per_second(rate: Column) -> Column:
    return rate * RATE_UNIT


def quality_scale(quality: Column) -> Column:
    """Percentage scale of a 1-100 quality rating."""
    q = F.greatest(F.lit(1), F.least(F.lit(100), quality)).cast("bigint")
    scale = F.try_divide(F.lit(5000), q)
    return F.when(q < 50, F.floor(scale)).otherwise(200 - q * 2).cast("bigint")


def scaled_entry(base: Column, scale: Column, baseline: bool = True) -> Column:
    """Table entry at a scale, kept in 1..255 (baseline) or 1..32767."""
    raw = F.floor((base * scale + 50) / 100).cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(255 if baseline else 32767).cast("bigint"), raw))


def size_category(v: Column) -> Column:
    """Bits needed for the magnitude; 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v)))).cast("bigint")


@F.pandas_udf(LongType())
def byte_sum(content: pd.Series) -> pd.Series:
    """Sum of the bytes of a binary column."""
    return content.map(lambda b: None if b is None else int(np.frombuffer(b, dtype=np.uint8).sum(dtype=np.int64)))


def complement(total: Column, kind: str = "ones") -> Column:
    """A byte sum mod 256: plain, or its ones' or twos' complement."""
    folded = {"none": total, "ones": -total - 1, "twos": -total}[kind]
    return F.pmod(folded, F.lit(256)).cast("bigint")


def byte_checksum(content: Column, kind: str = "ones") -> Column:
    return complement(byte_sum(content), kind)
