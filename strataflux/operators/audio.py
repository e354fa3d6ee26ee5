"""Audio sample tables `(sample_id, idx, amp)`."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

# Timer divisor of each note.
NOTE_DIVISORS = {
    "C": 98, "C#": 93, "D": 89, "D#": 83, "E": 79, "F": 75, "F#": 71, "G": 68, "G#": 65, "A": 59, "A#": 55, "B": 53,
}
# Timer divisor of each whole kHz from 5 up.
KHZ_DIVISORS = [113, 91, 75, 63, 54, 47, 41, 36, 32, 28, 25, 22, 20, 18, 16, 14, 13, 11]
KHZ_LOW, KHZ_HIGH = 5, 22


def _pick(keys: list, values: list, col: Column) -> Column:
    pairs = [F.lit(v) for pair in zip(keys, values) for v in pair]
    return F.element_at(F.create_map(*pairs), col)


def rate_for_note(df: DataFrame, note: str = "note") -> DataFrame:
    """Divisor of a note name, upper or lower case; null for a name that is no note."""
    return df.withColumn("divisor", _pick(list(NOTE_DIVISORS), list(NOTE_DIVISORS.values()), F.upper(F.trim(note))).cast("bigint"))


def illegal_notes(df: DataFrame, note: str = "note") -> DataFrame:
    return rate_for_note(df, note).where("divisor is null").drop("divisor")


def divisor_for_khz(df: DataFrame, khz: str = "khz") -> DataFrame:
    """Divisor of a whole kHz rate; null outside 5..22."""
    k = F.col(khz).cast("int")
    return df.withColumn("divisor", F.when(k.between(KHZ_LOW, KHZ_HIGH), _pick(
        list(range(KHZ_LOW, KHZ_HIGH + 1)), KHZ_DIVISORS, k)).cast("bigint"))


def sample_copy(df: DataFrame, start: int, end: int, dest: int = 0) -> DataFrame:
    """Samples from start up to, but not with, end; at least one is copied."""
    stop = max(end, start + 1)
    return df.where((F.col("idx") >= start) & (F.col("idx") < stop)).withColumn("idx", F.col("idx") - start + dest)


def sample_lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("sample_id").agg((F.max("idx") + 1).alias("n"))


def sample_direction(df: DataFrame, backward: bool = False, loops: int = 1) -> DataFrame:
    """Play order: forward or backward, repeated `loops` times."""
    sized = df.join(sample_lengths(df), "sample_id")
    at = F.col("n") - 1 - F.col("idx") if backward else F.col("idx")
    return sized.withColumn("_loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1)))).select(
        "sample_id", (at + F.col("_loop") * F.col("n")).alias("idx"), "amp")


def resample(df: DataFrame, rate_from: str, rate_to: str) -> DataFrame:
    """Nearest-sample rate change; output i reads input floor(i * from / to).

    A sample knows the outputs that read it, so no grid is joined.
    """
    first = F.expr(f"(idx * {rate_to} + {rate_from} - 1) div {rate_from}")
    last = F.expr(f"((idx + 1) * {rate_to} + {rate_from} - 1) div {rate_from} - 1")
    places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return df.select("sample_id", F.explode(places).alias("idx"), "amp")


def sample_checks(requests: DataFrame, bank: DataFrame) -> DataFrame:
    """Rejected play requests `(req_id, sample_id, start, end, khz)` with the reason."""
    joined = requests.join(sample_lengths(bank), "sample_id", "left")
    reason = (
        F.when(F.col("n").isNull(), "sample not found").when(F.col("end") <= F.col("start"), "end not above start")
        .when(~F.col("khz").between(KHZ_LOW, KHZ_HIGH), "rate out of range")
    )
    return joined.withColumn("reason", reason).where("reason is not null").select("req_id", "sample_id", "reason")


def spectrum(df: DataFrame, frame: int) -> DataFrame:
    """Fourier terms and energy of each frame: `(sample_id, frame, k, re, im, energy)`.

    Own definition: plain discrete transform, k = 0 .. frame-1. A frame brings
    `frame` samples to one row; Arrow batches of frames are multiplied by the
    cosine and sine basis. A short last frame counts as padded with zeros.
    """
    terms = StructType([StructField(n, ArrayType(DoubleType())) for n in ("re", "im")])

    @F.pandas_udf(terms)
    def fourier(at: pd.Series, amp: pd.Series) -> pd.DataFrame:
        dense = np.zeros((len(at), frame))
        if len(at):
            rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
            dense[rows, np.concatenate(at.to_numpy())] = np.concatenate(amp.to_numpy())
        turn = np.outer(np.arange(frame), np.arange(frame)) % frame * (2 * np.pi / frame)
        return pd.DataFrame({"re": list(dense @ np.cos(turn)), "im": list(-dense @ np.sin(turn))})

    frames = df.groupBy("sample_id", F.expr(f"idx div {frame}").alias("frame")).agg(
        F.collect_list(F.struct(F.expr(f"cast(idx % {frame} as int)").alias("at"), F.col("amp").cast("double").alias("v"))).alias("_s"))
    done = frames.select("sample_id", "frame", fourier(F.col("_s.at"), F.col("_s.v")).alias("_f"))
    return done.select("sample_id", "frame", F.posexplode(F.arrays_zip("_f.re", "_f.im")).alias("k", "_t")).select(
        "sample_id", "frame", F.col("k").cast("bigint").alias("k"), F.col("_t.re").alias("re"), F.col("_t.im").alias("im"),
        (F.col("_t.re") * F.col("_t.re") + F.col("_t.im") * F.col("_t.im")).alias("energy"))
