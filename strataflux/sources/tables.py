"""Star-schema loader and the working tables derived from it.

Every derived table is plain column arithmetic over one scan, so column pruning
and filters reach the parquet reader, and the same arithmetic can be written in
any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLOCK_HZ = 90_000
CLOCK_WRAP = 1 << 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, independent of the session zone."""
    return (
        F.unix_date(F.to_date(col)).cast("bigint") * F.lit(86_400_000_000)
        + F.hour(col).cast("bigint") * F.lit(3_600_000_000)
        + F.minute(col).cast("bigint") * F.lit(60_000_000)
        + (F.date_part(F.lit("SECOND"), col) * F.lit(1_000_000)).cast("bigint")
    )


def ticks(col: Column) -> Column:
    """33-bit 90 kHz clock of a timestamp, in whole-number arithmetic."""
    us = micros(col) * 9
    return ((us - us % 100).cast("decimal(20,0)") / 100).cast("bigint") % CLOCK_WRAP


def pixels(events: DataFrame) -> DataFrame:
    """64 x 64 images: `(img, y, x, r, g, b)`, one pixel per event."""
    return events.select(
        F.expr("event_id div 4096").alias("img"),
        F.expr("(event_id div 64) % 64").alias("y"),
        F.expr("event_id % 64").alias("x"),
        F.expr("cast(floor(value * 100) as bigint) % 256").alias("r"),
        F.expr("user_id % 256").alias("g"),
        F.expr("(event_id * 7919) % 256").alias("b"),
    )


def framed_pixels(events: DataFrame) -> DataFrame:
    """The same images with a plain border whose thickness depends on the image."""
    border = F.expr("x < 2 + img % 5 or y < 3 + img % 3 or x >= 61 or y >= 62 - img % 2")
    flat = F.col("img") % 2 * 40 + 60
    return pixels(events).select(
        "img", "y", "x",
        *[F.when(border, flat + shift).otherwise(F.col(c)).alias(c)
          for c, shift in (("r", 0), ("g", 5), ("b", 9))],
    )


def samples(embeddings: DataFrame) -> DataFrame:
    """`(sample_id, idx, amp)` from the vector table."""
    return embeddings.select(
        F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("idx", "amp")
    ).select("sample_id", F.col("idx").cast("bigint").alias("idx"), F.col("amp").cast("double").alias("amp"))


def coefs(embeddings: DataFrame) -> DataFrame:
    """8 x 8 coefficient blocks, 16 x 16 tiles per image and three components.

    `k` counts in zigzag order; `by`, `bx` place the block in its image.
    """
    s = samples(embeddings)
    return s.select(
        F.expr("sample_id div 768").alias("img"),
        F.expr("(sample_id div 256) % 3").alias("comp"),
        F.expr("(sample_id div 16) % 16").alias("by"),
        F.expr("sample_id % 16").alias("bx"),
        F.col("idx").alias("k"),
        F.expr("cast(floor(amp * 20) as bigint)").alias("coef"),
    )


def packets(events: DataFrame) -> DataFrame:
    """System-layer records per stream: headers declare an id, packets carry payload."""
    return events.select(
        F.expr("user_id % 8").alias("stream"),
        F.col("event_id").alias("seq"),
        F.expr("case when event_type = 'signup' then 'header' else 'packet' end").alias("kind"),
        F.expr(
            "case event_type"
            " when 'signup' then if(event_id % 2 = 0, 192 + user_id % 6, 224 + user_id % 3)"
            " when 'click' then 192 + event_id % 6"
            " when 'view' then 224 + event_id % 3"
            " when 'purchase' then 188 + event_id % 4"
            " else 240 + event_id % 16 end"
        ).alias("stream_id"),
        ticks(F.col("ts")).alias("scr_ticks"),
        F.expr("cast(floor(value * 100) as bigint)").alias("mux_rate"),
        F.lit(6).cast("bigint").alias("hdr_bytes"),
        F.length("props").cast("bigint").alias("payload_bytes"),
        F.col("props").alias("payload"),
    )


def pictures(events: DataFrame) -> DataFrame:
    """Coded pictures per stream; `decode_no` rises in decode order."""
    return events.select(
        F.expr("user_id % 8").alias("stream"),
        F.col("event_id").alias("decode_no"),
        F.expr("case event_type when 'signup' then 'I' when 'purchase' then 'P' else 'B' end").alias("ptype"),
    )


def deltas(lineitem: DataFrame) -> DataFrame:
    """Signed steps per part, with a reset flag, in a total order."""
    return lineitem.select(
        F.col("l_suppkey").alias("part"),
        F.col("l_orderkey").alias("ord1"),
        F.col("l_partkey").alias("ord2"),
        F.col("l_linenumber").cast("bigint").alias("ord3"),
        (F.col("l_quantity").cast("bigint") - 25).alias("delta"),
        (F.col("l_returnflag") == "R").alias("reset"),
    )


def step_bytes(events: DataFrame) -> DataFrame:
    """One byte per event, ordered inside each user."""
    return events.select(
        F.col("user_id").alias("part"),
        F.col("event_id").alias("pos"),
        F.expr("cast(floor(value * 100) as bigint) % 256").alias("b"),
    )
