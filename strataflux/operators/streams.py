"""Media packet and picture tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflux.functions.media import CLOCK_HZ, RATE_UNIT
from strataflux.operators.scan import WIDTH, FillBackward, FillForward, Previous, RunningSum, scan

# Stream ids.
RESERVED, PRIVATE_1, PADDING, PRIVATE_2 = 0xBC, 0xBD, 0xBE, 0xBF
AUDIO = (0xC0, 0xDF)
VIDEO = (0xE0, 0xEF)
CLOCK_WRAP = 1 << 33


def is_audio(sid: Column) -> Column:
    return sid.between(*AUDIO)


def is_video(sid: Column) -> Column:
    return sid.between(*VIDEO)


def declared_from(packets: DataFrame) -> DataFrame:
    """First header that declares each id: `(stream, stream_id, since)`, one row per pair."""
    return packets.where("kind = 'header'").groupBy("stream", "stream_id").agg(F.min("seq").alias("since"))


def with_declared(packets: DataFrame) -> DataFrame:
    """Packets with a flag: a header before them declares their id."""
    marked = packets.where("kind = 'packet'").join(declared_from(packets), ["stream", "stream_id"], "left")
    return marked.withColumn("declared", F.coalesce(F.col("since") < F.col("seq"), F.lit(False))).drop("since")


def packet_class(sid: Column, declared: Column) -> Column:
    return (
        F.when(declared & is_audio(sid), "audio").when(declared & is_video(sid), "video")
        .when(sid == PADDING, "padding").when(sid == RESERVED, "reserved")
        .when(sid == PRIVATE_1, "private_1").when(sid == PRIVATE_2, "private_2")
        .when(is_audio(sid), "undeclared_audio").when(is_video(sid), "undeclared_video").otherwise("unknown")
    )


def classify(packets: DataFrame) -> DataFrame:
    return with_declared(packets).withColumn("cls", packet_class(F.col("stream_id"), F.col("declared")))


def undeclared_streams(packets: DataFrame) -> DataFrame:
    """Audio and video packets whose id no earlier header declared; `adopted` marks those after the first."""
    media = is_audio(F.col("stream_id")) | is_video(F.col("stream_id"))
    loose = with_declared(packets).where(~F.col("declared") & media)
    first = loose.groupBy("stream", "stream_id").agg(F.min("seq").alias("first_seq"))
    return loose.join(first, ["stream", "stream_id"]).withColumn("adopted", F.col("seq") > F.col("first_seq")).drop("declared", "first_seq")


def stream_stats(packets: DataFrame) -> DataFrame:
    """Counts and bytes per stream; payload of skipped packets counts as system bytes."""
    sid = F.col("stream_id")
    header, packet = F.col("kind") == "header", F.col("kind") == "packet"
    audio, video = packet & is_audio(sid), packet & is_video(sid)
    kept = audio | video

    def total(cond, col):
        return F.sum(F.when(cond, col).otherwise(0))
    return packets.groupBy("stream").agg(
        F.count_if(header).alias("headers"), F.count_if(packet).alias("packets"),
        F.count_if(audio).alias("audio"), F.count_if(video).alias("video"),
        F.count_if(packet & (sid == PADDING)).alias("padding"), F.count_if(packet & (sid == RESERVED)).alias("reserved"),
        F.count_if(packet & (sid == PRIVATE_1)).alias("private_1"), F.count_if(packet & (sid == PRIVATE_2)).alias("private_2"),
        F.count_if(packet & (sid > VIDEO[1])).alias("unknown"),
        total(audio, F.col("payload_bytes")).alias("audio_bytes"), total(video, F.col("payload_bytes")).alias("video_bytes"),
        F.sum(F.col("hdr_bytes") + F.when(kept, 0).otherwise(F.col("payload_bytes"))).alias("system_bytes"),
    )


def first_stream(packets: DataFrame, low: int = VIDEO[0], high: int = VIDEO[1]) -> DataFrame:
    """Packets of the id in low..high that a stream shows first; all others are left out.

    The choice is one aggregated row per stream, found by partial aggregation.
    """
    wanted = packets.where(F.col("stream_id").between(low, high))
    chosen = wanted.groupBy("stream").agg(F.min_by("stream_id", "seq").alias("stream_id"))
    return wanted.join(chosen, ["stream", "stream_id"], "left_semi")


def reassemble(packets: DataFrame, low: int = VIDEO[0], high: int = VIDEO[1], width: int | None = WIDTH) -> DataFrame:
    """Payload pieces of the chosen stream with their byte offset in the joined output.

    The output of a hot stream is never gathered: a piece knows its place, and
    `sources.ranges.write_payload` writes ranges of pieces in order.
    """
    chosen = first_stream(packets, low, high).where("kind = 'packet'")
    placed = scan(chosen, ["stream"], ["seq"], {"_end": RunningSum(F.col("payload_bytes"))}, width=width)
    return placed.select("stream", "stream_id", "seq", (F.col("_end") - F.col("payload_bytes")).alias("start_byte"), "payload_bytes", "payload")


def clock_gaps(packets: DataFrame, width: int | None = WIDTH) -> DataFrame:
    """Ticks and seconds since the packet before, across the 33-bit wrap, and the rates in between."""
    done = scan(packets, ["stream"], ["seq"], {"_prev": Previous(F.col("scr_ticks"))}, width=width)
    gap = F.pmod(F.col("scr_ticks") - F.col("_prev"), F.lit(CLOCK_WRAP))
    seconds = gap / F.lit(CLOCK_HZ)
    return done.select(
        "stream", "seq", "scr_ticks", gap.alias("gap_ticks"), seconds.alias("gap_seconds"),
        F.try_divide(F.col("payload_bytes").cast("double"), seconds).alias("bytes_per_second"),
        (F.col("mux_rate") * RATE_UNIT).alias("declared_rate"))


# --- pictures ------------------------------------------------------------

def _is_reference(ptype: str = "ptype") -> Column:
    return F.col(ptype).isin("I", "P")


def reference_pictures(pictures: DataFrame, width: int | None = WIDTH) -> DataFrame:
    """`past_no` and `future_no`: a P picture refers to the last I/P before it, a B picture to the last two."""
    ref = F.when(_is_reference(), F.col("decode_no"))
    done = scan(
        pictures, ["stream"], ["decode_no"],
        {"_last": FillForward(ref, strict=True)},
        {"_before": FillForward(F.when(_is_reference(), F.col("_last")), strict=True)},
        width=width,
    )
    b, p = F.col("ptype") == "B", F.col("ptype") == "P"
    return done.select(
        "stream", "decode_no", "ptype", F.when(b, F.col("_before")).when(p, F.col("_last")).alias("past_no"),
        F.when(b, F.col("_last")).alias("future_no"))


def display_order(pictures: DataFrame, width: int | None = WIDTH) -> DataFrame:
    """Display numbers: a B picture shows at once, an I or P when the next I or P is done; the last one shows at the end."""
    ref = F.when(_is_reference(), F.col("decode_no"))
    timed = scan(pictures, ["stream"], ["decode_no"], {"_next": FillBackward(ref)}, width=width)
    shown = timed.withColumn("_at", F.when(_is_reference(), F.coalesce("_next", F.lit(1 << 62))).otherwise(F.col("decode_no")))
    done = scan(shown, ["stream"], ["_at"], {"display_no": RunningSum(F.lit(1).cast("bigint"))}, width=width)
    return done.select("stream", "decode_no", "ptype", "display_no")


def group_id(events: DataFrame, is_start: Column, part: str = "stream", order: str = "decode_no", out: str = "gop_no",
             width: int | None = WIDTH) -> DataFrame:
    """Running number of group starts."""
    marked = events.withColumn("_start", is_start.cast("bigint"))
    return scan(marked, [part], [order], {out: RunningSum(F.col("_start"))}, width=width).drop("_start")
