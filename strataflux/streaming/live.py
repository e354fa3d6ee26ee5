"""Structured Streaming jobs over packets, pictures and vector files.

Windowed counts, sessions and duplicates use the engine's own state; what else rows
must know of earlier batches is in `state`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from strataflux.operators import conformance, evaluate
from strataflux.sources import vectors
from strataflux.streaming.state import use_state_store


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def event_time(ticks: Column) -> Column:
    """Timestamp of a 90 kHz clock reference."""
    return F.timestamp_micros((ticks * 100 / 9).cast("bigint"))


def packet_windows(packets: DataFrame, watermark: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and payload bytes per stream and clock window; needs an `at` timestamp column."""
    return (
        packets.withWatermark("at", watermark)
        .groupBy(F.window("at", size, slide), "stream")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("payload_bytes"))
        .select("stream", F.unix_timestamp("window.start").alias("from_s"), F.unix_timestamp("window.end").alias("to_s"), "n", "payload_bytes")
    )


def picture_sessions(pictures: DataFrame, watermark: str, gap: str) -> DataFrame:
    """Picture groups per stream, closed by a gap in time."""
    return (
        pictures.withWatermark("at", watermark)
        .groupBy("stream", F.session_window("at", gap))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ptype") == "I").alias("n_i"))
        .select("stream", F.unix_micros("session_window.start").alias("from_us"), F.unix_micros("session_window.end").alias("to_us"), "n", "n_i")
    )


def closing_row(events: DataFrame, at: str, years: int = 10) -> DataFrame:
    """One row, null but for a time long after all others: delivered last, it lets the watermark pass every window and session."""
    last = events.agg((F.max(at) + F.make_interval(F.lit(years))).cast(events.schema[at].dataType).alias(at))
    return last.select(*[F.col(at) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])


def append_to(df: DataFrame, out: str, checkpoint: str, small_batches: bool = False) -> StreamingQuery:
    """Append finished rows to parquet, taking what is there and then stopping.

    Every batch loads and commits each partition of the state, touched or not. A
    stream of many small batches has no more partitions than the session has
    cores; the checkpoint keeps the number that its first start had.
    """
    spark, count = df.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(count)
    if small_batches:
        spark.conf.set(count, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:  # the query has a copy of the settings from here on
        return (
            df.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(count, before)


# --- sinks by batch id -----------------------------------------------------

def _each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of arriving text files with their place."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select(
        F.col("_metadata.file_path").alias("suite"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("raw"))


VERDICT = "suite string, line_no bigint, op string, exp1 string, verdict string"


def judge_files(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Check vector files as they arrive: VERDICT rows below `out`, a folder for each batch id, so a replayed batch writes its own rows again."""
    def work(batch: DataFrame, batch_id: int) -> None:
        ops = conformance.catalogue(batch.sparkSession)
        numbered = vectors.number_lines(batch)
        parsed, _ = vectors.parse_vectors(vectors.classify_lines(numbered))
        bound, _ = conformance.bind_ops(parsed, ops)
        verdicts = evaluate.run_vectors(bound)
        verdicts.select("suite", F.col("line_no").cast("bigint").alias("line_no"), "op", "exp1", "verdict").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return _each_batch(lines, work, checkpoint)


def once_only(spark: SparkSession, judged: str) -> DataFrame:
    """Stream of the verdicts below `judged`, the first of each file name, line, operation and expectation over all batches.

    A file that is delivered again, under the same name in another folder or
    another batch, adds nothing: its lines are in the engine's duplicate state,
    on disk, as it holds every line that ever came.
    """
    use_state_store(spark)
    rows = file_stream(spark, f"{judged}/*", StructType.fromDDL(VERDICT))
    return rows.withColumn("name", F.regexp_extract("suite", "[^/]+$", 0)).dropDuplicates(["name", "line_no", "op", "exp1"])


def stream_conformance(lines: DataFrame, judged: str, out: str, checkpoint: str) -> None:
    """Judge what has arrived and add the new verdicts to `out`; call it again, with the same folders, when more has come."""
    judge_files(lines, judged, f"{checkpoint}/judged").awaitTermination()
    append_to(once_only(lines.sparkSession, judged), out, f"{checkpoint}/once").awaitTermination()


def distinct_within(df: DataFrame, keys: list[str], watermark: str) -> DataFrame:
    """First row of each key within the watermark's reach; needs an `at` timestamp column."""
    return df.withWatermark("at", watermark).dropDuplicatesWithinWatermark(keys)
