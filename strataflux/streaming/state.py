"""Keyed stream state: what rows of later batches must know of earlier ones.

Each job groups a stream by its key and keeps a few numbers a key in the engine's
own state store, which is versioned with the checkpoint: a batch touches the keys
it has rows of, a restart goes on where the last one stopped, and a replayed batch
starts from the state of the one before it. Batches must arrive in order; rows of
one batch may come in any order. A key's rows of one batch are sorted in memory, so
`files_per_batch` bounds what a hot key takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from strataflux.operators.streams import AUDIO, VIDEO

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with columns and maps needs this provider; set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _gathered(rows: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


# Many small keys share a call and a state value: a call for each key costs more than its rows.
BUCKETS = 256


class _Levels(StatefulProcessor):
    """Value state of a bucket of parts: an Arrow table of their levels after the last row."""

    def __init__(self, part: list[str], order: str, delta: str):
        self.part, self.order, self.delta = part, order, delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getValueState("levels", "levels binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame, cols = _gathered(rows, self.order), [*self.part, self.delta]
        # the levels so far go in front, as one more delta of their parts
        before = [pa.ipc.open_stream(bytes(self.levels.get()[0])).read_all().to_pandas()] if self.levels.exists() else []
        steps = pd.concat([*before, frame[cols]], ignore_index=True)
        by = steps.groupby(self.part, dropna=False, sort=False)[self.delta]
        frame["level"] = by.cumsum().iloc[len(steps) - len(frame):].to_numpy()
        table = pa.Table.from_pandas(by.sum().astype("int64").reset_index(), preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.levels.update((sink.getvalue().to_pybytes(),))
        yield frame[[*self.part, self.order, self.delta, "level"]]

    def close(self) -> None:
        pass


def running_levels(deltas: DataFrame, part: list[str], order: str, delta: str) -> DataFrame:
    """The stream with `level`, the sum of a part's deltas up to the row, over all batches."""
    use_state_store(deltas.sparkSession)
    rows = deltas.select(*part, order, F.col(delta).cast("bigint").alias(delta))
    # parts with the same nulls meet, so that no whole number shares a column with a null
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in part])
    bucket = F.concat(nulls, F.lit(":"), F.pmod(F.xxhash64(*part), F.lit(BUCKETS)).cast("string"))
    return rows.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(
        _Levels(part, order, delta), StructType([*rows.schema.fields, StructField("level", LongType())]), "Append", "None")


class _FirstStream(StatefulProcessor):
    """Map state: first header and first packet of each id. Value state: the first video id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "stream_id bigint", "header_seq bigint, packet_seq bigint")
        self.video = handle.getValueState("video", "stream_id bigint, seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = _gathered(rows, "seq")
        header = frame["kind"] == "header"
        first = {True: frame[header].groupby("stream_id")["seq"].min(), False: frame[frame["kind"] == "packet"].groupby("stream_id")["seq"].min()}
        headers, packets = {}, {}
        for sid in map(int, frame["stream_id"].dropna().unique()):
            before = self.ids.getValue((sid,)) if self.ids.containsKey((sid,)) else (None, None)
            headers[sid], packets[sid] = (old if old is not None else (int(new[sid]) if sid in new.index else None) for old, new in zip(before, (first[True], first[False])))
            if (headers[sid], packets[sid]) != tuple(before):
                self.ids.updateValue((sid,), (headers[sid], packets[sid]))
        seen = frame[frame["stream_id"].between(*VIDEO)]
        if len(seen) and not self.video.exists():
            self.video.update((int(seen["stream_id"].iloc[0]), int(seen["seq"].iloc[0])))
        video = self.video.get()[0] if self.video.exists() else None
        out = frame[frame["kind"] == "packet"].drop(columns="kind").reset_index(drop=True)
        sid = out["stream_id"].astype("int64")
        declared = sid.map(headers).astype("float64") < out["seq"]
        out["declared"] = declared
        out["adopted"] = sid.between(AUDIO[0], VIDEO[1]) & ~declared & (out["seq"] > sid.map(packets).astype("float64"))
        out["chosen"] = sid == video if video is not None else np.zeros(len(out), bool)
        yield out

    def close(self) -> None:
        pass


def first_streams(packets: DataFrame) -> DataFrame:
    """Packets as they come: declared by a header before, adopted (undeclared, not the first of its id), of the first video id of their stream."""
    use_state_store(packets.sparkSession)
    rows = packets.select("stream", "kind", "stream_id", "seq", "payload_bytes")
    out = "stream bigint, stream_id bigint, seq bigint, payload_bytes bigint, declared boolean, adopted boolean, chosen boolean"
    return rows.groupBy("stream").transformWithStateInPandas(_FirstStream(), out, "Append", "None")


class _Lateness(StatefulProcessor):
    """Value state: rows on time and late so far, so that both are counted apart for each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "on_time bigint, late bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = _gathered(rows, "at_us")
        late = frame["at_us"] < timerValues.getCurrentWatermarkInMs() * 1000
        on_time, behind = self.counts.get() if self.counts.exists() else (0, 0)
        frame["late"] = late
        frame["late_so_far"] = behind + late.cumsum()
        self.counts.update((int(on_time + (~late).sum()), int(behind + late.sum())))
        yield frame

    def close(self) -> None:
        pass


def late_flags(events: DataFrame, delay: str) -> DataFrame:
    """The stream (stream, seq, at_us) with `late`: before the watermark that its batch starts with, `delay` behind the newest row of earlier batches.

    `late_so_far` counts a key's late rows, older ones of a batch first. The
    watermark's own column stays out of the grouping, or the engine would drop
    late rows before they can be told apart.
    """
    use_state_store(events.sparkSession)
    rows = events.withColumn("_at", F.timestamp_micros("at_us")).withWatermark("_at", delay).select("stream", "seq", "at_us")
    return rows.groupBy("stream").transformWithStateInPandas(_Lateness(), "stream bigint, seq bigint, at_us bigint, late boolean, late_so_far bigint", "Append", "EventTime")
