"""Binary files in byte ranges, and payload files in byte order.

`byte_ranges` reads a file of any size in many tasks: one row for each range of
`chunk_bytes`, with `overlap_bytes` of what follows it. `packets` walks such ranges
and finds the records that one walk over the whole file finds. Where a record
begins depends on the lengths of all records before it, so a range cannot know
alone which of its start codes are real. It first says, for every place a walk may
enter it, where that walk leaves it; a walk enters within OVERLAP_BYTES of the start
or passes the range by, so those step functions are short. Put together in file order they give the true entry of each
range, and every range is then walked from there.

`payload_files` writes the pieces of `streams.reassemble` as raw bytes. A task
writes one file and tells, when the job commits, which bytes of which stream it
holds; the index of all of them is written last, so a reader sees only files of
committed tasks.

Both open files through pyarrow: local paths and the stores it knows.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strataflux.session import scratch_path
# by name: a function that names a module takes all of it along to the tasks
from strataflux.sources.binaries import PACKET_SCHEMA, PREFIX, record_at

CHUNK_BYTES = 8 << 20
OVERLAP_BYTES = 66_000  # a record and the next prefix: 6 + 65,535 + 3 at most
INDEX = "index.json"
PIECE_BYTES = 4 << 20


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


# --- reading ------------------------------------------------------------------


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    size: int

    def __post_init__(self):
        super().__init__((self.path, self.start))


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.ending = options["path"], options.get("ending", "")
        self.chunk, self.overlap = int(options.get("chunk_bytes", CHUNK_BYTES)), int(options.get("overlap_bytes", OVERLAP_BYTES))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _files(self.path)
        found = store.get_file_info(base)
        infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.endswith(self.ending) and not i.base_name.startswith(("_", ".")))
        return [_Range(p, at, size) for p, size in files for at in range(0, max(1, size), self.chunk)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        store, _ = _files(self.path)
        with store.open_input_file(partition.path) as source:
            n = min(self.chunk + self.overlap, partition.size - partition.start)
            yield partition.path, partition.start, min(partition.start + self.chunk, partition.size), source.read_at(n, partition.start)


class ByteRanges(DataSource):
    """Options: path (a file or a folder), ending (of file names), chunk_bytes, overlap_bytes."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, start bigint, stop bigint, piece binary"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


def read_ranges(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    reader = spark.read.format("byte_ranges")
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load(path)


# --- packets --------------------------------------------------------------------

ENDED = 1 << 62  # where a walk goes that has met the end code or the end of the file


def _hits(piece: bytes, n: int) -> list[int]:
    """Places of start codes that begin in the first n bytes."""
    found, at = [], piece.find(PREFIX)
    while 0 <= at < n:
        found.append(at)
        at = piece.find(PREFIX, at + 1)
    return found


def _exits(piece: bytes, start: int, stop: int) -> list[tuple[int, int, int]]:
    """(last entry, exit, sequence numbers used): a walk that enters after the step before and up to `last entry` leaves at `exit`."""
    hits = _hits(piece, stop - start)
    exits, counts = [0] * len(hits), [0] * len(hits)
    for i in range(len(hits) - 1, -1, -1):
        record = record_at(piece, hits[i])
        if record is None:
            exits[i] = ENDED
            continue
        rows, after = record
        later = bisect_left(hits, after) if after < stop - start else len(hits)
        exits[i] = exits[later] if later < len(hits) else start + after
        counts[i] = len(rows) + (counts[later] if later < len(hits) else 0)
    steps: list[tuple[int, int, int]] = []
    for hit, leave, n in zip(hits, exits, counts):
        if steps and steps[-1][1:] == (leave, n):
            steps.pop()
        steps.append((start + hit, leave, n))
        if hit >= OVERLAP_BYTES:  # no record reaches further into a range
            break
    return steps


def _entries(ranges: pd.DataFrame) -> pd.DataFrame:
    """The true entry and first sequence number of each range of one file."""
    at = seq = 0
    out = []
    for _, row in ranges.sort_values("start").iterrows():
        out.append((row["path"], row["start"], at, seq))
        step = next((s for s in row["steps"] if at <= s["upto"]), None)
        if step is not None:
            at, seq = step["leave"], seq + step["n"]
    return pd.DataFrame(out, columns=["path", "start", "entry", "seq"])


def packets(ranges: DataFrame) -> DataFrame:
    """The records of `binaries.packet_records`, from byte ranges; `stream` is the path."""
    steps = "steps array<struct<upto:bigint,leave:bigint,n:bigint>>"

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, piece in zip(*[c.to_pylist() for c in batch.columns]):
                found = [{"upto": u, "leave": e, "n": n} for u, e, n in _exits(piece, start, stop)]
                kind = pa.list_(pa.struct([("upto", pa.int64()), ("leave", pa.int64()), ("n", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start]), pa.array([found], kind)], names=["path", "start", "steps"])

    names = [f.split()[0] for f in PACKET_SCHEMA.split(", ")]
    kinds = [pa.string() if "string" in f else pa.int64() for f in PACKET_SCHEMA.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, piece, entry, seq in zip(*[c.to_pylist() for c in batch.columns]):
                rows, at = [], entry
                while at < stop:
                    hit = piece.find(PREFIX, max(0, at - start))
                    record = record_at(piece, hit) if 0 <= hit < stop - start else None
                    if record is None:
                        break
                    for n, (kind, sid, ticks, rate, head, size) in enumerate(record[0]):
                        rows.append((path, seq + n, start + hit, kind, sid, ticks, rate, head, size, start + hit - at if n == 0 else 0))
                    seq, at = seq + len(record[0]), start + record[1]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    found = ranges.select("path", "start", "stop", "piece").mapInArrow(summaries, f"path string, start bigint, {steps}")
    # one row for a range: a file of a terabyte has about 130,000
    entered = found.groupBy("path").applyInPandas(_entries, "path string, start bigint, entry bigint, seq bigint")
    path = scratch_path(ranges.sparkSession, "range-entries")
    entered.write.parquet(path)  # so that the join knows its size and need not shuffle the pieces
    entered = ranges.sparkSession.read.schema(entered.schema).parquet(path)
    return ranges.join(entered, ["path", "start"]).select("path", "start", "stop", "piece", "entry", "seq").mapInArrow(walk, PACKET_SCHEMA)


# --- writing --------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    segments: list  # (stream, start byte, bytes, file, place in the file)


class _PayloadWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = _files(self.path)
        store.create_dir(base, recursive=True)
        name, segments, at, out = f"payload-{uuid.uuid4().hex}.bin", [], 0, None
        try:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("stream", "start_byte", "payload")]
                for stream, start, payload in zip(*columns):
                    if not payload:
                        continue
                    out = out or store.open_output_stream(f"{base}/{name}")
                    last = segments[-1] if segments else None
                    if last and last[0] == stream and last[1] + last[2] == start:
                        last[2] += len(payload)
                    else:
                        segments.append([stream, start, len(payload), name, at])
                    out.write(payload)
                    at += len(payload)
        finally:
            if out:
                out.close()
        return _Written(segments)

    def commit(self, messages) -> None:
        store, base = _files(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{INDEX}") as out:  # a line for each contiguous stretch: about one a task and stream
            for message in messages:
                for segment in message.segments if message else []:
                    out.write((json.dumps(dict(zip(("stream", "start_byte", "bytes", "file", "place"), segment))) + "\n").encode())

    def abort(self, messages) -> None:
        pass  # without an index no file is read


class PayloadFiles(DataSource):
    """Sink of (stream, start_byte, payload) rows; the option path names a new folder."""

    @classmethod
    def name(cls) -> str:
        return "payload_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PayloadWriter(self.options["path"])


def write_payload(pieces: DataFrame, path: str) -> None:
    """Pieces of any number of streams as raw bytes, in stream and byte order, with an index."""
    pieces.sparkSession.dataSource.register(PayloadFiles)
    rows = pieces.select(F.col("stream").cast("string").alias("stream"), F.col("start_byte").cast("bigint").alias("start_byte"), F.col("payload").cast("binary").alias("payload"))
    rows.repartitionByRange("stream", "start_byte").sortWithinPartitions("stream", "start_byte").write.format("payload_files").mode("append").save(path)


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """(stream, start_byte, payload) of a written folder, in pieces of at most PIECE_BYTES."""
    index = spark.read.schema("stream string, start_byte bigint, bytes bigint, file string, place bigint").json(f"{path}/{INDEX}")
    cuts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(PIECE_BYTES).cast("bigint"))).alias("cut")
    pieces = index.select("stream", "start_byte", "bytes", "file", "place", cuts).repartition("file", "cut")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _files(path)
        for batch in batches:
            for stream, start, size, file, place, cut in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_input_file(f"{base}/{file}") as source:
                    data = source.read_at(min(PIECE_BYTES, size - cut), place + cut)
                yield pa.RecordBatch.from_arrays([pa.array([stream]), pa.array([start + cut]), pa.array([data], pa.binary())], names=["stream", "start_byte", "payload"])

    return pieces.mapInArrow(fetch, "stream string, start_byte bigint, payload binary")


def stream_digests(pieces: DataFrame) -> DataFrame:
    """stream, bytes, sha256 of each stream's pieces in byte order, which must leave no gap; pieces stream through, none is gathered."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        stream, state, n = None, None, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([stream]), pa.array([n], pa.int64()), pa.array([state.hexdigest()])], names=["stream", "bytes", "sha256"])

        for batch in batches:
            for name, start, payload in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or name != stream:
                    if state is not None:
                        yield done()
                    stream, state, n = name, hashlib.sha256(), 0
                if start != n:
                    raise ValueError(f"stream {stream}: bytes {n} to {start} are missing or doubled")
                state.update(payload)
                n += len(payload)
        if state is not None:
            yield done()

    rows = pieces.select("stream", "start_byte", "payload").repartition("stream").sortWithinPartitions("stream", "start_byte")
    return rows.mapInArrow(digest, "stream string, bytes bigint, sha256 string")
