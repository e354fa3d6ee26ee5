"""Token-ID files: fixed-width bit packing with block offsets.

File format of a shard (one per range of document ids):

    blocks   every block holds BLOCK_IDS ids (the last one fewer), each id in
             `bits` bits, most significant first, padded to a whole byte
    starts   int64[n_docs + 1]: ids of the shard before each document
    offsets  int64[n_blocks + 1]: byte place of each block
    trailer  magic, bits, block size, n_docs, n_blocks (five int64)

`bits` is the least width that holds the vocabulary, so an id's place follows
from its number and any run of ids is unpacked with a few numpy calls. Writing
streams block by block; the trailer comes last, so the file needs no seek and
may lie in any store pyarrow knows (local, hdfs, s3, gs).

Tasks write under names of their own attempt and only report a name once its
file is closed; the index of names goes through Spark's committed Parquet
writer. A lost executor leaves an unnamed file behind and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflux.llm import common, tokens
from strataflux.session import scratch_path

MAGIC = 0x53464944
BLOCK_IDS = 65_536
TRAILER = 5
INDEX = "doc_id long, shard int, file string, first long, n_tokens long, position long"


def width(vocabulary: int) -> int:
    """Least bits that hold every id below `vocabulary`."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, most significant first."""
    if bits % 8 == 0:
        return np.ascontiguousarray(ids.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - bits // 8 :]).tobytes()
    places = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids.astype(np.uint32)[:, None] >> places) & 1).astype(np.uint8)).tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits % 8 == 0:
        wide = np.zeros((n, 4), np.uint8)
        wide[:, 4 - bits // 8 :] = np.frombuffer(data, np.uint8, n * bits // 8).reshape(n, bits // 8)
        return wide.view(">u4").ravel().astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    out = np.zeros(n, "<u4")
    for column in range(bits):
        out = (out << 1) | flat[:, column]
    return out


def qualified(spark: SparkSession, folder: str) -> str:
    """`folder` with the scheme that Spark itself gives a path without one; local paths stay plain."""
    if "://" in folder:
        return folder
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.removeprefix("file:") if whole.startswith("file:") else whole


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class ShardWriter:
    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.held, self.n_held, self.offsets, self.starts, self.n = stream, bits, [], 0, [0], [0], 0

    def add(self, raw: bytes) -> int:
        """Append one document's ids (little-endian uint32); gives the ids before it."""
        first, n = self.n, len(raw) // 4
        self.held.append(raw)
        self.n_held, self.n = self.n_held + n, self.n + n
        self.starts.append(self.n)
        if self.n_held >= 16 * BLOCK_IDS:
            self._flush(False)
        return first

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        full = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for at in range(0, full, BLOCK_IDS):
            data = pack_bits(ids[at : min(at + BLOCK_IDS, full)], self.bits)
            self.stream.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.n_held = [ids[full:].tobytes()], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        trailer = [MAGIC, self.bits, BLOCK_IDS, len(self.starts) - 1, len(self.offsets) - 1]
        for numbers in (self.starts, self.offsets, trailer):
            self.stream.write(np.asarray(numbers, "<i8").tobytes())


class ShardReader:
    """Random access: reads the trailer and the block offsets, then only the blocks asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.bits, self.block, self.n_docs, n_blocks = self._numbers(size - 8 * TRAILER, TRAILER)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = size - 8 * (TRAILER + n_blocks + 1)
        self.offsets = self._numbers(at, n_blocks + 1)
        self.starts_at = at - 8 * (self.n_docs + 1)

    def _numbers(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.source.read_at(8 * int(n), int(at)), "<i8")

    def starts(self, doc: int, n: int) -> np.ndarray:
        """The first id of documents doc .. doc + n (one more than n)."""
        return self._numbers(self.starts_at + 8 * doc, n + 1)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first .. last - 1 of the shard."""
        if last <= first:
            return np.zeros(0, "<u4")
        lo, hi = first // self.block, -(-last // self.block)
        data = self.source.read_at(int(self.offsets[hi] - self.offsets[lo]), int(self.offsets[lo]))
        n = (len(data) * 8) // self.bits if hi - lo == 1 else 0
        if n:
            got = unpack_bits(data, self.bits, min(n, self.block))
        else:
            got = np.concatenate([unpack_bits(data[self.offsets[b] - self.offsets[lo] : self.offsets[b + 1] - self.offsets[lo]], self.bits, min(self.block, int((self.offsets[b + 1] - self.offsets[b]) * 8 // self.bits))) for b in range(lo, hi)])
        return got[first - lo * self.block : last - lo * self.block]


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = 2, vocabulary: int = tokens.VOCABULARY_SIZE) -> DataFrame:
    """Write token shards of `docs` (doc_id, text) in ascending doc_id order; returns the committed index.

    Documents are dealt by ranges of doc_id and sorted inside a range, so shard
    number and place follow the global order. Null doc_ids come first, rows that
    share a doc_id are ordered by text, a null text is an empty one. Index
    columns: doc_id, shard, file, first (ids of the shard before it), n_tokens
    (with the end id), position (its number in the shard).
    """
    spark = docs.sparkSession
    folder = qualified(spark, scratch_path(spark, "token-shards"))
    bits = width(max(vocabulary, end_id + 1))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = tokens.encoder(path).encode
        writer = stream = None
        rows = []
        for batch in batches:
            for part in common.slices(batch, "text"):
                if writer is None:
                    fs, base = filesystem(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"shard-{shard:08d}-{uuid.uuid4().hex}.tok"
                    stream = fs.open_output_stream(f"{base}/{name}")
                    writer = ShardWriter(stream, bits)
                raws = [raw + end for raw in encode(part.column("text").to_pylist())]
                begin = len(writer.starts) - 1
                rows.append((part.column("doc_id"), [writer.add(raw) for raw in raws], [len(raw) // 4 for raw in raws], begin))
        if writer is None:
            return
        writer.close()
        stream.close()
        for ids, firsts, counts, begin in rows:
            n = len(firsts)
            yield pa.RecordBatch.from_arrays([ids, pa.array([shard] * n, pa.int32()), pa.array([f"{folder}/{name}"] * n), pa.array(firsts, pa.int64()), pa.array(counts, pa.int64()), pa.array(range(begin, begin + n), pa.int64())], ["doc_id", "shard", "file", "first", "n_tokens", "position"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty("text").cast("binary").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return common.stored(ordered.mapInArrow(run, INDEX), "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """Add `start`, the ids of all documents before each one. Totals are one row per shard, so few."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = totals.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    return index.join(F.broadcast(before), "shard").select("doc_id", "file", "position", "first", (F.col("base") + F.col("first")).alias("start"), "n_tokens")


def read_shards(index: DataFrame) -> DataFrame:
    """Ids of each document of `index` (columns doc_id, file, position, start) as read from its file.

    Rows of one file in a batch are read as one range; n_tokens comes from the
    file's own document table. Returns doc_id, start, n_tokens, ids (binary,
    little-endian unsigned 32-bit).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = opened = None
        for batch in batches:
            rows = sorted(zip(batch.column("file").to_pylist(), batch.column("position").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("start").to_pylist()), key=lambda r: r[:2])
            out: list = []
            for file, position, doc, start in rows:
                if file != opened:
                    fs, base = filesystem(file)
                    reader, opened, window = ShardReader(fs.open_input_file(base)), file, (0, -1)
                if not window[0] <= position < window[1]:
                    window = (position, min(position + 1024, int(reader.n_docs)))
                    starts = reader.starts(position, window[1] - position).tolist()
                    held = (0, 0)
                first, last = starts[position - window[0]], starts[position - window[0] + 1]
                if not (held[0] <= first and last <= held[1]):
                    held = (first, max(last, min(starts[-1], first + 8 * BLOCK_IDS)))
                    ids = reader.ids(*held)
                out.append((doc, start, last - first, ids[first - held[0] : last - held[0]].tobytes()))
                if len(out) >= 2000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def _rows(out):
        docs, starts, counts, raws = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(raws, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return index.select("doc_id", "file", "position", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_shards(common.read(spark, sf_dir, "documents"))
    back = read_shards(with_starts(index))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
