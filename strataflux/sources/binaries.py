"""Binary corpora: inventories, headers, pixels, start codes, packets, hex records.

Inputs are `(path, content)` tables as the `binaryFile` reader gives them.
Fixed-place fields are column expressions; only walks whose next step depends on
the bytes before it are small Python helpers inside `mapInPandas`.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from strataflux.functions.media import complement
from strataflux.functions.text import printable

# Leading bytes, in hex, of the media types; then file endings.
MAGIC = {
    "png": "89504E47", "jpeg": "FFD8FF", "mpeg_system": "000001BA", "mpeg_video": "000001B3",
    "iff": "464F524D", "program": "601A", "pixmap": "5036", "greymap": "5035",
}
ENDINGS = {
    "img": "raster", "iff": "iff", "gem": "metafile", "rsc": "resource", "png": "png", "jpg": "jpeg", "jpe": "jpeg", "jpeg": "jpeg",
    "mpg": "mpeg", "mpe": "mpeg", "mpeg": "mpeg", "sam": "sample", "snd": "sample", "avr": "sample", "doc": "text", "out": "text",
}


def read_binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


def number_at(col: str, offset: int, size: int, signed: bool = False) -> Column:
    """Big-endian number at a fixed byte offset; null past the end."""
    raw = F.conv(F.nullif(F.hex(F.substring(col, offset + 1, size)), F.lit("")), 16, 10).cast("bigint")
    value = F.when(F.length(col) >= offset + size, raw)
    return F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value) if signed else value


def with_type(df: DataFrame) -> DataFrame:
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(F.length("content") == 0, "empty")
    for name, magic in MAGIC.items():
        kind = kind.when(head.startswith(magic), name)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    for end, name in ENDINGS.items():
        kind = kind.when(ending == end, name)
    return df.select("path", kind.otherwise("text").alias("type"), F.length("content").cast("bigint").alias("bytes"))


def inventory(df: DataFrame) -> DataFrame:
    """Files and bytes per media type."""
    return with_type(df).groupBy("type").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


_RASTER = ("version", "head_words", "planes", "pat_run", "pix_width", "pix_height", "width", "height")


def raster_headers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raster headers of eight 16-bit words, split into good and rejected ones."""
    head = df.select("path", *[number_at("content", 2 * i, 2, signed=n != "head_words").alias(n) for i, n in enumerate(_RASTER)])
    good = F.coalesce(F.expr("width > 0 and height > 0 and planes > 0 and version >= 0 and pat_run >= 0"), F.lit(False))
    return head.where(good), head.where(~good)


@F.pandas_udf(LongType())
def _list_bytes(tail: pd.Series) -> pd.Series:
    """Bytes of a fix-up list: a long, then bytes up to and with the first zero unless the long is zero."""
    def size(b):
        if b is None or len(b) < 4:
            return None
        if b[:4] == b"\0\0\0\0":
            return 4
        stop = b.find(b"\0", 4)
        return stop + 1 if stop >= 0 else len(b)
    return tail.map(size).astype("Int64")


def program_headers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Section sizes of programs, memory used, bytes after the sections, and bytes no field explains."""
    head = df.select(
        "path", "content", F.length("content").cast("bigint").alias("file_bytes"), number_at("content", 0, 2).alias("magic"),
        *[number_at("content", 2 + 4 * i, 4).alias(n) for i, n in enumerate(("text_bytes", "data_bytes", "bss_bytes", "symbol_bytes"))])
    good = F.coalesce((F.col("magic") == 0x601A) & (F.col("file_bytes") >= 28), F.lit(False))
    tail = F.substring(F.col("content"), (F.col("text_bytes") + F.col("data_bytes") + 29).cast("int"), F.col("file_bytes").cast("int"))
    fields = head.where(good).select(
        "path", "file_bytes", "text_bytes", "data_bytes", "bss_bytes", "symbol_bytes",
        F.expr("text_bytes + data_bytes + bss_bytes").alias("memory_bytes"),
        F.expr("file_bytes - 28 - text_bytes - data_bytes").alias("extra_bytes"), _list_bytes(tail).alias("fixup_bytes"))
    return fields.withColumn("unaccounted", F.expr("extra_bytes - fixup_bytes - symbol_bytes")), head.where(~good).select("path", "file_bytes")


# --- pixels --------------------------------------------------------------

_PIXEL_SCHEMA = "img string, y bigint, x bigint, r bigint, g bigint, b bigint"
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")
PIXELS_PER_BATCH = 1 << 16


def read_pixels(df: DataFrame) -> DataFrame:
    """Portable pixmaps and greymaps, text or binary, as pixels with samples scaled to 0..255."""
    return df.select("path", "content").mapInPandas(_pixel_frames, _PIXEL_SCHEMA)


def _pixel_frames(batches):
    for pdf in batches:
        held, n = [], 0  # small images share a frame: one for each image costs far more than its pixels
        for path, content in zip(pdf["path"], pdf["content"]):
            for piece in _decode_map(path, content):
                if held and n + len(piece[3]) > PIXELS_PER_BATCH:
                    yield _pixel_frame(held)
                    held, n = [], 0
                held.append(piece)
                n += len(piece[3])
        if held:
            yield _pixel_frame(held)


def _pixel_frame(pieces):
    """Pixels of pieces `(path, width, first, samples)` one after the other."""
    paths, widths, firsts, grids = zip(*pieces)
    sizes = np.array([len(g) for g in grids])
    grid = np.concatenate(grids)
    n = np.arange(len(grid)) + np.repeat(np.array(firsts) - (np.cumsum(sizes) - sizes), sizes)
    w = np.repeat(np.array(widths), sizes)
    return pd.DataFrame({"img": np.repeat(np.array(paths, dtype=object), sizes), "y": n // w, "x": n % w, "r": grid[:, 0], "g": grid[:, 1], "b": grid[:, 2]})


def _decode_map(path, content):
    """Pieces `(path, width, first, samples)` of at most PIXELS_PER_BATCH pixels: three samples for each pixel from the `first` on."""
    if content[:2] not in (b"P2", b"P3", b"P5", b"P6"):
        return
    fields, at = [], 2
    for _ in range(3):
        hit = _TOKEN.match(content, at)
        if not hit:
            return
        fields.append(int(hit[1]))
        at = hit.end()
    w, h, top = fields
    planes = 3 if content[1:2] in b"36" else 1
    if content[1:2] in b"56":
        wide = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
        flat = np.frombuffer(content, dtype=wide, offset=at + 1, count=w * h * planes)
    else:
        flat = np.array(re.sub(rb"#[^\n]*", b"", content[at:]).split()[: w * h * planes], dtype=np.int64)
    scaled = (flat.astype(np.int64) * 255 + top // 2) // top
    grid = scaled.reshape(h * w, planes)
    for lo in range(0, h * w, PIXELS_PER_BATCH):
        part = grid[lo:lo + PIXELS_PER_BATCH]
        yield path, w, lo, part if planes == 3 else np.repeat(part, 3, axis=1)


# --- compressed-image markers --------------------------------------------

# Frame markers and the process each one names.
PROCESS = {
    0xC0: "Baseline", 0xC1: "Extended sequential", 0xC2: "Progressive", 0xC3: "Lossless", 0xC5: "Differential sequential",
    0xC6: "Differential progressive", 0xC7: "Differential lossless", 0xC9: "Extended sequential, arithmetic coding",
    0xCA: "Progressive, arithmetic coding", 0xCB: "Lossless, arithmetic coding", 0xCD: "Differential sequential, arithmetic coding",
    0xCE: "Differential progressive, arithmetic coding", 0xCF: "Differential lossless, arithmetic coding",
}
START, END, SCAN, COMMENT, APP12 = 0xD8, 0xD9, 0xDA, 0xFE, 0xEC
_MARKER_SCHEMA = ("path string, marker bigint, at bigint, process string, width bigint, height bigint, "
                  "components bigint, precision bigint, note binary")


def _segments(content):
    """(marker, offset of its 0xFF byte, body) before the first scan; a file that does not begin with the start marker gives nothing."""
    if content[:2] != bytes([0xFF, START]):
        return
    at = 2
    while True:
        at = content.find(b"\xff", at)
        if at < 0:
            return
        while at < len(content) and content[at] == 0xFF:
            at += 1
        if at >= len(content) or content[at] in (SCAN, END):
            return
        marker, size = content[at], int.from_bytes(content[at + 1:at + 3], "big")
        if size < 2:
            return
        yield marker, at - 1, content[at + 3:at + 1 + size]
        at += 1 + size


def _frame(marker, body):
    """Process, width, height, components and precision of a frame header; nulls for other markers."""
    if marker not in PROCESS or len(body) < 6:
        return (None,) * 5
    precision, height, width, parts = struct.unpack(">BHHB", body[:6])
    return PROCESS[marker], width, height, parts, precision


def _walk_markers(path, content):
    for marker, at, body in _segments(content):
        yield (path, marker, at, *_frame(marker, body), body if marker in (COMMENT, APP12) else None)


def image_markers(df: DataFrame) -> DataFrame:
    """One row per marker segment up to the start of the scan; comments as printable text."""
    names = [c.split()[0] for c in _MARKER_SCHEMA.split(", ")]

    def walk(batches):
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in _walk_markers(p, c)]
            frame = pd.DataFrame(rows, columns=names)
            for n in ("width", "height", "components", "precision"):
                frame[n] = frame[n].astype("Int64")
            yield frame

    found = df.select("path", "content").mapInPandas(walk, _MARKER_SCHEMA)
    return found.withColumn("note", printable(F.decode("note", "ISO-8859-1")))


def frame_fields(body: bytes):
    """Fields of a frame header, with the sampling factors and table of each component."""
    if len(body) < 6:
        raise ValueError("short frame header")
    precision, height, width, parts = struct.unpack(">BHHB", body[:6])
    yield from (("precision", precision), ("height", height), ("width", width), ("components", parts))
    if len(body) < 6 + 3 * parts:
        raise ValueError("short frame header")
    for i in range(parts):
        _, factors, table = body[6 + 3 * i:9 + 3 * i]
        yield from ((f"h{i}", factors >> 4), (f"v{i}", factors & 15), (f"table{i}", table))


def restart_fields(body: bytes):
    if len(body) != 2:
        raise ValueError("wrong length of a restart interval")
    yield "interval", int.from_bytes(body, "big")


def table_fields(body: bytes):
    """Number of quantization tables, and for each its width in bytes and the sum of its entries."""
    at, n = 0, 0
    while at < len(body):
        wide, ident = body[at] >> 4, body[at] & 15
        size = 64 * (1 + (wide > 0))
        entries = body[at + 1:at + 1 + size]
        if len(entries) < size:
            raise ValueError("short quantization table")
        step = size // 64
        yield from ((f"bytes{ident}", step), (f"sum{ident}", sum(int.from_bytes(entries[i:i + step], "big") for i in range(0, size, step))))
        at, n = at + 1 + size, n + 1
    yield "tables", n


# Handlers by marker code; another set is given to `marker_processor`.
HANDLERS = {**dict.fromkeys(PROCESS, frame_fields), 0xDB: table_fields, 0xDD: restart_fields}


def marker_processor(handlers=None):
    """A table function of one binary value: `(marker, at, field, value, error)` rows from the handler of each marker code.

    A handler takes the body of a segment and yields (name, whole number). A body
    it refuses with ValueError gives one row with the reason, after the fields it
    had read; markers without a handler give nothing. Null and empty content give
    no rows. Arrow table functions cannot stand in a lateral join, so this is a
    plain one; it is called once for a file.
    """
    chosen = dict(HANDLERS if handlers is None else handlers)

    class Processor:
        def eval(self, content):
            for marker, at, body in _segments(bytes(content or b"")):
                if marker in chosen:
                    try:
                        for field, value in chosen[marker](body):
                            yield marker, at, field, value, None
                    except ValueError as problem:
                        yield marker, at, None, None, str(problem)

    return F.udtf(Processor, returnType="marker bigint, at bigint, field string, value bigint, error string", useArrow=False)


def process_markers(df: DataFrame, handlers=None) -> DataFrame:
    """`(path, marker, at, field, value, error)` by a lateral call of `marker_processor`."""
    files = df.select("path", "content")
    return files.lateralJoin(marker_processor(handlers)(F.col("content").outer())).select("path", "marker", "at", "field", "value", "error")


def marker_summary(markers: DataFrame) -> DataFrame:
    """Images per process with the largest size."""
    return markers.where("process is not null").groupBy("process", "components", "precision").agg(
        F.count(F.lit(1)).alias("images"), F.max(F.col("width") * F.col("height")).alias("most_pixels"))


# --- start codes and packets ---------------------------------------------

CHUNK_BYTES = 1 << 20
PREFIX = b"\0\0\1"


def scan_start_codes(df: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every 00 00 01 xx: `(path, at, code)`.

    Content is cut into chunks that overlap by three bytes and spread over
    tasks, so one long file is searched in parallel.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.length("content") - 1).cast("bigint"), F.lit(chunk_bytes).cast("bigint"))
    chunks = df.select("path", "content", F.explode(starts).alias("start")).select(
        "path", "start", F.substring(F.col("content"), (F.col("start") + 1).cast("int"), F.lit(chunk_bytes + 3)).alias("piece"))
    spread = chunks.repartition("path", "start")

    def search(batches):
        for pdf in batches:
            rows = []
            for path, start, piece in zip(pdf["path"], pdf["start"], pdf["piece"]):
                at = piece.find(PREFIX)
                while 0 <= at < min(chunk_bytes, len(piece) - 3):
                    rows.append((path, start + at, piece[at + 3]))
                    at = piece.find(PREFIX, at + 1)
            yield pd.DataFrame(rows, columns=["path", "at", "code"])

    return spread.mapInPandas(search, "path string, at bigint, code bigint")


PACKET_SCHEMA = ("stream string, seq bigint, at bigint, kind string, stream_id bigint, scr_ticks bigint, mux_rate bigint, "
                  "hdr_bytes bigint, payload_bytes bigint, skipped_bytes bigint")


def _header_bytes(body):
    """Bytes of a packet's stuffing, buffer and time-stamp fields."""
    at = 0
    while at < len(body) and body[at] >= 0x80:
        at += 1
    if at < len(body) and body[at] >> 6 == 1:
        at += 2
    lead = body[at] >> 4 if at < len(body) else 0
    return at + {2: 5, 3: 10}.get(lead, 1)


def record_at(data: bytes, hit: int) -> tuple[list[tuple], int] | None:
    """Rows (kind, id, ticks, rate, header bytes, payload bytes) of the record at a start code, and where the next may begin; None ends a walk."""
    if hit < 0 or hit + 4 > len(data) or data[hit + 3] == 0xB9:
        return None
    code, body = data[hit + 3], hit + 4
    if code == 0xBA:
        f = data[body:body + 8]
        if len(f) < 8:
            return None
        ticks = (f[0] >> 3 & 1) << 32 | (f[0] >> 1 & 3) << 30 | f[1] << 22 | f[2] >> 1 << 15 | f[3] << 7 | f[4] >> 1
        return [("pack", None, ticks, (f[5] & 0x7F) << 15 | f[6] << 7 | f[7] >> 1, 12, 0)], body + 8
    size = int.from_bytes(data[body:body + 2], "big")
    inner, after = data[body + 2:body + 2 + size], body + 2 + size
    if code == 0xBB:
        ids = [inner[i] for i in range(6, len(inner) - 2, 3) if inner[i] >= 0x80] or [None]
        return [("header", sid, None, None, 6 + size if n == 0 else 0, 0) for n, sid in enumerate(ids)], after
    head = _header_bytes(inner) if 0xC0 <= code < 0xF0 else 0
    return [("packet", code, None, None, 6 + head, size - head)], after


def _walk_packets(name, data):
    at = seq = 0
    while (record := record_at(data, hit := data.find(PREFIX, at))) is not None:
        for n, (kind, sid, ticks, rate, head, size) in enumerate(record[0]):
            yield (name, seq + n, hit, kind, sid, ticks, rate, head, size, hit - at if n == 0 else 0)
        seq, at = seq + len(record[0]), record[1]


def packet_records(df: DataFrame) -> DataFrame:
    """System-layer records of each file: packs, declared ids of headers, packets.

    A packet's length says where the next record may begin, so codes inside
    payload are passed over. Bytes before a code count as skipped.
    """
    names = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]

    def walk(batches):
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in _walk_packets(p, c)]
            frame = pd.DataFrame(rows, columns=names)
            for n in ("stream_id", "scr_ticks", "mux_rate"):
                frame[n] = frame[n].astype("Int64")
            yield frame

    return df.select("path", "content").mapInPandas(walk, PACKET_SCHEMA)


# --- hex records ---------------------------------------------------------

_sums = StructType([StructField("bytes", ArrayType(LongType())), StructField("nibbles", ArrayType(LongType()))])


def _record_sums(size: int):
    @F.pandas_udf(_sums)
    def sums(content: pd.Series) -> pd.DataFrame:
        by, nib = [], []
        for c in content:
            a = np.frombuffer(c, dtype=np.uint8).astype(np.int64)
            cuts = np.arange(0, len(a), size)
            by.append(np.add.reduceat(a, cuts) if len(a) else a)
            nib.append(np.add.reduceat((a >> 4) + (a & 15), cuts) if len(a) else a)
        return pd.DataFrame({"bytes": by, "nibbles": nib})
    return sums


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(F.pmod(value.cast("bigint"), F.lit(1 << (4 * digits)))), digits, "0")


def _byte_total(value: Column, n: int) -> Column:
    """Sum of the low n bytes of an address."""
    return sum(F.shiftright(value, 8 * i).bitwiseAND(255) for i in range(n))


def _nibble_total(value: Column, n: int) -> Column:
    return sum(F.shiftright(value, 4 * i).bitwiseAND(15) for i in range(n))


def to_hex_records(df: DataFrame, key: str, fmt: str = "s", size: int = 32, offset: int = 0) -> DataFrame:
    """Checksummed text records `(key, addr, line)` of binary content, with a closing record.

    `s`: 24-bit address, ones' complement; `intel`: 16-bit address, twos'
    complement; `tek`: 16-bit address, digit sums of header and data.
    """
    # slices are cut from the bytes, where a cut costs its own length; in text it would walk from the start
    summed = df.select(key, "content", _record_sums(size)(F.col("content")).alias("_s"))
    rows = summed.select(key, "content", F.posexplode(F.arrays_zip("_s.bytes", "_s.nibbles")).alias("_i", "_t")).select(
        key, (F.col("_i").cast("bigint") * size).alias("_at"), F.hex(F.substring(F.col("content"), F.col("_i") * size + 1, F.lit(size))).alias("data"),
        F.col("_t.bytes").alias("total"), F.col("_t.nibbles").alias("nibbles"))
    n = (F.length("data") / 2).cast("bigint")
    if fmt == "s":
        addr = F.pmod(F.col("_at") + offset, F.lit(1 << 24))
        line = F.concat(F.lit("S2"), _hex(n + 4, 2), _hex(addr, 6), "data", _hex(complement(F.col("total") + n + 4 + _byte_total(addr, 3), "ones"), 2))
        end_sum = 4 + sum(offset >> s & 255 for s in (0, 8, 16))
        last = f"S804{offset & 0xFFFFFF:06X}{~end_sum & 255:02X}"
    elif fmt == "intel":
        addr = F.pmod(F.col("_at"), F.lit(1 << 16))
        line = F.concat(F.lit(":"), _hex(n, 2), _hex(addr, 4), F.lit("00"), "data", _hex(complement(F.col("total") + n + _byte_total(addr, 2), "twos"), 2))
        last = ":0000000000"
    elif fmt == "tek":
        addr = F.pmod(F.col("_at"), F.lit(1 << 16))
        head = _nibble_total(addr, 4) + _nibble_total(n, 2)
        line = F.concat(F.lit("/"), _hex(addr, 4), _hex(n, 2), _hex(head, 2), "data", _hex(F.col("nibbles"), 2))
        last = "/00000000"
    else:
        raise ValueError(f"unknown record format {fmt!r}")
    closing = df.select(key, F.length("content").cast("bigint").alias("addr"), F.lit(last).alias("line"))
    return rows.select(key, F.col("_at").alias("addr"), line.alias("line")).unionByName(closing)


def write_hex_records(records: DataFrame, key: str, path: str) -> None:
    """Record lines as text files in key and address order."""
    records.repartitionByRange(key, "addr").sortWithinPartitions(key, "addr").select("line").write.mode("errorifexists").text(path)
