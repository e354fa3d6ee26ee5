"""Byte ranges give the packets of one walk; payload files give back the bytes."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from strataflux.sources import binaries, ranges


def system_stream(seed, n):
    r = random.Random(seed)
    out = bytearray(r.randbytes(r.randint(0, 9)))
    for _ in range(n):
        kind = r.random()
        if kind < 0.15:
            out += b"\0\0\1\xba" + r.randbytes(8)
        elif kind < 0.25:
            inner = r.randbytes(6) + b"".join(bytes([r.choice([0xC0, 0xE0, 0x20]), 1, 2]) for _ in range(r.randint(0, 3)))
            out += b"\0\0\1\xbb" + len(inner).to_bytes(2, "big") + inner
        else:
            # payload with false codes and false lengths in it
            inner = b"".join(r.choice([r.randbytes(5), b"\0\0\1\xe0\0\x08", b"\0\0\1\xba", b"\x0f", b"\xff\xff"]) for _ in range(r.choice([1, 3, 20, 400])))
            out += b"\0\0\1" + bytes([r.choice([0xBD, 0xBE, 0xC0, 0xE0, 0xE1])]) + len(inner).to_bytes(2, "big") + inner
        if r.random() < 0.2:
            out += r.choice([b"junk", b"\0\0", b"\0" * 40])
    return bytes(out + r.choice([b"", b"\0\0\1\xb9tail\0\0\1\xba" + b"x" * 20, b"\0\0\1\xba123", b"\0\0\1", b"\0\0\1\xe0\xff\xffshort"]))


@pytest.mark.parametrize("chunk", [24, 500, 1 << 20])
def test_ranges_equal_one_walk(spark, folder, chunk):
    os.makedirs(f"{folder}/in")
    for i in range(3 if chunk == 24 else 8):
        with open(f"{folder}/in/{i}.mpg", "wb") as f:
            f.write(system_stream(10 * chunk + i, 1 if chunk == 24 else 25))
    open(f"{folder}/in/empty.mpg", "wb").close()
    cut = ranges.read_ranges(spark, f"{folder}/in", ending=".mpg", chunk_bytes=chunk)
    if chunk == 500:
        assert cut.rdd.getNumPartitions() > 20
    got = ranges.packets(cut)
    want = binaries.packet_records(binaries.read_binary(spark, f"{folder}/in"))
    name = F.regexp_extract("stream", "[^/]+$", 0)
    rows = [sorted((tuple(r) for r in df.withColumn("stream", name).collect()), key=lambda r: r[:2]) for df in (got, want)]
    assert rows[1] and rows[0] == rows[1]


def test_payload_files(spark, folder):
    r = random.Random(3)
    pieces, whole, at = [], {}, {}
    for i in range(400):
        s = r.choice(["7", "8", "9"]) if i % 3 else "7"
        data = r.randbytes(r.choice([0, 1, 10, 300])) + b"\n\xff"[: r.randint(0, 2)]
        pieces.append((s, at.get(s, 0), data))
        at[s] = at.get(s, 0) + len(data)
        whole[s] = whole.get(s, b"") + data
    df = spark.createDataFrame(pieces, "stream string, start_byte bigint, payload binary").repartition(5)
    ranges.write_payload(df, f"{folder}/out")
    back = ranges.read_payload(spark, f"{folder}/out")
    got = {x.stream: (x.bytes, x.sha256) for x in ranges.stream_digests(back).collect()}
    assert got == {s: (len(b), hashlib.sha256(b).hexdigest()) for s, b in whole.items()}
    with pytest.raises(Exception, match="missing or doubled"):
        ranges.stream_digests(df.where("start_byte > 0")).collect()


def test_no_pieces(spark, folder):
    ranges.write_payload(spark.createDataFrame([], "stream string, start_byte bigint, payload binary"), f"{folder}/out")
    assert ranges.read_payload(spark, f"{folder}/out").count() == 0
