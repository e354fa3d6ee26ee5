"""Joint segmentation of byte sequences into solid, pattern and literal pieces.

A sequence is read from the left. At each place the longest of three pieces wins:

    solid    two or more equal bytes (a third makes it worth more than a pattern)
    pattern  a pair of different bytes that comes at least twice in a row
    literal  everything else, up to the next place where one of the others begins

No piece is longer than MOST values (pairs count two). Whether a place begins a
solid or a pattern run depends only on where runs of equal neighbours and of equal
next-but-one neighbours end, which is local; where pieces are cut depends on where
the piece before ended. So a sequence of any length is a walk of a finite machine:
its state at a place is the number of values that the piece before still covers.

Long sequences are cut into chunks. A chunk, with the values that follow it, is
walked for every state it may be entered in; walks that come to one place go on as
one. What is left of it is a short map from entry to exit. Maps are put together in
order, and with its true entry each chunk writes its own pieces. No sequence is
gathered: rows are (part, pos, value) with pos dense from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflux.session import scratch_path

MOST = 128
AHEAD = MOST + 4  # a literal ends where another piece begins, and that takes four values to see
CHUNK = 1 << 14
PIECES = "kind string, start bigint, size bigint, values array<bigint>"
KINDS = ("literal", "solid", "pattern")


def _reach(same: np.ndarray, n: int) -> np.ndarray:
    """For each place, how many trues of `same` stand in a row from there on, at most `n`."""
    stops = np.append(np.flatnonzero(~same), len(same))
    return np.minimum(stops[np.searchsorted(stops, np.arange(len(same)))] - np.arange(len(same)), n)


def plan(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind, size) of the piece that begins at each place; the last MOST places see what is there only."""
    n = len(values)
    solid = 1 + np.append(_reach(values[1:] == values[:-1], MOST - 1), 0) if n else np.zeros(0, np.int64)
    twice = _reach(values[2:] == values[:-2], MOST - 2) if n > 2 else np.zeros(0, np.int64)
    pattern = np.zeros(n, np.int64)
    pattern[: len(twice)] = (twice + 2) // 2 * 2
    pattern[pattern < 4] = 0
    if n > 1:
        pattern[:-1][values[1:] == values[:-1]] = 0
    kind = np.where((solid >= 2) & (solid >= pattern), 1, np.where(pattern > 0, 2, 0))
    begins = np.append(np.flatnonzero(kind > 0), n)
    literal = np.minimum(begins[np.searchsorted(begins, np.arange(n))] - np.arange(n), MOST)
    return kind, np.where(kind == 1, solid, np.where(kind == 2, pattern, literal))


def walk(values: np.ndarray, first: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(kind, start, size) of the pieces that begin at first .. stop - 1."""
    kind, size = plan(values)
    at = first
    while at < stop:
        yield int(kind[at]), at, int(size[at])
        at += int(size[at])


def segment(values: list[int] | np.ndarray) -> list[tuple[str, int, list[int]]]:
    """Pieces of one sequence: kind, size, and the value, the pair, or all values of a literal."""
    values = np.asarray(values, np.int64)
    return [(KINDS[k], size, _held(values, k, at, size)) for k, at, size in walk(values, 0, len(values))]


def _held(values: np.ndarray, kind: int, at: int, size: int) -> list[int]:
    return values[at : at + (1, 2)[kind - 1] if kind else at + size].tolist()


def _exits(values: np.ndarray, n: int) -> list[int]:
    """For each number of values covered on entry (0 .. MOST - 1): how many values behind the chunk are covered on exit."""
    _, size = plan(values)
    after = np.arange(n + MOST) - n  # from places behind the chunk: what is covered there
    for at in range(n - 1, -1, -1):
        after[at] = after[min(at + int(size[at]), n + MOST - 1)]
    return after[np.minimum(np.arange(MOST), n + MOST - 1)].tolist()


def segments(df: DataFrame, part: list[str], pos: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """Pieces (part, kind, start, size, values) of every sequence; `pos` is dense from 0, `value` a whole number.

    `chunk` is at least AHEAD. A part without rows has no piece. Equal places in one part are an error of the
    input and are not looked for.
    """
    if chunk < AHEAD:
        raise ValueError(f"chunk must be at least {AHEAD}")
    spark = df.sparkSession
    body = df.select(*part, F.col(pos).cast("bigint").alias("_pos"), F.col(value).cast("bigint").alias("_value"))
    number = F.floor(F.col("_pos") / chunk).cast("bigint")
    # the first AHEAD values of a chunk go with the chunk before it, too
    ahead = body.where((F.col("_pos") % chunk < AHEAD) & (F.col("_pos") >= chunk)).withColumn("_chunk", number - 1)
    both = body.withColumn("_chunk", number).unionByName(ahead)
    grouped = both.groupBy(*part, "_chunk").agg(F.array_sort(F.collect_list(F.struct("_pos", "_value"))).alias("_rows"))
    path = scratch_path(spark, "segment-chunks")
    grouped.select(*part, "_chunk", F.col("_rows")["_value"].alias("_values")).write.parquet(path)
    chunks = spark.read.schema(grouped.select(*part, "_chunk", F.col("_rows")["_value"].alias("_values")).schema).parquet(path)
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in part)
    width = len(part)

    def arrays(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
        column = batch.column(batch.schema.get_field_index(name))
        flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        for a, b in zip(offsets - offsets[0], offsets[1:] - offsets[0]):
            yield flat[a:b]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_exits(v, chunk) if len(v) > chunk else [0] * MOST for v in arrays(batch, "_values")]
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names[: width + 1], "_exits"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entry of each chunk: the maps of a part stream by in order, one at a time."""
        last, state = None, 0
        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in range(width)])) if width else [()] * batch.num_rows
            out = []
            for name, found in zip(names, batch.column(width + 1).to_pylist()):
                if name != last:
                    last, state = name, 0
                out.append(state)
                state = found[state]
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 1], pa.array(out, pa.int64())], names=[*batch.schema.names[: width + 1], "_entry"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, source = [], []
            entries = batch.column(batch.schema.get_field_index("_entry")).to_pylist()
            numbers = batch.column(batch.schema.get_field_index("_chunk")).to_pylist()
            for i, (values, entry, at) in enumerate(zip(arrays(batch, "_values"), entries, numbers)):
                for kind, start, size in walk(values, entry, min(len(values), chunk)):
                    rows.append((KINDS[kind], at * chunk + start, size, _held(values, kind, start, size)))
                    source.append(i)
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).take(pa.array(source)) for i in range(width)], *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]],
                    names=[*batch.schema.names[:width], "kind", "start", "size", "values"])

    lead = f"{keys}, " if keys else ""
    found = chunks.select(*part, "_chunk", "_values").mapInArrow(maps, f"{lead}_chunk bigint, _exits array<bigint>")
    ordered = found.repartition(*[F.col(c) for c in part]) if part else found.repartition(1)  # one row for a chunk
    entries = ordered.sortWithinPartitions(*part, "_chunk").mapInArrow(enter, f"{lead}_chunk bigint, _entry bigint")
    same = [chunks[c].eqNullSafe(entries[c]) for c in (*part, "_chunk")]
    joined = chunks.join(entries, on=_all(same)).select(*[chunks[c] for c in (*part, "_chunk")], "_values", "_entry")
    return joined.mapInArrow(write, f"{lead}{PIECES}")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def expand(pieces: DataFrame, part: list[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """The sequences again: a solid repeats its value, a pattern its pair, a literal is its values."""
    place = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)).alias("_i")
    return pieces.select(*part, "start", "values", place).select(
        *part, (F.col("start") + F.col("_i")).alias(pos), F.element_at("values", (F.col("_i") % F.size("values") + 1).cast("int")).alias(value))
