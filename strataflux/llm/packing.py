"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n, the latter for
attention inside its document. Documents are cut into whole sequences first;
the rests are assigned in descending length, each to the sequence of lowest
cost so far that still has room for it. Where none has, the rest is cut at the
room of the emptiest one and its tail goes back into the queue, so a packing
group of T tokens uses ceil(T / capacity) sequences and pads less than one.

A group is what one task has read up to GROUP_TOKENS of such rests: memory is
bounded, nothing is shuffled, and a hot source or a huge document changes
nothing. A sequence's number holds its task's number, so it is unique and a
retried task gives the same one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflux.llm import common, tokens

CAPACITY = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
GROUP_TOKENS = 8_000_000
PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def balance(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Assign pieces shorter than `capacity`: rows (piece, start in it, length, sequence, offset there)."""
    total = sum(lengths)
    n = -(-total // capacity)
    queue = [(-length, i, 0) for i, length in enumerate(lengths) if length]
    heapq.heapify(queue)
    fits = [(0.0, s) for s in range(n)]  # sequences with room for the present length, by cost
    used, spent = [0] * n, [0.0] * n
    tight: list[list[int]] = [[] for _ in range(capacity + 1)]  # the others, by their room
    bar, placed = capacity, []
    while queue:
        negative, i, start = heapq.heappop(queue)
        length = -negative
        while bar > length:  # lengths only fall: sequences whose room suffices now come back
            bar -= 1
            for s in tight[bar]:
                heapq.heappush(fits, (spent[s], s))
            tight[bar].clear()
        if fits:
            _, s = heapq.heappop(fits)
        else:
            room = next(r for r in range(length - 1, 0, -1) if tight[r])
            s = tight[room].pop()
            heapq.heappush(queue, (room - length, i, start + room))
            length = room
        placed.append((i, start, length, s, used[s]))
        used[s] += length
        spent[s] += cost(length)
        room = capacity - used[s]
        if room >= bar:
            heapq.heappush(fits, (spent[s], s))
        elif room:
            tight[room].append(s)
    return placed


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row of `docs`: its columns but text, with start, length, doc_tokens, sequence_id, offset, ids.

    A null or empty text is the end id alone. Rows are packed as they come, so a
    repeated row is packed twice. `ids` are little-endian unsigned 32-bit.
    """
    kept = [c for c in docs.columns if c != "text"]
    source = docs.select(*kept, F.col("text").cast("binary").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401
        from pyspark import TaskContext

        encode = tokens.encoder(path).encode
        sequence = TaskContext.get().partitionId() << 33
        rest, held = [], 0  # (row as a one-row batch, start, ids, tokens of the document)

        def flush():
            nonlocal sequence, rest, held
            if not rest:
                return
            placed = balance([len(ids) // 4 for _, _, ids, _ in rest], capacity)
            rows = [(rest[i][0], rest[i][1] + start, length, rest[i][3], sequence + s, offset, rest[i][2][4 * start : 4 * (start + length)]) for i, start, length, s, offset in placed]
            sequence += 1 + max(s for _, _, _, s, _ in placed)
            rest, held = [], 0
            yield from emit(rows)

        def emit(rows):
            for first in range(0, len(rows), 4000):
                group = rows[first : first + 4000]
                table = pa.concat_tables(tables)
                columns = table.take(pa.array([r[0] for r in group], pa.int64())).combine_chunks().columns
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                new = [pa.array([r[k] for r in group], pa.int64()) for k in range(1, 6)] + [pa.array([r[6] for r in group], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + new, [*table.schema.names, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        tables: list[pa.Table] = []
        n_rows = 0
        for batch in batches:
            for part in common.slices(batch, "text"):
                at = part.schema.get_field_index("text")
                raws = [raw + end for raw in encode(part.column(at).to_pylist())]
                tables.append(pa.Table.from_batches([part]).drop_columns(["text"]))
                whole = []
                for i, raw in enumerate(raws, n_rows):
                    n = len(raw) // 4
                    full = n // capacity * capacity
                    for start in range(0, full, capacity):
                        whole.append((i, start, capacity, n, sequence, 0, raw[4 * start : 4 * (start + capacity)]))
                        sequence += 1
                    if n > full:
                        rest.append((i, full, raw[4 * full :], n))
                        held += n - full
                n_rows += len(raws)
                yield from emit(whole)
                if held >= GROUP_TOKENS:
                    yield from flush()
                    tables, n_rows = [], 0
        yield from flush()

    return source.mapInArrow(run, f"{fields}, {PIECES}" if fields else PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(common.read(spark, sf_dir, "documents").select("doc_id", "text")))
