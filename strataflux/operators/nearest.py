"""Nearest centroid of every vector, for any number of centroids, exactly.

A bounded set of centroids, the pivots, cuts the others into cells: a centroid
belongs to its nearest pivot, and a cell's radius is its farthest member. A vector
has a centroid at least as near as its nearest pivot, so by the triangle inequality
a cell can be left out when the distance to its pivot less its radius is larger.
Vectors meet the centroids of the remaining cells block by block: rows of both sides
are dealt by (cell, block, salt), centroids first, so a task holds one block and
streams the vectors past it. Equal vectors are looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIVOTS = 256
BLOCK = 1024
SPREAD = 16  # tasks that the vectors of one block are dealt to, whatever their number
SLACK = 1e-9  # of the distances: far above their rounding


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls as doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    return ((vectors - point) ** 2).sum(axis=1)


def closest(vectors: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the first nearest point.

    A matrix product bounds the distances of 256 vectors at a time; only points that
    its rounding leaves in question are measured, as `squared` does.
    """
    at, least = np.zeros(len(vectors), np.int64), np.full(len(vectors), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        lengths = np.sqrt((points**2).sum(axis=1))
        for start in range(0, len(vectors), 256):
            part = vectors[start:start + 256]
            own = np.sqrt((part**2).sum(axis=1, keepdims=True))
            size = (own + lengths) ** 2
            rough = own**2 + lengths**2 - 2 * (part @ points.T)
            slack = size * ((points.shape[1] + 8) * 1e-15) + 1e-290
            if len(points) and np.isfinite(size).all() and np.isfinite(rough).all():
                row, point = np.nonzero(rough - slack <= (rough + slack).min(axis=1, keepdims=True))
                d = squared(part[row], points[point])
                order = np.lexsort((point, d, row))
                first = order[np.unique(row[order], return_index=True)[1]]
                at[start:start + 256], least[start:start + 256] = point[first], d[first]
            else:
                at[start:start + 256], least[start:start + 256] = _closest_by_point(part, points)
    return at, least


def _closest_by_point(vectors: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same one point at a time, for numbers whose squares overflow."""
    at, least = np.zeros(len(vectors), np.int64), np.full(len(vectors), np.inf)
    for i, point in enumerate(points):
        d = squared(vectors, point)
        better = d < least
        at[better], least[better] = i, d[better]
    return at, least


def _cells(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, d = closest(matrix(batch.column(1)), pivots)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at), pa.array(np.sqrt(d))], names=["key", "v", "cell", "away"])

    return run


def _candidates(pivots: np.ndarray, radius: np.ndarray, blocks: np.ndarray):
    """Rows (v, cell, block) for every block of a cell that may hold a vector's nearest centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # at most 256 x all blocks rows at once
                part = batch.column(0).slice(start, 256)
                v = matrix(part)
                away = np.sqrt(np.stack([squared(v, p) for p in pivots], axis=1))
                upper = away.min(axis=1, keepdims=True)
                row, cell = np.nonzero(away - radius <= upper + SLACK * (away + radius + upper))
                times = blocks[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([part.take(pa.array(row)), pa.array(cell), pa.array(block)], names=["v", "cell", "block"])

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, dist, key) of each vector's best in its block; the centroids of a block come before its vectors."""
    group, keys, points, ready = None, [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)  # cell, block, salt, kind
        edges = np.flatnonzero(np.any(ids[1:] != ids[:-1], axis=1)) + 1
        for start, stop in zip([0, *edges], [*edges, len(ids)]):
            rows, part = batch.slice(start, stop - start), tuple(ids[start, :3])
            if part != group:
                group, keys, points, ready = part, [], [], None
            v = matrix(rows.column(5))
            if ids[start, 3] == 0:
                keys.append(rows.column(4).to_numpy())
                points.append(v)
                continue
            if not points:  # a block that got no centroid by hash
                continue
            if ready is None:
                order = np.argsort(np.concatenate(keys), kind="stable")
                ready = np.concatenate(keys)[order], np.concatenate(points)[order]
            at, d = closest(v, ready[1])
            yield pa.RecordBatch.from_arrays([rows.column(5), pa.array(d), pa.array(ready[0][at])], names=["v", "dist", "key"])


def usable(vector: str):
    """A vector without nulls and with finite parts only; others have no nearest centroid."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size(vector) > 0), F.lit(False))


def nearest_by_cells(vectors: DataFrame, centroids: DataFrame, vec: str, key: str, centroid: str = "centroid", pivots: int = PIVOTS, block: int = BLOCK, spread: int = SPREAD) -> DataFrame:
    """`vectors` without `vec` and with `nearest`, the key of the nearest centroid; the least key of equal distances.

    Keys are unique whole numbers. Null vectors, and vectors with parts that are null
    or not finite, get null, and so do all vectors when there is no centroid;
    centroids of that kind are ignored. Repeated vectors keep their rows.
    """
    points = centroids.select(F.col(key).cast("bigint").alias("key"), F.col(centroid).cast("array<double>").alias("v")).where(usable("v"))
    rest = [F.col(c) for c in vectors.columns if c != vec]
    first = points.orderBy(F.xxhash64("key"), "key").limit(pivots).collect()  # at most `pivots` rows
    if not first:
        return vectors.select(*rest, F.lit(None).cast("bigint").alias("nearest"))
    table = np.array([r["v"] for r in first], np.float64)
    celled = points.mapInArrow(_cells(table), "key bigint, v array<double>, cell bigint, away double")
    radius, blocks = np.zeros(len(table)), np.zeros(len(table), np.int64)
    for r in celled.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row for a pivot
        radius[r["cell"]], blocks[r["cell"]] = r["radius"], -(-r["n"] // block)
    count = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), (F.col("cell") + 1).cast("int"))
    dealt = celled.select(
        "cell", F.pmod(F.xxhash64("key"), count.cast("bigint")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<bigint>")).alias("salt"),
        F.lit(0).cast("bigint").alias("kind"), "key", "v")
    values = vectors.select(F.col(vec).cast("array<double>").alias("v")).where(usable("v")).distinct()
    asked = values.mapInArrow(_candidates(table, radius, blocks), "v array<double>, cell bigint, block bigint").select(
        "cell", "block", F.pmod(F.xxhash64("v"), F.lit(spread)).cast("bigint").alias("salt"), F.lit(1).cast("bigint").alias("kind"), F.lit(None).cast("bigint").alias("key"), "v")
    place = ["cell", "block", "salt"]
    met = dealt.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "kind")
    best = met.mapInArrow(_search, "v array<double>, dist double, key bigint").groupBy("v").agg(F.min(F.struct("dist", "key")).alias("_best"))
    found = best.select(F.col("v").alias("_v"), F.col("_best.key").alias("_nearest"))
    return vectors.withColumn("_v", F.col(vec).cast("array<double>")).join(found, "_v", "left").select(*rest, F.col("_nearest").alias("nearest"))
