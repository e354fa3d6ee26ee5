"""Ordered scans that stay parallel inside one hot key.

A plain window `partitionBy(part).orderBy(pos)` sends every row of a key to one
task. Here the order axis is cut into chunks of a fixed width, rows are
windowed by `(part, chunk)`, and what has to cross a chunk edge travels through
a table with one row per chunk:

1. per chunk, a mergeable summary (sum, last value, ...) by partial aggregation;
2. a window over the chunk table turns the summaries into carries;
3. the carries join back on `(part, chunk)`, the keys the rows are already
   shuffled by, so the large side moves once.

With a unique integral order column a chunk holds at most `width` rows whatever
the skew. Partition and order columns must not be null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = "_chunk"
WIDTH = 1 << 16
_FIRST = "_first"
_LAST = "_last"
_HELD = "_held"

_before = (W.unboundedPreceding, -1)
_upto = (W.unboundedPreceding, 0)


@dataclass(frozen=True)
class RunningSum:
    """Inclusive sum up to the current row."""

    value: Column

    def summary(self, key: Column) -> Column:
        return F.sum(F.coalesce(self.value, F.lit(0)))

    def carry(self, total: Column, chunks) -> Column:
        return F.sum(total).over(chunks.rowsBetween(*_before))

    def local(self, rows) -> Column:
        return F.sum(F.coalesce(self.value, F.lit(0))).over(rows.rowsBetween(*_upto))

    def merge(self, local: Column, carry: Column) -> Column:
        return local + F.coalesce(carry, F.lit(0))


@dataclass(frozen=True)
class FillForward:
    """Last non-null value up to the current row; `strict` leaves the current row out."""

    value: Column
    strict: bool = False

    def summary(self, key: Column) -> Column:
        return F.max_by(self.value, F.when(self.value.isNotNull(), key))

    def carry(self, total: Column, chunks) -> Column:
        return F.last(total, ignorenulls=True).over(chunks.rowsBetween(*_before))

    def local(self, rows) -> Column:
        return F.last(self.value, ignorenulls=True).over(rows.rowsBetween(*(_before if self.strict else _upto)))

    def merge(self, local: Column, carry: Column) -> Column:
        return F.coalesce(local, carry)


@dataclass(frozen=True)
class FillBackward:
    """First non-null value after the current row.

    Read from the far end: a frame that runs to the last row is evaluated anew
    for every row, one that starts at the first row only grows.
    """

    value: Column
    backward = True

    def summary(self, key: Column) -> Column:
        return F.min_by(self.value, F.when(self.value.isNotNull(), key))

    def carry(self, total: Column, chunks) -> Column:
        return F.last(total, ignorenulls=True).over(chunks.rowsBetween(*_before))

    def local(self, rows) -> Column:
        return F.last(self.value, ignorenulls=True).over(rows.rowsBetween(*_before))

    def merge(self, local: Column, carry: Column) -> Column:
        return F.coalesce(local, carry)


@dataclass(frozen=True)
class Previous:
    """Value of the row before, null or `default` on the first row of a part."""

    value: Column
    default: object = None

    def summary(self, key: Column) -> Column:
        return F.max_by(self.value, key)

    def carry(self, total: Column, chunks) -> Column:
        return F.lag(total, 1, self.default).over(chunks)

    def local(self, rows) -> Column:
        return F.lag(self.value, 1).over(rows)

    def merge(self, local: Column, carry: Column) -> Column:
        return F.when(F.col(_FIRST), carry).otherwise(local)


@dataclass(frozen=True)
class Following:
    """Value of the row after, null or `default` on the last row of a part."""

    value: Column
    default: object = None

    def summary(self, key: Column) -> Column:
        return F.min_by(self.value, key)

    def carry(self, total: Column, chunks) -> Column:
        return F.lead(total, 1, self.default).over(chunks)

    def local(self, rows) -> Column:
        return F.lead(self.value, 1).over(rows)

    def merge(self, local: Column, carry: Column) -> Column:
        return F.when(F.col(_LAST), carry).otherwise(local)


def scan(df: DataFrame, part: list[str], order: list[str], *stages: dict, width: int | None = WIDTH) -> DataFrame:
    """Add the ordered columns of each stage; a stage may read those of the stage before.

    `width` is the span of the leading order column per chunk; None makes every
    distinct leading value its own chunk.
    """
    if not part:
        raise ValueError("a scan needs a partition column; a global order would be one task")
    key = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    lead = F.col(order[0])
    cur = df.withColumn(CHUNK, lead if width is None else F.floor(lead / F.lit(width)).cast("bigint"))
    rows = W.partitionBy(*part, CHUNK).orderBy(*order)
    chunks = W.partitionBy(*part).orderBy(CHUNK)
    back_rows = W.partitionBy(*part, CHUNK).orderBy(*[F.desc(c) for c in order])
    back_chunks = W.partitionBy(*part).orderBy(F.desc(CHUNK))

    def way(step, forward, backward):
        return backward if getattr(step, "backward", False) else forward

    for stage in stages:
        names = list(stage)
        summary = cur.groupBy(*part, CHUNK).agg(*[stage[n].summary(key).alias(f"_s_{n}") for n in names])
        carries = summary.select(
            *part, CHUNK, *[stage[n].carry(F.col(f"_s_{n}"), way(stage[n], chunks, back_chunks)).alias(f"_c_{n}") for n in names]
        )
        local = [stage[n].local(way(stage[n], rows, back_rows)).alias(f"_l_{n}") for n in names]
        if any(isinstance(s, Previous) for s in stage.values()):
            local.append(F.lag(F.lit(1)).over(rows).isNull().alias(_FIRST))
        if any(isinstance(s, Following) for s in stage.values()):
            local.append(F.lead(F.lit(1)).over(rows).isNull().alias(_LAST))
        kept = [c for c in cur.columns if c not in names]
        cur = (
            cur.select("*", *local)
            .join(carries, [*part, CHUNK], "left")
            .select(*kept, *[stage[n].merge(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in names])
        )
    return cur.drop(CHUNK)


def chunk_width(df: DataFrame, lead: str, rows_per_chunk: int = WIDTH) -> int:
    """Width that gives chunks of about `rows_per_chunk` rows on a sparse integral axis.

    Reads one row of statistics; parquet footers answer it without a scan.
    """
    low, high, n = df.agg(F.min(lead), F.max(lead), F.count(lead)).first()
    if not n:
        return rows_per_chunk
    return max(1, int((high - low + 1) * rows_per_chunk // n))


def hold(df: DataFrame, **cols) -> DataFrame:
    """Add columns that later filters cannot copy below this point.

    A filter on a derived column is otherwise pushed down with the whole
    expression inlined at each use, which array functions then evaluate again.
    The values are computed in a projection of their own, below the generator:
    inside a generator that the engine does not compile they would be interpreted.
    The outer form: before the plain one the engine puts a filter on the size of the
    array, which computes all values twice.
    """
    made = df.select("*", F.array(F.struct(*[c.alias(n) for n, c in cols.items()])).alias(_HELD))
    return made.select(*df.columns, F.inline_outer(_HELD))
