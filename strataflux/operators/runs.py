"""Runs, deltas and change bits as ordered scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflux.operators.scan import WIDTH, FillForward, Previous, RunningSum, scan


def running_sum_with_reset(df: DataFrame, part: list[str], order: list[str], value: str, reset: Column,
                           out: str = "level", width: int | None = WIDTH) -> DataFrame:
    """Sum since the latest reset row, that row included."""
    done = scan(
        df.withColumn("_reset", reset),
        part, order,
        {"_sum": RunningSum(F.col(value))},
        {"_base": FillForward(F.when(F.col("_reset"), F.col("_sum") - F.col(value)))},
        width=width,
    )
    return done.withColumn(out, F.col("_sum") - F.coalesce(F.col("_base"), F.lit(0))).drop("_reset", "_sum", "_base")


def delta_decode(df: DataFrame, part: list[str], order: list[str], delta: str, reset: Column | None = None,
                 out: str = "level", width: int | None = WIDTH) -> DataFrame:
    """Levels from differences; each part has its own predictor, cleared at a reset row."""
    if reset is None:
        return scan(df, part, order, {out: RunningSum(F.col(delta))}, width=width)
    return running_sum_with_reset(df, part, order, delta, reset, out, width)


def delta_encode(df: DataFrame, part: list[str], order: list[str], value: str, out: str = "delta",
                 width: int | None = WIDTH) -> DataFrame:
    """Difference to the row before; the first row keeps its value."""
    done = scan(df, part, order, {"_prev": Previous(F.col(value), 0)}, width=width)
    return done.withColumn(out, F.col(value) - F.col("_prev")).drop("_prev")


def wrapped_sum(df: DataFrame, part: list[str], order: list[str], delta: str, lim: int, out: str = "vec",
                width: int | None = WIDTH) -> DataFrame:
    """Running sum folded into [-lim, lim - 1]; equal to wrapping each step while |step| <= lim."""
    done = scan(df, part, order, {"_sum": RunningSum(F.col(delta))}, width=width)
    return done.withColumn(out, F.pmod(F.col("_sum") + lim, F.lit(2 * lim)) - lim).drop("_sum")


def motion_delta(code: Column, residual: Column, r_size: int) -> Column:
    """Signed step of a motion code and its residual; code 0 means no step."""
    span = 1 << r_size
    size = (F.abs(code) - 1) * span + residual + 1
    return F.when(code == 0, F.lit(0)).otherwise(F.signum(code).cast("bigint") * size)


def islands(df: DataFrame, part: list[str], order: list[str], value: str, out: str = "run_start",
            width: int | None = WIDTH) -> DataFrame:
    """Mark every row with the order value at which its run of equal values begins."""
    first = F.col("_prev").isNull() | ~F.col("_prev").getField("v").eqNullSafe(F.col(value))
    done = scan(
        df, part, order,
        {"_prev": Previous(F.struct(F.col(value).alias("v")))},
        {out: FillForward(F.when(first, F.col(order[0])))},
        width=width,
    )
    return done.drop("_prev")


def runs(df: DataFrame, part: list[str], order: str, value: str, max_len: int | None = None,
         width: int | None = WIDTH) -> DataFrame:
    """Gaps and islands: `(part, run_start, value, run_len)`, cut into pieces of `max_len`.

    The count per run is a partial aggregate, so a run that holds a third of all
    rows shuffles one row per task. With `max_len`, `run_start` counts in rows
    of the run, so the order column must be dense.
    """
    marked = islands(df.select(*part, order, value), part, [order], value, width=width)
    whole = marked.groupBy(*part, "run_start").agg(
        F.first(F.col(value)).alias(value), F.count(F.lit(1)).alias("run_len")
    )
    if max_len is None:
        return whole.select(*part, "run_start", value, "run_len")
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(run_len - 1) div {max_len}")))
    return whole.withColumn("_piece", cut).select(
        *part,
        (F.col("run_start") + F.col("_piece") * max_len).alias("run_start"),
        value,
        F.least(F.lit(max_len).cast("bigint"), F.col("run_len") - F.col("_piece") * max_len).alias("run_len"),
    )


def expand_runs(df: DataFrame, part: list[str], value: str, order: str = "pos") -> DataFrame:
    """Inverse of `runs` over a dense order column."""
    return df.select(
        *part,
        F.explode(F.sequence(F.col("run_start"), F.col("run_start") + F.col("run_len") - 1)).alias(order),
        value,
    )


def pattern_runs(df: DataFrame, part: list[str], order: str, value: str, size: int = 2,
                 width: int | None = WIDTH) -> DataFrame:
    """Runs of a repeating pattern of `size` values on a dense, zero-based order column."""
    slots = [F.max(F.when(F.col(order) % size == i, F.col(value))).alias(f"_v{i}") for i in range(size)]
    groups = df.groupBy(*part, F.expr(f"{order} div {size}").alias("unit")).agg(*slots)
    pattern = groups.select(
        *part, "unit", F.concat_ws(",", *[F.col(f"_v{i}").cast("string") for i in range(size)]).alias("pattern")
    )
    return runs(pattern, part, "unit", "pattern", width=width)


def text_runs(text: Column) -> Column:
    """Runs of one character inside a string, as an array of pieces; no shuffle is needed."""
    return F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*)"), F.lit(1))


def repeated_lines(df: DataFrame, part: list[str], order: str, line: str, max_len: int = 256,
                   width: int | None = WIDTH) -> DataFrame:
    """Stretches of lines equal to the line above, cut at `max_len`."""
    hashed = df.select(*part, order, F.struct(F.xxhash64(line).alias("h"), F.col(line).alias("t")).alias("_line"))
    found = runs(hashed, part, order, "_line", max_len=max_len, width=width)
    return found.where(F.col("run_len") > 1).select(
        *part, "run_start", "run_len", F.col("_line.t").alias(line)
    )


def change_pack(df: DataFrame, part: list[str], order: str, value: str,
                width: int | None = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Keep a byte only where it differs from the byte before (0 before the first).

    Returns the kept bytes with their ordinal, from 1, and the change bitmap,
    eight positions to a byte, first position in the high bit.
    """
    marked = scan(
        df.select(*part, order, value), part, [order],
        {"_prev": Previous(F.col(value), 0), "_n": RunningSum(F.lit(1).cast("bigint"))},
        width=width,
    ).withColumn("_flag", (F.col(value) != F.col("_prev")).cast("bigint")).withColumn("pos", F.col("_n") - 1)
    numbered = scan(marked, part, [order], {"ordinal": RunningSum(F.col("_flag"))}, width=width)
    kept = numbered.where(F.col("_flag") == 1).select(*part, "ordinal", "pos", F.col(value).alias("val"))
    bitmap = marked.groupBy(*part, F.expr("pos div 8").alias("byte_no")).agg(
        F.sum(F.col("_flag") * F.expr("cast(shiftleft(1, cast(7 - pos % 8 as int)) as bigint)")).alias("bits"),
        F.count(F.lit(1)).alias("n_pos"),
    )
    return kept, bitmap


def change_unpack(kept: DataFrame, bitmap: DataFrame, part: list[str], width: int | None = WIDTH) -> DataFrame:
    """Rebuild `(part, pos, val)` from kept bytes and bitmap.

    Only changed positions look up a kept byte, one to one, and the rest fill
    forward. An unchanged position joins under a key of its own that no kept
    byte has, so a long unchanged stretch is not one join key.
    """
    flags = bitmap.select(
        *part,
        F.explode(
            F.expr(
                "transform(sequence(cast(0 as bigint), n_pos - 1),"
                " i -> struct(byte_no * 8 + i as pos,"
                " cast(shiftright(bits, cast(7 - i as int)) & 1 as bigint) as flag))"
            )
        ).alias("_e"),
    ).select(*part, "_e.pos", "_e.flag")
    numbered = scan(flags, part, ["pos"], {"ordinal": RunningSum(F.col("flag"))}, width=width)
    keyed = numbered.select(*part, "pos", F.when(F.col("flag") == 1, F.col("ordinal")).otherwise(-1 - F.col("pos")).alias("ordinal"))
    found = keyed.join(kept.select(*part, "ordinal", "val"), [*part, "ordinal"], "left")
    filled = scan(found, part, ["pos"], {"_v": FillForward(F.col("val"))}, width=width)
    return filled.select(*part, "pos", F.coalesce("_v", F.lit(0)).alias("val"))


def fixup_offsets(df: DataFrame, part: list[str], order: str, byte: str, start: Column | None = None,
                  width: int | None = WIDTH) -> DataFrame:
    """Offsets of fix-ups from delta bytes: 0 ends the list, 1 moves on by 254, others mark."""
    b = F.col(byte)
    stepped = scan(
        df, part, [order],
        {"_moved": RunningSum(F.when(b == 1, 254).otherwise(b)), "_ended": RunningSum((b == 0).cast("bigint"))},
        width=width,
    )
    base = F.lit(0) if start is None else start
    return stepped.where((F.col("_ended") == 0) & (b > 1)).select(
        *part, order, (base + F.col("_moved")).cast("bigint").alias("offset")
    )
