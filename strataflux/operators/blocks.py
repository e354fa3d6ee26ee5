"""8 x 8 coefficient blocks `(img, comp, by, bx, k, coef)`, k in zigzag order."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from strataflux.functions.media import size_category
from strataflux.operators.scan import WIDTH, Previous, scan

SIDE = 8
AREA = 64
BLOCK = ["img", "comp", "by", "bx"]

# Place of the k-th zigzag coefficient in row order: diagonals in turn, odd ones downward.
NATURAL = sorted(range(AREA), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else -(p // 8)))
ZIGZAG = [NATURAL.index(p) for p in range(AREA)]

# The sample luminance quantization table, in row order.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]

# The sample chrominance quantization table, in row order.
CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]


def component_class(comp: Column) -> Column:
    return F.when(comp == 0, "luminance").otherwise("chrominance")


def _lookup(values: list[int], at: Column) -> Column:
    """Entry of a short fixed list, kept as a literal in the plan."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int")).cast("bigint")


def natural(df: DataFrame) -> DataFrame:
    """Zigzag `k` to place in the block, row by row."""
    return df.withColumn("k", _lookup(NATURAL, F.col("k")))


def zigzag(df: DataFrame) -> DataFrame:
    """Place in the block to zigzag `k`."""
    return df.withColumn("k", _lookup(ZIGZAG, F.col("k")))


# --- lossless transforms -------------------------------------------------

KINDS = {
    # transpose first, then mirror left-right, then mirror top-bottom
    "none": (False, False, False), "flip_h": (False, True, False), "flip_v": (False, False, True),
    "transpose": (True, False, False), "transverse": (True, True, True),
    "rot_90": (True, True, False), "rot_180": (False, True, True), "rot_270": (True, False, True),
}


def transform(df: DataFrame, kind: str, width: int | Column, height: int | Column, trim: bool = False) -> DataFrame:
    """Flip, transpose or rotate images of width x height pixels by moving blocks and changing signs.

    A mirror moves whole tiles only: a partial tile at the far edge stays where
    it is, or is dropped with `trim`. Coefficients of odd frequency along a
    mirrored axis change sign.
    """
    swap, mirror_x, mirror_y = KINDS[kind]
    width, height = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    place = _lookup(NATURAL, F.col("k"))
    v, u = F.shiftright(place, 3), place % SIDE
    by, bx = F.col("by"), F.col("bx")
    if swap:
        v, u, by, bx, width, height = u, v, bx, by, height, width
    full_x, full_y = F.floor(width / SIDE).cast("bigint"), F.floor(height / SIDE).cast("bigint")
    keep, sign = F.lit(True), F.lit(1)
    if mirror_x:
        whole = bx < full_x
        sign = sign * F.when(whole & (u % 2 == 1), -1).otherwise(1)
        keep = keep & whole
        bx = F.when(whole, full_x - 1 - bx).otherwise(bx)
    if mirror_y:
        whole = by < full_y
        sign = sign * F.when(whole & (v % 2 == 1), -1).otherwise(1)
        keep = keep & whole
        by = F.when(whole, full_y - 1 - by).otherwise(by)
    moved = df.select("img", "comp", by.alias("by"), bx.alias("bx"), _lookup(ZIGZAG, v * SIDE + u).alias("k"),
                      (F.col("coef") * sign).alias("coef"), keep.alias("_keep"))
    return (moved.where("_keep") if trim else moved).drop("_keep")


def parse_region(spec: str, width: int, height: int) -> tuple[int, int, int, int]:
    """`WxH+X+Y` as first tile, tile count per axis: (x, y, nx, ny).

    Missing sizes reach to the edge; a minus offset counts from the far edge.
    The start moves up and left to a tile edge, the far corner stays.
    """
    hit = re.fullmatch(r"(?:(\d+))?(?:x(\d+))?(?:([+-]\d+)(?:([+-]\d+))?)?", spec)
    if not hit or not spec:
        raise ValueError(f"bad region {spec!r}")

    def axis(size_text, off_text, total):
        off = int(off_text or 0)
        size = int(size_text) if size_text else total - abs(off)
        start = off if off_text is None or off_text[0] == "+" else total - size + off
        if size <= 0 or start < 0 or start + size > total:
            raise ValueError(f"region {spec!r} leaves the image")
        return start // SIDE, -(-(start % SIDE + size) // SIDE)

    (x, nx), (y, ny) = axis(hit[1], hit[3], width), axis(hit[2], hit[4], height)
    return x, y, nx, ny


def _inside(region):
    x, y, nx, ny = region
    return (F.col("bx") >= x) & (F.col("bx") < x + nx) & (F.col("by") >= y) & (F.col("by") < y + ny)


def crop(df: DataFrame, spec: str, width: int, height: int) -> DataFrame:
    region = parse_region(spec, width, height)
    return df.where(_inside(region)).withColumn("bx", F.col("bx") - region[0]).withColumn("by", F.col("by") - region[1])


def wipe(df: DataFrame, spec: str, width: int, height: int) -> DataFrame:
    """Zero inside the region, keep outside."""
    return df.withColumn("coef", F.when(_inside(parse_region(spec, width, height)), 0).otherwise(F.col("coef")).cast("bigint"))


def resize_coefs(df: DataFrame, n: int) -> DataFrame:
    """Keep the n x n low frequencies of every block."""
    place = _lookup(NATURAL, F.col("k"))
    return df.where((F.shiftright(place, 3) < n) & (place % SIDE < n))


def drop_chroma(df: DataFrame) -> DataFrame:
    return df.where("comp = 0")


# --- transform and quantization ------------------------------------------

def cosine_basis() -> np.ndarray:
    """64 x 64 matrix: coefficient (row order) by sample (row order)."""
    line = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1.0) / 2 for x in range(8)] for u in range(8)])
    return np.kron(line, line)


def block_transform(samples: DataFrame, value: str, basis: np.ndarray | None = None) -> DataFrame:
    """Coefficients of level-shifted samples `(img, comp, y, x, value)`, k in row order.

    A block brings its 64 samples to one row; the product with the basis runs
    on Arrow batches of blocks. Samples missing from a partial block count as mid-grey.
    """
    matrix = (cosine_basis() if basis is None else basis).T

    @F.pandas_udf(ArrayType(DoubleType()))
    def product(at: pd.Series, level: pd.Series) -> pd.Series:
        dense = np.zeros((len(at), AREA))
        if len(at):
            rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
            dense[rows, np.concatenate(at.to_numpy())] = np.concatenate(level.to_numpy())
        return pd.Series(list(dense @ matrix))

    blocks = samples.groupBy("img", "comp", F.expr("y div 8").alias("by"), F.expr("x div 8").alias("bx")).agg(
        F.collect_list(F.struct(F.expr("cast(y % 8 * 8 + x % 8 as int)").alias("at"), (F.col(value) - 128).cast("double").alias("v"))).alias("_s"))
    return blocks.select(*BLOCK, F.posexplode(product(F.col("_s.at"), F.col("_s.v"))).alias("k", "coef")).withColumn("k", F.col("k").cast("bigint"))


def quantize(df: DataFrame, table: list[int], coef: str = "coef") -> DataFrame:
    """Divide by the table entry of row-order place k, rounding half away from zero."""
    return _divided(df, _lookup(table, F.col("k")), coef)


def _divided(df: DataFrame, q: Column, coef: str) -> DataFrame:
    c = F.col(coef)
    size = F.floor((F.abs(c) + F.shiftright(q, 1)) / q).cast("bigint")
    return df.withColumn(coef, F.when(c < 0, -size).otherwise(size))


def quantize_components(df: DataFrame, luminance: list[int], chrominance: list[int], big_gamut: bool = False, coef: str = "coef") -> DataFrame:
    """`quantize` with one table for component 0 and one for the others.

    Big-gamut colour keeps the usual chroma samples and doubles the steps of their
    coefficients instead.
    """
    steps = [v * (2 if big_gamut else 1) for v in chrominance]
    table = F.when(F.col("comp") == 0, _lookup(luminance, F.col("k"))).otherwise(_lookup(steps, F.col("k")))
    return _divided(df, table, coef)


def dequantize_components(df: DataFrame, luminance: list[int], chrominance: list[int], coef: str = "coef") -> DataFrame:
    """Product with the nominal tables; big-gamut chroma stays at half scale, for the doubled gains of `ycc_to_rgb`."""
    return df.withColumn(coef, F.col(coef) * F.when(F.col("comp") == 0, _lookup(luminance, F.col("k"))).otherwise(_lookup(chrominance, F.col("k"))))


def dequantize(df: DataFrame, table: list[int], coef: str = "coef") -> DataFrame:
    return df.withColumn(coef, F.col(coef) * _lookup(table, F.col("k")))


# --- symbol statistics ---------------------------------------------------

def zero_runs(df: DataFrame) -> DataFrame:
    """Non-zero AC coefficients with the zeros before them; a block is at most 63 rows."""
    order = W.partitionBy(*BLOCK).orderBy("k")
    hits = df.where("k > 0 and coef <> 0")
    return hits.withColumn("run", F.col("k") - F.lag("k", 1, 0).over(order) - 1)


def dc_differences(df: DataFrame, blocks_per_row: int, width: int | None = WIDTH) -> DataFrame:
    """First coefficient of each block minus that of the block before, per image and component."""
    dc = df.where("k = 0").select(*BLOCK, F.col("coef"), (F.col("by") * blocks_per_row + F.col("bx")).alias("_n"))
    done = scan(dc, ["img", "comp"], ["_n"], {"_prev": Previous(F.col("coef"), 0)}, width=width)
    return done.select(*BLOCK, (F.col("coef") - F.col("_prev")).alias("diff"))


def symbol_stats(df: DataFrame, blocks_per_row: int, width: int | None = WIDTH, by_class: bool = False) -> DataFrame:
    """`(tbl, symbol, cnt)` over the corpus: DC size categories, AC run/size codes, 0xF0 and end of block.

    `by_class` counts luminance and chrominance apart, in a first column `cls`.
    """
    cls = [component_class(F.col("comp")).alias("cls")] if by_class else []

    def symbols(found, tbl, symbol, n):
        return found.select(*cls, F.lit(tbl).alias("tbl"), symbol.cast("bigint").alias("symbol"), n.cast("bigint").alias("n"))

    runs = zero_runs(df)
    last = df.groupBy(*BLOCK).agg(F.max(F.when(F.expr("k > 0 and coef <> 0"), F.col("k"))).alias("last"))
    every = [
        symbols(dc_differences(df, blocks_per_row, width), "dc", size_category(F.col("diff")), F.lit(1)),
        symbols(runs, "ac", F.col("run") % 16 * 16 + size_category(F.col("coef")), F.lit(1)),
        symbols(runs.where("run > 15"), "ac", F.lit(240), F.expr("run div 16")),
        symbols(last.where("last is null or last < 63"), "ac", F.lit(0), F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, every).groupBy(*["cls"] * by_class, "tbl", "symbol").agg(F.sum("n").alias("cnt"))


# The default code tables. Codes of 1 to 16 bits, then symbols in code order;
# AC symbols that are not named (run 0-15, size 1-10, 00 and F0 exist) follow in rising order.
DEFAULT_CODES = {
    ("luminance", "dc"): ("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    ("chrominance", "dc"): ("0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", "00 01 02 03 04 05 06 07 08 09 0a 0b"),
    ("luminance", "ac"): ("0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125", """
        01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08
        23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"""),
    ("chrominance", "ac"): ("0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119", """
        00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91
        a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"""),
}


def default_lengths(cls: str, tbl: str) -> dict[int, int]:
    """Code length of every symbol of a default table."""
    counts, named = DEFAULT_CODES[cls, tbl]
    order = [int(s, 16) for s in named.split()]
    if tbl == "ac":
        every = {0x00, 0xF0} | {run * 16 + size for run in range(16) for size in range(1, 11)}
        order += sorted(every - set(order))
    lengths = [n + 1 for n, count in enumerate(counts.split()) for _ in range(int(count))]
    return dict(zip(order, lengths, strict=True))


def default_code_lengths(spark: SparkSession) -> DataFrame:
    """`(cls, tbl, symbol, len)` of the four default tables, 348 rows."""
    rows = [(*key, symbol, n) for key in DEFAULT_CODES for symbol, n in default_lengths(*key).items()]
    return spark.createDataFrame(rows, "cls string, tbl string, symbol bigint, len bigint")


def default_cost(symbols: DataFrame) -> DataFrame:
    """Bits of each class and table with the default codes against the best codes for these counts.

    `symbols` counts by class. `uncoded` counts occurrences of symbols without a default
    code (sizes that 8-bit samples do not reach); both sums leave them out.
    """
    def price(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows[rows["len"].notna()]
        best = _lengths(dict(zip(known["symbol"].tolist(), known["cnt"].tolist()))) if len(known) else {}
        sums = (known["cnt"] * known["len"]).sum(), (known["cnt"] * known["symbol"].map(best)).sum(), rows.loc[rows["len"].isna(), "cnt"].sum()
        return pd.DataFrame([(rows["cls"].iloc[0], rows["tbl"].iloc[0], *map(int, sums))], columns=["cls", "tbl", "default_bits", "optimal_bits", "uncoded"])

    lengths = F.broadcast(default_code_lengths(symbols.sparkSession))  # 348 rows
    # a table brings at most 256 rows
    return symbols.join(lengths, ["cls", "tbl", "symbol"], "left").groupBy("cls", "tbl").applyInPandas(
        price, "cls string, tbl string, default_bits bigint, optimal_bits bigint, uncoded bigint")


LONGEST = 16
PSEUDO = 256


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code length per symbol: optimal merging with a reserved pseudo-symbol, then the 16-bit limit.

    Of equal counts the larger symbol is merged first, and a merged node keeps
    the number of the one taken first.
    """
    heap = [(n, -s, (s,)) for s, n in counts.items() if n > 0] + [(1, -PSEUDO, (PSEUDO,))]
    heapq.heapify(heap)
    depth = Counter()
    while len(heap) > 1:
        n1, label, left = heapq.heappop(heap)
        n2, _, right = heapq.heappop(heap)
        depth.update(left + right)
        heapq.heappush(heap, (n1 + n2, label, left + right))
    per_length = Counter(depth.values())
    for length in range(max(per_length, default=0), LONGEST, -1):
        while per_length[length]:
            # a pair at this length shares its prefix: one takes the prefix, the
            # other moves below a shorter code, which gives way to two
            host = max(k for k in range(1, length - 1) if per_length[k])
            per_length[length] -= 2
            per_length[length - 1] += 1
            per_length[host] -= 1
            per_length[host + 1] += 2
    per_length[max(k for k, v in per_length.items() if v)] -= 1
    ranked = sorted((s for s in depth if s != PSEUDO), key=lambda s: (depth[s], s))
    spread = [k for k in sorted(per_length) for _ in range(per_length[k])]
    return dict(zip(ranked, spread))


def code_lengths(symbols: DataFrame) -> DataFrame:
    """`(tbl, symbol, len)`; a table brings at most 256 rows to one task."""
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        got = _lengths(dict(zip(rows["symbol"].tolist(), rows["cnt"].tolist())))
        return pd.DataFrame({"tbl": rows["tbl"].iloc[0], "symbol": list(got), "len": list(got.values())})

    return symbols.groupBy("tbl").applyInPandas(build, "tbl string, symbol bigint, len bigint")


def coding_cost(symbols: DataFrame, lengths: DataFrame, flat_bits: int = 8) -> DataFrame:
    """Bits per table with the given code lengths, and with a flat code."""
    return symbols.join(lengths, ["tbl", "symbol"]).groupBy("tbl").agg(
        F.sum(F.col("cnt") * F.col("len")).alias("bits"), F.sum(F.col("cnt") * flat_bits).alias("flat_bits"))
