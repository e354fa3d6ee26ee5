"""Pixel tables `(img, y, x, r, g, b)`: colour, crop, scale, blend, histogram, palette.

Per-pixel work is column arithmetic in one stage. Work per image goes through
line or cell tables, which partial aggregation makes small before any shuffle,
so one huge image does not become one task. Image facts (size, crop box) are
one row per image and join back on the image key; AQE broadcasts them when they
are small and splits a skewed image when they are not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataflux.operators.nearest import closest, nearest_by_cells

RGB = ("r", "g", "b")

# Colour-space weights, 16-bit fixed point.
FIX = 1 << 16
HALF = FIX >> 1
CENTRE = 128
Y_R, Y_G, Y_B = 0.299, 0.587, 0.114
CB_R, CB_G, CB_B = -0.168735892, -0.331264108, 0.5
CR_R, CR_G, CR_B = 0.5, -0.418687589, -0.081312411
R_CR, G_CR, G_CB, B_CB = 1.402, -0.714136286, -0.344136286, 1.772


def _fix(x: float) -> int:
    return int(abs(x) * FIX + 0.5) * (1 if x >= 0 else -1)


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(255).cast("bigint"), c))


def _c(name: str) -> Column:
    return F.col(name).cast("bigint")


def _rest(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


# --- colour spaces -------------------------------------------------------

def rgb_to_ycc(df: DataFrame) -> DataFrame:
    r, g, b = (_c(n) for n in RGB)
    def mix(wr, wg, wb, off):
        return F.shiftright(r * _fix(wr) + g * _fix(wg) + b * _fix(wb) + off, 16)
    chroma = CENTRE * FIX + HALF - 1
    return df.select(
        *_rest(df, *RGB), mix(Y_R, Y_G, Y_B, HALF).alias("lum"),
        mix(CB_R, CB_G, CB_B, chroma).alias("cb"), mix(CR_R, CR_G, CR_B, chroma).alias("cr"),
    )


def rgb_to_grey(df: DataFrame) -> DataFrame:
    r, g, b = (_c(n) for n in RGB)
    return df.select(*_rest(df, *RGB), F.shiftright(r * _fix(Y_R) + g * _fix(Y_G) + b * _fix(Y_B) + HALF, 16).alias("grey"))


def grey_to_rgb(df: DataFrame) -> DataFrame:
    return df.select(*_rest(df, "grey"), *[F.col("grey").alias(n) for n in RGB])


def ycc_to_rgb(df: DataFrame, big_gamut: bool = False) -> DataFrame:
    """Inverse transform with clamping; the big-gamut form doubles the chroma gain."""
    gain = 2 if big_gamut else 1
    lum, cb, cr = _c("lum"), _c("cb") - CENTRE, _c("cr") - CENTRE
    red = lum + F.shiftright(cr * _fix(R_CR * gain) + HALF, 16)
    green = lum + F.shiftright(cb * _fix(G_CB * gain) + cr * _fix(G_CR * gain) + HALF, 16)
    blue = lum + F.shiftright(cb * _fix(B_CB * gain) + HALF, 16)
    return df.select(*_rest(df, "lum", "cb", "cr"), *[_clamp(v).alias(n) for n, v in zip(RGB, (red, green, blue))])


def rgb_to_rgb1(df: DataFrame) -> DataFrame:
    """Reversible transform: red and blue as differences to green, mod 256."""
    g = _c("g")
    return df.select(*_rest(df, *RGB), ((_c("r") - g + 128).bitwiseAND(255)).alias("r"), g.alias("g"),
                     ((_c("b") - g + 128).bitwiseAND(255)).alias("b"))


def rgb1_to_rgb(df: DataFrame) -> DataFrame:
    g = _c("g")
    return df.select(*_rest(df, *RGB), ((_c("r") + g - 128).bitwiseAND(255)).alias("r"), g.alias("g"),
                     ((_c("b") + g - 128).bitwiseAND(255)).alias("b"))


def gamma_chroma(df: DataFrame, gamma: float, chroma: float, ranges=(8, 4, 4), gains=(1, 0, 0, 1)) -> DataFrame:
    """Luminance gamma and chroma gain on reduced-range values, then RGB, truncated and clamped.

    `gains` weigh cr to red, cr to green, cb to green, cb to blue; the defaults
    are the whole-number parts of the usual weights.
    """
    def level(col, n):
        step = F.expr(f"(cast({col} as bigint) * {n} div 256) * 256 div {n}") + 256 // (2 * n)
        return step.cast("double")

    lum = F.pow(level("lum", ranges[0]) / 255, F.lit(1.0 / gamma)) * 255
    def gained(col, n):
        return F.greatest(F.lit(-128.0), F.least(F.lit(127.0), (level(col, n) - 128) * chroma))
    cr, cb = gained("cr", ranges[1]), gained("cb", ranges[2])
    red, green, blue = lum + cr * gains[0], lum + cr * gains[1] + cb * gains[2], lum + cb * gains[3]
    return df.select(*_rest(df, "lum", "cb", "cr"), *[
        F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("bigint").alias(n) for n, v in zip(RGB, (red, green, blue))])


# --- level mapping -------------------------------------------------------

def split_levels(colours: int) -> tuple[int, int, int]:
    """Levels per red, green, blue whose product stays within `colours`.

    Blue, which the eye resolves least, has the whole cube root. Red has one
    more where red and green can both have it; green takes what is left.
    """
    if colours < 8:
        raise ValueError("at least 8 colours are needed")
    blue = max(n for n in range(2, int(colours ** (1 / 3)) + 2) if n**3 <= colours)
    red = blue + (blue * (blue + 1) ** 2 <= colours)
    return red, colours // (red * blue), blue


def _level(v: Column, n: int) -> Column:
    """Index of the level whose interval, halfway to its neighbours, holds v."""
    top = n - 1
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(top).cast("bigint"), F.ceil((v * (2 * top) - (top + 255)) / 510).cast("bigint")))


def _level_value(j: Column, n: int) -> Column:
    return F.floor((j * 255 + (n - 1) // 2) / (n - 1)).cast("bigint")


def quantize_levels(df: DataFrame, levels: tuple[int, int, int], shift: dict | None = None) -> DataFrame:
    """Each component to its nearest level, plus the colour number `code`."""
    idx = {c: _level(_c(c) + (shift[c] if shift else F.lit(0)), n) for c, n in zip(RGB, levels)}
    code = (idx["r"] * levels[1] + idx["g"]) * levels[2] + idx["b"]
    return df.select(*_rest(df, *RGB), *[_level_value(idx[c], n).alias(c) for c, n in zip(RGB, levels)], code.alias("code"))


def dither_cell(y: Column, x: Column) -> Column:
    """Fill order 0..255 of a cell of the 16 x 16 ordered-dither matrix, from the bits of its place."""
    total = F.lit(0).cast("bigint")
    for bit in range(4):
        by, bx = F.shiftright(y, bit).bitwiseAND(1), F.shiftright(x, bit).bitwiseAND(1)
        total = total + (by.bitwiseXOR(bx) * 2 + bx) * (1 << (6 - 2 * bit))
    return total


def ordered_dither(df: DataFrame, levels: tuple[int, int, int]) -> DataFrame:
    """Add the matrix amount of a pixel's place, cut toward zero, before level mapping."""
    cell = dither_cell(_c("y"), _c("x"))
    shift = {c: ((255 - cell * 2) * 255 / (512 * (n - 1))).cast("bigint") for c, n in zip(RGB, levels)}
    return quantize_levels(df, levels, shift)


# --- geometry ------------------------------------------------------------

def image_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("img").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def with_size(df: DataFrame) -> DataFrame:
    return df.join(image_sizes(df), "img")


def rotate_px(df: DataFrame, quarter_turns: int = 1) -> DataFrame:
    """Clockwise quarter turns."""
    out = {0: ("y", "x"), 1: ("x", "h - 1 - y"), 2: ("h - 1 - y", "w - 1 - x"), 3: ("w - 1 - x", "y")}[quarter_turns % 4]
    return with_size(df).select("img", F.expr(out[0]).alias("y"), F.expr(out[1]).alias("x"), *RGB)


def flip_px(df: DataFrame, horizontal: bool = True) -> DataFrame:
    y, x = ("y", "w - 1 - x") if horizontal else ("h - 1 - y", "x")
    return with_size(df).select("img", F.expr(y).alias("y"), F.expr(x).alias("x"), *RGB)


def negate(df: DataFrame) -> DataFrame:
    return df.select(*_rest(df, *RGB), *[(255 - F.col(c)).alias(c) for c in RGB])


def sub_image(df: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    inside = (F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)
    return df.where(inside).withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def _spread(size_src: str, size_dst: int, pos: str) -> Column:
    """Destination places whose source place is `pos`; empty when shrinking skips it."""
    first = F.expr(f"({pos} * {size_dst} + {size_src} - 1) div {size_src}")
    last = F.expr(f"(({pos} + 1) * {size_dst} + {size_src} - 1) div {size_src} - 1")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def resize_nearest(df: DataFrame, w: int, h: int) -> DataFrame:
    """Nearest-sample resize: every source pixel knows the places it fills, so there is no grid join."""
    placed = with_size(df).withColumn("y2", F.explode(_spread("h", h, "y"))).withColumn("x2", F.explode(_spread("w", w, "x")))
    return placed.select("img", F.col("y2").alias("y"), F.col("x2").alias("x"), *RGB)


def replicate(df: DataFrame, h: int, v: int) -> DataFrame:
    """Up-sample: every pixel becomes h x v equal pixels."""
    return (
        df.withColumn("_dy", F.explode(F.sequence(F.lit(0), F.lit(v - 1)))).withColumn("_dx", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
        .withColumn("y", F.col("y") * v + F.col("_dy")).withColumn("x", F.col("x") * h + F.col("_dx")).drop("_dy", "_dx")
    )


def _edge_weight(pos: str, size: str, block: int) -> Column:
    """How often a pixel counts when the last line is repeated to fill its block."""
    fill = F.pmod(-F.col(size), F.lit(block))
    return F.when(F.col(pos) == F.col(size) - 1, fill + 1).otherwise(1)


def downsample(df: DataFrame, h: int, v: int, biased: bool = True) -> DataFrame:
    """Box mean of h x v pixels.

    2 x 2 and 2 x 1 blocks round with a bias that alternates along the row
    (1, 2 and 0, 1); other sizes, or `biased=False`, round half up.
    """
    weight = _edge_weight("x", "w", h) * _edge_weight("y", "h", v)
    sums = with_size(df).withColumn("_n", weight).groupBy(
        "img", F.expr(f"y div {v}").alias("y"), F.expr(f"x div {h}").alias("x")
    ).agg(*[F.sum(F.col(c) * F.col("_n")).alias(c) for c in RGB])
    area = h * v
    odd = F.col("x") % 2
    bias = odd + 1 if (h, v) == (2, 2) and biased else odd if (h, v) == (2, 1) and biased else F.lit(area // 2)
    return sums.select("img", "y", "x", *[F.floor((F.col(c) + bias) / area).cast("bigint").alias(c) for c in RGB])


def rescale(df: DataFrame, power: int) -> DataFrame:
    """Halve (negative) or double (positive) both sides `power` times; means round half up."""
    if power >= 0:
        return replicate(df, 1 << power, 1 << power)
    return downsample(df, 1 << -power, 1 << -power, biased=False)


def _taps(pos: str, size: str) -> Column:
    """Outputs a line reaches in 2:1 smoothing, as (place, member) pairs.

    Edge lines stand for the repeated lines beyond them too. A line is a member
    of its own output and a neighbour of the adjacent one.
    """
    half = f"(({size} + 1) div 2)"
    return F.expr(f"""
      filter(flatten(transform(
        concat(array({pos}), if({pos} = 0, array(-1L), array()),
               if({pos} = {size} - 1, sequence({size}, 2 * {half}), array())),
        p -> array(
          struct(if(p < 0, -1L, p div 2) as o, true as m),
          struct(if(p % 2 = 0, p div 2 - 1, (p + 1) div 2) as o, false as m)))),
        t -> t.o >= 0 and t.o < {half})""")


def smooth(df: DataFrame, factor: int) -> DataFrame:
    """2:1 down-sample in both directions with smoothing factor 0..100, edges repeated.

    Pixels are scattered with their weights and summed, instead of gathering
    sixteen neighbours per output by a join.
    """
    member, neighbour = 16384 - factor * 80, factor * 16
    tapped = (
        with_size(df).withColumn("_y", F.explode(_taps("y", "h"))).withColumn("_x", F.explode(_taps("x", "w")))
    )
    both, one = F.col("_y.m") & F.col("_x.m"), F.col("_y.m") | F.col("_x.m")
    weight = F.when(both, member).when(one, 2 * neighbour).otherwise(neighbour).cast("bigint")
    return tapped.groupBy("img", F.col("_y.o").alias("y"), F.col("_x.o").alias("x")).agg(
        *[F.shiftright(F.sum(F.col(c) * weight) + 32768, 16).alias(c) for c in RGB]
    )


def pad_blend(df: DataFrame, w: int, h: int, colour: tuple[int, int, int] = (0, 0, 0),
              background: DataFrame | None = None, opacity: int = 100) -> DataFrame:
    """Centre each image on a w x h canvas and blend it by opacity percent.

    The canvas is a plain colour, or a background table `(y, x, r, g, b)`.
    Rows of the canvas are spread over tasks before they are widened.
    """
    sizes = image_sizes(df)
    place = F.expr(f"y + cast(({h} - h) / 2 as bigint)"), F.expr(f"x + cast(({w} - w) / 2 as bigint)")
    front = df.join(sizes, "img").select(
        "img", place[0].alias("y"), place[1].alias("x"), *[F.col(c).alias("_" + c) for c in RGB]
    ).where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w))
    rows = sizes.select("img", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(h - 1).cast("bigint"))).alias("y"))
    grid = rows.repartition("img", "y").withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(w - 1).cast("bigint"))))
    if background is None:
        back = grid.select("*", *[F.lit(v).cast("bigint").alias(c) for c, v in zip(RGB, colour)])
    else:
        back = grid.join(background, ["y", "x"], "left").fillna(0, list(RGB))
    def mixed(c):
        # each share is cut to a whole number on its own
        return F.expr(f"_{c} * {opacity} div 100 + {c} * {100 - opacity} div 100")
    return back.join(front, ["img", "y", "x"], "left").select(
        "img", "y", "x", *[F.coalesce(mixed(c), F.col(c)).alias(c) for c in RGB])


# --- cropping ------------------------------------------------------------

def _cropped(df: DataFrame, box: DataFrame) -> DataFrame:
    inside = F.expr("y >= top and y < h - bottom and x >= left_ and x < w - right_")
    return df.join(box, "img").where(inside).select("img", (F.col("y") - F.col("top")).alias("y"), (F.col("x") - F.col("left_")).alias("x"), *RGB)


def _box(lines: DataFrame) -> DataFrame:
    """Crop box from `(img, axis, idx, size, keep_lo, keep_hi)` lines: strip until the first kept line, keep one."""
    def first(axis):
        on = F.col("axis") == axis
        size = F.max(F.when(on, F.col("size")))
        lo = F.least(F.coalesce(F.min(F.when(on & F.col("keep_lo"), F.col("idx"))), size), size - 1)
        hi = F.coalesce(F.min(F.when(on & F.col("keep_hi"), F.col("size") - 1 - F.col("idx"))), size)
        return size, lo, F.greatest(F.lit(0).cast("bigint"), F.least(hi, size - 1 - lo))
    h, top, bottom = first("y")
    w, left, right = first("x")
    return lines.groupBy("img").agg(
        h.alias("h"), top.alias("top"), bottom.alias("bottom"), w.alias("w"), left.alias("left_"), right.alias("right_"))


def crop_box(df: DataFrame) -> DataFrame:
    """Exact border box: lines that hold nothing but the colour of their edge's corner are border.

    Each pixel is read once per axis into a line table of (least, greatest,
    first) colour; corners and box come from that table.
    """
    colour = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    base = df.select("img", "y", "x", colour.alias("v"))
    rows = base.groupBy("img", F.col("y").alias("idx")).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.min_by("v", "x").alias("first"), F.max_by("v", "x").alias("last"))
    cols = base.groupBy("img", F.col("x").alias("idx")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    edges = rows.groupBy("img").agg(
        (F.max("idx") + 1).alias("h"), F.min_by("first", "idx").alias("corner"),
        F.max_by("first", "idx").alias("bottom_left"), F.min_by("last", "idx").alias("top_right"))
    width = cols.groupBy("img").agg((F.max("idx") + 1).alias("w"))
    facts = edges.join(width, "img")
    def kept(edge):
        return (F.col("lo") != F.col(edge)) | (F.col("hi") != F.col(edge))
    lines = rows.select("img", F.lit("y").alias("axis"), "idx", "lo", "hi").unionByName(
        cols.select("img", F.lit("x").alias("axis"), "idx", "lo", "hi")).join(facts, "img")
    on_y = F.col("axis") == "y"
    return _box(lines.select(
        "img", "axis", "idx", F.when(on_y, F.col("h")).otherwise(F.col("w")).alias("size"),
        kept("corner").alias("keep_lo"), F.when(on_y, kept("bottom_left")).otherwise(kept("top_right")).alias("keep_hi")))


# Spread of channel differences to the edge colour and to the
# neighbour, and the share of misses in percent.
EDGE_SPREAD, NEIGHBOUR_SPREAD, MISS_PERCENT = 39, 16, 6


def tolerant_crop_box(df: DataFrame) -> DataFrame:
    """Border box with tolerance: a line is border while few of its pixels miss the edge's middle colour.

    A pixel misses when its channel differences to the edge colour spread by 39
    or more, or those to the pixel before it by 16 or more. Images under three
    lines stay whole. The neighbour is the previous pixel on all four sides.
    The last pixel of a line can no longer stop it, so it is not counted.
    """
    sized = with_size(df).select("img", "y", "x", *[_c(c).alias(c) for c in RGB], "h", "w")
    middle = F.struct(*RGB)
    edges = sized.groupBy("img").agg(
        F.max(F.when(F.expr("y = 0 and x = w div 2"), middle)).alias("y_lo"),
        F.max(F.when(F.expr("y = h - 1 and x = w div 2"), middle)).alias("y_hi"),
        F.max(F.when(F.expr("x = 0 and y = h div 2"), middle)).alias("x_lo"),
        F.max(F.when(F.expr("x = w - 1 and y = h div 2"), middle)).alias("x_hi"))

    def spread(d, limit):
        r, g, b = d
        return (F.abs(r - g) >= limit) | (F.abs(r - b) >= limit) | (F.abs(b - g) >= limit)

    def along(axis, line, pos, length, size):
        before = W.partitionBy("img", line).orderBy(pos)
        prev = sized.select("*", *[F.lag(c).over(before).alias("p" + c) for c in RGB]).join(edges, "img")
        def misses(edge):
            to_edge = [F.col(c) - F.col(f"{edge}.{c}") for c in RGB]
            to_prev = [F.col(c) - F.coalesce(F.col("p" + c), F.col(f"{edge}.{c}")) for c in RGB]
            miss = spread(to_edge, EDGE_SPREAD) | spread(to_prev, NEIGHBOUR_SPREAD)
            return F.sum(F.when(miss & (F.col(pos) < F.col(length) - 1), 1).otherwise(0))
        per_line = prev.groupBy("img", F.col(line).alias("idx"), F.col(size).alias("size"), F.col(length).alias("len")).agg(
            misses(f"{axis}_lo").alias("lo"), misses(f"{axis}_hi").alias("hi"))
        small = F.expr("size < 3 or len < 3")
        limit = F.expr(f"len * {MISS_PERCENT} div 100")
        return per_line.select("img", F.lit(axis).alias("axis"), "idx", "size",
                               (small | (F.col("lo") >= limit)).alias("keep_lo"), (small | (F.col("hi") >= limit)).alias("keep_hi"))

    return _box(along("y", "y", "x", "w", "h").unionByName(along("x", "x", "y", "h", "w")))


def auto_crop(df: DataFrame, tolerant: bool = False) -> DataFrame:
    return _cropped(df, tolerant_crop_box(df) if tolerant else crop_box(df))


# --- histogram and palette -----------------------------------------------

# Bits kept per component, and the weights of red, green, blue in colour distance.
BITS = (5, 6, 5)
SCALES = (2, 3, 1)
CELLS = ("c0", "c1", "c2")
SHIFTS = tuple(8 - b for b in BITS)


def with_cells(df: DataFrame, bits=BITS) -> DataFrame:
    return df.select("*", *[F.shiftright(_c(c), 8 - n).alias(cell) for c, cell, n in zip(RGB, CELLS, bits)])


def colour_histogram(df: DataFrame, bits=BITS, cap: int | None = None) -> DataFrame:
    """Pixels per colour cell and image; `cap` saturates the counter."""
    hist = with_cells(df, bits).groupBy("img", *CELLS).agg(F.count(F.lit(1)).alias("cnt"))
    return hist if cap is None else hist.withColumn("cnt", F.least("cnt", F.lit(cap).cast("bigint")))


def _span(lo: str, hi: str, i: int) -> Column:
    return (F.col(hi) - F.col(lo)) * ((1 << SHIFTS[i]) * SCALES[i])


def box_stats(hist: DataFrame, keys=("img", "box")) -> DataFrame:
    """Tight bounds, scaled 2-norm volume, number of colours and pixels per box."""
    tight = hist.groupBy(*keys).agg(
        *[f(c).alias(f"{c}_{n}") for c in CELLS for n, f in (("min", F.min), ("max", F.max))],
        F.count(F.lit(1)).alias("n_colours"), F.sum("cnt").alias("n_pixels"))
    volume = sum(_span(f"{c}_min", f"{c}_max", i) * _span(f"{c}_min", f"{c}_max", i) for i, c in enumerate(CELLS))
    return tight.withColumn("volume", volume)


def box_colour(hist: DataFrame, keys=("img", "box")) -> DataFrame:
    """Pixel-weighted mean of the cell centres, rounded half up."""
    def mean(i):
        centre = F.col(CELLS[i]) * (1 << SHIFTS[i]) + ((1 << SHIFTS[i]) >> 1)
        return F.floor((F.sum(centre * F.col("cnt")) + F.floor(F.sum("cnt") / 2)) / F.sum("cnt"))
    return hist.groupBy(*keys).agg(*[mean(i).cast("bigint").alias(c) for i, c in enumerate(RGB)], F.sum("cnt").alias("n_pixels"))


def top_box(boxes: DataFrame, by: str, keys=("img",)) -> DataFrame:
    """The splittable box with the largest `by` per image; the lowest box number wins ties."""
    best = F.max_by(F.struct("box", by), F.when(F.col("volume") > 0, F.struct(F.col(by), -F.col("box"))))
    return boxes.groupBy(*keys).agg(best.alias("_b")).where("_b is not null").select(*keys, "_b.box", f"_b.{by}")


def top_k(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def _split_boxes(cells: pd.DataFrame, target: int) -> pd.Series:
    """Box number of every cell of one image's histogram."""
    c = cells[list(CELLS)].to_numpy()
    scale = [(1 << s) * w for s, w in zip(SHIFTS, SCALES)]
    boxes = [np.arange(len(c))]

    def measures(members):
        lo, hi = c[members].min(axis=0), c[members].max(axis=0)
        spans = [int(hi[i] - lo[i]) * scale[i] for i in range(3)]
        return lo, hi, spans, sum(s * s for s in spans)

    facts = [measures(boxes[0])]
    while len(boxes) < target:
        by_colours = len(boxes) * 2 <= target
        sizes = [len(m) if by_colours else f[3] for m, f in zip(boxes, facts)]
        open_ = [i for i, f in enumerate(facts) if f[3] > 0]
        if not open_:
            break
        pick = max(open_, key=lambda i: (sizes[i], -i))
        lo, hi, spans, _ = facts[pick]
        # green is asked first, then red, then blue; only a longer axis displaces it
        axis = 1
        for other in (0, 2):
            if spans[other] > spans[axis]:
                axis = other
        low = c[boxes[pick], axis] <= (int(lo[axis]) + int(hi[axis])) // 2
        halves = boxes[pick][low], boxes[pick][~low]
        boxes[pick], facts[pick] = halves[0], measures(halves[0])
        boxes.append(halves[1])
        facts.append(measures(halves[1]))
    out = pd.Series(0, index=range(len(c)), dtype="int64")
    for n, members in enumerate(boxes):
        out.iloc[members] = n
    return out


def median_cut(hist: DataFrame, colours: int) -> DataFrame:
    """Histogram cells with their box after median-cut splitting, per image.

    The group an image brings to one task is its histogram: at most 65,536
    cells with the default bits, however many pixels the image has.
    """
    def assign(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(list(CELLS), ignore_index=True)
        return cells.assign(box=_split_boxes(cells, colours))

    return hist.select("img", *CELLS, "cnt").groupBy("img").applyInPandas(
        assign, "img bigint, c0 bigint, c1 bigint, c2 bigint, cnt bigint, box bigint")


def palette(hist: DataFrame, colours: int) -> DataFrame:
    """Representative colours `(img, idx, r, g, b)` of a median-cut palette."""
    return box_colour(median_cut(hist, colours)).select("img", F.col("box").alias("idx"), *RGB)


def nearest_cells(hist: DataFrame, colours: DataFrame) -> DataFrame:
    """Palette index of every histogram cell by scaled squared distance; the lowest index wins ties.

    Distances are formed per distinct cell, not per pixel. A palette travels as
    one short array per image (a palette index is one byte).
    """
    packed = colours.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("idx", *RGB))).alias("_p"))
    centre = {c: F.col(cell) * (1 << SHIFTS[i]) + ((1 << SHIFTS[i]) >> 1) for i, (c, cell) in enumerate(zip(RGB, CELLS))}
    cells = hist.join(packed, "img").select("img", *CELLS, "_p", *[v.alias("_" + c) for c, v in centre.items()])
    def distance(p):
        return sum((F.col("_" + c) - p[c]) * (F.col("_" + c) - p[c]) * (s * s) for c, s in zip(RGB, SCALES))
    best = F.array_min(F.transform("_p", lambda p: F.struct(distance(p).alias("dist"), p["idx"].alias("idx"))))
    return cells.select("img", *CELLS, best.getField("idx").alias("idx"))


def nearest(df: DataFrame, colours: DataFrame) -> DataFrame:
    """Pixels with the index of their nearest palette colour."""
    cells = nearest_cells(colour_histogram(df), colours)
    return with_cells(df).join(cells, ["img", *CELLS]).drop(*CELLS)


def nearest_vectors(vectors: DataFrame, centroids: DataFrame, vec: str, key: str, limit: int = 4096) -> DataFrame:
    """Vectors with the key of their nearest centroid; the lowest key wins ties.

    A table of at most `limit` centroids is sent with the task code; a larger
    one is cut into cells and blocks, see `operators.nearest`.
    """
    rows = centroids.orderBy(key).limit(limit + 1).collect()
    if len(rows) > limit:
        return nearest_by_cells(vectors, centroids, vec, key)
    keys = np.array([r[key] for r in rows])
    table = np.array([r["centroid"] for r in rows], dtype=np.float64)

    def assign(batches):
        for pdf in batches:
            out = pdf.drop(columns=[vec])
            if len(pdf):
                v = np.stack(pdf[vec].to_numpy()).astype(np.float64)
                out = out.assign(nearest=keys[closest(v, table)[0]])
            else:
                out = out.assign(nearest=np.array([], dtype=np.int64))
            yield out

    rest = [f for f in vectors.schema.fields if f.name != vec]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", nearest bigint"
    return vectors.mapInPandas(assign, schema)


def table_plane(df: DataFrame, component: str, comp: int = 0) -> DataFrame:
    """One component as samples `(img, comp, y, x, v)` for the block transform."""
    return df.select("img", F.lit(comp).cast("bigint").alias("comp"), "y", "x", F.col(component).alias("v"))
