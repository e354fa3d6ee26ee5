"""Registered queries over pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflux.operators import nearest as N
from strataflux.operators import pixels as P
from strataflux.plans import fixtures_sql as X
from strataflux.plans.registry import query
from strataflux.sources import tables as T

SIZES = """, sizes as (select img, max(y) + 1 as h, max(x) + 1 as w from pixels group by img),
px as (select * from pixels join sizes using (img))"""


def px(spark, d):
    return T.pixels(T.table(spark, d, "events"))


def framed(spark, d):
    return T.framed_pixels(T.table(spark, d, "events"))


def _sh(e):
    return f"cast(floor(({e}) / 65536.0) as bigint)"


def _cl(e):
    return f"greatest(0, least(255, {e}))"


_YCC = (f"{_sh('19595 * r + 38470 * g + 7471 * b + 32768')} as lum, {_sh('-11058 * r - 21710 * g + 32768 * b + 8421375')} as cb, "
        f"{_sh('32768 * r - 27439 * g - 5329 * b + 8421375')} as cr")


@query("rgb_to_ycc", X.with_(X.PIXELS) + f"select img, y, x, {_YCC} from pixels")
def rgb_to_ycc(spark, d):
    return P.rgb_to_ycc(px(spark, d))


def _back(cr, gcr, gcb, cb):
    return ", ".join((f"{_cl('lum + ' + _sh(f'{cr} * (cr - 128) + 32768'))} as r",
                      f"{_cl('lum + ' + _sh(f'-{gcb} * (cb - 128) - {gcr} * (cr - 128) + 32768'))} as g",
                      f"{_cl('lum + ' + _sh(f'{cb} * (cb - 128) + 32768'))} as b"))


_AS_YCC = "ycc as (select img, y, x, g as lum, r as cb, b as cr from pixels)"


@query("ycc_to_rgb", X.with_(X.PIXELS, _AS_YCC) + f"select img, y, x, {_back(91881, 46802, 22553, 116130)} from ycc")
def ycc_to_rgb(spark, d):
    return P.ycc_to_rgb(px(spark, d).selectExpr("img", "y", "x", "g as lum", "r as cb", "b as cr"))


@query("big_gamut_ycc_to_rgb", X.with_(X.PIXELS, _AS_YCC) + f"select img, y, x, {_back(183763, 93603, 45107, 232260)} from ycc")
def big_gamut_ycc_to_rgb(spark, d):
    return P.ycc_to_rgb(px(spark, d).selectExpr("img", "y", "x", "g as lum", "r as cb", "b as cr"), big_gamut=True)


@query("rgb_to_grey", X.with_(X.PIXELS) + f"select img, y, x, {_sh('19595 * r + 38470 * g + 7471 * b + 32768')} as grey from pixels")
def rgb_to_grey(spark, d):
    return P.rgb_to_grey(px(spark, d))


@query("grey_to_rgb", X.with_(X.PIXELS) + "select img, y, x, g as r, g, g as b from pixels")
def grey_to_rgb(spark, d):
    return P.grey_to_rgb(px(spark, d).selectExpr("img", "y", "x", "g as grey"))


@query("reversible_colour", X.with_(X.PIXELS) + "select img, y, x, (r - g + 128) & 255 as r, g, (b - g + 128) & 255 as b from pixels")
def reversible_colour(spark, d):
    return P.rgb_to_rgb1(px(spark, d))


@query("reversible_colour_back", X.with_(X.PIXELS) + "select * from pixels")
def reversible_colour_back(spark, d):
    return P.rgb1_to_rgb(P.rgb_to_rgb1(px(spark, d)))


def _steps(v, n, i):
    """Level index and value by walking the interval bounds."""
    tops = [((2 * j + 1) * 255 + (n - 1)) // (2 * (n - 1)) for j in range(n)]
    whens = " ".join(f"when {v} <= {t} then {j}" for j, t in enumerate(tops[:-1]))
    return f"case {whens} else {n - 1} end as i{i}"


def _quantized(values, levels, src):
    idx = ", ".join(_steps(v, n, i) for i, (v, n) in enumerate(zip(values, levels)))
    vals = ", ".join(f"(i{i} * 255 + {(n - 1) // 2}) // {n - 1} as {c}" for i, (c, n) in enumerate(zip("rgb", levels)))
    return (f"select img, y, x, {vals}, (i0 * {levels[1]} + i1) * {levels[2]} + i2 as code"
            f" from (select img, y, x, {idx} from {src})")


@query("quantize_levels", X.with_(X.PIXELS) + _quantized("rgb", (6, 7, 6), "pixels"))
def quantize_levels(spark, d):
    return P.quantize_levels(px(spark, d), P.split_levels(256))


_CELL = " + ".join(f"((((y >> {b}) & 1) + ((x >> {b}) & 1)) % 2 * 2 + ((x >> {b}) & 1)) * {1 << (6 - 2 * b)}" for b in range(4))


def _amount(n):
    return f"cast(trunc((255 - 2 * cell) * 255 / {512 * (n - 1)}.0) as bigint)"


@query("ordered_dither", X.with_(X.PIXELS) + f", dith as (select img, y, x, r + {_amount(6)} as r, g + {_amount(7)} as g, b + {_amount(6)} as b"
       + f" from (select *, {_CELL} as cell from pixels)) " + _quantized("rgb", (6, 7, 6), "dith"))
def ordered_dither(spark, d):
    return P.ordered_dither(px(spark, d), P.split_levels(256))


@query("gamma_chroma", X.with_(X.PIXELS, "ycc as (select img, y, x, g as lum, r as cb, b as cr from pixels)", """lv as (
  select *, pow((lum * 8 // 256 * 256 // 8 + 16) / 255.0::double, 1 / 1.5::double) * 255 as l,
    greatest(-128.0, least(127.0, (cr * 4 // 256 * 256 // 4 + 32 - 128) * 1.25::double)) as c,
    greatest(-128.0, least(127.0, (cb * 4 // 256 * 256 // 4 + 32 - 128) * 1.25::double)) as e from ycc)""") + """
select img, y, x, cast(floor(greatest(0.0, least(255.0, l + c))) as bigint) as r, cast(floor(greatest(0.0, least(255.0, l))) as bigint) as g,
  cast(floor(greatest(0.0, least(255.0, l + e))) as bigint) as b from lv""")
def gamma_chroma(spark, d):
    return P.gamma_chroma(px(spark, d).selectExpr("img", "y", "x", "g as lum", "r as cb", "b as cr"), 1.5, 1.25)


for _name, _turns, _yx in (("rotate_90", 1, ("x", "h - 1 - y")), ("rotate_180", 2, ("h - 1 - y", "w - 1 - x")), ("rotate_270", 3, ("w - 1 - x", "y"))):
    query(_name, X.with_(X.PIXELS) + SIZES + f" select img, {_yx[0]} as y, {_yx[1]} as x, r, g, b from px")(
        lambda spark, d, _turns=_turns: P.rotate_px(px(spark, d), _turns))


@query("flip_negate", X.with_(X.PIXELS) + SIZES + " select img, y, w - 1 - x as x, 255 - r as r, 255 - g as g, 255 - b as b from px")
def flip_negate(spark, d):
    return P.negate(P.flip_px(px(spark, d)))


@query("flip_vertical", X.with_(X.PIXELS) + SIZES + " select img, h - 1 - y as y, x, r, g, b from px")
def flip_vertical(spark, d):
    return P.flip_px(px(spark, d), horizontal=False)


@query("sub_image", X.with_(X.PIXELS) + "select img, y - 5 as y, x - 10 as x, r, g, b from pixels where x >= 10 and x < 40 and y >= 5 and y < 25")
def sub_image(spark, d):
    return P.sub_image(px(spark, d), 10, 5, 30, 20)


def _resized(w, h):
    return (X.with_(X.PIXELS) + SIZES + f""", grid as (
  select img, w, h, unnest(range(0, {w})) as ex, ey from (select img, w, h, unnest(range(0, {h})) as ey from sizes))
select grid.img, ey as y, ex as x, r, g, b from grid join pixels p on p.img = grid.img and p.y = grid.h * ey // {h} and p.x = grid.w * ex // {w}""")


@query("resize_shrink", _resized(23, 17))
def resize_shrink(spark, d):
    return P.resize_nearest(px(spark, d), 23, 17)


@query("resize_grow", _resized(100, 90))
def resize_grow(spark, d):
    return P.resize_nearest(px(spark, d), 100, 90)


@query("replicate", X.with_(X.PIXELS) + """
select img, y * 2 + dy as y, x * 2 + dx as x, r, g, b from pixels, (select unnest([0, 1]) as dy), (select unnest([0, 1]) as dx)""")
def replicate(spark, d):
    return P.rescale(px(spark, d), 1)


def _down(h, v, bias):
    area = h * v
    sums = ", ".join(f"sum({c} * n) as {c}" for c in "rgb")
    outs = ", ".join(f"cast(({c} + {bias}) // {area} as bigint) as {c}" for c in "rgb")
    return (X.with_(X.PIXELS) + SIZES + f""", wt as (
  select *, case when x = w - 1 then 1 + ({h} - w % {h}) % {h} else 1 end * case when y = h - 1 then 1 + ({v} - h % {v}) % {v} else 1 end as n from px), sm as (
  select img, y // {v} as y, x // {h} as x, {sums} from wt group by 1, 2, 3)
select img, y, x, {outs} from sm""")


@query("downsample_2x2", _down(2, 2, "1 + x % 2"))
def downsample_2x2(spark, d):
    return P.downsample(px(spark, d), 2, 2)


@query("downsample_2x1", _down(2, 1, "x % 2"))
def downsample_2x1(spark, d):
    return P.downsample(px(spark, d), 2, 1)


@query("downsample_3x3", _down(3, 3, "4"))
def downsample_3x3(spark, d):
    return P.downsample(px(spark, d), 3, 3)


@query("rescale_quarter", _down(4, 4, "8"))
def rescale_quarter(spark, d):
    return P.rescale(px(spark, d), -2)


def _tap(c, o):
    return f"greatest(0, least({'w' if c == 'x' else 'h'} - 1, 2 * {c}o + {o}))"


@query("smooth", X.with_(X.PIXELS) + SIZES + """, outs as (
  select img, w, h, yo, unnest(range(0, (w + 1) // 2)) as xo from (select img, w, h, unnest(range(0, (h + 1) // 2)) as yo from sizes)), taps as (
  select *, dy, dx, case when dy in (0, 1) and dx in (0, 1) then 16384 - 30 * 80 when dy in (0, 1) or dx in (0, 1) then 2 * 30 * 16 else 30 * 16 end as wt
  from outs, (select unnest([-1, 0, 1, 2]) as dy), (select unnest([-1, 0, 1, 2]) as dx)), src as (
  select img, yo, xo, wt, greatest(0, least(h - 1, 2 * yo + dy)) as y, greatest(0, least(w - 1, 2 * xo + dx)) as x from taps)
select src.img, yo as y, xo as x, """ + ", ".join(f"cast(floor((sum({c} * wt) + 32768) / 65536.0) as bigint) as {c}" for c in "rgb")
       + " from src join pixels p on p.img = src.img and p.y = src.y and p.x = src.x group by src.img, yo, xo")
def smooth(spark, d):
    return P.smooth(px(spark, d), 30)


_PAD = X.with_(X.PIXELS) + SIZES + """, front as (
  select img, y + cast(trunc((50 - h) / 2.0) as bigint) as y, x + cast(trunc((90 - w) / 2.0) as bigint) as x, r, g, b from px), grid as (
  select img, y, unnest(range(0, 90)) as x from (select img, unnest(range(0, 50)) as y from sizes))"""


@query("pad_solid", _PAD + """
select grid.img, grid.y, grid.x, coalesce(f.r * 70 // 100 + 200 * 30 // 100, 200) as r, coalesce(f.g * 70 // 100 + 10 * 30 // 100, 10) as g,
  coalesce(f.b * 70 // 100 + 99 * 30 // 100, 99) as b from grid left join front f on f.img = grid.img and f.y = grid.y and f.x = grid.x""")
def pad_solid(spark, d):
    return P.pad_blend(px(spark, d), 90, 50, (200, 10, 99), opacity=70)


@query("pad_background", _PAD + """, bg as (select y, x, r, g, b from pixels where img = 0), canvas as (
  select grid.img, grid.y, grid.x, coalesce(bg.r, 0) as r, coalesce(bg.g, 0) as g, coalesce(bg.b, 0) as b from grid left join bg on bg.y = grid.y and bg.x = grid.x)
select c.img, c.y, c.x, coalesce(f.r * 40 // 100 + c.r * 60 // 100, c.r) as r, coalesce(f.g * 40 // 100 + c.g * 60 // 100, c.g) as g,
  coalesce(f.b * 40 // 100 + c.b * 60 // 100, c.b) as b from canvas c left join front f on f.img = c.img and f.y = c.y and f.x = c.x""")
def pad_background(spark, d):
    images = px(spark, d)
    return P.pad_blend(images, 90, 50, background=images.where("img = 0").drop("img"), opacity=40)


_CROP_TAIL = """, bounds as (
  select img, max(case when axis = 'y' then size end) as h, max(case when axis = 'x' then size end) as w,
    least(coalesce(min(case when axis = 'y' and keep_lo then idx end), max(case when axis = 'y' then size end)), max(case when axis = 'y' then size end) - 1) as top,
    least(coalesce(min(case when axis = 'x' and keep_lo then idx end), max(case when axis = 'x' then size end)), max(case when axis = 'x' then size end) - 1) as lft,
    coalesce(min(case when axis = 'y' and keep_hi then size - 1 - idx end), max(case when axis = 'y' then size end)) as bot0,
    coalesce(min(case when axis = 'x' and keep_hi then size - 1 - idx end), max(case when axis = 'x' then size end)) as rgt0
  from lines group by img), box as (
  select *, greatest(0, least(bot0, h - 1 - top)) as bot, greatest(0, least(rgt0, w - 1 - lft)) as rgt from bounds)
select p.img, p.y - top as y, p.x - lft as x, p.r, p.g, p.b from framed p join box using (img)
where p.y >= top and p.y < h - bot and p.x >= lft and p.x < w - rgt"""
_FSIZES = """, sizes as (select img, max(y) + 1 as h, max(x) + 1 as w from framed group by img),
fx as (select *, r * 65536 + g * 256 + b as v from framed join sizes using (img))"""


@query("auto_crop", X.with_(X.FRAMED) + _FSIZES + """, corner as (
  select img, max(case when y = 0 and x = 0 then v end) as c, max(case when y = h - 1 and x = 0 then v end) as bl,
    max(case when y = 0 and x = w - 1 then v end) as tr from fx group by img), lines as (
  select fx.img, 'y' as axis, y as idx, h as size, not bool_and(v = c) as keep_lo, not bool_and(v = bl) as keep_hi from fx join corner using (img) group by fx.img, y, h
  union all
  select fx.img, 'x', x, w, not bool_and(v = c), not bool_and(v = tr) from fx join corner using (img) group by fx.img, x, w)""" + _CROP_TAIL)
def auto_crop(spark, d):
    return P.auto_crop(framed(spark, d))


def _miss(e):
    edge = f"abs((r - {e}.r) - (g - {e}.g)) >= 39 or abs((r - {e}.r) - (b - {e}.b)) >= 39 or abs((b - {e}.b) - (g - {e}.g)) >= 39"
    pr, pg, pb = (f"(r{''} - coalesce(p{c}, {e}.{c}))".replace("r -", f"{c} -") for c in "rgb")
    near = f"abs({pr} - {pg}) >= 16 or abs({pr} - {pb}) >= 16 or abs({pb} - {pg}) >= 16"
    return f"({edge} or {near})"


@query("auto_crop_tolerant", X.with_(X.FRAMED) + _FSIZES + """, edges as (
  select img, max(case when y = 0 and x = w // 2 then {'r': r, 'g': g, 'b': b} end) as ylo, max(case when y = h - 1 and x = w // 2 then {'r': r, 'g': g, 'b': b} end) as yhi,
    max(case when x = 0 and y = h // 2 then {'r': r, 'g': g, 'b': b} end) as xlo, max(case when x = w - 1 and y = h // 2 then {'r': r, 'g': g, 'b': b} end) as xhi
  from fx group by img), ty as (
  select *, lag(r) over q as pr, lag(g) over q as pg, lag(b) over q as pb from fx window q as (partition by img, y order by x)), tx as (
  select *, lag(r) over q as pr, lag(g) over q as pg, lag(b) over q as pb from fx window q as (partition by img, x order by y)), miss as (
  select img, 'y' as axis, y as idx, h as size, w as len, count(*) filter (x < w - 1 and """ + _miss("ylo") + """) as lo, count(*) filter (x < w - 1 and """ + _miss("yhi") + """) as hi
  from ty join edges using (img) group by img, y, h, w
  union all
  select img, 'x', x, w, h, count(*) filter (y < h - 1 and """ + _miss("xlo") + """), count(*) filter (y < h - 1 and """ + _miss("xhi") + """)
  from tx join edges using (img) group by img, x, h, w), lines as (
  select img, axis, idx, size, (size < 3 or len < 3 or lo >= len * 6 // 100) as keep_lo, (size < 3 or len < 3 or hi >= len * 6 // 100) as keep_hi from miss)""" + _CROP_TAIL)
def auto_crop_tolerant(spark, d):
    return P.auto_crop(framed(spark, d), tolerant=True)


HIST = X.PIXELS + """, hist as (select img, r // 8 as c0, g // 4 as c1, b // 8 as c2, count(*) as cnt from pixels group by all)"""
BOXED = HIST + """, boxed as (select *, c0 // 16 * 4 + c1 // 32 * 2 + c2 // 16 as box from hist), stats as (
  select img, box, min(c0) as c0_min, max(c0) as c0_max, min(c1) as c1_min, max(c1) as c1_max, min(c2) as c2_min, max(c2) as c2_max,
    count(*) as n_colours, cast(sum(cnt) as bigint) as n_pixels from boxed group by img, box), vols as (
  select *, (c0_max - c0_min) * 16 * ((c0_max - c0_min) * 16) + (c1_max - c1_min) * 12 * ((c1_max - c1_min) * 12)
    + (c2_max - c2_min) * 8 * ((c2_max - c2_min) * 8) as volume from stats)"""
PALETTE = BOXED + """, pal as (select img, box as idx, """ + ", ".join(
    f"cast((sum(({c} * {s} + {s // 2}) * cnt) + sum(cnt) // 2) // sum(cnt) as bigint) as {n}" for c, s, n in (("c0", 8, "r"), ("c1", 4, "g"), ("c2", 8, "b"))
) + ", cast(sum(cnt) as bigint) as n_pixels from boxed group by img, box)"


def hist(spark, d):
    return P.colour_histogram(px(spark, d))


def boxed(spark, d):
    return hist(spark, d).withColumn("box", F.expr("c0 div 16 * 4 + c1 div 32 * 2 + c2 div 16"))


@query("colour_histogram", X.with_(HIST) + "select * from hist")
def colour_histogram(spark, d):
    return hist(spark, d)


@query("colour_histogram_capped", X.with_(HIST) + "select img, c0, c1, c2, least(cnt, 1) as cnt from hist")
def colour_histogram_capped(spark, d):
    return P.colour_histogram(px(spark, d), cap=1)


@query("box_stats", X.with_(BOXED) + "select * from vols")
def box_stats(spark, d):
    return P.box_stats(boxed(spark, d))


@query("box_colour", X.with_(PALETTE) + "select img, idx as box, r, g, b, n_pixels from pal")
def box_colour(spark, d):
    return P.box_colour(boxed(spark, d))


for _by in ("n_colours", "volume"):
    query(f"top_box_by_{_by}", X.with_(BOXED) + f"""select img, box, {_by} from (
  select *, row_number() over (partition by img order by {_by} desc, box) as rn from vols where volume > 0) where rn = 1""")(
        lambda spark, d, _by=_by: P.top_box(P.box_stats(boxed(spark, d)), _by))


@query("top_colours", X.with_(HIST) + "select * from hist order by cnt desc, img, c0, c1, c2 limit 50")
def top_colours(spark, d):
    return P.top_k(hist(spark, d), "cnt", 50, "img", "c0", "c1", "c2")


@query("median_cut")
def median_cut(spark, d):
    return P.median_cut(hist(spark, d), 16)


@query("median_cut_palette")
def median_cut_palette(spark, d):
    return P.palette(hist(spark, d), 16)


@query("nearest_colour", X.with_(PALETTE) + """, best as (
  select h.img, c0, c1, c2, idx, row_number() over (partition by h.img, c0, c1, c2 order by
    pow((c0 * 8 + 4 - p.r) * 2, 2) + pow((c1 * 4 + 2 - p.g) * 3, 2) + pow(c2 * 8 + 4 - p.b, 2), idx) as rn
  from hist h join pal p on h.img = p.img)
select p.img, p.y, p.x, p.r, p.g, p.b, idx from pixels p join best on best.img = p.img and c0 = p.r // 8 and c1 = p.g // 4 and c2 = p.b // 8 and rn = 1""")
def nearest_colour(spark, d):
    colours = P.box_colour(boxed(spark, d)).withColumnRenamed("box", "idx").drop("n_pixels")
    return P.nearest(px(spark, d), colours)


@query("nearest_centroid", """
with s as (select vec_id, label, i, cast(embedding[i] as double) as v from (select vec_id, label, embedding, unnest(range(1, 65)) as i from embeddings)),
c as (select label as k, i, cast(sum(cast(v as decimal(20,12))) as double) / count(*) as m from s group by label, i), dist as (
  select vec_id, label, k, sum((v - m) * (v - m)) as d from s join c using (i) group by vec_id, label, k)
select vec_id, label, nearest from (select vec_id, label, cast(k as bigint) as nearest, row_number() over (partition by vec_id order by d, k) as rn from dist) where rn = 1""")
def nearest_centroid(spark, d):
    e = T.table(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(
        (F.sum(F.col("v").cast("double").cast("decimal(20,12)")).cast("double") / F.count(F.lit(1))).alias("m"))
    # 64 places per label
    centroids = means.groupBy(F.col("label").alias("k")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    return P.nearest_vectors(e.select("vec_id", "label", "embedding"), centroids, "embedding", "k")


@query("nearest_among_many", """
with s as (select vec_id, vec_id // 3 as grp, i, cast(embedding[i] as double) as v from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)),
c as (select grp as k, i, cast(sum(cast(v as decimal(20,12))) as double) / count(*) as m from s group by grp, i), dist as (
  select vec_id, k, sum((v - m) * (v - m)) as d from s join c using (i) group by vec_id, k)
select vec_id, cast(k as bigint) as nearest from (select vec_id, k, row_number() over (partition by vec_id order by d, k) as rn from dist) where rn = 1""")
def nearest_among_many(spark, d):
    """Centroids of runs of three vectors: their number grows with the table, so they are cut into cells and blocks."""
    e = T.table(spark, d, "embeddings")
    means = e.select(F.expr("vec_id div 3").alias("k"), F.posexplode("embedding").alias("i", "v")).groupBy("k", "i").agg(
        (F.sum(F.col("v").cast("double").cast("decimal(20,12)")).cast("double") / F.count(F.lit(1))).alias("m"))
    centroids = means.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))  # 64 places
    return N.nearest_by_cells(e.select("vec_id", "embedding"), centroids, "embedding", "k", pivots=32)


@query("median_cut_pixels", X.with_(HIST) + """
select img, cast(sum(cnt) as bigint) as pixels, count(*) as cells, least(16, count(*)) as boxes, true as boxes_part from hist group by img""")
def median_cut_pixels(spark, d):
    """Every cell and pixel is in exactly one box, boxes do not overlap."""
    cut = P.median_cut(hist(spark, d), 16)
    box = cut.groupBy("img", "box").agg(F.sum("cnt").alias("pixels"), F.count(F.lit(1)).alias("cells"), *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in ("c0", "c1", "c2")])
    # at most 16 boxes an image
    listed = box.groupBy("img").agg(F.sum("pixels").alias("pixels"), F.sum("cells").alias("cells"), F.count(F.lit(1)).alias("boxes"), F.collect_list(F.struct("box", "c0", "c1", "c2")).alias("b"))
    clash = "exists(b, p -> exists(b, q -> p.box < q.box and " + " and ".join(f"p.{c}.lo <= q.{c}.hi and q.{c}.lo <= p.{c}.hi" for c in ("c0", "c1", "c2")) + "))"
    return listed.select("img", "pixels", "cells", "boxes", F.expr(f"not {clash}").alias("boxes_part"))
