"""Registered queries over coefficient blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataflux.functions import media
from strataflux.operators import blocks as B
from strataflux.operators import pixels as P
from strataflux.operators import runs as R
from strataflux.plans import fixtures_sql as X
from strataflux.plans.numeric_queries import q6, r6
from strataflux.plans.registry import query
from strataflux.sources import tables as T

WIDTH, HEIGHT = 125, 124
NAT, ZIG = f"{B.NATURAL}", f"{B.ZIGZAG}"


def coefs(spark, d):
    return T.coefs(T.table(spark, d, "embeddings"))


# place of a zigzag index, walked diagonal by diagonal
_WALK = """walk as (
  select v, u, cast(row_number() over (order by v + u, case when (v + u) % 2 = 1 then v else -v end) - 1 as bigint) as k
  from (select unnest(range(0, 8)) as v), (select unnest(range(0, 8)) as u)), c as (
  select img, comp, by_, bx, v, u, coef from coefs join walk using (k))"""
_OUT = 'select img, comp, nby as "by", nbx as bx, w.k as k, ncoef as coef from moved m join walk w on w.v = nv and w.u = nu'


def _moved(kind, trim=False):
    swap, mx, my = B.KINDS[kind]
    v, u, by, bx, w, h = ("u", "v", "bx", "by_", HEIGHT, WIDTH) if swap else ("v", "u", "by_", "bx", WIDTH, HEIGHT)
    fx, fy = w // 8, h // 8
    sign, nby, nbx, keep = "1", by, bx, "true"
    if mx:
        sign += f" * case when {bx} < {fx} and {u} % 2 = 1 then -1 else 1 end"
        nbx = f"case when {bx} < {fx} then {fx - 1} - {bx} else {bx} end"
        keep += f" and {bx} < {fx}"
    if my:
        sign += f" * case when {by} < {fy} and {v} % 2 = 1 then -1 else 1 end"
        nby = f"case when {by} < {fy} then {fy - 1} - {by} else {by} end"
        keep += f" and {by} < {fy}"
    where = f" where {keep}" if trim else ""
    return (X.with_(X.COEFS, _WALK) + f", moved as (select img, comp, {nby} as nby, {nbx} as nbx, {v} as nv, {u} as nu, coef * {sign} as ncoef from c{where}) " + _OUT)


for _kind in ("flip_h", "flip_v", "transpose", "transverse", "rot_90", "rot_180", "rot_270"):
    query(f"block_{_kind}", _moved(_kind))(lambda spark, d, _k=_kind: B.transform(coefs(spark, d), _k, WIDTH, HEIGHT))
query("block_rot_90_trim", _moved("rot_90", True))(lambda spark, d: B.transform(coefs(spark, d), "rot_90", WIDTH, HEIGHT, trim=True))


@query("block_crop", X.with_(X.COEFS) + """
select img, comp, by_ - 2 as "by", bx - 1 as bx, k, coef from coefs where bx >= 1 and bx < 6 and by_ >= 2 and by_ < 7""")
def block_crop(spark, d):
    return B.crop(coefs(spark, d), "33x35+13+20", WIDTH, HEIGHT)


@query("block_wipe", X.with_(X.COEFS) + """
select img, comp, by_ as "by", bx, k, case when bx >= 1 and bx < 6 and by_ >= 2 and by_ < 7 then 0 else coef end as coef from coefs""")
def block_wipe(spark, d):
    return B.wipe(coefs(spark, d), "33x35+13+20", WIDTH, HEIGHT)


@query("block_resize", X.with_(X.COEFS, _WALK) + """
select img, comp, by_ as "by", bx, k, coef from coefs join walk using (k) where v < 4 and u < 4""")
def block_resize(spark, d):
    return B.resize_coefs(coefs(spark, d), 4)


@query("block_drop_chroma", X.with_(X.COEFS) + 'select img, comp, by_ as "by", bx, k, coef from coefs where comp = 0')
def block_drop_chroma(spark, d):
    return B.drop_chroma(coefs(spark, d))


@query("natural_order", X.with_(X.COEFS, _WALK) + 'select img, comp, by_ as "by", bx, v * 8 + u as k, coef from c')
def natural_order(spark, d):
    return B.natural(coefs(spark, d))


@query("zigzag_order", X.with_(X.COEFS, _WALK) + """
select img, comp, by_ as "by", bx, walk.k as k, coef from coefs join walk on coefs.k = v * 8 + u""")
def zigzag_order(spark, d):
    return B.zigzag(coefs(spark, d))


@query("block_transform", X.with_(X.PIXELS) + """, s as (
  select img, y // 8 as by_, x // 8 as bx, y % 8 as yy, x % 8 as xx, g - 128 as v from pixels), f as (
  select f, case when f = 0 then sqrt(0.5) else 1 end / 2 as c from (select unnest(range(0, 8)) as f)), terms as (
  select img, by_, bx, fv.f * 8 + fu.f as k, sum(v * (fv.c * cos((2 * yy + 1) * fv.f * pi() / 16)) * (fu.c * cos((2 * xx + 1) * fu.f * pi() / 16))) as coef
  from s, f fv, f fu group by img, by_, bx, fv.f, fu.f)
select img, cast(0 as bigint) as comp, by_ as "by", bx, k, """ + q6("coef", 4) + " as coef from terms")
def block_transform(spark, d):
    samples = P.table_plane(T.pixels(T.table(spark, d, "events")), "g")
    return B.block_transform(samples, "v").withColumn("coef", r6(F.col("coef"), 4))


_TABLE = ", ".join(str(v) for v in B.LUMINANCE)


@query("block_quantize", X.with_(X.COEFS) + f""", q as (select *, greatest(1, least(255, ([{_TABLE}][k + 1] * 60 + 50) // 100)) as t, coef * 37 as c from coefs)
select img, comp, by_ as "by", bx, k, case when c < 0 then -((-c + t // 2) // t) else (c + t // 2) // t end as coef from q""")
def block_quantize(spark, d):
    table = [max(1, min(255, (v * 60 + 50) // 100)) for v in B.LUMINANCE]
    return B.quantize(coefs(spark, d).withColumn("coef", F.col("coef") * 37), table)


@query("block_dequantize", X.with_(X.COEFS) + f'select img, comp, by_ as "by", bx, k, coef * [{_TABLE}][k + 1] as coef from coefs')
def block_dequantize(spark, d):
    return B.dequantize(coefs(spark, d), B.LUMINANCE)


# entries from the fifth row on are all 99
_BY_COMPONENT = """, q as (select *, case when comp = 0 then [{lum}][k + 1] else {gain} * coalesce([17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99,
  24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99][k + 1], 99) end as t, coef * 37 as c from coefs)
select img, comp, by_ as "by", bx, k, case when c < 0 then -((-c + t // 2) // t) else (c + t // 2) // t end as coef from q"""

for _name, _gain in (("block_quantize_components", 1), ("block_quantize_big_gamut", 2)):
    query(_name, X.with_(X.COEFS) + _BY_COMPONENT.format(lum=_TABLE, gain=_gain))(lambda spark, d, _g=_gain: B.quantize_components(
        coefs(spark, d).withColumn("coef", F.col("coef") * 37), B.LUMINANCE, B.CHROMINANCE, big_gamut=_g == 2))


@query("zero_runs", X.with_(X.COEFS) + """
select img, comp, by_ as "by", bx, k, coef, k - coalesce(lag(k) over (partition by img, comp, by_, bx order by k), 0) - 1 as run
from coefs where k > 0 and coef <> 0""")
def zero_runs(spark, d):
    return B.zero_runs(coefs(spark, d))


_SYMBOLS = X.COEFS + """, dc as (
  select coef - coalesce(lag(coef) over (partition by img, comp order by by_ * 16 + bx), 0) as diff from coefs where k = 0), ac as (
  select *, k - coalesce(lag(k) over (partition by img, comp, by_, bx order by k), 0) - 1 as run from coefs where k > 0 and coef <> 0), parts as (
  select 'dc' as tbl, case when diff = 0 then 0 else length(ltrim(cast(cast(abs(diff) as bit) as varchar), '0')) end as symbol, 1 as n from dc
  union all select 'ac', run % 16 * 16 + length(ltrim(cast(cast(abs(coef) as bit) as varchar), '0')), 1 from ac
  union all select 'ac', 240, run // 16 from ac where run > 15
  union all select 'ac', 0, 1 from (select max(case when k > 0 and coef <> 0 then k end) as last from coefs group by img, comp, by_, bx) where last is null or last < 63),
stats as (select tbl, cast(symbol as bigint) as symbol, cast(sum(n) as bigint) as cnt from parts group by tbl, symbol)"""


def symbols(spark, d):
    return B.symbol_stats(coefs(spark, d), 16)


@query("symbol_stats", X.with_(_SYMBOLS) + "select * from stats")
def symbol_stats(spark, d):
    return symbols(spark, d)


@query("top_symbols", X.with_(_SYMBOLS) + "select * from stats order by cnt desc, tbl, symbol limit 20")
def top_symbols(spark, d):
    return P.top_k(symbols(spark, d), "cnt", 20, "tbl", "symbol")


@query("code_lengths")
def code_lengths(spark, d):
    return B.code_lengths(symbols(spark, d))


@query("coding_cost")
def coding_cost(spark, d):
    counted = symbols(spark, d)
    return B.coding_cost(counted, B.code_lengths(counted))


# the default tables as the standard prints them: codes per length, symbols in code order, the rest rising
_DEFAULTS = """given(cls, tbl, counts, named) as (values
  ('luminance', 'dc', [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]),
  ('chrominance', 'dc', [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]),
  ('luminance', 'ac', [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    [1, 2, 3, 0, 4, 17, 5, 18, 33, 49, 65, 6, 19, 81, 97, 7, 34, 113, 20, 50, 129, 145, 161, 8, 35, 66, 177, 193, 21, 82, 209, 240, 36, 51, 98, 114, 130]),
  ('chrominance', 'ac', [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
    [0, 1, 2, 3, 17, 4, 5, 33, 49, 6, 18, 65, 81, 7, 97, 113, 19, 34, 50, 129, 8, 20, 66, 145, 161, 177, 193, 9, 35, 51, 82, 240, 21, 98, 114, 209, 10, 22, 36, 52, 225, 37, 241])),
universe as (select 'ac' as tbl, r * 16 + s as symbol from (select unnest(range(0, 16)) as r), (select unnest(range(1, 11)) as s)
  union all select 'ac', unnest([0, 240]) union all select 'dc', unnest(range(0, 12))),
placed as (select cls, tbl, symbol, counts, row_number() over (partition by cls, tbl order by coalesce(list_position(named, symbol), 1000 + symbol)) as place from given join universe using (tbl)),
lens as (select cls, tbl, symbol, 1 + len(list_filter(range(1, 17), lambda l: list_sum(counts[1:l]) < place)) as len from placed)"""
_BY_CLASS = _SYMBOLS.replace("select coef - coalesce", "select comp, coef - coalesce").replace("select 'dc' as tbl,", "select comp, 'dc' as tbl,").replace(
    "select 'ac',", "select comp, 'ac',").replace("from (select max(case", "from (select comp, max(case").replace(
    "select tbl, cast(symbol", "select case when comp = 0 then 'luminance' else 'chrominance' end as cls, tbl, cast(symbol").replace("group by tbl, symbol", "group by all")


@query("symbol_stats_by_class", X.with_(_BY_CLASS) + "select * from stats")
def symbol_stats_by_class(spark, d):
    return B.symbol_stats(coefs(spark, d), 16, by_class=True)


@query("default_coding_cost", X.with_(_BY_CLASS, _DEFAULTS) + """
select cls, tbl, cast(coalesce(sum(cnt * len), 0) as bigint) as default_bits, true as optimal_is_no_longer, cast(sum(case when len is null then cnt else 0 end) as bigint) as uncoded
from stats left join lens using (cls, tbl, symbol) group by cls, tbl""")
def default_coding_cost(spark, d):
    cost = B.default_cost(B.symbol_stats(coefs(spark, d), 16, by_class=True))
    return cost.select("cls", "tbl", "default_bits", (F.col("optimal_bits") <= F.col("default_bits")).alias("optimal_is_no_longer"), "uncoded")


@query("code_lengths_kraft", X.with_(_SYMBOLS) + """
select tbl, count(*) as symbols, true as fits_16_bits, true as leaves_one_code, true as rarer_is_no_shorter from stats group by tbl""")
def code_lengths_kraft(spark, d):
    counted = symbols(spark, d)
    order = Window.partitionBy("tbl").orderBy(F.desc("cnt"), "len")  # a table has at most 256 symbols
    coded = counted.join(B.code_lengths(counted), ["tbl", "symbol"]).withColumn("before", F.lag("len").over(order)).withColumn("cnt_before", F.lag("cnt").over(order))
    return coded.groupBy("tbl").agg(
        F.count(F.lit(1)).alias("symbols"), (F.max("len") <= 16).alias("fits_16_bits"), (F.sum(F.expr("shiftleft(1, cast(16 - len as int))")) < 65536).alias("leaves_one_code"),
        F.coalesce(F.bool_and(F.expr("before is null or cnt_before = cnt or before <= len")), F.lit(True)).alias("rarer_is_no_shorter"))


@query("dc_predictors", X.with_(X.COEFS) + """
select img, comp, by_ as "by", bx, coef - coalesce(lag(coef) over (partition by img, comp order by by_ * 16 + bx), 0) as diff from coefs where k = 0""")
def dc_predictors(spark, d):
    return B.dc_differences(coefs(spark, d), 16)


@query("dc_levels", X.with_(X.COEFS) + 'select img, comp, by_ as "by", bx, coef as level from coefs where k = 0')
def dc_levels(spark, d):
    diffs = B.dc_differences(coefs(spark, d), 16).withColumn("_n", F.col("by") * 16 + F.col("bx"))
    return R.delta_decode(diffs, ["img", "comp"], ["_n"], "diff").drop("_n", "diff")


@query("quality_tables", f"""with q as (select event_id % 100 + 1 as q from events), s as (select q, case when q < 50 then 5000 // q else 200 - 2 * q end as s from q),
e as (select q, s, unnest([{_TABLE}]) as base, unnest(range(0, 64)) as k from s)
select q, k, greatest(1, least(255, (base * s + 50) // 100)) as entry, count(*) as n from e group by all""")
def quality_tables(spark, d):
    rated = T.table(spark, d, "events").select((F.col("event_id") % 100 + 1).alias("q")).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    return rated.select("q", "n", F.posexplode(F.array(*[F.lit(v) for v in B.LUMINANCE])).alias("k", "base")).select(
        "q", F.col("k").cast("bigint").alias("k"), media.scaled_entry(F.col("base"), media.quality_scale(F.col("q"))).alias("entry"), "n")
