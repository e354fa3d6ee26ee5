"""Registered queries over the scalar function set."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflux.functions import conditions, fbits, ieee, media, registry, text
from strataflux.plans.registry import query
from strataflux.sources.tables import table, ticks


def r6(col, digits=6):
    return (F.round(col, digits) + F.lit(0.0)).cast("double")


def q6(expr, digits=6):
    """SQL twin of r6; minus zero becomes zero."""
    return f"cast(case when round({expr}, {digits}) = 0 then 0.0 else round({expr}, {digits}) end as double)"


def shown(df, exact, **cols):
    """Numbers that may be special, each as a class and a value; exact ones are not rounded."""
    named = df.select("k", "n", *[c.alias(name) for name, c in cols.items()])
    out = []
    for name in cols:
        col = F.col(name)
        cls = (
            F.when(F.isnan(col), "nan").when(col == float("inf"), "inf").when(col == float("-inf"), "-inf")
            .when((col == 0) & ieee.signbit(col), "-0").otherwise("num")
        )
        out += [cls.alias(f"{name}_cls"), F.when(cls == "num", (col + 0.0) if exact else r6(col)).alias(name)]
    return named.select("k", "n", *out)


def q_shown(source, exact, **cols):
    """SQL twin of shown over the relation `source`."""
    out = []
    for name in cols:
        cls = (f"case when isnan({name}) then 'nan' when {name} = 'inf'::double then 'inf' when {name} = '-inf'::double then '-inf'"
               f" when {name} = 0 and signbit({name}) then '-0' else 'num' end")
        out.append(f"{cls} as {name}_cls, case when ({cls}) = 'num' then {name if exact else q6(name)} end as {name}")
    inner = ", ".join(f"cast({e} as double) as {name}" for name, e in cols.items())
    return f"select k, n, {', '.join(out)} from (select k, n, {inner} from {source})"


# x and y: prices and quantities around zero, with every special value by part key
OPERANDS = """ops as (
  select l_orderkey as k, l_linenumber as n,
    case l_partkey % 41 when 0 then 'nan'::double when 1 then 'inf'::double when 2 then '-inf'::double
      when 3 then 0.0::double when 4 then '-0.0'::double else (l_extendedprice - 40000) / 10000 end as x,
    case l_suppkey % 43 when 0 then 'nan'::double when 1 then 'inf'::double when 2 then '-inf'::double
      when 3 then 0.0::double when 4 then '-0.0'::double else (l_quantity - 25) / 4 end as y
  from lineitem)
"""


def operands(spark, d):
    def special(key, mod, col):
        pick = F.col(key) % mod
        return (
            F.when(pick == 0, float("nan")).when(pick == 1, float("inf")).when(pick == 2, float("-inf"))
            .when(pick == 3, 0.0).when(pick == 4, F.lit(-0.0)).otherwise(col)
        )
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        special("l_partkey", 41, (F.col("l_extendedprice") - 40000) / 10000).alias("x"),
        special("l_suppkey", 43, (F.col("l_quantity") - 25) / 4).alias("y"),
    )


_TRIG = {"sin": "sin(u)", "cos": "cos(u)", "tan": "tan(u)", "asin": "asin(u)", "acos": "acos(u)", "atan": "atan(u)",
         "atanh": "atanh(u)", "sinh": "sinh(u)", "cosh": "cosh(u)", "tanh": "tanh(u)", "etox": "exp(u)",
         "etoxm1": "exp(u) - 1", "twotox": "pow(2, u)", "tentox": "pow(10, u)"}


@query("fn_transcendental", "with ops as (select l_orderkey as k, l_linenumber as n, (l_quantity - 25.5) / 25.5 as u from lineitem)\n"
       + "select k, n, " + ", ".join(f"{q6(e)} as {n}" for n, e in _TRIG.items()) + f", {q6('sin(u)')} as s2, {q6('cos(u)')} as c2 from ops")
def fn_transcendental(spark, d):
    u = F.col("u")
    ops = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), ((F.col("l_quantity") - 25.5) / 25.5).alias("u"))
    both = ieee.fsincos(u)
    return ops.select(
        "k", "n", *[r6(ieee.MONADIC["f" + n](u)).alias(n) for n in _TRIG],
        r6(both.getField("sin")).alias("s2"), r6(both.getField("cos")).alias("c2"))


def _q_log(fn, pole="0"):
    arg = "x" if pole == "0" else "1 + x"
    return (f"case when isnan(x) or x < {pole} then 'nan'::double when x = {pole} then '-inf'::double"
            f" when x = 'inf'::double or (x = 0 and {pole} <> 0) then x else {fn}(case when isnan(x) or x <= {pole} or x = 'inf'::double then 1.0 else {arg} end) end")


@query("fn_log", "with " + OPERANDS + q_shown(
    "ops", False, logn=_q_log("ln"), log2=_q_log("log2"), log10=_q_log("log10"), lognp1=_q_log("ln", "-1")))
def fn_log(spark, d):
    return shown(operands(spark, d), False, **{n: ieee.MONADIC["f" + n](F.col("x")) for n in ("logn", "log2", "log10", "lognp1")})


_ROUNDINGS = {"rn": "round_even(x, 0)", "rm": "floor(x)", "rp": "ceil(x)", "rz": "trunc(x)"}
_INTS = {m: (f"case when isnan(x) or isinf(x) then x when {e} = 0 then case when signbit(x) then '-0.0'::double else 0.0 end else {e} end")
         for m, e in _ROUNDINGS.items()}


@query("fn_int", "with " + OPERANDS + q_shown("ops", True, **_INTS, intrz=_INTS["rz"]))
def fn_int(spark, d):
    x = F.col("x")
    return shown(operands(spark, d), True, **{m: ieee.fint(x, m) for m in _ROUNDINGS}, intrz=ieee.fintrz(x))


@query("fn_parts", "with " + OPERANDS + """, parts as (
  select *, case when isnan(x) or isinf(x) or x = 0 then null else floor(log2(abs(x) * (1 + 1e-15))) end as e from ops)
""" + q_shown(
    "parts", True,
    getexp="case when isnan(x) or isinf(x) then 'nan'::double when x = 0 then x else e end",
    getman="case when isnan(x) or isinf(x) then 'nan'::double when x = 0 then x else x / pow(2, e) end",
    scale="case when isnan(x) or isnan(y) or isinf(y) then 'nan'::double when x = 0 or isinf(x) then x else x * pow(2, trunc(y)) end"))
def fn_parts(spark, d):
    x, y = F.col("x"), F.col("y")
    return shown(operands(spark, d), True, getexp=ieee.fgetexp(x), getman=ieee.fgetman(x), scale=ieee.fscale(x, y))


_DIV = ("case when isnan(x) or isnan(y) or (x = 0 and y = 0) or (isinf(x) and isinf(y)) then 'nan'::double"
        " when y = 0 or isinf(x) then case when signbit(x) <> signbit(y) then '-inf'::double else 'inf'::double end"
        " else x / case when y = 0 then 1 else y end end")


@query("fn_arith", "with " + OPERANDS + ", fin as (select *, isnan(x) or isinf(x) or isnan(y) or isinf(y) as s from ops) " + q_shown(
    "fin", True,
    add="case when isnan(x) or isnan(y) or (isinf(x) and isinf(y) and x <> y) then 'nan'::double else x + y end",
    sub="case when isnan(x) or isnan(y) or (isinf(x) and isinf(y) and x = y) then 'nan'::double else x - y end",
    mul="case when isnan(x) or isnan(y) or (isinf(x) and y = 0) or (x = 0 and isinf(y)) then 'nan'::double else x * y end",
    div=_DIV,
    sadd="case when isnan(x) or isnan(y) or (isinf(x) and isinf(y) and x <> y) then 'nan'::double when s then x + y else cast(cast(x + y as float) as double) end",
    sglmul="case when isnan(x) or isnan(y) or (isinf(x) and y = 0) or (x = 0 and isinf(y)) then 'nan'::double when s then x * y else cast(cast(cast(x as float)::double * cast(y as float)::double as float) as double) end"))
def fn_arith(spark, d):
    x, y = F.col("x"), F.col("y")
    return shown(
        operands(spark, d), True, add=ieee.fadd(x, y), sub=ieee.fsub(x, y), mul=ieee.fmul(x, y), div=ieee.fdiv(x, y),
        sadd=ieee.DYADIC["fsadd"](x, y), sglmul=ieee.fsglmul(x, y))


@query("fn_rem", """
with ints as (select l_orderkey as k, l_linenumber as n, cast(round((l_extendedprice - 40000) * 100) as bigint) as a,
                     l_partkey % 37 * 5 - 60 as b from lineitem), div as (
  select *, abs(a) // nullif(abs(b), 0) as q, abs(a) % nullif(abs(b), 0) as r from ints), near as (
  select *, (2 * r > abs(b) or (2 * r = abs(b) and q % 2 = 1)) as up from div)
select k, n, a, b, case when b = 0 then 'nan'::double when a < 0 then -r else r end + 0.0::double as md,
       case when b = 0 then 'nan'::double when a < 0 then -(r - case when up then abs(b) else 0 end) else r - case when up then abs(b) else 0 end end + 0.0::double as rm,
       q % 128 + case when (a < 0) <> (b < 0) then 128 else 0 end as qmod,
       (q + case when up then 1 else 0 end) % 128 + case when (a < 0) <> (b < 0) then 128 else 0 end as qrem
from near""")
def fn_rem(spark, d):
    ints = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        F.round((F.col("l_extendedprice") - 40000) * 100).cast("bigint").alias("a"),
        (F.col("l_partkey") % 37 * 5 - 60).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return ints.select("k", "n", "a", "b", (ieee.fmod(a, b) + 0.0).alias("md"), (ieee.frem(a, b) + 0.0).alias("rm"),
                       ieee.fquotient(a, b).alias("qmod"), ieee.fquotient(a, b, nearest=True).alias("qrem"))


# truth of each predicate over (un)ordered, less, equal, greater, written out
_SQL_COND = {
    "f": "false", "eq": "e", "ogt": "g", "oge": "g or e", "olt": "l", "ole": "l or e", "ogl": "l or g", "or": "not u",
    "un": "u", "ueq": "u or e", "ugt": "u or g", "uge": "not l", "ult": "u or l", "ule": "not g", "ne": "not e", "t": "true",
}
_SIGNALLING = dict(zip("sf seq gt ge lt le gl gle ngle ngl nle nlt nge ngt sne st".split(), _SQL_COND))


@query("fcond", "with " + OPERANDS + """, rel as (
  select k, n, isnan(x) or isnan(y) as u, not (isnan(x) or isnan(y)) and x < y as l,
         not (isnan(x) or isnan(y)) and x = y as e, not (isnan(x) or isnan(y)) and x > y as g from ops)
select k, n, """ + " || ".join(
    f"case when {c} then '1' else '0' end" for c in [*_SQL_COND.values(), *[_SQL_COND[q] for q in _SIGNALLING.values()]])
    + " as taken, case when u then 16 else 0 end as n_bsun from rel")
def fcond(spark, d):
    x, y = F.col("x"), F.col("y")
    got = {p: conditions.fcond(p, x, y) for p in conditions.PREDICATES}
    return operands(spark, d).select(
        "k", "n", F.concat(*[F.when(c.getField("taken"), "1").otherwise("0") for c in got.values()]).alias("taken"),
        sum(c.getField("bsun").cast("int") for c in got.values()).alias("n_bsun"))


_SQL_BRANCH = {
    "f": "false", "eq": "z", "ogt": "not (nn or z or n)", "oge": "z or not (nn or n)", "olt": "n and not (nn or z)",
    "ole": "z or (n and not nn)", "ogl": "not (nn or z)", "or": "not nn", "un": "nn", "ueq": "nn or z",
    "ugt": "nn or not (n or z)", "uge": "nn or z or not n", "ult": "nn or (n and not z)", "ule": "nn or z or n",
    "ne": "not z", "t": "true",
}


@query("branch", """with codes as (select event_id, user_id % 2 = 1 as n, (user_id // 2) % 2 = 1 as z, (event_id // 3) % 2 = 1 as nn from events)
select event_id, """ + " || ".join(
    f"case when {c} then '1' else '0' end" for c in [*_SQL_BRANCH.values(), *[_SQL_BRANCH[q] for q in _SIGNALLING.values()]])
    + " as taken, case when nn then 16 else 0 end as n_bsun from codes")
def branch(spark, d):
    codes = table(spark, d, "events").select(
        "event_id", F.expr("user_id % 2 = 1").alias("n"), F.expr("(user_id div 2) % 2 = 1").alias("z"),
        F.expr("(event_id div 3) % 2 = 1").alias("nn"))
    got = [conditions.branch(p, F.col("n"), F.col("z"), F.col("nn")) for p in conditions.PREDICATES]
    return codes.select(
        "event_id", F.concat(*[F.when(c.getField("taken"), "1").otherwise("0") for c in got]).alias("taken"),
        sum(c.getField("bsun").cast("int") for c in got).alias("n_bsun"))


@query("ftst_fcmp", "with " + OPERANDS + """
select k, n, case when isnan(x) then false else signbit(x) end as tn, not isnan(x) and x = 0 as tz, isinf(x) as ti, isnan(x) as tnan,
       not (isnan(x) or isnan(y)) and (x < y or (x = y and signbit(x))) as cn,
       not (isnan(x) or isnan(y)) and x = y as cz, isnan(x) or isnan(y) as cnan from ops""")
def ftst_fcmp(spark, d):
    t, c = conditions.ftst(F.col("x")), conditions.fcmp(F.col("x"), F.col("y"))
    return operands(spark, d).select(
        "k", "n", *[t.getField(f).alias("t" + f) for f in ("n", "z", "i", "nan")],
        *[c.getField(f).alias("c" + f) for f in ("n", "z", "nan")])


@query("packed_decimal", """
with p as (select l_orderkey as k, l_linenumber as n, l_extendedprice - 40000 as x, printf('%.9e', l_extendedprice - 40000) as t from lineitem), q as (
  select k, n, round(x, 2) as x, replace(replace(split_part(printf('%.9e', round(x, 2)), 'e', 1), '-', ''), '.', '') as m,
         cast(split_part(printf('%.9e', round(x, 2)), 'e', 2) as int) as e from p)
select k, n, x as value, case when x < 0 then case when e < 0 then 'c' else '8' end else case when e < 0 then '4' else '0' end end
       || lpad(cast(abs(e) as varchar), 3, '0') || '000' || rpad(m, 17, '0') as packed from q""")
def packed_decimal(spark, d):
    x = F.round(F.col("l_extendedprice") - 40000, 2)
    packed = ieee.packed_hex(F.col("x"), -2)
    return (
        table(spark, d, "lineitem")
        .select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), x.alias("x"))
        .select("k", "n", packed.alias("packed"), ieee.packed_value(packed).alias("value"))
    )


@query("number_bits", """
select o_orderkey, lower(hex(cast(cast(o_totalprice - 200000 as bit) as blob))) as bits,
       o_totalprice - 200000 as back_d, cast(cast(o_totalprice - 200000 as float) as double) as back_s,
       o_totalprice - 200000 as back_x, cast(o_custkey - 500 as double) as back_w
from orders""")
def number_bits(spark, d):
    # one select per step: each step's columns are used several times by the next
    x = F.col("o_totalprice") - 200000
    ops = table(spark, d, "orders").select(
        "o_orderkey", x.alias("x"), x.cast("float").cast("double").alias("s"),
        F.lpad(F.hex(((F.col("o_custkey") - 500) % 65536 + 65536) % 65536), 24, "0").alias("w_hex"))
    hexed = ops.select(
        "*", fbits.double_digits(F.col("x")).alias("bits"), fbits.double_digits(F.col("s")).alias("wide"),
        fbits.extended_digits(F.col("x")).alias("x_hex"))
    # the single form of a normal number, built from its double form
    exp = F.conv(F.substring("wide", 1, 3), 16, 10).cast("bigint")
    word = (
        F.when(exp >= 2048, F.lit(1 << 31)).otherwise(0) + (exp % 2048 - 1023 + 127) * (1 << 23)
        + F.shiftright(F.conv(F.substring("wide", 4, 13), 16, 10).cast("bigint"), 29)
    )
    singles = hexed.select("*", F.lpad(F.hex(word.cast("bigint")), 24, "0").alias("s_hex"))
    return singles.select(
        "o_orderkey", "bits", fbits.double_value(F.lpad("bits", 24, "0")).alias("back_d"),
        F.when(F.col("s") == 0, 0.0).otherwise(fbits.single_value(F.col("s_hex"))).alias("back_s"),
        fbits.extended_value(F.col("x_hex")).alias("back_x"),
        fbits.integer_value(F.col("w_hex"), "w").cast("double").alias("back_w"))


@query("constant_cleanup", """
select o_orderkey, case o_orderkey % 3 when 0 then 'l' when 1 then 'x' end as size, lpad(printf('%08x', o_orderkey) || printf('%04x', o_custkey % 65536), 24, '0') as digits
from orders""")
def constant_cleanup(spark, d):
    token = F.concat(
        F.expr("case o_orderkey % 3 when 0 then '[l]' when 1 then '[x]' else '' end"),
        F.lower(F.lpad(F.hex("o_orderkey"), 8, "0")), F.lit("_"),
        F.lower(F.lpad(F.hex(F.col("o_custkey") % 65536), 4, "0")), F.lit("("), F.col("o_totalprice").cast("string"), F.lit(")"))
    got = fbits.clean_constant(token)
    return table(spark, d, "orders").where(fbits.is_constant(token)).select(
        "o_orderkey", got.getField("size").alias("size"), got.getField("digits").alias("digits"))


@query("ulp_distance", """
with pairs as (select l_orderkey as k, l_linenumber as n, l_extendedprice as a, l_quantity * (floor(l_extendedprice / l_quantity * 100) / 100) as b from lineitem), bits as (
  select k, n, cast('0x' || hex(cast(cast(a as bit) as blob)) as bigint) as ia, cast('0x' || hex(cast(cast(b as bit) as blob)) as bigint) as ib from pairs)
select k, n, case when abs(ia - ib) > 2147483647 then 2147483647 else abs(ia - ib) end as ulps, abs(ia - ib) <= 2 as ok from bits""")
def ulp_distance(spark, d):
    a, b = F.col("l_extendedprice"), F.col("l_quantity") * (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100)
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), a.alias("a"), b.alias("b"))
    hexed = pairs.select(
        "k", "n", F.lpad(fbits.double_digits(F.col("a")), 24, "0").alias("a"), F.lpad(fbits.double_digits(F.col("b")), 24, "0").alias("b"))
    far = hexed.select("k", "n", fbits.ulp_diff(F.col("a"), F.col("b"), F.lit("d"), F.lit("x")).alias("ulps"))
    return far.select("k", "n", "ulps", (F.col("ulps") <= fbits.tolerance(F.lit("d"), F.lit("x"), F.lit(False))).alias("ok"))


@query("basic_functions", "with ops as (select l_orderkey as k, l_linenumber as n, l_quantity / 10 as x, l_discount as y from lineitem)\nselect k, n, "
       + ", ".join(f"{q6(e)} as {n}" for n, e in {
           "sgn": "sign(x - 2)", "deg": "degrees(x)", "rad": "radians(x)", "whole": "floor(x)", "power": "pow(x, y)",
           "root": "sqrt(x)", "circle": "pi() * x"}.items())
       + ", x > y as gt, x <= y as le, cast(floor(x) as bigint) as as_int from ops")
def basic_functions(spark, d):
    ops = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") / 10).alias("x"), F.col("l_discount").alias("y"))
    x, y, call = F.col("x"), F.col("y"), registry.call
    return ops.select(
        "k", "n", r6(call("sgn", x - 2)).alias("sgn"), r6(call("deg", x)).alias("deg"), r6(call("rad", x)).alias("rad"),
        r6(call("int", x)).alias("whole"), r6(call("power", x, y)).alias("power"), r6(call("sqr", x)).alias("root"),
        r6(call("pi") * x).alias("circle"), call("gt", x, y).alias("gt"), call("le", x, y).alias("le"),
        call("float_int", x).alias("as_int"))


_TRIMMED = "regexp_replace(regexp_replace({0}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


@query("number_text", "select l_orderkey as k, l_linenumber as n, printf('%.2f', l_extendedprice) as fixed, "
       + "case when l_quantity / 8 < 1 then " + _TRIMMED.format("printf('%.6f', l_quantity / 8)") + " else "
       + _TRIMMED.format("printf('%.5f', l_quantity / 8)") + " end as short, l_quantity / 8 as back from lineitem")
def number_text(spark, d):
    x = F.col("l_quantity") / 8
    short = text.number_text(x)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), text.fixed_text(F.col("l_extendedprice"), 2).alias("fixed"),
        short.alias("short"), text.text_number(short).alias("back"))


@query("printable_text", """
with norm as (select doc_id, regexp_replace(replace(text, '\\', '\\\\'), '\\r\\n?', chr(10), 'g') as t from documents), esc as (
  select doc_id, list_aggregate(list_transform(string_split(t, ''), lambda c: case when c = chr(10) or (ord(c) between 32 and 126 and length(c) = 1) then c
    else list_aggregate(list_transform(range(1, octet_length(encode(c)) + 1), lambda i: '\\' || printf('%03o', cast('0x' || substr(hex(encode(c)), 2 * i - 1, 2) as int))), 'string_agg', '') end),
    'string_agg', '') as p from norm)
select doc_id, md5(coalesce(p, '')) as digest, length(coalesce(p, '')) as n from esc""")
def printable_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.printable(F.col("text")).alias("p")).select(
        "doc_id", F.md5("p").alias("digest"), F.length("p").cast("bigint").alias("n"))


_BASES = "16 11 10 16 24 40 51 61"


@query("media_scalars", """
with e as (select event_id, user_id, epoch_us(ts) as us, value from events), f as (
  select *, (us * 9 // 100) % 8589934592 as ticks, 1 + event_id % 100 as q, cast(floor(value * 100) as bigint) - 2000 as v from e), g as (
  select *, case when q < 50 then 5000 // q else 200 - 2 * q end as scale from f)
select event_id, user_id % 24 * 3600 + event_id % 60 * 60 + event_id % 59 + (event_id % 25) / 25.0::double as tc,
       round(ticks / 90000.0::double, 6) as secs, ticks as joined, user_id * 50 as rate, scale,
       greatest(1, least(255, (16 * scale + 50) // 100)) as entry, greatest(1, least(32767, (99 * scale + 50) // 100)) as wide_entry,
       case when v = 0 then 0 else length(ltrim(cast(cast(abs(v) as bit) as varchar), '0')) end as category from g""")
def media_scalars(spark, d):
    e = table(spark, d, "events").select(
        "event_id", "user_id", ticks(F.col("ts")).alias("ticks"),
        (F.col("event_id") % 100 + 1).alias("q"), (F.floor(F.col("value") * 100).cast("bigint") - 2000).alias("v"))
    eid, scale = F.col("event_id"), media.quality_scale(F.col("q"))
    joined = media.clock_ticks(F.shiftright("ticks", 32), F.col("ticks").bitwiseAND((1 << 32) - 1))
    return e.select(
        "event_id", media.timecode_seconds(F.col("user_id") % 24, eid % 60, eid % 59, eid % 25, 25).alias("tc"),
        F.round(media.clock_seconds(joined), 6).alias("secs"), joined.alias("joined"),
        media.mux_bytes_per_second(F.col("user_id")).alias("rate"), scale.alias("scale"),
        media.scaled_entry(F.lit(16), scale).alias("entry"), media.scaled_entry(F.lit(99), scale, baseline=False).alias("wide_entry"),
        media.size_category(F.col("v")).alias("category"))
