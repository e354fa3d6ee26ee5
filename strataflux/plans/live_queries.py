"""Registered streaming jobs: each reads a table as a stream until it is used up and returns what was written."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from strataflux.functions import fbits, ieee
from strataflux.operators import conformance as C
from strataflux.operators import evaluate as E
from strataflux.plans import fixtures_sql as X
from strataflux.plans.registry import query
from strataflux.session import scratch_path
from strataflux.sources import tables as T
from strataflux.sources import vectors as V
from strataflux.streaming import live as L
from strataflux.streaming import state as S


DELIVERY_ROWS = 250_000


def _deliveries(spark, d, into, folder):
    """Events as one file for each delivery, `slot=i` below `folder`, all written by one job.

    `into` gives the number of a row's delivery from columns `slot` (0 .. n - 1, by event_id) and the table's own.
    """
    events = T.table(spark, d, "events")
    rows, top = events.agg(F.count(F.lit(1)), F.max("event_id")).first()
    n = max(4, -(-rows // DELIVERY_ROWS))
    placed = events.withColumn("slot", F.expr(f"event_id * {n} div {(top or 0) + 1}")).withColumn("slot", F.expr(into))
    placed.where(F.col("slot").between(0, n)).repartition(n + 1, "slot").write.partitionBy("slot").parquet(folder)
    return n


def _arrive(spark, source, slots, folder, since):
    """Put the files of these deliveries into the watched `folder`, each a second newer than the one before: a stream takes old files first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(hadoop.Path(folder))
    for i in slots:
        at = hadoop.Path(f"{source}/slot={i}")
        for name in [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []:
            if name.startswith("part-"):
                there = hadoop.Path(f"{folder}/{i}-{name}")
                if not store.rename(hadoop.Path(f"{source}/slot={i}/{name}"), there):
                    raise OSError(f"{name} could not be moved to {folder}")
                store.setTimes(there, since + i * 1000, -1)


def _twice(spark, d, label, job, into="slot"):
    """What `job` writes of the event stream, stopped after half of the deliveries and started again for the rest."""
    made, folder, out, check = (scratch_path(spark, f"{label}-{n}") for n in ("made", "in", "out", "checkpoint"))
    n, since = _deliveries(spark, d, into, made), int(time.time() * 1000)
    for slots in (range(n // 2), range(n // 2, n + 1)):
        _arrive(spark, made, slots, folder, since)
        done = job(L.file_stream(spark, folder, T.table(spark, d, "events").schema, files_per_batch=1))
        L.append_to(done, out, check, small_batches=True).awaitTermination()
    return spark.read.schema(done.schema).parquet(out)


def _timed(events):
    """Events as packets and pictures with their event time."""
    return events.select(
        F.expr("user_id % 8").alias("stream"), F.timestamp_micros(T.micros(F.col("ts"))).alias("at"),
        F.length("props").cast("bigint").alias("payload_bytes"),
        F.expr("case event_type when 'signup' then 'I' when 'purchase' then 'P' else 'B' end").alias("ptype"))


def _closed(spark, d, label, job):
    """All groups that `job` makes of the timed events: a closing row comes last, so none stays open."""
    folder = scratch_path(spark, f"{label}-in")
    events = T.table(spark, d, "events")
    events.write.parquet(folder)
    L.closing_row(events, "ts").coalesce(1).write.mode("append").parquet(folder)
    return _appended(spark, job(_timed(L.file_stream(spark, folder, events.schema))), label)


def _appended(spark, df, label):
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    L.append_to(df, out, checkpoint).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


_TIMED = """e as (select user_id % 8 as stream, epoch_us(ts) as us, length(props) as n, event_type from events)"""


@query("live_windows", "with " + _TIMED + """
select stream, us // 300000000 * 300 as from_s, us // 300000000 * 300 + 300 as to_s, count(*) as n, cast(sum(n) as bigint) as payload_bytes
from e group by stream, us // 300000000""")
def live_windows(spark, d):
    return _closed(spark, d, "windows", lambda e: L.packet_windows(e, "10 minutes", "5 minutes"))


@query("live_sliding_windows", "with " + _TIMED + """, s as (select stream, n, us // 300000000 * 300 - 300 * k as from_s from e, (select unnest([0, 1, 2]) as k))
select stream, from_s, from_s + 900 as to_s, count(*) as n, cast(sum(n) as bigint) as payload_bytes from s group by stream, from_s""")
def live_sliding_windows(spark, d):
    return _closed(spark, d, "sliding", lambda e: L.packet_windows(e, "10 minutes", "15 minutes", "5 minutes"))


@query("live_sessions", "with " + _TIMED + """, m as (
  select *, case when us - lag(us) over (partition by stream order by us) < 1800000000 then 0 else 1 end as f from e), g as (
  select *, sum(f) over (partition by stream order by us rows unbounded preceding) as s from m)
select stream, min(us) as from_us, max(us) + 1800000000 as to_us, count(*) as n, count(*) filter (event_type = 'signup') as n_i
from g group by stream, s""")
def live_sessions(spark, d):
    return _closed(spark, d, "sessions", lambda e: L.picture_sessions(e, "10 minutes", "30 minutes"))


@query("live_delta_decode", """
select user_id as part, event_id as pos, cast(sum(cast(floor(value * 100) as bigint) - 2500) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as level from events""")
def live_delta_decode(spark, d):
    def job(events):
        deltas = events.select(F.col("user_id").alias("part"), F.col("event_id").alias("pos"), (F.floor(F.col("value") * 100).cast("bigint") - 2500).alias("delta"))
        return S.running_levels(deltas, ["part"], "pos", "delta")

    return _twice(spark, d, "levels", job).select("part", "pos", "level")


@query("live_first_stream", "with " + X.PACKETS + """, seen as (
  select stream, stream_id, min(case when kind = 'header' then seq end) as hs, min(case when kind = 'packet' then seq end) as ps from packets group by all), fv as (
  select stream, arg_min(stream_id, least(hs, ps)) as vid from seen where stream_id between 224 and 239 group by stream)
select p.stream, p.stream_id, seq, payload_bytes, coalesce(hs < seq, false) as declared,
  stream_id between 192 and 239 and not coalesce(hs < seq, false) and seq > ps as adopted, coalesce(stream_id = vid, false) as chosen
from packets p left join seen using (stream, stream_id) left join fv using (stream) where kind = 'packet'""")
def live_first_stream(spark, d):
    return _twice(spark, d, "first", lambda e: S.first_streams(T.packets(e)))


# rows of user_id % 10 = 7 are held back by one delivery
_HELD = "slot + if(user_id % 10 = 7, 1, 0)"


@query("live_late_split", f"""
with n as (select greatest(4, (count(*) + {DELIVERY_ROWS - 1}) // {DELIVERY_ROWS}) as n, max(event_id) + 1 as top from events), e as (
  select user_id % 8 as stream, event_id as seq, epoch_us(ts) as us, event_id * n // top + case when user_id % 10 = 7 then 1 else 0 end as slot from events, n), marks as (
  select slot, max(max(us // 1000)) over (order by slot rows between unbounded preceding and 1 preceding) - 600000 as mark from e group by slot), t as (
  select stream, seq, slot, us, coalesce(us < mark * 1000, false) as late from e join marks using (slot))
select stream, seq, late, cast(sum(cast(late as int)) over (partition by stream order by slot, us, seq rows unbounded preceding) as bigint) as late_so_far from t""")
def live_late_split(spark, d):
    def job(events):
        return S.late_flags(events.select(F.expr("user_id % 8").alias("stream"), F.col("event_id").alias("seq"), T.micros(F.col("ts")).alias("at_us")), "10 minutes")

    return _twice(spark, d, "late", job, _HELD).select("stream", "seq", "late", "late_so_far")


@query("live_distinct", "select distinct l_suppkey as suite, l_partkey as line_no from lineitem")
def live_distinct(spark, d):
    lines = L.file_stream(spark, d, T.table(spark, d, "lineitem").schema, glob="lineitem.parquet").select(
        F.col("l_suppkey").alias("suite"), F.col("l_partkey").alias("line_no"), F.timestamp_micros(T.micros(F.col("l_shipdate"))).alias("at"))
    return _appended(spark, L.distinct_within(lines, ["suite", "line_no"], "1 day"), "distinct").select("suite", "line_no")


_CHECKED = ("fadd", "fsub", "fmul", "fdiv", "fabs", "fneg", "fsqrt", "fetox", "flogn", "fint")


def _checked_text(spark, d, path=None):
    """Vector files from line items: exact operands, results from the same arithmetic, some spoiled."""
    x, y = F.col("l_extendedprice"), F.col("l_quantity")
    small = y / 16
    ops = T.table(spark, d, "lineitem").select(
        F.element_at(F.array(*[F.lit(o) for o in _CHECKED]), (F.col("l_partkey") % len(_CHECKED) + 1).cast("int")).alias("op"),
        x.alias("x"), y.alias("y"), small.alias("s"), (F.col("l_suppkey") % 20 == 7).alias("spoiled"))
    r = F.when(F.col("op") == "fadd", F.col("x") + F.col("y")).when(F.col("op") == "fsub", F.col("x") - F.col("y")).when(
        F.col("op") == "fmul", F.col("x") * F.col("y")).when(F.col("op") == "fdiv", F.col("x") / F.col("y")).when(
        F.col("op") == "fabs", F.col("s")).when(F.col("op") == "fneg", -F.col("s")).when(F.col("op") == "fsqrt", F.sqrt("s")).when(
        F.col("op") == "fetox", F.exp("s")).when(F.col("op") == "flogn", F.ln("s")).otherwise(ieee.fint(F.col("s")))
    two = F.col("op").isin("fadd", "fsub", "fmul", "fdiv")
    # a doubled result is one exponent away and far off
    done = ops.select("op", two.alias("two"), F.when(two, F.col("x")).otherwise(F.col("s")).alias("a"), F.col("y"), F.when(F.col("spoiled"), r * 8).otherwise(r).alias("r"))
    hexed = done.select("op", "two", fbits.double_digits(F.col("a")).alias("a"), fbits.double_digits(F.col("y")).alias("b"), fbits.extended_digits(F.col("r")).alias("e"))
    line = F.concat(F.col("op"), F.lit(".d "), F.when(F.col("two"), F.concat(F.lit("[d]"), "a", F.lit(" "), "b")).otherwise(F.col("a")), F.lit(" = "), "e", F.lit(" ~nan"))
    path = path or scratch_path(spark, "checked")
    hexed.select(line.alias("value")).write.text(path)
    return path


_CHECKED_SQL = f"""
with v as (select {list(_CHECKED)}[l_partkey % {len(_CHECKED)} + 1] as op, l_suppkey % 20 = 7 as spoiled, l_quantity / 16 as s, l_extendedprice as x, l_quantity as y from lineitem), r as (
  select op, spoiled, case op when 'fsub' then x - y when 'flogn' then ln(s) when 'fint' then round_even(s, 0) else 1 end as r from v)
select op, case when spoiled and r <> 0 then 'mismatch' else 'ok' end as verdict, count(*) as n from r group by 1, 2"""


@query("vector_verdicts", _CHECKED_SQL)
def vector_verdicts(spark, d):
    parsed, _ = V.parse_vectors(V.read_vectors(spark, _checked_text(spark, d)))
    bound, _ = C.bind_ops(parsed, C.catalogue(spark))
    return E.run_vectors(bound).groupBy("op", "verdict").agg(F.count(F.lit(1)).alias("n"))


# the 32 conditions in pairs: the second of a pair is the signalling twin of the first
_CONDITIONS = ("f sf eq seq ogt gt oge ge olt lt ole le ogl gl or gle un ngle ueq ngl ugt nle uge nlt ult nge ule ngt ne sne t st").split()
_BRANCH_SQL = f"""with b as (select l_orderkey, l_linenumber, {_CONDITIONS}[l_partkey % 32 + 1] as p, l_partkey % 32 as pos, l_suppkey % 2 = 1 as n, l_orderkey % 3 = 0 as z, l_linenumber % 2 = 0 as nan,
  (l_orderkey // 4) % 2 = 0 as enabled, l_quantity % 2 = 0 as expected from lineitem), s as (
  select *, pos % 2 = 1 and nan as bsun, nan and not (pos % 2 = 1 and enabled) as u from b), r as (
  select *, case pos // 2 when 0 then false when 1 then z when 2 then not (u or z or n) when 3 then z or not (u or n) when 4 then n and not (u or z) when 5 then z or (n and not u)
    when 6 then not (u or z) when 7 then not u when 8 then u when 9 then u or z when 10 then u or not (n or z) when 11 then u or z or not n when 12 then u or (n and not z)
    when 13 then u or z or n when 14 then not z else true end as goes from s)
select 'fb' || p as op, case when goes = expected and not bsun then 'ok' else 'mismatch' end as verdict,
  concat_ws(',', case when expected and not goes then 'taken' end, case when bsun then '~aiop' end, case when bsun then '~bsun' end, case when goes and not expected then '~taken' end) as failed, count(*) as n
from r group by all"""


@query("branch_verdicts", _BRANCH_SQL)
def branch_verdicts(spark, d):
    """A conditional branch for each line item, expected to be (not) taken and to raise nothing."""
    names = F.element_at(F.array(*[F.lit(c) for c in _CONDITIONS]), (F.col("l_partkey") % 32 + 1).cast("int"))
    line = F.concat(F.lit("fb"), names, F.expr("""concat('.w ', if(l_suppkey % 2 = 1, 'n ', ''), if(l_orderkey % 3 = 0, 'z ', ''), if(l_linenumber % 2 = 0, 'nan ', ''),
      if((l_orderkey div 4) % 2 = 0, 'bsun ', ''), '= ~bsun ~aiop ', if(l_quantity % 2 = 0, 't', '~t'), ' q:00')"""))
    path = scratch_path(spark, "branches")
    T.table(spark, d, "lineitem").select(line.alias("value")).write.text(path)
    parsed, _ = V.parse_vectors(V.read_vectors(spark, path))
    bound, _ = C.bind_ops(parsed, C.catalogue(spark))
    return E.run_vectors(bound).groupBy("op", "verdict", F.array_join(F.array_sort("failed"), ",").alias("failed")).agg(F.count(F.lit(1)).alias("n"))


_FLAG_SQL = """with v as (select l_partkey % 4 as kind, cast(l_quantity as double) as a, cast(l_suppkey % 3 - 1 as double) as b, l_linenumber % 2 = 0 as said, l_orderkey % 128 as q from lineitem), g as (
  select *, case kind when 0 then a < b when 1 then b < 0 else false end as n, case kind when 0 then a = b when 1 then b = 0 else false end as z,
    kind = 2 and b = 0 as dz, case when kind = 3 then case when b = 0 then null else (cast(a as bigint) % 128) + case when b < 0 then 128 else 0 end end end as qb, kind = 3 and b = 0 as operr from v), f as (
  select ['fcmp', 'ftst', 'fdiv', 'fmod'][kind + 1] as op, case when kind = 3 and b = 0 then true else false end as unsure, array_to_string(list_sort(list_filter([
    case when kind < 2 and n <> said then case when said then 'n' else '~n' end end,
    case when kind >= 2 and dz <> said then case when said then 'dz' else '~dz' end end, case when operr then '~operr' end,
    case when kind = 3 and b <> 0 and qb <> q then 'qbyte' when kind <> 3 and q <> 0 then 'qbyte' end], lambda x: x is not null)), ',') as failed from g)
select op, case when failed <> '' then 'mismatch' when unsure then 'not_judged' else 'ok' end as verdict, failed, count(*) as n from f group by all"""


@query("flag_verdicts", _FLAG_SQL)
def flag_verdicts(spark, d):
    """Comparisons, tests, divisions and remainders, some by zero, with expected codes, exceptions and quotient bytes."""
    rows = T.table(spark, d, "lineitem").select((F.col("l_partkey") % 4).alias("kind"), F.col("l_quantity").cast("double").alias("a"), (F.col("l_suppkey") % 3 - 1).cast("double").alias("b"),
                                                (F.col("l_linenumber") % 2 == 0).alias("said"), (F.col("l_orderkey") % 128).alias("q"))
    result = F.when(F.col("kind") == 2, ieee.fdiv(F.col("a"), F.col("b"))).otherwise(ieee.fmod(F.col("a"), F.col("b")))
    hexed = rows.select("kind", "said", "q", fbits.double_digits(F.col("a")).alias("x"), fbits.double_digits(F.col("b")).alias("y"), fbits.extended_digits(result).alias("r"))
    line = F.expr("""concat(element_at(array('fcmp', 'ftst', 'fdiv', 'fmod'), cast(kind + 1 as int)), '.d ', if(kind = 1, y, concat('[d]', x, ' ', y)), ' = ', if(kind < 2, '', concat(r, ' ')),
      if(said, '', '~'), if(kind < 2, 'n', 'dz'), ' ~operr ~snan q:', lower(lpad(hex(q), 2, '0')))""")
    path = scratch_path(spark, "flags")
    hexed.select(line.alias("value")).write.text(path)
    parsed, _ = V.parse_vectors(V.read_vectors(spark, path))
    bound, _ = C.bind_ops(parsed, C.catalogue(spark))
    return E.run_vectors(bound).groupBy("op", "verdict", F.array_join(F.array_sort("failed"), ",").alias("failed")).agg(F.count(F.lit(1)).alias("n"))


def _deliver_again(spark, source, target):
    """Every second file of `source` under its own name in `target`."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    store = hadoop.Path(source).getFileSystem(conf)
    store.mkdirs(hadoop.Path(target))
    names = sorted(f.getPath().getName() for f in store.listStatus(hadoop.Path(source)))
    for name in [n for n in names if n.startswith("part-")][::2]:
        hadoop.FileUtil.copy(store, hadoop.Path(f"{source}/{name}"), store, hadoop.Path(f"{target}/{name}"), False, conf)


@query("live_conformance", _CHECKED_SQL)
def live_conformance(spark, d):
    """Half of the files come again, in a later batch; every line counts once."""
    base = scratch_path(spark, "vector-files")
    judged, out, check = (scratch_path(spark, f"verdicts-{n}") for n in ("judged", "out", "checkpoint"))
    for i in range(2):
        _checked_text(spark, d, f"{base}/first") if i == 0 else _deliver_again(spark, f"{base}/first", f"{base}/again")
        L.stream_conformance(L.text_stream(spark, f"{base}/*"), judged, out, check)
    return spark.read.parquet(out).groupBy("op", "verdict").agg(F.count(F.lit(1)).alias("n"))
