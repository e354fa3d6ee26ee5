"""Registered queries over runs, deltas and change bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflux.operators import runs as R
from strataflux.operators import segments as G
from strataflux.plans import fixtures_sql as X
from strataflux.plans.registry import query
from strataflux.session import scratch_path
from strataflux.sources import tables as T

DELTA_ORDER = ["ord1", "ord2", "ord3", "delta"]


def _deltas(spark, d):
    return T.deltas(T.table(spark, d, "lineitem"))


def _bytes(spark, d):
    return T.step_bytes(T.table(spark, d, "events"))


@query("delta_decode", X.with_(X.DELTAS) + """, grouped as (
  select *, sum(case when reset then 1 else 0 end) over w as g from deltas
  window w as (partition by part order by ord1, ord2, ord3, delta rows unbounded preceding))
select part, ord1, ord2, ord3, delta,
       cast(sum(delta) over (partition by part, g order by ord1, ord2, ord3, delta rows unbounded preceding) as bigint) as level
from grouped""")
def delta_decode(spark, d):
    return R.delta_decode(_deltas(spark, d), ["part"], DELTA_ORDER, "delta", F.col("reset")).drop("reset")


@query("delta_encode", X.with_(X.DELTAS) + """
select part, ord1, ord2, ord3, delta,
       delta - coalesce(lag(delta) over (partition by part order by ord1, ord2, ord3, delta), 0) as step
from deltas""")
def delta_encode(spark, d):
    return R.delta_encode(_deltas(spark, d), ["part"], DELTA_ORDER, "delta", out="step").drop("reset")


@query("wrapped_sum", X.with_(X.DELTAS) + """
select part, ord1, ord2, ord3, delta, cast(((s + 32) % 64 + 64) % 64 - 32 as bigint) as vec
from (select *, sum(delta) over (partition by part order by ord1, ord2, ord3, delta rows unbounded preceding) as s from deltas)""")
def wrapped_sum(spark, d):
    return R.wrapped_sum(_deltas(spark, d), ["part"], DELTA_ORDER, "delta", lim=32).drop("reset")


@query("motion_vectors", """
with steps as (
  select l_suppkey as part, l_orderkey as ord1, l_partkey as ord2, cast(l_linenumber as bigint) as ord3,
         cast(l_quantity as bigint) % 33 - 16 as code, l_partkey % 4 as residual
  from lineitem), moved as (
  select *, case when code = 0 then 0 when code > 0 then (code - 1) * 4 + residual + 1
                 else -((-code - 1) * 4 + residual + 1) end as step from steps), summed as (
  select *, sum(step) over (partition by part order by ord1, ord2, ord3, step rows unbounded preceding) as s from moved)
select part, ord1, ord2, ord3, code, residual, cast(((s + 64) % 128 + 128) % 128 - 64 as bigint) as vec from summed""")
def motion_vectors(spark, d):
    steps = T.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("part"), F.col("l_orderkey").alias("ord1"), F.col("l_partkey").alias("ord2"),
        F.col("l_linenumber").cast("bigint").alias("ord3"),
        (F.col("l_quantity").cast("bigint") % 33 - 16).alias("code"), (F.col("l_partkey") % 4).alias("residual"),
    ).withColumn("step", R.motion_delta(F.col("code"), F.col("residual"), 2))
    return R.wrapped_sum(steps, ["part"], ["ord1", "ord2", "ord3", "step"], "step", lim=64).drop("step")


@query("runs", """
with flagged as (
  select user_id % 8 as part, event_id as pos, event_type = 'view' or event_type = 'click' as val from events), marked as (
  select *, case when lag(val) over w is distinct from val then 1 else 0 end as f from flagged
  window w as (partition by part order by pos)), numbered as (
  select *, sum(f) over (partition by part order by pos rows unbounded preceding) as g from marked)
select part, min(pos) as run_start, any_value(val) as val, count(*) as run_len from numbered group by part, g""")
def runs(spark, d):
    e = T.table(spark, d, "events").select(
        F.expr("user_id % 8").alias("part"), F.col("event_id").alias("pos"),
        F.col("event_type").isin("view", "click").alias("val"))
    return R.runs(e, ["part"], "pos", "val")


@query("runs_cut", """
with flagged as (
  select vec_id % 3 as part, vec_id // 3 as pos, label % 2 = 0 as val from embeddings), marked as (
  select *, case when lag(val) over w is distinct from val then 1 else 0 end as f from flagged
  window w as (partition by part order by pos)), numbered as (
  select *, sum(f) over (partition by part order by pos rows unbounded preceding) as g from marked), placed as (
  select *, pos - min(pos) over (partition by part, g) as off from numbered)
select part, min(pos) as run_start, any_value(val) as val, count(*) as run_len from placed group by part, g, off // 3""")
def runs_cut(spark, d):
    e = T.table(spark, d, "embeddings").select(
        F.expr("vec_id % 3").alias("part"), F.expr("vec_id div 3").alias("pos"), F.expr("label % 2 = 0").alias("val"))
    return R.runs(e, ["part"], "pos", "val", max_len=3)


@query("runs_expand", """
select vec_id % 3 as part, vec_id // 3 as pos, label % 2 = 0 as val from embeddings""")
def runs_expand(spark, d):
    return R.expand_runs(runs_cut(spark, d), ["part"], "val")


@query("pattern_runs", """
with vals as (select vec_id % 3 as part, vec_id // 3 as pos, label % 2 as val from embeddings), units as (
  select part, pos // 2 as unit,
         concat_ws(',', max(case when pos % 2 = 0 then val end), max(case when pos % 2 = 1 then val end)) as pattern
  from vals group by part, pos // 2), marked as (
  select *, case when lag(pattern) over w is distinct from pattern then 1 else 0 end as f from units
  window w as (partition by part order by unit)), numbered as (
  select *, sum(f) over (partition by part order by unit rows unbounded preceding) as g from marked)
select part, min(unit) as run_start, any_value(pattern) as pattern, count(*) as run_len from numbered group by part, g""")
def pattern_runs(spark, d):
    e = T.table(spark, d, "embeddings").select(
        F.expr("vec_id % 3").alias("part"), F.expr("vec_id div 3").alias("pos"), F.expr("label % 2").alias("val"))
    return R.pattern_runs(e, ["part"], "pos", "val", size=2)


@query("text_runs", """
with chars as (
  select doc_id, unnest(range(1, length(text) + 1)) as pos, unnest(string_split(text, '')) as c from documents), marked as (
  select *, case when lag(c) over w is distinct from c then 1 else 0 end as f from chars
  window w as (partition by doc_id order by pos)), numbered as (
  select *, sum(f) over (partition by doc_id order by pos rows unbounded preceding) as g from marked), pieces as (
  select doc_id, g, count(*) as n from numbered group by doc_id, g)
select doc_id, count(n) as n_runs, coalesce(max(n), 0) as longest, coalesce(cast(sum(n * n) as bigint), 0) as square_sum
from documents left join pieces using (doc_id) group by doc_id""")
def text_runs(spark, d):
    lens = F.transform(R.text_runs(F.coalesce("text", F.lit(""))), lambda p: F.length(p).cast("bigint"))
    return (
        T.table(spark, d, "documents")
        .select("doc_id", lens.alias("lens"))
        .select(
            "doc_id", F.size("lens").cast("bigint").alias("n_runs"), F.coalesce(F.array_max("lens"), F.lit(0).cast("bigint")).alias("longest"),
            F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, n: a + n * n).alias("square_sum"),
        )
    )


@query("repeated_lines", """
with lines as (
  select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as line
  from documents), marked as (
  select *, case when lag(line) over w is distinct from line then 1 else 0 end as f from lines
  window w as (partition by doc_id order by line_no)), numbered as (
  select *, sum(f) over (partition by doc_id order by line_no rows unbounded preceding) as g from marked), placed as (
  select *, line_no - min(line_no) over (partition by doc_id, g) as off from numbered)
select doc_id, min(line_no) as run_start, count(*) as run_len, any_value(line) as line
from placed group by doc_id, g, off // 256 having count(*) > 1""")
def repeated_lines(spark, d):
    lines = T.table(spark, d, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))
    return R.repeated_lines(lines, ["doc_id"], "line_no", "line")


PACKED = X.with_(X.STEP_BYTES) + """, placed as (
  select part, row_number() over w - 1 as pos, b,
         case when b <> coalesce(lag(b) over w, 0) then 1 else 0 end as flag
  from (select part, pos, b // 16 % 3 as b from step_bytes) window w as (partition by part order by pos))"""


def _packed(spark, d):
    coarse = _bytes(spark, d).withColumn("b", F.expr("b div 16 % 3"))
    return R.change_pack(coarse, ["part"], "pos", "b")


@query("change_pack_kept", PACKED + """
select part, row_number() over (partition by part order by pos) as ordinal, pos, b as val from placed where flag = 1""")
def change_pack_kept(spark, d):
    return _packed(spark, d)[0]


@query("change_pack_bitmap", PACKED + """
select part, pos // 8 as byte_no, cast(sum(flag * (1 << cast(7 - pos % 8 as int))) as bigint) as bits, count(*) as n_pos
from placed group by part, pos // 8""")
def change_pack_bitmap(spark, d):
    return _packed(spark, d)[1]


@query("change_pack_second_level", PACKED + """, bitmap as (
  select part, pos // 8 as byte_no, cast(sum(flag * (1 << cast(7 - pos % 8 as int))) as bigint) as bits
  from placed group by part, pos // 8), again as (
  select *, case when bits <> coalesce(lag(bits) over (partition by part order by byte_no), 0) then 1 else 0 end as flag
  from bitmap)
select part, row_number() over (partition by part order by byte_no) as ordinal, byte_no as pos, bits as val
from again where flag = 1""")
def change_pack_second_level(spark, d):
    return R.change_pack(_packed(spark, d)[1], ["part"], "byte_no", "bits")[0]


@query("change_unpack", PACKED + "select part, pos, b as val from placed")
def change_unpack(spark, d):
    # packed data is stored data: unpacking starts from what was written
    stored = []
    for name, df in zip(("kept", "bitmap"), _packed(spark, d)):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        stored.append(spark.read.parquet(path))
    return R.change_unpack(*stored, ["part"])


@query("fixup_offsets", X.with_(X.STEP_BYTES) + """, stepped as (
  select *, sum(case when b = 1 then 254 else b end) over w as moved, sum(case when b = 0 then 1 else 0 end) over w as ended
  from step_bytes window w as (partition by part order by pos rows unbounded preceding))
select part, pos, cast(28 + moved as bigint) as "offset" from stepped where ended = 0 and b > 1""")
def fixup_offsets(spark, d):
    return R.fixup_offsets(_bytes(spark, d), ["part"], "pos", "b", start=F.lit(28))


@query("segments", """
with b as (select vec_id % 3 as part, vec_id // 3 as pos, case when vec_id % 1000 < 400 then label % 2 else label // 4 end as val from embeddings)
select part, pos, val from b""")
def segments(spark, d):
    """Solid, pattern and literal pieces of each sequence, expanded again."""
    e = T.table(spark, d, "embeddings").select(
        F.expr("vec_id % 3").alias("part"), F.expr("vec_id div 3").alias("pos"), F.expr("case when vec_id % 1000 < 400 then label % 2 else label div 4 end").cast("bigint").alias("val"))
    return G.expand(G.segments(e, ["part"], "pos", "val", chunk=1 << 10), ["part"], "pos", "val")


@query("segment_sizes", """
with b as (select vec_id % 3 as part, vec_id // 3 as pos, case when vec_id % 1000 < 400 then label % 2 else label // 4 end as val from embeddings)
select part, count(*) as covered, true as gapless from b group by part""")
def segment_sizes(spark, d):
    """Pieces cover every value once: sizes add up to it and no piece begins elsewhere than the one before ends."""
    e = T.table(spark, d, "embeddings").select(
        F.expr("vec_id % 3").alias("part"), F.expr("vec_id div 3").alias("pos"), F.expr("case when vec_id % 1000 < 400 then label % 2 else label div 4 end").cast("bigint").alias("val"))
    found = G.segments(e, ["part"], "pos", "val", chunk=1 << 10)
    return found.groupBy("part").agg(F.sum("size").alias("covered"), (F.sum("size") == F.max(F.col("start") + F.col("size"))).alias("gapless"))
