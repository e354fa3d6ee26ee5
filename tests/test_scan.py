"""Chunked scans equal plain loops, whatever the chunk width, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from strataflux.operators import runs as R
from strataflux.operators.scan import FillBackward, FillForward, Following, Previous, RunningSum, chunk_width, scan


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    hot = [(0, p, rng.randint(-5, 5), rng.choice([None, None, p])) for p in range(300)]
    rest = [(k, p * 7, rng.randint(-5, 5), rng.choice([None, p])) for k in (1, 2) for p in range(20)]
    return hot + rest


def table(spark, rows):
    return spark.createDataFrame(rows, "part bigint, pos bigint, v bigint, w bigint").repartition(4)


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 16, None])
def test_all_columns(spark, rows, width):
    got = scan(
        table(spark, rows), ["part"], ["pos"],
        {"total": RunningSum(F.col("v")), "last": FillForward(F.col("w")), "before": FillForward(F.col("w"), strict=True),
         "next": FillBackward(F.col("w")), "prev": Previous(F.col("v"), -99), "foll": Following(F.col("v"))},
        width=width,
    ).collect()
    by = {(r.part, r.pos): r for r in got}
    assert len(by) == len(rows)
    for part in {r[0] for r in rows}:
        line = sorted(r for r in rows if r[0] == part)
        for i, (_, pos, v, w) in enumerate(line):
            r = by[part, pos]
            seen = [x[3] for x in line[: i + 1] if x[3] is not None]
            strict = [x[3] for x in line[:i] if x[3] is not None]
            ahead = [x[3] for x in line[i + 1:] if x[3] is not None]
            assert r.total == sum(x[2] for x in line[: i + 1])
            assert r.last == (seen[-1] if seen else None)
            assert r.before == (strict[-1] if strict else None)
            assert r.next == (ahead[0] if ahead else None)
            assert r.prev == (line[i - 1][2] if i else -99)
            assert r.foll == (line[i + 1][2] if i + 1 < len(line) else None)


def test_stage_reads_stage(spark, rows):
    got = R.running_sum_with_reset(table(spark, rows), ["part"], ["pos"], "v", F.col("w").isNotNull(), width=9)
    level = {}
    for part, pos, v, w in sorted(rows):
        level[part] = v if w is not None else level.get(part, 0) + v
        rows_at = level[part]
        assert got.where((F.col("part") == part) & (F.col("pos") == pos)).count() == 1 if pos == 0 else True
        level[(part, pos)] = rows_at
    assert {(r.part, r.pos): r.level for r in got.collect()} == {k: v for k, v in level.items() if isinstance(k, tuple)}


def test_encode_then_decode(spark, rows):
    df = table(spark, rows).select("part", "pos", "v")
    back = R.delta_decode(R.delta_encode(df, ["part"], ["pos"], "v", width=16), ["part"], ["pos"], "delta", width=16)
    assert back.where("level <> v").count() == 0 and back.count() == df.count()


@pytest.mark.parametrize("max_len", [None, 4])
def test_runs_expand_to_input(spark, max_len):
    rng = random.Random(2)
    data = [(p, i, v) for p in (0, 1) for i, v in enumerate(rng.choices("aab", k=150))]
    df = spark.createDataFrame(data, "part bigint, pos bigint, v string")
    found = R.runs(df, ["part"], "pos", "v", max_len=max_len, width=13)
    assert max_len is None or found.agg(F.max("run_len")).first()[0] <= max_len
    back = R.expand_runs(found, ["part"], "v")
    assert sorted(map(tuple, back.select("part", "pos", "v").collect())) == sorted(data)


def test_one_run_over_all_chunks(spark):
    df = spark.range(1000).select(F.lit(1).alias("part"), F.col("id").alias("pos"), F.lit(3).alias("v"))
    assert [tuple(r) for r in R.runs(df, ["part"], "pos", "v", width=10).collect()] == [(1, 0, 3, 1000)]


def test_null_is_a_value_of_its_own(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, 1, None])], "part int, pos bigint, v int")
    got = sorted((r.run_start, r.v, r.run_len) for r in R.runs(df, ["part"], "pos", "v", width=2).collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, None, 1)]


def test_pack_then_unpack(spark):
    rng = random.Random(8)
    data = [(p, i * 3, rng.choice([0, 0, 7])) for p in (0, 4) for i in range(101)]
    df = spark.createDataFrame(data, "part bigint, pos bigint, b bigint")
    kept, bitmap = R.change_pack(df, ["part"], "pos", "b", width=20)
    back = R.change_unpack(kept, bitmap, ["part"], width=20)
    want = [(p, i // 3, b) for p, i, b in data]
    assert sorted(map(tuple, back.select("part", "pos", "val").collect())) == sorted(want)


def test_wrapped_sum_equals_stepwise_wrap(spark):
    rng = random.Random(1)
    steps = [rng.randint(-16, 16) for _ in range(500)]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(steps)], "part int, pos bigint, d bigint")
    got = [r.vec for r in R.wrapped_sum(df, ["part"], ["pos"], "d", 16, width=32).orderBy("pos").collect()]
    vec, want = 0, []
    for s in steps:
        vec += s
        vec += 32 if vec < -16 else -32 if vec >= 16 else 0
        want.append(vec)
    assert got == want


def test_fixups_stop_at_zero(spark):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate([4, 1, 1, 10, 2, 0, 8])], "part int, pos bigint, b bigint")
    got = [r.offset for r in R.fixup_offsets(df, ["part"], "pos", "b", F.lit(100), width=3).orderBy("pos").collect()]
    assert got == [104, 104 + 254 + 254 + 10, 104 + 254 + 254 + 12]


def test_width_from_density(spark):
    df = spark.range(0, 1_000_000, 100).withColumnRenamed("id", "pos")
    assert 9_000 <= chunk_width(df, "pos", 100) <= 11_000


def test_no_global_scan(spark):
    with pytest.raises(ValueError):
        scan(spark.range(3), [], ["id"], {"s": RunningSum(F.col("id"))})


def test_rows_move_once(spark):
    """The large side is shuffled by part and chunk only; the carries join on the same keys."""
    df = spark.range(100_000).select((F.col("id") % 3).alias("part"), F.col("id").alias("pos"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scan(df, ["part"], ["pos"], {"t": RunningSum(F.col("v"))}, width=100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moves) == 4, plan  # rows, chunk sums, chunk order, carries
