"""Streams over several batches end where one batch would."""

import os
import random

from pyspark.sql import functions as F

from strataflux.operators import runs as R
from strataflux.streaming import live as L
from strataflux.streaming import state as S


def twice(spark, folder, files, schema, job):
    """What `job` writes when the query stops after the first file and starts again for the rest, one file a batch."""
    for part in (files[:1], files[1:]):
        for df in part:
            df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        done = job(L.file_stream(spark, f"{folder}/in", schema, files_per_batch=1))
        L.append_to(done, f"{folder}/out", f"{folder}/check").awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{folder}/out")


def test_levels_over_batches_and_a_restart(spark, folder):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.8 else 1, i, rng.randint(-9, 9)) for i in range(300)] + [(7, 250, 5), (None, 10, 2), (None, 200, 3)]
    df = spark.createDataFrame(rows, "part bigint, pos bigint, d bigint")
    files = [df.where(f"pos div 100 = {i}").orderBy(F.rand(1)) for i in range(3)]
    got = twice(spark, folder, files, df.schema, lambda s: S.running_levels(s, ["part"], "pos", "d"))
    want = R.delta_decode(df, ["part"], ["pos"], "d").select("part", "pos", "level")
    assert got.count() == 303
    assert got.select("part", "pos", "level").exceptAll(want).count() == 0


def test_first_stream_over_batches_and_a_restart(spark, folder):
    rows = [(0, "packet", 225, 1, 5), (0, "packet", 224, 2, 5), (0, "header", 224, 3, 0),
            (0, "packet", 224, 10, 5), (0, "packet", 225, 11, 5), (0, "packet", 192, 12, 5), (1, "header", 224, 13, 0),
            (1, "packet", 224, 20, 5), (0, "packet", 192, 21, 5), (0, "packet", 250, 22, 5)]
    df = spark.createDataFrame(rows, "stream bigint, kind string, stream_id bigint, seq bigint, payload_bytes bigint")
    files = [df.where(f"seq div 10 = {i}").orderBy(F.desc("seq")) for i in range(3)]
    out = twice(spark, folder, files, df.schema, S.first_streams)
    got = {r.seq: (r.declared, r.adopted, r.chosen) for r in out.collect()}
    no = (False, False, False)
    assert got == {1: (False, False, True), 2: no, 10: (True, False, False), 11: (False, True, True), 12: no,
                   20: (True, False, True), 21: (False, True, False), 22: no}


def test_late_rows_are_told_apart(spark, folder):
    second = 1_000_000
    batches = [[(0, 0), (1, 100)], [(2, 200), (3, 10), (4, 150)], [(5, 149), (6, 151), (7, 300)]]
    schema = "stream bigint, seq bigint, at_us bigint"
    files = [spark.createDataFrame([(0, s, t * second) for s, t in rows], schema) for rows in batches]
    out = twice(spark, folder, files, files[0].schema, lambda s: S.late_flags(s, "50 seconds"))
    got = {r.seq: (r.late, r.late_so_far) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {0: False, 1: False, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False}
    assert got[3][1] == 1 and got[7][1] == 2


def test_closing_row_lets_all_windows_out(spark, folder):
    df = spark.createDataFrame([(0, s, 2) for s in (0, 30, 61, 500)], "stream bigint, s bigint, payload_bytes bigint").select("stream", F.timestamp_seconds("s").alias("at"), "payload_bytes")
    df.write.parquet(f"{folder}/in")
    L.closing_row(df, "at").write.mode("append").parquet(f"{folder}/in")
    stream = L.file_stream(spark, f"{folder}/in", df.schema)
    L.append_to(L.packet_windows(stream, "1 minute", "1 minute"), f"{folder}/w", f"{folder}/w-check").awaitTermination()
    assert {(r.stream, r.from_s, r.n) for r in spark.read.parquet(f"{folder}/w").collect()} == {(0, 0, 2), (0, 60, 1), (0, 480, 1)}


def test_windows_drop_late_rows(spark, folder):
    # the engine compares a batch with the watermark of the batch before it
    for secs in ([0, 30, 61], [4000], [4001], [5, 4100]):
        spark.createDataFrame([(0, s, 2) for s in secs], "stream bigint, s bigint, payload_bytes bigint").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    stream = L.file_stream(spark, f"{folder}/in", schema, files_per_batch=1).withColumn("at", F.timestamp_seconds("s"))
    L.append_to(L.packet_windows(stream, "1 minute", "1 minute"), f"{folder}/w", f"{folder}/w-check").awaitTermination()
    got = {(r.from_s, r.n) for r in spark.read.parquet(f"{folder}/w").collect()}
    assert (0, 2) in got and (60, 1) in got


def test_conformance_files(spark, folder):
    import os
    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/a.vec", "w") as f:
        f.write("fabs.x bfff00008000000000000000 = 3fff00008000000000000000\nfabs.x bfff00008000000000000000 = 3fff00008000000000000001\n")
    with open(f"{folder}/in/b.vec", "w") as f:
        f.write("# nothing\nfneg.d 3ff0000000000000 = bfff00008000000000000000 n\nquit\nfneg.d 0 = 0\n")
    def come():
        L.stream_conformance(L.text_stream(spark, f"{folder}/in*", 1), f"{folder}/judged", f"{folder}/out", f"{folder}/check")
        return {(r.suite[-5:], r.line_no): r.verdict for r in spark.read.parquet(f"{folder}/out").collect()}

    want = {("a.vec", 1): "ok", ("a.vec", 2): "not_representable", ("b.vec", 2): "ok"}
    assert come() == want
    # the same file once more, elsewhere and later, and a new one
    os.makedirs(f"{folder}/in2")
    with open(f"{folder}/in/a.vec") as f, open(f"{folder}/in2/a.vec", "w") as g:
        g.write(f.read())
    with open(f"{folder}/in2/c.vec", "w") as f:
        f.write("fneg.d 3ff0000000000000 = bfff00008000000000000000 n\n")
    assert come() == {**want, ("c.vec", 1): "ok"}
    assert spark.read.parquet(f"{folder}/out").count() == 4


def test_small_parts_share_a_call(spark, folder):
    rows = [(i % 900, i, i % 7, "x" if i % 5 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "part bigint, pos bigint, d bigint, sub string")
    got = twice(spark, folder, [df.where(f"pos div 2000 = {i}") for i in range(2)], df.schema, lambda s: S.running_levels(s, ["part", "sub"], "pos", "d"))
    want = R.delta_decode(df.withColumn("key", F.concat_ws("-", "part", F.coalesce("sub", F.lit("none")))), ["key"], ["pos"], "d").select("part", "sub", "pos", "level")
    assert got.count() == 4000 and got.select("part", "sub", "pos", "level").exceptAll(want).count() == 0
    plan = S.running_levels(L.file_stream(spark, f"{folder}/in", df.schema), ["part"], "pos", "d")._jdf.queryExecution().analyzed().toString()
    assert "_bucket" in plan


def test_deliveries_are_one_file_each_and_arrive_in_order(spark, folder):
    from strataflux.plans import live_queries as Q

    events = spark.createDataFrame([(i, i % 20) for i in range(100)] + [(None, 1)], "event_id bigint, user_id bigint")
    events.write.parquet(f"{folder}/events.parquet")
    n = Q._deliveries(spark, folder, Q._HELD, f"{folder}/made")
    assert n == 4
    Q._arrive(spark, f"{folder}/made", range(2), f"{folder}/in", 1_700_000_000_000)
    Q._arrive(spark, f"{folder}/made", range(2, 5), f"{folder}/in", 1_700_000_000_000)
    files = sorted((p for p in os.listdir(f"{folder}/in") if p.endswith(".parquet")), key=lambda p: os.stat(f"{folder}/in/{p}").st_mtime)
    seen = [sorted(r.event_id for r in spark.read.parquet(f"{folder}/in/{p}").select("event_id").collect()) for p in files]
    assert seen == [sorted(i for i in range(100) if i // 25 + (i % 20 % 10 == 7) == k) for k in range(5)]
    assert spark.read.parquet(f"{folder}/in").columns == ["event_id", "user_id"]


def test_lines_seen_are_kept_on_disk(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    spark.createDataFrame([], L.VERDICT).write.parquet(f"{folder}/batch=0")
    L.once_only(spark, folder)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == S.STORE


def test_small_batches_have_few_state_partitions(spark, folder):
    df = spark.createDataFrame([(i % 9, i, 1) for i in range(100)], "part bigint, pos bigint, d bigint")
    df.write.parquet(f"{folder}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        done = S.running_levels(L.file_stream(spark, f"{folder}/in", df.schema), ["part"], "pos", "d")
        query = L.append_to(done, f"{folder}/out", f"{folder}/check", small_batches=True)
        query.awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert query.lastProgress.stateOperators[0].numShufflePartitions == spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{folder}/out").count() == 100
