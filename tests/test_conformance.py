import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from strataflux.functions import conditions, fbits, ieee, registry
from strataflux.operators import conformance as C
from strataflux.operators import evaluate as E
from strataflux.operators import generate as G
from strataflux.sources import vectors as V

VECTORS = """\
# hand-written checks
verbose

fadd.x 3fff00008000000000000000 3fff00008000000000000000 = 40000000_8000000000000000(2) ~N ~Z ~I ~NAN Q:00
FABS.D bff8_0000_0000_0000(-1.5) rn x = 3fff0000c000000000000000 ~n
facos.d 0000_0000_0000_0000 = 3fff0000c90fdaa22168c235(1.5708)
~verbose
fsqrt.s 40800000 rz d dz unfl = 400000008000000000000000
fmul.d [d]4000000000000000 4008000000000000 = 40010000c000000000000001
fbge.w n z = T
fmove.p out 3fff00008000000000000000 k#:7
fsin.x 12345
nonsense here.x 5
quit
fadd.x 1 2
"""

FAILURES = """\
fmove.b out 40050000 = 7f(127) ~n
\t= 7f(127) ~N
\t*** Check failed: INEX2
\t*** Check failed: AINEX

fsin.x 1
\t= 5
\t*** Check failed: Result
\t\t00 (Expected)
"""


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("vec") / "small.vec"
    path.write_text(VECTORS)
    return V.read_vectors(spark, str(path)).cache()


def test_line_numbers_kinds_and_quit(lines):
    got = {r.line_no: (r.kind, r.verbose) for r in lines.collect()}
    assert got[1] == ("comment", False) and got[2] == ("directive", True) and got[3] == ("blank", True)
    assert got[4] == ("test", True) and got[8] == ("test", False)
    assert max(got) == 13 and len(got) == 13


def test_line_numbers_across_splits(spark, folder):
    with open(f"{folder}/long.txt", "w") as f:
        f.writelines(f"line {i}\n" for i in range(1, 5001))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = V.read_lines(spark, folder).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000 and all(r.raw == f"line {r.line_no}" for r in got)


def test_parse(lines):
    vectors, rejects = V.parse_vectors(lines)
    got = {r.line_no: r for r in vectors.collect()}
    assert got[4].op == "fadd" and got[4].size == "x" and got[4].exp_flags == {"n": False, "z": False, "i": False, "nan": False}
    assert got[4].qbyte == 0 and got[4].exp1.hex() == "400000008000000000000000"
    assert got[5].in1.hex() == "00000000bff8000000000000"
    assert (got[8].rmode, got[8].prec, got[8].enables) == ("rz", "d", ["dz", "unfl"])
    assert got[9].in1_from == "d" and got[10].exp_flags == {"taken": True} and got[10].codes == ["n", "z"]
    assert got[11].kfactor == 7 and not got[11].has_expect
    assert {(r.line_no, r.reason) for r in rejects.collect()} == {(13, "unknown item")}


def test_evaluate(spark, lines):
    vectors, _ = V.parse_vectors(lines)
    bound, _ = C.bind_ops(vectors, C.catalogue(spark))
    got = {r.line_no: r.verdict for r in E.run_vectors(bound).collect()}
    # line 8 rounds to zero and 9 expects a bit beyond 53; 10 is a branch; 11 and 12 are a move out and a line without expectation
    assert got == {4: "ok", 5: "ok", 6: "ok", 8: "not_representable", 9: "not_representable", 10: "ok", 11: "not_judged", 12: "not_judged"}


UNCHECKED = [
    ("", "ok"), ("~n", "ok"), ("n", "mismatch"), ("~n inex2", "not_judged"), ("~n q:11", "mismatch"), ("~n q:00", "ok"), ("~n dz", "mismatch"), ("~n ~snan ~operr ~aiop", "ok"), ("n inex2", "mismatch")
]


def test_unchecked_expectations_never_pass(spark, tmp_path):
    (tmp_path / "one.vec").write_text("".join(f"fabs.d bff8000000000000 = {expected} 3fff0000c000000000000000\n" for expected, _ in UNCHECKED))
    vectors, _ = V.parse_vectors(V.read_vectors(spark, str(tmp_path)))
    bound, _ = C.bind_ops(vectors, C.catalogue(spark))
    got = {r.line_no: r.verdict for r in E.run_vectors(bound).collect()}
    assert [got[i + 1] for i in range(len(UNCHECKED))] == [verdict for _, verdict in UNCHECKED]


JUDGED = [
    ("fbge.w n z = t", "ok", []),
    ("fbge.w n = t", "mismatch", ["taken"]),
    ("fbge.w nan = ~t bsun aiop ~tbsun ~sigfpe q:00", "ok", []),
    ("fbge.w nan bsun = ~nan t bsun tbsun sigfpe", "ok", []),
    ("fbuge.w nan bsun = nan t ~bsun ~tbsun", "ok", []),
    ("fbeq.w = ~t snan", "mismatch", ["snan"]),
    ("ftst.d c000000000000000 = n ~z", "ok", []),
    ("ftst.s 7f800001 = nan snan aiop", "ok", []),
    ("ftst.s 7fc00001 = nan ~snan", "ok", []),
    ("ftst.d 7ff0000000000000 = ~n i", "ok", []),
    ("fcmp.d [d]3ff0000000000000 4000000000000000 = n ~z ~nan", "ok", []),
    ("fcmp.d [d]4000000000000000 4000000000000000 = ~n ~z", "mismatch", ["~z"]),
    ("fsincos.d 0000000000000000 = 3fff00008000000000000000 000000000000000000000000 ~n z", "ok", []),
    ("fsincos.d 0000000000000000 = 3fff00008000000000000000 3fff00008000000000000000 z", "mismatch", ["result2"]),
    ("fdiv.d [d]3ff0000000000000 0000000000000000 = 7fff00000000000000000000 dz adz ~operr i", "ok", []),
    ("fmod.d [d]401c000000000000 4000000000000000 = 3fff00008000000000000000 q:03", "ok", []),
    ("fmod.d [d]401c000000000000 4000000000000000 = 3fff00008000000000000000 q:83", "mismatch", ["qbyte"]),
    ("fsqrt.d bff0000000000000 = 7fff0000ffffffffffffffff operr aiop", "not_representable", None),
    ("fadd.d rz [d]3ff0000000000000 3ff0000000000000 = 400000008000000000000000", "not_representable", None),
]


def test_judged_beyond_results(spark, tmp_path):
    (tmp_path / "one.vec").write_text("".join(line + "\n" for line, _, _ in JUDGED))
    vectors, rejects = V.parse_vectors(V.read_vectors(spark, str(tmp_path)))
    assert rejects.count() == 0
    got = {r.line_no: r for r in E.run_vectors(C.bind_ops(vectors, C.catalogue(spark))[0]).collect()}
    for i, (line, verdict, failed) in enumerate(JUDGED, 1):
        assert got[i].verdict == verdict and (failed is None or got[i].failed == failed), (line, got[i])


def test_signalling_numbers(spark):
    rows = [("7f800001", "s", True), ("7fc00000", "s", False), ("ff810000", "s", True), ("7f800000", "s", False), ("7ff0000000000001", "d", True), ("fff8000000000001", "d", False),
            ("7ff0000000000000", "d", False), ("7fff0000" + "8000000000000001", "x", True), ("7fff0000" + "c000000000000001", "x", False), ("7fff0000" + "8000000000000000", "x", False),
            ("ff", "b", False)]
    df = spark.createDataFrame(rows, "h string, size string, want boolean").withColumn("got", E.signals(F.lpad("h", 24, "0"), F.col("size")))
    assert df.where("got <> want").count() == 0


def test_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("suite"), (F.col("id") % 7).alias("op"), (F.col("id") % 5_000).alias("v"), F.lit(None).cast("long").alias("w"))
    merged = C.merged_cardinality(C.operand_sketches(df, ["suite", "op"], ["v", "w"]), ["suite"], ["v", "w"]).collect()
    assert len(merged) == 3 and all(abs(r.n_v - 5_000) < 250 and r.n_w == 0 for r in merged)


def test_failures_and_back(spark, folder):
    with open(f"{folder}/f.log", "w") as f:
        f.write(FAILURES)
    got = V.read_failures(spark, folder).orderBy("record")
    rows = got.collect()
    assert [r.failed for r in rows] == [["INEX2", "AINEX"], ["Result"]]
    assert rows[1].vector == "fsin.x 1" and rows[1].actual == "5"
    assert "\t*** Check failed: AINEX" in V.report_text(got).first().value


def test_manifest_and_coverage(spark):
    text = spark.createDataFrame([("File  Coverage",), ("Fa.nrm\taccuracy",), ("Fb.nrm missing!",), ("----",)], "raw string")
    rows = V.manifest_rows(text)
    assert {(r.suite, r.missing) for r in rows.collect()} == {("Fa.nrm", False), ("Fb.nrm", True)}
    present = spark.createDataFrame([("Fb.nrm",), ("Fc.vec",)], "suite string")
    assert {tuple(r) for r in C.coverage(rows, present).collect()} == {("Fa.nrm", "absent"), ("Fb.nrm", "covered"), ("Fc.vec", "unlisted")}


def test_ulp_distance(spark):
    rows = [
        ("40000000" + "8000000000000000", "3fff0000" + "fffffffffffffff0", "x", "x"),
        ("40000000" + "8000000000000800", "40000000" + "8000000000000000", "x", "d"),
        ("40000000" + "8000000000000000", "40020000" + "8000000000000000", "x", "x"),
        ("c0000000" + "8000000000000000", "40000000" + "8000000000000001", "x", "x"),
        ("0" * 22 + "ff", "0" * 22 + "01", "b", "x"), ("0" * 16 + "3f800002", "0" * 16 + "3f800000", "s", "x"),
    ]
    df = spark.createDataFrame(rows, "e string, a string, size string, prec string")
    got = [r[0] for r in df.select(fbits.ulp_diff(F.col("e"), F.col("a"), F.col("size"), F.col("prec"))).collect()]
    # one exponent apart: the smaller side is halved
    assert got == [2**63 - 0x7FFFFFFFFFFFFFF8 if 2**63 - 0x7FFFFFFFFFFFFFF8 < 2**31 else fbits.FAR, 1, fbits.FAR, 1, 254, 2]


def test_numbers_round_trip(spark):
    rng = random.Random(3)
    vals = [0.0, -0.0, 5e-324, -2.5e-310, 1.7976931348623157e308, math.inf, -math.inf, 0.1] + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").select("x", fbits.double_digits(F.col("x")).alias("d"), fbits.extended_digits(F.col("x")).alias("e"))
    for r in df.select("x", fbits.double_value(F.lpad("d", 24, "0")).alias("b"), fbits.extended_value(F.col("e")).alias("c"), ieee.fgetexp(F.col("x")).alias("g")).collect():
        assert math.copysign(1, r.b) == math.copysign(1, r.x) and r.b == r.x and r.c == r.x
        if r.x and math.isfinite(r.x):
            assert r.g == math.frexp(r.x)[1] - 1


def test_remainder_is_ieee(spark):
    rng = random.Random(4)
    pairs = [(rng.uniform(-1, 1) * 10.0 ** rng.randint(-5, 40), rng.uniform(-1, 1) * 10.0 ** rng.randint(-5, 5)) for _ in range(300)] + [(5.0, 2.0), (7.0, 2.0), (-5.0, 2.0), (1.0, math.inf)]
    df = spark.createDataFrame(pairs, "x double, y double")
    for r in df.select("x", "y", ieee.frem(F.col("x"), F.col("y")).alias("r"), ieee.fmod(F.col("x"), F.col("y")).alias("m"),
                       ieee.fquotient(F.col("x"), F.col("y")).alias("q")).collect():
        assert r.r == math.remainder(r.x, r.y) and r.m == math.fmod(r.x, r.y)
        if math.isfinite(r.y):
            q = int(abs(Fraction(r.x) / Fraction(r.y))) % 128
            assert r.q == q + (128 if (r.x < 0) != (r.y < 0) else 0)


def test_all_predicates_agree_with_codes(spark):
    pairs = [(1.0, 2.0), (2.0, 1.0), (1.0, 1.0), (math.nan, 1.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    for p in conditions.PREDICATES:
        a, b = F.col("a"), F.col("b")
        codes = conditions.fcmp(a, b)
        row = df.select(conditions.fcond(p, a, b).alias("x"), conditions.branch(p, codes["n"], codes["z"], codes["nan"]).alias("y")).collect()
        assert all(r.x == r.y for r in row), p


def test_registry(spark):
    registry.define("twice", ("double",), "double", lambda x: x * 2)
    assert spark.range(1).select(registry.call("twice", F.lit(4))).first()[0] == 8.0
    registry.register_sql(spark, "plus_one", lambda s: s + 1, "bigint")
    assert spark.sql("select plus_one(id) from range(3)").agg(F.sum("plus_one(id)")).first()[0] == 6
    with pytest.raises(TypeError):
        registry.call("twice")


def test_cases_do_not_depend_on_partitions(spark):
    one = G.cases_for(spark.range(200).repartition(1), "id", 5).select("id", "line")
    many = G.cases_for(spark.range(200).repartition(7), "id", 5).select("id", "line")
    assert one.exceptAll(many).count() == 0
    parsed, rejects = V.parse_vectors(V.classify_lines(one.select(F.lit("s").alias("suite"), F.col("id").alias("line_no"), F.col("line").alias("raw"))))
    assert rejects.count() == 0 and parsed.count() == 200


def test_legal_packed_mix(spark):
    df = G.random_cases(spark, 4000, 1, legal_only=True).where("size = 'p' and in2 is null")
    n = df.count()
    special = df.where("in1 like '_fff%'").count()
    assert 0.1 < special / n < 0.3


def test_remainder_of_large_divisors(spark):
    from math import remainder

    pairs = [(1.9 * 2.0**1023, 1.1 * 2.0**1023), (1.2 * 2.0**1023, 1.1 * 2.0**1023), (2.0**1023, 2.0**1023), (3.0, 1.7 * 2.0**1023), (7.5, 3.0), (4.5, 3.0), (-1.5, 1.0)]
    got = spark.createDataFrame(pairs, "x double, y double").select(ieee.frem(F.col("x"), F.col("y")).alias("r"), "x", "y").collect()
    assert [r["r"] for r in got] == [remainder(r["x"], r["y"]) for r in got]


def test_no_local_scratch_on_a_cluster(spark):
    from strataflux.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return "spark://host:7077" if key == "spark.master" else default

    class Cluster:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_dir(Cluster())


def test_lines_are_numbered_without_a_window_over_them(spark, folder):
    for name in ("a", "b"):
        with open(f"{folder}/{name}.txt", "w") as f:
            f.writelines(f"{name} {i}\n" for i in range(1, 2001))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = V.read_lines(spark, folder)
        got = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 4000 and all(r.raw == f"{r.suite[-5]} {r.line_no}" for r in got)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1  # over one row a block


def test_wide_projections_are_split(spark, folder):
    from strataflux.operators.scan import hold

    plan = hold(spark.range(3), a=F.col("id") * 2, b=F.col("id") + 1)
    assert plan.columns == ["id", "a", "b"] and [tuple(r) for r in plan.orderBy("id").collect()] == [(0, 0, 1), (1, 2, 2), (2, 4, 3)]
    assert "inline(_held" in plan._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    lines = spark.createDataFrame([("s", 1, "fadd.x 0 1 = 1 ~n")], "suite string, line_no bigint, raw string")
    bound, _ = C.bind_ops(V.parse_vectors(V.classify_lines(lines))[0], C.catalogue(spark))
    assert E.run_vectors(bound).count() == 1 and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_held_values_are_computed_once(spark):
    from strataflux.operators.scan import hold

    twice = spark.range(5).withColumn("x", F.col("id") * 1.5)
    plan = hold(hold(twice, a=ieee.fgetexp(F.col("x"))), b=ieee.fgetman(F.col("a"))).where("b > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("number_parts(") == 2 and "size(" not in plan


def test_verdicts_take_two_python_passes(spark):
    lines = spark.createDataFrame([("s", 1, "fadd.x 0 1 = 1 ~n")], "suite string, line_no bigint, raw string")
    vectors = V.parse_vectors(V.classify_lines(lines))[0]
    assert vectors._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    bound = C.bind_ops(vectors.localCheckpoint(), C.catalogue(spark))[0]
    assert E.run_vectors(bound)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2


def test_taken_is_the_branch(spark):
    codes = spark.createDataFrame([(a, b, c) for a in (False, True) for b in (False, True) for c in (False, True)], "n boolean, z boolean, nan boolean")
    branches = {p: conditions.branch(p, F.col("n"), F.col("z"), F.col("nan"))["taken"] for p in conditions.PREDICATES}
    for r in codes.select("*", *[c.alias("_" + p) for p, c in branches.items()]).collect():
        assert {p: conditions.taken(p, r.n, r.z, r.nan) for p in branches} == {p: r["_" + p] for p in branches}


ODD_LINES = [
    ("fabs.d [d]bff8_0000_0000_0000(-1.5 rn rz rm = 3fff0000c000000000000000 n ~n n", ("fabs", "d", "rm", "d", "00000000bff8000000000000", {"n": True})),
    ("\tfabs.d 1 = 2", None), ("fabs.d\x0b1=2 = 3 ~z z(", None), ("fabs.d 1111111111111111111111111 = 2", None), ("fabs.d = = t q:7f", ("fabs", "d", "rn", None, None, {"taken": True})),
    ("fabs.d rn\u0085 1", ("fabs", "d", "rn", None, "0" * 23 + "1", {})), ("1 2", None), ("fabs 1", None)]


def test_odd_lines(spark):
    lines = spark.createDataFrame([("s", i, raw) for i, (raw, _) in enumerate(ODD_LINES)], "suite string, line_no bigint, raw string")
    vectors, rejects = V.parse_vectors(V.classify_lines(lines))
    got = {r.line_no: (r.op, r["size"], r.rmode, r.in1_from, r.in1 and r.in1.hex(), r.exp_flags) for r in vectors.collect()}
    assert got == {i: want for i, (_, want) in enumerate(ODD_LINES) if want}
    assert {r.line_no: r.reason for r in rejects.collect()} == {1: "unknown item", 2: "unknown item", 3: "unknown item", 6: "no test name", 7: "unknown test name"}


def test_random_verdicts_agree_with_double_arithmetic(spark, folder):
    """Sums with a result that is right, one unit off or far off, in 2,000 lines: more than one batch of a task."""
    import struct

    def wide(v):
        bits = struct.unpack(">Q", struct.pack(">d", v))[0]
        return f"{(bits >> 63) * 32768 + (bits >> 52 & 2047) + 15360:04x}0000{bits << 11 & (1 << 63) - 1 | 1 << 63:016x}"

    rng, rows = random.Random(8), []
    for i in range(2000):
        a, b = rng.randint(-99, 99) / 8, rng.randint(1, 99) / 8
        total = a + b or 1.0
        said = {0: total, 1: math.nextafter(total, math.inf), 2: total * 4}[i % 3]
        rows.append((f"fadd.d [d]{struct.pack('>d', a).hex()} {struct.pack('>d', b).hex()} = {wide(said)} {'' if total < 0 else '~'}n", "ok" if i % 3 == 0 and a + b else "mismatch"))
    with open(f"{folder}/a.vec", "w") as f:
        f.writelines(line + "\n" for line, _ in rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        bound = C.bind_ops(V.parse_vectors(V.read_vectors(spark, folder))[0], C.catalogue(spark))[0]
        got = {r.line_no: r for r in E.run_vectors(bound).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i + 1].verdict for i in range(2000)] == [v for _, v in rows]
