"""Numeric conformance: catalogue binding, reconciliation, flag checks, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataflux.functions import conditions, fbits

# Operation, operand count, allowed sizes, exact-match flag.
# Rows with a rounded form also exist with the prefixes fs and fd.
CATALOGUE = """
fabs 1 bwlsdxp y rounded
facos 1 bwlsdxp n
fasin 1 bwlsdxp n
fatan 1 bwlsdxp n
fatanh 1 bwlsdxp n
fcos 1 bwlsdxp n
fcosh 1 bwlsdxp n
fetox 1 bwlsdxp n
fetoxm1 1 bwlsdxp n
fgetexp 1 bwlsdxp n
fgetman 1 bwlsdxp n
fint 1 bwlsdxp n
fintrz 1 bwlsdxp n
flog10 1 bwlsdxp n
flog2 1 bwlsdxp n
flogn 1 bwlsdxp n
flognp1 1 bwlsdxp n
fmove 1 bwlsdxp y rounded
fneg 1 bwlsdxp y rounded
fsin 1 bwlsdxp n
fsinh 1 bwlsdxp n
fsqrt 1 bwlsdxp y rounded
ftan 1 bwlsdxp n
ftanh 1 bwlsdxp n
ftentox 1 bwlsdxp n
ftwotox 1 bwlsdxp n
fsincos 1 bwlsdxp n
ftst 1 bwlsdxp n
fadd 2 bwlsdxp y rounded
fcmp 2 bwlsdxp n
fdiv 2 bwlsdxp y rounded
fmod 2 bwlsdxp y
fmul 2 bwlsdxp y rounded
frem 2 bwlsdxp y
fscale 2 bwlsdxp n
fsub 2 bwlsdxp y rounded
fsglmul 2 bwlsdxp y
fsgldiv 2 bwlsdxp y
"""


def catalogue(spark: SparkSession) -> DataFrame:
    """`(op, arity, sizes, exact)`, one row per operation name; packed results are never exact."""
    rows = []
    for line in CATALOGUE.split("\n"):
        word = line.split()
        if not word:
            continue
        names = [word[0]]
        if word[-1] == "rounded":
            names += ["fs" + word[0][1:], "fd" + word[0][1:]]
        rows += [(n, int(word[1]), word[2], word[3] == "y") for n in names]
    rows += [("fb" + p, 0, "wl", False) for p in conditions.PREDICATES]
    return spark.createDataFrame(rows, "op string, arity int, sizes string, exact boolean")


def bind_ops(vectors: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach the catalogue row of each vector; names or sizes it lacks are rejects.

    The catalogue is a fixed list of about a hundred rows, so it is broadcast.
    """
    small = F.broadcast(ops)
    match = (vectors["op"] == small["op"]) & F.expr("instr(sizes, size) > 0")
    bound = vectors.join(small, match, "inner").drop(small["op"])
    rejects = vectors.join(small, match, "left_anti")
    return bound, rejects


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str], value: str, tol: float | Column) -> DataFrame:
    """Full outer pairing with a verdict: ok, mismatch, missing_actual or missing_expected.

    Both sides must be unique on the keys; a one-to-many actual side is
    aggregated first, where partial aggregation takes the skew out.
    """
    tol = F.lit(tol) if isinstance(tol, (int, float)) else tol
    e = expected.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("_e"))
    a = actual.select(*keys, F.col(value).alias("actual"), F.lit(True).alias("_a"))
    both = e.join(a, keys, "full_outer")
    diff = F.abs(F.col("expected") - F.col("actual"))
    verdict = (
        F.when(F.col("_a").isNull(), "missing_actual").when(F.col("_e").isNull(), "missing_expected")
        .when(diff <= tol, "ok").otherwise("mismatch")
    )
    return both.select(*keys, "expected", "actual", diff.alias("diff"), verdict.alias("verdict"))


def check_results(bound: DataFrame, actual: str = "act1", expected: str = "exp1") -> DataFrame:
    """Last-place distance, tolerance and verdict of result constants in hex."""
    ulps = fbits.ulp_diff(F.col(expected), F.col(actual), F.col("size"), F.col("prec"))
    tol = fbits.tolerance(F.col("size"), F.col("prec"), F.col("exact") & (F.col("size") != "p"))
    return bound.withColumn("ulps", ulps).withColumn("tol", tol).withColumn(
        "verdict", F.when(F.col("ulps") <= F.col("tol"), "ok").otherwise("mismatch")
    )


def flag_failures(df: DataFrame, keys: list[str], expected: str = "exp_flags", got: str = "got_flags") -> DataFrame:
    """One row per failed flag; a flag absent from the expectation is not checked.

    A flag that should be set is reported by name, one that should be clear
    with a leading `~`. Flags missing from `got` count as clear.
    """
    failed = F.filter(
        F.map_entries(F.col(expected)),
        lambda e: e["value"] != F.coalesce(F.element_at(F.col(got), e["key"]), F.lit(False)),
    )
    return df.select(
        *keys,
        F.explode(F.transform(failed, lambda e: F.when(e["value"], e["key"]).otherwise(F.concat(F.lit("~"), e["key"])))).alias("failed"),
    )


def count_ok(expected: Column, got: Column) -> Column:
    """Counter check; a null or negative expectation never fails."""
    return F.coalesce(F.when(expected >= 0, expected == got), F.lit(True))


def verdict_rollup(verdicts: DataFrame, dims: list[str], diff: str = "diff") -> DataFrame:
    return _summary(verdicts.rollup(*dims), dims, diff)


def verdict_cube(verdicts: DataFrame, dims: list[str], diff: str = "diff") -> DataFrame:
    return _summary(verdicts.cube(*dims), dims, diff)


def _summary(grouped, dims, diff):
    return grouped.agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict") == "ok").alias("n_ok"),
        F.count_if(F.col("verdict") == "mismatch").alias("n_mismatch"),
        F.count_if(F.col("verdict").startswith("missing")).alias("n_missing"),
        F.max(diff).alias("worst"),
    )


def operand_cardinality(df: DataFrame, suite: str, operands: list[str], approximate: bool = False) -> DataFrame:
    """Distinct operand values per suite."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(suite).agg(*[count(c).alias(f"n_{c}") for c in operands])


def operand_sketches(df: DataFrame, by: list[str], operands: list[str], precision: int = 14) -> DataFrame:
    """A sketch of the distinct values of each operand per group, about 2 ** precision bytes however many rows; nulls are not counted."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(precision)).alias(f"sketch_{c}") for c in operands])


def merged_cardinality(sketches: DataFrame, by: list[str], operands: list[str]) -> DataFrame:
    """Estimated distinct values for coarser groups, by union of their sketches: no value is read again."""
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")).alias(f"n_{c}") for c in operands])


def worst(verdicts: DataFrame, n: int, diff: str, ties: list[str]) -> DataFrame:
    """The n largest differences, ranked; the cut is a distributed top-n, the ranks see n rows."""
    top = verdicts.orderBy(F.desc(diff), *ties).limit(n)
    by = W.partitionBy(F.lit(1)).orderBy(F.desc(diff))
    return top.withColumn("rank", F.rank().over(by)).withColumn("dense", F.dense_rank().over(by)).withColumn(
        "quarter", F.ntile(4).over(W.partitionBy(F.lit(1)).orderBy(F.desc(diff), *ties))
    )


def corpus(*suites: DataFrame) -> DataFrame:
    """Union of suites by column name."""
    out = suites[0]
    for s in suites[1:]:
        out = out.unionByName(s)
    return out


def golden_diff(run: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of only one side, with multiplicity: `side` is run or stored."""
    return run.exceptAll(stored).withColumn("side", F.lit("run")).unionByName(
        stored.exceptAll(run).withColumn("side", F.lit("stored"))
    )


def unblessed(vectors: DataFrame, blessed: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors without an expectation that no baseline holds yet, each once."""
    return vectors.where(~F.col("has_expect")).join(blessed, keys, "left_anti").dropDuplicates(keys)


def dedupe(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)


def coverage(listed: DataFrame, present: DataFrame, key: str = "suite") -> DataFrame:
    """Listed against present suites: covered, absent (listed only) or unlisted (present only)."""
    a = listed.select(key).distinct().withColumn("_l", F.lit(True))
    b = present.select(key).distinct().withColumn("_p", F.lit(True))
    return a.join(b, key, "full_outer").select(
        key,
        F.when(F.col("_p").isNull(), "absent").when(F.col("_l").isNull(), "unlisted").otherwise("covered").alias("state"),
    )
