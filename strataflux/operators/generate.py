"""Random conformance cases whose content depends only on the seed and the row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sizes to draw from (s, d and x twice), rounding modes, precisions, exception names.
SIZES = "bwlssddxxp"
ROUNDINGS = ("rn", "rz", "rm", "rp")
PRECISIONS = ("x", "d", "s")
ENABLES = ("bsun", "snan", "operr", "ovfl", "unfl", "dz", "inex2", "inex1")
# Operations to draw from, by operand count.
MONADIC = ("fabs fsabs fdabs facos fasin fatan fatanh fcos fcosh fetox fetoxm1 fgetexp fgetman fint fintrz flog10 "
           "flog2 flogn flognp1 fmove fsmove fdmove fneg fsneg fdneg fsin fsinh fsqrt fssqrt fdsqrt ftan ftanh "
           "ftentox ftwotox fsincos ftst").split()
DYADIC = ("fadd fsadd fdadd fcmp fdiv fsdiv fddiv fmod fmul fsmul fdmul frem fscale fsub fssub fdsub fsglmul fsgldiv").split()


def word(row_id: Column, seed: int, salt: str) -> Column:
    """Eight hex digits drawn for a row; md5 is the same on every engine and partitioning."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string"), F.lit(salt))), 1, 8)


def draw(row_id: Column, seed: int, salt: str, n: int) -> Column:
    """Whole number in 0 .. n-1."""
    return F.conv(word(row_id, seed, salt), 16, 10).cast("bigint") % n


def _digits(value: Column, n: int) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def _operand(row_id: Column, seed: int, salt: str, size: Column, legal: bool) -> Column:
    w = [word(row_id, seed, f"{salt}{i}") for i in range(3)]
    wide = F.concat_ws("_", *w)
    if legal:
        ext = F.concat_ws("_", F.concat(F.substring(w[0], 1, 4), F.lit("0000")), w[1], w[2])
        sign = F.when(draw(row_id, seed, salt + "s", 2) == 0, "f").otherwise("7")
        top = F.element_at(F.array(*[F.lit(c) for c in "048c"]), (draw(row_id, seed, salt + "q", 4) + 1).cast("int"))
        exp3 = _digits(draw(row_id, seed, salt + "e", 1000), 3)
        number = F.concat(
            top, exp3, F.lpad(draw(row_id, seed, salt + "d", 10).cast("string"), 4, "0"), F.lit("_"),
            _digits(draw(row_id, seed, salt + "m", 100_000_000), 8), F.lit("_"), _digits(draw(row_id, seed, salt + "n", 100_000_000), 8))
        kind = draw(row_id, seed, salt + "k", 10)
        packed = (
            F.when(kind == 0, F.concat(sign, F.lit("fff0000_00000000_00000000")))
            .when(kind == 1, F.concat(sign, F.lit("fff0000_"), w[1], F.lit("_"), w[2]))
            .when(kind == 2, F.concat(top, exp3, F.lit("0000_00000000_00000000")))
            .otherwise(number)
        )
    else:
        ext = packed = wide
    return (
        F.when(size == "b", F.substring(w[0], 1, 2)).when(size == "w", F.substring(w[0], 1, 4))
        .when(size.isin("l", "s"), w[0]).when(size == "d", F.concat_ws("_", w[0], w[1]))
        .when(size == "x", ext).otherwise(packed)
    )


def cases_for(df: DataFrame, row_id: str, seed: int, legal_only: bool = False) -> DataFrame:
    """One case per row of `df`: operation, size, operands, rounding, precision, enabled exceptions, text line."""
    rid = F.col(row_id)

    def pick(values, salt):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(rid, seed, salt, len(values)) + 1).cast("int"))

    base = df.select(
        rid.alias(row_id), pick(MONADIC + DYADIC, "op").alias("op"), pick(SIZES, "size").alias("size"),
        pick(ROUNDINGS, "rmode").alias("rmode"), pick(PRECISIONS, "prec").alias("prec"),
        F.when(draw(rid, seed, "any", 2) == 1, F.concat_ws(
            " ", *[F.when(draw(rid, seed, e, 2) == 1, e) for e in ENABLES])).otherwise("").alias("enables"))
    size, two = F.col("size"), F.col("op").isin(*DYADIC)
    ops = base.withColumn("in1", F.when(two, _operand(rid, seed, "a", F.lit("x"), legal_only)).otherwise(
        _operand(rid, seed, "a", size, legal_only))).withColumn("in2", F.when(two, _operand(rid, seed, "b", size, legal_only)))
    line = F.concat_ws(" ", F.concat_ws(".", "op", "size"), "in1", "in2", "rmode", "prec", F.nullif("enables", F.lit("")))
    return ops.withColumn("line", line)


def random_cases(spark: SparkSession, n: int, seed: int, legal_only: bool = False) -> DataFrame:
    """n cases numbered from 0."""
    return cases_for(spark.range(n), "id", seed, legal_only)
