"""Comparison predicates and condition codes with NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflux.functions import ieee

# Which relations make a predicate true. L less, E equal,
# G greater, U unordered.
QUIET = {
    "f": "", "eq": "E", "ogt": "G", "oge": "GE", "olt": "L", "ole": "LE", "ogl": "GL", "or": "LEG",
    "un": "U", "ueq": "UE", "ugt": "UG", "uge": "UGE", "ult": "UL", "ule": "ULE", "ne": "LGU", "t": "LEGU",
}
# The signalling twin of each quiet predicate.
SIGNALLING = {
    "sf": "f", "seq": "eq", "gt": "ogt", "ge": "oge", "lt": "olt", "le": "ole", "gl": "ogl", "gle": "or",
    "ngle": "un", "ngl": "ueq", "nle": "ugt", "nlt": "uge", "nge": "ult", "ngt": "ule", "sne": "ne", "st": "t",
}
PREDICATES = tuple(QUIET) + tuple(SIGNALLING)


def fcond(name: str, a: Column, b: Column) -> Column:
    """Struct `(taken, bsun)` of a predicate over two numbers."""
    rel = QUIET[SIGNALLING.get(name, name)]
    unordered = F.isnan(a) | F.isnan(b)
    taken = (
        F.when(unordered, "U" in rel)
        .when(a < b, "L" in rel)
        .when(a > b, "G" in rel)
        .otherwise("E" in rel)
    )
    return F.struct(taken.alias("taken"), (unordered & F.lit(name in SIGNALLING)).alias("bsun"))


def branch(name: str, n: Column, z: Column, nan: Column) -> Column:
    """Struct `(taken, bsun)` of a predicate over condition codes, any combination of codes allowed."""
    quiet = SIGNALLING.get(name, name)
    rel = QUIET[quiet]
    if quiet == "t":
        taken = F.lit(True)
    elif quiet == "or":
        taken = ~nan
    elif quiet == "ne":
        taken = ~z
    else:
        ordered = ~z & ~nan
        taken = F.lit(False)
        for letter, code in (("E", z), ("U", nan), ("L", n & ordered), ("G", ~n & ordered)):
            if letter in rel:
                taken = taken | code
    return F.struct(taken.alias("taken"), (nan & F.lit(name in SIGNALLING)).alias("bsun"))


def taken(name: str, n: bool, z: bool, nan: bool) -> bool:
    """`branch` of one combination of condition codes."""
    quiet = SIGNALLING.get(name, name)
    if quiet in ("t", "or", "ne"):
        return {"t": True, "or": not nan, "ne": not z}[quiet]
    ordered = not z and not nan
    return any(code for letter, code in (("E", z), ("U", nan), ("L", n and ordered), ("G", not n and ordered)) if letter in QUIET[quiet])


def ftst(x: Column) -> Column:
    """Condition codes of a number: struct `(n, z, i, nan)`."""
    return F.struct(
        ieee.signbit(x).alias("n"),
        F.when(F.isnan(x), False).otherwise(x == 0).alias("z"),
        F.when(F.isnan(x), False).otherwise(ieee.isinf(x)).alias("i"),
        F.isnan(x).alias("nan"),
    )


def fcmp(x: Column, y: Column) -> Column:
    """Condition codes of `x - y` without forming it: struct `(n, z, nan)`."""
    unordered = F.isnan(x) | F.isnan(y)
    equal = ~unordered & (x == y)
    negative = ~unordered & ((x < y) | (equal & ieee.signbit(x)))
    return F.struct(negative.alias("n"), equal.alias("z"), unordered.alias("nan"))
