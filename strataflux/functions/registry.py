"""Named, typed column functions: the extension surface for users.

A name maps to one or more parameter lists; a call picks the first list of the
right length. `register_sql` makes the same names callable from SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from strataflux.functions import ieee, text


@dataclass
class Entry:
    """Alternatives of one name: parameter types and the function that builds the column."""

    returns: str
    alternatives: list[tuple[tuple[str, ...], Callable[..., Column]]] = field(default_factory=list)


TABLE: dict[str, Entry] = {}


def define(name: str, params: tuple[str, ...], returns: str, fn: Callable[..., Column]) -> None:
    """Add an alternative; arguments are cast to the parameter types."""
    TABLE.setdefault(name, Entry(returns)).alternatives.append((params, fn))


def call(name: str, *args: Column) -> Column:
    entry = TABLE.get(name)
    if entry is None:
        raise KeyError(f"no function {name}")
    for params, fn in entry.alternatives:
        if len(params) == len(args):
            return fn(*[a.cast(p) for a, p in zip(args, params)]).cast(entry.returns)
    raise TypeError(f"{name} takes {[len(p) for p, _ in entry.alternatives]} arguments, got {len(args)}")


def register_sql(spark: SparkSession, name: str, fn: Callable[..., pd.Series], returns: str) -> None:
    """Make a vectorised function callable from SQL text; batches travel as Arrow."""
    spark.udf.register(name, F.pandas_udf(fn, returns))


_D = "double"
for _n, _f in {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "ln": ieee.flogn, "log": ieee.flog10, "sqr": F.sqrt,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "abs": F.abs,
    "int": lambda x: ieee.fint(x, "rm"), "sgn": F.signum, "deg": F.degrees, "rad": F.radians,
}.items():
    define(_n, (_D,), _D, _f)
for _n, _f in {"add": ieee.fadd, "sub": ieee.fsub, "mul": ieee.fmul, "div": ieee.fdiv, "power": F.pow}.items():
    define(_n, (_D, _D), _D, _f)
for _n, _f in {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
}.items():
    define(_n, (_D, _D), "boolean", _f)
define("pi", (), _D, F.pi)
define("float_text", (_D,), "string", text.number_text)
define("text_float", ("string",), _D, text.text_number)
define("float_int", (_D,), "bigint", lambda x: F.floor(x))
define("int_float", ("bigint",), _D, lambda x: x)
