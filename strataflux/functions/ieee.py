"""IEEE 754 arithmetic as columns: the places where SQL raises or gives NULL are spelled out.

Spark's `ln(0)` is NULL, `1 / 0` raises, `NaN = NaN` is true and NaN sorts
above everything. Each function here returns what the number format asks for.
All work on DOUBLE; a `fs*` twin rounds the result through FLOAT, a `fd*` twin
is the function itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _nan() -> Column:
    return F.lit(float("nan"))


def _inf() -> Column:
    return F.lit(float("inf"))


def signbit(x: Column) -> Column:
    """True for negative numbers and for minus zero."""
    # the reciprocal by power keeps the sign of a zero; division by zero would raise
    return F.when(F.isnan(x), False).when(x == 0, F.pow(x, F.lit(-1.0)) < 0).otherwise(x < 0)


def isinf(x: Column) -> Column:
    return F.abs(x) == _inf()


def with_sign(size: Column, sign: Column) -> Column:
    return F.when(sign, -F.abs(size)).otherwise(F.abs(size))


def single(x: Column) -> Column:
    """Round to single precision and back."""
    return x.cast("float").cast("double")


# --- one operand ---------------------------------------------------------

def fabs(x): return F.abs(x)
def fneg(x): return -x
def fmove(x): return x
def fsqrt(x): return F.sqrt(x)
def fsin(x): return F.sin(x)
def fcos(x): return F.cos(x)
def ftan(x): return F.tan(x)
def fasin(x): return F.asin(x)
def facos(x): return F.acos(x)
def fatan(x): return F.atan(x)
def fatanh(x): return F.atanh(x)
def fsinh(x): return F.sinh(x)
def fcosh(x): return F.cosh(x)
def ftanh(x): return F.tanh(x)
def fetox(x): return F.exp(x)
def fetoxm1(x): return F.expm1(x)
def ftwotox(x): return F.pow(F.lit(2.0), x)
def ftentox(x): return F.pow(F.lit(10.0), x)
def fsincos(x): return F.struct(F.sin(x).alias("sin"), F.cos(x).alias("cos"))


def _log(fn, x: Column, pole: float) -> Column:
    return F.when(F.isnan(x) | (x < pole), _nan()).when(x == pole, -_inf()).otherwise(fn(x))


def flogn(x): return _log(F.ln, x, 0.0)
def flog2(x): return _log(F.log2, x, 0.0)
def flog10(x): return _log(F.log10, x, 0.0)
def flognp1(x): return _log(F.log1p, x, -1.0)


def fint(x: Column, mode: str = "rn") -> Column:
    """Round to an integral value: rn half to even, rz to zero, rm down, rp up."""
    down, up = F.floor(x).cast("double"), F.ceil(x).cast("double")
    pick = {
        "rn": F.rint(x),
        "rm": down,
        "rp": up,
        "rz": F.when(x < 0, up).otherwise(down),
    }[mode]
    integral = F.isnan(x) | (F.abs(x) >= float(1 << 52))
    return F.when(integral, x).otherwise(F.when(pick == 0, x * 0.0).otherwise(pick))


def fintrz(x): return fint(x, "rz")


_parts = StructType([StructField("man", DoubleType()), StructField("exp", DoubleType())])


@F.arrow_udf(_parts)
def number_parts(x: pa.Array) -> pa.Array:
    """Significand in [1, 2) and binary exponent; zeros pass through, infinities and NaN give NaN.

    SQL has no way to the exponent field, and a logarithm is off by one near
    powers of two, so this pair comes from an Arrow batch.
    """
    none = x.is_null().to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([pa.array(part, mask=none) for part in significand_exponent(x.to_numpy(zero_copy_only=False))], names=["man", "exp"])


def significand_exponent(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    man, exp = np.frexp(v)
    zero, gone = v == 0, ~np.isfinite(v)
    return np.where(gone, np.nan, np.where(zero, v, man * 2)), np.where(gone, np.nan, np.where(zero, v, exp - 1.0))


def fgetexp(x: Column) -> Column:
    return number_parts(x).getField("exp")


def fgetman(x: Column) -> Column:
    """Significand in [1, 2) with the sign of the operand."""
    return number_parts(x).getField("man")


# --- two operands --------------------------------------------------------

def fadd(x, y): return x + y
def fsub(x, y): return x - y
def fmul(x, y): return x * y


def fdiv(x: Column, y: Column) -> Column:
    sign = signbit(x) != signbit(y)
    return (
        F.when(F.isnan(x) | F.isnan(y) | ((x == 0) & (y == 0)), _nan())
        .when(y == 0, with_sign(_inf(), sign))
        .otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))
    )


def fsglmul(x, y): return single(single(x) * single(y))
def fsgldiv(x, y): return single(fdiv(single(x), single(y)))


def fscale(x: Column, n: Column) -> Column:
    """x * 2^trunc(n); the power is applied in halves so that it cannot overflow early."""
    steps = F.greatest(F.lit(-2200.0), F.least(F.lit(2200.0), fintrz(n)))
    half = fintrz(steps / 2)
    scaled = x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), steps - half)
    return F.when(F.isnan(x) | F.isnan(n) | isinf(n), _nan()).when((x == 0) | isinf(x), x).otherwise(scaled)


def _mod(x: Column, y: Column) -> Column:
    return x % F.when(y == 0, F.lit(1.0)).otherwise(y)


def _mod_domain(x: Column, y: Column, result: Column) -> Column:
    bad = F.isnan(x) | F.isnan(y) | isinf(x) | (y == 0)
    return F.when(bad, _nan()).when(isinf(y), x).otherwise(result)


def fmod(x: Column, y: Column) -> Column:
    """Remainder with the quotient cut toward zero."""
    return _mod_domain(x, y, _mod(x, y))


MAX_HALF = 2.0**1023 * (1 - 2.0**-53)  # the largest double whose double is finite


def frem(x: Column, y: Column) -> Column:
    """Remainder with the quotient rounded to nearest, ties to even.

    Reduced by 2|y| first, which keeps the parity of the quotient without
    forming it; the halfway cases at |y|/2 and 3|y|/2 go to the even side.
    """
    b = F.abs(y)
    two = F.when(b <= MAX_HALF, _mod(F.abs(x), b * 2)).otherwise(F.abs(x))  # beyond, 2|y| is more than any |x|
    over = two - b
    size = F.when(two <= b - two, two).when(over < b - over, over).otherwise(over - b)  # no doubled value, so no overflow
    return _mod_domain(x, y, F.when(signbit(x), -size).otherwise(size))


def fquotient(x: Column, y: Column, nearest: bool = False) -> Column:
    """Quotient byte of fmod / frem: low seven bits of the quotient, sign in the high bit."""
    a, b = F.abs(x), F.abs(y)
    cut = F.rint((_mod(a, b * 128) - _mod(a, b)) / F.when(b == 0, F.lit(1.0)).otherwise(b)).cast("bigint")
    if nearest:
        two = _mod(a, b * 2)
        down = (two * 2 <= b) | ((two >= b) & ((two - b) * 2 < b))
        cut = (cut + F.when(down, 0).otherwise(1)) % 128
    byte = cut + F.when(signbit(x) != signbit(y), 128).otherwise(0)
    bad = F.isnan(x) | F.isnan(y) | isinf(x) | isinf(y) | (y == 0)
    return F.when(bad, F.lit(None).cast("bigint")).otherwise(byte)


# --- packed decimal ------------------------------------------------------

PACKED_DIGITS = 17


def packed_text(x: Column, k: Column | int) -> Column:
    """Decimal text of a finite number under a K-factor.

    k > 0 asks for that many significant digits, k <= 0 for -k digits right of
    the decimal point; never more than 17 digits.
    """
    k = F.lit(k) if isinstance(k, int) else k
    lead = F.floor(F.log10(F.abs(F.when(x == 0, F.lit(1.0)).otherwise(x)))).cast("int") + 1
    digits = F.when(k > 0, k).otherwise(lead - k)
    digits = F.greatest(F.lit(1), F.least(F.lit(PACKED_DIGITS), digits))
    return F.printf(F.concat(F.lit("%."), (digits - 1).cast("string"), F.lit("e")), x)


def packed_hex(x: Column, k: Column | int) -> Column:
    """24 hex digits: sign and exponent sign, three exponent digits, then 17 digits of the number."""
    text = packed_text(x, k)
    mantissa = F.rpad(F.regexp_replace(F.substring_index(text, "e", 1), "[-.]", ""), PACKED_DIGITS, "0")
    exponent = F.substring_index(text, "e", -1).cast("int")
    top = F.when(signbit(x), 8).otherwise(0) + F.when(exponent < 0, 4).otherwise(0)
    body = F.concat(
        F.lower(F.hex(top.cast("bigint"))), F.lpad(F.abs(exponent).cast("string"), 3, "0"), F.lit("000"), mantissa
    )
    nan = F.lit("7fff0000ffffffffffffffff")
    inf = F.when(x > 0, F.lit("7fff00000000000000000000")).otherwise(F.lit("ffff00000000000000000000"))
    return F.when(F.isnan(x), nan).when(isinf(x), inf).otherwise(body)


def packed_value(text: Column) -> Column:
    """Number held by 24 packed hex digits."""
    top = F.conv(F.substring(text, 1, 1), 16, 10).cast("int")
    special = F.lower(F.substring(text, 2, 3)) == "fff"
    digits = F.concat(F.substring(text, 8, 1), F.lit("."), F.substring(text, 9, 16))
    number = F.concat(
        F.when(top >= 8, F.lit("-")).otherwise(F.lit("")), digits, F.lit("e"),
        F.when(top % 8 >= 4, F.lit("-")).otherwise(F.lit("")), F.substring(text, 2, 3),
    )
    inf = F.when(top >= 8, -_inf()).otherwise(_inf())
    return (
        F.when(special & (F.substring(text, 9, 16) != "0" * 16), _nan()).when(special, inf)
        .otherwise(number.try_cast("double"))
    )


MONADIC = {f.__name__: f for f in (
    fabs, facos, fasin, fatan, fatanh, fcos, fcosh, fetox, fetoxm1, fgetexp, fgetman, fint, fintrz,
    flog10, flog2, flogn, flognp1, fmove, fneg, fsin, fsinh, fsqrt, ftan, ftanh, ftentox, ftwotox)}
DYADIC = {f.__name__: f for f in (fadd, fdiv, fmod, fmul, frem, fscale, fsgldiv, fsglmul, fsub)}

# The operations that also exist with a fixed result precision.
_ROUNDED = ("fabs", "fmove", "fneg", "fsqrt", "fadd", "fdiv", "fmul", "fsub")


def _twin(fn, wrap):
    return lambda *args: wrap(fn(*args))


for _name in _ROUNDED:
    _home = MONADIC if _name in MONADIC else DYADIC
    _home["fs" + _name[1:]] = _twin(_home[_name], single)
    _home["fd" + _name[1:]] = _home[_name]

PI = math.pi
