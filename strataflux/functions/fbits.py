"""Number formats as hex digits: parse, widen, read as DOUBLE, compare in last-place units.

A constant is kept as 24 hex digits, right-justified, as in the 96-bit
extended layout: sign and 15-bit exponent, 16 unused bits, 64-bit significand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from strataflux.functions import ieee

HEX_DIGITS = 24
# Hex digits of a size, and the difference that means "far apart".
SIZE_DIGITS = {"b": 2, "w": 4, "l": 8, "s": 8, "d": 16, "x": 24, "p": 24}
FAR = (1 << 31) - 1
# Allowed last-place difference per size, and for extended results per precision.
SIZE_ULPS = {"s": 2, "d": 2, "p": 1}
PRECISION_ULPS = {"x": 2048, "d": 2, "s": 2}

WIDE = "decimal(20,0)"


def clean_constant(token: Column) -> Column:
    """Struct `(size, digits)`: size prefix dropped, `_` and `(...)` removed, right-justified."""
    size = F.nullif(F.regexp_extract(token, r"^\[([bwlsdxp])\]", 1), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(token, r"^\[[bwlsdxp]\]", ""), r"\([^)]*\)?|_", "")
    return F.struct(size.alias("size"), F.lpad(bare, HEX_DIGITS, "0").alias("digits"))


def is_constant(token: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(token, r"^\[[bwlsdxp]\]", ""), r"\([^)]*\)?|_", "")
    return bare.rlike(r"^[0-9a-f]{1,24}$")


def unsigned(hex_text: Column) -> Column:
    """Up to 16 hex digits as an exact unsigned number."""
    return F.conv(hex_text, 16, 10).cast(WIDE)


def _small(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("bigint")


# SQL cannot look at the bits of a DOUBLE; these four change only the type of
# what is already in the Arrow batch.

@F.arrow_udf(LongType())
def double_bits(x: pa.Array) -> pa.Array:
    """The 64 bits of a double as a whole number."""
    return pa.array(x.to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64), mask=_gaps(x))


@F.arrow_udf(DoubleType())
def bits_double(bits: pa.Array) -> pa.Array:
    """The double with these 64 bits."""
    return pa.array(_whole(bits).view(np.float64), mask=_gaps(bits))


@F.arrow_udf(DoubleType())
def bits_single(bits: pa.Array) -> pa.Array:
    """The single with these low 32 bits, as a double."""
    return pa.array(_whole(bits).astype(np.uint32).view(np.float32).astype(np.float64), mask=_gaps(bits))


@F.arrow_udf(DoubleType())
def extended_number(head: pa.Array, significand: pa.Array) -> pa.Array:
    """Nearest double of a sign-and-exponent word and 64 significand bits."""
    return pa.array(extended_double(_whole(head), _whole(significand).view(np.uint64)), mask=_gaps(head) | _gaps(significand))


def extended_double(word: np.ndarray, mant: np.ndarray) -> np.ndarray:
    exp = word & 32767
    with np.errstate(over="ignore"):
        size = np.ldexp(mant.astype(np.float64), np.clip(exp - (16383 + 63), -2200, 2200))
    size = np.where(exp == 32767, np.where(mant << np.uint64(1), np.nan, np.inf), size)
    return np.where(word & 32768, -size, size)


def packed_bytes(values: pa.Array) -> np.ndarray:
    """All bytes of a text or binary column, one value after the other."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1] if len(values) else [0, 0]
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)


def fixed_binary(rows: np.ndarray, gaps: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Rows of bytes as a binary (or text) column."""
    n, width = rows.shape
    ends = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)[:n + 1])
    valid = pa.py_buffer(np.packbits(~gaps, bitorder="little")) if gaps.any() else None
    return pa.Array.from_buffers(kind or pa.binary(), n, [valid, ends, pa.py_buffer(np.ascontiguousarray(rows, np.uint8))])


def _gaps(values: pa.Array) -> np.ndarray:
    return values.is_null().to_numpy(zero_copy_only=False)


def _whole(values: pa.Array) -> np.ndarray:
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _signed(hex_text: Column) -> Column:
    """16 hex digits as a 64-bit number in twos' complement."""
    return F.conv(hex_text, 16, -10).cast("bigint")


def single_value(digits: Column) -> Column:
    """Value of the low 32 bits read as a single."""
    return bits_single(_small(F.substring(digits, 17, 8)))


def double_value(digits: Column) -> Column:
    """Value of the low 64 bits read as a double."""
    return bits_double(_signed(F.substring(digits, 9, 16)))


def extended_value(digits: Column) -> Column:
    """Nearest double of an extended number; out-of-range exponents overflow or underflow as IEEE asks."""
    return extended_number(_small(F.substring(digits, 1, 4)), _signed(F.substring(digits, 9, 16)))


def integer_value(digits: Column, size: str) -> Column:
    """Value of the low 8, 16 or 32 bits as a signed number."""
    n = SIZE_DIGITS[size]
    raw = _small(F.substring(digits, HEX_DIGITS - n + 1, n))
    return F.when(raw >= 1 << (4 * n - 1), raw - (1 << (4 * n))).otherwise(raw)


def value(digits: Column, size: Column) -> Column:
    """Number held by a constant of any size, as DOUBLE."""
    out = F.when(size == "d", double_value(digits)).when(size == "s", single_value(digits))
    for s in ("b", "w", "l"):
        out = out.when(size == s, integer_value(digits, s).cast("double"))
    return out.when(size == "p", ieee.packed_value(digits)).otherwise(extended_value(digits))


def double_digits(x: Column) -> Column:
    """The 16 hex digits of a double; the inverse of `double_value`."""
    return F.lower(F.lpad(F.hex(double_bits(x)), 16, "0"))


def extended_digits(x: Column) -> Column:
    """The 24 hex digits of the extended form of a double (exact)."""
    bits = double_bits(x)
    exp = F.shiftright(bits, 52).bitwiseAND(2047)
    mant = bits.bitwiseAND((1 << 52) - 1)
    sign = F.when(bits < 0, 32768).otherwise(0)
    # a tiny number has no leading one of its own: its highest bit moves to the top
    width = F.length(F.bin(mant))
    tiny = exp == 0
    head = sign + F.when(tiny & (mant == 0), 0).when(exp == 2047, 32767).when(tiny, width + (16383 - 1075)).otherwise(exp + (16383 - 1023))
    top = F.lit(-(1 << 62)) * 2
    body = (
        F.when(tiny & (mant == 0), F.lit(0).cast("bigint")).when((exp == 2047) & (mant == 0), F.lit(0).cast("bigint"))
        .when(tiny, F.call_function("shiftleft", mant, 64 - width)).otherwise(F.shiftleft(mant, 11).bitwiseOR(top))
    )
    return F.lower(F.concat(F.lpad(F.hex(head.cast("bigint")), 4, "0"), F.lit("0000"), F.lpad(F.hex(body), 16, "0")))


def widen(constant: Column) -> Column:
    """Digits of a cleaned constant, converted to extended where it carried a size prefix."""
    size, digits = constant.getField("size"), constant.getField("digits")
    return F.when(size.isNull() | (size == "x"), digits).otherwise(extended_digits(value(digits, size)))


def _abs_diff(a: Column, b: Column) -> Column:
    diff = F.abs(a - b)
    return F.when(diff > FAR, F.lit(FAR).cast("bigint")).otherwise(diff.cast("bigint"))


def _half(m: Column, yes: Column) -> Column:
    return F.when(yes, F.floor(m / 2)).otherwise(m).cast(WIDE)


def ulp_diff(expected: Column, actual: Column, size: Column, prec: Column) -> Column:
    """Distance of two constants in units of the last place of their size.

    Extended results compare significands at the rounding precision; exponents
    one apart are aligned by halving the side with the smaller exponent, any
    other exponent distance is far apart. Signs of extended results are not
    part of the distance: they have their own condition code.
    """
    def low(col, n):
        return unsigned(F.substring(col, HEX_DIGITS - n + 1, n))

    # whole 96-bit fields: high half equal, or the low halves cannot be compared
    packed = F.when(F.substring(expected, 1, 8) == F.substring(actual, 1, 8), _abs_diff(low(expected, 16), low(actual, 16))
                    ).otherwise(F.lit(FAR).cast("bigint"))
    drop = F.when(prec == "d", F.lit(1 << 11)).when(prec == "s", F.lit(1 << 40)).otherwise(F.lit(1)).cast(WIDE)
    e_exp = _small(F.substring(expected, 1, 4)).bitwiseAND(32767)
    a_exp = _small(F.substring(actual, 1, 4)).bitwiseAND(32767)
    e = _half(F.floor(low(expected, 16) / drop).cast(WIDE), e_exp - a_exp == -1)
    a = _half(F.floor(low(actual, 16) / drop).cast(WIDE), e_exp - a_exp == 1)
    extended = F.when(F.abs(e_exp - a_exp) > 1, F.lit(FAR).cast("bigint")).otherwise(_abs_diff(e, a))
    out = F.when(size == "x", extended)
    for s in ("b", "w", "l"):
        n = SIZE_DIGITS[s]
        out = out.when(size == s, _abs_diff(low(expected, n), low(actual, n)))
    return out.otherwise(packed)


def tolerance(size: Column, prec: Column, exact: Column) -> Column:
    """Allowed distance: none for exact operations and integers."""
    by_prec = F.when(prec == "x", PRECISION_ULPS["x"]).when(prec == "d", PRECISION_ULPS["d"]).otherwise(PRECISION_ULPS["s"])
    out = F.when(exact, 0).when(size == "x", by_prec)
    for s, ulps in SIZE_ULPS.items():
        out = out.when(size == s, ulps)
    return out.otherwise(0).cast("bigint")
