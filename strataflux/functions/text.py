"""Printable text of bytes and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflux.functions import ieee


def printable(text: Column) -> Column:
    r"""`\` doubled, CR, LF and CR LF as one newline, other non-printables as `\ooo` of their bytes."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"\r\n?", "\n")
    pieces = F.regexp_extract_all(plain, F.lit(r"([\n -~]+|[^\n -~])"), F.lit(1))
    octal = lambda c: F.concat_ws("", F.transform(
        F.sequence(F.lit(1), F.octet_length(c)),
        lambda i: F.concat(F.lit("\\"), F.lpad(F.conv(F.hex(F.substring(F.encode(c, "UTF-8"), i, F.lit(1))), 16, 8), 3, "0")),
    ))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^[\n -~]"), p).otherwise(octal(p))), "")


def fixed_text(x: Column, places: int) -> Column:
    """Fixed-point text with at most seven places; no point when there are none."""
    return F.format_string(f"%.{min(places, 7)}f", x)


def _trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(E|$)", "$1$2"), r"\.(E|$)", "$1")


def number_text(x: Column, digits: int = 7) -> Column:
    """Shortest proportional text: trailing zeros dropped, exponent form outside 1e-4 .. 1e7."""
    a = F.abs(x)
    whole = F.greatest(F.lit(1), F.length(F.format_string("%.0f", F.floor(a).cast("double"))))
    plain = F.printf(F.concat(F.lit("%."), F.greatest(F.lit(0), F.least(F.lit(5), F.lit(digits) - whole)).cast("string"), F.lit("f")), x)
    # below one, six digits count after the leading zeros
    zeros = F.when((a > 0) & (a < 1), -F.floor(F.log10(F.when(a > 0, a).otherwise(F.lit(1.0)))) - 1).otherwise(0)
    small = F.printf(F.concat(F.lit("%."), (zeros + 6).cast("string"), F.lit("f")), x)
    scientific = F.upper(F.format_string("%.5e", x))
    return (
        F.when(F.isnan(x) | ieee.isinf(x), x.cast("string"))
        .when(a == 0, F.lit("0"))
        .when((a >= 1e7) | (a < 1e-4), _trim(scientific))
        .when(a < 1, _trim(small))
        .otherwise(_trim(plain))
    )


def text_number(text: Column) -> Column:
    """Number at the start of a text, 0 when there is none."""
    return F.coalesce(
        F.nullif(F.regexp_extract(text, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double"),
        F.lit(0.0),
    )
