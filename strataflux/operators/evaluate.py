"""Run bound vectors with DOUBLE arithmetic and compare with their expectations.

DOUBLE carries 53 bits. A vector whose operands, mode or exact result need more
gets the verdict `not_representable` instead of a false pass or failure, whatever
its result is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from strataflux.functions import conditions, ieee
# by name: a function that names a module takes all of it along to the tasks
from strataflux.functions.fbits import FAR, PRECISION_ULPS, extended_double, fixed_binary, packed_bytes
from strataflux.functions.ieee import significand_exponent
from strataflux.operators.scan import hold
from strataflux.session import split_wide_code

_PLAIN = [n for n in ieee.MONADIC if n not in ("fint", "fintrz", "fgetexp", "fgetman")]
TESTS = ("ftst", "fcmp")  # set codes only
MODE_FREE = ("fint", "fintrz", "fabs", "fneg", "fmod", "frem", "fgetexp", "fgetman", *TESTS)
CODES = ("n", "z", "i", "nan")
# Flags that follow from operands, result and enabled exceptions of any operation.
DERIVED = (*CODES, "bsun", "snan", "operr", "dz", "aiop", "adz")
DIVISIONS = ("fdiv", "fsdiv", "fddiv", "fsgldiv")


def _result(op: Column, mode: Column, x: Column, y: Column) -> Column:
    out = F.when(op == "fintrz", ieee.fintrz(x))
    for m in ("rn", "rz", "rm", "rp"):
        out = out.when((op == "fint") & (mode == m), ieee.fint(x, m))
    out = out.when(op == "fsincos", ieee.fcos(x))
    for name in _PLAIN:
        out = out.when(op == name, ieee.MONADIC[name](x))
    # the first operand is the one operated on: fsub a b is a - b
    for name, fn in ieee.DYADIC.items():
        out = out.when(op == name, fn(x, y))
    return out


def _field(digits: Column, first: int, count: int, mask: int) -> Column:
    return F.conv(F.substring(digits, first, count), 16, 10).cast("int").bitwiseAND(mask)


def signals(digits: Column, size: Column) -> Column:
    """Whether a constant is a signalling NaN: full exponent, top fraction bit clear, other fraction bits not."""
    def nan(exponent, quiet, fraction):
        return exponent & ~quiet & fraction
    single = nan(_field(digits, 17, 3, 0x7F8) == 0x7F8, _field(digits, 19, 1, 4) > 0, (_field(digits, 19, 1, 7) > 0) | (F.substring(digits, 20, 5) != "0" * 5))
    double = nan(_field(digits, 9, 3, 0x7FF) == 0x7FF, _field(digits, 12, 1, 8) > 0, F.substring(digits, 12, 13) != "0" * 13)
    extended = nan(_field(digits, 1, 4, 0x7FFF) == 0x7FFF, _field(digits, 9, 1, 4) > 0, (_field(digits, 9, 1, 7) > 0) | (F.substring(digits, 10, 15) != "0" * 15))
    return F.coalesce(F.when(size == "s", single).when(size == "d", double).when(size == "x", extended), F.lit(False))


# --- batches -----------------------------------------------------------------
# What a vector's constants and flags say is read from their bits, a batch at a time.

def _row(**fields: DataType) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


OPERANDS = _row(x=DoubleType(), y=DoubleType(), man=DoubleType(), exp=DoubleType(), snan=BooleanType(), fits=BooleanType())
JUDGED = _row(act1=StringType(), ulps=LongType(), tol=LongType(), failed=ArrayType(StringType()), verdict=StringType())
# every flag that has a value; others count as clear
FLAGS = (*DERIVED, "taken", "tbsun", "sigfpe")
_AT = {f: i for i, f in enumerate(FLAGS)}
_BRANCHES = tuple("fb" + p for p in conditions.PREDICATES)
# by predicate, then n, z, nan as bits
_TAKEN = np.array([[conditions.taken(p, bool(c & 4), bool(c & 2), bool(c & 1)) for c in range(8)] for p in conditions.PREDICATES])
_ALWAYS = np.array([p in ("t", "st") for p in conditions.PREDICATES])
_SIGNALS = np.array([p in conditions.SIGNALLING for p in conditions.PREDICATES])
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


def _gaps(values: pa.Array) -> np.ndarray:
    return values.is_null().to_numpy(zero_copy_only=False)


def _true(values: pa.Array) -> np.ndarray:
    return values.fill_null(False).to_numpy(zero_copy_only=False)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.fill_null(0).to_numpy(zero_copy_only=False)


def _place(values: pa.Array, words: tuple) -> np.ndarray:
    """Position among `words`, -1 for others."""
    return pc.index_in(values, value_set=pa.array(words)).fill_null(-1).to_numpy(zero_copy_only=False)


def _one_of(values: pa.Array, *words: str) -> np.ndarray:
    return _true(pc.is_in(values, value_set=pa.array(words)))


def _halves(constants: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sign-and-exponent word and the low 64 bits of 96-bit constants; zeros for nulls."""
    if not _true(pc.equal(pc.binary_length(constants), 12)).all():
        constants = pa.array([(v or b"").rjust(12, b"\0")[-12:] for v in constants.to_pylist()], pa.binary())
    raw = packed_bytes(constants).reshape(-1, 12)
    return raw[:, :2].copy().view(">u2")[:, 0].astype(np.int64), raw[:, 4:].copy().view(">u8")[:, 0].astype(np.uint64)


def _low_bits_clear(word: np.ndarray, low: np.ndarray) -> np.ndarray:
    """An extended constant that DOUBLE holds exactly: 53 significant bits, exponent in range."""
    exp = word & 32767
    return (low & np.uint64(2047) == 0) & ((exp == 0) & (low == 0) | (exp >= 16383 - 1022) & (exp <= 16383 + 1023) | (exp == 32767))


def _operand(word: np.ndarray, low: np.ndarray, size: pa.Array, packed: pa.Array, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of a constant, where there is none, and whether it is a signalling NaN."""
    signed, is_ = low.view(np.int64), {s: _true(pc.equal(size, s)) for s in "dsbwlpx"}
    value, signals = extended_double(word, low), np.zeros(len(low), bool)
    value = np.where(is_["d"], low.view(np.float64), value)
    single = (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    value = np.where(is_["s"], single.view(np.float32).astype(np.float64), value)
    for s, kind in (("b", np.int8), ("w", np.int16), ("l", np.int32)):
        value = np.where(is_[s], signed.astype(kind).astype(np.float64), value)
    value = np.where(is_["p"], _numbers(packed), value)

    def nan(exponent, full, quiet, fraction):
        return (exponent & full == full) & (fraction & quiet == 0) & (fraction != 0)

    signals |= is_["s"] & nan(signed, 0x7F800000, 0x400000, signed & 0x7FFFFF)
    signals |= is_["d"] & nan(signed >> 52, 0x7FF, 1 << 51, signed & ((1 << 52) - 1))
    signals |= is_["x"] & nan(word, 0x7FFF, 1 << 62, signed & ((1 << 63) - 1))
    return value, missing | is_["p"] & _gaps(packed), signals & ~missing


@F.arrow_udf(OPERANDS)
def _operands(in1: pa.Array, s1: pa.Array, p1: pa.Array, in2: pa.Array, s2: pa.Array, p2: pa.Array, two: pa.Array) -> pa.Array:
    """Values of the operands, significand and exponent of the first, and whether DOUBLE holds both; `p1`, `p2` are packed values."""
    (w1, l1), (w2, l2), both = _halves(in1), _halves(in2), _true(two)
    x, no_x, snan = _operand(w1, l1, s1, p1, _gaps(in1))
    y, no_y, snan2 = _operand(w2, l2, s2, p2, _gaps(in2))
    fits = np.where(_one_of(s1, "x"), _low_bits_clear(w1, l1), ~_one_of(s1, "p"))
    fits &= np.where(both & _one_of(s2, "x"), _low_bits_clear(w2, l2), ~(both & _one_of(s2, "p")))
    man, exp = significand_exponent(x)
    columns = [pa.array(x, mask=no_x), pa.array(y, mask=no_y), pa.array(man, mask=no_x), pa.array(exp, mask=no_x), pa.array(snan | both & snan2), pa.array(fits)]
    return pa.StructArray.from_arrays(columns, names=["x", "y", "man", "exp", "snan", "fits"])


def _extended(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign-and-exponent word and significand of doubles in extended form (exact)."""
    bits = x.view(np.int64)
    exp, mant = bits >> 52 & 2047, bits & ((1 << 52) - 1)
    # a tiny number has no leading one of its own: its highest bit moves to the top
    width = np.frexp(mant.astype(np.float64))[1].astype(np.int64)
    tiny, zero = exp == 0, (exp == 0) & (mant == 0)
    word = np.where(bits < 0, 32768, 0) + np.select([zero, exp == 2047, tiny], [0, 32767, width + (16383 - 1075)], exp + (16383 - 1023))
    own = mant.astype(np.uint64)
    low = np.where(tiny, own << np.where(zero, 0, 64 - width).astype(np.uint64), own << np.uint64(11) | np.uint64(1 << 63))
    return word, np.where(zero | (exp == 2047) & (mant == 0), np.uint64(0), low)


def _hex_text(word: np.ndarray, low: np.ndarray, gaps: np.ndarray) -> pa.Array:
    raw = np.zeros((len(word), 12), np.uint8)
    raw[:, :2], raw[:, 4:] = word.astype(">u2").view(np.uint8).reshape(-1, 2), low.astype(">u8").view(np.uint8).reshape(-1, 8)
    return fixed_binary(_HEX[raw].reshape(-1, 24), gaps, pa.string())


def _ulps(word: np.ndarray, low: np.ndarray, other: np.ndarray, other_low: np.ndarray, prec: pa.Array) -> np.ndarray:
    """`ulp_diff` of extended constants."""
    drop = np.select([_one_of(prec, "d"), _one_of(prec, "s")], [11, 40], 0).astype(np.uint64)
    step = (word & 32767) - (other & 32767)
    a, b = low >> drop >> (step == -1).astype(np.uint64), other_low >> drop >> (step == 1).astype(np.uint64)
    far = np.where(a > b, a - b, b - a)
    return np.where(np.abs(step) > 1, FAR, np.minimum(far, np.uint64(FAR)).astype(np.int64))


def _flags(op: pa.Array, x, no_x, y, no_y, r, no_r, sine, no_sine, two, snan) -> np.ndarray:
    """FLAGS of operations that are no branches; what follows from a missing value is clear."""
    got = np.zeros((len(x), len(FLAGS)), bool)
    fcmp, ftst = _one_of(op, "fcmp"), _one_of(op, "ftst")
    v = np.where(ftst, x, np.where(no_sine, r, sine))
    no_v = np.where(ftst, no_x, no_sine & no_r)
    nan_x, nan_y, nan_v = np.isnan(x) & ~no_x, np.isnan(y) & ~no_y, np.isnan(v) & ~no_v
    known = ~no_x & ~no_y
    equal, less = known & (x == y), known & (x < y)
    got[:, _AT["n"]] = np.where(fcmp, ~nan_x & ~nan_y & (less | equal & np.signbit(x)), ~no_v & ~nan_v & np.signbit(v))
    got[:, _AT["z"]] = np.where(fcmp, equal, ~no_v & (v == 0))
    got[:, _AT["i"]] = ~fcmp & ~no_v & np.isinf(v)
    got[:, _AT["nan"]] = np.where(fcmp, nan_x | nan_y, nan_v)
    poles = _one_of(op, "flogn", "flog2", "flog10") & (x == 0) | _one_of(op, "flognp1") & (x == -1) | _one_of(op, "fatanh") & (np.abs(x) == 1)
    dz = ~nan_x & ~no_x & (poles | _one_of(op, *DIVISIONS) & ~no_y & (y == 0) & (x != 0) & ~np.isinf(x))
    operr = np.isnan(r) & ~no_r & ~nan_x & ~(two & nan_y) & ~fcmp & ~ftst
    for name, flag in (("snan", snan), ("operr", operr), ("dz", dz), ("aiop", snan | operr), ("adz", dz)):
        got[:, _AT[name]] = flag
    return got


def _branch_flags(op: pa.Array, codes: pa.Array, enables: pa.Array) -> np.ndarray:
    """FLAGS after a conditional branch: `taken`, the codes and what an unordered comparison raises.

    A signalling predicate on an unordered code raises BSUN. Where that is
    enabled it traps, and the branch is then decided without the unordered code.
    """
    got, which = np.zeros((len(op), len(FLAGS)), bool), _place(op, _BRANCHES)

    def has(words, word):
        found = np.zeros(len(op), bool)
        found[pc.list_parent_indices(words).to_numpy()[_one_of(words.flatten(), word)]] = True
        return found

    n, z, nan = has(codes, "n"), has(codes, "z"), has(codes, "nan")
    bsun = nan & (which >= 0) & _SIGNALS[which]
    trap = bsun & has(enables, "bsun")
    nan = nan & ~trap
    taken = (which >= 0) & _TAKEN[which, n * 4 + z * 2 + nan] & (~_gaps(codes) | _ALWAYS[which])
    flags = {"taken": taken, "n": n, "z": z, "i": has(codes, "i"), "nan": nan, "bsun": bsun, "aiop": bsun, "tbsun": trap, "sigfpe": trap}
    for name, flag in flags.items():
        got[:, _AT[name]] = flag
    return got


@F.arrow_udf(JUDGED)
def _judged(runs: pa.Array, op: pa.Array, arity: pa.Array, rmode: pa.Array, prec: pa.Array, exact: pa.Array, exp_flags: pa.Array, codes: pa.Array, enables: pa.Array, qbyte: pa.Array,
            exp1: pa.Array, exp2: pa.Array, operands: pa.Array, r: pa.Array, sine: pa.Array, byte: pa.Array) -> pa.Array:
    n, run, one, both = len(op), _true(runs), _true(pc.equal(arity, 0)), _true(pc.equal(arity, 2))
    test, sincos, strict = _one_of(op, *TESTS), _one_of(op, "fsincos"), _true(exact)
    x, y, snan, fits = (pc.struct_field(operands, f) for f in ("x", "y", "snan", "fits"))
    no_r, no_sine, no_1, no_2 = _gaps(r), _gaps(sine), _gaps(exp1), _gaps(exp2)
    result, second = _numbers(r), _numbers(sine)
    got_1, got_2, want_1, want_2 = _extended(result), _extended(second), _halves(exp1), _halves(exp2)

    # an exact operation whose full result has more than 53 bits cannot be judged
    rounded = ~_gaps(rmode) & ~_one_of(rmode, "rn") & ~_one_of(op, *MODE_FREE)
    unfit = ~one & (~_true(fits) | rounded | strict & ~no_1 & ~_low_bits_clear(*want_1) & ~test)

    ulps, no_ulps = _ulps(*want_1, *got_1, prec), no_1 | no_r
    tol = np.where(strict, 0, np.where(_one_of(prec, "x"), PRECISION_ULPS["x"], np.where(_one_of(prec, "d"), PRECISION_ULPS["d"], PRECISION_ULPS["s"])))
    off = ~(~no_ulps & (ulps <= tol))
    off_2 = sincos & ~no_2 & ~no_sine & (_ulps(*want_2, *got_2, prec) > tol)

    got = _flags(op, _numbers(x), _gaps(x), _numbers(y), _gaps(y), result, no_r, second, no_sine, both, _true(snan))
    if one.any():
        got[one] = _branch_flags(op, codes, enables)[one]
    ends = exp_flags.offsets.to_numpy()
    row = np.repeat(np.arange(n), np.diff(ends))
    keys, values = exp_flags.keys.slice(ends[0], len(row)), exp_flags.items.slice(ends[0], len(row))
    which = _place(keys, FLAGS)
    derived = (which >= 0) & (which < len(DERIVED))
    want = _true(values)
    wrong = (one[row] | derived) & ~_gaps(values) & (want != ((which >= 0) & got[row, which]))
    # no quotient byte without a quotient
    q, no_q, no_byte = _numbers(qbyte), _gaps(qbyte), _gaps(byte)
    off_byte = ~no_q & (q >= 0) & ~no_byte & (q != _numbers(byte))
    unlisted = _gaps(exp_flags)
    more = np.bincount(row[~derived], minlength=n) > 0
    unknown = ~one & (more | ~no_2 & ~sincos) | ~no_q & no_byte

    named = pc.if_else(pa.array(want[wrong]), keys.filter(pa.array(wrong)), pc.binary_join_element_wise("~", keys.filter(pa.array(wrong)), ""))
    off_byte, off_2 = off_byte & ~unlisted, off_2 & ~unlisted
    whose = np.concatenate([row[wrong], np.flatnonzero(off_byte), np.flatnonzero(off_2)])
    names = pa.concat_arrays([named, pa.array(["qbyte"] * int(off_byte.sum()) + ["result2"] * int(off_2.sum()), pa.string())])
    count = np.bincount(whose, minlength=n)
    ends = pa.array(np.append(0, np.cumsum(count)).astype(np.int32))
    failed = pa.ListArray.from_arrays(ends, names.take(pa.array(np.argsort(whose, kind="stable"))))
    failed = pc.if_else(pa.array(run & ~unlisted), failed, pa.scalar(None, failed.type))

    bad = off & ~one & ~test | (count > 0)
    verdict = np.select([~run, unfit, bad, unknown], [0, 1, 2, 0], 3)
    hidden = ~(run & ~one & ~test)
    columns = [_hex_text(*got_1, hidden | no_r), pa.array(ulps, mask=hidden | no_ulps), pa.array(tol, pa.int64(), mask=hidden), failed,
               pa.array(["not_judged", "not_representable", "mismatch", "ok"]).take(pa.array(verdict))]
    return pa.StructArray.from_arrays(columns, names=["act1", "ulps", "tol", "failed", "verdict"])


def run_vectors(bound: DataFrame) -> DataFrame:
    """One row per bound vector with `act1`, `ulps`, `tol`, `failed` and `verdict`.

    `failed` lists the flags that differ from the expectation, those that should
    be clear with a leading `~`, then `qbyte` for the quotient byte (0 but for
    fmod and frem) and `result2` for the sine of fsincos, whose first result is
    the cosine. Condition codes, BSUN, SNAN, OPERR, DZ and their accrued forms are
    derived; branches are judged by all their flags. `ftst` and `fcmp` have
    flags only, so no `act1`.

    A vector that is not run (moves out, no operand or no expectation) is
    `not_judged`. So is one whose checked parts are right but which expects
    more: overflow, inexact and trap flags. An unchecked expectation never reads
    as ok. What DOUBLE cannot hold is `not_representable`, right or wrong.
    """
    split_wide_code(bound.sparkSession)
    two, op = F.col("arity") == 2, F.col("op")
    runs = F.coalesce(F.expr("""has_expect and not moves_out and (arity = 0 or in1 is not null and (arity = 1 or in2 is not null)
        and (op in ('ftst', 'fcmp') or exp1 is not null) and (op <> 'fsincos' or exp2 is not null))"""), F.lit(False))
    s1 = F.when(F.col("in1_from").isNotNull(), F.col("in1_from")).when(two, "x").otherwise(F.col("size"))

    def packed(constant, size):
        return F.when(size == "p", ieee.packed_value(F.lower(F.hex(constant))))

    kept = ("suite", "line_no", "op", "arity", "rmode", "prec", "exact", "exp_flags", "codes", "enables", "qbyte", "exp1", "exp2")
    values = hold(bound.select(*kept, "in1", "in2", s1.alias("_s1"), F.col("size").alias("_s2"), two.alias("_two"), runs.alias("_runs")),
                  _o=_operands("in1", "_s1", packed("in1", F.col("_s1")), "in2", "_s2", packed("in2", F.col("_s2")), "_two"))
    x, y = F.col("_o.x"), F.col("_o.y")
    byte = F.when(op.isin("fmod", "frem"), ieee.fquotient(x, y)).otherwise(0).cast("bigint")
    result = F.when(op == "fgetexp", F.col("_o.exp")).when(op == "fgetman", F.col("_o.man")).otherwise(_result(op, F.col("rmode"), x, y))
    done = values.select(*kept, "_runs", "_o", result.alias("_r"), F.when(op == "fsincos", ieee.fsin(x)).alias("_sine"), byte.alias("_byte"))
    judged = hold(done, _v=_judged("_runs", *kept[2:], "_o", "_r", "_sine", "_byte"))
    return judged.select("suite", "line_no", "op", F.lower(F.hex("exp1")).alias("exp1"), *[F.col(f"_v.{c}").alias(c) for c in ("act1", "ulps", "tol", "failed", "verdict")])
