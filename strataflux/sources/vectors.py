"""Conformance text: vector files, failure logs, coverage manifests, verdict reports."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, MapType, StringType, StructField, StructType

from strataflux.functions.fbits import HEX_DIGITS, fixed_binary, packed_bytes  # by name: a function that names a module takes all of it along to the tasks
from strataflux.operators.scan import FillForward, RunningSum, hold, scan
from strataflux.session import split_wide_code

# Words of the vector format.
ENABLES = ("bsun", "snan", "operr", "ovfl", "unfl", "dz", "inex2", "inex1")
CODES = ("n", "z", "i", "nan")
ROUNDINGS = ("rn", "rz", "rm", "rp")
PRECISIONS = ("x", "d", "s")
STATUS = CODES + ENABLES + ("aiop", "aovfl", "aunfl", "adz", "ainex")
TRAPS = ("sigfpe", "tbsun", "tinex", "tdz", "tunfl", "toperr", "tovfl", "tnan", "tunimp", "tunsup")
DIRECTIVES = ("verbose", "~verbose", "log", "~log", "local", "remote", "quit")
PLACES = ("in", "out", "dn") + tuple(f"d{i}" for i in range(8))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as `(suite, line_no, raw)`: the file's path, true 1-based line numbers, the text.

    Files stay splittable: a line's place is its file block and its order in
    that block, and the scan turns places into numbers.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("suite"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").alias("raw"),
    )
    return number_lines(lines)


def number_lines(lines: DataFrame) -> DataFrame:
    """Line numbers for `(suite, _block, raw)`, blocks as the text reader gives them: each in one piece, rows in reading order.

    The rows of a block have ids in sequence, so a block's first id and the lines
    of the blocks before it give the numbers, and no line is moved or sorted. There
    is one row for each block to broadcast.
    """
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    blocks = placed.groupBy("suite", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("suite").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("suite", "_block", (before + 1 - F.col("_first")).alias("_start"))
    return placed.join(F.broadcast(starts), ["suite", "_block"]).select("suite", (F.col("_at") + F.col("_start")).alias("line_no"), "raw")


def directive_state(lines: DataFrame, line: str = "line", part: str = "suite", order: str = "line_no", width: int | None = 1 << 16) -> DataFrame:
    """`verbose` on every line after a `verbose` directive, until `~verbose`."""
    state = F.when(F.col(line) == "verbose", True).when(F.col(line) == "~verbose", False)
    done = scan(lines, [part], [order], {"_state": FillForward(state)}, width=width)
    return done.withColumn("verbose", F.coalesce("_state", F.lit(False))).drop("_state")


def classify_lines(lines: DataFrame, width: int | None = 1 << 16) -> DataFrame:
    """Lower-cased lines with kind and verbose state; lines from `quit` on are dropped."""
    low = lines.withColumn("line", F.lower("raw"))
    kind = (
        F.when(F.col("line").startswith("#"), "comment").when(F.col("line") == "", "blank")
        .when(F.col("line").isin(*DIRECTIVES), "directive").otherwise("test")
    )
    state = F.when(F.col("line") == "verbose", True).when(F.col("line") == "~verbose", False)
    done = scan(
        low, ["suite"], ["line_no"],
        {"_state": FillForward(state), "_quit": RunningSum((F.col("line") == "quit").cast("bigint"))}, width=width,
    )
    return done.where(F.col("_quit") == 0).select(
        "suite", "line_no", "raw", "line", kind.alias("kind"), F.coalesce("_state", F.lit(False)).alias("verbose")
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return classify_lines(read_lines(spark, path))


# Words of a side, and the beginnings of its words with a value.
_LEFT = (ROUNDINGS + PRECISIONS + PLACES + tuple(s + w for w in ENABLES + CODES for s in ("", "~")), ("k#:", "ks:", "kd:", "q:"))
_RIGHT = (tuple(s + w for w in STATUS + TRAPS + ("t",) for s in ("", "~")) + ("f",), ("q:",))
_GAP = r"[ \t\n\x0b\f\r]+"
_ENDS = "\u0085\u2028\u2029"  # line ends inside a token: one at its end is not part of the word
_NIBBLE = np.zeros(256, np.uint8)
_NIBBLE[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16)
_TEXT, _WORDS = StringType(), ArrayType(StringType())
PARSED = StructType([StructField(name, kind) for name, kind in {
    "reason": _TEXT, "op": _TEXT, "size": _TEXT, "rmode": _TEXT, "prec": _TEXT, "enables": _WORDS, "codes": _WORDS, "in1": BinaryType(), "in1_from": _TEXT, "in2": BinaryType(),
    "k_word": _TEXT, "q_word": _TEXT, "moves_out": BooleanType(), "has_expect": BooleanType(), "exp1": BinaryType(), "exp2": BinaryType(),
    "exp_flags": MapType(StringType(), BooleanType())}.items()])


def _true(mask: pa.Array) -> np.ndarray:
    return mask.fill_null(False).to_numpy(zero_copy_only=False)


def _is_word(tokens: pa.Array, words: tuple, starts: tuple, odd: bool) -> np.ndarray:
    hit = _true(pc.is_in(tokens, value_set=pa.array(words)))
    if odd:
        known = [re.escape(w) for w in words] + [re.escape(s) + f"[^{_ENDS}]*" for s in starts]
        return _true(pc.match_substring_regex(tokens, f"^(?:{'|'.join(known)})[{_ENDS}]?$"))
    for s in starts:
        hit |= _true(pc.starts_with(tokens, s))
    return hit


def _bare(tokens: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Constants without size prefix, `_` and `(...)`, and their size prefix."""
    marked = pc.or_(pc.starts_with(tokens, "["), pc.or_(pc.match_substring(tokens, "("), pc.match_substring(tokens, "_")))
    some = tokens.filter(marked)
    sized = pc.match_substring_regex(some, r"^\[[bwlsdxp]\]")
    cut = pc.replace_substring_regex(pc.if_else(sized, pc.utf8_slice_codeunits(some, 3), some), r"\([^)]*\)?|_", "")
    size = pc.if_else(sized, pc.utf8_slice_codeunits(some, 1, 2), pa.scalar(None, pa.string()))
    return pc.replace_with_mask(tokens, marked, cut), pc.replace_with_mask(pa.nulls(len(tokens), pa.string()), marked, size)


def _constant_bytes(bare: pa.Array) -> pa.Array:
    """Twelve bytes of hex digits, right-justified; null where they are none."""
    digits = pc.utf8_slice_codeunits(pc.utf8_lpad(bare, HEX_DIGITS, "0"), 0, HEX_DIGITS)
    good = _true(pc.match_substring_regex(digits, "^[0-9a-f]{24}$"))
    text = pc.if_else(pa.array(good), digits, "0" * HEX_DIGITS)
    half = _NIBBLE[packed_bytes(text)].reshape(-1, 2)
    return fixed_binary((half[:, 0] << 4 | half[:, 1]).reshape(-1, 12), ~good)


class _Rows:
    """Tokens of one kind, grouped by their line."""

    def __init__(self, tokens: pa.Array, row: np.ndarray, n: int):
        self.tokens, self.row, self.count = tokens, row, np.bincount(row, minlength=n)
        self.start = np.cumsum(self.count) - self.count

    def at(self, i: int, values: pa.Array | None = None) -> pa.Array:
        """The i-th token (or its value) of each line, the last for -1; null where there is none."""
        there = self.count > max(i, 0)
        place = self.start + (i if i >= 0 else self.count - 1)
        return (self.tokens if values is None else values).take(pa.array(np.where(there, place, 0), mask=~there))

    def pick(self, mask: np.ndarray) -> _Rows:
        return _Rows(self.tokens.filter(pa.array(mask)), self.row[mask], len(self.count))

    def among(self, words: tuple) -> _Rows:
        return self.pick(_true(pc.is_in(self.tokens, value_set=pa.array(words))))

    def offsets(self) -> pa.Array:
        return pa.array(np.append(self.start, len(self.row)).astype(np.int32))

    def lists(self, gone: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(self.offsets(), self.tokens, mask=pa.array(gone))


@F.arrow_udf(PARSED)
def _parsed(line: pa.Array) -> pa.Array:
    """Fields of test lines, or the reason of a reject: all tokens of a batch at once."""
    n, gone = len(line), line.is_null().to_numpy(zero_copy_only=False)
    split = pc.split_pattern_regex(pc.utf8_trim(pc.replace_substring(line, "=", " = "), " "), _GAP)
    t, row = split.flatten(), pc.list_parent_indices(split).to_numpy()
    odd = bool(pc.any(pc.match_substring_regex(line, f"[{_ENDS}]")).as_py())
    equals = _true(pc.equal(t, "="))
    at, place = np.full(n, len(t)), np.flatnonzero(equals)[::-1]
    at[row[place]] = place  # the first of a line is written last
    right = np.arange(len(t)) > at[row]
    word = np.where(right, _is_word(t, *_RIGHT, odd), _is_word(t, *_LEFT, odd)) & ~equals
    rest = np.flatnonzero(~equals & ~word)
    bare, size = _bare(t.take(pa.array(rest)))
    constant = _true(pc.match_substring_regex(bare, f"^[0-9a-f]{{1,24}}[{_ENDS}]?$"))

    def rows(mask):
        return _Rows(t.filter(pa.array(mask)), row[mask], n)

    def constants(mask):
        return _Rows(bare.filter(pa.array(mask)), row[rest[mask]], n)

    left, said = rows(word & ~right), rows(word & right)
    ins, outs = constants(constant & ~right[rest]), constants(constant & right[rest])
    ops = _Rows(t.take(pa.array(rest[~constant])), row[rest[~constant]], n)
    names = ops.at(0).dictionary_encode()
    parts = pc.extract_regex(names.dictionary, rf"^(?P<op>[a-z0-9]+)\.(?P<size>[bwlsdxp][{_ENDS}]?)$")
    op, op_size = (pc.struct_field(parts, f).take(names.indices) for f in ("op", "size"))
    named = ~op.is_null().to_numpy(zero_copy_only=False)
    why = np.select([gone, ops.count == 0, ops.count > 1, ~named], [0, 1, 2, 3], 0)
    reason = pa.array([None, "no test name", "unknown item", "unknown test name"]).take(pa.array(why))

    # the last word on a flag counts
    flags = said.pick(~_true(pc.starts_with(said.tokens, "q:")))
    clear = pc.starts_with(flags.tokens, "~")
    key = pc.if_else(pc.is_in(flags.tokens, value_set=pa.array(["t", "~t", "f"])), "taken", pc.utf8_ltrim(flags.tokens, "~")).dictionary_encode()
    pair = flags.row * max(len(key.dictionary), 1) + key.indices.to_numpy()
    last, seen = np.zeros(n * max(len(key.dictionary), 1), np.int64), np.arange(len(pair))
    last[pair] = seen
    kept = last[pair] == seen
    value = pc.invert(pc.or_(clear, pc.equal(flags.tokens, "f")))
    final = flags.pick(kept)
    flag_map = pa.MapArray.from_arrays(final.offsets(), key.dictionary.take(key.indices).filter(pa.array(kept)), value.filter(pa.array(kept)))
    none = pa.scalar(None)

    def unless_gone(values):
        return pc.if_else(pa.array(gone), none.cast(values.type), values) if gone.any() else values

    fields = {
        "reason": reason, "op": op, "size": op_size, "rmode": left.among(ROUNDINGS).at(-1).fill_null("rn"), "prec": left.among(PRECISIONS).at(-1).fill_null("x"),
        "enables": left.among(ENABLES).lists(gone), "codes": left.among(CODES).lists(gone),
        "in1": _constant_bytes(ins.at(0)), "in1_from": ins.at(0, size.filter(pa.array(constant & ~right[rest]))), "in2": _constant_bytes(ins.at(1)),
        "k_word": left.pick(_true(pc.match_substring_regex(left.tokens, "^(?:k#|ks|kd):"))).at(-1), "q_word": said.pick(_true(pc.starts_with(said.tokens, "q:"))).at(-1),
        "moves_out": unless_gone(pa.array(left.among(("out",)).count > 0)), "has_expect": unless_gone(pa.array(at < len(t))),
        "exp1": _constant_bytes(outs.at(0)), "exp2": _constant_bytes(outs.at(1)), "exp_flags": flag_map}
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


def parse_vectors(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rows of the test lines, and the rejected lines with a reason.

    Tokens before the first `=` are settings and operands, those after it
    expected flags and results. A token is a known word, a constant or, once
    per line, the operation.
    """
    split_wide_code(lines.sparkSession)
    judged = hold(lines.where("kind = 'test'"), _p=_parsed(F.col("line")))
    rejects = judged.where("_p.reason is not null").select("suite", "line_no", "raw", F.col("_p.reason").alias("reason"))

    def number(word, prefix, base):
        hit = F.regexp_extract(word, prefix + "(-?[0-9a-f]+)", 2)
        return (F.conv(hit, 16, 10) if base == 16 else hit).cast("int")

    def parsed(*names):
        return [F.col(f"_p.{c}").alias(c) for c in names]

    vectors = judged.where("_p.reason is null").select(
        "suite", "line_no", *parsed("op", "size", "rmode", "prec", "enables", "codes", "in1", "in1_from", "in2"),
        number(F.col("_p.k_word"), "^(k#:|ks:|kd:)", 10).alias("kfactor"), number(F.col("_p.q_word"), "^(q:)", 16).alias("qbyte"),
        *parsed("moves_out", "has_expect", "exp1", "exp2", "exp_flags"), "verbose", "raw",
    )
    return vectors, rejects


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure logs as one row per failed vector: `(suite, record, vector, actual, failed[])`."""
    return failure_records(read_lines(spark, path))


def failure_records(lines: DataFrame, width: int | None = 1 << 16) -> DataFrame:
    """Group the lines of each failure; a record starts at every line that is not indented or blank."""
    kind = (
        F.when(F.trim("raw") == "", "blank").when(F.col("raw").rlike(r"^\s+=") , "actual")
        .when(F.col("raw").rlike(r"^\s+\*\*\* Check failed:"), "failed").when(F.col("raw").rlike(r"^\s"), "detail")
        .otherwise("vector")
    )
    marked = scan(lines.withColumn("_k", kind), ["suite"], ["line_no"],
                  {"record": RunningSum((F.col("_k") == "vector").cast("bigint"))}, width=width)
    failed = F.regexp_extract("raw", r"Check failed:\s*(.*\S)", 1)
    return marked.where("record > 0").groupBy("suite", "record").agg(
        F.max(F.when(F.col("_k") == "vector", F.trim("raw"))).alias("vector"),
        F.max(F.when(F.col("_k") == "actual", F.regexp_extract("raw", r"=\s*(.*\S)", 1))).alias("actual"),
        # a vector has a fixed number of checks, so the list is short
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") == "failed", F.struct("line_no", failed.alias("name"))))),
                    lambda e: e["name"]).alias("failed"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Coverage manifest: `(suite, note, missing)` from lines of a file name and a description."""
    return manifest_rows(spark.read.text(path).select(F.col("value").alias("raw")))


def manifest_rows(lines: DataFrame) -> DataFrame:
    hit = lines.select(F.regexp_extract("raw", r"^([A-Z]\S*[._]\S+)\s+(\S.*)$", 1).alias("suite"),
                       F.regexp_extract("raw", r"^([A-Z]\S*[._]\S+)\s+(\S.*)$", 2).alias("note"))
    return hit.where("suite <> ''").select("suite", "note", F.col("note").startswith("missing").alias("missing"))


def write_report(verdicts: DataFrame, path: str, by: str = "suite") -> None:
    """Failed checks as parquet, one folder per suite."""
    verdicts.write.mode("errorifexists").partitionBy(by).parquet(path)


def report_text(failures: DataFrame) -> DataFrame:
    """Text form of failure records, the inverse of `failure_records`."""
    return failures.select(F.concat_ws(
        "\n", F.col("vector"), F.concat(F.lit("\t= "), F.col("actual")),
        F.array_join(F.transform("failed", lambda f: F.concat(F.lit("\t*** Check failed: "), f)), "\n"), F.lit("")).alias("value"))
