"""Conversation structure repair by one shortest path over big integers.

Rows of a conversation are taken by turn (nulls first; equal turns by role, then
by the SHA-256 of the text). The first fault of a row counts: blank, duplicate
(role and text seen earlier), truncated. Edits turn the role initials into
`(s?(ua)+)?`:

    K  keep                                cost 0
    R  give the role user or assistant     cost 2
    D  delete; blank and duplicate rows must go   cost 3
    I  insert an empty user or assistant row      cost 2

and a truncated row that stays adds 1. The automaton of the pattern has four
states (start, system, user, assistant); at each of them only one of user and
assistant can follow, so an audit, the initials of all edits, fixes the result.

The weight of a path is one integer. Its high digits are the cost, its low digits
the audit: three bits a letter, in order, in as many places as the audit can have,
zeros behind its end. So the least integer is the cheapest path, and among those
the ASCII-least audit. The dynamic program runs from the last row to the first:
a letter put in front moves the letters behind it one place down.

A conversation may be of any length. All rows are sorted by one range
partitioning, and cut into chunks of at most 512 rows of a partition. A chunk is a
4 x 4 matrix of costs; matrices are combined in a tree of groups of at most 4,096,
which gives each chunk the cost still to come behind it. With it the chunk is
solved for every state it may be entered in, and a second tree of state maps gives
the one it is entered in. Letters of other rows never meet in one number: paths
that end a chunk in different states differ before their ends, as inserts stand
before a row or at the very end. Only the SHA-256 of a repaired conversation is
serial by definition: its rows stream, sorted, through one task that holds the
audit and one row.

A null role or text counts as one space, as does a null in the damage key. Rows
with a null conv_id are one conversation. A role whose initial is none of s, u, a
cannot be kept. Repeated rows are duplicates. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflux.llm import common

CHUNK_BITS, GROUP_BITS = 9, 12
NEVER = 1 << 40  # more than any cost
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FOLLOWS = (USER, USER, ASSISTANT, USER)  # the one of user and assistant that may follow a state
ROLES = {USER: b"user", ASSISTANT: b"assistant"}
TAIL = ("", "II", "I", "")  # inserts that end a conversation in an accepting state
ENDS = tuple(2 * len(t) for t in TAIL)
PLACE = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = " DIKR"


# --- one chunk -------------------------------------------------------------


def steps(letter: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, letters, next state) of a row: its class s, u, a or x, upper case where truncated, or d where it must go."""
    out = [(3, "D", state)]
    if letter != "d":
        extra, initial = int(letter.isupper()), letter.lower()
        for cost, before, at in ((extra, "", state), (extra + 2, "I", FOLLOWS[state])):
            if (at, initial) in NEXT:
                out.append((cost, before + "K", NEXT[at, initial]))
            out.append((cost + 2, before + "R", FOLLOWS[at]))
    return out


STEPS = {letter: [steps(letter, s) for s in range(4)] for letter in "suaxSUAXd"}


def matrix(letters: str) -> list[int]:
    """Least cost from each state (rows of four) to each state."""
    out = []
    for first in range(4):
        cost = [NEVER] * 4
        cost[first] = 0
        for letter in letters:
            after = [NEVER] * 4
            for s, c in enumerate(cost):
                if c < NEVER:
                    for more, _, t in STEPS[letter][s]:
                        after[t] = min(after[t], c + more)
            cost = after
        out += cost
    return out


def solve(letters: str, behind: tuple[int, ...]) -> list[tuple[int, str, int]]:
    """(cost with what comes behind, audit, exit state) for each entry state; `behind` is the cost from each exit state on."""
    room = 6 * len(letters)  # two letters a row, three bits each
    low = (1 << room) - 1
    weight = [c << room for c in behind]
    for letter in reversed(letters):
        before = []
        for options in STEPS[letter]:
            best = None
            for cost, audit, t in options:
                digits = (weight[t] & low) >> 3 * len(audit)
                for i, a in enumerate(audit):
                    digits |= PLACE[a] << room - 3 * (i + 1)
                value = ((weight[t] >> room) + cost << room) | digits
                if best is None or value < best:
                    best = value
            before.append(best)
        weight = before
    out = []
    for state, value in enumerate(weight):
        audit = "".join(LETTERS[(value >> room - 3 * (i + 1)) & 7] for i in range(room // 3)).rstrip()
        rows = iter(letters)
        for a in audit:
            letter = next(rows) if a != "I" else ""
            if a == "K":
                state = NEXT[state, letter.lower()]
            elif a != "D":
                state = FOLLOWS[state]
        out.append((value >> room, audit, state))
    return out


def illegal_pairs(classes: str) -> int:
    return sum(classes[i : i + 2] not in LEGAL for i in range(len(classes) - 1))


def remembered(memo: dict, fn: Callable, *key):
    """fn(*key), kept in a task's `memo`: short conversations repeat each other's letters."""
    if key not in memo:
        if len(memo) >= 20_000:
            memo.clear()
        memo[key] = fn(*key)
    return memo[key]


# --- the tree over chunks ----------------------------------------------------


def join_costs(a: list[int], b: list[int]) -> list[int]:
    return [min(min(a[4 * s + k] + b[4 * k + t] for k in range(4)), NEVER) for s in range(4) for t in range(4)]


def cost_before(behind: list[int], m: list[int]) -> list[int]:
    return [min(min(m[4 * s + t] + behind[t] for t in range(4)), NEVER) for s in range(4)]


def join_maps(a: list[int], b: list[int]) -> list[int]:
    """Exit states of two neighbours and the class of the last row."""
    return [b[a[s]] for s in range(4)] + b[4:]


def state_behind(state: list[int], m: list[int]) -> list[int]:
    return [m[state[0]], m[4]]


def _map(df: DataFrame, fn: Callable[[list[dict], dict], Iterator[tuple]], out: str) -> DataFrame:
    """Rows of `df` with conv_id kept and the columns of the DDL string `out` made by `fn` from its other columns."""
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            at = batch.schema.get_field_index("conv_id")
            rows = list(fn(batch.to_pylist(), memo))
            if rows:
                source = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(at).take(source), *[pa.array(list(c)) for c in list(zip(*rows))[1:]]], names=names)

    names = ["conv_id", *[f.split()[0] for f in out.split(", ")]]
    return df.mapInArrow(run, f"conv_id {kind}, {out}")


def _by_key(df: DataFrame, other: DataFrame) -> DataFrame:
    renamed = other.withColumnsRenamed({"conv_id": "_conv", "key": "_key"})
    return df.join(renamed, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key"))).drop("_conv", "_key")


def carries(elements: DataFrame, join: Callable, move: Callable, first: list[int], backward: bool) -> DataFrame:
    """conv_id, key, carry: what reaches each element (conv_id, key, e) from those before it, or behind it.

    `join(e, e)` combines neighbours, `move(carry, e)` steps over one, `first` enters at the end.
    """

    def joined(rows: list[dict], memo: dict) -> Iterator[tuple]:
        for i, row in enumerate(rows):
            e = row["items"][0]["e"]
            for item in row["items"][1:]:
                e = join(e, item["e"])
            yield i, row["key"], e

    def spread(rows: list[dict], memo: dict) -> Iterator[tuple]:
        for i, row in enumerate(rows):
            carry = row["carry"]
            for item in reversed(row["items"]) if backward else row["items"]:
                yield i, item["key"], carry
                carry = move(carry, item["e"])

    levels = []
    while True:
        groups = elements.groupBy("conv_id", F.shiftright("key", GROUP_BITS).alias("up")).agg(F.array_sort(F.collect_list(F.struct("key", "e"))).alias("items"))
        levels.append(common.stored(groups.withColumnRenamed("up", "key"), "conversation-tree"))
        if levels[-1].groupBy("conv_id").count().where("count > 1").isEmpty():
            break
        elements = _map(levels[-1], joined, "key long, e array<long>")
    carry = levels[-1].select("conv_id", "key", F.array(*[F.lit(v).cast("long") for v in first]).alias("carry"))
    for groups in reversed(levels):
        carry = _map(_by_key(groups, carry), spread, "key long, carry array<long>")
    return carry


# --- conversations -----------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its .!?, 3 repeats it, 4 makes it the user's."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", spaced[2].alias("role"), spaced[3].alias("text"), kind.alias("kind")).where("kind <> 0")
    return marked.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _digested(rows: DataFrame) -> DataFrame:
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select("conv_id", "turn", *spaced).withColumn("digest", F.unhex(F.sha2("text", 256)))


def chunked(rows: DataFrame) -> DataFrame:
    """One row for each chunk: conv_id, key, letters (classes with faults), classes, and counts of the three faults."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    lean = _digested(rows).select(
        "conv_id", "turn", "role", "digest", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("class"), F.monotonically_increasing_id().alias("tie"))
    # equal rows are interchangeable; `tie` lets a range boundary fall between them
    ranged = lean.repartitionByRange(F.col("conv_id").asc_nulls_first(), *_order(), "tie").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order(), "tie")
    placed = common.stored(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()), "conversation-rows")
    first = placed.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "b").when(F.col("new").isNull(), "d").when(F.col("open"), "t").otherwise("")
    marked = placed.select("conv_id", "at", "blank", "open", "class").join(first, "at", "left").select("conv_id", "at", "class", fault.alias("fault"))
    letter = F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper("class")).otherwise(F.col("class"))
    packed = marked.groupBy("conv_id", F.shiftright("at", CHUNK_BITS).alias("key")).agg(
        F.array_sort(F.collect_list(F.struct("at", letter.alias("l"), "class"))).alias("rows"),
        *[F.count_if(F.col("fault") == f).alias(n) for f, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    return packed.select("conv_id", "key", *[F.array_join(F.col("rows")[c], "").alias(n) for c, n in (("l", "letters"), ("class", "classes"))], "blank", "duplicate", "truncated")


def _costs(rows: list[dict], memo: dict) -> Iterator[tuple]:
    for i, row in enumerate(rows):
        yield i, row["key"], remembered(memo, matrix, row["letters"])


def _solved(rows: list[dict], memo: dict) -> Iterator[tuple]:
    for i, row in enumerate(rows):
        found = remembered(memo, solve, row["letters"], tuple(row["carry"]))
        yield i, row["key"], [t for _, _, t in found] + [ord(row["classes"][-1])], [c for c, _, _ in found], [a for _, a, _ in found]


def _alone(rows: list[dict], memo: dict) -> Iterator[tuple]:
    for i, row in enumerate(rows):
        cost, audit, state = remembered(memo, solve, row["letters"], ENDS)[START]
        yield i, row["key"], cost, audit + TAIL[state], illegal_pairs(row["classes"])


def _entered(rows: list[dict], memo: dict) -> Iterator[tuple]:
    """What a chunk of several adds: the first one the whole cost, the last one the closing inserts."""
    for i, row in enumerate(rows):
        state, before = row["carry"]
        closing = TAIL[row["e"][state]] if row["last"] else ""
        classes = (chr(before) if before else "") + row["classes"]
        yield i, row["key"], row["costs"][state] if not before else 0, row["audits"][state] + closing, illegal_pairs(classes)


def edits(rows: DataFrame) -> DataFrame:
    """One row for each conversation of `rows`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    chunks = common.stored(chunked(rows), "conversation-chunks")
    ends = common.stored(chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("end")).where("n > 1"), "conversation-ends")
    named = ends.select(F.col("conv_id").alias("_conv"), "end")
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    out = "key long, cost long, audit string, illegal long"
    parts = _map(chunks.join(named, same, "left_anti"), _alone, out)
    if not ends.isEmpty():
        several = common.stored(chunks.join(named, same).withColumn("last", F.col("key") == F.col("end")).drop("_conv", "end"), "conversation-several")
        behind = carries(_map(several, _costs, "key long, e array<long>"), join_costs, cost_before, list(ENDS), True)
        solved = common.stored(_map(_by_key(several, behind), _solved, "key long, e array<long>, costs array<long>, audits array<string>"), "conversation-solved")
        entry = carries(solved.select("conv_id", "key", "e"), join_maps, state_behind, [START, 0], False)
        parts = parts.unionByName(_map(_by_key(_by_key(several.select("conv_id", "key", "classes", "last"), solved), entry), _entered, out))
    zeros = {n: F.lit(0).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    turns = rows.groupBy("conv_id", "turn").count().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    none = F.lit(None).cast("string").alias("audit"), F.lit(None).cast("long").alias("key")
    pieces = [
        turns.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), *[zeros[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")], *none),
        chunks.select("conv_id", zeros["gaps"], "blank", "duplicate", "truncated", zeros["illegal"], zeros["cost"], *none),
        parts.select("conv_id", *[zeros[n] for n in ("gaps", "blank", "duplicate", "truncated")], "illegal", "cost", "audit", "key"),
    ]
    audit = F.array_join(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "audit"))))["audit"], "").alias("audit")
    return pieces[0].unionByName(pieces[1]).unionByName(pieces[2]).groupBy("conv_id").agg(*[F.sum(n).cast("long").alias(n) for n in zeros], audit)


class Repair:
    """The rows of one repaired conversation, as its rows come in order: (role, text) as bytes."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[bytes, bytes]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, FOLLOWS[self.state]
            yield ROLES[self.state], b""

    def row(self, role: bytes, text: bytes) -> Iterator[tuple[bytes, bytes]]:
        yield from self.inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = NEXT[self.state, role[:1].decode()]
            yield role, text
        elif letter == "R":
            self.state = FOLLOWS[self.state]
            yield ROLES[self.state], text


def _streamed(rows: DataFrame, found: DataFrame, fn: Callable, out: str) -> DataFrame:
    """`fn` over the sorted rows of each conversation, its edits first; conversations are whole in a task and stream through it."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    body = _digested(rows).select("conv_id", F.lit(1).alias("n"), "turn", F.col("role").cast("binary").alias("role"), "digest", F.lit(None).cast("string").alias("audit"), F.col("text").cast("binary").alias("text"))
    head = found.select("conv_id", F.lit(0).alias("n"), *[F.lit(None).cast(body.schema[c].dataType).alias(c) for c in ("turn", "role", "digest")], "audit", F.lit(None).cast("binary").alias("text"))
    return head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "n", *_order()).select("conv_id", "audit", "role", "text").mapInArrow(fn, f"conv_id {kind}, {out}")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, line (from 0), role, text. `found` is `edits(rows)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, conv, line, out, held = None, None, 0, [], 0

        def put(pairs):
            nonlocal line, held
            for role, text in pairs:
                out.append((conv, line, role, text))
                line, held = line + 1, held + len(text)

        def ready(kind):
            nonlocal out, held
            columns = list(zip(*out))
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.binary()).cast(pa.string()) for c in columns[2:]]], names=["conv_id", "line", "role", "text"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for part in common.slices(batch, "text"):
                for row in part.to_pylist():
                    if row["audit"] is not None:
                        if repair:
                            put(repair.inserts())
                        repair, conv, line = Repair(row["audit"]), row["conv_id"], 0
                    else:
                        put(repair.row(row["role"], row["text"]))
                    if held > common.SLICE_BYTES or len(out) > 10_000:
                        yield ready(kind)
        if repair:
            put(repair.inserts())
        if out:
            yield ready(kind)

    return _streamed(rows, found, run, "line long, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the repaired `role:text`, newline-joined. `found` is `edits(rows)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, conv, hashed, lines = None, None, None, 0

        def put(pairs):
            nonlocal lines
            for role, text in pairs:
                hashed.update((b"\n" if lines else b"") + role + b":")
                hashed.update(text)
                lines += 1

        for batch in batches:
            done = []
            for part in common.slices(batch, "text"):
                for row in part.to_pylist():
                    if row["audit"] is None:
                        put(repair.row(row["role"], row["text"]))
                        continue
                    if repair:
                        put(repair.inserts())
                        done.append((conv, hashed.hexdigest()))
                    repair, conv, hashed, lines = Repair(row["audit"]), row["conv_id"], hashlib.sha256(), 0
            kind = batch.schema.field("conv_id").type
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])
        if repair:
            put(repair.inserts())
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([hashed.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return _streamed(rows, found, run, "repaired_sha256 string")


def op13_bigint_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations")
    damaged = damage(rows)
    found = common.stored(edits(damaged), "conversation-edits")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = hashlib.sha256(b"").hexdigest()
    sums = found.select("conv_id", *counts, "audit", F.lit(None).cast("string").alias("repaired_sha256"))
    hashes = digests(damaged, found).select("conv_id", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit(None).cast("string").alias("audit"), "repaired_sha256")
    every = rows.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256"))
    whole = sums.unionByName(hashes).unionByName(every).groupBy("conv_id")
    return whole.agg(*[F.sum(c).alias(c) for c in counts], F.max("audit").alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))
