"""Phrase collocation mining by SON partitioning.

Per language, phrases of 2 to SIZE words with at least SUPPORT occurrences are
scored against their parts. Texts (A-Z lower-cased) are split at `[.,;:!?\\n-\\r]`
into pieces and those at spaces and tabs into words; a phrase stays in one piece.

Phase 1 cuts the corpus into SHARDS shards, by the file blocks rows are read from,
and mines each shard completely, level by level, at a support lowered in
proportion to its share of the language's words: a phrase that is frequent in the
whole must reach its proportional support in some shard. The number of shards is
fixed, so the lowered support does not sink as the corpus grows; a shard spans many
tasks, and its counts are summed by a shuffle of partial sums. At each level only
phrases whose parts are candidates are counted. The union of the locally frequent
phrases, less those whose counts in all shards add up to less than the support, is
one bit set of BITS bits over their hashes for a level: its size is fixed, and a
clash only lets a needless candidate through.

Phase 2 counts every candidate of the union over the whole corpus, by its text and
exactly, and drops what is below the support.

Texts are read in segments with the words that a phrase may begin in, so memory
follows neither the longest text nor a task's share; a task's partial counts are
sent on when HELD of them have gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflux.llm import common
from strataflux.llm.words import Hashes, folded, mixed

SIZE, SUPPORT, TOP, COVER = 5, 100, 2_000, 100
LEVELS = ((2,), (3,), (4, 5))  # sizes counted in one reading; few phrases are left at the last
SHARDS = 8
BITS = 1 << 26
HELD = 2_000_000
CACHE_WORDS = 400_000
SLICE_BYTES = 8 << 20  # of texts, whose words are made a run at a time
SEGMENT = 1 << 20  # bytes of a text looked at at once
PACKS = 256  # rows in which a task sends its counts of a language
SLOTS = 64  # the best of a language are the best of its slots' best
NO_LANG = "und"

# No UTF-8 text holds the byte 0xFF: it stands for the end of a piece. A tab is a space, all other bytes are words.
PIECES = bytearray(folded(b"\t"))
for _i in b".,;:!?\n\x0b\x0c\r":
    PIECES[_i] = 0xFF
PIECES = bytes(PIECES)
END = b"\xff"
M = np.uint64(0xC4CEB9FE1A85EC53)


def segments(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of a text with END between pieces, a segment at a time; words are whole."""
    text = text or b""
    at = 0
    while at < len(text):
        stop = at + SEGMENT
        if stop < len(text):
            found = max(text.rfind(b" ", at, stop), text.rfind(b"\n", at, stop), text.rfind(b".", at, stop))
            if found < at:  # one word of more than a segment
                ends = [i for i in (text.find(s, stop) for s in (b" ", b"\n", b".")) if i >= 0]
                found = min(ends, default=len(text) - 1)
            stop = found + 1
        yield text[at:stop].translate(PIECES).replace(END, b" \xff ").split()  # of white space only the space is left
        at = stop


def runs(texts: list[bytes | None], lead: int) -> Iterator[tuple[list[bytes], int]]:
    """Word lists of about SEGMENT / 6 words from several texts, END before each text; a list begins with the last `lead` words of the one before, and tells how many."""
    held, size, kept = [], 0, 0
    for text in texts:
        held.append(END)
        for words in segments(text):
            held += words
            size += 6 * len(words)
            if size > SEGMENT:
                yield held, kept
                held, size = held[max(0, len(held) - lead) :], 0
                kept = len(held)
    if len(held) > kept:
        yield held, kept


class Rolling:
    """Hashes of the word runs of every size that `words` begin: `upto(k)[i]` covers words i .. i + k - 1."""

    def __init__(self, words: list[bytes], lang: np.uint64, hashes: Hashes):
        self.words = hashes.of(words)
        self.open = self.words != np.uint64(hashes[END])
        self.sizes = {1: mixed(self.words ^ lang)}
        self.inside = {1: self.open}

    def upto(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, whether the run lies in one piece)"""
        for size in range(max(self.sizes) + 1, k + 1):
            before, inside = self.sizes[size - 1], self.inside[size - 1]
            n = max(0, len(before) - 1)
            self.sizes[size] = mixed(before[:n] * M + self.words[size - 1 : size - 1 + n])
            self.inside[size] = inside[:n] & self.open[size - 1 : size - 1 + n]
        return self.sizes[k], self.inside[k]


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(BITS - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Sums:
    """(key, n) arrays of one language, added up when many have gathered."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([c for _, c in self.parts]), len(keys)).astype(np.int64)
        self.parts, self.size = [(keys, counts)], len(keys)
        return keys, counts


def _tokens(docs: DataFrame) -> DataFrame:
    """lang, shard, text of every row; a shard is a set of the file blocks that rows are read from."""
    shard = F.pmod(F.xxhash64(F.input_file_name(), F.input_file_block_start()), F.lit(SHARDS)).cast("int")
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), shard.alias("shard"), F.col("text").cast("binary").alias("text"))


def _counted(docs: DataFrame, make: Callable[[], Callable], out: str) -> DataFrame:
    """Rows (lang, shard, ...) from `fn(lang, shard, texts)`, which yields batches at times and with None at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  slices() needs it

        fn = make()
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                groups: dict[tuple, list] = {}
                for lang, shard, text in zip(*[part.column(i).to_pylist() for i in range(3)]):
                    groups.setdefault((lang, shard), []).append(text)
                for (lang, shard), texts in groups.items():
                    yield from fn(lang, shard, texts)
        yield from fn(None, None, None)

    return _tokens(docs).mapInArrow(run, f"lang string, shard int, {out}")


def _seed(lang: str, hashes: Hashes) -> np.uint64:
    return np.uint64(hashes.digest(lang.encode()))


def words(docs: DataFrame) -> DataFrame:
    """lang, shard, word, key, n: all words of each shard, counted."""

    def make():
        from collections import Counter

        hashes, held = Hashes(CACHE_WORDS), {}

        def flush():
            for (lang, shard), counts in held.items():
                found = list(counts)
                for at in range(0, len(found), 50_000):
                    group = found[at : at + 50_000]
                    keys = mixed(hashes.of(group) ^ _seed(lang, hashes)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(group)), pa.array([shard] * len(group), pa.int32()), pa.array(group, pa.binary()), pa.array(keys), pa.array([counts[w] for w in group], pa.int64())],
                        names=["lang", "shard", "word", "key", "n"])
            held.clear()

        def fn(lang, shard, texts):
            if texts is None:
                yield from flush()
                return
            counts = held.setdefault((lang, shard), Counter())
            for run, _ in runs(texts, 0):
                counts.update(run)
            del counts[END]
            if sum(map(len, held.values())) > HELD // 8:
                yield from flush()

        return fn

    found = _counted(docs, make, "word binary, key long, n long")
    return found.groupBy("lang", "shard", "word", "key").agg(F.sum("n").alias("n")).withColumn("word", F.col("word").cast("string"))


def level(docs: DataFrame, sizes: tuple[int, ...], bits) -> DataFrame:
    """lang, shard, key, n of the phrases of `sizes` words whose parts of min(sizes) - 1 words are all in `bits`; a task's sums."""
    least = min(sizes) - 1

    def make():
        hashes, held, known = Hashes(CACHE_WORDS), {}, np.frombuffer(bits.value, np.uint8)

        def flush():
            for (lang, shard), sums in held.items():
                keys, counts = sums.whole() if sums.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                for at in range(0, len(keys), 100_000):
                    part = keys[at : at + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([shard] * len(part), pa.int32()), pa.array(part), pa.array(counts[at : at + 100_000])], names=["lang", "shard", "key", "n"])
            held.clear()

        def fn(lang, shard, texts):
            if texts is None:
                yield from flush()
                return
            sums = held.setdefault((lang, shard), Sums())
            for run, lead in runs(texts, max(sizes) - 1):
                rolling = Rolling(run, _seed(lang, hashes), hashes)
                parts, inside = rolling.upto(least)
                member = inside & has(known, parts)
                for size in range(least + 1, max(sizes) + 1):
                    member = member[:-1] & member[1:]  # all parts of a phrase of `size` words
                    if size in sizes:
                        keys, inside = rolling.upto(size)
                        new = max(0, lead - size + 1)  # a phrase that lies in the lead was counted before
                        keys = keys[new:][(inside & member)[new:]]
                        if len(keys):
                            sums.add(*np.unique(keys, return_counts=True))
            if sum(s.size for s in held.values()) > HELD:
                for s in held.values():
                    if s.parts:
                        s.whole()
                if sum(s.size for s in held.values()) > HELD // 2:
                    yield from flush()

        return fn

    return _counted(docs, make, "key long, n long")


def candidates(docs: DataFrame, bits: dict) -> DataFrame:
    """lang, phrase, size, a: all occurrences of the phrases of 2 words or more whose hash is in `bits[size]`, by their text."""

    def make():
        hashes, held, frequent = Hashes(CACHE_WORDS), {}, {k: np.frombuffer(b.value, np.uint8) for k, b in bits.items()}

        def flush():
            for (lang, shard), counts in held.items():
                slots: dict[int, list[bytes]] = {}
                for phrase in counts:
                    slots.setdefault(crc32(phrase) % PACKS, []).append(phrase)
                for slot, group in slots.items():
                    yield _pack(lang, shard, slot, group, [counts[p] for p in group])
            held.clear()

        def fn(lang, shard, texts):
            if texts is None:
                yield from flush()
                return
            counts = held.setdefault((lang, 0), {})
            for run, lead in runs(texts, SIZE - 1):
                rolling = Rolling(run, _seed(lang, hashes), hashes)
                number = {w: i for i, w in enumerate(set(run))}
                name = np.fromiter(map(number.__getitem__, run), np.int64, len(run))
                ids, at = name, np.arange(len(name))
                for size in sorted(frequent):
                    keys, inside = rolling.upto(size)
                    member = np.zeros(len(ids), bool)
                    member[: len(keys)] = inside & has(frequent[size], keys)
                    at, name = at[member[at]], name[member[at]]
                    if not len(at):
                        break
                    # exact: a phrase is named by the name of its first words, candidates too, and its last word
                    _, first, name = np.unique(name * len(number) + ids[at + size - 1], return_index=True, return_inverse=True)
                    for p, n in zip(at[first].tolist(), np.bincount(name[at + size > lead], minlength=len(first)).tolist()):
                        if n:
                            phrase = b" ".join(run[p : p + size])
                            counts[phrase] = counts.get(phrase, 0) + n
            if sum(map(len, held.values())) > HELD // 8:
                yield from flush()

        return fn

    packs = _counted(docs, make, "slot int, phrases array<binary>, counts array<long>")
    dealt = packs.repartition("lang", "slot").sortWithinPartitions("lang", "slot")
    found = dealt.select("lang", "slot", "phrases", "counts").mapInArrow(_summed, "lang string, phrase binary, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).withColumn("phrase", F.col("phrase").cast("string"))


def _pack(lang: str, shard: int, slot: int, phrases: list[bytes], counts: list[int]) -> pa.RecordBatch:
    """One row for all counts of a task in a slot: far fewer rows to shuffle than one a phrase."""
    return pa.RecordBatch.from_arrays(
        [pa.array([lang]), pa.array([shard], pa.int32()), pa.array([slot], pa.int32()), pa.array([phrases], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))],
        names=["lang", "shard", "slot", "phrases", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a slot's phrases; rows come sorted by slot, so one slot is held at a time, and sent on early when it is large."""
    key, held = None, {}

    def ready():
        found = list(held)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found)), pa.array(found, pa.binary()), pa.array(list(held.values()), pa.int64())], names=["lang", "phrase", "n"])

    for batch in batches:
        for i in range(batch.num_rows):
            lang, slot, phrases, counts = (c[i].as_py() for c in batch.columns)
            if held and ((lang, slot) != key or len(held) > HELD // 8):
                yield ready()
                held = {}
            key = (lang, slot)
            for phrase, n in zip(phrases, counts):
                held[phrase] = held.get(phrase, 0) + n
    if held:
        yield ready()


def bitset(keys: DataFrame) -> bytes:
    """BITS bits, one set for each key; the driver gets at most BITS / 64 words."""
    slot = F.col("key").bitwiseAND(F.lit(BITS - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    found = keys.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.astype("<i8").tobytes()


def frequent(docs: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of every phrase of 1 to SIZE words with a >= `support`, and (lang, n) of all words."""
    context = docs.sparkSession.sparkContext
    every = common.stored(words(docs), "phrase-words")
    totals = common.stored(every.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    share = every.groupBy("lang", "shard").agg(F.sum("n").alias("part")).join(totals, "lang")
    local = common.stored(share.select("lang", "shard", F.expr(f"({support} * part + n - 1) div n").alias("least")), "phrase-supports")

    def union(counts: DataFrame) -> bytes:
        """Keys that are frequent in a shard and, as all shards counted them, in the whole."""
        dealt = counts.repartition("lang", "key")  # both sums below reuse this partitioning
        summed = dealt.groupBy("lang", "shard", "key").agg(F.sum("n").alias("n")).join(F.broadcast(local), ["lang", "shard"])  # languages x SHARDS rows
        return bitset(summed.groupBy("lang", "key").agg(F.sum("n").alias("n"), F.max(F.col("n") >= F.col("least")).alias("mined")).where(F.col("mined") & (F.col("n") >= support)))

    bits, last = {}, union(every)
    for sizes in LEVELS:
        last = union(level(docs, sizes, context.broadcast(last)))
        if not any(last):
            break
        bits |= dict.fromkeys(sizes, context.broadcast(last))
    singles = every.groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("a"))
    found = singles.unionByName(candidates(docs, bits)) if bits else singles
    sized = found.where(F.col("a") >= support).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "a")
    return common.stored(sized, "phrases"), totals


def _piece(first, count) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, count), " ")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language.

    A candidate is cut after its first k words into parts of l and r occurrences;
    of the scores floor(1000 * a * n / (l * r)) the lowest counts (the least k of
    equal ones). A candidate inside a longer one with 100 * f(longer) >= cover * a
    is dropped; counts fall with length, so one word more is enough to look at.
    Order: score, then a, descending, then the phrase by bytes. Null lang is
    "und"; a null or empty text has no words. Repeated rows count each time. Other
    columns than lang and text are ignored.
    """
    found, totals = frequent(docs, support)
    long = found.where("size >= 2")
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = long.select("lang", "phrase", "size", "a", k).select("lang", "phrase", "a", "k", _piece(F.lit(1), F.col("k")).alias("left"), _piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    parts = found.where(f"size < {SIZE}")
    scored = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    scored = scored.join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]).join(totals, "lang")
    exact = F.expr("(1000 * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("best"))
    longer = long.where("size >= 3").select("lang", F.explode(F.array(_piece(F.lit(1), F.col("size") - 1), _piece(F.lit(2), F.col("size") - 1))).alias("phrase"), F.col("a").alias("around"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = best.join(covered, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("around") < F.lit(cover) * F.col("a"), F.lit(True)))
    rows = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    slot = F.pmod(F.xxhash64("phrase"), F.lit(SLOTS))
    some = rows.withColumn("slot", slot).withColumn("i", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*order))).where(F.col("i") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.read(spark, sf_dir, "documents"))
