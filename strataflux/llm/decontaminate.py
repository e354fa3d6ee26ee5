"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark.

Both sides become words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.
A window is WINDOW consecutive words of an item, or all of a shorter one. The
automaton runs over word numbers of the benchmark vocabulary (0 for any other
word), so a text is scanned once, word by word, whatever the number of windows.
Offsets of hits are mapped back to the text only for documents that have hits.

The benchmark reaches the tasks in blocks of at most BLOCK_WORDS words, longer
items cut with overlap. One block is one scan. More blocks are one pass each over
the texts: a pass broadcasts its block, writes the hits and drops the block, so
driver and workers hold a bounded number of blocks whatever the benchmark; the
hits of a document are merged afterwards. Nothing is joined but hits by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflux.llm import common
from strataflux.llm.words import ALPHANUMERIC

WINDOW = 10
BLOCK_WORDS = 60_000  # an automaton over 200,000 words took 149 MB; every Python worker builds one of a block
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FIELDS = ("first_word", "last_word", "start", "end")
SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in FIELDS]))
HITS = "n_words long, items array<string>, spans array<struct<first_word:long,last_word:long,start:long,end:long>>"


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALPHANUMERIC).split()


def blocks(benchmark: DataFrame, block_words: int, window: int = WINDOW) -> Iterator[list[tuple[str, list[bytes]]]]:
    """(item_id as text, words) in blocks; the driver holds one block at a time."""
    held, n, most = [], 0, max(block_words, 2 * window)
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        words = split(row[1])
        if not words:
            continue
        for at in range(0, max(1, len(words) - window + 1), most - window + 1):  # pieces share all but one word of a window
            piece = words[at : at + most]
            if held and n + len(piece) > block_words:
                yield held
                held, n = [], 0
            held.append((row[0], piece))
            n += len(piece)
    yield held


class Scanner:
    """The automaton of one block: `find(words)` gives the item numbers and the merged hit runs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        import ahocorasick

        self.items = [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        owners: dict[tuple, list[int]] = {}
        for i, (_, words) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1):
                owner = owners.setdefault(tuple(ids[at : at + size]), [])
                if not owner or owner[-1] != i:
                    owner.append(i)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, owner in owners.items():
            self.automaton.add_word(ids, (len(ids), owner))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def find(self, words: list[bytes]) -> tuple[set[int], list[list[int]]]:
        found: set[int] = set()
        runs: list[list[int]] = []
        if self.empty or not words:
            return found, runs
        get = self.number.get
        for last, (size, owner) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            found.update(owner)
            first = last - size + 1
            while runs and first <= runs[-1][1] + 1:  # ends only grow, so earlier runs are swallowed from the back
                first = min(first, runs.pop()[0])
            runs.append([first, last])
        return found, runs


def places(text: bytes, runs: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """Word runs with their code point offsets in the text itself."""
    bounds = np.asarray([m.span() for m in WORD.finditer(text.lower())], np.int64)
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(a, b, int(lead[bounds[a, 0]]), int(lead[bounds[b, 1]])) for a, b in runs]


def merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every row of `docs`, its text replaced by n_words, items and spans.

    `items` are the distinct item_ids (as text, sorted as strings) with a window
    in the text; `spans` the merged hit runs as word numbers (both inclusive) and
    code point offsets of the text (end exclusive). A null or wordless text has
    none; items without words or with a null text have no window; a null item_id
    is the name "null". An empty benchmark hits nothing.
    """
    parts = blocks(benchmark, block_words, window)
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return _scanned(docs, docs.sparkSession.sparkContext.broadcast(first), window)
    return _merged_passes(docs, chain((first, second), parts), window)


def _scanned(docs: DataFrame, sent: Broadcast, window: int) -> DataFrame:
    def make():
        scanner = Scanner(sent.value, window)

        def find(texts: list) -> list:
            counts, items, spans = [], [], []
            for text in texts:
                words = split(text)
                found, runs = scanner.find(words)
                counts.append(len(words))
                items.append(sorted({str(scanner.items[i]) if scanner.items[i] is not None else "null" for i in found}))
                spans.append([dict(zip(FIELDS, p)) for p in places(text, merged(runs))] if runs else [])
            return [("n_words", pa.array(counts, pa.int64())), ("items", pa.array(items, pa.list_(pa.string()))), ("spans", pa.array(spans, SPANS))]

        return find

    return common.map_texts(docs, make, HITS)


def _merged_passes(docs: DataFrame, parts: Iterator[list[tuple[str, list[bytes]]]], window: int) -> DataFrame:
    """`scan` with one pass for each block of `parts`."""
    context = docs.sparkSession.sparkContext
    kept = [c for c in docs.columns if c != "text"]
    rows = common.stored(docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(F.lit(None).cast("int").alias("0"), *[F.col(c) for c in kept]).alias("row"), "text"), "decontaminate-rows")
    hits = None
    for block in parts:
        sent = context.broadcast(block)
        found = _scanned(rows.select("row_id", "text"), sent, window)
        found = common.stored(found if hits is None else found.where(F.size("spans") > 0), "decontaminate-hits")
        sent.destroy()
        hits = found if hits is None else hits.unionByName(found)
    grouped = hits.groupBy("row_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))

    def join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for found in batch.column(3).to_pylist():
                out: list[dict] = []
                for span in found:  # sorted by first_word
                    if out and span["first_word"] <= out[-1]["last_word"] + 1:
                        if span["last_word"] > out[-1]["last_word"]:
                            out[-1] |= {"last_word": span["last_word"], "end": span["end"]}
                    else:
                        out.append(span)
                spans.append(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, SPANS)], names=batch.schema.names)

    whole = grouped.mapInArrow(join_runs, f"row_id long, {HITS}")
    return rows.select("row_id", "row").join(whole, "row_id").select(*[F.col("row")[c].alias(c) for c in kept], "n_words", "items", "spans")


def digest(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (common.read(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return digest(scan(docs.select("doc_id", "text"), benchmark))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no benchmark window; one pass for each block of the benchmark."""
    context = docs.sparkSession.sparkContext
    parts = blocks(benchmark, block_words, window)
    block = next(parts)
    while True:
        sent, later = context.broadcast(block), next(parts, None)
        left = common.filtered(docs, _without(sent, window))
        if later is None:
            return left
        docs, block = common.stored(left, "decontaminate-left"), later
        sent.destroy()


def _without(sent: Broadcast, window: int):
    def make():
        scanner = Scanner(sent.value, window)
        return lambda texts: [not scanner.find(split(text))[1] for text in texts]

    return make
