"""Exact deduplication by deterministic block naming (after Karp, Miller and Rosenberg).

A normalised text is cut into blocks of BLOCK bytes. The distinct blocks are
sorted and numbered; a number is a block's name. Then adjacent names are paired
and the distinct pairs numbered, and so on until each document has one name.
(depth, name) is equal exactly for equal texts.

Block bytes move once, in the aggregate that finds the distinct ones. Documents
refer to blocks by two 64-bit fingerprints; that aggregate compares the blocks
themselves, and should one fingerprint pair stand for two blocks, the naming is
done again under other seeds, so no name rests on a hash alone. All further
steps move numbers. Copies meet in partial aggregates (a text that makes up a
third of all rows is one row per task), and the joins back are plain equi-joins,
which Spark splits when skewed.

Every level is a written table: names cannot change when executors are lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflux.llm import common

BLOCK = 4096


def normalised(text: str = "text") -> F.Column:
    return F.regexp_replace(common.text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def fingerprints(block: F.Column, seed: int) -> F.Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("f1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("f2"))


def _with(fingerprint, seed: int):
    return lambda piece: fingerprint(piece, seed)  # one parameter: F.transform would fill a second one with the place


def _pieces(block: int) -> F.Column:
    last = F.greatest(F.lit(0), F.floor((F.length("bytes") - 1) / block)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("bytes"), i * block + 1, F.lit(block)))


def _numbered(distinct: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Sort the rows of each partition and number them; written, so that the numbers stand."""
    return common.stored(distinct.select(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), label)


def identities(docs: DataFrame, block: int = BLOCK, fingerprint=fingerprints) -> tuple[DataFrame, DataFrame]:
    """rows (row_id, doc_id, text_sha256) as read and names (row_id, depth, name)."""
    bytes_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().cast("binary").alias("bytes"))
    for seed in range(1_000):
        prints = F.transform(_pieces(block), _with(fingerprint, seed))
        rows = common.stored(bytes_.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.sha2("bytes", 256).alias("text_sha256"), prints.alias("prints")), "rows")
        pieces = bytes_.select(F.explode(_pieces(block)).alias("block")).select(fingerprint(F.col("block"), seed).alias("p"), "block")
        distinct = pieces.groupBy(F.col("p.f1").alias("f1"), F.col("p.f2").alias("f2"), "block").agg(F.count(F.lit(1)).alias("copies"))
        names = _numbered(distinct, ["f1", "f2"], "block-names")
        if names.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
    symbols = rows.select("row_id", F.size("prints").alias("n"), F.posexplode("prints").alias("place", "p")).select("row_id", "n", F.col("place").cast("long").alias("place"), F.col("p.f1").alias("f1"), F.col("p.f2").alias("f2"))
    symbols = common.stored(symbols.join(names, ["f1", "f2"]).select("row_id", "n", "place", "name"), "symbols")
    depth = 0
    done = []
    while True:
        done.append(symbols.where("n = 1").select("row_id", F.lit(depth).alias("depth"), "name"))
        symbols = symbols.where("n > 1")
        if symbols.isEmpty():
            break
        depth += 1
        even = F.col("place") % 2 == 0
        pairs = common.stored(symbols.groupBy("row_id", "n", F.shiftright("place", 1).alias("half")).agg(F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right")), "pairs")
        names = _numbered(pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("copies")), ["left", "right"], "pair-names")
        symbols = common.stored(pairs.join(names, ["left", "right"]).select("row_id", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("place"), "name"), "symbols")
    named = done[0]
    for more in done[1:]:
        named = named.unionByName(more)
    return rows.select("row_id", "doc_id", "text_sha256"), named


def groups(docs: DataFrame, block: int = BLOCK, fingerprint=fingerprints) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one
    space; null counts as empty, and all empty texts are equal. The smallest
    doc_id of a group stays (a null one last); of rows that repeat it, one.
    """
    rows, names = identities(docs, block, fingerprint)
    ident = common.stored(rows.join(names, "row_id"), "identities")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    whole = ident.groupBy("depth", "name").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return ident.join(whole, ["depth", "name"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256")


def op9_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.read(spark, sf_dir, "documents").select("doc_id", "text"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all columns."""
    found = common.stored(groups(docs), "exact-groups")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", F.col("text_sha256").alias("t1")).agg(F.count(F.lit(1)).alias("copies"))
    return common.keep_one(docs, kept.withColumn("t2", F.lit(0)), [F.sha2(normalised(), 256).alias("t1"), F.lit(0).alias("t2")])
