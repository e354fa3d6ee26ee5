"""Helpers shared by the corpus operators: reading tables, scratch tables, mapping texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflux.session import scratch_path

SLICE_BYTES = 2 << 20  # texts a function sees at once: memory per task follows this and the longest text


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once below the shared folder and read back: later jobs see the same rows whatever executors are lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col) -> F.Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose `column` (binary) holds about `most` bytes; a longer value stands alone."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        size = size or 0
        if i > first and held + size > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if batch.num_rows > first:
        yield batch.slice(first)


def released() -> None:
    """Drop the token encoder that an earlier operator left in this reused worker."""
    import sys

    vocabulary = sys.modules.get("public_tokenizers")
    if vocabulary is not None and vocabulary.__dict__.pop("encoders", None):
        import gc

        gc.collect()


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], list[pa.Array]]], out: str, text: str = "text") -> DataFrame:
    """Replace column `text` by the columns of the DDL string `out`; all other columns pass through.

    `make()` runs once per task and returns a function from a list of texts
    (UTF-8 bytes, None for null) to one Arrow array per new column.
    """
    kept = [c for c in df.columns if c != text]
    source = df.select(*kept, F.col(text).cast("binary").alias(text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  slices() needs it

        released()
        fn = make()
        for batch in batches:
            for part in slices(batch, text):
                at = part.schema.get_field_index(text)
                arrays = [a for i, a in enumerate(part.columns) if i != at]
                names = [n for i, n in enumerate(part.schema.names) if i != at]
                new = fn(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(arrays + [a for _, a in new], names + [n for n, _ in new])

    return source.mapInArrow(run, f"{fields}, {out}" if fields else out)


def filtered(docs: DataFrame, make: Callable[[], Callable[[list], list[bool]]], text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that `fn` keeps; a text goes to Python once and comes back only where it stays.

    `make()` runs once per task and returns `fn`, from a list of texts (UTF-8
    bytes, None for null) to whether each row stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  slices() needs it

        released()
        fn = make()
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(part.schema.get_field_index(text)).cast(pa.binary())
                yield part.filter(pa.array(fn(texts.to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def text_keys(text: str = "text") -> list[F.Column]:
    """Two 64-bit hashes of a text: with its doc_id they find a row again without carrying the text."""
    body = text_or_empty(text)
    return [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2")]


def keep_one(docs: DataFrame, kept: DataFrame, keys: list[F.Column]) -> DataFrame:
    """Rows of `docs` named by `kept` (doc_id, t1, t2, copies), once each, with the columns of `docs`.

    `keys` gives t1 and t2 of a row of `docs`. Rows that repeat in all three are
    told apart only where `copies` says that there are any.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *keys)
    named = kept.select(F.col("doc_id").alias("k"), F.col("t1").alias("k1"), F.col("t2").alias("k2"), "copies")
    joined = rows.join(named, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")))
    if kept.where("copies > 1").isEmpty():
        return joined.select("row.*")
    once = joined.where("copies = 1").select("row.*")
    return once.unionByName(joined.where("copies > 1").dropDuplicates(["doc_id", "t1", "t2"]).select("row.*"))
