"""Near-duplicates: fast similarity sketching, banding, exact verification.

A document is its set of word shingles. Equal sets form one class; classes are
compared, not copies. A sketch has BANDS * ROWS coordinates filled in rounds
(after Dahlgaard, Knudsen and Thorup): in round i every shingle is hashed to one
coordinate, which keeps its least (round, hash) value; coordinates that are
still empty after as many rounds as coordinates are filled by one more round
each, so every coordinate fills and two sketches agree in a share of coordinates
that concentrates around the similarity. A large set needs one round only.

ROWS coordinates make a band; classes that agree in a band meet in a bucket. A
pair of similarity 0.8 misses all buckets with probability (1 - 0.8^8)^72 < 2e-6.

Links inside a bucket are confirmed on the full shingle sets, without emitting
all pairs: first every class is compared with the least class it meets, then in
rounds a few leaders per bucket are compared with all its members that are not
already in their component, and leave the bucket. A bucket is finished when its
remaining members are one component; leaders per bucket grow sixteenfold a round.
Exact bounds come before comparisons: pairs that share a rare shingle are tested
by that shingle; all others share frequent shingles only, whose number bounds
their similarity, which tells the outliers of a group of copies from its members. So a group of n close copies costs about n comparisons,
and yet every pair that meets in a bucket is compared, ruled out by a bound or
already connected. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflux.llm import common, graph
from strataflux.llm.words import M1, Hashes, SPACED, mixed, shingles

BANDS, ROWS = 72, 8
RARE = 16  # a shingle of at most so many open classes names its pairs itself; more only shift work between two exact ways
LOW = np.uint64((1 << 44) - 1)
S44, S20 = np.uint64(44), np.uint64(20)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _seeds(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * M1)


def sketch(items: np.ndarray, size: int, seeds: np.ndarray | None = None) -> np.ndarray:
    """`size` coordinates of a non-empty set of 64-bit hashes. A value holds its round above 44 bits of hash."""
    seeds = _seeds(2 * size) if seeds is None else seeds
    out = np.full(size, EMPTY)
    n, at = len(items), 0
    while at < size and (at == 0 or (out == EMPTY).any()):
        rounds = min(size - at, max(1, -(-3 * size // n)))
        h = mixed(items[None, :] ^ seeds[at : at + rounds, None])
        place = ((h >> S44) * np.uint64(size)) >> S20
        np.minimum.at(out, place.ravel().astype(np.intp), ((np.arange(at, at + rounds, dtype=np.uint64) << S44)[:, None] | (h & LOW)).ravel())
        at += rounds
    for empty in np.flatnonzero(out == EMPTY):
        out[empty] = (np.uint64(size + empty) << S44) | (mixed(items ^ seeds[size + empty]) & LOW).min()
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in values.reshape(bands, rows).T:
        key = mixed(key * M1 + column)
    return key.view(np.int64)


def shingle_set(text: bytes | None, hashes: Hashes, size: int) -> np.ndarray:
    return shingles(hashes.of((text or b"").translate(SPACED).split()), size)


def sketches(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), n_shingles, h1, h2 (digest of the set), bands (empty without shingles)."""

    def make():
        from xxhash import xxh3_128_digest

        hashes, seeds = Hashes(), _seeds(2 * bands * rows)

        def fn(texts: list) -> list:
            counts, digests, keys = [], [], []
            for text in texts:
                items = shingle_set(text, hashes, size)
                counts.append(len(items))
                digests.append(xxh3_128_digest(items.tobytes()))
                keys.append(band_keys(sketch(items, bands * rows, seeds), bands, rows) if len(items) else np.zeros(0, np.int64))
            two = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            return [("n_shingles", pa.array(counts, pa.int64())), ("h1", pa.array(two[:, 0])), ("h2", pa.array(two[:, 1])), ("bands", pa.ListArray.from_arrays(offsets, flat))]

        return fn

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *common.text_keys(), "text")
    return common.map_texts(source, make, "n_shingles long, h1 long, h2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """`pairs` (a, b) with linked: percent * union <= 100 * intersection of the full shingle sets."""
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    sides = sides.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        last, held = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            linked = []
            for i in range(batch.num_rows):
                if last != a[i]:
                    last, held = a[i], shingle_set(batch.column("text_a")[i].as_py(), hashes, size)
                other = shingle_set(batch.column("text_b")[i].as_py(), hashes, size)
                both = len(np.intersect1d(held, other, assume_unique=True))
                linked.append(100 * both >= percent * (len(held) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return sides.mapInArrow(run, "a long, b long, linked boolean")


def rare_items(nodes: DataFrame, texts: DataFrame, size: int, rare: int = RARE) -> DataFrame:
    """(node, item, holders): the shingles of `nodes` that at most `rare` of them hold."""

    def make():
        hashes = Hashes()

        def fn(found: list) -> list:
            sets = [shingle_set(t, hashes, size).view(np.int64) for t in found]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32))
            return [("items", pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets))))]

        return fn

    items = common.map_texts(texts.join(nodes, "node", "left_semi").select("node", "text"), make, "items array<long>")
    items = common.stored(items.select("node", F.explode("items").alias("item")), "open-items")
    few = items.groupBy("item").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") <= rare)
    return common.stored(items.join(few, "item"), "rare-items")


class _Search:
    """Labels of classes while links are confirmed bucket by bucket."""

    def __init__(self, members: DataFrame, texts: DataFrame, size: int, percent: int):
        self.members, self.texts, self.size, self.percent = members, texts, size, percent
        self.labels = self.tested = None

    def fits(self, most: Column, n: str = "n", m: str = "m") -> Column:
        """Sets of n and m items with at most `most` in common may reach the bar: 100 * most >= percent * (n + m - most)."""
        return (100 + self.percent) * most >= self.percent * (F.col(n) + F.col(m))

    def test(self, pairs: DataFrame) -> bool:
        """Confirm pairs (a, b) that were not tested before, and merge components; False when there was nothing to do."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        result = common.stored(verified(pairs, self.texts, self.size, self.percent), "verified")
        seen = result.select("a", "b")
        self.tested = seen if self.tested is None else self.tested.unionByName(seen)
        links = result.where("linked").select("a", "b")
        if links.isEmpty():
            return False
        if self.labels is None:
            self.labels = graph.components(links)
            return True
        ends = [self.labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}")) for c in "ab"]
        links = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
        merged = common.stored(graph.components(links), "merged")
        step = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
        moved = self.labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        self.labels = common.stored(moved.unionByName(merged.join(self.labels, "node", "left_anti")), "labels")
        return True

    def open(self, members: DataFrame) -> DataFrame:
        """Members of the buckets that still hold two components, with their labels."""
        if self.labels is not None:
            members = members.drop("label").join(self.labels, "node", "left")
            members = members.withColumn("label", F.coalesce("label", "node"))
        else:
            members = members.withColumn("label", F.col("node"))
        mixed = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
        return common.stored(members.join(mixed, "bucket", "left_semi"), "open-buckets")

    def by_rare_items(self, rest: DataFrame) -> DataFrame:
        """Test the pairs that share a rare shingle; give the members that may link with others in their bucket.

        Pairs without a rare shingle in common share frequent ones only, of which
        a class has n less its rare ones. That exact bound takes out of a bucket
        the members that can reach no set as large as its smallest one.
        """
        classes = common.stored(rest.groupBy("node").agg(F.first("n").alias("n"), F.first("label").alias("label")), "open-classes")
        items = rare_items(classes.select("node"), self.texts, self.size)
        counts = items.groupBy("node").agg(F.count(F.when(F.col("holders") == 1, 1)).alias("alone"), F.count(F.lit(1)).alias("rare"))
        known = classes.join(counts, "node", "left").select("node", "n", "label", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"), (F.col("n") - F.coalesce("rare", F.lit(0))).alias("frequent"))
        known = common.stored(known, "open-profiles")
        side = items.where("holders > 1").join(known.where(100 * F.col("shared") >= self.percent * F.col("n")), "node").select("item", "node", "n", "label", "shared")
        other = side.select("item", F.col("node").alias("other"), F.col("n").alias("m"), F.col("label").alias("l"), F.col("shared").alias("o"))
        met = side.join(other, "item").where((F.col("node") < F.col("other")) & (F.col("label") != F.col("l")) & self.fits(F.least("shared", "o")))
        self.test(met.select(F.col("node").alias("a"), F.col("other").alias("b")))
        rest = rest.join(known.where(100 * F.col("frequent") >= self.percent * F.col("n")).select("node", "frequent"), "node")
        smallest = rest.groupBy("bucket").agg(F.min("n").alias("m"))
        return rest.join(smallest, "bucket").where(self.fits(F.col("frequent"))).drop("m")

    def run(self) -> DataFrame | None:
        least = self.members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("lead"))
        met = self.members.join(least, "bucket").select("node", "n", F.col("lead.node").alias("other"), F.col("lead.n").alias("m"))
        met = met.where((F.col("node") != F.col("other")) & self.fits(F.least("n", "m")))
        first = met.groupBy("node").agg(F.min("other").alias("other"))
        self.test(first.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")))
        rest = self.open(self.members)
        if rest.isEmpty():
            return self.labels
        rest = self.open(self.by_rare_items(rest))
        lead = F.struct((F.col("n") - F.col("frequent")).alias("rare"), "node", "n", "label", "frequent")  # few rare shingles: it links with most others
        others = lambda leaders: leaders.select("bucket", F.col("node").alias("other"), F.col("n").alias("m"), F.col("frequent").alias("o"), F.col("label").alias("l"), "rare")
        pair = (F.col("label") != F.col("l")) & self.fits(F.least("frequent", "o"))
        # Once more one comparison for each class, now with the best leader it meets.
        best = others(rest.groupBy("bucket").agg(F.min(lead).alias("lead")).select("bucket", "lead.*"))
        met = rest.join(best, "bucket").where(pair).groupBy("node").agg(F.min(F.struct("rare", "other")).alias("best")).select("node", "best.other")
        self.test(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")))
        rest = self.open(rest)
        # A pair may meet in many buckets. It is made in the first one that `other` leads and `node` has ever been in:
        # where `node` has left a bucket it led there itself, so that the pair was dealt with then.
        at = rest.groupBy("node").agg(F.collect_list("bucket").alias("at"))  # at most one bucket a band
        rest = common.stored(rest.join(at, "node"), "open-buckets")
        once = F.col("bucket") == F.array_min(F.array_intersect("at", "led"))
        slots, turn = 32, 0
        while not rest.isEmpty():
            slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(slots)).alias("slot")
            leaders = common.stored(rest.groupBy("bucket", slot).agg(F.min(lead).alias("lead")).select("bucket", "lead.*"), "leaders")
            led = leaders.groupBy("node").agg(F.collect_list("bucket").alias("led")).withColumnRenamed("node", "other")
            met = rest.join(others(leaders).join(led, "other"), "bucket").where(pair & once)
            self.test(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")))
            rest = self.open(rest.join(leaders.select("bucket", "node"), ["bucket", "node"], "left_anti"))
            slots, turn = slots * 16, turn + 1
        return self.labels


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, t1, t2, n_shingles, component_id, component, kept.

    Words are runs without white space, A-Z lower-cased; the set holds the
    distinct runs of `size` words (the whole text where it has fewer). A text
    without words, null included, has an empty set and is linked with nothing.
    component_id is the smallest doc_id reachable over links, kept says that it
    is the row's own; rows that share a doc_id are kept or dropped together. A
    null doc_id loses to any other. `component` numbers components; it is null
    for empty sets.
    """
    drawn = common.stored(sketches(docs, size, bands, rows), "sketches")
    classes = drawn.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = common.stored(classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "first", "n", "bands"), "classes")
    entries = classes.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("bucket")
    members = common.stored(entries.join(shared, "bucket", "left_semi"), "buckets")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("first.doc_id").alias("k"), F.col("first.t1").alias("k1"), F.col("first.t2").alias("k2"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *common.text_keys(), "text")
    same = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2"))
    texts = common.stored(source.join(wanted, same).select("node", F.col("text").cast("binary").alias("text")), "texts")
    if not drawn.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        texts = common.stored(texts.dropDuplicates(["node"]), "texts")
    labels = _Search(members, texts, size, percent).run()
    if labels is None:
        labels = members.select("node", F.col("node").alias("label")).limit(0)
    named = classes.join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("component"), F.col("first.doc_id").alias("doc_id"))
    named = common.stored(named, "components")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.select("h1", "h2", "component").join(least, "component")
    joined = drawn.select("doc_id", "t1", "t2", "n_shingles", "h1", "h2").join(by_set, ["h1", "h2"], "left")
    smallest = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "t1", "t2", "n_shingles", smallest.alias("component_id"), "component", F.col("doc_id").eqNullSafe(smallest).alias("kept"))


def op10_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(common.read(spark, sf_dir, "documents").select("doc_id", "text"), size=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component and all rows with empty sets, all columns of `docs`."""
    found = common.stored(near_groups(docs, size, percent), "near-groups")
    rows = found.where("component is not null").groupBy("component", "doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("copies"))
    one = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2", "copies")).alias("one")).select("one.doc_id", "one.t1", "one.t2", "one.copies")
    blank = docs.where(~common.text_or_empty("text").rlike(r"[^\x20\x09-\x0D]"))
    return common.keep_one(docs, one, common.text_keys()).unionByName(blank)
