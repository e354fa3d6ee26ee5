"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag of subwords: itself and its character 3- to 5-grams between "<"
and ">", hashed into BUCKETS embeddings of DIMS numbers. A misspelling never seen
shares most of its n-grams with the word it comes from, so it shares its vectors.
A passage is WINDOW words; a word that one of the WINDOW words before it equals
adds nothing, so runs of one word say no more than the word. A document is the
average of the subword bags of its TOP most toxic passages (missing ones are
empty), and a linear softmax over that average gives its probability. So a few
words in a long text are not averaged away, and every passage is looked at.

Embeddings, softmax weights and biases are learned together by Adam over
cross-entropy. The first epochs draw TOP passages of each document; the later ones
take those that score highest under the present weights.

The fit uses about SAMPLE_ROWS labelled rows, chosen by a hash of doc_id, and at
most SAMPLE_WINDOWS passages of each, evenly spread; both bound what the driver
holds. Scoring covers every passage of every text.
"""

from __future__ import annotations

import pickle
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflux.llm import common
from strataflux.llm.words import folded

SAMPLE_ROWS, SAMPLE_WINDOWS = 5_000, 384
BUCKETS, DIMS = 1 << 16, 8
SIZES = (3, 4, 5)
WINDOW, TOP = 4, 4
EPOCHS, STEPS, BATCH, RATE, DECAY = 20, 260, 256, 0.02, 1e-5  # small samples get more epochs, to make STEPS steps
POSITIVE = 5.0  # weight of a toxic document in the loss: missing one costs more than a false alarm
THRESHOLD = 0.5
CACHE_WORDS = 150_000
SLOTS = 1 << 30

# A-Z to lower case; white space and the signs around words separate, signs used inside disguised words do not.
SIGNS = folded(bytes([*range(0x21), *b"\"'(),./:;<=>?[\\]^`{|}~!", 0x7F]))
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(SIGNS).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every subword of `words`; the numbers ascend."""
    parts = ["<" + w.decode("utf-8", "replace").lower() + ">" for w in words]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    place = (np.arange(len(codes)) - first[owner]).astype(np.uint64)
    whole = np.add.reduceat((codes + np.uint64(1)) * MIX[0] ^ (place + np.uint64(7)) * MIX[1], first) if len(parts) else np.zeros(0, np.uint64)
    owners, hashes = [np.arange(len(parts))], [whole * MIX[1]]
    run = codes.copy()
    for size in range(2, max(SIZES) + 1):
        run = run[:-1] * MIX[0] + codes[size - 1 :]
        if size in SIZES:
            inside = owner[: len(run)] == owner[size - 1 :]
            owners.append(owner[: len(run)][inside])
            hashes.append((run[inside] ^ np.uint64(size)) * MIX[1])
    owners, hashes = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owners, kind="stable")
    hashes ^= hashes >> np.uint64(31)
    return owners[order], ((hashes * MIX[0]) >> shift).astype(np.int64)[order]


def fresh(words: list[bytes]) -> np.ndarray:
    """1 for a word that none of the WINDOW words before it equals, 0 for a repeat: runs of one word say no more than the word."""
    last: dict[bytes, int] = {}
    get, out = last.get, bytearray(len(words))
    for i, w in enumerate(words):
        if i - get(w, -WINDOW) >= WINDOW:
            out[i] = 1
        last[w] = i
    return np.frombuffer(out, np.uint8)


def passages(words: list[bytes], most: int) -> list[bytes]:
    """At most `most` passages, evenly spread, without repeats."""
    begin, new = np.arange(0, max(1, len(words)), WINDOW), fresh(words)
    if len(begin) > most:
        begin = begin[np.linspace(0, len(begin) - 1, most).astype(int)]
    return [b" ".join([words[j] for j in range(i, min(i + WINDOW, len(words))) if new[j]]) for i in begin.tolist()]


def spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place) of every element of segments that start at `begin` and hold `size` places."""
    segment = np.repeat(np.arange(len(size)), size)
    return segment, np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


class Model:
    """Embeddings, weights (DIMS x 2) and biases. As all is linear, `gain` is what a subword adds to the log-odds of its bag."""

    def __init__(self, embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.embeddings, self.weights, self.bias = embeddings, weights, bias

    @property
    def gain(self) -> np.ndarray:
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)

    @property
    def lead(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(texts: list[list[bytes]], labels: np.ndarray) -> Model | None:
    """Learn from documents given as lists of passages, words joined by spaces; None without documents."""
    if not texts:
        return None
    rng = np.random.default_rng(11)
    vocabulary: dict[bytes, int] = {}
    number, lengths = array("i"), []
    for passage in chain.from_iterable(texts):
        words = passage.split()
        lengths.append(len(words))
        number.extend([vocabulary.setdefault(w, len(vocabulary)) for w in words])
    flat, lengths = np.frombuffer(number, np.int32), np.array(lengths)
    buckets, counts = array("H"), []
    names = list(vocabulary)
    for at in range(0, len(names), 5_000):
        owners, found = subwords(names[at : at + 5_000])
        buckets.extend(array("H", found.astype(np.uint16).tobytes()))
        counts.append(np.bincount(owners, minlength=len(names[at : at + 5_000])))
    del vocabulary, names
    buckets, counts = np.frombuffer(buckets, np.uint16), np.concatenate(counts) if counts else np.zeros(0, np.int64)
    edges = np.cumsum(counts) - counts  # where a word's subwords begin
    begins = np.cumsum(lengths) - lengths
    per_doc = np.array([len(doc) for doc in texts])
    first = np.cumsum(per_doc) - per_doc

    e = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIMS, 2)).astype(np.float32)
    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    b = np.array([np.log(1 - rate), np.log(rate)], np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, b)]
    epochs, step = max(EPOCHS, -(-STEPS // -(-len(texts) // BATCH))), 0
    for epoch in range(epochs):
        if epoch < epochs * 3 // 20:
            odds = rng.random(len(lengths))
        else:
            gains = np.add.reduceat((e @ (w[:, 1] - w[:, 0]))[buckets], edges) / counts if len(edges) else np.zeros(0)
            odds = np.diff(np.concatenate([[0.0], np.cumsum(gains[flat])])[np.append(begins, len(flat))])
        doc = np.repeat(np.arange(len(texts)), per_doc)
        ranked = np.lexsort((np.arange(len(odds)), -odds, doc))
        chosen = ranked[np.arange(len(odds)) - first[doc] < TOP]  # the first of equal passages
        sizes = np.minimum(per_doc, TOP)
        offsets = np.cumsum(sizes) - sizes
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            step += 1
            docs = order[at : at + BATCH]
            owner, picked = spread(offsets[docs], sizes[docs])
            picked = chosen[picked]
            rows, words = spread(begins[picked], lengths[picked])
            rows = owner[rows]
            seen, words = np.unique(flat[words], return_inverse=True)
            inner, grams = spread(edges[seen], counts[seen])
            grams = buckets[grams]
            vectors = np.stack([np.bincount(inner, e[grams, d], len(seen)) for d in range(DIMS)], 1) / counts[seen, None]
            mean = np.stack([np.bincount(rows, vectors[words, d], len(docs)) for d in range(DIMS)], 1) / (TOP * WINDOW)
            logits = mean @ w + b
            error = np.exp(logits - logits.max(1, keepdims=True))
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(docs)), labels[docs].astype(int)] -= 1
            error *= np.where(labels[docs] == 1, POSITIVE, 1.0)[:, None] / len(docs)
            pull = (error @ w.T / (TOP * WINDOW))[rows]
            per_word = np.stack([np.bincount(words, pull[:, d], len(seen)) for d in range(DIMS)], 1) / counts[seen, None]
            slope = np.stack([np.bincount(grams, per_word[inner, d], BUCKETS) for d in range(DIMS)], 1)
            for value, g, (m, v) in zip((e, w, b), (slope + DECAY * e, mean.T @ error + DECAY * w, error.sum(0)), state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(e, w, b)


class Gains(dict):
    """word -> the mean gain of its subwords; forgotten when full, as it can be made again."""

    def __init__(self, model: Model):
        super().__init__()
        self.gain = model.gain

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(words)
        for at in range(0, len(new), 20_000):
            group = new[at : at + 20_000]
            owners, buckets = subwords(group)
            means = np.bincount(owners, self.gain[buckets], len(group)) / np.bincount(owners, minlength=len(group))
            self.update(zip(group, means.tolist()))


def probability(model: Model, gains: Gains, words: list[bytes]) -> float:
    """That of the TOP most toxic passages; without words, that of empty ones."""
    best = 0.0
    if words:
        gains.learn(set(words))
        found = np.fromiter(map(gains.__getitem__, words), np.float64, len(words)) * fresh(words)
        sums = np.add.reduceat(found, np.arange(0, len(words), WINDOW))
        best = float(np.partition(sums, -TOP)[-TOP:].sum() if len(sums) > TOP else sums.sum()) / (TOP * WINDOW)
    return float(1 / (1 + np.exp(-np.clip(best + model.lead, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, picked: Column, rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn labels.toxic (0 or 1) from the labelled rows that `picked`, a condition on doc_id, names.

    A doc_id with several labels counts with the highest, one with several texts
    with the text of the least hash. None when there is no labelled row.
    """
    known = labels.where(picked & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if not total:
        return None
    slot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(SLOTS))
    some = known.where(slot < (rows * SLOTS) // total)  # a share of the ids: no sort, no task that sees them all
    texts = docs.select("doc_id", F.col("text").alias("body")).join(F.broadcast(some), "doc_id")  # about `rows` ids
    one = texts.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("body"), F.xxhash64("body"))["body"].alias("text"))

    def make():
        def fn(found: list) -> list:
            out = []
            for text in found:
                out.append(passages(split(text), SAMPLE_WINDOWS))
            return [("passages", pa.array(out, pa.list_(pa.binary())))]

        return fn

    got = sorted(common.map_texts(one, make, "passages array<binary>").collect(), key=lambda r: r["doc_id"])
    return train([[bytes(p) for p in r["passages"]] for r in got], np.array([r["toxic"] for r in got]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every row of `docs`, its text replaced by score and predicted; columns of `docs` with these names give way.

    A null or wordless text has the score of empty passages. Without a model
    every score is 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # BUCKETS x DIMS floats

    def make():
        learned = pickle.loads(sent.value)
        gains = Gains(learned) if learned else None

        def fn(texts: list) -> list:
            found = [probability(learned, gains, split(t)) if learned else 0.0 for t in texts]
            return [("score", pa.array(found, pa.float64()))]

        return fn

    return common.map_texts(docs.drop("score", "predicted"), make, "score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op11_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.read(spark, sf_dir, t) for t in ("documents", "labels"))
    model = fit(docs, labels, ~held_out())
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
