"""Language identification by nearest centroid.

A text is a vector of hashed letter bigrams and trigrams (lower case, anything
but letters is one separator), weighted log(1 + tf) * idf and normalised. Each
language has up to CENTROIDS centroids from spherical k-means, so that a
language with several kinds of text is not averaged into one. The nearest
centroid by cosine names the language.

A text is rejected when it is too far from every centroid for its extent: the
number of its different n-grams, because a text with few of them lies farther
away, be it short or one word a thousand times over. Training texts and snippets
of them are binned by extent, bins with few rows merged; a bin's bar is MARGIN
times a low quantile of their similarity to their own language, without the low
outliers of each language, and no bar is lower than that of a smaller extent.

The fit uses about SAMPLE_ROWS labelled rows, spread over the languages and
chosen by a hash of doc_id, equal rows once; prediction covers every text whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflux.llm import common

DIMS = 4096
CENTROIDS = 4
SAMPLE_ROWS, PER_LANGUAGE = 8_000, 800
SLOTS = 1 << 30
SNIPPETS = (3, 6, 12, 48, 200)  # code points
MARGIN, QUANTILE = 0.42, 0.01
BIN_ROWS = 100
UNKNOWN = "und"
SEGMENT = 500_000  # code points turned into numbers at once
K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Grams:
    """Counts of hashed n-grams of texts, as rows of a matrix."""

    def __init__(self, dims: int = DIMS):
        self.dims, self.shift = dims, np.uint64(64 - (dims - 1).bit_length())
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def _places(self, codes: np.ndarray) -> np.ndarray:
        letter = self.letter[codes]
        kept = letter.copy()
        kept[1:] |= letter[:-1]  # one separator behind each word
        c = np.where(letter, codes, np.uint32(32))[kept].astype(np.uint64)
        if not letter.any():
            return np.zeros(0, np.intp)
        c = np.concatenate([np.array([32], np.uint64), c])
        two = c[:-1] * K[0] + c[1:] * K[1]
        three = two[:-1] + c[2:] * K[2]
        grams = np.concatenate([two, three])
        grams ^= grams >> np.uint64(29)
        return ((grams * K[0]) >> self.shift).astype(np.intp)

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, text in enumerate(texts):
            for at in range(0, len(text), SEGMENT):
                codes = np.frombuffer(text[at : at + SEGMENT].lower().encode("utf-32-le", "surrogatepass"), "<u4")
                out[i] += np.bincount(self._places(codes), minlength=self.dims)
        return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def spherical(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows; the start is deterministic, each new seed being the row farthest from the former ones."""
    seeds = [rows[(rows @ rows.mean(0)).argmax()]]
    while len(seeds) < min(k, len(rows)):
        seeds.append(rows[(rows @ np.array(seeds).T).max(1).argmin()])
    centroids = np.array(seeds)
    for _ in range(rounds):
        nearest = (rows @ centroids.T).argmax(1)
        for j in range(len(centroids)):
            if (nearest == j).any():
                centroids[j] = rows[nearest == j].mean(0)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
    return centroids


def extent_bin(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum((counts > 0).sum(1), 1)).astype(int)


def bars(own: np.ndarray, langs: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The bar of every bin, from each training row's similarity to its own language."""
    groups, size = [], 0
    for b, n in zip(*np.unique(bins, return_counts=True)):
        if not groups or size >= BIN_ROWS:
            groups.append([])
            size = 0
        groups[-1].append(b)
        size += n
    if len(groups) > 1 and size < BIN_ROWS:
        groups[-2:] = [groups[-2] + groups[-1]]
    out, bar = np.zeros((DIMS - 1).bit_length() + 1), 0.0
    for group in groups:
        clean = []
        for lang in np.unique(langs):
            rows = own[np.isin(bins, group) & (langs == lang)]
            if len(rows):
                low, high = np.quantile(rows, [0.25, 0.75])
                clean.append(rows[rows >= low - 1.5 * (high - low)])
        bar = max(bar, MARGIN * float(np.quantile(np.concatenate(clean), QUANTILE)))
        out[group[0] :] = bar
    return out


def dense(rows: list[bytes]) -> np.ndarray:
    """Matrix of the sparse rows that `fit` collects: places, then counts, as uint16."""
    out = np.zeros((len(rows), DIMS), np.float32)
    for i, raw in enumerate(rows):
        places, values = np.frombuffer(raw, "<u2").reshape(2, -1)
        out[i, places] = values
    return out


class Model:
    def __init__(self, rows: list[tuple[str, bool, bytes]]):
        """`rows`: language, whether a whole text, sparse counts. Snippets only set the bars, a few rows at a time."""
        langs = np.array([lang for lang, whole, _ in rows if whole])
        counts = dense([raw for _, whole, raw in rows if whole])
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        counts = weighted(counts, self.idf)
        parts = [(str(lang), spherical(counts[langs == lang], CENTROIDS)) for lang in np.unique(langs)]
        self.langs = [lang for lang, c in parts for _ in c]
        self.centroids = np.concatenate([c for _, c in parts]).astype(np.float32)
        own, bins = [], []
        for at in range(0, len(rows), 500):
            names = np.array([lang for lang, _, _ in rows[at : at + 500]])
            group = dense([raw for _, _, raw in rows[at : at + 500]])
            bins.append(extent_bin(group))
            near = weighted(group, self.idf) @ self.centroids.T
            own.append(np.where(names[:, None] == np.array(self.langs)[None, :], near, -1).max(1))
        self.bars = bars(np.concatenate(own), np.array([lang for lang, _, _ in rows]), np.concatenate(bins))

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        near = weighted(counts, self.idf) @ self.centroids.T
        best = near.argmax(1)
        score = near.max(1).astype(float).clip(0, 1)
        lettered = counts.any(1)
        names = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        score = np.where(lettered, score, 0.0)
        return names, score, ~lettered | (score < self.bars[extent_bin(counts)])


def _sample(docs: DataFrame, train: Column) -> DataFrame:
    """About as many rows (lang, text) for each language, SAMPLE_ROWS in all: a share of its ids by hash, so no task sees all of a language."""
    rows = docs.select("lang", "text", F.xxhash64("doc_id").alias("h")).where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = common.stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "language-sizes")
    each = max(1, min(PER_LANGUAGE, SAMPLE_ROWS // max(1, sizes.count())))
    share = F.pmod("h", F.lit(SLOTS)) / F.lit(float(SLOTS))
    picked = rows.join(F.broadcast(sizes), "lang").where(share < F.lit(float(each)) / F.col("size"))  # one row per language
    return picked.withColumn("t", F.xxhash64("text")).dropDuplicates(["lang", "h", "t"]).select("lang", "text")


def fit(docs: DataFrame, train: Column) -> Model | None:
    """Learn from the rows of `docs` (doc_id, text, lang) that `train` picks; None when there are none."""

    def make():
        grams = Grams()

        def fn(texts: list) -> list:
            out = []
            for text in texts:
                text = text.decode("utf-8")
                starts = [(len(text) * 7919 // 10007 % max(1, len(text) - n), n) for n in SNIPPETS if len(text) > 2 * n]
                counts = grams.counts([text] + [text[at : at + n] for at, n in starts]).clip(0, 65535)
                out.append([np.concatenate([at := np.flatnonzero(row), row[at]]).astype("<u2").tobytes() for row in counts])
            return [("vectors", pa.array(out, pa.list_(pa.binary())))]

        return fn

    sample = common.map_texts(_sample(docs, train), make, "vectors array<binary>").collect()
    rows = [(row["lang"], i == 0, bytes(raw)) for row in sample for i, raw in enumerate(row["vectors"]) if len(raw)]
    return Model(rows) if any(whole for _, whole, _ in rows) else None


def _judges(docs: DataFrame, model: Model | None):
    """A maker of functions from texts (UTF-8 bytes) to lists of languages, scores and rejections."""
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # classes travel by value; DIMS floats for each of at most CENTROIDS * languages centroids

    def make():
        learned = pickle.loads(sent.value)
        grams = Grams() if learned else None

        def judge(texts: list) -> tuple[list, list, list]:
            names, scores, out = [], [], []
            for at in range(0, len(texts), 200):
                group = [(t or b"").decode("utf-8") for t in texts[at : at + 200]]
                if learned is None:
                    found = [UNKNOWN] * len(group), np.zeros(len(group)), np.ones(len(group), bool)
                else:
                    found = learned.predict(grams.counts(group))
                names += found[0]
                scores += found[1].tolist()
                out += found[2].tolist()
            return names, scores, out

        return judge

    return make


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every row of `docs`, its text replaced by lang_pred, score (cosine, 0 to 1) and rejected.

    A null text, or one without a letter, is "und", score 0, rejected. Of equal
    cosines the first centroid counts, languages in the order of their names.
    Without a model every text is rejected. Columns of `docs` with these names
    give way.
    """
    judges = _judges(docs, model)

    def make():
        judge = judges()

        def fn(texts: list) -> list:
            names, scores, out = judge(texts)
            return [("lang_pred", pa.array(names, pa.string())), ("score", pa.array(scores, pa.float64())), ("rejected", pa.array(out, pa.bool_()))]

        return fn

    return common.map_texts(docs.drop("lang_pred", "score", "rejected"), make, "lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = fit(docs, ~held_out() & F.col("doc_id").isNotNull())
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text is near a language learned from their own labels."""
    model = fit(docs, ~held_out() & F.col("doc_id").isNotNull())
    judges = _judges(docs, model)

    def make():
        judge = judges()
        return lambda texts: [not out for out in judge(texts)[2]]

    return common.filtered(docs, make)
