"""Quality classifier: a sparse ensemble of rules (after Friedman and Popescu).

Statistics of each whole text are computed once. Shallow boosted trees are grown
on a labelled sample; every path from a root is a conjunctive rule over the
statistics. A lasso logistic regression gives most rules weight zero. The rest
is compiled into one Spark column expression, so scoring is plain SQL.

The fit uses about SAMPLE_ROWS labelled rows, chosen by a hash of doc_id; their
statistics, a few numbers each, go to the driver. Scoring covers every text whole.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflux.llm import common

SAMPLE_ROWS = 20_000
SLOTS = 1 << 30
TREES, DEPTH, BINS, SHRINK = 40, 3, 32, 0.15
PENALTY, ROUNDS = 0.0015, 300
THRESHOLD = 0.3
STATS = ("chars", "words", "word_length", "upper", "digits", "symbols", "stops", "distinct", "repeats", "top", "line_words", "same_lines", "closed_lines", "small_lines", "lower_lines", "tails")

UPPER, LETTER, DIGIT, STOP, SYMBOL = 1, 2, 3, 4, 5
Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most?, value) and so on


def byte_classes() -> np.ndarray:
    table = np.full(256, SYMBOL, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[ord("A") : ord("Z") + 1] = UPPER
    table[ord("a") : ord("z") + 1] = LETTER
    table[0x80:] = LETTER
    table[ord("0") : ord("9") + 1] = DIGIT
    for c in b".,;:?!'\"()-":
        table[c] = STOP
    return table


def statistics(text: bytes | None, classes: np.ndarray) -> list[float]:
    """The numbers of STATS; all zero for a text without words. Shares are between 0 and 1."""
    words = (text or b"").split()
    if not words:
        return [0.0] * len(STATS)
    n, size = len(words), np.bincount(classes[np.frombuffer(text, np.uint8)], minlength=6)
    shown = max(1, int(size[1:].sum()))
    letters = max(1, int(size[UPPER] + size[LETTER]))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    tails = classes[np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)]
    return [
        float(np.log1p(len(text))), float(np.log1p(n)), shown / n,
        size[UPPER] / letters, size[DIGIT] / shown, size[SYMBOL] / shown, size[STOP] / shown,
        len(seen) / n, sum(map(operator.eq, words, words[1:])) / n, max(seen.values()) / n,
        n / len(lines), 1 - len(set(lines)) / len(lines), sum(x[-1:] in b".!?:" for x in lines) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines), sum(x[:1].islower() for x in lines) / len(lines), float((tails == SYMBOL).mean()),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """Every row of `docs`, its text replaced by one double per name of STATS."""

    def make():
        classes = byte_classes()

        def fn(texts: list) -> list:
            table = np.array([statistics(t, classes) for t in texts], np.float64).reshape(len(texts), len(STATS))
            return [(name, pa.array(table[:, i])) for i, name in enumerate(STATS)]

        return fn

    return common.map_texts(docs, make, ", ".join(f"{s} double" for s in STATS))


def _tree(bins: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, rows: np.ndarray, columns: np.ndarray, depth: int, path: Rule, rules: set[Rule], value: np.ndarray) -> None:
    """Grow one regression tree; its paths go to `rules`, its leaf means to `value`."""
    if path:
        rules.add(tuple(sorted(path)))
    value[rows] = target[rows].mean()
    if depth == 0 or len(rows) < 40:
        return
    best = (1e-9, 0, 0)
    whole, n = target[rows].sum(), len(rows)
    for c in columns:
        if not len(cuts[c]):
            continue
        k = len(cuts[c]) + 1
        left_n = np.cumsum(np.bincount(bins[rows, c], minlength=k))[:-1]
        left = np.cumsum(np.bincount(bins[rows, c], target[rows], minlength=k))[:-1]
        right_n = n - left_n
        fine = (left_n >= 15) & (right_n >= 15)
        gain = np.where(fine, left**2 / np.maximum(left_n, 1) + (whole - left) ** 2 / np.maximum(right_n, 1) - whole**2 / n, 0)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), int(c), at)
    gain, c, at = best
    if gain <= 1e-9:
        return
    for low in (True, False):
        side = rows[(bins[rows, c] <= at) == low]
        _tree(bins, cuts, target, side, columns, depth - 1, (*path, (c, low, float(cuts[c][at]))), rules, value)


def grow(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Rules of boosted trees, each on half of the rows and statistics (seeded draws)."""
    rng = np.random.default_rng(7)
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T)]
    bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)
    rules: set[Rule] = set()
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        columns = np.flatnonzero(rng.random(x.shape[1]) < 0.5)
        if not len(rows) or not len(columns):
            continue
        found: set[Rule] = set()
        _tree(bins, cuts, residual, rows, columns, DEPTH, (), found, np.zeros(len(y)))
        for rule in found:
            if len(rule) == DEPTH:  # step along the leaves, on all rows
                inside = holds(rule, x)
                if inside.any():
                    margin[inside] += SHRINK * residual[inside].mean() / max(1e-3, float((y[inside].mean() * (1 - y[inside].mean())) or 1e-3)) if y[inside].std() else SHRINK * np.sign(residual[inside].mean())
        margin = margin.clip(-8, 8)
        rules |= found
    return sorted(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for c, low, cut in rule:
        inside &= (x[:, c] <= cut) == low
    return inside


def lasso(rules: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """Intercept (not penalised) and weights of a logistic regression with an L1 penalty, by accelerated proximal steps."""
    n, k = rules.shape
    centre = rules.mean(0)
    z = rules - centre
    vector = np.ones(k, np.float32) / np.sqrt(max(k, 1))
    for _ in range(20):
        vector = z.T @ (z @ vector)
        norm = float(np.linalg.norm(vector)) or 1.0
        vector /= norm
    step = 4 / (norm / n + 1)
    w = np.zeros(k)
    b = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-(z @ vw.astype(np.float32) + vb))) - y
        nw = vw - step * (z.T @ error.astype(np.float32)) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * float(error.mean())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return b - float(centre @ w), w


class Ensemble:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.rules, self.weights = [], []
        if not len(y):
            self.intercept = 0.0
        elif y.min() == y.max():
            self.intercept = 4.0 if y[0] else -4.0
        else:
            rules = grow(x, y)
            table = np.stack([holds(r, x) for r in rules], 1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
            self.intercept, weights = lasso(table, y)
            chosen = [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6]
            self.rules, self.weights = [r for r, _ in chosen], [w for _, w in chosen]

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            inside = None
            for c, low, cut in rule:
                test = F.col(STATS[c]) <= F.lit(cut)
                test = test if low else ~test
                inside = test if inside is None else inside & test
            total = total + F.when(inside, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Ensemble:
    """Learn labels.quality (0 or 1) from the labelled rows that `train`, a condition on doc_id, picks.

    A doc_id with several labels counts with the highest, equal texts of one
    doc_id count once. Of equal gains the first statistic and the least cut count.
    """
    known = labels.where(train & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    total = known.count()
    share = F.pmod("h", F.lit(SLOTS)) / F.lit(float(SLOTS))
    picked = known.where(share < F.lit(SAMPLE_ROWS / max(total, 1)))  # a share of the ids: no sort, no task that sees them all
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("t", F.xxhash64("text")).dropDuplicates(["doc_id", "t"])
    got = sorted(with_statistics(rows.select("quality", "h", "text")).collect(), key=lambda r: (r["h"], *[r[s] for s in STATS]))
    x = np.array([[r[s] for s in STATS] for r in got], np.float64).reshape(len(got), len(STATS))
    return Ensemble(x, np.array([r["quality"] for r in got], np.float64))


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """Every row of `docs`, its text replaced by the statistics, score and predicted.

    A null or wordless text has all statistics zero and the score of that point.
    Without labels every score is 0.5.
    """
    return with_statistics(docs).withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.read(spark, sf_dir, t) for t in ("documents", "labels"))
    model = fit(docs, labels, ~held_out() & F.col("doc_id").isNotNull())
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
