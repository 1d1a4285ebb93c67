"""Quality rules: text statistics, fixed base rules and gradient-boosted trees with monotonic constraints.

Statistics are computed over whole texts. The trees are fitted on the driver on at most ``max_train_rows``
labelled documents (those with the smallest hash of their id, so reruns agree) and flattened into numpy
node arrays; scoring walks all documents of an Arrow batch and all trees level by level.

Defined results: a null or empty text has no words, all statistics 0, and fails the base rules. Repeated rows
are judged alike. An empty table gives an empty result. With no usable labels (none, or one class only) the
trees are empty and every document that passes the base rules is kept. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_long, as_text

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGIT = bytes(range(0x30, 0x3A))
_PUNCTUATION = b"!?.,;:-_'\"()[]{}/\\"

#: Features of the trees, and the sign that the quality score must have in each: -1 never rises with it, 0 free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "digits": 0,
    "punctuation": 0, "marks": -1, "distinct": 0, "line_words": 0, "longest": 0, "high_bytes": 0, "commonest": 0,
}


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """Words that lie in an n-word window which the text holds twice or more, its first place included."""
    if len(words) <= n:
        return 0
    ids: defaultdict = defaultdict(count().__next__)
    a = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    key = a[: len(a) - n + 1]
    for j in range(1, n):
        key = key * len(ids) + a[j : len(a) - n + 1 + j]
        if j + 1 < n and len(ids) > 1_000_000:  # the next product could overflow
            key = np.unique(key, return_inverse=True)[1]
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[at] > 1
    if not twice.any():
        return 0
    inside = np.zeros(len(a), bool)
    for j in range(n):
        inside[j : len(a) - n + 1 + j] |= twice
    return int(inside.sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features of one text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()  # bytes split at ASCII white space, which is what bounds a word here
    n = len(words)
    solid = b.translate(None, SPACE)
    chars = len(solid.translate(None, _CONTINUATION))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    share = lambda which: (len(solid) - len(solid.translate(None, which))) / max(1, len(solid))
    times: defaultdict = defaultdict(int)
    for w in words[:]:
        times[w] += 1
    letters = share(_UPPER + _LOWER)
    features = [
        math.log1p(n), chars / max(1, n), symbols / max(1, chars), dup_lines / max(1, len(lines)), repeats / max(1, n),
        share(_UPPER) / max(letters, 1e-9) if letters else 0.0, share(_DIGIT), share(_PUNCTUATION), share(b"!?"),
        len(times) / max(1, n), math.log1p(n / max(1, len(lines))), math.log1p(max(map(len, words), default=0)),
        share(bytes(range(0x80, 0x100))), max(times.values(), default=0) / max(1, n),
    ]
    return n, chars, symbols, dup_lines, repeats, features


@dataclass
class Trees:
    """Flattened trees of equal depth: node i of a level has the children 2i and 2i+1 of the next."""

    depth: int = 4
    base: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 15), np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 15)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 16)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + (1 << level) - 1
                node = 2 * node + (x[rows, f[at]] > t[at])
            total += leaf[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(
    x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 120, depth: int = 4, rate: float = 0.15, bins: int = 48, penalty: float = 1.0, least: float = 4.0
) -> Trees:
    """Logistic gradient boosting over histograms.

    A split on a feature of sign -1 (+1) is allowed only where the right child's value isn't above (below) the
    left's; the midpoint then bounds the values of both subtrees, so that the whole score is monotonic.
    """
    out = Trees(depth=depth)
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    p = y.mean()
    out.base = float(np.log(p / (1 - p)))
    margin, found = np.full(len(y), out.base), []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        feature, threshold = np.zeros((1 << depth) - 1, np.int32), np.full((1 << depth) - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(1, -np.inf), np.full(1, np.inf)
        for level in range(depth):
            width = 1 << level
            best, cut = np.zeros(width), np.full(width, -1)
            which, mid, up = np.zeros(width, np.int32), np.zeros(width), np.zeros(width, np.int8)
            total_g, total_h = np.bincount(node, grad, width), np.bincount(node, hess, width)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                k = len(e) + 1
                g = np.bincount(node * k + coded[:, j], grad, width * k).reshape(width, k).cumsum(1)[:, :-1]
                h = np.bincount(node * k + coded[:, j], hess, width * k).reshape(width, k).cumsum(1)[:, :-1]
                rg, rh = total_g[:, None] - g, total_h[:, None] - h
                left = np.clip(-g / (h + penalty), low[:, None], high[:, None])
                right = np.clip(-rg / (rh + penalty), low[:, None], high[:, None])
                gain = g**2 / (h + penalty) + rg**2 / (rh + penalty) - (total_g**2 / (total_h + penalty))[:, None]
                gain[(h < least) | (rh < least)] = 0
                if signs[j]:
                    gain[signs[j] * (right - left) < 0] = 0
                at = gain.argmax(1)
                value = gain[np.arange(width), at]
                better = value > best + 1e-9
                best[better], cut[better], which[better] = value[better], at[better], j
                mid[better] = ((left + right) / 2)[np.arange(width), at][better]
                up[better] = signs[j]
            base = width - 1
            for i in range(width):
                if cut[i] >= 0:
                    feature[base + i], threshold[base + i] = which[i], edges[which[i]][cut[i]]
            node = 2 * node + (x[np.arange(len(y)), feature[base + node]] > threshold[base + node])
            lows, highs = np.repeat(low, 2), np.repeat(high, 2)
            for i in range(width):
                if cut[i] >= 0 and up[i]:
                    (lows if up[i] > 0 else highs)[2 * i + 1] = mid[i]
                    (highs if up[i] > 0 else lows)[2 * i] = mid[i]
            low, high = lows, highs
        g, h = np.bincount(node, grad, 1 << depth), np.bincount(node, hess, 1 << depth)
        leaf = rate * np.clip(-g / (h + penalty), low, high)
        margin = margin + leaf[node]
        found.append((feature, threshold, leaf))
    out.feature, out.threshold, out.leaf = (np.stack(a) for a in zip(*found, strict=True))
    return out


SCHEMA = "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"


def measured(docs: DataFrame, keep: str = "") -> DataFrame:
    """The statistics of every document; ``keep`` names one more column to pass through, with its type."""

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [statistics(t) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            if keep:
                out[keep.split()[0]] = pdf[keep.split()[0]].array
            yield out

    columns = [as_text("doc_id"), "text", *([keep.split()[0]] if keep else [])]
    return as_long(docs.select(*columns).mapInPandas(stats, SCHEMA + (f", {keep}" if keep else "")), "doc_id")


def train(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, spared: float = 0.995) -> tuple[Trees, float]:
    """The trees, and the score below which a document is rejected.

    A fifth of the sample is held out; the threshold is the score that ``spared`` of its good documents reach,
    but at most a half, so that clean documents stay.
    """
    sample = (
        labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    )
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("quality", F.col("quality").cast("double")), "quality double").select("doc_id", "features", "quality")
    # one row of each id, however many share it: no more than max_train_rows reach the driver
    pdf = rows.groupBy("doc_id").agg(F.min(F.struct("features", "quality")).alias("r")).select("doc_id", "r.*").toPandas()
    if not len(pdf):
        return Trees(), 0.0
    pdf["key"] = pd.util.hash_array(pdf["doc_id"].to_numpy())
    pdf = pdf.sort_values(["key", "doc_id"], kind="stable")
    x, y = np.array(pdf["features"].tolist()), (pdf["quality"].to_numpy() > 0).astype(float)
    held = np.arange(len(y)) % 5 == 4
    trees = fit(x[~held], y[~held], list(FEATURES.values()))
    good = trees.score(x[held])[y[held] == 1]
    return trees, float(min(0.5, np.quantile(good, 1 - spared))) if len(good) else 0.0


def apply(docs: DataFrame, trees: Trees, threshold: float) -> DataFrame:
    """Verdicts of all documents: the statistics, base_failed, kept and the quality score."""
    model = docs.sparkSession.sparkContext.broadcast(trees)  # as large as the number of trees, whatever the data

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(np.array(features.tolist()).reshape(-1, len(FEATURES))))

    m = measured(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = m.withColumn("quality_score", score("features")).withColumn("base_failed", failed)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("quality_score") >= F.lit(threshold))).alias("kept"), "quality_score",
    )


def filter_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000) -> DataFrame:
    """The documents that pass, with all their columns; the verdict is taken on each row's own text."""
    trees, threshold = train(docs, labels, max_train_rows)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("boolean")
    def passes(text: pd.Series) -> pd.Series:
        rows = [statistics(t) for t in text]
        score = model.value.score(np.array([r[5] for r in rows]).reshape(-1, len(FEATURES)))
        return pd.Series([r[0] >= 50 and 100 * r[4] <= 50 * r[0] and s >= threshold for r, s in zip(rows, score, strict=True)], dtype=bool)

    return docs.filter(passes("text"))
