"""Operator 10, quality classifier.

Histogram gradient-boosted trees over document statistics. A bounded sample of labelled
rows is turned into statistics by Spark and fitted in the driver; the trees become flat
arrays, and tasks walk all trees over a batch of documents with numpy.

Defined results: a null text counts as empty; an empty text gets the score of its
(all zero) statistics; a repeated row is scored twice alike; a null id is scored and is
not held out; empty tables give empty results. Labels other than 0 and 1 teach nothing,
and without any label every score is one half. Only the id and text columns are read,
so other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from srclens.llm.common import bounded_batches, table

TRAIN_ROWS = 20_000
"""Most labelled rows that a model is fitted on, those with the smallest hash of the id."""
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, LEAST_HESSIAN, RIDGE = 60, 4, 64, 0.15, 2.0, 1.0
N_STATISTICS = 25

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_STOPS = b".,;:!?'\"()-"
_SYMBOLS = bytes(c for c in range(33, 127) if c not in _UPPER + _LOWER + _DIGITS + _STOPS)
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """Numbers about a whole text that do not depend on its language."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words, lines = text.split(), text.split("\n")
    n, size, n_lines = len(words), len(raw), len(lines)
    if not n:
        return [0.0] * N_STATISTICS
    counts = Counter(words)
    pairs = n - 1
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    lengths = np.fromiter(map(len, words), dtype=np.int32, count=n)
    line_sizes = [len(x) for x in lines]
    spoken = [x for x in lines if x.strip()]
    line_counts = Counter(spoken)
    ends = sum(x.rstrip().endswith((".", "!", "?", ":", "…")) for x in spoken)
    return [
        math.log1p(len(text)),
        math.log1p(n),
        math.log1p(n_lines),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths <= 3).mean()),
        float((lengths >= 20).mean()),
        share(_UPPER),
        share(_LOWER),
        share(_DIGITS),
        share(_SPACE),
        share(_STOPS),
        share(_SYMBOLS),
        share(_HIGH),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / max(pairs, 1),
        len(set(zip(words, words[1:]))) / max(pairs, 1),
        text.count("|") / n,
        (text.count(".") + text.count("!") + text.count("?")) / n,
        n / n_lines,
        math.log1p(max(line_sizes)),
        len(line_counts) / max(len(spoken), 1),
        ends / max(len(spoken), 1),
        sum(len(x) for x in spoken if line_counts[x] > 1) / len(text),
    ]


def statistics_matrix(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), N_STATISTICS)


@dataclass
class Forest:
    """Complete trees of equal depth: node ``i`` of a tree has children ``2i+1`` and ``2i+2``."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes; a row goes right when its value is larger
    leaf: np.ndarray  # trees x leaves
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, lim, leaf in zip(self.feature, self.limit, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            while inner and at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > lim[at])
            total += leaf[at - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boost logistic loss; splits are found on histograms of at most ``bins`` bins."""
    rate_one = (y.sum() + 1) / (len(y) + 2)
    prior = math.log(rate_one / (1 - rate_one))
    inner = 2**depth - 1
    empty = Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), prior)
    if not len(y) or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    forest, margin = empty, np.full(len(y), prior)
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.zeros(nodes)
            for j, codes in enumerate(binned):
                key = (at - first) * bins + codes
                g = np.bincount(key, grad, nodes * bins).reshape(nodes, bins).cumsum(1)
                h = np.bincount(key, hess, nodes * bins).reshape(nodes, bins).cumsum(1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
                gain[(h < LEAST_HESSIAN) | (all_h - h < LEAST_HESSIAN)] = 0
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(1)
                top = gain[np.arange(nodes), cut]
                for node in np.flatnonzero(top > best + 1e-12):
                    best[node], feature[first + node], limit[first + node] = top[node], j, edges[j][cut[node]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > limit[at])
        g, h = np.bincount(at - inner, grad, inner + 1), np.bincount(at - inner, hess, inner + 1)
        leaf = -rate * g / (h + RIDGE)
        margin += leaf[at - inner]
        features.append(feature), limits.append(limit), leaves.append(leaf)
    return Forest(np.array(features), np.array(limits), np.array(leaves), prior)


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS) -> Forest:
    """Fit on at most ``most`` labelled documents that are not held out.

    The ids of the sample (a bounded table) are shipped to the documents, so texts are
    not shuffled; only statistics reach the driver, one row for each sampled id.
    """
    bounded_batches(docs.sparkSession)
    sample = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )

    @pandas_udf("array<double>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        .join(F.broadcast(sample), "id")  # at most ``most`` rows
        .select("id", "y", numbers("t").alias("x"))
        .groupBy("id")
        .agg(F.min("x").alias("x"), F.min("y").alias("y"))
        .orderBy("id")
        .toPandas()
    )
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), N_STATISTICS)
    return fit(x, rows["y"].to_numpy(dtype=np.float64))


def scorer(forest: Forest):
    """Column function: text to score."""

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(forest.score(statistics_matrix(texts)))

    return score


def classify(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    bounded_batches(docs.sparkSession)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), scorer(forest)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    bounded_batches(docs.sparkSession)
    return docs.filter(scorer(forest)(F.col(text_col)) >= threshold)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
