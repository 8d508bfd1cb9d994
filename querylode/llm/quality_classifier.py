"""A quality classifier: histogram gradient-boosted trees over statistics of a text, kept in flat arrays.

Labels are learned from at most ``MAX_TRAINING`` rows, those with the smallest hash of their id among all labelled
rows outside the held-out fold, so the fit is bounded and repeatable. Statistics of the sample are computed by Spark;
quantile bins, gradient histograms and splits are numpy work on the bounded sample. Trees are complete binary trees:
node i has the children 2 i + 1 and 2 i + 2, so a batch walks a tree level by level with one index per row.

Defined cases: null and empty texts have all statistics 0 and get a score like any other; without labels of both
kinds the score is the share of good labels (0.5 without any); rows that repeat get equal scores; labels whose
quality is null are not used; texts of any length count whole; of equally good splits the first feature and bin is
taken; an empty table gives no rows; extra columns stay, except those that the output names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylode.llm import common

# A bound of the classifier's labelled sample.
MAX_TRAINING = 20_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.2
SMOOTHING = 1.0

# Classes of bytes; a byte of no class is "other".
_CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\x0b\x0c\r",
    b".,;:", b"!", b"?", b"|", b"#*$%&", b"<>{}[]()", b"\"'`", b"-_/\\+=~^@", bytes(range(128, 256)),
]
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _i
STATISTICS = len(_CLASSES) + 1 + 8


def statistics(many: list[bytes]) -> np.ndarray:
    """One row of numbers for each text: shares of byte classes, and counts of words and lines."""
    out = np.zeros((len(many), STATISTICS))
    sizes = np.array([len(t) for t in many], dtype=np.int64)
    data = np.frombuffer(b"".join(many), dtype=np.uint8)
    k = len(_CLASSES) + 1
    if len(data):
        slot = np.repeat(np.arange(len(many)) * k, sizes) + _CLASS_OF[data]
        counts = np.bincount(slot, minlength=k * len(many)).reshape(len(many), k)
        out[:, :k] = counts / np.maximum(sizes, 1)[:, None]
        letters = counts[:, 0] + counts[:, 1]
        out[:, k] = counts[:, 0] / np.maximum(letters, 1)
    for i, text in enumerate(many):
        words, lines = text.split(), text.split(b"\n")
        n = len(words)
        if n:
            distinct = set(words)
            out[i, k + 1 :] = (
                np.log1p(n), len(text) / n, len(distinct) / n, max(map(len, distinct)) / len(text),
                1 - len(set(lines)) / len(lines), n / len(lines),
                text.count(words[n // 2]) / n,
            )
    return out


@dataclass
class Trees:
    """``feature`` and ``threshold`` of every inner node, ``value`` of every leaf, one row for each tree."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and len(node) and node[0] < inner:  # every row is on the same level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Newton boosting of the logistic loss with histogram splits."""
    inner = (1 << depth) - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Trees(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n, width = x.shape
    slots = binned + np.arange(width) * BINS
    total = np.full(n, prior)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * BINS) + slots).ravel()
            shape = (count, width, BINS)
            size = count * width * BINS
            g = np.bincount(at, np.repeat(gradient, width), size).reshape(shape).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hessian, width), size).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + SMOOTHING) + (g_all - g) ** 2 / (h_all - h + SMOOTHING) - g_all**2 / (h_all + SMOOTHING)
            gain[(h < 1) | (h_all - h < 1)] = 0  # a leaf needs some weight
            best = gain.reshape(count, -1).argmax(axis=1)
            for j in range(count):
                f, b = divmod(int(best[j]), BINS)
                if gain[j, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + j], threshold[first + j] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + SMOOTHING)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(prior, np.array(features), np.array(thresholds), np.array(values))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING) -> Trees:
    """Fit on (doc_id, label) rows; ``labels`` holds 0 or 1, nulls are left out."""
    sample = (
        labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("label").cast("double").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "__label")
        .limit(max_rows)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_rows numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                x = statistics(common.texts(batch.column("text")))
                columns = [batch.column("doc_id").cast(pa.string()), batch.column("__label"), pa.array(list(x), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "x"])

    rows = chosen.mapInArrow(run, "doc_id string, label double, x array<double>").toArrow().sort_by(
        [("doc_id", "ascending"), ("label", "ascending")]
    )
    if not rows.num_rows:
        return fit(np.zeros((0, STATISTICS)), np.zeros(0))
    return fit(np.array(rows["x"].to_pylist()), rows["label"].to_numpy())


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """Every row with ``score``, the probability of a good text."""
    inputs = docs.drop("score")
    names = inputs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                s = model.scores(statistics(common.texts(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema)
    return inputs.mapInArrow(run, f"{fields}, score double")
