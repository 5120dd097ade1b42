"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics are computed for whole texts, a few MB at a time.  The trees are fitted on a
bounded sample of labelled documents (``sample_rows``, the labelled rows first in the order of
a hash of their id), stored as flat arrays of complete binary trees and evaluated for all
documents of a slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.words import NEWLINE, SPACE, Hasher, mix, runs, shingles, text_slices
from trialweave.llm.workers import giving_back

_CLASSES = np.full(256, 6, np.int64)  # other ASCII
_CLASSES[ord("a") : ord("z") + 1] = 0
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("0") : ord("9") + 1] = 2
_CLASSES[np.flatnonzero(SPACE)] = 3
_CLASSES[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASSES[128:] = 5
N_CLASSES = 7


def _per_doc(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document and the count of its most frequent one."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    _, at, count = np.unique(mix(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, doc[at], count)
    return np.bincount(doc[at], minlength=n).astype(float), top


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
    """One row of numbers per document: sizes, character shares, repetition of words and lines."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc_of_byte = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc_of_byte * N_CLASSES + _CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    start, end, doc = runs(data, offsets, SPACE)
    length = (end - start).astype(float)
    words = np.bincount(doc, minlength=n).astype(float)
    hashes = hasher.spans(data, start, end)
    distinct, top = _per_doc(hashes, doc, n)
    three, at = shingles(hashes, doc, 3)
    threes = np.bincount(doc[at], minlength=n).astype(float)
    distinct_threes, top_three = _per_doc(three, doc[at], n)
    line_start, line_end, line_doc = runs(data, offsets, NEWLINE)
    lines = np.bincount(line_doc, minlength=n).astype(float)
    distinct_lines, top_line = _per_doc(hasher.spans(data, line_start, line_end), line_doc, n)
    last = _CLASSES[data[end - 1]] if len(end) else np.zeros(0, np.int64)
    one = np.maximum
    mean = np.bincount(doc, length, n) / one(words, 1)
    square = np.bincount(doc, length * length, n) / one(words, 1)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(words),
            kinds / one(size, 1)[:, None],
            mean,
            np.sqrt(one(square - mean * mean, 0)),
            longest,
            distinct / one(words, 1),
            top / one(words, 1),
            distinct_threes / one(threes, 1),
            top_three / one(threes, 1),
            lines / one(words, 1),
            distinct_lines / one(lines, 1),
            top_line / one(lines, 1),
            np.bincount(doc, last == 6, n) / one(words, 1),
            np.bincount(doc, last == 4, n) / one(words, 1),
            np.bincount(doc, length == 1, n) / one(words, 1),
        ]
    )


@dataclass
class Trees:
    """Complete binary trees: inner node ``k`` has the children ``2k+1`` and ``2k+2``."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, least: int = 10, l2: float = 1.0) -> Trees:
    """Boost trees on the logistic loss with splits at quantile bin edges.

    Without rows the score is 0.5 for every text; with one class it is that class's smoothed
    share.  Equal gains take the first feature and bin.
    """
    n, inner, leaves = len(y), 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(base, feature[:0], threshold[:0], leaf[:0])
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(k)]) + np.arange(k) * bins
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (k * bins) + binned).ravel()
            shape = (width, k, bins)
            sums = [np.bincount(cell, np.repeat(w, k), width * k * bins).reshape(shape).cumsum(2) for w in (grad, hess, np.ones(n))]
            total = [s[:, :, -1:] for s in sums]
            left, right = sums, [a - b for a, b in zip(total, sums, strict=True)]
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(left[2] < least) | (right[2] < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-9 and b < len(edges[j]):
                    feature[t, first + i], threshold[t, first + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        spot = node - inner
        leaf[t] = rate * np.bincount(spot, grad, leaves) / (np.bincount(spot, hess, leaves) + l2)
        raw += leaf[t, spot]
    return Trees(base, feature, threshold, leaf)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample_rows: int = 20_000) -> Trees:
    """Fit on at most ``sample_rows`` labelled documents, the first by a hash of their key.

    ``labels`` holds key and a 0/1 label; rows with a null key or label are ignored, several
    labels of one key count as its largest one.  Only the statistics of the sample reach the
    driver: two dozen numbers per row.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null")
    known = known.groupBy("k").agg(F.max("y").cast("double").alias("y"))
    order = F.md5(F.col("k").cast("string"))
    sample = known.orderBy(order, "k").limit(sample_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(sample), "k")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part, data, offsets in text_slices(batch, "text"):
                x = statistics(data, offsets, hasher)
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part["k"], part["y"], values], ["k", "y", "x"])

    schema = f"k {docs.schema[key].dataType.simpleString()}, y double, x array<double>"
    table = rows.select("k", "y", "text").mapInArrow(giving_back(measure), schema).toArrow().sort_by("k")
    if not len(table):
        return fit_trees(np.zeros((0, 1)), np.zeros(0))
    x = np.array(table["x"].to_pylist())
    return fit_trees(x, table["y"].to_numpy())


def score(docs: DataFrame, model: Trees, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, score)`` for every row; null and empty texts are scored from zero statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part, data, offsets in text_slices(batch, "t"):
                values = model.score(statistics(data, offsets, hasher))
                yield pa.RecordBatch.from_arrays([part["k"], pa.array(values)], [key, "score"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, score double"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(giving_back(run), schema)


def keep(docs: DataFrame, model: Trees, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part, data, offsets in text_slices(batch, text):
                yield part.filter(pa.array(model.score(statistics(data, offsets, hasher)) >= threshold))

    return docs.mapInArrow(giving_back(run), docs.schema)
