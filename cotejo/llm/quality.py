"""Document quality: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes of whole texts, by array operations over a batch. Trees are complete and of one depth, kept
in flat arrays (feature, threshold, leaf), so a batch passes a tree in ``depth`` vectorised steps. The model is fitted on
a bounded sample of labelled rows (``training.TRAIN_ROWS``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cotejo.llm.textops import (
    distinct_per_row, per_row, slices, small_batches, text_bytes, word_hashes, word_spans)
from cotejo.llm.training import TRAIN_ROWS, held_out, labelled

THRESHOLD = 0.3

_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" \t", "line": b"\n", "stop": b".", "comma": b",", "loud": b"!?", "mark": b"*#$%&", "bar": b"|",
    "other": b"\"'()+-/:;<=>@[\\]^_`{}~", "high": bytes(range(0x80, 0x100)),
}
FEATURES = ("log_words", "log_bytes", "word_length", "distinct_words", "distinct_pairs", "same_as_before",
            "words_per_stop", "words_per_line", "longest_word") + tuple(_GROUPS)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; all zero for an empty one."""
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    group = np.zeros(256, np.uint8)
    for k, members in enumerate(_GROUPS.values()):
        group[list(members)] = k + 1
    kinds = group[data]
    shares = [per_row(kinds == k + 1, offsets) for k in range(len(_GROUPS))]
    starts, ends, words = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    bounds = np.append(0, np.cumsum(words))
    n = np.maximum(words, 1)
    inner = np.ones(len(hashes), bool)
    inner[bounds[:-1][words > 0]] = False
    before = np.concatenate((hashes[:1], hashes[:-1]))
    same = per_row(inner & (hashes == before), bounds)
    pair = (hashes * np.uint64(3) + before)[inner]
    longest = np.zeros(len(words))
    if len(starts):
        longest[words > 0] = np.maximum.reduceat(ends - starts, bounds[:-1][words > 0])
    groups = dict(zip(_GROUPS, shares))
    columns = [
        np.log1p(words), np.log1p(size), per_row(ends - starts, bounds) / n,
        distinct_per_row(hashes, words) / n, distinct_per_row(pair, np.maximum(words - 1, 0)) / np.maximum(words - 1, 1),
        same / n, words / (groups["stop"] + groups["loud"] + 1), words / (groups["line"] + 1), longest,
    ] + [s / some for s in shares]
    return np.column_stack(columns).astype(np.float32)


@dataclass(frozen=True)
class Forest:
    """Flat arrays of complete trees: tree t, node i has children 2i + 1 and 2i + 2; its leaves follow the inner nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        depth = (inner + 1).bit_length() - 1
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.threshold[t][node])
            total += self.leaf[t][node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 48, rate: float = 0.15,
        ridge: float = 5.0, least: float = 10.0) -> Forest:
    """Second-order boosting of the log loss on binned features. Without rows or with one class only, the forest gives the
    smoothed share of label 1 for every text."""
    n = len(y)
    base = float(np.log((y.sum() + 1.0) / (n - y.sum() + 1.0)))
    inner = 2**depth - 1
    if n == 0 or y.min() == y.max():
        trees = 0
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if n else []
    binned = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf, np.float32)
    leaf = np.zeros((trees, inner + 1))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        slope, curve = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            first = width - 1
            best = np.full(width, 1e-6)
            split = np.full((width, 2), -1)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                cells = (node - first) * (len(c) + 1) + binned[f]
                g = np.bincount(cells, slope, width * (len(c) + 1)).reshape(width, -1).cumsum(1)
                h = np.bincount(cells, curve, width * (len(c) + 1)).reshape(width, -1).cumsum(1)
                gl, hl, gr, hr = g[:, :-1], h[:, :-1], g[:, -1:] - g[:, :-1], h[:, -1:] - h[:, :-1]
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g[:, -1:]**2 / (h[:, -1:] + ridge)
                gain[(hl < least * 0.05) | (hr < least * 0.05)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                split[better] = np.column_stack((np.full(width, f), top))[better]
            for k in np.flatnonzero(split[:, 0] >= 0):
                feature[t, first + k] = split[k, 0]
                threshold[t, first + k] = cuts[split[k, 0]][split[k, 1]]
            right = x[np.arange(n), feature[t][node]] > threshold[t][node]
            node = 2 * node + 1 + right
        g = np.bincount(node - inner, slope, inner + 1)
        h = np.bincount(node - inner, curve, inner + 1)
        leaf[t] = -rate * g / (h + ridge)
        margin += leaf[t][node - inner]
    return Forest(feature, threshold, leaf, base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Fit on the statistics of at most ``rows`` labelled documents; only those statistics reach the driver."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    sample = labelled(docs, labels, label, rows).select("text", "label").mapInArrow(run, "label int, x binary").collect()
    sample.sort(key=lambda r: (bytes(r.x), r.label))
    x = np.frombuffer(b"".join(bytes(r.x) for r in sample), np.float32).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.label for r in sample], float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row. Null and empty texts have statistics of zero and are scored
    like any other; repeated rows get equal scores; an empty table gives an empty one; other columns are not read."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                scores = forest.score(statistics(*text_bytes(part.column("text"))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(scores)],
                    names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
