"""Toxicity: cumulative-link ordinal regression of severity grades on hashed words and word starts.

P(grade >= k) = sigmoid(w.x - theta_k) with one weight vector for all ordered thresholds; the expected severity is the sum
of these probabilities. Labels only say toxic or not, so grades above 0 are derived in training: toxic documents are
divided by how much they hold of the words that tell the classes apart. The words that enter the model are
chosen by Spark from the sample's document counts; the fit uses at most ``training.TRAIN_ROWS`` labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cotejo.llm.textops import mix, slices, small_batches, text_bytes, word_hashes, word_spans
from cotejo.llm.training import TRAIN_ROWS, held_out, labelled
from cotejo.plans.staging import staged

GRADES = 3
#: How far a word's share of toxic documents must exceed chance, in standard errors, to enter the model.
LIFT = 6.0
#: Hash buckets of words, and how many of them the model may use.
BUCKETS = 1 << 20
MODEL_WORDS = 2000

#: Bytes of a word's start that are a feature of their own, so inflected words share one.
START = 4

#: Everything but ASCII letters and bytes of other scripts separates words here.
_BREAK = np.ones(256, bool)
_BREAK[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and row of every feature (each word, and the start of each longer one), and the number of rows."""
    starts, ends, counts = word_spans(data, offsets, _BREAK)
    row = np.repeat(np.arange(len(counts)), counts)
    longer = ends - starts > START
    begun = mix(word_hashes(data, starts[longer], starts[longer] + START))
    found = np.concatenate((word_hashes(data, starts, ends), begun)) % np.uint64(BUCKETS)
    return found.astype(np.int64), np.concatenate((row, row[longer])), len(counts)


@dataclass(frozen=True)
class Ordinal:
    """Words of the model, their shared weights, the ordered thresholds, and the P(grade >= 1) from which on a document is
    rejected."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def sparse(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Row, model word and count of each entry, and the number of rows."""
        place = np.full(BUCKETS, -1, np.int64)
        place[self.words] = np.arange(len(self.words))
        found, row, rows = buckets(data, offsets)
        word = place[found]
        width = max(1, len(self.words))
        cell, n = np.unique(row[word >= 0] * width + word[word >= 0], return_counts=True)
        return cell // width, cell % width, n, rows

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..GRADES, one row for each text."""
        row, word, n, rows = self.sparse(data, offsets)
        margin = np.bincount(row, self.weights[word] * np.log1p(n), rows)
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - margin[:, None], -40, 40)))


def fit(row: np.ndarray, word: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, steps: int = 300,
        ridge: float = 1e-5, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the mean log-likelihood of the grades. The first threshold is free and
    the gaps to the next ones are exponentials, so they stay ordered."""
    n = len(grade)
    weights, free = np.zeros(width), np.append(1.0, np.zeros(GRADES - 1))
    state = [np.zeros(width + GRADES), np.zeros(width + GRADES)]
    onehot = grade[:, None] == np.arange(GRADES + 1)
    for step in range(1, steps + 1 if n else 1):
        theta = np.cumsum(np.append(free[0], np.exp(free[1:])))
        margin = np.bincount(row, weights[word] * value, n)
        over = 1.0 / (1.0 + np.exp(np.clip(theta - margin[:, None], -40, 40)))
        upper = np.column_stack((np.ones(n), over))
        lower = np.column_stack((over, np.zeros(n)))
        likely = np.maximum(((upper - lower) * onehot).sum(1), 1e-9)
        d_upper, d_lower = upper * (1 - upper), lower * (1 - lower)
        to_margin = -((d_upper - d_lower) * onehot).sum(1) / likely / n
        to_theta = np.array([((d_upper[:, k] * onehot[:, k] - d_lower[:, k - 1] * onehot[:, k - 1]) / likely).sum() / n
                             for k in range(1, GRADES + 1)])
        tail = np.cumsum(to_theta[::-1])[::-1]
        slope = np.concatenate((np.bincount(word, to_margin[row] * value, width) + ridge * weights,
                                [tail[0]], tail[1:] * np.exp(free[1:])))
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.999 * state[1] + 0.001 * slope**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        weights, free = weights - move[:width], free - move[width:]
    return weights, np.cumsum(np.append(free[0], np.exp(free[1:])))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Ordinal:
    """Choose the words, derive the grades, fit. Without labelled rows of both classes nothing is toxic."""
    small_batches(docs.sparkSession)
    sample = staged(labelled(docs, labels, label, rows).select("text", "label").repartition(16), "toxicity-sample")

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, row, _ = buckets(*text_bytes(part.column("text")))
                cell = np.unique(row * BUCKETS + found)
                toxic = part.column("label").to_numpy()[cell // BUCKETS]
                yield pa.RecordBatch.from_arrays([pa.array(cell % BUCKETS), pa.array(toxic)], names=["word", "label"])

    totals = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    bad, good = totals[1], totals[0] - totals[1]
    if not bad or not good:
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES, 40.0))
    counted = (sample.mapInArrow(distinct, "word bigint, label int").groupBy("word")
               .agg(F.sum("label").alias("b"), (F.count(F.lit(1)) - F.sum("label")).alias("g")).filter("b + g >= 5"))
    share = (F.col("b") + F.col("g")) / F.lit(float(bad + good))
    spread = F.sqrt(share * (1 - share) * (1.0 / bad + 1.0 / good) + 1e-12)
    lift = (F.col("b") / F.lit(float(bad)) - F.col("g") / F.lit(float(good))) / spread
    chosen = counted.select("word", lift.alias("lift")).orderBy(F.col("lift").desc(), "word").limit(MODEL_WORDS)
    chosen = [(r.word, r["lift"]) for r in chosen.filter(F.col("lift") >= LIFT).collect()]
    model = Ordinal(np.array([w for w, _ in chosen], np.int64), np.zeros(len(chosen)), np.full(GRADES, 40.0))

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, word, n, rows_ = model.sparse(*text_bytes(part.column("text")))
                ends = np.searchsorted(row, np.arange(rows_ + 1))
                packed = np.column_stack((word, n)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"),
                     pa.array([packed[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())],
                    names=["label", "entries"])

    # At most ``rows`` rows of at most MODEL_WORDS entries each.
    got = sorted(map(tuple, sample.mapInArrow(entries, "label int, entries binary").collect()))
    toxic = np.array([r[0] for r in got])
    parts = [np.frombuffer(r[1], np.int32).reshape(-1, 2) for r in got]
    row = np.repeat(np.arange(len(got)), [len(p) for p in parts])
    word, n = np.concatenate(parts).T if len(row) else np.zeros((2, 0), np.int64)
    amount = np.bincount(row, np.log1p(n), len(got))
    grade = np.zeros(len(got), np.int64)
    marked = amount[(toxic == 1) & (amount > 0)]
    if len(marked):
        cuts = np.quantile(marked, np.arange(1, GRADES) / GRADES)
        grade[toxic == 1] = 1 + np.searchsorted(cuts, amount[toxic == 1], "left")
    grade[(toxic == 1) & (grade == 0)] = 1
    weights, thresholds = fit(row, word.astype(np.int64), np.log1p(n), grade, len(chosen))
    margin = np.bincount(row, weights[word] * np.log1p(n), len(got)) if len(row) else np.zeros(len(got))
    p = 1.0 / (1.0 + np.exp(np.clip(thresholds[0] - margin, -40, 40)))
    cuts = np.linspace(0.05, 0.5, 46)
    errors = [int(((p >= c) != (toxic == 1)).sum()) for c in cuts]
    return Ordinal(model.words, weights, thresholds, float(cuts[int(np.argmin(errors))]))


def rate(docs: DataFrame, model: Ordinal, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row with ``score`` (P(grade >= 1)), ``expected_severity`` (0 to ``GRADES``), ``grade`` (rounded)
    and ``predicted`` (1: toxic, from the model's cut on). Null and empty texts have no words, so only the thresholds speak; repeated rows get equal
    grades; an empty table gives an empty one."""
    small_batches(docs.sparkSession)
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_body"):
                p = model.probabilities(*text_bytes(part.column("_body")))
                kept = [part.column(f"c{i}") for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(
                    kept + [pa.array(p[:, 0]), pa.array(p.sum(1))],
                    names=[f"c{i}" for i in range(len(columns))] + ["score", "expected_severity"])

    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").alias("_body"))
    rated = rows.mapInArrow(run, f"{kinds}, score double, expected_severity double")
    return rated.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "score", "expected_severity",
        F.round("expected_severity").cast("int").alias("grade"), (F.col("score") >= model.cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject; null and empty texts stay."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = model.probabilities(*text_bytes(part.column("text")))
                yield part.filter(pa.array(p[:, 0] < model.cut))

    return docs.mapInArrow(run, docs.schema)
