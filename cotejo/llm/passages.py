"""Substring dedup by sliding sentence spans.

A sentence ends with a word that ends in ``.``, ``!`` or ``?``, or at a line break. Spans are all runs of ``SENTENCES``
sentences, however short, and single sentences of ``LONG_WORDS`` words; so a repeated passage is covered to its last
sentence. The shorter rule takes for each sentence the shortest run from it on that has at least ``SENTENCES`` sentences and
``WORDS`` words, or ``LONG_WORDS`` words however few its sentences. Spans meet in Spark by a 128-bit hash of their words;
sentences in any occurrence but the first are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cotejo.llm.textops import mix, slices, small_batches, text_bytes, word_hashes, word_spans
from cotejo.plans.staging import staged

SENTENCES = 2
WORDS = 20
LONG_WORDS = 40

_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BACK = np.array([pow(int(m), -1, 2**64) for m in _STEP], np.uint64)


def sentence_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For a batch of texts: word starts, word ends, index of each sentence's first word, sentences of each row."""
    starts, ends, words = word_spans(data, offsets)
    if not len(starts):
        return starts, ends, np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    lines = np.append(0, np.cumsum(data == 0x0A))
    closed = _STOPS[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    opens = np.append(True, closed)
    row_first = np.append(0, np.cumsum(words))
    opens[row_first[:-1][words > 0]] = True
    first = np.flatnonzero(opens)
    return starts, ends, first, np.diff(np.searchsorted(first, row_first))


def sentence_spans(data: np.ndarray, offsets: np.ndarray, every_run: bool = False) -> tuple[np.ndarray, ...]:
    """Row, sentence (within its row), length in sentences and two hashes of every span."""
    starts, ends, first, sentences = sentence_starts(data, offsets)
    if not len(first):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    hashes = word_hashes(data, starts, ends)
    word_bounds = np.append(first, len(starts))
    row_end = np.repeat(np.cumsum(sentences), sentences)
    at = np.arange(len(first))
    if every_run:
        runs, long = np.flatnonzero(at + SENTENCES <= row_end), np.flatnonzero(np.diff(word_bounds) >= LONG_WORDS)
        whole, stop = np.append(runs, long), np.append(runs + SENTENCES, long + 1)
    else:
        usual = np.maximum(at + SENTENCES, np.searchsorted(word_bounds, word_bounds[:-1] + WORDS))
        stop = np.minimum(usual, np.searchsorted(word_bounds, word_bounds[:-1] + LONG_WORDS))
        whole = np.flatnonzero(stop <= row_end)
        stop = stop[whole]
    low, high = word_bounds[whole], word_bounds[stop]
    values = []
    for step, back in zip(_STEP, _BACK):
        forward, backward = (np.cumprod(np.append(np.uint64(1), np.full(len(hashes), m, np.uint64))) for m in (step, back))
        sums = np.append(np.uint64(0), np.cumsum(hashes * forward[:-1]))
        values.append(mix((sums[high] - sums[low]) * backward[low] + (high - low).astype(np.uint64)).view(np.int64))
    row = np.repeat(np.arange(len(sentences)), sentences)[whole]
    within = whole - (np.cumsum(sentences) - sentences)[row]
    return row, within, stop - whole, values[0], values[1]


def _spans(texts: DataFrame, every_run: bool) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, within, n, one, two = sentence_spans(*text_bytes(part.column("text")), every_run)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("text_hash").take(at), pa.array(within, pa.int32()),
                     pa.array(n, pa.int32()), pa.array(one), pa.array(two)],
                    names=["doc_id", "text_hash", "at", "n", "one", "two"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, text_hash bigint, at int, n int, one bigint, two bigint")


def dedup_sentences(docs: DataFrame, keep_text: bool = False, every_run: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_sentences, n_removed`` (sentences), ``removed_bytes``, ``kept_sha256``
    and, if asked, ``kept``. ``every_run`` takes all runs as spans; without it the shorter rule holds, which leaves the last
    sentences of a repeated passage and repeated runs of under ``WORDS`` words.

    The first occurrence of a span is the one with the smallest doc_id (null last), then the smaller text digest, then the
    earlier place. A removed sentence takes the white space behind it along. Null and empty texts, and texts too short
    for a span, stay as they are; rows repeating both id and text are one occurrence. An empty table gives an empty one;
    other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text_hash", "text")
    spans = staged(_spans(texts, every_run), "spans")
    shared = spans.groupBy("one", "two").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    met = staged(spans.join(shared, ["one", "two"]), "spans-met")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "at")
    low = met.groupBy("one", "two").agg(F.min(place).alias("low"))
    later = met.join(low, ["one", "two"]).filter(place != F.col("low"))
    cuts = later.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.collect_set(F.struct("at", "n")).alias("cuts"))
    joined = texts.join(cuts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                starts, _, first, sentences = sentence_starts(data, offsets)
                ends = np.cumsum(sentences)
                removed, out, digests, kept = [], [], [], []
                for i, cut in enumerate(part.column("cuts").to_pylist()):
                    raw = data[offsets[i]:offsets[i + 1]]
                    n = int(sentences[i])
                    gone = np.zeros(n, bool)
                    for c in cut or ():
                        gone[c["at"]:c["at"] + c["n"]] = True
                    keep = np.ones(len(raw), bool)
                    if gone.any():
                        bounds = np.append(starts[first[ends[i] - n:ends[i]]] - offsets[i], len(raw))
                        for k in np.flatnonzero(gone):
                            keep[bounds[k]:bounds[k + 1]] = False
                    left = raw[keep].tobytes()
                    removed.append(int(gone.sum()))
                    out.append(len(raw) - len(left))
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode() if keep_text else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(sentences, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(out, pa.int64()), pa.array(digests, pa.string()),
                     pa.array(kept, pa.string())],
                    names=["doc_id", "n_bytes", "n_sentences", "n_removed", "removed_bytes", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = joined.select("doc_id", "text", "cuts").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_sentences bigint, n_removed bigint, removed_bytes bigint, "
             "kept_sha256 string, kept string")
    return done if keep_text else done.drop("kept")
